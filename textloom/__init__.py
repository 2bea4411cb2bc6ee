"""A Spark-native engine for building and analysing a corpus of collected web documents."""
