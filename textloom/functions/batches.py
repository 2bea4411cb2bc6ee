"""How much goes to Python at a time. A worker holds a batch several times over, and keeps what its largest one took."""

import ctypes

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows and bytes of a batch, whatever the table's size. Fixed values.
MOST_RECORDS, MOST_BYTES = 1000, 4 << 20
RECORDS_SETTING, BYTES_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
#: Of the C library, where it has it: gives freed memory back to the system.
TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def small_batches(spark: SparkSession) -> None:
    """The session's batches for Python are brought down to the limits above if they are larger; all rows still go."""
    for setting, most in ((RECORDS_SETTING, MOST_RECORDS), (BYTES_SETTING, MOST_BYTES)):
        given = spark.conf.get(setting)
        number = int(given.rstrip("b")) if given.rstrip("b").lstrip("-").isdigit() else 0
        if not 0 < number <= most:
            spark.conf.set(setting, str(most))


def released() -> None:
    """Gives unused memory back to the system."""
    pa.default_memory_pool().release_unused()
    if TRIM:
        TRIM(0)
