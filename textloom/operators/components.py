"""Connected components of a graph of links, in rounds of joins: no component is ever in one task."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least")).withColumnRenamed("a", "of")
    return both.join(least, F.col("a") == F.col("of")).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of these. edges: a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("least")).withColumnRenamed("a", "of")
    moved = edges.join(least, F.col("a") == F.col("of")).where(F.col("b") != F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select(F.col("of").alias("a"), F.col("least").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) of all nodes with a link. links: columns a and b of one type that can be ordered.

    Rounds of large and small stars until nothing moves; their number grows with the logarithm of the longest path. Each
    round's edges, never more than the links, are stored. A null end, a link of a node with itself and repeated links count for
    nothing; an empty table gives no rows.
    """
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = stored(links.where(F.col("a") != F.col("b")).select(a, b).distinct(), "edges")
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
        if not state[0]:
            break
        edges = stored(_small_star(_large_star(edges)).distinct(), "edges")
    # Stars only: every node hangs on the least one of its component.
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
