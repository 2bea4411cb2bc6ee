"""Shards by jump consistent hashing, with DataFrame functions only.

A row's shard follows from its key and the number of shards alone. With one more shard, only the rows that go into it move.
The jumps take their random numbers from md5(key:step), 32 bits each, which any SQL engine can repeat.

Defined cases: a null key counts as the text "null"; a null text has size 1; rows that share a key share a shard, with a
slot each; an empty table gives no rows; other columns are not read.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import by_name, shuffle_partitions, stored

LAW = "key"
#: A key makes about as many jumps as the logarithm of the number of shards.
JUMPS = 128


def draw(key: Column, step: Column | int) -> Column:
    """A number from 0 to 2**32 - 1."""
    step = F.lit(step) if isinstance(step, int) else step
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), step.cast("string"))), 1, 8), 16, 10).cast("long")


def jump_shard(key: Column, shards: int) -> Column:
    """From 0 to shards - 1. The jump goes from shard b to floor((b + 1) * 2**32 / (draw + 1)) until that lies beyond the last."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")

    def jump(state: Column, step: Column) -> Column:
        there = F.floor((state["next"] + 1) * F.lit(float(2**32)) / (draw(key, step) + 1)).cast("long")
        return F.when(state["next"] >= shards, state).otherwise(F.struct(state["next"].alias("at"), there.alias("next")))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("next"))
    steps = min(shards, JUMPS)
    reached = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, jump)
    if shards <= JUMPS:
        return reached["at"].cast("int")
    # A key that needs more jumps than any is likely to goes on through all that are possible.
    longest = F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, jump)
    return F.when(reached["next"] >= shards, reached["at"]).otherwise(longest["at"]).cast("int")


def sharded(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless from 0 in each shard, in id order), grown_shard (with one more shard).

    Slots come from one sort by ranges of (shard, id) of narrow rows, which are stored, and from the counts of its
    partitions: no task holds a whole shard.
    """
    key = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    rows = by_name(docs, id=id_col, text=text_col).select(
        F.col("id").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit(LAW).alias("law"),
        jump_shard(key, shards).alias("shard"),
        jump_shard(key, shards + 1).alias("grown_shard"),
    )
    order = ["shard", "doc_id", "text_crc32", "size"]
    spread = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    # The number is the partition's, shifted by 33 bits, plus the row's place in it.
    placed = stored(spread.withColumn("at", F.monotonically_increasing_id()), "shards")
    part, place = F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy("shard", part).agg(F.count("*").alias("n"), F.min(place).alias("least"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    starts = counts.select(F.col("shard").alias("of"), F.col("part").alias("range"), (F.sum("n").over(before) - F.col("n") - F.col("least")).alias("start"))
    found = placed.join(starts, (F.col("shard") == F.col("of")) & (F.shiftright("at", 33) == F.col("range")))
    return found.select("doc_id", "size", "text_crc32", "law", "shard", (place + F.col("start")).alias("slot"), "grown_shard")

