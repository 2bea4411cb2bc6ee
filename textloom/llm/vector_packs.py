"""Vectors of whole numbers in packs, and the grid of tasks on which blocks of queries meet packs of all vectors.

A task of the grid holds one group of query packs and streams one group of packs, so what it has found so far bounds what the
next pack has to give. Query packs are copied to as many tasks as there are columns, packs to as many as there are rows: with Q
query packs and groups of GROUP_PACKS of them, that is Q * columns + packs * Q / GROUP_PACKS copies, whatever the number of packs.

Defined cases: shorter vectors are filled up with zeros; an empty table gives no packs; with no queries no task gets a row.
"""

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import shuffle_partitions

#: Query packs that a task holds.
GROUP_PACKS = 64
#: Sums stay below this where 64 bits are enough, and below the other one where doubles are exact.
SAFE, EXACT = 1 << 62, 1 << 53
LONG = np.iinfo(np.int64)


def packed(ids: np.ndarray, vectors: np.ndarray) -> bytes:
    """vectors: whole numbers, as 64-bit integers, or as doubles where some are larger."""
    return struct.pack("<IIc", *vectors.shape, b"i" if vectors.dtype == np.int64 else b"f") + ids.astype("<i8").tobytes() + vectors.tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, width, kind = struct.unpack_from("<IIc", data)
    return np.frombuffer(data, "<i8", n, 9), np.frombuffer(data, "<i8" if kind == b"i" else "<f8", n * width, 9 + 8 * n).reshape(n, width)


def whole(vectors: np.ndarray) -> np.ndarray:
    """As 64-bit integers, or as Python's integers where some are larger."""
    if vectors.dtype == np.int64:
        return vectors
    out = np.empty(vectors.shape, object)
    out.reshape(-1)[:] = [int(x) for x in vectors.reshape(-1).tolist()]
    return out


def largest(x: np.ndarray) -> int:
    return max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) if x.size else 0


def matrix(lists: pa.Array) -> np.ndarray:
    """Lists of numbers as rows, filled up with zeros; as 64-bit integers if they fit."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    numbers = lists.flatten().to_numpy(zero_copy_only=False)
    if numbers.dtype != np.int64 and np.abs(numbers).max(initial=0) < 2.0**62:
        numbers = numbers.astype(np.int64)
    vectors = np.zeros((len(lists), int(lengths.max(initial=1))), numbers.dtype)
    vectors[np.arange(vectors.shape[1]) < lengths[:, None]] = numbers
    return vectors


def packs(rows: DataFrame, most: int) -> DataFrame:
    """number, pack, info: rows (id, vector, and info, an array of longs, if there is one) in packs of at most `most`, where and as they lie."""
    given = rows.select("id", "vector", "info" if "info" in rows.columns else F.array().cast("array<long>").alias("info"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []

        def done(count: int) -> pa.RecordBatch:
            nonlocal number, held
            table = pa.Table.from_batches(held).combine_chunks()
            part, rest = table.slice(0, count), table.slice(count)
            held = rest.to_batches() if rest.num_rows else []
            ids, lists, info = (part.column(i).combine_chunks() for i in range(3))
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number - 1], pa.int64()), pa.array([packed(ids.to_numpy(), matrix(lists))], pa.binary()), pa.array([matrix(info).astype("<i8").tobytes()], pa.binary())], ["number", "pack", "info"])

        for batch in batches:
            held.append(batch)
            while sum(x.num_rows for x in held) >= most:
                yield done(most)
        if count := sum(x.num_rows for x in held):
            yield done(count)

    return given.mapInArrow(pack, "number long, pack binary, info binary")


def in_turn(table: DataFrame) -> DataFrame:
    """A stored table of packs with place, gapless from 0. Packs are numbered within the tasks that made them, so there is one offset for each of these."""
    task = F.shiftright("number", 32)
    counts = table.groupBy(task.alias("task")).agg(F.count("*").alias("n"))
    offsets = counts.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("offset"))
    return table.join(F.broadcast(offsets), task == F.col("task")).withColumn("place", F.col("offset") + F.col("number").bitwiseAND(0xFFFFFFFF)).drop("task", "offset")


def dealt(index: DataFrame, queries: DataFrame, group_packs: int = GROUP_PACKS) -> DataFrame:
    """cell, kind (0: queries, 1: index), number, pack, info: each query pack meets each pack of the index in one cell. Both are stored tables of packs.

    A partition is a cell. A cell's query packs come first, then the packs that it streams.
    """
    rows = max(1, -(-queries.count() // group_packs))
    columns = max(1, min(index.count(), -(-shuffle_partitions(index.sparkSession) // rows)))
    turn = lambda n: F.pmod("place", F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = in_turn(queries).withColumn("row", turn(rows)).withColumn("column", each(columns)).withColumn("kind", F.lit(0))
    streamed = in_turn(index).withColumn("column", turn(columns)).withColumn("row", each(rows)).withColumn("kind", F.lit(1))
    cells = own.unionByName(streamed).select((F.col("row") * columns + F.col("column")).alias("cell"), "kind", "number", "pack", "info")
    return cells.repartitionById(rows * columns, "cell").sortWithinPartitions("kind", "number")


def cell_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """kind, pack and info (as one row of numbers) of each row of dealt()."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column(1)[i].as_py(), batch.column(3)[i].as_py(), np.frombuffer(batch.column(4)[i].as_py(), "<i8")


def saturated(scores: list[int]) -> np.ndarray:
    return np.array([min(max(x, LONG.min), LONG.max) for x in scores], np.int64)


def finite_vector(vector: Column) -> Column:
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))


def whole_numbers(vector: Column, factor: int) -> Column:
    """floor(factor * x) of each component, taken in double and kept as one; null for a vector with a null or non-finite component."""
    scaled = F.transform(vector, lambda x: x.cast("double") * factor)
    # floor gives whole numbers of 64 bits; doubles from 2**53 on are whole already.
    return F.when(finite_vector(scaled), F.transform(scaled, lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)))

