"""Helpers that the operators of this subpackage share."""

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.session import scratch_path, stored

__all__ = ["scratch_path", "stored"]

#: Stands for a null id inside binary structures that hold plain 64-bit ids.
NULL_ID = -(2**63)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Words (of 64 bits) of a filter of keys: about 60 MB where it is broadcast.
FILTER_WORDS = 1 << 20
#: A key with fewer rows than this is never called hot, and no more keys than this are.
HOT_ROWS, MOST_HOT = 1000, 4096
#: Bits of a filter for each key.
KEY_BITS = 16


def marked(rows: DataFrame, keys: DataFrame, on: list[str], flag: str = "marked") -> DataFrame:
    """rows with a flag: true wherever the columns `on` are a key of `keys` (a stored table), and for few other rows.

    A Bloom filter as a table of words that is broadcast: KEY_BITS bits a key, and never more than FILTER_WORDS, whatever the number
    of keys. Beyond that more rows are marked than need be, but never fewer. What is marked still has to be joined.
    """
    words = 1 << min(FILTER_WORDS.bit_length() - 1, max(10, (keys.count() * KEY_BITS // 64).bit_length()))
    hashed = F.xxhash64(*on)
    slot = F.pmod(hashed, F.lit(words))
    bit = lambda shift: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(hashed, shift).bitwiseAND(63).cast("int"))
    bits = bit(40).bitwiseOR(bit(50))
    table = keys.select(slot.alias("filter_slot"), bits.alias("filter_bits")).groupBy("filter_slot").agg(F.bit_or("filter_bits").alias("filter_bits"))
    found = rows.join(F.broadcast(table), slot == F.col("filter_slot"), "left")
    return found.withColumn(flag, F.coalesce(F.col("filter_bits").bitwiseAND(bits) == bits, F.lit(False))).drop("filter_slot", "filter_bits")


def precise(keys: DataFrame) -> bool:
    """Whether a filter of these keys has its full number of bits for each, so that it marks about one other row in forty."""
    return keys.count() * KEY_BITS <= 64 * FILTER_WORDS


def hot_keys(counts: DataFrame, on: list[str], rows: str) -> DataFrame:
    """The MOST_HOT keys with the most rows, if they have more than HOT_ROWS: those that would fill tasks of their own.

    counts: a stored table with a row for each key and the number of its rows.
    """
    return counts.where(F.col(rows) > HOT_ROWS).orderBy(F.desc(rows), *on).limit(MOST_HOT).select(*on)


def joined(rows: DataFrame, keys: DataFrame, on: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with keys (inner or left_semi): rows with a hot key stay where they are and get their few keys by broadcast; others are shuffled."""
    few = F.broadcast(hot)
    return rows.join(F.broadcast(keys.join(few, on, "left_semi")), on, how).unionByName(rows.join(few, on, "left_anti").join(keys, on, how))


#: Of the C library, where it has it: gives freed memory back to the system.
TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def released() -> None:
    """Gives unused memory back: else a worker, which serves many stages, keeps what its largest batch took."""
    pa.default_memory_pool().release_unused()
    if TRIM:
        TRIM(0)


def text_slices(batches: Iterator[pa.RecordBatch], id_at: int, text_at: int, most: int = 1 << 20) -> Iterator[tuple[list, list]]:
    """Ids and texts in lists of about `most` characters; one longer text stands alone."""
    for batch in batches:
        ids, texts, size = [], [], 0
        column = batch.column(text_at)
        for i, key in enumerate(batch.column(id_at).to_pylist()):
            text = column[i].as_py()
            ids.append(key)
            texts.append(text)
            size += len(text or "")
            if size >= most:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts
        released()


class WordHashes(dict):
    """Word (bytes) to a 64-bit number; holds at most `most` words and then starts afresh."""

    def __init__(self, most: int = 80_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        found = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 64:
            self[word] = found
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: One per Python worker.
WORD_HASHES = WordHashes()


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits of x."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k consecutive words (given as 64-bit numbers); empty if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    factor = 1
    for i in range(k):
        out += words[i : i + n] * np.uint64(factor)
        factor = factor * 0xD1342543DE82EF95 % 2**64
    return mixed(out, k)


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Rows that go to Python at a time. Texts may be long, and a worker holds a batch several times over.
MOST_RECORDS = 1000
RECORDS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def by_name(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the names that the operator uses: other columns and their names do not matter.

    Every operator begins here, so here the session's batches for Python are brought down to MOST_RECORDS rows if they are larger.
    """
    if not 0 < int(df.sparkSession.conf.get(RECORDS_SETTING)) <= MOST_RECORDS:
        df.sparkSession.conf.set(RECORDS_SETTING, str(MOST_RECORDS))
    return df.select(*[F.col(f"`{given}`").alias(name) for name, given in columns.items()])
