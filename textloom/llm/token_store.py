"""Token ids of documents in files of blocks, with constant-time access by document id.

A store is a Parquet data set with one row for each block of up to `block_bytes` of ids, so Spark's writer commits it, any
store that Spark reaches can hold it, and a lost executor costs only its unfinished blocks. Blocks follow each other in
ascending (shard, block) order, documents within them in ascending id order:

    shard, block      place of the block; a shard is one range of ids
    first_id, last_id smallest and largest id in the block (its statistics let Spark skip blocks)
    n_docs, n_ids     counts
    width             bytes of an id in the payload: 2 if every id of the vocabulary fits, else 4
    payload           the raw ids, little-endian, document after document
    bounds            n_docs + 1 numbers (int64): where each document's ids begin in the payload, counted in ids
    keys              the distinct ids (int64), ascending
    hash              minimal perfect hash of the keys
    prints            a 32-bit fingerprint for each number that the hash gives
    places, repeats   for each number: the key's first document in the block, and how many documents have that id

A look-up hashes the id, compares the fingerprint, then the id of the document that it leads to, and slices the payload; no
key is searched for.

Defined cases: a null text is an empty one; a null id is kept as the smallest 64-bit number (so it comes first and that
number itself may not be used); rows that share an id all stay, in the order of their texts' hashes; an empty table gives an
empty store; other columns are not read.
"""

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import NULL_ID, as_signed, by_name, mixed, shuffle_partitions, text_slices
from textloom.llm.mph import PerfectHash
from textloom.llm.pretokens import encoder

BLOCK_BYTES = 4 << 20
#: Characters that are encoded at a time: the more, the fewer words are looked up again.
SLICE_CHARS = 4 << 20
SCHEMA = "shard int, block int, first_id long, last_id long, n_docs int, n_ids long, width int, payload binary, bounds binary, keys binary, hash binary, prints binary, places binary, repeats binary"
ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("width", pa.int32()), *[(x, pa.binary()) for x in ("payload", "bounds", "keys", "hash", "prints", "places", "repeats")]])


def prints_of(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys.view(np.uint64), 977) >> np.uint64(32)).astype(np.uint32)


def block_row(shard: int, block: int, ids: np.ndarray, lengths: np.ndarray, numbers: np.ndarray, width: int) -> dict:
    """ids: of the documents, ascending; lengths: their token counts; numbers: all their tokens."""
    keys, first, repeats = np.unique(ids, return_index=True, return_counts=True)
    index = PerfectHash.build(keys.view(np.uint64))
    at = index.find(keys.view(np.uint64))
    prints, places, many = np.empty(len(keys), np.uint32), np.empty(len(keys), np.uint32), np.empty(len(keys), np.uint32)
    prints[at], places[at], many[at] = prints_of(keys), first, repeats
    bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return {
        "shard": shard, "block": block, "first_id": int(ids[0]), "last_id": int(ids[-1]), "n_docs": len(ids), "n_ids": int(bounds[-1]), "width": width,
        "payload": numbers.astype("<u2" if width == 2 else "<u4").tobytes(), "bounds": bounds.tobytes(), "keys": keys.tobytes(), "hash": index.to_bytes(), "prints": prints.tobytes(), "places": places.tobytes(), "repeats": many.tobytes(),
    }


class Block:
    """A block that was read: probes of its index."""

    def __init__(self, row: dict):
        self.row = row
        self.index = PerfectHash.from_bytes(row["hash"])
        self.prints, self.places, self.repeats = (np.frombuffer(row[x], np.uint32) for x in ("prints", "places", "repeats"))
        self.bounds, self.payload = np.frombuffer(row["bounds"], np.int64), np.frombuffer(row["payload"], "<u2" if row["width"] == 2 else "<u4")
        self.keys = np.frombuffer(row["keys"], np.int64)
        # The id of each document: a number of repeats for each key, in the order of ids.
        self.ids = np.repeat(self.keys, self.repeats[self.index.find(self.keys.view(np.uint64))])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first document of each key, -1 if the block has none, and how many documents have it."""
        at = self.index.find(keys.view(np.uint64))
        ok = at >= 0
        ok[ok] = self.prints[at[ok]] == prints_of(keys[ok])
        first, many = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        first[ok], many[ok] = self.places[at[ok]], self.repeats[at[ok]]
        # An absent id may have the fingerprint of another: the documents' own ids decide.
        other = ok & (self.ids[np.maximum(first, 0)] != keys)
        first[other], many[other] = -1, 0
        return first, many

    def ids_of(self, document: int) -> np.ndarray:
        return self.payload[self.bounds[document] : self.bounds[document + 1]]


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


def write_store(docs: DataFrame, path: str, model: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, block_bytes: int = BLOCK_BYTES) -> None:
    """Encode every whole text with the tokenizer file `model`, append end_id to each document, write the store to path.

    One shuffle, by ranges of the id, of the texts; sorting and encoding then go on within each range. Repeated ids are
    spread by their texts' hashes.
    """
    rows = by_name(docs, id=id_col, text=text_col).select(F.coalesce("id", F.lit(NULL_ID)).cast("long").alias("id"), "text", F.xxhash64("text").alias("tie"))
    ordered = rows.repartitionByRange(shards or shuffle_partitions(docs.sparkSession), "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block = TaskContext.get().partitionId(), 0
        own, extra = encoder(model), 0 if end_id is None else 1
        width = 2 if max(own.library.get_vocab_size(with_added_tokens=True), (end_id or 0) + 1) <= 1 << 16 else 4
        ids, lengths, numbers, size = [], [], [], 0

        def done() -> pa.RecordBatch:
            row = block_row(shard, block, np.concatenate(ids), np.concatenate(lengths), np.concatenate(numbers), width)
            return pa.RecordBatch.from_pylist([row], ARROW)

        for some, texts in text_slices(batches, 0, 1, SLICE_CHARS):
            found, offsets = own.encode(texts)
            if extra:
                found = np.insert(found, offsets[1:], end_id)
            ids.append(np.array(some, np.int64))
            lengths.append(np.diff(offsets) + extra)
            numbers.append(found)
            size += width * len(found)
            if size >= block_bytes:
                yield done()
                ids, lengths, numbers, size, block = [], [], [], 0, block + 1
        if ids:
            yield done()

    ordered.mapInArrow(encode, SCHEMA).write.parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def block_starts(store: DataFrame) -> DataFrame:
    """shard, block, start: the number of ids in all blocks before. Two prefix sums: over the shards' totals (a row for each shard), and within each shard."""
    sizes = store.select("shard", "block", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    before = shards.select("shard", (F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("before"))
    within = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    return sizes.select("shard", "block", (F.sum("n_ids").over(within) - F.col("n_ids")).alias("inner")).join(before, "shard").select("shard", "block", (F.col("before") + F.col("inner")).alias("start"))


def scan(store: DataFrame, per_document: Callable[[np.ndarray], dict], schema: str, arrow: list[tuple[str, pa.DataType]]) -> DataFrame:
    """Every document of the store, found through the index by the block's keys: doc_id, start, n_tokens and what per_document makes of the ids."""
    placed = store.join(block_starts(store), ["shard", "block"])
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), *arrow])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                block = Block(row)
                first, many = block.find(block.keys)
                rows = []
                for key, at, n in zip(block.keys.tolist(), first.tolist(), many.tolist(), strict=True):
                    for document in range(at, at + n):
                        ids = block.ids_of(document)
                        rows.append({"doc_id": None if key == NULL_ID else key, "start": row["start"] + int(block.bounds[document]), "n_tokens": len(ids)} | per_document(ids))
                yield pa.RecordBatch.from_pylist(rows, out)

    return placed.mapInArrow(read, f"doc_id long, start long, n_tokens long, {schema}")


def look_up(store: DataFrame, keys: list[int]) -> DataFrame:
    """doc_id, ids (array) of the given documents, a short list: blocks without any of them are skipped by their statistics."""
    wanted = np.array(sorted(set(keys)), np.int64)
    near = F.lit(False)
    for key in wanted.tolist():
        near |= (F.col("first_id") <= key) & (F.col("last_id") >= key)
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                block = Block(row)
                first, many = block.find(wanted)
                found = [(k, block.ids_of(d)) for k, a, n in zip(wanted.tolist(), first.tolist(), many.tolist(), strict=True) for d in range(a, a + n)]
                yield pa.RecordBatch.from_pylist([{"doc_id": k, "ids": as_signed(x).tolist()} for k, x in found], out)

    return store.where(near).mapInArrow(read, "doc_id long, ids array<int>")


def crc32_of_ids(ids: np.ndarray) -> dict:
    return {"ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())}
CRC32 = [("ids_crc32", pa.int64())]
