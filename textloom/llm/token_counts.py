"""Token counts of whole texts, in one pass; no text is shuffled.

Two tiers: a table of frequent pre-tokens and their lengths goes to every worker once; what it lacks is encoded by the
library through each worker's own cache. The table only saves work: counts are the library's for any table.

Bounds: the table has at most TABLE_WORDS entries of at most LONGEST_WORD characters (about 2 MB), taken from the chunks of
about SAMPLE_DOCS documents that a hash of the id and text picks. Their chunks are counted where they lie, and only chunks
with their counts are shuffled. Every document is counted whole. With a tokenizer file whose texts can't be taken apart at
white space (see pretokens) there is no table, and whole texts are encoded.

Defined cases: a null text is an empty one with 0 tokens; repeated rows are counted each; an empty table gives no rows;
other columns are not read.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import by_name, released, text_slices
from textloom.llm.pretokens import LONGEST_WORD, chunks, encoder

SAMPLE_DOCS = 2_000
TABLE_WORDS = 50_000


def frequent_lengths(docs: DataFrame, model: str, sample_docs: int = SAMPLE_DOCS, table_words: int = TABLE_WORDS) -> tuple[list[str], list[int]]:
    """The most frequent chunks of a sample of about sample_docs documents and their token counts. docs: id, text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counter()
        for _, texts in text_slices(batches, 0, 1):
            distinct, codes, _ = chunks(texts)
            found.update(dict(zip(distinct.to_pylist(), np.bincount(codes, minlength=len(distinct)).tolist(), strict=True)))
            if len(found) > 4 * table_words:
                # Counts so far go on and are added up behind the shuffle.
                yield rows_of(found)
                found = Counter()
        yield rows_of(found)

    def rows_of(found: Counter) -> pa.RecordBatch:
        kept = [(w, n) for w, n in found.items() if len(w) <= LONGEST_WORD]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = encoder(model).of_chunks(batch.column(0).cast(pa.large_string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int32())], ["word", "tokens"])

    if not encoder(model).chunked:
        return [], []
    # Of 64-bit hashes, those below the sample's share of all.
    share = min(1.0, sample_docs / max(1, docs.count()))
    picked = docs.where(F.col("text").isNotNull() & (F.xxhash64("id", "text") <= F.lit(min(2**63 - 1, int(share * 2**64) - 2**63)).cast("long")))
    words = picked.select("id", "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    best = words.orderBy(F.desc("n"), "word").limit(table_words).select("word").mapInArrow(lengths, "word string, tokens int")
    rows = best.collect()
    return [x[0] for x in rows], [x[1] for x in rows]


def token_counts(docs: DataFrame, model: str, limit: int, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, table_words: int = TABLE_WORDS) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens by the tokenizer file `model`, over_limit (n_tokens > limit)."""
    rows = by_name(docs, id=id_col, text=text_col)
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(rows, model, sample_docs, table_words))
    kind = rows.schema["id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, lengths = pa.array(table.value[0], pa.large_string()), np.array([*table.value[1], 0], np.int64)
        for batch in batches:
            for part in parts(batch):
                if not encoder(model).chunked:
                    _, offsets = encoder(model).encode(part.column(1).to_pylist())
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(np.diff(offsets))], ["doc_id", "n_bytes", "n_tokens"])
                    continue
                distinct, codes, offsets = chunks(part.column(1).to_pylist())
                at = pc.fill_null(pc.index_in(distinct, value_set=words), len(words)).to_numpy(zero_copy_only=False)
                own = lengths[at]
                missed = at == len(words)
                own[missed] = [len(x) // 4 for x in encoder(model).of_chunks(distinct.filter(pa.array(missed)))]
                sums = np.concatenate([[0], np.cumsum(own[codes])])[offsets]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(np.diff(sums))], ["doc_id", "n_bytes", "n_tokens"])

    sized = rows.select("id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = sized.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def parts(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about `most` bytes (by the third column); one longer text stands alone."""
    size = np.cumsum(batch.column(2).to_numpy(zero_copy_only=False)) // most
    cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)
    released()
