"""Passages that documents with smaller ids also have, found with an FM-index per shard.

A window is WINDOW consecutive words. Equal windows have the same anchor, the least hash of their GRAM-word runs, so windows
go to shards by their anchors: consecutive windows with one anchor form a segment (its words are shipped once), and segments
whose anchor occurs in one document only are left out, as none of their windows can occur elsewhere. Each shard indexes its
distinct segments and streams them through backward search: matching statistics give, for each place with a match of WINDOW
words, all occurrences, and so the smallest id among them. Documents then drop the words in windows whose smallest id is
below their own.

Anchors with more than HOT_SEGMENTS distinct segments (the edges of a passage that very many documents share) are dealt out
further by the hash of each whole window, so that no shard has to hold them all.

Defined cases: a null text has no words; a null id is smaller than any other; rows that share an id are judged alike and do
not count as smaller than each other; texts shorter than a window stay as they are; an empty table gives no rows; other
columns are not read.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import NULL_ID, WORD_HASHES, by_name, gram_hashes, hot_keys, joined, marked, mixed, precise, stored, text_slices
from textloom.llm.fm_index import FmIndex

WINDOW = 50
GRAM = 8
#: Windows of a segment: longer runs are cut.
MOST_WINDOWS = 512
SHARD_WORDS = 150_000
HOT_SEGMENTS = 5_000
#: An odd number and its inverse, to hash runs of words by differences of sums.
BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 2**64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def anchors(words: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The least hash of the grams in each window."""
    least = gram_hashes(words, gram)
    width, want = 1, window - gram + 1
    if len(least) < want:
        return np.empty(0, np.uint64)
    while 2 * width <= want:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return np.minimum(least[: len(least) - (want - width)], least[want - width :])


def runs(values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values, cut to `most`."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(values)))
    if len(sizes) and sizes.max() > most:
        many = -(-sizes // most)
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        starts = np.repeat(starts, many) + nth * most
        sizes = np.diff(np.append(starts, len(values)))
    return starts, sizes


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def run_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the words from each start to each end; equal runs have equal ones wherever they stand."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers(BASE, len(words)), dtype=np.uint64)])
    return mixed((sums[ends] - sums[starts]) * powers(INVERSE, len(words) + 1)[starts], 3)


def segments(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """anchor, segment (a hash of its words), id, tie, start, windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, tie, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = WORD_HASHES.of(words_of(text.as_py()))
                found = anchors(words, window, gram)
                if len(found):
                    starts, sizes = runs(found, MOST_WINDOWS)
                    hashes = run_hashes(words, starts, starts + sizes + (window - 1))
                    out.append((found[starts].view(np.int64), hashes.view(np.int64), np.full(len(starts), key), np.full(len(starts), tie), starts.astype(np.int32), sizes.astype(np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["anchor", "segment", "id", "tie", "start", "windows"])

    return rows.mapInArrow(cut, "anchor long, segment long, id long, tie long, start int, windows int")


def least_ids(window: int):
    """For a shard's segments: the smallest id that has each window."""

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["anchor", "segment", "offset"])
        texts = [np.frombuffer(x, np.uint64) for x in pdf["words"]]
        sizes = np.array([len(x) for x in texts])
        _, numbers = np.unique(np.concatenate(texts), return_inverse=True)
        texts = np.split(numbers + 1, np.cumsum(sizes)[:-1])
        found = FmIndex(texts, window).statistics(texts, pdf["least"].to_numpy(np.int64))
        out = [least[: len(least) - window + 1].tobytes() for _, least in found]
        return pd.DataFrame({"anchor": pdf["anchor"], "segment": pdf["segment"], "offset": pdf["offset"], "found": out})

    return search


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hot_segments: int = HOT_SEGMENTS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by a space)."""
    rows = by_name(docs, id=id_col, text=text_col).select(F.coalesce("id", F.lit(NULL_ID)).cast("long").alias("id"), F.xxhash64("text").alias("tie"), "text")
    every = stored(segments(rows, window, gram), "segments")
    anchors_of_two = every.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("rows")).where(F.col("low") < F.col("high"))
    shared = stored(anchors_of_two.select("anchor", "rows"), "anchors")
    near = marked(every, shared, ["anchor"]).where("marked").drop("marked")
    # A few anchors of one document more do no harm: nothing is found for them.
    places = stored(near if precise(shared) else joined(near, shared.select("anchor"), ["anchor"], hot_keys(shared, ["anchor"], "rows"), "left_semi"), "places")

    least = F.min(F.struct("id", "tie", "start", "windows")).alias("at")
    distinct = places.groupBy("anchor", "segment").agg(least, F.count("*").alias("rows")).select("anchor", "segment", "rows", F.col("at.id").alias("least"), F.col("at.tie").alias("own"), F.col("at.start").alias("start"), F.col("at.windows").alias("windows"))
    distinct = stored(distinct, "distinct")
    ways = stored(distinct.groupBy("anchor").agg(F.count("*").alias("segments"), (F.floor(F.count("*") / hot_segments) + 1).cast("int").alias("ways")), "ways")
    dealt = joined(distinct, ways.select("anchor", "ways"), ["anchor"], hot_keys(ways, ["anchor"], "segments"))
    wanted = dealt.groupBy("least", "own").agg(F.collect_list(F.struct("anchor", "segment", "start", "windows", "ways")).alias("segments"))
    total = distinct.agg(F.sum(F.col("windows") + window - 1)).first()[0] or 0
    # The documents that are read for their segments, found before their texts are shuffled; of repeated rows one is enough.
    sources = stored(distinct.select(F.col("least").alias("id"), F.col("own").alias("tie")).distinct(), "sources")
    own_rows = marked(rows, sources, ["id", "tie"]).where("marked").select("id", "tie", "text").dropDuplicates(["id", "tie"])
    texts = own_rows.join(wanted, (F.col("id") == F.col("least")) & (F.col("tie") == F.col("own"))).select("least", "text", "segments")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            cuts, flat = lists.offsets.to_numpy(), [x.to_numpy(zero_copy_only=False) for x in lists.values.flatten()]
            for i, (least, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                words, out = WORD_HASHES.of(words_of(text.as_py())), []
                for anchor, segment, start, windows, many in zip(*(x[cuts[i] : cuts[i + 1]].tolist() for x in flat), strict=True):
                    own = words[start : start + windows + window - 1]
                    if many == 1:
                        out.append((anchor, segment, 0, 0, own.tobytes()))
                        continue
                    ways = gram_hashes(own, window) % np.uint64(many)
                    out += [(anchor, segment, s, int(ways[s]), own[s : s + size + window - 1].tobytes()) for s, size in zip(*(y.tolist() for y in runs(ways, MOST_WINDOWS)), strict=True)]
                kinds = {"anchor": pa.int64(), "segment": pa.int64(), "offset": pa.int32(), "way": pa.int32(), "words": pa.binary()}
                arrays = [pa.array([y[k] for y in out], kind) for k, kind in enumerate(kinds.values())]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.full(len(out), least, np.int64))], [*kinds, "least"])

    pieces = texts.mapInArrow(extract, "anchor long, segment long, offset int, way int, words binary, least long")
    shards = 1 + total // shard_words
    found = pieces.groupBy(F.pmod(F.xxhash64("anchor", "way"), F.lit(shards)).alias("shard")).applyInPandas(least_ids(window), "anchor long, segment long, offset int, found binary")
    # A hot segment's rows (a passage that very many documents hold) meet its few results where they are.
    pair = ["anchor", "segment"]
    met = joined(places, stored(found, "found"), pair, hot_keys(distinct, pair, "rows")).select("id", "tie", (F.col("start") + F.col("offset")).alias("start"), "found")

    def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The spans of words in windows that a smaller id has too."""
        for batch in batches:
            out = []
            for key, tie, start, data in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                hit = np.frombuffer(data, np.int64) < key
                for s, size in zip(*(x.tolist() for x in runs(hit, len(hit))), strict=True):
                    if hit[s]:
                        out.append((key, tie, start + s, start + s + size + window - 1))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["id", "tie", "low", "high"])

    spans = met.mapInArrow(covered, "id long, tie long, low int, high int").groupBy("id", "tie").agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    spans = stored(spans, "spans")
    # Texts without spans are not shuffled.
    told = marked(rows, spans, ["id", "tie"])
    touched = told.where("marked").join(spans, ["id", "tie"], "left").select("id", "text", "spans")
    others = told.where(~F.col("marked")).select("id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids, texts in text_slices(iter([batch]), 0, 1):
                some = batch.column(2).slice(at, len(ids)).to_pylist()
                at += len(ids)
                n_words, n_removed, kept = [], [], []
                for text, own in zip(texts, some, strict=True):
                    words = words_of(text)
                    n_words.append(len(words))
                    if own:
                        drop = np.zeros(len(words) + 1, np.int64)
                        for x in own:
                            drop[x["low"]] += 1
                            drop[x["high"]] -= 1
                        words = [words[i] for i in np.flatnonzero(np.cumsum(drop)[:-1] == 0).tolist()]
                    n_removed.append(n_words[-1] - len(words))
                    kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept"])

    done = touched.union(others).mapInArrow(rewrite, "id long, n_words long, n_removed long, kept string")
    return done.select(F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept")
