"""Lines that many documents share are dropped from all but one of them.

A line's key is the line without blanks at its ends, A-Z in lower case. The distinct keys that occur in at least `least_docs`
documents are put into shards by their hash. Each shard is a minimal perfect hash over its keys' first 64 bits, with arrays
of the keys' other 64 bits (fingerprints), their document counts and the largest document id that holds them. Documents
probe these arrays; lines are not joined. While the arrays of all shards fit in BROADCAST_BYTES (they are measured), every
worker gets them and documents are read once, without a shuffle. Beyond that, the documents' line hashes go to the shards,
dealt out by shard and by a salt of the document, and only the decisions come back.

Defined cases: a null text is an empty one, with one empty line; a row counts once for each of its keys, so rows that share
an id count as documents each and keep a line together; a null id is smaller than any other; an empty table gives no rows.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import NULL_ID, by_name, stored, text_slices
from textloom.llm.mph import PerfectHash

BLANKS = " \t\n\x0b\x0c\r"
LEAST_LENGTH = 20
LEAST_DOCS = 3
BROADCAST_BYTES = 64 << 20
KEYS_PER_SHARD = 200_000
PROBES_PER_GROUP = 500_000


def key_of(line: str, least_length: int) -> bytes | None:
    """128 bits for the line's key; None for a key that is too short."""
    key = line.strip(BLANKS)
    return xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower()) if len(key) >= least_length else None


def halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


class LineIndex:
    """Shards that can be probed."""

    def __init__(self, rows: list[tuple], shards: int):
        """rows: shard, hash, fingerprints, last ids."""
        self.shards = shards
        self.parts: dict[int, list] = {}
        for s, h, p, x in rows:
            self.parts.setdefault(int(s), []).append((PerfectHash.from_bytes(bytes(h)), np.frombuffer(bytes(p), np.int64), np.frombuffer(bytes(x), np.int64)))

    def last(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is a frequent one, and the largest id that holds it."""
        found, last = np.zeros(len(high), bool), np.zeros(len(high), np.int64)
        shard = np.mod(high, self.shards)
        for s in np.unique(shard).tolist():
            for index, prints, ids in self.parts.get(s, ()):
                at = np.flatnonzero(shard == s)
                number = index.find(high[at].view(np.uint64))
                at, number = at[number >= 0], number[number >= 0]
                ok = prints[number] == low[at]
                found[at[ok]], last[at[ok]] = True, ids[number[ok]]
        return found, last


def key_rows(batches: Iterator[pa.RecordBatch], least_length: int, counted: bool) -> Iterator[pa.RecordBatch]:
    """high, low, id (the largest), n for the distinct keys of each document; counted: added up over some documents."""
    for ids, texts in text_slices(batches, 0, 1):
        rows: dict = {}
        for key_id, text in zip(ids, texts, strict=True):
            for key in {key_of(line, least_length) for line in (text or "").split("\n")}:
                if key is not None:
                    if counted:
                        n, last = rows.get(key, (0, NULL_ID))
                        rows[key] = n + 1, max(last, key_id)
                    else:
                        rows[key, key_id] = 1, key_id
        high, low = halves([k if counted else k[0] for k in rows]) if rows else ([], [])
        n, last = zip(*rows.values(), strict=True) if rows else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(last, pa.int64()), pa.array(n, pa.int64())], ["high", "low", "id", "n"])


KEY_ROWS = "high long, low long, id long, n long"


def line_index(rows: DataFrame, least_length: int, least_docs: int) -> tuple[DataFrame, int]:
    """shard, hash, prints, last, counts of the keys that at least least_docs documents hold; the number of shards."""
    keys = rows.mapInArrow(lambda batches: key_rows(batches, least_length, True), KEY_ROWS)
    frequent = stored(keys.groupBy("high", "low").agg(F.sum("n").alias("n"), F.max("id").alias("last")).where(F.col("n") >= least_docs), "lines")
    shards = 1 + frequent.count() // KEYS_PER_SHARD

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        """One row; a further one for keys that share their first half with another key."""
        out, rest = [], pdf.sort_values(["high", "low"])
        while len(rest):
            now, rest = rest[~rest.duplicated("high")], rest[rest.duplicated("high")]
            high = now["high"].to_numpy(np.int64)
            index = PerfectHash.build(high.view(np.uint64))
            at, arrays = index.find(high.view(np.uint64)), {}
            for name in ("low", "last", "n"):
                arrays[name] = np.empty(len(at), np.int64)
                arrays[name][at] = now[name].to_numpy(np.int64)
            out.append({"shard": int(high[0] % shards), "hash": index.to_bytes(), "prints": arrays["low"].tobytes(), "last": arrays["last"].tobytes(), "counts": arrays["n"].astype(np.uint32).tobytes()})
        return pd.DataFrame(out)

    built = frequent.groupBy(F.pmod("high", F.lit(shards)).alias("shard")).applyInPandas(build, "shard long, hash binary, prints binary, last binary, counts binary")
    return stored(built, "line-index"), shards


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), least_length: int = LEAST_LENGTH, least_docs: int = LEAST_DOCS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, text (the lines that stay, joined by a line end), n_lines, n_dropped, and the columns to carry along."""
    given = by_name(docs, id=id_col, text=text_col, **{f"carried_{i}": c for i, c in enumerate(carry)}).withColumn("id", F.coalesce("id", F.lit(NULL_ID)).cast("long"))
    rows = given.select("id", "text")
    index, shards = line_index(rows, least_length, least_docs)
    size = index.agg(F.sum(F.length("hash") + F.length("prints") + F.length("last"))).first()[0] or 0
    carried = [given.schema[f"carried_{i}"] for i in range(len(carry))]
    schema = ", ".join(["id long", "text string", "n_lines long", "n_dropped long", *[f"{x.name} {x.dataType.simpleString()}" for x in carried]])

    def rewritten(batch: pa.RecordBatch, dropped_of) -> pa.RecordBatch:
        texts, n_lines, n_dropped = [], [], []
        for key_id, text, decided in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), dropped_of(batch), strict=True):
            lines = (text or "").split("\n")
            kept = [line for line in lines if key_of(line, least_length) not in decided] if decided else lines
            texts.append("\n".join(kept))
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(kept))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), *batch.columns[2 : 2 + len(carried)]], ["id", "text", "n_lines", "n_dropped", *[x.name for x in carried]])

    if size <= broadcast_bytes:
        sent = docs.sparkSession.sparkContext.broadcast([(r.shard, bytes(r.hash), bytes(r.prints), bytes(r.last)) for r in index.collect()])

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found_in = LineIndex(sent.value, shards)

            def dropped_of(batch: pa.RecordBatch) -> list[set]:
                out, keys, owners = [], [], []
                for i, (key_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                    out.append(set())
                    for key in {key_of(line, least_length) for line in (text or "").split("\n")} - {None}:
                        keys.append(key)
                        owners.append((i, key_id))
                if keys:
                    found, last = found_in.last(*halves(keys))
                    for k in np.flatnonzero(found).tolist():
                        i, key_id = owners[k]
                        if last[k] != key_id:
                            out[i].add(keys[k])
                return out

            for batch in batches:
                for start in range(0, batch.num_rows, 1000):
                    yield rewritten(batch.slice(start, 1000), dropped_of)

        done = given.select("id", "text", *[x.name for x in carried]).mapInArrow(probe, schema)
    else:
        decided = decisions(rows, index, shards, least_length)
        joined = given.join(decided, given["id"] == decided["of"], "left").select("id", "text", *[x.name for x in carried], "dropped")

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield rewritten(batch, lambda b: [set(x or ()) for x in b.column(b.num_columns - 1).to_pylist()])

        done = joined.mapInArrow(apply, schema)
    back = F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id")
    return done.select(back, "text", "n_lines", "n_dropped", *[F.col(x.name).alias(c) for x, c in zip(carried, carry, strict=True)])


def decisions(rows: DataFrame, index: DataFrame, shards: int, least_length: int) -> DataFrame:
    """of (an id), dropped (keys): line hashes meet the shards' arrays in groups by shard and salt."""
    probes = stored(rows.mapInArrow(lambda batches: key_rows(batches, least_length, False), KEY_ROWS).select("high", "low", "id"), "probes")
    salts = 1 + probes.count() // (shards * PROBES_PER_GROUP)
    dealt = probes.select(F.pmod("high", F.lit(shards)).alias("shard"), F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"), "high", "low", "id")
    arrays = index.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), "hash", "prints", "last")

    def probe(lines: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        if not len(lines) or not len(parts):
            return pd.DataFrame({"of": pd.Series(dtype="int64"), "key": pd.Series(dtype=object)})
        found_in = LineIndex(list(parts[["shard", "hash", "prints", "last"]].itertuples(index=False, name=None)), shards)
        high, low, ids = (lines[x].to_numpy(np.int64) for x in ("high", "low", "id"))
        found, last = found_in.last(high, low)
        out = found & (last != ids)
        keys = np.stack([high[out], low[out]], 1).astype("<i8")
        return pd.DataFrame({"of": ids[out], "key": [x.tobytes() for x in keys]})

    found = dealt.groupBy("shard", "salt").cogroup(arrays.groupBy("shard", "salt")).applyInPandas(probe, "of long, key binary")
    return found.groupBy("of").agg(F.collect_set("key").alias("dropped"))
