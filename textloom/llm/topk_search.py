"""Exact top-k by inner product with MaxScore over postings of signed vectors.

A term is a component with a sign. Its posting list in a shard holds the vectors whose component has that sign, with their
impacts. For a query, the lists with the query's own signs add to a score and have an upper bound each; the others only
lower it. Sorted by bound, the lists whose bounds together stay below the k-th best score known are non-essential: a vector
that is in none of the essential lists can't be among the best. So essential lists are traversed, and the vectors met there
are probed in the other lists, in the order of their bounds, while their score can still compete. Shards give their k best
for each query, and these are merged.

Vectors are packed into shards of at most SHARD_VECTORS where they lie. A task of the grid of vector_packs holds some blocks of at
most QUERY_BLOCK queries and streams some shards; the k-th best score of a query so far is the bound that the next shard begins
with, and only the k best of all the task's shards leave it. Nothing else is paired. Where the largest components of a query and a shard show that no sum can leave
64 bits, sums are taken in 64 bits, else in whole numbers of any size.

Defined cases: a vector that is null or holds null or non-finite components takes no part, nor does a row without an id;
scores are compared as they are, and one that does not fit into 64 bits is given as the nearest number that does;
shorter vectors are filled up with zeros; of queries that share an id the one with the least vector counts, while candidates
that share an id count each; a query's own rows are those with its id; an empty table gives no rows.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import by_name, stored
from textloom.llm.vector_packs import LONG, SAFE, cell_rows, dealt, largest, packs, unpacked, whole

SHARD_VECTORS = 2048
QUERY_BLOCK = 512
SEEDS = 32


def kth(values: np.ndarray, k: int):
    """The k-th largest."""
    return sorted(values.tolist())[-k] if values.dtype == object else np.partition(values, len(values) - k)[len(values) - k]


class Shard:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.given, self.exact = ids[order], vectors[order], None
        self.vectors = whole(self.given)
        self.most = largest(self.vectors)
        self.columns = np.ascontiguousarray(self.vectors.T)
        self.lists = {}
        for t, (column, size) in enumerate(zip(self.columns, np.abs(self.given.astype(float)).T, strict=True)):
            for sign in (1, -1):
                at = np.flatnonzero(column * sign > 0)
                if len(at):
                    # The strongest impacts come first: they give a query its first scores.
                    strong = at[np.argpartition(-size[at], min(SEEDS, len(at)) - 1)[:SEEDS]]
                    self.lists[t, sign] = at, column[at], largest(column[at]), strong

    def wide(self) -> tuple[np.ndarray, np.ndarray]:
        """Vectors and columns as integers of any size."""
        if self.exact is None:
            self.exact = self.vectors.astype(object), self.columns.astype(object)
        return self.exact

    def best(self, own_id: int, query: np.ndarray, k: int, known: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best, ties to the smaller id. known: a score that k other vectors reach, so that lower ones need not be found."""
        width = min(len(query), len(self.columns))
        query, vectors, columns = whole(query[:width]), self.vectors, self.columns
        if largest(query) * self.most * width >= SAFE:
            query, (vectors, columns) = query.astype(object), self.wide()
        terms = [(abs(int(q)) * found[2], t, found) for t, q in enumerate(query.tolist()) if q and (found := self.lists.get((t, 1 if q > 0 else -1)))]
        terms.sort(key=lambda x: (-x[0], x[1]))
        bounds = np.array([x[0] for x in terms], query.dtype)
        # rest[i]: what the lists from i on can add at most.
        rest = np.concatenate([np.cumsum(bounds[::-1])[::-1], [0]])
        seeds = np.unique(np.concatenate([x[2][3] for x in terms[:4]])) if terms else np.empty(0, np.int64)
        seeds = seeds[self.ids[seeds] != own_id]
        scores = vectors[seeds][:, :width] @ query
        least = kth(scores, k) if len(scores) >= k else None
        if known is not None:
            least = known if least is None else max(least, known)
        essential = len(terms)
        if least is not None:
            # An equal score may still win by its id, so only bounds below the least one make lists non-essential.
            while essential and rest[essential - 1] < least:
                essential -= 1
        if least is None or least <= 0:
            # Vectors in no list at all score 0 or less and may be among the best: all are candidates.
            candidates = np.arange(len(self.ids))
        else:
            met = np.zeros(len(self.ids), bool)
            for _, _, found in terms[:essential]:
                met[found[0]] = True
            candidates = np.flatnonzero(met)
        candidates = candidates[self.ids[candidates] != own_id]
        totals = np.zeros(len(candidates), query.dtype)
        # Components where lists of the other sign only lower the score come with their own component, in the order of bounds.
        order = [t for _, t, _ in terms] + sorted(set(np.flatnonzero(query).tolist()) - {t for _, t, _ in terms})
        step = 8
        for i in range(0, len(order), step):
            some = order[i : i + step]
            totals = totals + (query[some] @ columns[some][:, candidates] if len(candidates) * 4 > len(self.ids) else query[some] @ columns[np.ix_(some, candidates)])
            if least is not None:
                able = (totals + rest[min(i + step, len(terms))] >= least).astype(bool)
                if not able.all():
                    candidates, totals = candidates[able], totals[able]
        if len(totals) > k:
            enough = (totals >= kth(totals, k)).astype(bool)
            candidates, totals = candidates[enough], totals[enough]
        first = np.array(sorted(range(len(totals)), key=lambda i: (-totals[i], self.ids[candidates[i]]))[:k], np.int64)
        return self.ids[candidates[first]], totals[first]


def top_k(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "vector", shard_vectors: int = SHARD_VECTORS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score. vector_col: array of whole numbers, long or double; is_query: a condition on the column `id`."""
    rows = by_name(vectors, id=id_col, vector=vector_col).where(F.col("id").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()))
    shards = stored(packs(rows, shard_vectors), "vectors")
    queries = stored(packs(rows.where(is_query).groupBy("id").agg(F.min("vector").alias("vector")), query_block), "queries")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, best = [], []
        for kind, pack, _ in cell_rows(batches):
            if kind == 0:
                held += zip(*unpacked(pack), strict=True)
                continue
            best = best or [[] for _ in held]
            shard = Shard(*unpacked(pack))
            for i, (own, query) in enumerate(held):
                ids, totals = shard.best(int(own), query, k, best[i][-1][1] if len(best[i]) == k else None)
                if len(ids):
                    best[i] = sorted([*best[i], *zip(ids.tolist(), totals.tolist(), strict=True)], key=lambda x: (-x[1], x[0]))[:k]
        for (own, _), found in zip(held, best, strict=False):
            if found:
                ids, scores = zip(*found, strict=True)
                fitting = pa.array([min(max(x, LONG.min), LONG.max) for x in scores], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([int(own)] * len(ids), pa.int64()), pa.array(ids, pa.int64()), fitting, pa.array(map(place_of, scores), pa.string())], ["query_id", "vec_id", "score", "place"])

    found = dealt(shards, queries).mapInArrow(search, "query_id long, vec_id long, score long, place string")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("place"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def place_of(score: int) -> str:
    """Orders scores beyond 64 bits among each other and around all others, as text."""
    if LONG.min <= score <= LONG.max:
        return "1"
    digits = f"{abs(score):0700d}"
    return "2" + digits if score > 0 else "0" + digits.translate(NINES)


NINES = str.maketrans("0123456789", "9876543210")
