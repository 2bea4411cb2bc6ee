"""Hard negatives by an inverted multi-index: for each anchor and positive, the best rows of other labels within a window of scores.

A vector's two halves have a codebook each, fitted on a bounded sample; a row lies in the cell of its two nearest codewords. Rows
are sorted by label and cell into packs, and a pack knows for each label which cells it holds and how far its own rows' halves lie
from each codeword (radii). For an anchor, the inner product of its half with a codeword plus its length times the radius bounds
what that half can give, and two sorted lists of such bounds, one for each half, bound every cell. A heap visits cells in falling
order of the sum (multi-sequence): cells whose lower bound is above every window are passed over, others are scored exactly. It
stops when every window is certified: ten rows found, of which the last beats all that is left, or what is left lies below it.
What a task has found in one pack certifies windows of the next. Where whole packs are certified, no heap is begun.

Two passes over the index: one with the anchor's own label for its positives, one with all others for the negatives. Both go
through the grid of vector_packs, where a task holds some anchors and streams some packs. Results do not depend on the codebooks.

Bounds: codebooks have at most MOST_CODEWORDS words of a half, fitted on SAMPLE_WORDS times as many rows, taken by a hash of
their ids. Every row is in the index.

Defined cases: a row without an id, label or vector, or with a null or non-finite component, takes no part; shorter vectors are
filled up with zeros; an anchor's own rows are those with its id; of anchors that share an id the one with the least vector and
then label counts, while other rows that share an id count each; a score that does not fit into 64 bits counts as the nearest
number that does; an anchor without positives, or a positive without rows in its window, gives no row; so does an empty table;
other columns are not read, whatever their names.
"""

import heapq
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import by_name, shuffle_partitions, stored
from textloom.llm.vector_packs import EXACT, LONG, SAFE, cell_rows, dealt, finite_vector, largest, matrix, packs, saturated, unpacked, whole

PACK_VECTORS, ANCHOR_BLOCK = 1024, 256
MOST_CODEWORDS, SAMPLE_WORDS = 256, 64
#: Rows of a cell, about, for all labels together.
CELL_ROWS = 1024
#: Of the lengths of two vectors, what rounding may add to their product.
ROUNDING = 1e-9


class Codebooks(NamedTuple):
    half: int
    words: tuple[np.ndarray, np.ndarray]

    def halves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return vectors[:, : self.half], vectors[:, self.half :]

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        return np.stack([nearest(part, words) for part, words in zip(self.halves(vectors), self.words, strict=True)], 1)


def nearest(rows: np.ndarray, words: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.nan_to_num((words**2).sum(1) - 2 * rows @ words.T, nan=np.inf).argmin(1)


def fitted(sample: np.ndarray, count: int, rounds: int = 8) -> Codebooks:
    """Each half by Lloyd's rounds, begun from rows of the sample."""
    half = sample.shape[1] // 2
    books = []
    for part in (sample[:, :half], sample[:, half:]):
        words = np.unique(part, axis=0)
        words = words[np.random.default_rng(1).permutation(len(words))[:count]]
        for _ in range(rounds):
            code = nearest(part, words)
            sums = np.zeros_like(words)
            np.add.at(sums, code, part)
            n = np.bincount(code, minlength=len(words))[:, None]
            words = np.where(n > 0, sums / np.maximum(n, 1), words)
        books.append(words)
    return Codebooks(half, tuple(books))


def wide(vectors: np.ndarray, width: int) -> np.ndarray:
    return np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))


class Found:
    """The best rows of one window so far: those of the highest scores, ties to smaller ids."""

    def __init__(self, low: int, high: int, most: int):
        self.low, self.high, self.most = low, high, most
        self.ids, self.scores = np.empty(0, np.int64), np.empty(0, np.int64)

    def needs(self) -> int:
        """No row with a lower score can be among the best."""
        return int(self.scores[-1]) if len(self.ids) == self.most else self.low

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        fits = (scores >= self.needs()) & (scores <= self.high)
        if fits.any():
            ids, scores = np.concatenate([self.ids, ids[fits]]), np.concatenate([self.scores, scores[fits]])
            # The complement turns the order around without leaving 64 bits.
            first = np.lexsort((ids, ~scores))[: self.most]
            self.ids, self.scores = ids[first], scores[first]


class Anchor(NamedTuple):
    id: int
    label: int
    vector: np.ndarray
    most: int
    windows: list[Found]

    def needs(self) -> int:
        return min(w.needs() for w in self.windows)


class LabelCells:
    """The rows of one label in a pack, cell by cell."""

    def __init__(self, books: Codebooks, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray):
        order = np.lexsort((codes[:, 1], codes[:, 0]))
        self.ids, self.given, codes = ids[order], vectors[order], codes[order]
        self.vectors, self.floats, self.exact = whole(self.given), self.given.astype(float), None
        self.most = largest(self.vectors)
        starts = [0, *(np.flatnonzero((np.diff(codes, axis=0) != 0).any(1)) + 1).tolist(), len(ids)]
        self.cells, self.words, self.radii, self.lengths = {}, [], [], []
        own = []
        with np.errstate(all="ignore"):
            for part, words, code in zip(books.halves(self.floats), books.words, codes.T, strict=True):
                used, place = np.unique(code, return_inverse=True)
                away = np.nan_to_num(np.sqrt(((part - words[code]) ** 2).sum(1)), nan=np.inf)
                radii = np.zeros(len(used))
                np.maximum.at(radii, place, away)
                own.append(place)
                self.words.append(words[used])
                self.radii.append(radii)
                self.lengths.append(float(np.nan_to_num(np.sqrt((part**2).sum(1)), nan=np.inf).max()))
        for a, b in pairwise(starts):
            self.cells[int(own[0][a]), int(own[1][a])] = a, b

    def bounds(self, books: Codebooks, anchors: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """For each half and anchor the most and the least that each codeword's rows can give, and what rounding may add to a sum."""
        upper, lower, slack = [], [], np.ones(len(anchors))
        with np.errstate(all="ignore"):
            for part, words, radii, most in zip(books.halves(anchors), self.words, self.radii, self.lengths, strict=True):
                length = np.sqrt((part**2).sum(1))
                middle, reach = part @ words.T, length[:, None] * radii
                upper.append(np.nan_to_num(middle + reach, nan=np.inf))
                lower.append(np.nan_to_num(middle - reach, nan=-np.inf))
                slack += np.nan_to_num(ROUNDING * length * most, nan=np.inf)
        return upper, lower, slack

    def scores(self, anchor: Anchor, a: int, b: int) -> np.ndarray:
        most = anchor.most * self.most * max(1, len(anchor.vector))
        if most < EXACT:
            return (self.floats[a:b] @ anchor.vector.astype(float)).astype(np.int64)
        if most < SAFE:
            return self.vectors[a:b] @ anchor.vector
        return saturated((self.vectors[a:b].astype(object) @ anchor.vector.astype(object)).tolist())

    def visit(self, anchor: Anchor, upper: list[np.ndarray], lower: list[np.ndarray], slack: float) -> None:
        """Cells in falling order of their bounds, until all windows are certified."""
        first, second = np.argsort(-upper[0], kind="stable"), np.argsort(-upper[1], kind="stable")
        up, down = upper[0][first].tolist(), upper[1][second].tolist()
        high = max(w.high for w in anchor.windows)
        heap = [(-(up[0] + down[0]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            if slack - bound < anchor.needs():
                return
            # Each pair is pushed by one other pair, whose bound is not below its own.
            if j + 1 < len(down):
                heapq.heappush(heap, (-(up[i] + down[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(up):
                heapq.heappush(heap, (-(up[i + 1] + down[0]), i + 1, 0))
            p, q = int(first[i]), int(second[j])
            cell = self.cells.get((p, q))
            if cell is None or lower[0][p] + lower[1][q] - slack > high:
                continue
            scores, ids = self.scores(anchor, *cell), self.ids[cell[0] : cell[1]]
            others = (ids != anchor.id) & (scores >= anchor.needs()) & (scores <= high)
            if others.any():
                for window in anchor.windows:
                    window.add(ids[others], scores[others])


def searched(batches: Iterator[pa.RecordBatch], books: Codebooks, same_label: bool, windows_of, most: int) -> Iterator[pa.RecordBatch]:
    """anchor_id, place (of the window), id, score: what this task's packs hold for its anchors. windows_of gives an anchor's (low, high)."""
    width = sum(x.shape[1] for x in books.words)
    anchors: list[Anchor] = []
    floats = labels = None
    for kind, pack, info in cell_rows(batches):
        ids, vectors = unpacked(pack)
        info = info.reshape(len(ids), -1)
        if kind == 0:
            for own, vector, extra in zip(ids.tolist(), whole(wide(vectors, width)), info.tolist(), strict=True):
                windows = [Found(low, high, most) for low, high in windows_of(extra[1:])]
                anchors.append(Anchor(own, extra[0], vector, largest(vector), windows))
            continue
        if floats is None:
            floats = np.array([a.vector.astype(float) for a in anchors]).reshape(len(anchors), width)
            labels = np.array([a.label for a in anchors], np.int64)
        vectors = wide(vectors, width)
        for label in np.unique(info[:, 0]).tolist():
            own = info[:, 0] == label
            cells = LabelCells(books, ids[own], vectors[own], info[own][:, 1:])
            some = np.flatnonzero((labels == label) == same_label)
            for start in range(0, len(some), ANCHOR_BLOCK):
                part = some[start : start + ANCHOR_BLOCK]
                upper, lower, slack = cells.bounds(books, floats[part])
                best = upper[0].max(1) + upper[1].max(1) + slack
                for k in np.flatnonzero(best >= [anchors[i].needs() for i in part]).tolist():
                    cells.visit(anchors[part[k]], [x[k] for x in upper], [x[k] for x in lower], float(slack[k]))
    for anchor in anchors:
        for place, window in enumerate(anchor.windows):
            n = len(window.ids)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([anchor.id] * n, pa.int64()), pa.array([place] * n, pa.int32()), pa.array(window.ids), pa.array(window.scores)], ["anchor_id", "place", "id", "score"])


def best_of(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


FOUND = "anchor_id long, place int, id long, score long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, id_col: str = "vec_id", vector_col: str = "vector", label_col: str = "label", codewords: int | None = None, pack_vectors: int = PACK_VECTORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vector_col: an array of whole numbers, long or double; is_anchor: a condition on the column `id`. A negative's score is from
    low to high hundredths of the positive's. codewords: of each half; by default, so that cells hold about CELL_ROWS rows.
    """
    spark = vectors.sparkSession
    rows = by_name(vectors, id=id_col, vector=vector_col, label=label_col).where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite_vector(F.col("vector")))
    rows = rows.select("id", "vector", F.col("label").cast("long").alias("label"))
    count, width = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not count or not width:
        # Vectors without components give no score but 0, and it has no order: as many as there are, by id, would be all there is.
        width = 1
    if not count:
        return spark.createDataFrame([], RESULT)
    words = codewords or max(2, min(MOST_CODEWORDS, round((count / CELL_ROWS) ** 0.5)))
    picked = rows.select("vector", F.xxhash64("id").alias("hash"), "id").orderBy("hash", "id", "vector").limit(words * SAMPLE_WORDS).select("vector").toArrow()
    books = fitted(wide(matrix(picked.column(0).combine_chunks()), width).astype(float), words)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = books.codes(wide(matrix(batch.column(1)), width).astype(float)) if batch.num_rows else np.empty((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes[:, 0], pa.int64()), pa.array(codes[:, 1], pa.int64())], ["id", "vector", "label", "first", "second"])

    kind = rows.schema["vector"].dataType.simpleString()
    coded = rows.mapInArrow(code, f"id long, vector {kind}, label long, first long, second long")
    order = ["label", "first", "second", "id"]
    ranged = coded.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    index = stored(packs(ranged.select("id", "vector", F.array("label", "first", "second").alias("info")), pack_vectors), "negative_index")
    anchors = stored(rows.where(is_anchor).groupBy("id").agg(F.min(F.struct("vector", "label")).alias("own")).select("id", "own.vector", "own.label"), "anchors")

    def find_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return searched(batches, books, True, lambda _: [(LONG.min, LONG.max)], positives)

    own = stored(packs(anchors.select("id", "vector", F.array("label").alias("info")), ANCHOR_BLOCK), "anchor_packs")
    near = stored(best_of(dealt(index, own).mapInArrow(find_positives, FOUND), positives).select("anchor_id", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    def window(score: int) -> tuple[int, int]:
        return max(LONG.min, -(-low * score // 100)), min(LONG.max, high * score // 100)

    def find_negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return searched(batches, books, False, lambda scores: map(window, scores[1 : 1 + scores[0]]), negatives)

    # At most `positives` scores for each anchor, in the order of their ranks, with their number before them.
    scores = near.groupBy(F.col("anchor_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    info = F.concat(F.array(F.col("label"), F.size("scores").cast("long")), "scores")
    wanted = stored(packs(anchors.join(scores, "id").select("id", "vector", info.alias("info")), ANCHOR_BLOCK), "anchor_windows")
    found = best_of(dealt(index, wanted).mapInArrow(find_negatives, FOUND), negatives)
    ranked = found.select("anchor_id", "rank", (F.col("place") + 1).alias("positive_rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return ranked.join(near.withColumnRenamed("rank", "positive_rank"), ["anchor_id", "positive_rank"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
