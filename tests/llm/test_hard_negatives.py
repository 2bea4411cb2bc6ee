import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import hard_negatives, queries, vector_packs

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def wanted(rows, is_anchor, positives=5, negatives=10):
    """All pairs, in Python's integers."""
    rows = [(i, v, label) for i, v, label in rows if i is not None and label is not None and v is not None and None not in v]
    out = []
    clip = lambda x: min(max(x, vector_packs.LONG.min), vector_packs.LONG.max)
    anchors = {}
    for i, v, label in rows:
        if is_anchor(i):
            anchors[i] = min(anchors.get(i, (v, label)), (v, label))
    for i, (v, label) in anchors.items():
        scored = [(-clip(sum(int(x) * int(y) for x, y in zip(v, w, strict=False))), j, own) for j, w, own in rows if j != i]
        for s, j, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            fits = sorted(x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s)[:negatives]
            out += [(i, j, rank + 1, k, -s, -t) for rank, (t, k, _) in enumerate(fits)]
    return sorted(out)


def random_rows(seed, n=700, width=9, spread=40):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-spread, spread, (6, width))
    rows = []
    for i in range(n):
        label = int(rng.integers(0, 4))
        rows.append((i, (centres[(label + int(rng.integers(0, 3))) % 6] + rng.integers(-9, 9, width)).tolist(), label))
    rows += [(n + i, rows[10][1], 1) for i in range(200)]
    return rows


@pytest.mark.parametrize(("codewords", "pack"), [(1, 64), (5, 64), (None, 1024), (16, 7)])
def test_against_all_pairs(spark, codewords, pack):
    """Whatever the codebooks and packs: a vector that a quarter of the rows share, ties, labels of any number."""
    rows = random_rows(codewords or 9)
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>, label int").withColumns({x: F.lit(None) for x in ("id", "info", "first", "place", "score")})
    found = hard_negatives.hard_negatives(df, F.col("id") % 20 == 0, codewords=codewords, pack_vectors=pack)
    assert found.columns == COLUMNS
    want = wanted(rows, lambda i: i % 20 == 0)
    assert sorted(map(tuple, found.collect())) == want and len(want) > 500


def test_cells_are_passed_over(spark):
    """The heap stops at certified windows: of well separated cells, few are scored."""
    rng = np.random.default_rng(2)
    centres = rng.integers(-1000, 1000, (40, 16))
    vectors = np.concatenate([c + rng.integers(-3, 3, (50, 16)) for c in centres])
    books = hard_negatives.fitted(vectors.astype(float), 16)
    cells = hard_negatives.LabelCells(books, np.arange(len(vectors)), vectors, books.codes(vectors.astype(float)))
    anchor = hard_negatives.Anchor(-1, 0, vectors[0], int(abs(vectors[0]).max()), [hard_negatives.Found(vector_packs.LONG.min, vector_packs.LONG.max, 5)])
    upper, lower, slack = cells.bounds(books, vectors[:1].astype(float))
    scored = []
    plain = cells.scores
    cells.scores = lambda a, start, end: scored.append(end - start) or plain(a, start, end)
    cells.visit(anchor, [x[0] for x in upper], [x[0] for x in lower], float(slack[0]))
    assert sum(scored) < len(vectors) // 4
    assert anchor.windows[0].scores.tolist() == sorted((vectors @ vectors[0]).tolist(), reverse=True)[:5]


def test_odd_vectors(spark):
    big = float(2**70)
    rows = [(0, [1, 2], 1), (0, [1, 2], 1), (0, [0, 5], 2), (1, [3, 4, 5], 1), (1, [3, 4, 5], 1), (2, [5, 5], 2), (3, [1, 1], 2), (4, [2], 2), (5, [], 2), (20, None, 1), (40, [1, 1], None), (None, [1, 1], 1), (7, [1, None], 1), (60, [0, 0], 3), (61, [0, 1], 3), (62, [9, -9], 3)]
    schema = "vec_id long, vector array<double>, label long"
    for own in (rows, [*rows, (80, [big, 0], 1), (81, [big, 1], 1), (82, [big / 2, -1], 2), (83, [-big, 0], 2)], [(0, [], 1), (1, [], 1), (2, [], 2)], [(0, [2], 1), (1, [3], 1), (2, [2], 2)]):
        df = spark.createDataFrame([(i, v and [None if x is None else float(x) for x in v], label) for i, v, label in own], schema)
        found = hard_negatives.hard_negatives(df, F.col("id") % 20 == 0)
        assert sorted(map(tuple, found.collect())) == wanted(own, lambda i: i % 20 == 0)
    assert hard_negatives.hard_negatives(df.limit(0), F.col("id") % 20 == 0).collect() == []
    assert hard_negatives.hard_negatives(df, F.lit(False)).collect() == []


def test_query_and_its_sql(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, [round(rng.gauss(0.02, 0.1), 4) for _ in range(12)], rng.randint(0, 9)) for i in range(1500)]
    rows += [(1600, None, 1), (1700, [0.1] * 12, None), (1800, [float("nan")] * 12, 1), (1900, [None] * 12, 1), (2000, [float("inf")] * 12, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    df = queries.op11_hard_negatives(spark, str(tmp_path))
    assert df.dtypes == [(c, "int" if c == "rank" else "bigint") for c in COLUMNS]
    duckdb.sql(f"create or replace view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = duckdb.sql(f"select {', '.join(COLUMNS)} from ({queries.oracle_sql()['op11_hard_negatives']}) order by all").fetchall()
    assert sorted(map(tuple, df.collect())) == want and len(want) > 100


def test_copies_grow_with_tasks(spark):
    """Query packs go to as many cells as there are tasks, not packs; every pair meets once; groups of queries are bounded."""
    rows = spark.range(1000).select("id", F.array(F.col("id")).alias("vector"))
    index, own = (vector_packs.packs(rows.repartition(4), n).persist() for n in (10, 50))
    for group in (64, 7, 1):
        found = vector_packs.dealt(index, own, group).select("cell", "kind", "number").collect()
        pairs = [(q.number, p.number) for q in found for p in found if q.kind == 0 and p.kind == 1 and q.cell == p.cell]
        assert len(pairs) == len(set(pairs)) == own.count() * index.count()
        groups = -(-own.count() // group)
        assert len({r.cell for r in found}) == groups * -(-4 // groups)
        per_cell = [sum(r.kind == 0 for r in found if r.cell == c) for c in {r.cell for r in found}]
        assert max(per_cell) <= group
