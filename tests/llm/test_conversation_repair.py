import collections
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from textloom.llm import conversation_repair, queries

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def random_rows(seed, conversations=40, most=14):
    rng, rows = random.Random(seed), []
    for conv in range(conversations):
        for _ in range(rng.randint(1, most)):
            turn = None if rng.random() < 0.1 else rng.randint(0, 12)
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "u", "s"])
            text = rng.choice(["Yes.", "No", "Why?", "", " \t", None, "So it goes!", "a.\n", "b \n", "é", "x" * 50 + "."])
            rows.append((conv if conv else None, turn, role, text))
    return rows


def wanted(rows):
    each = collections.defaultdict(list)
    for conv, *row in rows:
        each[conv].append(row)
    return {conv: brute.conversation(own) for conv, own in each.items()}


@pytest.mark.parametrize("segment_rows", [1, 3, 1024])
def test_against_all_edits(spark, segment_rows):
    """Costs, audits, digests and what is left, whatever the segments, with null, repeated and unordered rows."""
    rows = random_rows(segment_rows)
    rows += [(100, i, "user" if i % 2 else "assistant", f"text {i}{'.' if i % 5 else ''}") for i in range(60)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({x: F.lit(None).cast("string") for x in ("conv", "segment", "row", "tie", "fault", "text ")})
    found = conversation_repair.repaired(df, segment_rows=segment_rows)
    want = wanted(rows)
    assert {r["conv"]: tuple(r[c] for c in COLUMNS) for r in found.conversations.collect()} == {c: x for c, (x, _) in want.items()}
    left = collections.defaultdict(list)
    for r in found.turns.orderBy("segment", "number").collect():
        left[r["conv"]].append((r["edit"], r["role"], r["text"]))
    assert left == {c: x for c, (_, x) in want.items() if x}


def test_runs_and_powers():
    """A run's matrix is the product of its rows' matrices, and a long run's edits are those of the plain search."""
    for role in ("system", "user", "assistant", "tool"):
        for fault in range(4):
            sign = conversation_repair.symbol(role, fault)
            step = out = conversation_repair.run(sign, 1)
            for n in range(2, 20):
                out = conversation_repair.product(out, step)
                assert out == conversation_repair.run(sign, n) == conversation_repair.matrix_of(bytes([sign]) * n)
    signs = bytes([conversation_repair.symbol("user", 0)] * 700 + [conversation_repair.symbol("assistant", 2)] * 500)
    (audit, state), *_ = conversation_repair.unrolled(signs, conversation_repair.END, (conversation_repair.START,))
    want = brute.cheapest_edits([("u", "")] * 700 + [("a", "truncated")] * 500)
    assert audit + conversation_repair.last_inserts(state) == want[1]
    assert conversation_repair.applied(conversation_repair.matrix_of(signs), conversation_repair.END)[0] == want[0]


def test_a_long_conversation_takes_many_tasks(spark):
    """A third of all rows in one conversation, most of them the same row: several segments from several tasks."""
    rows = [(7, i // 2, "user", "The same.") for i in range(3000)] + [(i, i % 3, "assistant", "Other.") for i in range(1000, 6000)]
    segments = conversation_repair.sorted_segments(spark.createDataFrame(rows, "conv long, turn long, role string, text string"), 200)
    own = segments.where("conv = 7").select("segment", F.size("roles").alias("n")).collect()
    assert len({r["segment"] >> 32 for r in own}) > 1 and max(r["n"] for r in own) <= 200
    found = conversation_repair.repaired(spark.createDataFrame(rows, SCHEMA), segment_rows=200).conversations.where("conv = 7").first()
    assert tuple(found[c] for c in COLUMNS) == wanted([r for r in rows if r[0] == 7])[7][0]


def test_query_and_its_sql(spark, tmp_path):
    """The contract's columns, damage of all kinds, conversations without rows left, against SQL and plain Python."""
    rows = random_rows(5, 120) + [(1000 + i, None if i % 3 else i, "user", "Only this.") for i in range(60)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    df = queries.op13_conversation_repair(spark, str(tmp_path))
    assert df.dtypes == [("conv_id", "bigint"), *[(c, "bigint") for c in COLUMNS[:6]], ("audit", "string"), ("repaired_sha256", "string")]
    found = {r["conv_id"]: tuple(r)[1:] for r in df.collect()}
    damaged = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        dealt = brute.crc(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if dealt == 1 else re.sub("[.!?]", "", text) if dealt == 2 else text
        damaged += [(conv, turn, "user" if dealt == 4 else role, text)] * (0 if dealt == 0 else 2 if dealt == 3 else 1)
    none = (0, 0, 0, 0, 0, 0, "", brute.sha(""))
    want = {c: none for c, *_ in rows} | {c: x for c, (x, _) in wanted(damaged).items()}
    assert found == want and none in want.values()
    duckdb.sql(f"create or replace view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert {r[0]: r[1:] for r in duckdb.sql(f"select conv_id, {', '.join(COLUMNS)} from ({queries.oracle_sql()['op13_conversation_repair']})").fetchall()} == want


def test_no_rows(spark):
    found = conversation_repair.repaired(spark.createDataFrame([], SCHEMA))
    assert found.conversations.collect() == found.turns.collect() == []
