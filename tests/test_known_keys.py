import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.functions.urls import url_hash
from textloom.operators import store
from textloom.operators.known_keys import KnownKeys


def keyed(spark, urls, first=0, tenant="a"):
    rows = [(first + i, tenant, u) for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, "id long, workspace_id string, url string").withColumn("url_hash", url_hash(F.col("url")))


def batch_of(spark, urls, tenant="a"):
    return spark.createDataFrame([(i, tenant, u, "p", "b") for i, u in enumerate(urls)], "ordinal long, workspace_id string, url string, publisher string, cleaned_body string")


def candidates_of(spark, pairs, tenant="a"):
    return spark.createDataFrame([(tenant, k, u, i % 5, 1, None, i % 2, i) for i, (k, u) in enumerate(pairs)], "workspace_id string, keyword string, url string, rank int, job_id long, found_at timestamp, priority int, ordinal long")


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def stored_side(df):
    """The plan's lines from the join's stored side: what stands under the scan's own branch."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    scan = next(i for i, x in enumerate(lines) if "known_keys_" in x)
    depth = lambda x: len(re.match(r"^[ :+\-*()0-9]*", x).group(0))
    out, at = [lines[scan]], depth(lines[scan])
    for line in reversed(lines[:scan]):
        if depth(line) < at:
            out, at = [*out, line], depth(line)
            if "Join" in line:
                return plan, out
    return plan, out


def test_plans_leave_the_stored_side(spark, tmp_path, no_broadcast):
    known = KnownKeys(spark, f"file://{tmp_path}/keys", buckets=7)
    known.add(keyed(spark, [f"http://h/{i}" for i in range(50)]))
    for df in (store.unknown_rows(batch_of(spark, ["http://h/1"]), known), store.placed_hits(candidates_of(spark, [("k", "http://h/1")]), known)):
        plan, side = stored_side(df)
        assert "Bucketed: true" in plan and "Join" in side[-1]
        assert not any("Exchange" in x for x in side)
        assert re.search(r"Exchange hashpartitioning\(workspace_id.*, 7\)", plan)


def test_rows_equal_those_of_a_plain_join(spark, tmp_path, no_broadcast):
    rng = random.Random(3)
    stored = keyed(spark, [f"http://h/{i}" for i in range(0, 400, 3)])
    known = KnownKeys(spark, f"file://{tmp_path}/keys", buckets=5)
    known.add(stored.where("id % 2 = 0"))
    known.add(stored)
    # A third of the rows have one URL, others repeat too.
    urls = ["http://h/7"] * 100 + [f"http://h/{rng.randint(0, 420)}" for _ in range(200)]
    batch = batch_of(spark, urls)
    columns = ["id", "ordinal", "workspace_id", "url", "url_hash", "publisher", "body_length"]
    plain = store.new_contents(batch, stored).select(*columns).collect()
    assert plain and sorted(store.new_contents(batch, known).select(*columns).collect()) == sorted(plain)
    given = candidates_of(spark, [(rng.choice("xyz"), u) for u in urls])
    words = spark.createDataFrame([(1, "a", "x")], "id long, workspace_id string, keyword string")
    old = spark.createDataFrame([(9, 0, "x")], "id long, content_id long, keyword string")
    hits = [sorted(store.new_hits(given, c, words, old).select("id", "content_id", "keyword", "priority", "ordinal").collect()) for c in (stored, known)]
    assert hits[0] and hits[0] == hits[1]


def test_adding_again_adds_nothing(spark, tmp_path):
    known = KnownKeys(spark, f"file://{tmp_path}/keys", buckets=4)
    assert known.read().count() == 0
    rows = keyed(spark, ["http://h/1", "http://h/2", "http://h/2", None])
    rows = rows.unionByName(keyed(spark, ["http://h/1"], 8, "b")).unionByName(rows.limit(1).withColumn("workspace_id", F.lit(None).cast("string")))
    known.add(rows)
    for _ in range(2):
        assert {(r["workspace_id"], r["id"]) for r in known.read().collect()} == {("a", 0), ("a", 1), ("b", 8)}
        known.add(rows)


def test_another_session_and_other_buckets(spark, tmp_path):
    """A session without the table takes it from its folder; rewritten keys lie in one file to a bucket at most."""
    known = KnownKeys(spark, f"file://{tmp_path}/keys", buckets=4)
    for k in range(3):
        known.add(keyed(spark, [f"http://h/{k}/{i}" for i in range(20)], 100 * k))
    spark.sql(f"drop table {known.name}")
    assert known.read().count() == 60
    new = known.rewritten(f"file://{tmp_path}/more", 9)
    assert sorted(new.read().collect()) == sorted(known.read().collect())
    assert len(new.read().inputFiles()) <= 9 < len(known.read().inputFiles())
    with pytest.raises(ValueError):
        KnownKeys(spark, "file:///nowhere", buckets=0)
