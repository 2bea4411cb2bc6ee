from datetime import datetime

import pytest
from pyspark.sql import functions as F

from textloom import schema
from textloom.operators import store as S
from textloom.operators.analysis import Settings
from textloom.streaming import incremental

A, B = "00000000-0000-0000-0000-00000000000a", "00000000-0000-0000-0000-00000000000b"
BATCH = "ordinal int, workspace_id string, source_id long, first_job_id long, collection_path string, url string, title string, publisher string, published_at timestamp, summary string, board_url string, raw_body string, cleaned_body string, collected_at timestamp, keyword string, rank int"
NOW = datetime(2026, 9, 26)
LONG = "태권도 대회가 열렸다. " * 20


def batch(spark, rows, workspace=A):
    full = [(i, workspace, 1, 7, "news", url, title, "매체", published, "", "", body, body, NOW, keyword, rank) for i, (url, title, body, published, keyword, rank) in enumerate(rows)]
    return spark.createDataFrame(full, BATCH)


def parts(df):
    candidates = df.select("workspace_id", "keyword", "url", "rank", F.col("first_job_id").alias("job_id"), F.col("collected_at").alias("found_at"), F.lit(0).alias("priority"), "ordinal")
    return df.withColumn("normalized_url", F.col("url")).drop("keyword", "rank"), candidates


def job(spark, number=7):
    return spark.createDataFrame([(number, A, 1, "manual", "success", 2)], "id long, workspace_id string, source_id long, trigger string, status string, collected_count int").selectExpr(
        "*", "timestamp'2026-09-26' as queued_at", "timestamp'2026-09-26' as started_at", "timestamp'2026-09-26' as finished_at", "0D as duration_sec", "map('cleaned', 2) as stage_counts", "cast(null as string) as error_message")


@pytest.fixture
def store(spark, tmp_path):
    found = S.Store(spark, f"file://{tmp_path}/store")
    source = spark.createDataFrame([(1, A, "뉴스", "news_keyword", True, 100), (2, B, "게시판", "board", False, 30)], "id long, workspace_id string, name string, type string, is_active boolean, min_body_length int")
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.schema_of("sources") if f.name not in source.columns]
    found.commit(sources=source.select("*", *missing))
    return found


ROWS = [("http://a.kr/1?utm_source=x", "첫 글", LONG, NOW, "태권도", 1), ("http://a.kr/2", "둘째", "본문에 태권도", None, "태권도", 2), ("http://a.kr/1", "같은 글", LONG, NOW, "대회", 3)]


def test_saving_twice_adds_nothing(spark, store):
    S.add_keywords(store, A, 1, [" 태권도 ", "대회", "", "태권도"])
    rows, candidates = parts(batch(spark, ROWS))
    assert S.save(store, rows, candidates, job(spark)) == {"new": 2, "known": 1, "new_hits": 3}
    assert S.save(store, rows, candidates, job(spark)) == {"new": 0, "known": 3, "new_hits": 0}
    contents = {r["url"]: r for r in store.read("contents").collect()}
    assert sorted(r["id"] for r in contents.values()) == [1, 2]
    assert contents["http://a.kr/1?utm_source=x"]["title"] == "첫 글"
    assert store.read("sources").where("id = 1").first()["last_published_at"] == NOW
    assert {(r["content_id"], r["keyword"], r["rank"]) for r in store.read("content_keyword_hits").collect()} == {(1, "태권도", 1), (2, "태권도", 2), (1, "대회", 3)}


def test_analysis_is_incremental(spark, store):
    rows, candidates = parts(batch(spark, ROWS[:2]))
    S.save(store, rows, candidates, job(spark))
    assert S.analyze_pending(store) == {"analyzed": 2, "stats_only": 0}
    assert S.analyze_pending(store) == {"analyzed": 0, "stats_only": 0}
    verdicts = {r["content_id"]: r["relevance"] for r in store.read("content_analyses").collect()}
    assert verdicts == {1: "main", 2: "passing"}
    again, late = parts(batch(spark, [ROWS[2]]))
    S.save(store, again, late, job(spark))
    assert S.analyze_pending(store) == {"analyzed": 0, "stats_only": 1}
    assert store.read("content_keyword_stats").count() == 3
    for table in ("content_analyses", "content_terms", "content_keyword_stats"):
        schema.assert_unique(store.read(table), table)


def test_recleaning_settles(spark, store):
    rows, candidates = parts(batch(spark, [("http://a.kr/9", "글", LONG + "\n(끝)\n남의 기사", NOW, "태권도", 1)]))
    S.save(store, rows, candidates, job(spark))
    S.analyze_pending(store)
    assert S.reclean(store, dry_run=True) == {"checked": 1, "changed": 1, "short": 0}
    assert store.read("contents").first()["cleaned_body"].endswith("남의 기사")
    assert S.reclean(store)["changed"] == 1
    assert S.reclean(store) == {"checked": 1, "changed": 0, "short": 0}
    assert store.read("content_analyses").count() == 1


def test_deletes(spark, store):
    rows, candidates = parts(batch(spark, ROWS[:2]))
    S.save(store, rows, candidates, job(spark))
    S.analyze_pending(store, Settings())
    S.delete_contents(store, B, [1])
    assert store.read("contents").count() == 2
    S.delete_contents(store, A, [1])
    assert [r["id"] for r in store.read("contents").collect()] == [2]
    assert all(store.read(t).where("content_id = 1").count() == 0 for t in schema.CONTENT_CHILDREN)


def test_keywords_leave_hits(spark, store):
    S.add_keywords(store, A, 1, ["태권도"])
    rows, candidates = parts(batch(spark, ROWS[:1]))
    S.save(store, rows, candidates, job(spark))
    S.remove_keywords(store, [1])
    row = store.read("content_keyword_hits").first()
    assert (row["keyword"], row["source_keyword_id"]) == ("태권도", None)


def test_jobs(spark, store):
    assert S.queue_jobs(store, A) == [1]
    assert S.queue_jobs(store, A, [1, 1]) == []
    with pytest.raises(KeyError):
        S.queue_jobs(store, A, [2])
    S.advance_job(store, 1, "running")
    S.advance_job(store, 1, "success")
    with pytest.raises(ValueError):
        S.advance_job(store, 1, "running")
    assert S.queue_jobs(store, A) == [1]
    assert S.fail_active(store) == 1
    assert {r["status"] for r in store.read("collection_jobs").collect()} == {"success", "failed"}


def test_tenants(spark, store):
    assert schema.scoped(store.read("sources"), A).count() == 1
    assert schema.point(store.read("sources"), B, 1).collect() == []
    with pytest.raises(TypeError):
        schema.scoped(store.read("sources"), "no uuid")
    with pytest.raises(TypeError):
        schema.scoped(spark.range(1), A)
    with pytest.raises(schema.KeyViolation):
        schema.assert_unique(spark.createDataFrame([(1,), (1,)], "id long"), "sources")
    with pytest.raises(ValueError):
        schema.assert_one_of(spark.createDataFrame([("x",)], "s string"), "s", schema.JOB_STATUSES)


def test_stream_is_replayable(spark, store, tmp_path):
    rows = batch(spark, ROWS).withColumn("normalized_url", F.col("url"))
    rows.write.json(f"{tmp_path}/landing")
    for k in range(2):
        stream = incremental.landed(spark, f"file://{tmp_path}/landing", f"{BATCH}, normalized_url string")
        incremental.save_stream(store, stream, f"file://{tmp_path}/checkpoint-{k}", lambda df, n: job(spark)).awaitTermination()
    assert store.read("contents").count() == 2
    assert store.read("content_analyses").count() == 2


def test_sources_and_workspaces(store):
    assert S.create_workspace(store, S.DEFAULT_WORKSPACE, "기본")
    assert not S.create_workspace(store, S.DEFAULT_WORKSPACE, "기본")
    number = S.create_source(store, A, " 새 소스 ", "url_list", {"urls": ["http://a", "http://a"]})
    assert number == 3
    assert S.update_source(store, A, number, name="이름", schedule_time="09:00")
    assert not S.update_source(store, B, number, name="x")
    row = store.read("sources").where("id = 3").first()
    assert (row["name"], row["schedule_time"], row["min_body_length"], row["config"]) == ("이름", "09:00", 30, '{"urls": ["http://a"]}')
    for bad in ({"type": "board"}, {"schedule_time": "9:00"}, {"config": {"urls": []}}):
        with pytest.raises(ValueError):
            S.update_source(store, A, number, **bad)


def test_daily_rollup_counts_days_of_the_zone(spark, tmp_path):
    """A day begins at 15:00 UTC, and a row that comes a day late still counts."""
    rows = [("2026-09-25 14:59:59", "news"), ("2026-09-25 15:00:00", "news"), ("2026-09-26 14:59:59", "news"), ("2026-09-26 15:00:00", "board"), (None, "news")]
    spark.createDataFrame(rows, "at string, kind string").coalesce(1).write.json(f"{tmp_path}/in/1")
    query = lambda: incremental.daily_rollup(incremental.landed(spark, f"{tmp_path}/in/*", "at timestamp, kind string"), "at", "kind").writeStream.format("memory").queryName("rollup").outputMode("complete").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination(120)
    assert query()
    spark.createDataFrame([("2026-09-25 16:00:00", "news")], "at string, kind string").coalesce(1).write.json(f"{tmp_path}/in/2")
    assert query()
    found = {(str(r["window"]["start"]), r["kind"]): r["n"] for r in spark.table("rollup").collect()}
    assert found == {("2026-09-24 15:00:00", "news"): 1, ("2026-09-25 15:00:00", "news"): 3, ("2026-09-26 15:00:00", "board"): 1}
