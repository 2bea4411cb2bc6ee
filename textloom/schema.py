"""Tables of the content store, their keys, and checks that a frame keeps them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(**columns: str) -> dict[str, str]:
    return columns


TABLES: dict[str, dict[str, str]] = {
    "workspaces": _schema(id="string", name="string", type="string", plan="string", created_at="timestamp"),
    "sources": _schema(
        id="long", workspace_id="string", name="string", type="string", is_active="boolean", schedule_type="string", schedule_time="string", cron_expr="string", next_run_at="timestamp", last_collected_at="timestamp",
        last_status="string", last_published_at="timestamp", min_body_length="int", allow_non_korean="boolean", config="string", created_at="timestamp", updated_at="timestamp",
    ),
    "source_keywords": _schema(id="long", workspace_id="string", source_id="long", keyword="string", origin="string", created_at="timestamp"),
    "collection_jobs": _schema(
        id="long", workspace_id="string", source_id="long", trigger="string", status="string", queued_at="timestamp", started_at="timestamp", finished_at="timestamp", duration_sec="double", collected_count="int",
        stage_counts="map<string,int>", error_message="string",
    ),
    "job_api_responses": _schema(id="long", workspace_id="string", job_id="long", keyword="string", response="array<string>", created_at="timestamp"),
    "contents": _schema(
        id="long", workspace_id="string", source_id="long", first_job_id="long", collection_path="string", url="string", normalized_url="string", url_hash="string", title="string", publisher="string", published_at="timestamp",
        summary="string", board_url="string", raw_body="string", cleaned_body="string", body_length="int", collected_at="timestamp",
    ),
    "content_keyword_hits": _schema(id="long", workspace_id="string", content_id="long", source_keyword_id="long", keyword="string", rank="int", job_id="long", found_at="timestamp"),
    "content_analyses": _schema(
        id="long", workspace_id="string", content_id="long", settings_version="int", analyzer="string", body_length="int", tokens="int", unique_tokens="int", nouns="int", sentences="int", avg_sentence_len="double", ttr="double",
        relevance="string", analyzed_at="timestamp",
    ),
    "content_terms": _schema(id="long", workspace_id="string", content_id="long", term="string", pos="string", count="int"),
    "content_keyword_stats": _schema(id="long", workspace_id="string", content_id="long", keyword="string", mentions="int", density="double", title_has="boolean", relevance="string"),
}

def schema_of(table: str) -> T.StructType:
    """Needs a session."""
    return T.StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in TABLES[table].items()))


UNIQUE: dict[str, list[str]] = {
    "workspaces": ["id"], "sources": ["id"], "source_keywords": ["source_id", "keyword"], "collection_jobs": ["id"], "job_api_responses": ["id"], "contents": ["workspace_id", "url_hash"],
    "content_keyword_hits": ["content_id", "keyword"], "content_analyses": ["content_id"], "content_terms": ["content_id", "term", "pos"], "content_keyword_stats": ["content_id", "keyword"],
}

#: Child tables of contents: rows go with their content.
CONTENT_CHILDREN = ("content_keyword_hits", "content_analyses", "content_terms", "content_keyword_stats")
SOURCE_TYPES = ("news_keyword", "board", "url_list")
JOB_STATUSES = ("queued", "running", "success", "failed")
RELEVANCES = ("main", "partial", "passing")


class KeyViolation(ValueError):
    """Two rows share a key that is unique."""


def assert_unique(df: DataFrame, table: str) -> None:
    key = UNIQUE[table]
    repeated = df.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > 1).limit(1).collect()
    if repeated:
        raise KeyViolation(f"{table}: {repeated[0].asDict()}")


def assert_one_of(df: DataFrame, column: str, allowed: tuple[str, ...]) -> None:
    """Enumerated columns are plain strings; their values are checked when they are written."""
    wrong = df.where(~F.col(column).isin(*allowed)).select(column).limit(1).collect()
    if wrong:
        raise ValueError(f"{column}: {wrong[0][0]!r} is not one of {allowed}")


def scoped(df: DataFrame, workspace_id: str) -> DataFrame:
    """Rows of one tenant; a frame without the column and a value that is no UUID are refused."""
    import uuid

    if "workspace_id" not in df.columns:
        raise TypeError("the frame has no workspace_id")
    try:
        uuid.UUID(str(workspace_id))
    except ValueError as e:
        raise TypeError("workspace_id must be a UUID") from e
    return df.where(F.col("workspace_id") == F.lit(str(workspace_id)))


def point(df: DataFrame, workspace_id: str, row_id: int) -> DataFrame:
    """The row with that id; another tenant's looks like a missing one."""
    return scoped(df, workspace_id).where(F.col("id") == row_id).limit(1)
