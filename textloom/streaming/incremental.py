"""Collections that arrive as files: each micro-batch is saved like a batch job, so replaying one adds nothing.

No event-time watermark is set: rows that come late are kept, and the source's own watermark only moves forward.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.operators.store import Store, analyze_pending, save


def landed(spark: SparkSession, path: str, schema: str, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(path)


def save_stream(store: Store, articles: DataFrame, checkpoint: str, job_of: Callable[[DataFrame, int], DataFrame], analyze: bool = True) -> StreamingQuery:
    """articles: a stream of rows for `save`, with keyword, rank and job_id. job_of gives the batch's row of collection_jobs."""

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            candidates = batch.where(F.col("keyword").isNotNull()).select("workspace_id", "keyword", "url", "rank", F.col("first_job_id").alias("job_id"), F.col("collected_at").alias("found_at"), F.lit(0).alias("priority"), "ordinal")
            save(store, batch.drop("keyword", "rank"), candidates, job_of(batch, number))
            if analyze:
                analyze_pending(store)
        finally:
            batch.unpersist()

    return articles.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_rollup(rows: DataFrame, at: str, kind: str, late: str = "2 days", zone_offset: str = "15 hours") -> DataFrame:
    """Counts by day of a display zone and kind, from a stream: windows of a day that begin at the zone's midnight in UTC."""
    return rows.withWatermark(at, late).groupBy(F.window(at, "1 day", "1 day", zone_offset), kind).agg(F.count("*").alias("n"))
