"""The Spark session that the engine expects, and tables of intermediate results."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SCRATCH_SETTING = "spark.checkpoint.dir"


def session(name: str = "textloom", master: str | None = None, **settings: str) -> SparkSession:
    """UTC as session time zone, adaptive execution and Arrow on; settings override."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    return builder.config(map=base | settings).getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none, a new temporary one in local mode; a cluster has to name one."""
    root = spark.conf.get(SCRATCH_SETTING, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SCRATCH_SETTING} to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='textloom-')}"
        spark.conf.set(SCRATCH_SETTING, root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back: the plan behind it runs once, and lost executors cost nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
