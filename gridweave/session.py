"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    # Wall-clock timestamps are TIMESTAMP_NTZ everywhere; UTC only matters for text output.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # call sites are captured by several extra JVM calls per expression; wide plans feel it
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def get_session(app: str = "gridweave", master: str | None = None, **extra: str) -> SparkSession:
    """Session with the library's settings; master and sizes come from spark-submit on a cluster."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` when the cluster names one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable; a folder already set is left alone."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back.

    Several passes cost one computation, lineage is cut, and lost executors are survived. A join of two
    written tables also has plain exchanges on both sides, which is what adaptive execution needs to split
    a hot key.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_observed(df: DataFrame, name: str, aggregates: dict[str, str]) -> tuple[DataFrame, dict]:
    """``stored``, and aggregates (SQL text) of the rows that ride along with the write: no pass of their own.

    A task that is retried may be counted twice, so these are for checks of presence, not for totals.
    """
    seen = Observation()
    table = stored(df.observe(seen, *[F.expr(e).alias(n) for n, e in aggregates.items()]), name)
    return table, seen.get


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out to every core, for work that takes long for each row: a small table is one file,
    and so one task, however long its rows take."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/gridweave/{name}-{uuid.uuid4().hex}"
