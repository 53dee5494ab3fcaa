"""CSV, partitioned Parquet, scaler statistics, predictions, metrics and run records."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridweave.functions.guards import nan_to_null
from gridweave.functions.nested import flatten
from gridweave.functions.text import col, select

TIMESTAMP_TEXT = "yyyy-MM-dd HH:mm:ss"
PREDICTION_DECIMALS = 10
# columns without a header, as written by data frames and as named by the CSV reader
UNNAMED = re.compile(r"Unnamed:.*|_c\d+")


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """CSV with a header (a UTF-8 byte-order mark is accepted) and a declared schema."""
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False)
    return nan_to_null(
        reader.option("timestampNTZFormat", TIMESTAMP_TEXT).option("mode", "FAILFAST").csv(path)
    )


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with every column as text, for files that still need coercion and checks."""
    return drop_empty_unnamed(spark.read.option("header", True).option("inferSchema", False).csv(path))


def drop_empty_unnamed(df: DataFrame) -> DataFrame:
    """Drop columns without a name that hold no value at all: one aggregate over the candidates."""
    candidates = [c for c in df.columns if UNNAMED.fullmatch(c)]
    if not candidates:
        return df
    filled = df.selectExpr(*select([], {c: f"count({col(c)})" for c in candidates})).first()
    return df.drop(*[c for c in candidates if filled[c] == 0])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("timestampNTZFormat", TIMESTAMP_TEXT).csv(path)


def write_sorted(df: DataFrame, path: str, keys: list[str], fmt: str = "parquet") -> None:
    """Globally ordered files: range partitions on the keys, sorted inside each."""
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    writer = ordered.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("timestampNTZFormat", TIMESTAMP_TEXT).csv(path)
    else:
        writer.parquet(path)


def dataset_path(base: str, variant: str, feature_set: str, horizon: str) -> str:
    return f"{base}/variant={variant}/feature_set={feature_set}/horizon={horizon}"


def write_split_dataset(df: DataFrame, base: str, variant: str, feature_set: str, horizon: str) -> str:
    """One schema per (variant, feature set, horizon) folder, partitioned by split inside it."""
    path = dataset_path(base, variant, feature_set, horizon)
    df.write.mode("overwrite").partitionBy("split").parquet(path)
    return path


def read_split_dataset(
    spark: SparkSession, base: str, variant: str, feature_set: str, horizon: str, split: str | None = None
) -> DataFrame:
    """Reads one folder; ``split`` prunes partitions."""
    df = spark.read.parquet(dataset_path(base, variant, feature_set, horizon))
    return df if split is None else df.filter(F.col("split") == split)


STATS_SCHEMA = "`column` string, min double, max double, `range` double"


def write_stats(stats: DataFrame, base: str, kind: str, horizon: str) -> str:
    path = f"{base}/stats/kind={kind}/horizon={horizon}"
    stats.write.mode("overwrite").parquet(path)
    return path


def read_stats(spark: SparkSession, base: str, kind: str, horizon: str) -> DataFrame:
    return spark.read.schema(STATS_SCHEMA).parquet(f"{base}/stats/kind={kind}/horizon={horizon}")


def fixed_decimals(df: DataFrame, decimals: int = PREDICTION_DECIMALS) -> DataFrame:
    """Doubles as text with a fixed number of decimals."""

    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.selectExpr(
        *[f"format_string('%.{decimals}f', {col(c)}) AS {col(c)}" if c in doubles else col(c) for c in df.columns]
    )


def write_predictions(df: DataFrame, path: str) -> None:
    write_csv(fixed_decimals(df), path)


def write_metrics(payload: DataFrame, path: str, fmt: str = "json") -> None:
    """A nested payload as JSON lines, or flattened to dotted columns as CSV."""
    if fmt == "json":
        payload.write.mode("overwrite").json(path)
    elif fmt == "csv":
        write_csv(flatten(payload), path)
    else:
        raise ValueError(f"unsupported format: {fmt}")


RUN_KEYS = ("run_id", "horizon")


def append_runs(runs: DataFrame, path: str) -> None:
    """Run records grow by one row per run and horizon; a run that is written again replaces its own rows.

    A run and horizon has a folder of its own. Spark writes beside the table and moves the finished folders in
    when the job commits, so a run that fails or is retried leaves the records of the others as they were.
    """
    _write_folders(runs, path, RUN_KEYS)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All run records; run ids are text even when they look like numbers."""
    found = spark.read.parquet(path).schema
    kinds = [T.StructField(f.name, T.StringType() if f.name in RUN_KEYS else f.dataType) for f in found]
    return spark.read.schema(T.StructType(kinds)).parquet(path)


def write_model_predictions(predictions: DataFrame, path: str) -> None:
    """Long prediction rows of all baselines, a folder per dataset and horizon."""
    _write_folders(predictions, path)


def write_model_metrics(metrics: DataFrame, path: str) -> None:
    """All baseline metrics in one table, a folder per dataset and horizon."""
    _write_folders(metrics, path)


def _write_folders(df: DataFrame, path: str, keys: tuple[str, ...] = ("dataset", "horizon")) -> None:
    """Replaces the folders that ``df`` has rows for; other runs keep theirs."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*keys).parquet(path)
