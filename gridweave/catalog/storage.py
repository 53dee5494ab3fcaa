"""Write-and-read-back queries. Each run writes to a fresh folder under the shared one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.catalog import inputs as i
from gridweave.catalog import scaling as scaling_queries
from gridweave.catalog import sql as q
from gridweave.catalog.evaluation import ORACLE as EVALUATION_SQL
from gridweave.catalog.evaluation import _model_metrics
from gridweave.fixed_values import CORE_FEATURES, EXTENDED_FEATURES
from gridweave.functions.errors import METRICS
from gridweave.functions.nested import flatten
from gridweave.functions.text import add
from gridweave.operators import evaluate
from gridweave.operators.baselines import persistence
from gridweave.operators.splits import train_test
from gridweave.plans import preprocess
from gridweave.session import scratch_path
from gridweave.sources import files

KEY = ["series_id", "datetime"]
MEASURES = ["load_kwh", "temperature", "humidity", "apparent_temperature", "rain", "wind_speed", "cloud_cover"]
PANEL_CSV = "series_id string, datetime timestamp_ntz, " + ", ".join(f"{c} double" for c in MEASURES) + ", occupancy_level bigint"
PANEL_CSV_COLUMNS = ["series_id", "datetime", *MEASURES, "occupancy_level"]
UNEVEN = ["humidity", "apparent_temperature"]


def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered CSV files with a header, read back with a declared schema."""
    path = scratch_path(spark, "panel-csv")
    files.write_sorted(i.hourly(spark, sf).select(*PANEL_CSV_COLUMNS), path, KEY, "csv")
    return i.rounded(files.read_csv(spark, path, PANEL_CSV), UNEVEN)


def csv_unnamed_columns(spark: SparkSession, sf: str) -> DataFrame:
    """A file with one empty and one filled column without a proper name; only the empty one goes."""
    path = scratch_path(spark, "unnamed-csv")
    rows = i.hourly(spark, sf).selectExpr(
        "series_id", "load_kwh", "CAST(NULL AS STRING) AS `Unnamed: 0`", "string(occupancy_level) AS `Unnamed: 1`"
    )
    files.write_csv(rows, path)
    back = files.read_text_csv(spark, path).withColumnRenamed("Unnamed: 1", "kept")
    return back.groupBy(*[c for c in back.columns if c != "load_kwh"]).agg(F.count(F.lit(1)).alias("rows"))


def _write_horizon(spark: SparkSession, sf: str, horizon: str) -> str:
    base = scratch_path(spark, f"prepared-{horizon}")
    files.write_sorted(i.wide_table(spark, sf), f"{base}/wide", ["profile_code", "datetime"])
    wide = spark.read.parquet(f"{base}/wide")
    preprocess.write_horizon(spark, preprocess.prepare(wide, horizon, i.TRAIN_END), base)
    return base


def partitioned_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The test split of the scaled core features of one horizon, from its own partition."""
    base = _write_horizon(spark, sf, "1h")
    back = files.read_split_dataset(spark, base, "scaled", "core", "1h", "test")
    return i.rounded(back, [*scaling_queries.CORE, "target_1h_scaled"])


def partitioned_folders(spark: SparkSession, sf: str) -> DataFrame:
    """Both variants and feature sets with both splits, read back folder by folder."""
    base, frames = _write_horizon(spark, sf, "24h"), []
    for variant in ("raw", "scaled"):
        for feature_set in ("core", "extended"):
            back = files.read_split_dataset(spark, base, variant, feature_set, "24h")
            sums = back.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.sum("target_24h").alias("total"))
            frames.append(
                sums.selectExpr(f"'{variant}' AS variant", f"'{feature_set}' AS feature_set", "string(split) AS split", f"{len(back.columns)} AS columns", "rows", "total")
            )
    return i.rounded(reduce(DataFrame.unionByName, frames), ["total"], 3)


def summary_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    base = _write_horizon(spark, sf, "24h")
    back = spark.read.parquet(f"{base}/summary").withColumn("horizon", F.col("horizon").cast("string"))
    return i.rounded(back, ["target_mean", "target_std"])


def stats_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    base = _write_horizon(spark, sf, "1h")
    both = files.read_stats(spark, base, "feature", "1h").unionByName(files.read_stats(spark, base, "target", "1h"))
    return i.rounded(both, ["min", "max", "range"])


def predictions_text(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions with ten fixed decimals, written as text and read back."""
    path = scratch_path(spark, "predictions")
    _, test = train_test(i.wide_table(spark, sf), i.TRAIN_END)
    files.write_predictions(
        evaluate.prediction_frame(test, "target_1h", "load_rolling_24", persistence(test)),
        path,
    )
    return spark.read.option("header", True).csv(path)


def metrics_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of all runs in one table, a folder per dataset and horizon."""
    path = scratch_path(spark, "metrics")
    files.write_model_metrics(add(_model_metrics(spark, sf), {"dataset": "'wide'"}), path)
    back = spark.read.parquet(path).withColumn("horizon", F.col("horizon").cast("string"))
    return i.rounded(back.select("horizon", "model", *METRICS), list(METRICS))


def metrics_json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The nested payload as JSON lines and back."""
    path = scratch_path(spark, "payload")
    _, test = train_test(i.wide_table(spark, sf), i.TRAIN_END)
    frame = evaluate.prediction_frame(test, "target_24h", "load_rolling_24", persistence(test), text_time=False)
    payload = evaluate.payload(frame, run_id="check", horizon="24h", feature_set="core", target="target_24h")
    files.write_metrics(payload, path)
    back = flatten(spark.read.schema(payload.schema).json(path))
    return i.rounded(back, [c for c, t in back.dtypes if t == "double"])


def metrics_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The same payload as CSV with dotted columns, read back as text."""
    path = scratch_path(spark, "payload-csv")
    _, test = train_test(i.wide_table(spark, sf), i.TRAIN_END)
    frame = evaluate.prediction_frame(test, "target_24h", "load_rolling_24", persistence(test), text_time=False)
    payload = evaluate.payload(frame, run_id="check", horizon="24h", feature_set="core", target="target_24h")
    files.write_metrics(payload, path, "csv")
    kinds = dict(flatten(payload).dtypes)
    back = spark.read.option("header", True).option("inferSchema", False).csv(path)
    typed = back.selectExpr(*[f"CAST(`{c}` AS {kinds[c]}) AS `{c}`" for c in back.columns])
    return i.rounded(typed, [c for c, t in typed.dtypes if t == "double"])


QUERIES = {
    f.__name__: f
    for f in (
        csv_roundtrip, csv_unnamed_columns, partitioned_roundtrip, summary_roundtrip, stats_roundtrip, predictions_text,
        metrics_roundtrip, metrics_json_roundtrip, metrics_csv_roundtrip, partitioned_folders,
    )
}

_CORE = scaling_queries.ORACLE["scaled_core"]

ORACLE = {
    "csv_roundtrip": q.BASE
    + f"SELECT {', '.join(f'{q.r(c)} AS {c}' if c in UNEVEN else c for c in PANEL_CSV_COLUMNS)} FROM panel",
    "partitioned_folders": q.wide_plus(q.splits())
    + f"""SELECT variant, feature_set, split, CAST(features + extra AS INTEGER) AS columns, count(*) AS rows, {q.r("sum(target_24h)", 3)} AS total
       FROM rows1, (VALUES ('raw', 5), ('scaled', 6)) v(variant, extra),
            (VALUES ('core', {len(CORE_FEATURES)}), ('extended', {len(EXTENDED_FEATURES)})) f(feature_set, features)
       GROUP BY 1, 2, 3, features, extra""",
    "csv_unnamed_columns": q.BASE + "SELECT series_id, CAST(occupancy_level AS VARCHAR) AS kept, count(*) AS rows FROM panel GROUP BY 1, 2",
    "partitioned_roundtrip": f"SELECT * FROM ({_CORE}) WHERE split = 'test'",
    "summary_roundtrip": f"SELECT * FROM ({scaling_queries.ORACLE['split_summaries']}) WHERE horizon = '24h'",
    "stats_roundtrip": scaling_queries.ORACLE["minmax_statistics"],
    "predictions_text": q.wide_plus(q.splits())
    + """SELECT strftime(datetime, '%Y-%m-%d %H:%M:%S') AS datetime, CAST(profile_code AS VARCHAR) AS profile_code, profile_name,
       printf('%.10f', target_1h) AS actual_kwh, printf('%.10f', load_rolling_24) AS predicted_kwh,
       printf('%.10f', load_lag_24) AS baseline_lag24_kwh, printf('%.10f', target_1h - load_rolling_24) AS error_kwh,
       printf('%.10f', abs(target_1h - load_rolling_24)) AS abs_error_kwh,
       printf('%.10f', abs(target_1h - load_rolling_24) / greatest(abs(target_1h), 1e-8) * 1e2) AS ape
       FROM rows1 WHERE split = 'test'""",
    "metrics_roundtrip": EVALUATION_SQL["metrics_records"],
    "metrics_json_roundtrip": EVALUATION_SQL["run_payload"],
    "metrics_csv_roundtrip": EVALUATION_SQL["run_payload"],
}
