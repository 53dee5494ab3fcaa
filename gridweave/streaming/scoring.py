"""Scores rows as they arrive. Nothing is kept between rows, so no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from gridweave.functions.text import add
from gridweave.operators.fuzzy import FuzzyModel, score
from gridweave.operators.scaling import Stats, unscaled


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def score_stream(rows: DataFrame, model: FuzzyModel, target: str, stats: Stats) -> DataFrame:
    scored = score(rows, model, "predicted_scaled")
    return add(scored, {"predicted_kwh": unscaled("predicted_scaled", target, stats)})


def write_scores(scored: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to Parquet; the checkpoint makes a restart continue where it stopped."""
    writer = scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()
