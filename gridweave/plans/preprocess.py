"""Wide table to scaled feature sets, statistics and summaries, per horizon."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gridweave.fixed_values import (
    CORE_FEATURES,
    DIAGNOSTIC_COLUMNS,
    EXTENDED_FEATURES,
    FEATURE_SETS,
    META_COLUMNS,
    TARGETS,
    TRAIN_END,
)
from gridweave.functions.text import Expr
from gridweave.operators.quality import remove_invalid_rows, require_columns
from gridweave.operators.scaling import Stats, collect_stats, minmax_stats, raw_frame, scaled_frame, stats_table
from gridweave.operators.splits import add_split, require_rows, train_test
from gridweave.operators.summary import split_summary
from gridweave.sources.files import read_split_dataset, read_stats, write_split_dataset, write_stats

ALL_FEATURES = sorted({*CORE_FEATURES, *EXTENDED_FEATURES})
SPLITS = ("train", "test")
REQUIRED = [*META_COLUMNS, *ALL_FEATURES, *DIAGNOSTIC_COLUMNS, *TARGETS.values()]


@dataclass(frozen=True)
class Prepared:
    """Valid rows of one horizon with their split, and the statistics of the training part."""

    horizon: str
    target: str
    rows: DataFrame
    stats: Stats

    def scaled(self, feature_set: str, extra: dict[str, Expr] | None = None) -> DataFrame:
        more = {"split": "split"} if extra is None else extra
        return scaled_frame(self.rows, list(FEATURE_SETS[feature_set]), self.target, self.stats, more)

    def raw(self, feature_set: str) -> DataFrame:
        return raw_frame(self.rows, list(FEATURE_SETS[feature_set]), self.target, ["split"])


def prepare(
    wide: DataFrame, horizon: str, train_end: str = TRAIN_END, features: list[str] | None = None
) -> Prepared:
    """Invalid rows out, split by time, min-max statistics from training rows (one aggregate)."""
    target = TARGETS[horizon]
    columns = ALL_FEATURES if features is None else features
    rows = add_split(remove_invalid_rows(wide, columns, target), train_end)
    train, _ = train_test(rows, train_end)
    return Prepared(horizon, target, rows, collect_stats(minmax_stats(train, [*columns, target])))


def summary(prepared: Prepared) -> DataFrame:
    return split_summary(prepared.rows, prepared.target, prepared.horizon)


def write_horizon(spark: SparkSession, prepared: Prepared, base: str) -> None:
    """Eight split folders (two variants, two feature sets, two splits), statistics and summary.

    Whether both splits have rows is seen while the first folders are written, and stops the run there.
    """
    seen = None
    for feature_set in FEATURE_SETS:
        raw = prepared.raw(feature_set)
        if seen is None:
            seen = Observation()
            raw = raw.observe(seen, *[F.expr(f"count_if(split = '{s}')").alias(s) for s in SPLITS])
        write_split_dataset(raw, base, "raw", feature_set, prepared.horizon)
        require_rows(seen.get, SPLITS)
        write_split_dataset(prepared.scaled(feature_set), base, "scaled", feature_set, prepared.horizon)
    features = {c: s for c, s in prepared.stats.items() if c != prepared.target}
    write_stats(stats_table(spark, features), base, "feature", prepared.horizon)
    write_stats(
        stats_table(spark, {prepared.target: prepared.stats[prepared.target]}), base, "target", prepared.horizon
    )
    summary(prepared).write.mode("overwrite").parquet(f"{base}/summary/horizon={prepared.horizon}")


def run(spark: SparkSession, wide_path: str, base: str, train_end: str = TRAIN_END) -> None:
    """Reads the written wide table, so every output is a scan and a projection, without a shuffle."""
    wide = require_columns(spark.read.parquet(wide_path), REQUIRED, "wide table")
    for horizon in TARGETS:
        write_horizon(spark, prepare(wide, horizon, train_end), base)


def load(spark: SparkSession, base: str, horizon: str, feature_set: str = "core") -> tuple[DataFrame, DataFrame, Stats]:
    """Scaled rows, raw rows and statistics of one horizon, as written by ``run``."""
    stats = collect_stats(read_stats(spark, base, "feature", horizon).unionByName(read_stats(spark, base, "target", horizon)))
    return (
        read_split_dataset(spark, base, "scaled", feature_set, horizon),
        read_split_dataset(spark, base, "raw", feature_set, horizon),
        stats,
    )
