"""Duplicate handling by partial aggregation, so copies of one key collapse before the exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.functions.guards import nan_to_null


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the smallest by ``order``, ties broken by the remaining columns.

    Null and NaN are no readings: they come after every value, column by column.

    ``min`` of a struct combines on the map side, so a key holding most of the rows is reduced
    to one row per task before anything is shuffled.
    """
    rest = [c for c in order if c not in keys]
    rest += [c for c in df.columns if c not in keys and c not in rest]
    # a struct (is missing, value) sorts the missing ones last
    entries = [F.struct(F.col(c).isNull().alias("none"), F.col(c).alias("v")).alias(c) for c in rest]
    best = nan_to_null(df).groupBy(*keys).agg(F.min(F.struct(*entries)).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}.v").alias(c) for c in df.columns])


def repeated_rows(df: DataFrame) -> DataFrame:
    """Distinct rows that occur more than once, with the number of later copies."""
    counted = df.groupBy(*df.columns).agg((F.count(F.lit(1)) - 1).alias("later_copies"))
    return counted.filter("later_copies > 0")


def duplicate_count(df: DataFrame) -> DataFrame:
    """How many rows equal an earlier row."""
    return (
        df.groupBy(*df.columns)
        .agg(F.count(F.lit(1)).alias("_n"))
        .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))
    )
