"""Household profile dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridweave.fixed_values import PROFILE_COLUMNS, PROFILES
from gridweave.functions.text import Expr, constant_rows, num, quote, table


def profile_table(spark: SparkSession) -> DataFrame:
    return constant_rows(spark, _profile_rows())


def _literal(v: object) -> Expr:
    return quote(v) if isinstance(v, str) else num(v) if isinstance(v, float) else str(v)


def _profile_rows() -> list[dict[str, Expr]]:
    return [{c: _literal(v) for c, v in zip(PROFILE_COLUMNS, profile)} for profile in PROFILES]


def fan_out(weather: DataFrame) -> DataFrame:
    """Every weather row once per profile: the four profiles are a constant array, not a join."""
    return weather.selectExpr("*", f"inline({table(_profile_rows())})")


def attach(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profile attributes by ``profile_code`` for rows that already carry one."""
    return df.join(profiles, "profile_code", "left")
