"""Registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def all_queries() -> dict[str, Query]:
    from gridweave.catalog import evaluation, features, fits, fuzzy, missing, models, profiling, quality, scaling, storage

    merged: dict[str, Query] = {}
    for module in (features, scaling, quality, profiling, fuzzy, evaluation, storage, models, fits, missing):
        merged.update(module.QUERIES)
    return merged


def all_oracles() -> dict[str, str]:
    from gridweave.catalog import evaluation, features, fits, fuzzy, missing, models, profiling, quality, scaling, storage

    merged: dict[str, str] = {}
    for module in (features, scaling, quality, profiling, fuzzy, evaluation, storage, models, fits, missing):
        merged.update(module.ORACLE)
    return merged
