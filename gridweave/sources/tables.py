"""Parquet tables with declared schemas; nothing is inferred at the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridweave.functions.guards import nan_to_null

SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table; NaN counts as missing from here on."""
    return nan_to_null(spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet"))
