"""Weather payloads: one JSON object of parallel arrays becomes one row per hour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.fixed_values import PAYLOAD_FIELDS
from gridweave.functions.text import col, cols, quote, struct

PAYLOAD_TIME = quote("yyyy-MM-dd'T'HH:mm")
VALUE_FIELDS = {f: c for f, c in PAYLOAD_FIELDS.items() if f != "time"}
PAYLOAD_SCHEMA = "hourly struct<time: array<string>, " + ", ".join(f"{f}: array<double>" for f in VALUE_FIELDS) + ">"
NO_DATA = "the payload has no hourly data"


def explode_payload(df: DataFrame, text: str = "payload") -> DataFrame:
    """Rows of a payload column to hourly rows; a payload without ``hourly`` fails the query."""
    keys = [c for c in df.columns if c != text]
    parsed = df.selectExpr(*keys, f"from_json({col(text)}, {quote(PAYLOAD_SCHEMA)}).hourly AS _h")
    checked = parsed.selectExpr(*keys, f"CASE WHEN _h IS NULL THEN raise_error({quote(NO_DATA)}) ELSE _h END AS _h")
    # a field the payload lacks becomes nulls beside the hours it has
    fields = checked.selectExpr(*keys, *[f"coalesce(_h.{col(f)}, array()) AS {col(f)}" for f in PAYLOAD_FIELDS])
    rows = fields.selectExpr(*keys, f"inline(arrays_zip({cols(PAYLOAD_FIELDS)}))")
    return rows.selectExpr(
        *keys,
        f"to_timestamp_ntz(`time`, {PAYLOAD_TIME}) AS datetime",
        *[f"{col(f)} AS {col(c)}" for f, c in VALUE_FIELDS.items()],
    )


def build_payload(weather: DataFrame, keys: list[str]) -> DataFrame:
    """The inverse: hourly rows to one payload per key and day (at most 24 entries per array)."""
    entry = f"struct(datetime, {cols(VALUE_FIELDS.values())})"
    stamped = weather.selectExpr(*keys, "to_date(datetime) AS _day", f"{entry} AS _row")
    days = stamped.groupBy(*keys, "_day").agg(F.expr("sort_array(collect_list(_row))").alias("_rows"))
    hourly = {"time": f"transform(_rows, r -> date_format(r.datetime, {PAYLOAD_TIME}))"}
    hourly.update({f: f"_rows.{col(c)}" for f, c in VALUE_FIELDS.items()})
    return days.selectExpr(*keys, f"to_json({struct({'hourly': struct(hourly)})}) AS payload")
