"""Nested structs to flat columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridweave.functions.text import Expr, col, select


def flat_columns(schema: T.StructType, path: tuple[str, ...] = ()) -> dict[str, Expr]:
    """Dotted name -> expression for every leaf; arrays become JSON text."""
    out: dict[str, Expr] = {}
    for field in schema.fields:
        here = (*path, field.name)
        expr = ".".join(col(part) for part in here)
        if isinstance(field.dataType, T.StructType):
            out.update(flat_columns(field.dataType, here))
        else:
            out[".".join(here)] = f"to_json({expr})" if isinstance(field.dataType, T.ArrayType) else expr
    return out


def flatten(df: DataFrame) -> DataFrame:
    return df.selectExpr(*select([], flat_columns(df.schema)))
