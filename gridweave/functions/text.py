"""Building blocks of SQL text."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

Expr = str


def num(x: float) -> Expr:
    """A double literal (a bare 0.1 would be a decimal)."""
    return f"{float(x)!r}D"


def quote(s: object) -> Expr:
    escaped = str(s).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def col(name: str) -> Expr:
    return f"`{name}`"


def cols(names: Iterable[str]) -> Expr:
    return ", ".join(col(n) for n in names)


def all_of(conditions: Iterable[Expr]) -> Expr:
    return " AND ".join(f"({c})" for c in conditions) or "true"


def any_of(conditions: Iterable[Expr]) -> Expr:
    return " OR ".join(f"({c})" for c in conditions) or "false"


def struct(fields: Mapping[str, Expr]) -> Expr:
    return "named_struct(" + ", ".join(f"{quote(n)}, {e}" for n, e in fields.items()) + ")"


def array(items: Iterable[Expr]) -> Expr:
    return "array(" + ", ".join(items) + ")"


def table(rows: Iterable[Mapping[str, Expr]]) -> Expr:
    """An array of structs, to be turned into rows with ``inline``."""
    return array(struct(r) for r in rows)


def let(name: str, value: Expr, body: Expr) -> Expr:
    """Evaluate ``value`` once per row and use it as ``name`` in ``body``.

    A plain column used inside a lambda may be inlined there by the optimizer and then computed
    again for every array element.
    """
    return f"transform(array({value}), {name} -> {body})[0]"


def select(keep: Iterable[str], exprs: Mapping[str, Expr]) -> list[Expr]:
    """Arguments of ``selectExpr``: kept columns, then named expressions."""
    return [col(k) for k in keep] + [f"{e} AS {col(n)}" for n, e in exprs.items()]


def add(df: DataFrame, exprs: Mapping[str, Expr]) -> DataFrame:
    """New columns; none of the names may exist yet."""
    return df.selectExpr("*", *select([], exprs))


def put(df: DataFrame, exprs: Mapping[str, Expr]) -> DataFrame:
    """Replace existing columns."""
    return df.selectExpr(f"* EXCEPT ({cols(exprs)})", *select([], exprs))


def constant_rows(spark: SparkSession, rows: Iterable[Mapping[str, Expr]]) -> DataFrame:
    """A small table from literals, without a trip through Python objects."""
    return spark.sql(f"SELECT inline({table(rows)})")


def aggregate_rows(df: DataFrame, rows: Iterable[Mapping[str, Expr]]) -> DataFrame:
    """One aggregate over the whole frame, laid out as rows."""
    return df.selectExpr(f"{table(rows)} AS _r").selectExpr("inline(_r)")


def window(keys: Iterable[str], order: Expr, frame: str = "") -> Expr:
    partition = cols(keys)
    by = f"PARTITION BY {partition} " if partition else ""
    return f"({by}ORDER BY {order} {frame})"
