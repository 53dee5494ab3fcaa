"""Exact quantiles with linear interpolation, at any size.

A first pass gives each group its size, limits and a KLL sketch, which is merged from parts like a sum and
serves all probabilities. Spark's ``percentile`` keeps every distinct value of a group in one task; up to
``BUFFER_ROWS`` values per group that is the cheapest exact way. Beyond it the sketch gives a bracket around
every wanted rank. A second pass counts: values outside the brackets by the gap they fall into, values
inside one by one, equal values together and within tasks first. The running sum over these counts gives
exact ranks, so it either finds the wanted values inside the brackets or shows that a bracket was too narrow,
which is then widened. Results are the same either way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.functions.text import Expr, add, array, col, cols, num, quote, table, window
from gridweave.session import stored

BUFFER_ROWS = 1_000_000
#: Size of a sketch and the share of ranks by which brackets reach to either side, about three times its error;
#: groups beyond ``MANY_ROWS`` take the finer one.
SKETCH, MARGIN = 4096, 0.004
MANY_ROWS, FINE_SKETCH, FINE_MARGIN = 100_000_000, 65_535, 0.0004
BROADCAST_GROUPS = 100_000


def long_values(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, column, value) rows without nulls."""
    entries = table({"column": quote(c), "value": f"double({col(c)})"} for c in columns)
    return df.selectExpr(*keys, f"inline({entries})").filter("value IS NOT NULL")


def profile(df: DataFrame, columns: list[str], keys: list[str], extra: dict[str, Expr] | None = None, size: int = SKETCH) -> DataFrame:
    """(keys, column, n, low, high, sketch) and the aggregates ``extra``, in which ``{}`` stands for the column;
    written, from one pass."""
    entries = table(
        {
            "column": quote(c),
            "n": f"count({col(c)})",
            "low": f"double(min({col(c)}))",
            "high": f"double(max({col(c)}))",
            "sketch": f"kll_sketch_agg_double(double({col(c)}), {size})",
            **{name: e.format(col(c)) for name, e in (extra or {}).items()},
        }
        for c in columns
    )
    return stored(df.groupBy(*keys).agg(F.expr(entries).alias("_r")).selectExpr(*keys, "inline(_r)"), "profile")


def exact_quantiles(
    df: DataFrame, columns: list[str], probabilities: list[float], keys: list[str] | None = None,
    buffer_rows: int = BUFFER_ROWS, rows: int | None = None, known: DataFrame | None = None,
) -> DataFrame:
    """Rows (keys, column, quantiles) where ``quantiles`` follows ``probabilities``.

    ``rows`` is the row count of ``df``, or ``known`` its ``profile``, when the caller already has it.
    """
    keys = list(keys or [])
    if rows is None or rows > buffer_rows:
        known = profile(df, columns, keys) if known is None else known
        largest = known.agg(F.max("n")).first()[0] or 0
        if largest > buffer_rows:
            margin = MARGIN
            if largest > MANY_ROWS:
                known, margin = profile(df, columns, keys, size=FINE_SKETCH), FINE_MARGIN
            return _narrowed(long_values(df, keys, columns), known, [*keys, "column"], probabilities, margin)
    levels = array(num(p) for p in probabilities)
    entries = table({"column": quote(c), "quantiles": f"percentile(double({col(c)}), {levels})"} for c in columns)
    buffered = df.groupBy(*keys).agg(F.expr(entries).alias("_r"))
    return buffered.selectExpr(*keys, "inline(_r)").filter("quantiles IS NOT NULL")


def _brackets(known: DataFrame, probabilities: list[float], margin: float) -> DataFrame:
    """(_g, _n, _b): the value brackets of every group, one for each probability."""

    # a rank p * (n - 1) lies within 2 / n of the share p; where that is not small, all values are in
    small = f"n * {num(margin)} < 4D"

    def bracket(p: float) -> dict[str, Expr]:
        low, high = p - 1.5 * margin, p + 1.5 * margin
        return {
            "lo": "low" if low <= 0 else f"CASE WHEN {small} THEN low ELSE kll_sketch_get_quantile_double(sketch, {num(low)}) END",
            "hi": "high" if high >= 1 else f"CASE WHEN {small} THEN high ELSE kll_sketch_get_quantile_double(sketch, {num(high)}) END",
        }

    return known.selectExpr("_g", "n AS _n", f"{table(bracket(p) for p in probabilities)} AS _b")


def _narrowed(long: DataFrame, known: DataFrame, keys: list[str], probabilities: list[float], margin: float) -> DataFrame:
    # the keys form one struct, so that null keys match each other in the joins
    group = f"struct({cols(keys)}) AS _g"
    values = long.selectExpr(group, "value")
    groups = known.where("n > 0").selectExpr(group, "n", "low", "high", "sketch")
    few = groups.count() <= BROADCAST_GROUPS
    while True:
        limits = stored(_brackets(groups, probabilities, margin), "brackets")
        # small for few groups, else a join that adaptive execution may split
        met = values.join(F.broadcast(limits) if few else limits, "_g")
        placed = met.selectExpr(
            "_g", "_n",
            "CASE WHEN exists(_b, b -> value BETWEEN b.lo AND b.hi) THEN value END AS _in",
            "array_max(transform(filter(_b, b -> b.hi < value), b -> b.hi)) AS _gap",
        )
        # a gap stands behind the values of the bracket below it; the lowest has no bracket below
        cell = ["_g", "_n", "coalesce(_in, _gap) AS _v", "_in IS NULL AS _outside"]
        counts = stored(placed.selectExpr(*cell).groupBy("_g", "_n", "_v", "_outside").agg(F.count(F.lit(1)).alias("_c")), "rank-counts")
        order = window(["_g"], "_v NULLS FIRST, _outside", "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
        ends = add(counts, {"_end": f"sum(_c) OVER {order}"})

        def at(rank: Expr) -> Expr:
            return f"max(CASE WHEN NOT _outside AND _end - _c <= {rank} AND {rank} < _end THEN _v END)"

        ranks = [f"{num(p)} * (_n - 1)" for p in probabilities]
        pairs = table({"rank": f"any_value({r})", "a": at(f"floor({r})"), "b": at(f"ceil({r})")} for r in ranks)
        found = stored(ends.groupBy("_g").agg(F.expr(pairs).alias("_q")), "ranks")
        if not found.where("exists(_q, q -> q.a IS NULL OR q.b IS NULL)").isEmpty():
            margin *= 4
            continue
        # the weights of ``percentile``, and like there none between equal values: infinity stays infinity
        value = "CASE WHEN q.a = q.b THEN q.a ELSE (ceil(q.rank) - q.rank) * q.a + (q.rank - floor(q.rank)) * q.b END"
        return found.selectExpr("_g.*", f"transform(_q, q -> {value}) AS quantiles")
