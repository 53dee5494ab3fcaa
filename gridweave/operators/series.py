"""Row-position windows over ordered series, safe for series of any length.

A series on an hourly grid cannot exceed 8,784 rows a year, so when the caller proves a row
bound (``rows_bound``, one min/max job) a plain window per series is cheapest: one exchange,
one sort. Without a bound, or beyond ``PLAIN_ROWS``, rows get their exact position inside the
series by a two-step prefix sum, series are cut into chunks of ``CHUNK_ROWS`` positions, and
the few rows at chunk edges are copied to the neighbours. No task ever holds a whole series.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.functions.calendar import grid_index
from gridweave.functions.guards import half_even, settled_units
from gridweave.functions.text import Expr, add, col, cols, num, put, struct, window

PLAIN_ROWS = 1_000_000
CHUNK_ROWS = 8192
BUCKET_STEPS = 4096


@dataclass(frozen=True)
class Series:
    """How a panel is keyed: at most one row per key and grid step (see dedup.keep_first)."""

    keys: tuple[str, ...] = ("series_id",)
    time: str = "datetime"
    step: str = "hour"


def rows_bound(df: DataFrame, time: str, step: str = "hour") -> int:
    """Grid steps between the first and last time: no series can have more rows than this."""
    first, last = df.selectExpr(
        f"{grid_index(f'min({col(time)})', step)}", f"{grid_index(f'max({col(time)})', step)}"
    ).first()
    return 0 if first is None else int(last - first) + 1


def with_positions(df: DataFrame, series: Series, bucket_steps: int = BUCKET_STEPS) -> DataFrame:
    """Adds ``_bucket``, ``_cell`` and ``_pos``, the 0-based row position inside the series.

    Buckets of the time grid hold at most ``bucket_steps`` rows. Only bucket counts travel to
    a per-series window, and an hourly calendar has about two buckets a year. ``_cell`` is the
    struct (keys, bucket): as one key it lets the join and the numbering share an exchange, and
    null keys stay equal to each other.
    """
    keys = list(series.keys)
    numbered = add(df, {"_bucket": f"floor({grid_index(col(series.time), series.step)} / {bucket_steps})"})
    bucketed = add(numbered, {"_cell": cell(keys)})
    counts = bucketed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = window(keys, "_bucket", "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")
    offsets = counts.selectExpr(f"{cell(keys)} AS _cell", f"coalesce(sum(_n) OVER {before}, 0) AS _offset")
    inside = window(["_cell"], col(series.time))
    return add(bucketed.join(offsets, "_cell"), {"_pos": f"_offset + row_number() OVER {inside} - 1"}).drop("_offset")


def cell(keys: list[str]) -> Expr:
    return f"struct({cols([*keys, '_bucket'])})"


def with_chunks(df: DataFrame, before: int, after: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Adds ``_chunk`` and ``_own``; rows within reach of a neighbouring chunk are copied to it."""
    if before >= chunk_rows or after >= chunk_rows:
        raise ValueError("the window reach must be smaller than a chunk")
    chunk, offset = f"floor(_pos / {chunk_rows})", f"_pos % {chunk_rows}"

    def copy(to: Expr, own: str, condition: Expr) -> Expr:
        return f"CASE WHEN {condition} THEN {struct({'_chunk': to, '_own': own})} END"

    copies = ", ".join(
        [
            copy(chunk, "true", "true"),
            copy(f"{chunk} + 1", "false", f"{offset} >= {chunk_rows - before}"),
            copy(f"{chunk} - 1", "false", f"{offset} < {after} AND _pos >= {chunk_rows}"),
        ]
    )
    return df.selectExpr("*", f"inline(array_compact(array({copies})))")


def over_series(
    df: DataFrame,
    series: Series,
    columns: Callable[[list[str], str], dict[str, Expr]],
    *,
    before: int,
    after: int,
    bound: int | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Evaluate window expressions that look at most ``before`` / ``after`` rows away.

    ``columns(keys, order)`` gives the expressions for the partitioning that was chosen.
    """
    if bound is not None and bound <= PLAIN_ROWS:
        return add(df, columns(list(series.keys), col(series.time)))
    # a row is copied to the next chunk at most, so a chunk is at least twice as long as the reach
    chunks = with_chunks(with_positions(df, series), before, after, max(chunk_rows, 2 * before, 2 * after))
    made = add(chunks, columns([*series.keys, "_chunk"], "_pos"))
    return made.filter("_own").drop("_bucket", "_cell", "_pos", "_chunk", "_own")


def rolling_mean_before(value: Expr, rows: int, keys: list[str], order: str, decimals: int | None) -> Expr:
    """Mean of the ``rows`` rows before the current one; null unless all of them hold a value.

    With ``decimals`` the mean is rounded. The sum is settled first (``guards.settled``), so that the
    order of additions cannot move an exact tie across the rounding edge.
    """
    frame = window(keys, order, f"ROWS BETWEEN {rows} PRECEDING AND 1 PRECEDING")
    if decimals is None:
        mean = f"avg({value}) OVER {frame}"
    else:
        units = settled_units(f"sum({value}) OVER {frame}", decimals)
        mean = f"rint(({units}) / {num(rows)}) / {num(10**decimals)}"
    return f"CASE WHEN count({value}) OVER {frame} = {rows} THEN {mean} END"


def add_lag_block(
    df: DataFrame,
    series: Series,
    value: str = "load_kwh",
    *,
    lags: dict[str, int] | None = None,
    leads: dict[str, int] | None = None,
    rolling: dict[str, int] | None = None,
    decimals: int | None = 4,
    bound: int | None = None,
    drop_incomplete: bool = True,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Lags, forward targets and rolling means by row position, sharing one sort.

    Rows where any of the new columns is null are dropped, the rest is rounded half-even.
    """
    lags = {"load_lag_1": 1, "load_lag_24": 24} if lags is None else lags
    leads = {"target_1h": 1, "target_24h": 24} if leads is None else leads
    rolling = {"load_rolling_3": 3, "load_rolling_24": 24} if rolling is None else rolling

    def columns(keys: list[str], order: str) -> dict[str, Expr]:
        v, over = col(value), window(keys, order)
        out = {name: f"lag({v}, {k}) OVER {over}" for name, k in lags.items()}
        out.update({name: f"lead({v}, {k}) OVER {over}" for name, k in leads.items()})
        out.update({name: rolling_mean_before(v, n, keys, order, decimals) for name, n in rolling.items()})
        return out

    made = over_series(
        df,
        series,
        columns,
        before=max([*lags.values(), *rolling.values(), 0]),
        after=max([*leads.values(), 0]),
        bound=bound,
        chunk_rows=chunk_rows,
    )
    if drop_incomplete:
        made = made.dropna(subset=[*lags, *leads, *rolling])
    if decimals is not None and (lags or leads):
        made = put(made, {n: half_even(col(n), decimals) for n in [*lags, *leads]})
    return made


def first_rows(df: DataFrame, series: Series, rows: int) -> DataFrame:
    """The first ``rows`` rows of every series in time order.

    Spark cuts each map task's output to ``rows`` per series before the exchange
    (WindowGroupLimit), so a hot series costs no more than tasks x rows.
    """
    numbered = add(df, {"_rn": f"row_number() OVER {window(series.keys, col(series.time))}"})
    return numbered.filter(f"_rn <= {rows}").drop("_rn")


def first_series(df: DataFrame, series: Series) -> DataFrame:
    """Key of the first row in (key, time) order: one partial aggregate, no sort."""
    return df.selectExpr(f"array(min(struct({cols(series.keys)}))) AS _r").selectExpr("inline(_r)")
