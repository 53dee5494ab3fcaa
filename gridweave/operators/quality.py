"""Data-quality checks: one aggregate each, reported as rows (check, column, violations)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.fixed_values import PARITY_TOLERANCE
from gridweave.functions.guards import infinite, missing_or_not_finite, number, parse_time
from gridweave.functions.text import Expr, aggregate_rows, any_of, col, constant_rows, num, quote


class DataQualityError(ValueError):
    """A required column, row or value is missing or invalid."""


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    """Schema check: no job runs."""
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: list[str], what: str) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise DataQualityError(f"{what} is missing required columns: {missing}")
    return df


def required_columns_report(df: DataFrame, required: list[str]) -> DataFrame:
    """One row per required column with its presence and how many rows hold a value."""
    present = set(df.columns)
    return aggregate_rows(
        df,
        [
            {
                "column": quote(c),
                "present": str(int(c in present)),
                "filled_rows": f"count({col(c)})" if c in present else "0L",
            }
            for c in required
        ],
    )


def long_counts(df: DataFrame, counts: dict[tuple[str, str], Expr]) -> DataFrame:
    """One pass of conditional counts, as (check, column, violations) rows."""
    return aggregate_rows(
        df,
        [
            {"check": quote(check), "column": quote(column), "violations": f"count_if({condition})"}
            for (check, column), condition in counts.items()
        ],
    )


def quality_checks(
    df: DataFrame, features: list[str], targets: list[str], text_time: str | None = None
) -> DataFrame:
    """Missing or non-numeric, infinite, negative target and unparsable time, in one scan."""
    counts: dict[tuple[str, str], Expr] = {}
    for c in [*features, *targets]:
        counts["missing_or_non_numeric", c] = f"{number(col(c))} IS NULL"
        counts["infinite", c] = infinite(number(col(c)))
    for c in targets:
        counts["negative", c] = f"coalesce({number(col(c))} < 0, false)"
    if text_time is not None:
        counts["invalid_time", text_time] = f"{parse_time(col(text_time))} IS NULL"
    return long_counts(df, counts)


def finite_report(df: DataFrame, columns: list[str]) -> DataFrame:
    return long_counts(df, {("not_finite", c): missing_or_not_finite(col(c)) for c in columns})


def raise_on_violations(report: DataFrame, what: str) -> None:
    """Fail with the offending checks; the report has one row per check and column."""
    bad = report.filter("violations > 0").collect()
    if bad:
        details = ", ".join(f"{r['check']}({r['column']})={r['violations']}" for r in bad)
        raise DataQualityError(f"{what}: {details}")


def invalid_row(columns: list[str], target: str) -> Expr:
    """True for rows to remove: null or NaN in any listed column, or a negative target."""
    nulls = any_of(f"{col(c)} IS NULL OR isnan(double({col(c)}))" for c in [*columns, target])
    return f"({nulls} OR {col(target)} < 0)"


def remove_invalid_rows(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    return df.filter(f"NOT {invalid_row(columns, target)}")


def removed_row_count(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    bad = invalid_row(columns, target)
    return df.selectExpr(
        "count(*) AS rows_before", f"count_if({bad}) AS removed_rows", f"count_if(NOT {bad}) AS rows_after"
    )


def raw_scaled_parity(raw: DataFrame, scaled: DataFrame, keys: list[str], target: str) -> DataFrame:
    """Row, key and target agreement of two frames that must match one to one.

    Both sides are stacked and grouped by key, which combines on the map side; a join would
    pair every copy of a repeated key with every other copy.
    """

    def side(df: DataFrame, raw_row: int) -> DataFrame:
        return df.selectExpr(*keys, f"{raw_row} AS _is_raw", f"double({col(target)}) AS _t")

    both = side(raw, 1).unionByName(side(scaled, 0))
    per_key = both.groupBy(*keys).agg(
        F.expr("count_if(_is_raw = 1)").alias("_raw"),
        F.expr("count_if(_is_raw = 0)").alias("_scaled"),
        F.expr("max(_t) - min(_t)").alias("_gap"),
    )
    return per_key.selectExpr(
        "coalesce(sum(_raw), 0) AS raw_rows",
        "coalesce(sum(_scaled), 0) AS scaled_rows",
        "count_if(_raw != _scaled) AS key_mismatches",
        f"count_if(_raw = 1 AND _scaled = 1 AND _gap > {num(PARITY_TOLERANCE)}) AS target_mismatches",
        "count_if(_raw > 1 OR _scaled > 1) AS repeated_keys",
    )


def stats_coverage(spark: SparkSession, stats: DataFrame, expected: list[str]) -> DataFrame:
    """Expected columns without a statistics row, and rows with a non-positive or missing range."""
    wanted = constant_rows(spark, [{"column": quote(c)} for c in expected])
    absent = wanted.join(stats, "column", "left_anti").selectExpr("column", "'missing' AS problem")
    bad_range = stats.filter(f"{missing_or_not_finite('`range`')} OR `range` <= 0")
    return absent.unionByName(bad_range.selectExpr("column", "'bad_range' AS problem"))
