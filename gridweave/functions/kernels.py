"""NumPy work on one Arrow batch. Imports nothing from the package, so it travels by value."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd

Z_LIMIT = 1e6
SEGMENT = 512
BATCH_CELLS = 4_000_000


@dataclass(frozen=True)
class Rules:
    """Set centers and widths (inputs x sets), rule grid (rules x inputs), linear outputs."""

    mu: np.ndarray
    sigma: np.ndarray
    grid: np.ndarray
    coefficients: np.ndarray | None = None

    @property
    def width(self) -> int:
        return self.grid.shape[0] * (self.grid.shape[1] + 1)


def normalized(x: np.ndarray, rules: Rules) -> np.ndarray:
    """Rows x rules: strengths divided by their sum, via logs so that tiny ones survive."""
    z = np.clip((x[:, :, None] - rules.mu) / rules.sigma, -Z_LIMIT, Z_LIMIT)
    log_sets = -0.5 * z * z
    logs = sum(log_sets[:, i, rules.grid[:, i]] for i in range(x.shape[1]))
    weights = np.exp(logs - logs.max(axis=1, keepdims=True))
    return weights / weights.sum(axis=1, keepdims=True)


def basis(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x])


def design(x: np.ndarray, rules: Rules) -> np.ndarray:
    """Rows x width: every rule's weight times (1, inputs). Exists for one slice of a batch only."""
    return (normalized(x, rules)[:, :, None] * basis(x)[:, None, :]).reshape(len(x), rules.width)


def slices(rows: int, cells_per_row: int) -> Iterator[slice]:
    step = max(1, BATCH_CELLS // cells_per_row)
    for start in range(0, rows, step):
        yield slice(start, start + step)


def predict(x: np.ndarray, rules: Rules) -> np.ndarray:
    """Weighted sum of the linear outputs; NaN where an input is missing or infinite."""
    out = np.full(len(x), np.nan)
    usable = np.flatnonzero(np.isfinite(x).all(axis=1))
    for part in slices(len(usable), rules.grid.size):
        rows = x[usable[part]]
        out[usable[part]] = (normalized(rows, rules) * (basis(rows) @ rules.coefficients.T)).sum(axis=1)
    return out


def panel(weights: np.ndarray, base: np.ndarray, first: int, last: int) -> np.ndarray:
    """The columns of the design that belong to the rules from ``first`` to ``last``, exclusive."""
    return (weights[:, first:last, None] * base[:, None, :]).reshape(len(weights), -1)


def tile_sums(
    batches: Iterator[pd.DataFrame], names: list[str], targets: list[str], rules: Rules, cuts: np.ndarray, pairs: list[tuple[int, int]]
) -> Iterator[pd.DataFrame]:
    """One tile of D'D, and D'y beside a tile on the diagonal, over the rows of one task."""
    each = rules.grid.shape[1] + 1
    gram = moments = None
    for batch in batches:
        if batch.empty:
            continue
        a, b = pairs[int(batch["_tile"].iloc[0])]
        one, two = (cuts[a], cuts[a + 1]), (cuts[b], cuts[b + 1])
        if gram is None:
            gram = np.zeros(((one[1] - one[0]) * each, (two[1] - two[0]) * each))
            moments = np.zeros((len(targets), len(gram)))
        x, y = batch[names].to_numpy(dtype=float), batch[targets].to_numpy(dtype=float)
        for part in slices(len(x), rules.width):
            weights, base = normalized(x[part], rules), basis(x[part])
            left = panel(weights, base, *one)
            gram += left.T @ (left if a == b else panel(weights, base, *two))
            moments += y[part].T @ left
    if gram is None:
        return
    top, side = int(one[0]) * each, int(two[0]) * each
    if a == b:
        cells = [(top + i, top + i, gram[i, i:]) for i in range(len(gram))] + [(top, -1 - k, m) for k, m in enumerate(moments)]
    else:
        cells = [(top + i, side, row) for i, row in enumerate(gram)]
    for start in range(0, len(cells), 256):
        yield pd.DataFrame(cells[start : start + 256], columns=["i", "j", "values"])


def product_sums(
    batches: Iterator[pd.DataFrame], names: list[str], targets: list[str], rules: Rules, columns: np.ndarray | None, cuts: np.ndarray
) -> Iterator[pd.DataFrame]:
    """D'(D V) for one panel of the columns V, or D'Y, over the rows of one task."""
    out = None
    for batch in batches:
        if batch.empty:
            continue
        number = int(batch["_tile"].iloc[0])
        first, last = int(cuts[number]), int(cuts[number + 1])
        out = np.zeros((rules.width, last - first)) if out is None else out
        x, y = batch[names].to_numpy(dtype=float), batch[targets].to_numpy(dtype=float)
        for part in slices(len(x), rules.width):
            d = design(x[part], rules)
            out += d.T @ (y[part][:, first:last] if columns is None else d @ columns[:, first:last])
    if out is None:
        return
    step = max(1, SEGMENT // (last - first))
    cells = [(i, first, out[i : i + step].ravel()) for i in range(0, len(out), step)]
    for start in range(0, len(cells), 4096):
        yield pd.DataFrame(cells[start : start + 4096], columns=["i", "j", "values"])


def add_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Streams (i, j, values) rows into one total for each (i, j)."""
    totals: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for i, j, values in zip(batch["i"], batch["j"], batch["values"]):
            if (i, j) in totals:
                totals[i, j] += np.asarray(values, dtype=float)
            else:
                totals[i, j] = np.array(values, dtype=float)
    if totals:
        yield pd.DataFrame([(i, j, v) for (i, j), v in totals.items()], columns=["i", "j", "values"])


# --- co-moments of pairs of columns -----------------------------------------------------------

#: Rows with both values, the two means, and the centred sums of squares and products.
MOMENTS = ("n", "mean_x", "mean_y", "xx", "yy", "xy")


def co_moments(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """MOMENTS of every column of ``x`` with every column of ``y``; NaN is missing."""

    def shifted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        there = ~np.isnan(values)
        # a value of the column itself: constant columns get exact zeros
        base = values[there.argmax(axis=0), np.arange(values.shape[1])]
        base = np.where(np.isfinite(base), base, 0.0)
        return np.where(there, values - base, 0.0), there.astype(float), base

    with np.errstate(invalid="ignore", over="ignore"):
        (a, has_a, base_a), (b, has_b, base_b) = shifted(x), shifted(y)
        n = has_a.T @ has_b
        some = np.maximum(n, 1)
        sum_a, sum_b = a.T @ has_b, has_a.T @ b
        xx, yy, xy = (a * a).T @ has_b - sum_a**2 / some, has_a.T @ (b * b) - sum_b**2 / some, a.T @ b - sum_a * sum_b / some
        return n, base_a[:, None] + sum_a / some, base_b[None, :] + sum_b / some, xx, yy, xy


def merged_moments(one: tuple[np.ndarray, ...], two: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """MOMENTS of the rows of both."""
    with np.errstate(invalid="ignore", over="ignore"):
        n = one[0] + two[0]
        share = two[0] / np.maximum(n, 1)
        # an empty side has no mean
        dx, dy = (np.where((one[0] > 0) & (two[0] > 0), two[i] - one[i], 0.0) for i in (1, 2))
        mean_x, mean_y = (np.where(one[0] > 0, one[i] + d * share, two[i]) for i, d in ((1, dx), (2, dy)))
        weight = one[0] * share
        return n, mean_x, mean_y, *(one[i] + two[i] + p * weight for i, p in ((3, dx * dx), (4, dy * dy), (5, dx * dy)))


def pearson(found: tuple[np.ndarray, ...]) -> np.ndarray:
    """r, NaN where it is undefined."""
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        spread = np.sqrt(found[3]) * np.sqrt(found[4])
        return np.where((spread > 0) & np.isfinite(spread), found[5] / spread, np.nan)
