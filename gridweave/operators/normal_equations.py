"""Sums over all rows that a ridge fit needs, and its two solutions: direct and iterative.

D is the design matrix (rows x coefficients). It exists for a slice of one batch only.

* ``gram_tiles`` gives D'D and D'y as tiles of the matrix. Rows are cut into groups and columns into
  panels; a task adds up one tile of one row group. With R groups and B tiles the tiles move R times the
  matrix and the rows move B times their size, so ``layout`` picks the cheapest split for the tasks at hand:
  few rows give one group (no sums are shuffled at all), many rows give many groups. A full matrix for each
  task would move tasks times the matrix.
* ``products`` gives D'(D V) for a few columns V in one pass, which is all that the iterative solution needs:
  conjugate gradients with a randomised Nystrom preconditioner. Neither D'D nor a cubic solve is on the
  driver, which holds a few columns of the model's width.

Both read a written table of the few input numbers, so a lost task or executor is redone from it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.functions import kernels
from gridweave.functions.text import col, select
from gridweave.operators.quality import DataQualityError
from gridweave.session import stored

SUMS = "i bigint, j bigint, values array<double>"
#: Columns of the random sketch of the preconditioner.
SKETCH = 320
#: The residual of every equation, as a share of the largest right side.
TOLERANCE = 1e-9
MOST_STEPS = 2_000
#: Rows that are worth a task of their own.
TASK_ROWS = 256


@dataclass(frozen=True)
class FitInput:
    """The numbers of a fit, written once, and how many rows there are."""

    rows: DataFrame
    names: list[str]
    targets: list[str]
    count: int

    @property
    def row_bytes(self) -> int:
        return 8 * (len(self.names) + len(self.targets) + 1)

    @property
    def tasks(self) -> int:
        wanted = 2 * self.rows.sparkSession.sparkContext.defaultParallelism
        return max(1, min(wanted, math.ceil(self.count / TASK_ROWS)))


def fit_input(df: DataFrame, names: list[str], targets: list[str]) -> FitInput:
    rows = stored(df.selectExpr(*select([], {c: f"double({col(c)})" for c in [*names, *targets]})), "fit-input")
    count = rows.count()
    if not count:
        raise DataQualityError("no rows to fit on")
    return FitInput(rows, names, targets, count)


# --- who adds up what ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Layout:
    """Row groups and column panels; ``moved`` is what the exchanges move, in bytes."""

    groups: int
    panels: int
    moved: int


def layout(tasks: int, matrix_bytes: int, table_bytes: int, most_panels: int, triangular: bool) -> Layout:
    """The split that moves least among those that keep ``tasks`` tasks busy.

    ``triangular``: p panels make p (p + 1) / 2 tiles, otherwise p.
    """
    found = []
    for panels in range(1, max(1, most_panels) + 1):
        tiles = panels * (panels + 1) // 2 if triangular else panels
        groups = max(1, math.ceil(tasks / tiles))
        sums = groups * matrix_bytes if groups > 1 else 0
        found.append(Layout(groups, panels, sums + tiles * table_bytes))
        if tiles >= tasks:
            break
    return min(found, key=lambda x: x.moved)


def dealt(data: FitInput, groups: int, tiles: int) -> DataFrame:
    """Every row once for every tile, with ``_tile``; one partition for each row group and tile."""
    part = F.monotonically_increasing_id() % groups * tiles
    each = data.rows.withColumn("_part", part).select("*", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("_tile"))
    return each.repartitionById(groups * tiles, (F.col("_part") + F.col("_tile")).cast("int")).drop("_part")


def added(parts: DataFrame, groups: int) -> DataFrame:
    """Sums of the row groups; with one group there is nothing to add."""
    return parts if groups == 1 else parts.repartition("i", "j").mapInPandas(kernels.add_rows, SUMS)


def gram_tiles(data: FitInput, rules: kernels.Rules) -> DataFrame:
    """D'D and D'y as rows (i, j, values): the cells (i, j), (i, j + 1), ... of the upper triangle; ``j`` =
    -1 - k marks the cells i, i + 1, ... of D'y of target k."""
    most = max(1, len(rules.grid) // 8)
    plan = layout(data.tasks, 4 * rules.width**2, data.count * data.row_bytes, most, triangular=True)
    cuts = np.linspace(0, len(rules.grid), plan.panels + 1).astype(int)
    pairs = [(a, b) for a in range(plan.panels) for b in range(a, plan.panels)]
    names, targets = data.names, data.targets

    def accumulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return kernels.tile_sums(batches, names, targets, rules, cuts, pairs)

    return added(dealt(data, plan.groups, len(pairs)).mapInPandas(accumulate, SUMS), plan.groups)


def products(data: FitInput, rules: kernels.Rules, columns: np.ndarray | None) -> np.ndarray:
    """D'(D V) for the columns V, or D'Y for the targets, from one pass over the rows."""
    width = columns.shape[1] if columns is not None else len(data.targets)
    plan = layout(data.tasks, 8 * rules.width * width, data.count * data.row_bytes, max(1, width // 16), triangular=False)
    cuts = np.linspace(0, width, plan.panels + 1).astype(int)
    shared = data.rows.sparkSession.sparkContext.broadcast(columns)  # the model's width times a few columns
    names, targets = data.names, data.targets

    def accumulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return kernels.product_sums(batches, names, targets, rules, shared.value, cuts)

    found = added(dealt(data, plan.groups, plan.panels).mapInPandas(accumulate, SUMS), plan.groups).toArrow()
    out = np.zeros((rules.width, width))
    of = {int(first): int(last) for first, last in zip(cuts, cuts[1:])}
    for i, j, values in cells(found):
        part = values.reshape(-1, of[j] - j)
        out[i : i + len(part), j : of[j]] = part
    shared.destroy()
    return out


def cells(found) -> Iterator[tuple[int, int, np.ndarray]]:
    """Rows of SUMS from an Arrow table."""
    for batch in found.to_batches():
        starts = batch["values"].offsets.to_numpy()
        # a sum spoilt by a missing input arrives as null and becomes NaN here
        flat = batch["values"].values.to_numpy(zero_copy_only=False)
        for i, j, a, b in zip(batch["i"].to_pylist(), batch["j"].to_pylist(), starts, starts[1:]):
            yield i, j, flat[a:b]


def gram_and_moments(data: FitInput, rules: kernels.Rules) -> tuple[np.ndarray, np.ndarray]:
    """D'D and D'y on the driver: the size of the model, whatever the number of rows."""
    gram, moments = np.zeros((rules.width, rules.width)), np.zeros((len(data.targets), rules.width))
    for i, j, values in cells(gram_tiles(data, rules).toArrow()):
        if j < 0:
            moments[-1 - j, i : i + len(values)] = values
        else:
            gram[i, j : j + len(values)] = values
    upper = np.triu(gram, 1)
    gram += upper.T
    return gram, moments


# --- solutions ----------------------------------------------------------------------------------


def solve(gram: np.ndarray, moment: np.ndarray, alpha: float) -> np.ndarray:
    """Ridge with every coefficient penalised; least squares when the system is singular."""
    system = gram + alpha * np.eye(len(gram))
    try:
        return np.linalg.solve(system, moment)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(system, moment, rcond=None)[0]


@dataclass(frozen=True)
class Preconditioner:
    """(D'D + alpha)^-1 where D'D is replaced by its Nystrom approximation U diag(values) U'."""

    u: np.ndarray
    values: np.ndarray
    alpha: float

    def __call__(self, r: np.ndarray) -> np.ndarray:
        inside = self.u.T @ r
        shrunk = inside * ((self.values[-1] + self.alpha) / (self.values + self.alpha))[:, None]
        return r + self.u @ (shrunk - inside)


def nystrom(data: FitInput, rules: kernels.Rules, alpha: float, sketch: int, seed: int) -> Preconditioner:
    """From one pass: D'(D Q) for a random orthonormal Q of ``sketch`` columns."""
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(rules.width, min(sketch, rules.width))))[0]
    y = products(data, rules, q)
    shift = np.finfo(float).eps * max(float(np.linalg.norm(y)), 1e-300)
    y += shift * q
    inner = q.T @ y
    inner = (inner + inner.T) / 2
    # a root of the inner matrix that also exists when it is not quite positive definite
    eig, vec = np.linalg.eigh(inner)
    kept = eig > shift
    half = y @ (vec[:, kept] / np.sqrt(eig[kept]))
    u, s, _ = np.linalg.svd(half, full_matrices=False)
    return Preconditioner(u, np.maximum(0.0, s**2 - shift), alpha)


def conjugate_gradients(data: FitInput, rules: kernels.Rules, alpha: float, sketch: int = SKETCH, tolerance: float = TOLERANCE, seed: int = 0) -> np.ndarray:
    """Coefficients of every target (targets x width); each step is one pass for all targets together."""
    right = products(data, rules, None)
    if not np.isfinite(right).all():
        raise DataQualityError("fit input: a value is missing, infinite or too large")
    before = nystrom(data, rules, alpha, sketch, seed)
    found, r = np.zeros_like(right), right.copy()
    limit = tolerance * np.maximum(np.abs(right).max(axis=0), np.finfo(float).tiny)
    z = before(r)
    p, rz = z.copy(), (r * z).sum(axis=0)
    for _ in range(MOST_STEPS):
        open_ = np.abs(r).max(axis=0) > limit
        if not open_.any():
            return found.T
        ap = products(data, rules, p) + alpha * p
        length = np.where(open_, rz / np.maximum((p * ap).sum(axis=0), np.finfo(float).tiny), 0.0)
        found += length * p
        r -= length * ap
        z = before(r)
        after = (r * z).sum(axis=0)
        p = z + np.where(open_, after / np.maximum(rz, np.finfo(float).tiny), 0.0) * p
        rz = after
    raise DataQualityError(f"no solution after {MOST_STEPS} passes; use a larger sketch or ridge")
