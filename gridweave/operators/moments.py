"""Pearson correlations from mergeable co-moments: one pass, whatever the number of columns.

A task turns each Arrow batch into a few matrix products: for every pair of columns the number of rows that
have both values, their means and the centred sums of squares and products over these rows. Such sets are
merged without loss of digits, within a task and then between tasks, where each row of the matrix is merged
by itself. The volume is the number of pairs for each task, not the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from gridweave.functions import kernels
from gridweave.functions.text import col

PARTS = "x int, " + ", ".join(f"{name} array<double>" for name in kernels.MOMENTS)


def correlations(df: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """(x, y, r) for every column of ``left`` with every column of ``right``, over the rows that have both values.

    NaN counts as missing; r is null where one of the two does not vary, or is infinite somewhere.
    """
    names = list(dict.fromkeys([*left, *right]))
    at = [names.index(c) for c in left], [names.index(c) for c in right]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            if batch.num_rows:
                values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])  # null becomes NaN
                one = kernels.co_moments(values[:, at[0]], values[:, at[1]])
                found = one if found is None else kernels.merged_moments(found, one)
        if found is not None:
            columns = [pa.array(range(len(left)), pa.int32()), *[pa.array(list(m), pa.list_(pa.float64())) for m in found]]
            yield pa.RecordBatch.from_arrays(columns, names=["x", *kernels.MOMENTS])

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: dict[int, tuple[np.ndarray, ...]] = {}
        for batch in batches:
            for x, *parts in batch.itertuples(index=False):
                one = tuple(np.asarray(p, float) for p in parts)
                rows[x] = kernels.merged_moments(rows[x], one) if x in rows else one
        for x, found in rows.items():
            r = kernels.pearson(found)
            yield pd.DataFrame({"x": left[x], "y": right, "r": pd.Series(r).astype(object).where(~np.isnan(r), None)})

    numbers = df.selectExpr(*[f"double({col(c)}) AS {col(c)}" for c in names])
    return numbers.mapInArrow(gather, PARTS).repartition("x").mapInPandas(finish, "x string, y string, r double")
