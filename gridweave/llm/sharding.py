"""Shards of nearly equal size that keep equal texts together.

Rows are ordered by a 64-bit hash of their text; all rows of one hash are an atomic group. A group of a
fair share or more gets a shard of its own. The others are cut into contiguous ranges: binary search finds
the smallest capacity for which filling shards greedily needs no more shards than there are, and the cuts
are made there, each as near to an even share as this capacity allows.

The driver never sees the groups. It holds cells (hash ranges) with their sizes. For cells of more than
one group the greedy check is run twice, once as if they could be cut anywhere and once as if not at all;
cells where the two runs could cut differently are split by the next bits of the hash and counted again,
until only single groups are left there. A round collects at most ``CELLS`` rows, or 256 for each cell it
splits, and each round divides the open range by 256.

Size is the UTF-8 length of the text plus 8; null text counts as empty. Repeated rows stay together. More
shards than groups leave some empty; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.common import stored, text_or_empty

ROW_BYTES = 8
CELL_BITS, SPLIT_BITS = 14, 8
CELLS = 1 << CELL_BITS
#: Slices of a shard in which rows are numbered.
SLOT_SLICES = 256


@dataclass
class Cells:
    """Sizes of consecutive hash ranges, in order. ``groups`` is 1 where a range cannot be split."""

    first: np.ndarray
    bits: np.ndarray
    size: np.ndarray
    groups: np.ndarray

    @property
    def ends(self) -> np.ndarray:
        return np.cumsum(self.size)


def sized(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(_id, size, text_crc32, _key): the only pass over the texts."""
    content = text_or_empty(text)
    return docs.select(
        F.col(id_column).alias("_id"),
        (F.octet_length(content) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        F.xxhash64(content).alias("_key"),
    )


def count_cells(groups: DataFrame, bits: int) -> Cells:
    """Cells of the leading ``bits`` of the hash that hold anything."""
    cell = F.shiftright("_key", 64 - bits) if bits < 64 else F.col("_key")
    rows = groups.groupBy(cell.alias("c")).agg(F.sum("_size").alias("s"), F.count("*").alias("n")).orderBy("c").collect()
    first = np.array([r["c"] << (64 - bits) for r in rows], np.int64)
    return Cells(first, np.full(len(rows), bits), np.array([r["s"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64))


def split_cells(groups: DataFrame, cells: Cells, open_cells: np.ndarray) -> Cells:
    """The same cells, the open ones cut by the next bits of the hash."""
    kept = ~open_cells
    parts = [Cells(cells.first[kept], cells.bits[kept], cells.size[kept], cells.groups[kept])]
    for bits in np.unique(cells.bits[open_cells]):
        firsts = cells.first[open_cells & (cells.bits == bits)]
        spark = groups.sparkSession
        wanted = F.broadcast(spark.createDataFrame([(int(x),) for x in firsts], "_first long"))
        mask = F.lit(int(np.int64(-1) << np.int64(64 - bits)))
        inside = groups.join(wanted, F.col("_key").bitwiseAND(mask) == F.col("_first"), "left_semi")
        parts.append(count_cells(inside, min(64, int(bits) + SPLIT_BITS)))
    merged = [np.concatenate(x) for x in zip(*[(p.first, p.bits, p.size, p.groups) for p in parts])]
    order = np.argsort(merged[0], kind="stable")
    return Cells(*[x[order] for x in merged])


def greedy(ends: np.ndarray, solid: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Amounts taken after 1, 2, ... shards of at most ``capacity``; cells that are not ``solid`` may be
    cut anywhere. Ends early when a solid cell does not fit."""
    taken, out = 0, []
    for _ in range(shards):
        reach = taken + capacity
        i = int(np.searchsorted(ends, reach, "right"))
        stop = int(ends[i - 1]) if i else 0
        if i < len(ends) and not solid[i]:
            stop = reach
        if stop <= taken:
            break
        taken = stop
        out.append(taken)
        if taken >= ends[-1]:
            break
    return out


def smallest_capacity(ends: np.ndarray, solid: np.ndarray, shards: int) -> int:
    low, high = 0, int(ends[-1])
    while high - low > 1:
        middle = (low + high) // 2
        done = greedy(ends, solid, middle, shards)
        low, high = (low, middle) if done and done[-1] >= ends[-1] else (middle, high)
    return high


def open_cells(cells: Cells, shards: int) -> np.ndarray:
    """Cells of several groups in which a cut of the true optimum may fall."""
    ends, single = cells.ends, cells.groups == 1
    low = smallest_capacity(ends, single, shards)
    high = smallest_capacity(ends, np.ones_like(single), shards)
    late = greedy(ends, single, high, shards)
    early = greedy(ends, np.ones_like(single), low, shards)
    early += [early[-1] if early else 0] * (len(late) - len(early))
    inside = np.zeros(len(ends), bool)
    for a, b in zip(early, late):
        inside[np.searchsorted(ends, a, "right") : np.searchsorted(ends, b, "left") + 1] = True
    return (inside | (cells.size > low)) & ~single


def even_cuts(ends: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Ends of the shards but the last: known borders, no shard above ``capacity``, near to even shares."""
    total, cuts, taken = int(ends[-1]), [], 0
    borders = np.concatenate([[0], ends])
    # the least that must be taken by each cut, so that the remaining shards can hold the rest
    needed, least = total, []
    for _ in range(shards - 1):
        needed = int(borders[np.searchsorted(borders, needed - capacity, "left")])
        least.append(needed)
    least = [max(0, x) for x in reversed(least)]
    for i in range(1, shards):
        wanted = total * i // shards
        k = int(np.searchsorted(borders, wanted, "left"))
        near = min(borders[max(0, k - 1)], borders[min(k, len(borders) - 1)], key=lambda b: abs(int(b) - wanted))
        top = int(borders[np.searchsorted(borders, taken + capacity, "right") - 1])
        taken = min(max(int(near), least[i - 1], taken), top)
        cuts.append(taken)
    return cuts


@dataclass(frozen=True)
class Layout:
    """Shard of each oversize hash, and the first hashes of shards 1, 2, ... of the others."""

    alone: dict[int, int]
    starts: list[int]
    capacity: int


def make_layout(groups: DataFrame, shards: int) -> Layout:
    """``groups``: one row (_key, _size) for each atomic group."""
    largest = [(r["_key"], r["_size"]) for r in groups.orderBy(F.desc("_size"), "_key").limit(shards).collect()]
    rest = groups.agg(F.sum("_size")).first()[0] or 0
    alone: dict[int, int] = {}
    for key, size in largest:
        if shards - len(alone) > 1 and size * (shards - len(alone)) >= rest:
            alone[key] = shards - 1 - len(alone)
            rest -= size
    left = shards - len(alone)
    others = groups.where(~F.col("_key").isin(list(alone))) if alone else groups
    cells = count_cells(others, CELL_BITS)
    if not len(cells.size):
        return Layout(alone, [], 0)
    while (wanted := open_cells(cells, left)).any():
        cells = split_cells(others, cells, wanted)
    ends = cells.ends
    capacity = smallest_capacity(ends, np.ones(len(ends), bool), left)
    cuts = even_cuts(ends, capacity, left)
    starts = [int(cells.first[i]) if (i := int(np.searchsorted(ends, cut, "right"))) < len(ends) else None for cut in cuts]
    return Layout(alone, starts, capacity)


def shard_of(layout: Layout) -> Column:
    # a cut at the very end leaves the shards after it empty
    passed = [F.when(F.col("_key") >= start, 1).otherwise(0) for start in layout.starts if start is not None]
    shard = sum(passed, F.lit(0))
    for key, number in layout.alone.items():
        shard = F.when(F.col("_key") == key, number).otherwise(shard)
    return shard.cast("int")


def numbered(rows: DataFrame) -> DataFrame:
    """A gapless ``slot`` from 0 in every shard, counted in slices of the shard that hash the id."""
    sliced = rows.withColumn("_slice", F.expr(f"pmod(xxhash64(_id, size, text_crc32), {SLOT_SLICES})"))
    before = Window.partitionBy("shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sliced.groupBy("shard", "_slice")
        .agg(F.count("*").alias("_n"))
        .select("shard", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    number = F.row_number().over(Window.partitionBy("shard", "_slice").orderBy("_id"))
    return sliced.withColumn("_number", number).join(F.broadcast(starts), ["shard", "_slice"]).withColumn("slot", F.expr("_before + _number - 1"))


def shard(docs: DataFrame, shards: int = 24, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard (null: not a key law)."""
    rows = stored(sized(docs, id_column, text), "sizes")
    groups = stored(rows.groupBy("_key").agg(F.sum("size").alias("_size")), "groups")
    layout = make_layout(groups, shards)
    placed = stored(rows.withColumn("shard", shard_of(layout)), "shards")
    return numbered(placed).select(
        F.col("_id").alias(id_column),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
