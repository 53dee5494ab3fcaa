"""Best-fit packing of token sequences.

Documents become token ids plus an end id; only longer ones are cut, into pieces of ``capacity`` ids of
which the first may be shorter. Where a piece goes depends on its length alone, so the plan is made on
the histogram of lengths (at most ``capacity`` numbers, however many documents there are):

1. Configuration linear program: cover the count of every length with patterns of lengths that fit one
   sequence, using as few patterns as possible. Multiplicative weights hold a price for each length, which
   falls exponentially with what is covered of it; a knapsack dynamic program finds the patterns worth most
   at these prices. One program serves a batch of patterns, the best one through each length.
2. Rounding: patterns become whole sequences as long as pieces last, those with the longest piece first and
   only full ones. What is left is a smaller instance, which is solved and rounded again, until no full
   pattern is left; then patterns with more and more room are taken, up to ``MOST_ROOM``. The few last
   pieces go, by decreasing length, to the fullest sequence with room (best fit), also on the histogram.
3. A few settings of the weights are tried and the plan with fewest sequences is taken; best fit alone is
   cheap to plan and taken only if it needs fewer sequences than all of them.

A piece finds its sequence by its rank among the pieces of its length. Ranks come from counts of hashed
slices of each length, so no task holds all pieces of a common length.

Null text counts as empty and gives one piece of the end id alone. Repeated rows are packed each for
itself. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.common import by_value, stored, text_or_empty

by_value(__name__)

CAPACITY = 1024
END_ID = 2
#: How much of its count a length may gain from one pattern, and how much less than the best pattern another
#: one of the same batch may be worth; the settings that are tried.
SETTINGS = ((0.5, 1.0), (1.0, 1.0), (0.5, 0.3))
#: Prices grow a little faster than lengths, so that long pieces, which are hard to place, come first.
PRICE_POWER = 1.2
#: Room that a pattern may leave in the last rounds.
MOST_ROOM = 64
#: Most pieces that one task ranks, and into how many slices a length that all pieces had would be cut.
SLICE_ROWS, SLICES = 200_000, 256


# --- tokens -----------------------------------------------------------------------------------------


#: How byte-level vocabularies split text before the merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: White space as the pattern knows it, in runs that are too long for its look-ahead.
LONG_BLANKS = re.compile("[\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{10000,}")


def byte_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and ids of a byte-level vocabulary file (JSON of the ``tokenizers`` library).

    The file writes printable bytes as themselves and moves the others up, in order, from 256.
    """
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    special = {t["content"] for t in content["added_tokens"]}
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    return {bytes(map(byte_of.__getitem__, t)): i for t, i in content["model"]["vocab"].items() if t not in special}


def special_ids(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


class Encoder:
    """Ids of a byte-level BPE.

    They are those of the ``tokenizers`` library for the same file; ``tiktoken`` does the merges, as it is
    four times as fast. With ``special``, as the library does by default, a special token written out in the
    text has its own id; otherwise it is read as ordinary text.
    """

    def __init__(self, path: str, special: bool = False):
        import tiktoken

        found = special_ids(path) if special else {}
        self.special = tuple(found)
        self.merges = tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=byte_ranks(path), special_tokens=found)

    def encode(self, text: str) -> list[int]:
        """The pattern takes a run of white space as one piece, without its last character when more text follows
        than a special token. Very long runs are cut off by this rule first, since the look-ahead of the
        pattern cannot hold them."""
        out, done = [], 0
        for run in LONG_BLANKS.finditer(text):
            last = run.end() == len(text) or text.startswith(self.special, run.end())
            end = run.end() if last else run.end() - 1
            out += self.merges.encode(text[done : run.start()], allowed_special="all")
            out += self.merges._encode_single_piece(text[run.start() : end])
            done = end
        return out + self.merges.encode(text[done:], allowed_special="all") if done else self.merges.encode(text, allowed_special="all")

    def __call__(self, text: str) -> bytes:
        """Little-endian 32-bit numbers."""
        ids = array("I", self.encode(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()


PIECES = "id long, piece int, start long, length long, ids_crc32 long"


def _cut(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encode, end = Encoder(path, special=True), np.array([end_id], "<u4").tobytes()
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = ["id", "piece", "start", "length", "ids_crc32"]
    if with_ids:
        types.append(pa.list_(pa.int64()))
        names.append("ids")

    def cut(text: str) -> list[tuple]:
        chain = encode(text) + end
        total = len(chain) // 4
        first = total % capacity if total > capacity else total
        cuts = [0, *range(first or capacity, total + 1, capacity)]
        out = []
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            part = chain[4 * a : 4 * b]
            row = (i, a, b - a, zlib.crc32(part))
            out.append((*row, np.frombuffer(part, "<u4").astype("i8")) if with_ids else row)
        return out

    for batch in batches:
        known: dict[str, list[tuple]] = {}  # copies within a batch are encoded once
        rows: list[tuple] = []
        for key, value in zip(batch.column("id").to_pylist(), batch.column("text")):
            text = value.as_py()
            if text not in known:
                known[text] = cut(text)
            rows += [(key, *piece) for piece in known[text]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names=names)


def pieces(
    docs: DataFrame,
    tokenizer: str,
    id_column: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    ids: bool = False,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every piece, and the token ids themselves on request."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), text_or_empty(text).alias("text"))
    schema = PIECES + (", ids array<long>" if ids else "")
    return rows.mapInArrow(lambda batches: _cut(batches, tokenizer, capacity, end_id, ids), schema)


# --- plan on the histogram --------------------------------------------------------------------------


def knapsack(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Greatest value that fits into every room up to ``capacity`` (lengths may repeat), and the length to
    take first, -1 where the room stays as one smaller."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if k := fitting[room]:
            totals = best[room - lengths[:k]] + values[:k]
            if totals[i := int(totals.argmax())] > best[room]:
                best[room], pick[room] = totals[i], i
    return best, pick


def pattern_through(start: int, lengths: np.ndarray, pick: np.ndarray, capacity: int) -> np.ndarray:
    """How often each length occurs in the best pattern that holds length number ``start``."""
    times, room = np.zeros(len(lengths), np.int64), capacity - int(lengths[start])
    times[start] = 1
    while room > 0:
        if pick[room] < 0:
            room -= 1
        else:
            times[pick[room]] += 1
            room -= int(lengths[pick[room]])
    return times


def solve_lp(lengths: np.ndarray, counts: np.ndarray, capacity: int, step: float, near: float) -> list[tuple[np.ndarray, float]]:
    """Patterns with fractional counts that cover the histogram, by multiplicative weights.

    In every round each uncovered length whose best pattern is worth at least 1 - ``near`` of the best of all
    takes that pattern until its scarcest length has gained ``step`` of its count. Every round covers ``step``
    of some length, so it ends.
    """
    covered = np.zeros(len(lengths))
    chosen: dict[bytes, tuple[np.ndarray, float]] = {}
    weight = (lengths / capacity) ** PRICE_POWER
    while (open_ := covered < 1).any():
        price = np.where(open_, weight * np.exp(-covered / step), 0.0)
        price /= price.max()
        best, pick = knapsack(lengths, price, capacity)
        worth = price + best[capacity - lengths]
        for i in np.flatnonzero(open_ & (worth >= (1 - near) * best[capacity]))[::-1]:
            if covered[i] >= 1:
                continue
            pattern = pattern_through(i, lengths, pick, capacity)
            used = pattern > 0
            amount = step * (counts[used] / pattern[used]).min()
            covered[used] += amount * pattern[used] / counts[used]
            old = chosen.get(pattern.tobytes(), (pattern, 0.0))[1]
            chosen[pattern.tobytes()] = (pattern, old + amount)
    return list(chosen.values())


Sequences = list[tuple[tuple[int, ...], int]]


def place_patterns(lengths: np.ndarray, counts: np.ndarray, capacity: int, step: float, near: float) -> tuple[Sequences, np.ndarray]:
    """Whole sequences as (lengths inside, number of such sequences), and the counts that are left."""
    left, out, room = counts.copy(), [], 0
    while left.any():
        here = np.flatnonzero(left)
        own, rest = lengths[here], left[here]
        solution = [(p, amount, capacity - int(p @ own), int(own[np.flatnonzero(p)[-1]])) for p, amount in solve_lp(own, rest, capacity, step, near)]
        placed = False
        for pattern, amount, free, longest in sorted(solution, key=lambda x: (-x[3], x[2], -x[1])):
            used = pattern > 0
            number = min(max(1, round(amount)), int((rest[used] // pattern[used]).min())) if free <= room else 0
            if number:
                rest[used] -= number * pattern[used]
                out.append((tuple(int(x) for x in np.repeat(own, pattern)[::-1]), number))
                placed = True
        left[here] = rest
        if not placed:
            if room >= min(MOST_ROOM, capacity):
                break
            room = 2 * room + 1
    return out, left


def best_fit(sequences: Sequences, lengths: np.ndarray, counts: np.ndarray, capacity: int) -> Sequences:
    """The sequences and those of the remaining counts, each piece in the fullest sequence with room for it."""
    by_room: dict[int, Sequences] = {}

    def put(inside: tuple[int, ...], number: int) -> None:
        if number:
            by_room.setdefault(capacity - sum(inside), []).append((inside, number))

    for inside, number in sequences:
        put(inside, number)
    for i in range(len(lengths) - 1, -1, -1):
        length, rest = int(lengths[i]), int(counts[i])
        while rest:
            room = min((r for r in by_room if r >= length), default=None)
            if room is None:
                each = capacity // length
                put((length,) * each, rest // each)
                put((length,) * (rest % each), 1 if rest % each else 0)
                break
            inside, number = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
            taken = min(number, rest)
            put(inside, number - taken)
            put((*inside, length), taken)
            rest -= taken
    return [x for group in by_room.values() for x in group]


@dataclass(frozen=True)
class Plan:
    """For each run of ranks within a length: first sequence, pieces per sequence, first offset."""

    length: np.ndarray
    first_rank: np.ndarray
    sequence: np.ndarray
    per_sequence: np.ndarray
    offset: np.ndarray
    sequences: int
    #: Pieces shorter than a sequence that patterns of the program have placed.
    by_pattern: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (self.length << 44) + self.first_rank
        run = np.searchsorted(key, (length << 44) + rank, "right") - 1
        turn, place = np.divmod(rank - self.first_rank[run], self.per_sequence[run])
        return self.sequence[run] + turn, self.offset[run] + place * length


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY, settings: tuple[tuple[float, float], ...] = SETTINGS) -> Plan:
    """The packing plan of a histogram length -> count."""
    lengths = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[int(x)] for x in lengths], np.int64)
    plans = []
    for step, near in settings:
        placed, left = place_patterns(lengths, counts, capacity, step, near)
        plans.append((best_fit(placed, lengths, left, capacity), int((counts - left)[lengths < capacity].sum())))
    plans.append((best_fit([], lengths, counts, capacity), 0))
    chosen, by_pattern = min(plans, key=lambda plan: sum(n for _, n in plan[0]))
    runs, sequences, seen = [], 0, dict.fromkeys(histogram, 0)
    for inside, number in chosen:
        offset = 0
        for length in sorted(set(inside), reverse=True):
            times = inside.count(length)
            runs.append((length, seen[length], sequences, times, offset))
            seen[length] += number * times
            offset += times * length
        sequences += number
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    return Plan(*table.T.copy(), sequences=sequences, by_pattern=by_pattern)


# --- placing ----------------------------------------------------------------------------------------


def _place(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
        sequence, offset = plan.place(length, rank)
        columns = [c for n, c in zip(batch.schema.names, batch.columns) if n != "rank"]
        names = [n for n in batch.schema.names if n != "rank"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])


def ranked(rows: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """Rows with their rank, from 0, among the rows of equal length."""
    spark = rows.sparkSession
    most = min(SLICE_ROWS, max(1_000, sum(histogram.values()) // SLICES))
    slices = [(length, math.ceil(n / most)) for length, n in histogram.items()]
    by_length = F.broadcast(spark.createDataFrame(slices, "length long, _slices long"))
    cut = rows.join(by_length, "length").withColumn("_slice", F.expr("pmod(xxhash64(id, piece), _slices)")).drop("_slices")
    before = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cut.groupBy("length", "_slice")
        .agg(F.count("*").alias("_n"))
        .select("length", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    number = F.row_number().over(Window.partitionBy("length", "_slice").orderBy("id", "piece"))
    return (
        cut.withColumn("_number", number.cast("long"))
        .join(F.broadcast(starts), ["length", "_slice"])  # at most 1,024 + SLICES + pieces / SLICE_ROWS rows
        .withColumn("rank", F.expr("_before + _number - 1"))
        .drop("_slice", "_number", "_before")
    )


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_column: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    ids: bool = False,
) -> DataFrame:
    """Every piece with its sequence and its place there."""
    cut = stored(pieces(docs, tokenizer, id_column, text, capacity, end_id, ids), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    plan = make_plan(histogram, capacity)
    rows = ranked(cut, histogram).select(*cut.columns, "rank")
    schema = PIECES + (", ids array<long>" if ids else "") + ", sequence_id long, offset long"
    return rows.mapInArrow(lambda batches: _place(batches, plan), schema).withColumnRenamed("id", id_column)
