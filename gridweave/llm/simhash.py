"""Near-duplicate documents by SimHash and multi-index hashing.

A fingerprint has 64 bits; a bit is set when it is set in more than half of the XXH64 hashes (seed 42) of
the text's shingles, repeats included. Texts with fewer words than a shingle are one shingle; texts
without words have fingerprint zero. Fingerprints that differ in at most ``distance`` bits are linked, and
linked documents share a class.

Equal fingerprints are merged before anything is searched, so a group of copies costs one point. Points
are found by multi-index hashing: the 64 bits are cut into segments, every point is listed in one table
under each of its segments, and looks up a small Hamming ball around each. With ``distance`` = q * m + r
for m segments, two points within ``distance`` agree up to q bits in one of the first r + 1 segments or up
to q - 1 bits in a later one, so nothing is missed. Table matches are verified on all 64 bits inside the
join. The number of segments follows from the number of points, so that table lists stay short.

Links are made in rounds. In a round every class keeps one link, to the smallest class that one of its points
meets (a minimum taken before the exchange), so a dense group writes one row for each point and not its pairs;
the joined classes search again, and only for points of other classes, until none is found. At least half of
the classes that have a link go in every round.

Null text counts as empty. Repeated rows share a class. Rows without an id belong to the class of their
fingerprint; when all rows of a fingerprint lack one, it has no class and takes no links. An empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.common import WORD, by_value, lowered, stored, text_or_empty
from gridweave.llm.components import components

by_value(__name__)

BITS = 64
#: What it costs a probe to meet a point, in rows shuffled.
MEETING_COST = 0.02
#: Shingles whose bits are counted at a time.
SLICE = 65_536


def fingerprint(text: str, shingle: int) -> int:
    words = WORD.findall(lowered(text))
    if not words:
        return 0
    joined = " ".join(words).encode()
    ends = np.cumsum([len(w.encode()) for w in words]) + np.arange(len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(shingle, len(words))
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in spans], "<u8")
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), SLICE):
        part = hashes[i : i + SLICE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(text.as_py(), shingle) for text in batch.column("_text")]
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(found, pa.int64())], names=["_id", "_fp"])


def fingerprints(docs: DataFrame, id_column: str, text: str, shingle: int) -> DataFrame:
    rows = docs.select(F.col(id_column).cast("long").alias("_id"), text_or_empty(text).alias("_text"))
    return rows.mapInArrow(lambda batches: _fingerprints(batches, shingle), "_id long, _fp long")


def segment_plan(points: int, distance: int) -> list[tuple[int, int, int]]:
    """(shift, bits, radius) of every segment, for so many points.

    Of all numbers of segments the one with the least work is taken: every probe is a row to shuffle and
    meets as many points as share its segment by chance.
    """

    def layout(count: int) -> list[tuple[int, int, int]]:
        whole, rest = divmod(distance, count)
        plan, shift = [], 0
        for i in range(count):
            bits = BITS // count + (i < BITS % count)
            plan.append((shift, bits, whole if i <= rest else whole - 1))
            shift += bits
        return plan

    def work(plan: list[tuple[int, int, int]]) -> float:
        return sum(
            sum(math.comb(bits, r) for r in range(radius + 1)) * (1 + MEETING_COST * points / 2**bits) for _, bits, radius in plan
        )

    return min(map(layout, range(2, max(2, min(distance + 1, 8)) + 1)), key=work)


def ball(bits: int, radius: int) -> list[int]:
    """All patterns of at most ``radius`` changed bits."""
    return [sum(1 << b for b in chosen) for r in range(radius + 1) for chosen in combinations(range(bits), r)]


def links(points: DataFrame, distance: int, count: int) -> DataFrame:
    """(a, b): for every class a of ``points`` (_fp, _class) the smallest class b below it that one of its
    points comes within ``distance`` bits of."""
    plan = segment_plan(count, distance)

    def key(number: int, shift: int, bits: int) -> Column:
        """Segment number and bits in one number; at most 32 bits and 8 segments."""
        return F.shiftrightunsigned("_fp", shift).bitwiseAND((1 << bits) - 1) + (number << 32)

    def around(k: Column, radius_masks: list[int]) -> Column:
        """The key with every pattern of changed bits."""
        return F.transform(F.array(*map(F.lit, radius_masks)).cast("array<long>"), lambda mask: k.bitwiseXOR(mask))

    keys = [(key(i, shift, bits), ball(bits, radius)) for i, (shift, bits, radius) in enumerate(plan) if radius >= 0]
    listed = F.array(*[k for k, _ in keys])
    probes = F.concat(*[around(k, masks) for k, masks in keys])
    table = points.select(F.explode(listed).alias("_key"), F.col("_fp").alias("_fp2"), F.col("_class").alias("b"))
    probing = points.select(F.explode(probes).alias("_key"), "_fp", F.col("_class").alias("a"))
    differing = F.col("_fp").bitwiseXOR(F.col("_fp2"))
    # two points may meet in several segments; only the first of them counts
    first = F.lit(None).cast("long")
    for i, (shift, bits, radius) in reversed(list(enumerate(plan))):
        within = F.bit_count(F.shiftrightunsigned(differing, shift).bitwiseAND((1 << bits) - 1)) <= radius
        first = F.when(within, F.lit(i)).otherwise(first)
    near = (F.bit_count(differing) <= distance) & (F.col("a") != F.col("b")) & (F.col("_fp") < F.col("_fp2"))
    met = probing.join(table, (probing["_key"] == table["_key"]) & near & (F.shiftright(probing["_key"], 32) == first))
    return met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).groupBy("a").agg(F.min("b").alias("b"))


def classes(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint as 16 hexadecimal digits, component_id."""
    prints = stored(fingerprints(docs, id_column, text, shingle), "fingerprints")
    named = stored(prints.groupBy("_fp").agg(F.min("_id").alias("_class")), "points")
    count = named.count()
    while True:
        found = stored(links(named, distance, count), "links")
        if found.isEmpty():
            break
        joined = named.join(stored(components(found), "components"), F.col("_class") == F.col("node"), "left")
        named = stored(joined.select("_fp", F.coalesce("component", "_class").alias("_class")), "classes")
    return prints.join(named, "_fp", "left").select(
        F.col("_id").alias(id_column),
        F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
        F.col("_class").alias("component_id"),
    )


def keep_one(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 5, distance: int = 4) -> DataFrame:
    """The rows of ``docs``, all columns, one for each class: the one whose id is the class id.

    Rows that repeat this id and its text stay once; a row without an id forms no class and stays.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_column).cast("long").alias("_id"))
    found = classes(docs, id_column, text, shingle, distance).where(f"`{id_column}` = component_id")
    kept = rows.join(found.select(F.col(id_column).alias("_id")).distinct(), "_id", "left_semi")
    first = F.row_number().over(Window.partitionBy("_id").orderBy(F.xxhash64("_row")))
    alone = rows.where("_id IS NULL").select("_row.*")
    return kept.withColumn("_rank", first).where("_rank = 1").select("_row.*").unionByName(alone)
