"""Benchmark decontamination: short test items found inside long documents.

Words are runs of letters and digits, case folded; a text's set holds its shingles of five consecutive
words (a shorter item is one shingle of all its words). A document leaks an item when it holds at least
``threshold`` of the item's distinct shingles.

Containment search with MinHash: the items are partitioned by the number of their shingles, and an item of
a class keeps as its sketch its ``k`` smallest shingle hashes, where k is one more than the number of
shingles that a leaking document may lack in that class. By counting, such a document holds at least one
of the k, however long it is, so testing the document's shingle hashes against the sketches finds every
leak. Candidates are verified by exact shingle containment on the words themselves.

Items are a reference set. They are taken in blocks of about ``BLOCK_BYTES`` of text at most; a block travels
with the tasks of one pass over the documents. Documents are not shuffled.

Null and wordless texts leak nothing and are never leaked. Repeated rows are reported each for itself, and
so are items of equal text. Empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import by_value, text_or_empty

by_value(__name__)

SHINGLE = 5
THRESHOLD = 0.8
BLOCK_BYTES = 8_000_000
TOKEN = re.compile(r"[^\W_]+")
#: Odd multiplier of the polynomial over word hashes, modulo 2 ** 64.
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Low bits of a hash that are looked up before the sketches are searched.
FILTER_BITS = 16
KNOWN_WORDS = 300_000


#: Of the ASCII characters only letters and digits belong to words.
ASCII_WORDS = "".join(chr(c) if chr(c).isalnum() else " " for c in range(128))


def tokens(text: str) -> list[str]:
    lower = text.lower()
    return lower.translate(ASCII_WORDS).split() if lower.isascii() else TOKEN.findall(lower)


class WordHashes(dict):
    """64-bit hash of a word, remembered; starts over when it grows too large."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def shingle_hashes(words: list[str], size: int, known: WordHashes) -> np.ndarray:
    """Hash of every shingle of ``size`` words, in order."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    return rolled(word_hashes(words, known), size)


def word_hashes(words: list[str], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    total = np.zeros(len(hashes) - size + 1, np.uint64)
    for i in range(size):
        total = total * MULTIPLIER + hashes[i : len(hashes) - size + 1 + i]
    return total


class Items:
    """Shingles and sketches of one block of items."""

    def __init__(self, items: list[tuple[int, str]], threshold: float):
        self.threshold = threshold
        self.ids, self.sizes, self.shingles = [], [], []
        known = WordHashes()
        owners: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item, text in items:
            words = tokens(text)
            if not words:
                continue
            size = min(SHINGLE, len(words))
            shingles = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
            number = len(self.ids)
            self.ids.append(item)
            self.sizes.append(size)
            self.shingles.append(shingles)
            by_hash = sorted({int(h) for h in shingle_hashes(words, size, known)})
            for h in by_hash[: self.sketch_size(len(shingles))]:
                owners[size][h].append(number)
        self.owners = {size: dict(found) for size, found in owners.items()}
        self.hashes = {size: np.array(sorted(found), np.uint64) for size, found in self.owners.items()}
        self.filters = {}
        for size, hashes in self.hashes.items():
            low = np.zeros(1 << FILTER_BITS, bool)
            low[(hashes & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
            self.filters[size] = low

    def sketch_size(self, shingles: int) -> int:
        """Sketch length in the class of items with up to the next power of two shingles."""
        largest = 1 << (shingles - 1).bit_length()
        return largest - math.ceil(self.threshold * largest - 1e-9) + 1

    def found_in(self, words: list[str], known: WordHashes) -> list[tuple[int, int, int]]:
        """(item number, item shingles, shingles held) of every item that the words leak."""
        if not words:
            return []
        hashes = word_hashes(words, known)
        candidates: set[int] = set()
        for size, wanted in self.hashes.items():
            if len(words) < size:
                continue
            probes = rolled(hashes, size)
            probes = probes[self.filters[size][(probes & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)]]
            for h in np.intersect1d(probes, wanted):
                candidates.update(self.owners[size][int(h)])
        if not candidates:
            return []
        held: dict[int, set[tuple[str, ...]]] = {}
        out = []
        for number in sorted(candidates):
            size, shingles = self.sizes[number], self.shingles[number]
            if size not in held:
                held[size] = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
            common = len(shingles & held[size])
            if common >= self.threshold * len(shingles) - 1e-9:
                out.append((number, len(shingles), common))
        return out


def _search(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for key, text in zip(batch.column("_id").to_pylist(), batch.column("_text")):
            for number, total, common in items.found_in(tokens(text.as_py()), known):
                for column, value in zip(out, (key, items.ids[number], total, common)):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["_id", "item_id", "item_shingles", "held"])


def _clean(batches: Iterator[pa.RecordBatch], items: Items, text: str) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in batches:
        yield batch.filter(pa.array([not items.found_in(tokens(t.as_py() or ""), known) for t in batch.column(text)], pa.bool_()))


FOUND = "_id long, item_id long, item_shingles long, held long"


def blocks(benchmark: DataFrame, item_column: str, item_text: str, threshold: float) -> Iterator[Items]:
    """The items in blocks small enough to travel with a task; at least one block."""
    rows = benchmark.select(F.col(item_column).cast("long").alias("item"), text_or_empty(item_text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, math.ceil(2 * total / BLOCK_BYTES))  # hashing deals them unevenly, so half full on average
    for number in range(count):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == number).collect()
        yield Items([(r["item"], r["text"]) for r in part], threshold)


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row for every document and item it leaks: id, item_id, item_shingles, held, containment."""
    rows = docs.select(F.col(id_column).cast("long").alias("_id"), text_or_empty(text).alias("_text"))
    found = None
    for items in blocks(benchmark, item_column, item_text, threshold):
        one = rows.mapInArrow(lambda batches, items=items: _search(batches, items), FOUND)
        found = one if found is None else found.unionByName(one)
    return found.select(
        F.col("_id").alias(id_column),
        F.col("item_id").alias(item_column),
        "item_shingles",
        "held",
        (F.col("held") / F.col("item_shingles")).alias("containment"),
    )


def keep_clean(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The rows of ``docs``, all columns, that leak no item; each row is judged by its own text."""
    for items in blocks(benchmark, item_column, item_text, threshold):
        docs = docs.mapInArrow(lambda batches, items=items: _clean(batches, items, text), docs.schema)
    return docs
