"""Periodic runs of words, found on a grammar of the texts.

A run is a stretch of consecutive words of one document with smallest period q (words q apart are equal),
at least ``max(LEAST, POWER * q)`` words long, that no neighbouring word extends. A word is redundant when a
run holds it after that run's first q words; the collapsed text leaves these out.

1. Re-Pair replaces repeated pairs of symbols by nonterminals, most frequent pairs first. It works in
   rounds over all documents of a chunk at once: in a round every occurrence whose pair is more frequent
   than the pairs that overlap it is replaced, as long as some pair is replaced twice. What is left of a
   document is halved into a balanced tree, so that every document ends as one nonterminal.
2. A run inside the expansion of a nonterminal X -> L R either lies inside L or R or crosses their boundary.
   Those that cross are computed once for each nonterminal, on one of its occurrences and cut off at its ends.
   A run of period q in [2^k, 2^(k+1)) that crosses the boundary holds a block of 2^(k+1) words beside or
   around the boundary that returns at distance q and no sooner, because 2^(k+1) words hold a whole root. So
   for each scale k four blocks give one candidate each. Hashes propose candidates; their extent and smallest
   period are then settled by comparing words.
3. The runs of a nonterminal are translated to all its positions in the derivation. Of intervals of equal
   period the maximal ones stay: an interval cut off at the end of a nonterminal lies inside the whole run,
   which the lowest nonterminal that covers it has found.

The result does not depend on the grammar or on the chunk: documents that share a chunk share nonterminals
and nothing else. A chunk has ``CHUNK_WORDS`` words, or one longer document.

Null text has no words. Texts without a run are returned as they are. Repeated rows are reported each for
itself, a null id is kept. An empty table gives an empty result. Long texts are processed whole, in memory in
proportion to their words.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import by_value

by_value(__name__)

LEAST, POWER = 6, 4
CHUNK_WORDS = 400_000
#: Pairs of a block and a shift that are compared at a time.
SLICE = 1 << 20
#: A round of replacements that shortens the chunk by less than this share is the last.
GAIN = 1 / 64
MIX_A, MIX_B, BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)

Words = list[bytes]


# --- grammar ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Grammar:
    """Nonterminals by one of their occurrences: first word, boundary of the halves, end; and all the
    positions (``at``) at which each ``rule`` stands in the derivation."""

    first: np.ndarray
    boundary: np.ndarray
    end: np.ndarray
    rule: np.ndarray
    at: np.ndarray


def joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def mixed(values: np.ndarray, salt: int) -> np.ndarray:
    """Scrambled 64-bit numbers."""
    x = (values.astype(np.uint64) + np.uint64(salt)) * MIX_A
    x ^= x >> np.uint64(29)
    x *= MIX_B
    return x ^ (x >> np.uint64(32))


def best_pairs(symbols: np.ndarray, doc: np.ndarray, salt: int) -> np.ndarray:
    """Left ends of pairs to replace: those that are more frequent than the pairs overlapping them.

    Frequencies are counted in a hash table; a collision can only change the order of replacements.
    """
    left, right = symbols[:-1], symbols[1:]
    usable = doc[:-1] == doc[1:]
    # of "aaaa" every other pair counts
    same = np.flatnonzero(usable & (left == right))
    if len(same):
        begins = np.concatenate([[True], np.diff(same) > 1])
        start = np.maximum.accumulate(np.where(begins, same, 0))
        usable[same[(same - start) % 2 == 1]] = False
    h = mixed(left * np.int64(0x1_0000_0001) ^ (right << np.int64(17)), salt)
    bits = max(10, int(2 * len(symbols)).bit_length())
    slot = (h >> np.uint64(64 - bits)).astype(np.int64)
    times = np.bincount(slot[usable], minlength=1 << bits)[slot]
    usable &= times > 1
    rank = np.where(usable, (times << 24) | (h & np.uint64(0xFFFFFF)).astype(np.int64), 0)
    wins = usable
    wins[1:] &= rank[1:] > rank[:-1]
    wins[:-1] &= rank[:-1] > rank[1:]
    return np.flatnonzero(wins)


def repair(ids: np.ndarray, doc: np.ndarray) -> Grammar:
    """Grammar of the word ids ``ids``; ``doc`` (not decreasing) is the document of each word."""
    symbols, at, end = ids.astype(np.int64), np.arange(len(ids)), np.arange(1, len(ids) + 1)
    fresh = int(ids.max()) + 1 if len(ids) else 0
    made: list[list[np.ndarray]] = [[], [], [], [], []]
    rules = 0

    def replace(chosen: np.ndarray, inverse: np.ndarray, first: np.ndarray) -> None:
        """Join the pairs at ``chosen``; ``inverse`` numbers them by content, ``first`` has one of each."""
        nonlocal symbols, at, end, doc, fresh, rules
        one = chosen[first]
        for column, values in zip(made, (at[one], at[one + 1], end[one + 1], rules + inverse, at[chosen])):
            column.append(values)
        symbols[chosen], end[chosen] = fresh + inverse, end[chosen + 1]
        fresh, rules = fresh + len(first), rules + len(first)
        keep = np.ones(len(symbols), bool)
        keep[chosen + 1] = False
        symbols, at, end, doc = symbols[keep], at[keep], end[keep], doc[keep]

    salt = 0
    while len(symbols) > 1:
        salt += 1
        chosen = best_pairs(symbols, doc, salt)
        _, first, inverse, count = np.unique(symbols[chosen] * fresh + symbols[chosen + 1], return_index=True, return_inverse=True, return_counts=True)
        again = count > 1
        if not again.any():
            break
        number = np.cumsum(again) - 1
        used = again[inverse]
        size = len(symbols)
        place = np.cumsum(used) - 1  # the first occurrence of a kept pair, among the kept ones
        replace(chosen[used], number[inverse[used]], place[first[again]])
        if size - len(symbols) < GAIN * size:
            break
    while True:
        opens = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.empty(0, bool)
        inside = np.arange(len(doc)) - np.maximum.accumulate(np.where(opens, np.arange(len(doc)), 0))
        chosen = np.flatnonzero((inside[:-1] % 2 == 0) & (doc[:-1] == doc[1:]))
        if not len(chosen):
            break
        each = np.arange(len(chosen))
        replace(chosen, each, each)
    return Grammar(*map(joined, made))


# --- runs across boundaries -------------------------------------------------------------------------


def back_distance(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Words back to the same word of the same document; the number of words where there is none."""
    size = len(ids)
    shift = size.bit_length()
    key = np.sort((ids.astype(np.int64) << shift) | np.arange(size))
    place, word = key & ((1 << shift) - 1), key >> shift
    out = np.full(size, size, np.int64)
    again = (word[1:] == word[:-1]) & (doc[place[1:]] == doc[place[:-1]])
    out[place[1:][again]] = (place[1:] - place[:-1])[again]
    return out


def stretches(hit: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end of the stretches of at least ``least`` consecutive positions in ``hit`` (ascending)."""
    if len(hit) < least:
        return hit[:0], hit[:0]
    cuts = np.flatnonzero(np.diff(hit) > 1)
    begin, end = hit[np.concatenate([[0], cuts + 1])], hit[np.concatenate([cuts, [len(hit) - 1]])] + 1
    long = end - begin >= least
    return begin[long], end[long]


def proposals(ids: np.ndarray, doc: np.ndarray, grammar: Grammar) -> Iterator[tuple[int, int, int]]:
    """(rule, period, first word of a block that returns one period later) worth a look."""
    size = grammar.end - grammar.first
    back = back_distance(ids, doc)
    powers = np.full(len(ids) + 1, BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(ids, 1) * powers[:-1], dtype=np.uint64)])

    rules = np.flatnonzero(size >= LEAST)
    near = np.flatnonzero(back < len(ids))
    scale = 1
    while len(rules):
        # all words of a run after its first root have an equal word less than 2 * scale back
        begin, end = stretches(near[back[near] < 2 * scale], max(3 * scale, LEAST - 1))
        if len(begin):
            b = grammar.boundary[rules]
            k = np.minimum(np.searchsorted(end, b, "right"), len(end) - 1)
            live = rules[(begin[k] - 2 * scale < b) & (b < end[k])]
            yield from returning(sums, powers, grammar, live, scale)
        scale *= 2
        rules = rules[size[rules] >= POWER * scale]


def returning(sums: np.ndarray, powers: np.ndarray, grammar: Grammar, rules: np.ndarray, scale: int) -> Iterator[tuple[int, int, int]]:
    """For four blocks of 2 * ``scale`` words at each boundary, the least shift in [scale, 2 * scale) at which
    the block stands again, forwards or backwards, inside the expansion."""
    width = 2 * scale
    shifts = np.arange(scale, width)
    step = max(1, SLICE // scale)
    for lead, forward in ((0, True), (scale, True), (scale, False), (width, False)):
        for i in range(0, len(rules), step):
            part = rules[i : i + step]
            block = grammar.boundary[part] - lead
            if forward:
                fits = (block >= grammar.first[part]) & (block + width + scale <= grammar.end[part])
            else:
                fits = (block - scale >= grammar.first[part]) & (block + width <= grammar.end[part])
            part, block = part[fits], block[fits]
            if not len(part):
                continue
            one = block[:, None] if forward else block[:, None] - shifts
            two = one + shifts
            inside = (two + width <= grammar.end[part][:, None]) if forward else (one >= grammar.first[part][:, None])
            one, two = np.where(inside, one, 0), np.where(inside, two, 0)
            last = len(sums) - 1
            a = (sums[np.minimum(one + width, last)] - sums[one]) * powers[shifts]
            equal = inside & (a == sums[np.minimum(two + width, last)] - sums[two])
            for row in np.flatnonzero(equal.any(axis=1)):
                found = int(equal[row].argmax())
                yield int(part[row]), int(shifts[found]), int(one[row, found])


def extent(ids: np.ndarray, low: int, high: int, begin: int, period: int) -> tuple[int, int]:
    """Longest stretch with this period inside [low, high) that starts at or before ``begin`` and goes on."""
    start, reach = begin, 16
    while start > low:
        to = max(low, start - reach)
        differ = np.flatnonzero(ids[to:start] != ids[to + period : start + period])
        if len(differ):
            start = to + int(differ[-1]) + 1
            break
        start, reach = to, 2 * reach
    end, reach = begin, 16
    while end + period < high:
        to = min(high - period, end + reach)
        differ = np.flatnonzero(ids[end:to] != ids[end + period : to + period])
        if len(differ):
            end += int(differ[0])
            break
        end, reach = to, 2 * reach
    return start, end + period


def prime_factors(n: int) -> list[int]:
    found, p = [], 2
    while p * p <= n:
        if n % p == 0:
            found.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return [*found, n] if n > 1 else found


def crossing_runs(ids: np.ndarray, doc: np.ndarray, grammar: Grammar) -> list[tuple[int, int, int, int]]:
    """(rule, first word and end relative to the expansion, period) of the runs across each boundary."""
    out, seen = [], set()
    for rule, period, begin in proposals(ids, doc, grammar):
        low, boundary, high = int(grammar.first[rule]), int(grammar.boundary[rule]), int(grammar.end[rule])
        start, end = extent(ids, low, high, begin, period)
        if not start < boundary < end or end - start < max(LEAST, POWER * period) or (rule, start, period) in seen:
            continue
        seen.add((rule, start, period))
        smaller = (period // r for r in prime_factors(period))
        if not any(np.array_equal(ids[start : end - p], ids[start + p : end]) for p in smaller):
            out.append((rule, start - low, end - low, period))
    return out


def runs(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """All runs of the documents as rows (start, end, period), ordered by start and period; places count
    through the whole chunk."""
    none = np.empty((0, 3), np.int64)
    if not len(ids):
        return none
    grammar = repair(ids, doc)
    found = crossing_runs(ids, doc, grammar)
    if not found:
        return none
    wanted = np.zeros(len(grammar.first), bool)
    wanted[[rule for rule, *_ in found]] = True
    hit = wanted[grammar.rule]
    rule, at = grammar.rule[hit], grammar.at[hit]
    order = np.argsort(rule, kind="stable")
    rule, at = rule[order], at[order]
    placed = []
    for number, start, end, period in found:
        a, b = np.searchsorted(rule, [number, number + 1])
        placed.append(np.stack([at[a:b] + start, at[a:b] + end, np.full(b - a, period)], axis=1))
    every = np.concatenate(placed)
    every = every[np.lexsort((-every[:, 1], every[:, 0], every[:, 2]))]
    # within a period, an interval that does not reach beyond the ones before it lies inside one of them
    reach = every[:, 2] * (len(ids) + 1) + every[:, 1]
    before = np.concatenate([[-1], np.maximum.accumulate(reach)[:-1]])
    every = every[reach > before]
    return every[np.lexsort((every[:, 2], every[:, 0]))]


# --- documents --------------------------------------------------------------------------------------


class Numbers(dict):
    """Word -> number, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


def summary(words: Words, found: np.ndarray, with_text: bool) -> tuple:
    """What is reported of a document with these runs (start, end, period)."""
    listed = [(int(s), int(e - s), int(q)) for s, e, q in found]
    kept = words
    if listed:
        redundant = np.zeros(len(words), bool)
        for start, length, period in listed:
            redundant[start + period : start + length] = True
        kept = [w for w, drop in zip(words, redundant) if not drop]
    best = min(listed, key=lambda r: (-r[1], r[0], r[2])) if listed else (None, None, None)
    text = b" ".join(kept)
    return (
        len(listed),
        *best,
        1000 * best[1] // best[2] if listed else None,
        sha256("".join(f"{s},{n},{q}\n" for s, n, q in listed).encode()).hexdigest(),
        sha256(text).hexdigest(),
        [{"start": s, "length": n, "period": q} for s, n, q in listed],
        text.decode("utf-8", "surrogatepass") if with_text else None,
    )


Prepare = Callable[[int | None, Words], Words]
RUNS = (
    "_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
    "collapsed_sha256 string, runs array<struct<start: long, length: long, period: long>>, collapsed string"
)
LISTED = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
TYPES = [*[pa.int64()] * 6, pa.string(), pa.string(), LISTED, pa.string()]
NAMES = ["_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed"]


def chunk_rows(keys: list[int | None], texts: list[Words], with_text: bool) -> pa.RecordBatch:
    numbers = Numbers()
    sizes = np.array([len(words) for words in texts], np.int64)
    ends = np.cumsum(sizes)
    ids = np.fromiter(map(numbers.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
    found = runs(ids, np.repeat(np.arange(len(texts)), sizes))
    cut = np.searchsorted(found[:, 0], np.concatenate([[0], ends]))
    rows = []
    for i, (key, words) in enumerate(zip(keys, texts)):
        own = found[cut[i] : cut[i + 1]] - np.array([ends[i] - sizes[i], ends[i] - sizes[i], 0])
        rows.append((key, *summary(words, own, with_text)))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names=NAMES)


def _find(batches: Iterator[pa.RecordBatch], prepare: Prepare | None, with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, texts, held = [], [], 0
        for key, text in zip(batch.column("_id").to_pylist(), batch.column("_text")):
            words = text.as_buffer().to_pybytes().split() if text.is_valid else []
            words = prepare(key, words) if prepare else words
            if held and held + len(words) > CHUNK_WORDS:
                yield chunk_rows(keys, texts, with_text)
                keys, texts, held = [], [], 0
            keys.append(key)
            texts.append(words)
            held += len(words)
        if keys:
            yield chunk_rows(keys, texts, with_text)


def find(docs: DataFrame, id_column: str = "doc_id", text: str = "text", prepare: Prepare | None = None, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_runs, the longest run (start, length, period, exponent_milli),
    runs_sha256, collapsed_sha256, ``runs`` themselves, and the collapsed text on request.

    ``prepare(id, words)`` may change the words before they are searched.
    """
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"))
    found = rows.mapInArrow(lambda batches: _find(batches, prepare, with_text), RUNS)
    return found.withColumnRenamed("_id", id_column) if with_text else found.drop("collapsed").withColumnRenamed("_id", id_column)


def planted(key: int | None, words: Words) -> Words:
    """The words with a periodic end for one id in ten: from a place on, the first p words repeat. A null id
    leaves them unchanged."""
    if key is None or not words:
        return words
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return words[:a] + (root * ((n - a) // len(root) + 1))[: n - a]
