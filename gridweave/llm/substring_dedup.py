"""Substring dedup with suffix automata over shards of repeated passages.

A window is ``WINDOW`` consecutive words of one document. A window whose words also start earlier (smaller
id, or same document and earlier start) is a repeat, and every word under a repeat is removed; overlapping
repeats make one maximal span. Windows are judged on the input.

1. One pass over the texts files every window under its anchor, the smallest hash of the runs of ``ANCHOR``
   words inside it. Equal windows have equal anchors, and neighbouring windows mostly share one: such a run
   of windows is a passage. Passages of one Arrow batch that are equal are settled at once: all but the first
   are repeats as a whole, so a passage that a third of all documents hold leaves one row for each batch. The
   pass also writes the words compressed, for later, and the anchors that are frequent in the batch.
2. The other passages meet by anchor, in order of words and place, in a stream that holds one row of state.
   The first of equal passages represents them, all later ones are repeats as a whole. Anchors with one
   representative that does not repeat itself have nothing left to compare.
3. The other representatives are the reference. Their words are fetched and dealt into shards by anchor, a
   shard gets a suffix automaton over words in which each state knows the earliest place of its string, and
   passages are streamed through it. Where the matching statistics reach ``WINDOW`` words, the state of the
   last ``WINDOW`` words tells where the window starts first.

The reference is as large as the repeated part of the corpus and has no size bound, so the automata are
not sent to every task: a passage is streamed through the automaton that holds its anchor, and no other can
hold its windows. An anchor with a share of ``SUPPORT`` of all passages (at most 1 / ``SUPPORT`` of these are
broadcast), or whose different passages have more than ``SHARD_WORDS`` words, such as one of a frequent line
in many surroundings, gets no automaton: its windows are filed one by one under their own hash, the earliest
place of each is aggregated before the shuffle, and no task holds the anchor.

Passages count as equal when their anchor, length and a further 64-bit hash of their words agree, and windows
of frequent anchors when anchor and a 64-bit hash agree; the words themselves are compared by the automata only.

Null text counts as no words. Rows that repeat both id and text are the same document; rows that share an
id only are ordered by start. A null id comes before all others. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.common import by_value, stored, text_or_empty

by_value(__name__)

WINDOW, ANCHOR = 20, 8
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
KNOWN_WORDS = 300_000
#: Share of all passages from which an anchor is surely found frequent.
SUPPORT = 0.001
#: Words in one automaton; anchors with more are filed by window.
SHARD_WORDS = 400_000
NULL_ID = -(1 << 63)


def words_of(text: pa.BinaryScalar | pa.StringScalar) -> list[bytes]:
    """Words between blanks, tabs and line ends; splitting bytes knows exactly these six characters."""
    return text.as_buffer().to_pybytes().split() if text.is_valid else []


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def window_anchors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of every window of words with these hashes, and the hashes that more than one run has."""
    count = len(hashes) - WINDOW + 1
    if count <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    runs = np.zeros(len(hashes) - ANCHOR + 1, np.uint64)
    for i in range(ANCHOR):
        runs *= MULTIPLIER
        runs += hashes[i : i + len(runs)]
    ordered = np.sort(runs)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    # minimum over the runs of a window, by doubling the reach
    reach, wanted = 1, WINDOW - ANCHOR + 1
    while 2 * reach <= wanted:
        runs = np.minimum(runs[:-reach], runs[reach:])
        reach *= 2
    return np.minimum(runs[:count], runs[wanted - reach : wanted - reach + count]), again


def passages(anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of each run of equal anchors."""
    starts = np.concatenate([[0], np.flatnonzero(anchors[1:] != anchors[:-1]) + 1]) if len(anchors) else np.empty(0, np.int64)
    return starts, np.diff(np.append(starts, len(anchors)))


def passage_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the words in every [start, end), from prefix sums of a polynomial modulo 2 ** 64."""
    powers, inverse = powers_of(len(hashes) + 1)
    mixed = hashes ^ (hashes >> np.uint64(31))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed * powers[: len(mixed)], dtype=np.uint64)])
    return (sums[ends] - sums[starts]) * inverse[starts]


POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}
BASE = 0xD6E8FEB86659FD93


def powers_of(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``BASE`` and of its inverse modulo 2 ** 64, at least so many."""
    if "all" not in POWERS or len(POWERS["all"][0]) < count:
        found = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            steps = np.full(2 * count, base, np.uint64)
            steps[0] = 1
            found.append(np.cumprod(steps, dtype=np.uint64))
        POWERS["all"] = (found[0], found[1])
    return POWERS["all"]


def loops(part: list[bytes]) -> bool:
    """Whether a window of the passage occurs in it twice."""
    windows = len(part) - WINDOW + 1
    # the words of the second window have all been seen before
    if windows == 1 or len(set(part)) > len(part) - WINDOW:
        return False
    return len({tuple(part[i : i + WINDOW]) for i in range(windows)}) < windows


def signed_hash(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw) - (1 << 63)


#: A passage in one number: first word, number of windows, whether a window repeats inside.
LOOP_BIT, WINDOW_BITS = 1, 31


def filed(words: list[bytes], known: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, hash, packed place) of every passage of one document."""
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    anchors, again = window_anchors(hashes)
    starts, counts = passages(anchors)
    own = anchors[starts]
    same = passage_hashes(hashes, starts, starts + counts + WINDOW - 1)
    looped = np.zeros(len(starts), np.int64)
    if len(again):
        for i in np.flatnonzero(np.isin(own, again) & (counts > 1)):
            looped[i] = loops(words[starts[i] : starts[i] + counts[i] + WINDOW - 1])
    return own.view(np.int64), same.view(np.int64), (starts << (WINDOW_BITS + 1)) | (counts << 1) | looped


def first_word(span: np.ndarray) -> np.ndarray:
    return span >> (WINDOW_BITS + 1)


def windows_in(span: np.ndarray) -> np.ndarray:
    return (span >> 1) & ((1 << WINDOW_BITS) - 1)


def settle(h: np.ndarray, same: np.ndarray, span: np.ndarray, key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shipped, repeated): which passages of a batch stay in play, and which repeat an earlier one as a whole.

    Rows come in the order of their places. One of several rows at one place of one document is enough.
    """
    order = np.argsort(h ^ (same * np.int64(0x9E3779B97F4A7C1)), kind="stable")
    a, b = order[1:], order[:-1]
    fresh = np.concatenate([[True], (h[a] != h[b]) | (same[a] != same[b]) | (windows_in(span[a]) != windows_in(span[b]))]) if len(h) else np.zeros(0, bool)
    lead = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))] if len(h) else order
    later = (key[order] != key[lead]) | (first_word(span[order]) != first_word(span[lead]))
    shipped, repeated = np.zeros(len(h), bool), np.zeros(len(h), bool)
    repeated[order] = later
    shipped[order] = ~later & (fresh | (doc[order] != doc[lead]))
    return shipped, repeated


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Sorted spans (first word, end) that touch, joined."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


PASSAGE = pa.struct([("h", pa.int64()), ("same", pa.int64()), ("span", pa.int64())])
SPAN = pa.struct([("a", pa.int64()), ("b", pa.int64())])
HOT = pa.struct([("h", pa.int64()), ("n", pa.int64())])
FILED = (
    "_id long, doc long, packed binary, n_words long, kept_sha256 string, n_passages long, passages array<struct<h: long, same: long, span: long>>, "
    "early array<struct<a: long, b: long>>, hot array<struct<h: long, n: long>>"
)


def lists(values: pa.StructArray, owner: np.ndarray, rows: int) -> pa.ListArray:
    """One list for each of ``rows`` owners; ``owner`` does not decrease."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        keys = batch.column("_id").to_numpy(zero_copy_only=False)
        texts = batch.column("_text")
        copies: dict[bytes, tuple] = {}  # copies inside a batch are read once
        found = []
        order = np.argsort(keys, kind="stable")
        for row in order:
            words = words_of(texts[int(row)])
            raw = b" ".join(words)
            if raw not in copies:
                copies[raw] = (signed_hash(raw), squeeze(raw), len(words), sha256(raw).hexdigest(), *filed(words, known))
            found.append(copies[raw])
        if not found:
            continue
        keys = keys[order]
        owner = np.repeat(np.arange(len(found)), [len(f[4]) for f in found])
        h, same, span = (np.concatenate([f[i] for f in found]) for i in (4, 5, 6))
        doc = np.array([f[0] for f in found], np.int64)
        shipped, repeated = settle(h, same, span, keys[owner], doc[owner])
        early: list[list[tuple[int, int]]] = [[] for _ in found]
        for i, a, n in zip(owner[repeated].tolist(), first_word(span[repeated]).tolist(), windows_in(span[repeated]).tolist()):
            early[i].append((a, a + n + WINDOW - 1))
        anchors, times = np.unique(h[shipped], return_counts=True)
        often = times >= SUPPORT * shipped.sum()
        hot = lists(pa.StructArray.from_arrays([pa.array(anchors[often]), pa.array(times[often])], ["h", "n"]), np.zeros(often.sum(), np.int64), len(found))
        kept = pa.StructArray.from_arrays([pa.array(x[shipped]) for x in (h, same, span)], ["h", "same", "span"])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(keys), pa.array(doc), pa.array([f[1] for f in found], pa.binary()), pa.array([f[2] for f in found], pa.int64()),
                pa.array([f[3] for f in found], pa.string()), pa.array(np.bincount(owner[shipped], minlength=len(found))),
                lists(kept, owner[shipped], len(found)),
                pa.array([[{"a": a, "b": b} for a, b in merged(e)] for e in early], pa.list_(SPAN)), hot,
            ],
            names=["_id", "doc", "packed", "n_words", "kept_sha256", "n_passages", "passages", "early", "hot"],
        )


def opened(packed: pa.BinaryScalar) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed.as_buffer())


#: kind 0: the words [start, n) are repeated; kind 1: a representative of ``n`` windows.
MET = "kind int, h long, _id long, doc long, start long, n long, shard long"


class Meeting:
    """Passages in order of anchor, words and place, one Arrow batch after the other.

    What is carried between batches: the last anchor and hash with the place of its first row, how many words
    the representatives of the anchor have so far, whether it is contested, and its only representative.
    """

    def __init__(self) -> None:
        self.last: tuple | None = None  # anchor, hash, windows, id and first word of the first row
        self.words, self.contested, self.pending = 0, False, None

    def add(self, h: np.ndarray, same: np.ndarray, key: np.ndarray, span: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
        """Columns of MET."""
        start, n = first_word(span), windows_in(span)
        size, carried = len(h), self.last
        anchor_new, text_new = np.ones(size, bool), np.ones(size, bool)
        anchor_new[1:] = h[1:] != h[:-1]
        text_new[1:] = anchor_new[1:] | (same[1:] != same[:-1]) | (n[1:] != n[:-1])
        if carried is not None:
            anchor_new[0] = h[0] != carried[0]
            text_new[0] = anchor_new[0] or same[0] != carried[1] or n[0] != carried[2]
        at = np.maximum.accumulate(np.where(text_new, np.arange(size), -1))
        lead_key, lead_start = key[at], start[at]
        if carried is not None:
            lead_key, lead_start = np.where(at < 0, carried[3], lead_key), np.where(at < 0, carried[4], lead_start)
        later = (key != lead_key) | (start != lead_start)
        # groups of one anchor; number 0 goes on from the last batch
        group = np.cumsum(anchor_new)
        groups = int(group[-1]) + 1
        different = np.bincount(group[text_new], minlength=groups)
        contested = np.bincount(group, weights=span & LOOP_BIT, minlength=groups) > 0
        if carried is not None:
            different[0] += 1
            contested[0] |= self.contested
        contested |= different > 1
        size_of = np.where(text_new, n + WINDOW - 1, 0)
        run = np.cumsum(size_of)
        base = np.concatenate([[0], run])[np.searchsorted(group, np.arange(groups))]  # words before the group
        words = run - base[group] + np.where(group == 0, self.words, 0)
        speaks = ~later & contested[group]
        out = [
            np.concatenate([np.zeros(later.sum(), np.int32), np.ones(speaks.sum(), np.int32)]),
            *[np.concatenate([x[later], x[speaks]]) for x in (h, key, doc, start)],
            np.concatenate([start[later] + n[later] + WINDOW - 1, n[speaks]]),
            np.concatenate([np.zeros(later.sum(), np.int64), words[speaks] // SHARD_WORDS]),
        ]
        if self.pending is not None and contested[0]:
            out = [np.append(column, value) for column, value in zip(out, self.pending)]
            self.pending = None
        final = groups - 1
        if final > 0:
            self.pending = None
            if not contested[final]:
                i = int(np.flatnonzero(anchor_new)[-1])
                self.pending = (1, h[i], key[i], doc[i], start[i], n[i], 0)
        self.words = int(words[-1])
        self.contested = bool(contested[final])
        i = int(at[-1])
        self.last = (h[-1], same[-1], n[-1], key[i], start[i]) if i >= 0 else carried
        return out


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    meeting = Meeting()
    for batch in batches:
        if batch.num_rows:
            columns = meeting.add(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "same", "_id", "span", "doc")))
            types = [pa.int32(), *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["kind", "h", "_id", "doc", "start", "n", "shard"])


REFERENCE = "h long, _id long, doc long, start long, text binary"


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the wanted passages of each document."""
    types = [*[pa.int64()] * 4, pa.binary()]
    for batch in batches:
        rows: list[tuple] = []
        for key, doc, packed, wanted in zip(*(batch.column(c).to_pylist() for c in ("_id", "doc", "packed", "wanted"))):
            words = zstandard.ZstdDecompressor().decompress(packed).split()
            for p in wanted:
                rows.append((p["h"], key, doc, p["start"], b" ".join(words[p["start"] : p["start"] + p["n"] + WINDOW - 1])))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types)], names=["h", "_id", "doc", "start", "text"])


WINDOWS = "h long, same long, _id long, doc long, start long, later boolean"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the wanted passages of each document. Of equal windows in one batch only the first is
    not yet known to be later than another."""
    for batch in batches:
        rows: list[tuple] = []
        for key, doc, packed, wanted in zip(*(batch.column(c).to_pylist() for c in ("_id", "doc", "packed", "wanted"))):
            words = zstandard.ZstdDecompressor().decompress(packed).split()
            rows += [(p["h"], signed_hash(b" ".join(words[i : i + WINDOW])), key, doc, i) for p in wanted for i in range(p["start"], p["start"] + p["n"])]
        first: dict[tuple[int, int], tuple[int, int]] = {}
        for h, same, key, _, i in rows:
            first[h, same] = min(first.get((h, same), (key, i)), (key, i))
        later = [(key, i) != first[h, same] for h, same, key, _, i in rows]
        columns = zip(*rows) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], pa.array(later, pa.bool_())], names=["h", "same", "_id", "doc", "start", "later"])


def repeated_windows(texts: DataFrame, by_doc: DataFrame) -> DataFrame:
    """SPANS of the windows of the wanted passages that start earlier with the same anchor."""
    windows = stored(texts.join(by_doc, ["_id", "doc"]).mapInArrow(_windows, WINDOWS), "windows")
    open_ = windows.where("NOT later")  # one row for each different window and batch
    firsts = open_.groupBy("h", "same").agg(F.min(F.struct("_id", "start")).alias("f"), F.count("*").alias("n")).where("n > 1")
    met = open_.join(firsts, ["h", "same"]).where(F.struct("_id", "start") != F.col("f"))
    late = windows.where("later").select("_id", "doc", "start").unionByName(met.select("_id", "doc", "start"))
    return late.select("_id", "doc", F.col("start").alias("a"), (F.col("start") + WINDOW).alias("b"))


class Automaton:
    """Suffix automaton of several word sequences; every state knows the earliest place of its string.

    A place is (id, number of the last word). Index 0 is the start state.
    """

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [None]

    def _state(self, following: dict[bytes, int], link: int, length: int, first) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def _split(self, state: int, word: bytes, target: int) -> int:
        """A state for the shorter strings of ``target`` that continue ``state``."""
        twin = self._state(dict(self.next[target]), self.link[target], self.length[state] + 1, None)
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = twin
            state = self.link[state]
        self.link[target] = twin
        return twin

    def add(self, words: list[bytes], key: int, start: int) -> None:
        last = 0
        for offset, word in enumerate(words):
            place, target = (key, start + offset), self.next[last].get(word)
            if target is not None:
                last = target if self.length[target] == self.length[last] + 1 else self._split(last, word, target)
            else:
                fresh, state = self._state({}, 0, self.length[last] + 1, None), last
                while state >= 0 and word not in self.next[state]:
                    self.next[state][word] = fresh
                    state = self.link[state]
                if state >= 0:
                    target = self.next[state][word]
                    self.link[fresh] = target if self.length[target] == self.length[state] + 1 else self._split(state, word, target)
                last = fresh
            if self.first[last] is None or place < self.first[last]:
                self.first[last] = place

    def finish(self) -> None:
        """Earliest places go from longer strings to their suffixes."""
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            link, place = self.link[state], self.first[state]
            if link > 0 and (self.first[link] is None or place < self.first[link]):
                self.first[link] = place

    def earliest(self, words: list[bytes], window: int) -> Iterator[tuple[int, tuple[int, int]]]:
        """(last word, earliest place) of every window of ``words`` that occurs in the automaton."""
        state = matched = 0
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state, matched = self.next[state][word], matched + 1
            while matched >= window and self.length[self.link[state]] >= window:
                state = self.link[state]
                matched = self.length[state]
            if matched >= window:
                yield i, self.first[state]


def repeats(group: list[tuple[int, int, int, bytes]]) -> Iterator[tuple[int, int, int, int]]:
    """(id, doc, first word, end) of the spans that repeat earlier ones within the passages of one anchor."""
    split = [(key, doc, start, text.split()) for key, doc, start, text in group]
    automaton = Automaton()
    for key, _, start, words in split:
        automaton.add(words, key, start)
    automaton.finish()
    found = [[i for i, place in automaton.earliest(words, WINDOW) if place < (key, start + i)] for key, _, start, words in split]
    for mine, (key, doc, start, _) in zip(found, split):
        begin = end = None
        for i in mine:
            if end is not None and i - WINDOW + 1 <= end:
                end = i
                continue
            if end is not None:
                yield key, doc, start + begin, start + end + 1
            begin, end = i - WINDOW + 1, i
        if end is not None:
            yield key, doc, start + begin, start + end + 1


SPANS = "_id long, doc long, a long, b long"


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Representatives come sorted by anchor."""
    rows = (row for batch in batches for row in zip(*[batch.column(c).to_pylist() for c in ("h", "_id", "doc", "start", "text")]))
    out: list[tuple] = []
    for _, group in groupby(rows, key=lambda row: row[0]):
        out.extend(repeats([row[1:] for row in group]))
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["_id", "doc", "a", "b"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["_id", "doc", "a", "b"])


def _remove(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], [], [], []]
        columns = (batch.column(c).to_pylist() for c in ("_id", "n_words", "kept_sha256", "early", "spans"))
        for key, count, digest, early, later, packed in zip(*columns, batch.column("packed")):
            cuts = merged([(s["a"], s["b"]) for s in (*early, *(later or ()))])
            text = None
            if cuts:
                words, kept, end = opened(packed).split(), [], 0
                for a, b in cuts:
                    kept += words[end:a]
                    end = b
                left = b" ".join(kept + words[end:])
                digest, text = sha256(left).hexdigest(), left.decode() if with_text else None
            shown = [{"a": a, "b": b} for a, b in cuts]
            for column, value in zip(out, (key, count, sum(b - a for a, b in cuts), digest, shown, text)):
                column.append(value)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(SPAN), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["_id", "n_words", "n_removed", "kept_sha256", "removed", "kept_text"])


REMOVED = "_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<a: long, b: long>>, kept_text string"


def frequent(filed_rows: DataFrame) -> DataFrame:
    """Anchors with a share of ``SUPPORT`` of all passages, by the counts of the batches where they are frequent."""
    total = filed_rows.agg(F.sum("n_passages")).first()[0] or 0
    counts = filed_rows.selectExpr("inline(hot)").groupBy("h").agg(F.sum("n").alias("n"))
    return stored(counts.where(F.col("n") >= max(2.0, SUPPORT * total)).select("h"), "hot-anchors")


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept_sha256, removed spans (word numbers, end
    exclusive); ``kept_text`` on request, for documents that lose words."""
    rows = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NULL_ID)).alias("_id"), text_or_empty(text).alias("_text"))
    texts = stored(rows.mapInArrow(_file, FILED), "filed")
    every = texts.selectExpr("_id", "doc", "inline(passages)")
    hot = F.broadcast(frequent(texts))  # at most 1 / SUPPORT rows
    cold = every.join(hot, "h", "left_anti").repartition("h").sortWithinPartitions("h", "same", "_id", "span")
    met = stored(cold.mapInArrow(_meet, MET), "met")
    whole = met.where("kind = 0").select("_id", "doc", F.col("start").alias("a"), F.col("n").alias("b"))
    speaking = met.where("kind = 1")
    large = stored(speaking.where("shard > 0").select("h").distinct(), "large-anchors")

    def by_doc(rows: DataFrame) -> DataFrame:
        return rows.groupBy("_id", "doc").agg(F.collect_list(F.struct("h", "start", "n")).alias("wanted"))

    packed = texts.select("_id", "doc", "packed")
    reference = packed.join(by_doc(speaking.join(large, "h", "left_anti")), ["_id", "doc"]).mapInArrow(_fetch, REFERENCE)
    dealt = reference.repartition("h").sortWithinPartitions("h")
    # a passage of a frequent anchor as (h, start, n)
    place = f"shiftright(span, {WINDOW_BITS + 1}) AS start", f"shiftright(span, 1) & {(1 << WINDOW_BITS) - 1} AS n"
    by_window = every.join(hot, "h", "left_semi").selectExpr("_id", "doc", "h", *place)
    by_window = by_window.unionByName(speaking.join(large, "h", "left_semi").select("_id", "doc", "h", "start", "n"))
    found = whole.unionByName(dealt.mapInArrow(_stream, SPANS)).unionByName(repeated_windows(packed, by_doc(by_window)))
    spans = found.groupBy("_id", "doc").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    joined = texts.drop("passages", "hot", "n_passages").join(stored(spans, "spans"), ["_id", "doc"], "left")
    names = ["n_words", "n_removed", "kept_sha256", "removed", *(["kept_text"] if with_text else [])]
    return joined.mapInArrow(lambda batches: _remove(batches, with_text), REMOVED).select(F.nullif(F.col("_id"), F.lit(NULL_ID)).alias(id_column), *names)
