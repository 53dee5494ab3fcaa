import random
from hashlib import sha256

import numpy as np
import pytest
from samples import crowded, frame, prose, rows

from gridweave.llm import substring_dedup


def brute_force(data):
    """id and text -> (words, removed, digest of the kept words)."""
    docs = sorted({(substring_dedup.NULL_ID if i is None else i, t or "") for i, t, *_ in data})
    first = {}
    split = [(i, t, t.encode().split()) for i, t in docs]
    for i, _, words in split:
        for s in range(len(words) - 19):
            key = tuple(words[s : s + 20])
            first[key] = min(first.get(key, (i, s)), (i, s))
    out = {}
    for i, t, words in split:
        dead = bytearray(len(words))
        for s in range(len(words) - 19):
            if first[tuple(words[s : s + 20])] < (i, s):
                dead[s : s + 20] = b"\1" * 20
        kept = b" ".join(w for w, d in zip(words, dead) if not d)
        out[None if i == substring_dedup.NULL_ID else i, t] = (len(words), sum(dead), sha256(kept).hexdigest())
    return out


def passages():
    draw = random.Random(6)
    shared = [prose(i, draw.choice([19, 20, 21, 35, 60, 200])) for i in range(12)]
    data = list(rows())
    for i in range(150):
        parts = [prose(10_000 + 10 * i + k, draw.randint(0, 40)) for k in range(4)]
        for k in (1, 3):
            words = draw.choice(shared).split()
            cut = draw.choice([0, 0, 5])
            parts.insert(k, " ".join(words[cut:]))
        data.append((1_000 + i, draw.choice([" ", "  ", "\n"]).join(parts), None, None, None))
    data += [(2_000 + i, "x y " * n, None, None, None) for i, n in enumerate((9, 10, 11, 12, 40))]
    return data


@pytest.mark.parametrize(("support", "shard_words", "batch"), [(0.001, 400_000, 10_000), (0.02, 60, 10_000), (0.002, 60, 7)])
def test_removed(spark, monkeypatch, support, shard_words, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    monkeypatch.setattr(substring_dedup, "SUPPORT", support)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", shard_words)
    data = passages()
    found = substring_dedup.remove_repeats(crowded(frame(spark, data)), with_text=True).collect()
    want = brute_force(data)
    assert len(found) == len(data)
    text = {i: t or "" for i, t, *_ in data}
    for r in found:
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"], text[r["doc_id"]]], r["doc_id"]
        assert sum(s["b"] - s["a"] for s in r["removed"]) == r["n_removed"]
        if r["kept_text"] is not None:
            assert sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)


def test_no_task_holds_a_frequent_line_in_many_surroundings(spark, monkeypatch):
    real = substring_dedup.repeats

    def bounded(group):
        assert sum(len(text.split()) for *_, text in group) <= 400
        return real(group)

    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 400)
    monkeypatch.setattr(substring_dedup, "repeats", bounded)
    line, longer = prose(1, 12), prose(2, 24)
    data = [(i, f"{prose(100 + i, 30)} {line} {prose(500 + i, 30)} {longer} {prose(900 + i % 7, 40)}", None, None, None) for i in range(200)]
    data += [(1_000, f"{line} " * 60, None, None, None), (1_001, f"{line} " * 60, None, None, None)]
    want = brute_force(data)
    found = substring_dedup.remove_repeats(frame(spark, data)).collect()
    assert {(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found} == {(i, *v) for (i, _), v in want.items()}
    assert len(found) == len(data)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {i: v for (i, _), v in brute_force([(r["doc_id"], r["text"]) for r in docs.collect()]).items()}
    found = substring_dedup.remove_repeats(docs).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found} == want


def test_empty(spark):
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_automaton_matches_by_search():
    draw = random.Random(9)
    for _ in range(40):
        sequences = [[draw.choice([b"a", b"b", b"c"]) for _ in range(draw.randint(0, 30))] for _ in range(5)]
        automaton = substring_dedup.Automaton()
        for key, words in enumerate(sequences):
            automaton.add(words, key, 0)
        automaton.finish()
        probe = [draw.choice([b"a", b"b", b"c"]) for _ in range(40)]
        want = {}
        for i in range(4, 41):
            places = [(key, e - 1) for key, words in enumerate(sequences) for e in range(4, len(words) + 1) if words[e - 4 : e] == probe[i - 4 : i]]
            if places:
                want[i - 1] = min(places)
        assert dict(automaton.earliest(probe, 4)) == want


@pytest.mark.parametrize("seed", range(30))
def test_meeting_does_not_depend_on_batches(monkeypatch, seed):
    """Representatives, repeats and shards of a sorted stream, whole and cut anywhere, against a plain count."""
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 70)
    draw = random.Random(seed)
    rows = []
    for _ in range(draw.randrange(1, 60)):
        h, same = draw.randrange(6), draw.randrange(3)
        loop = int((h, same) == (4, 1))
        rows.append((h, same, draw.randrange(5), (draw.randrange(9) << 32) | ((same + 1) << 1) | loop, 0))
    rows = sorted(set(rows))
    columns = [np.array(c, np.int64) for c in zip(*rows)]
    want = set()
    for h in {r[0] for r in rows}:
        group = [r for r in rows if r[0] == h]
        leads: dict[int, tuple] = {}
        for r in group:
            leads.setdefault(r[1], (r[2], r[3] >> 32))
        contested, words = len(leads) > 1 or any(r[3] & 1 for r in group), 0
        for r in group:
            start, n = r[3] >> 32, (r[3] >> 1) & 0x7FFFFFFF
            if (r[2], start) != leads[r[1]]:
                want.add((0, h, r[2], 0, start, start + n + 19, 0))
            elif contested:
                words += n + 19
                want.add((1, h, r[2], 0, start, n, words // 70))
    for cuts in ([], sorted(draw.sample(range(len(rows) + 1), min(4, len(rows)))), list(range(1, len(rows)))):
        meeting, got = substring_dedup.Meeting(), []
        for a, b in zip([0, *cuts], [*cuts, len(rows)]):
            if a < b:
                got += zip(*(c.tolist() for c in meeting.add(*(c[a:b] for c in columns))))
        # a representative that waited for the second one of its anchor comes with shard 0
        assert {r[:6] for r in got} == {r[:6] for r in want} and len(got) == len(want)
        assert {r[1] for r in got if r[6]} == {r[1] for r in want if r[6]}


def test_equal_passages_of_a_batch():
    one, two = (np.array([5, 5, 5, 7, 5], np.int64), np.array([1, 1, 1, 1, 2], np.int64))
    span = np.array([0 << 32 | 2, 4 << 32 | 2, 4 << 32 | 2, 0 << 32 | 2, 0 << 32 | 2])
    shipped, repeated = substring_dedup.settle(one, two, span, np.array([1, 1, 1, 2, 3]), np.array([9, 9, 9, 8, 7]))
    assert shipped.tolist() == [True, False, False, True, True] and repeated.tolist() == [False, True, True, False, False]
    # two rows of one document at one place, and of two documents that share an id
    place = np.array([2, 2, 2])
    shipped, repeated = substring_dedup.settle(place * 0, place * 0, place, np.array([1, 1, 1]), np.array([9, 9, 8]))
    assert shipped.tolist() == [True, False, True] and not repeated.any()
