import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from samples import crowded, frame, rows

from gridweave.llm import periodic_runs


def brute_runs(words: list) -> list[tuple[int, int, int]]:
    """(start, end, period) by trying every period at every word."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            part = words[start : i + q]
            if len(part) >= max(6, 4 * q) and not any(q % p == 0 and part[p:] == part[:-p] for p in range(1, q)):
                out.append((start, i + q, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(key, text) -> tuple:
    words = (text or "").encode().split()
    n = len(words)
    if key is not None and n and zlib.crc32(str(key).encode()) % 10 == 0:
        g = zlib.crc32(str(key).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = brute_runs(words)
    gone = {i for s, e, q in found for i in range(s + q, e)}
    s, e, q = min(found, key=lambda r: (r[0] - r[1], r[0], r[2])) if found else (None,) * 3
    return (
        key, len(found), s, e - s if found else None, q, 1000 * (e - s) // q if found else None,
        sha256("".join(f"{s},{e - s},{q}\n" for s, e, q in found).encode()).hexdigest(),
        sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


CONTRACT = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def order(row):
    return (row[0] is not None, row[0] or 0, row[-1])


@given(st.lists(st.lists(st.integers(0, 2), max_size=90), max_size=5), st.integers(0, 90), st.lists(st.integers(0, 2), min_size=1, max_size=20), st.integers(0, 120))
@settings(max_examples=300, deadline=None)
def test_runs_of_a_chunk(docs, at, root, length):
    docs = [*docs, (docs[0][:at] if docs else []) + (root * 120)[:length] + [1, 2]]
    sizes = [len(d) for d in docs]
    found = periodic_runs.runs(np.array([w for d in docs for w in d]), np.repeat(np.arange(len(docs)), sizes))
    starts = np.cumsum([0, *sizes])
    assert [tuple(r) for r in found.tolist()] == [(s + o, e + o, q) for d, o in zip(docs, starts.tolist()) for s, e, q in brute_runs(d)]


def test_grammar_derives_the_words():
    draw = random.Random(3)
    docs = [[draw.randrange(6) for _ in range(n)] * times for n, times in ((0, 1), (1, 1), (7, 30), (300, 2), (500, 1))]
    ids = np.array([w for d in docs for w in d])
    grammar = periodic_runs.repair(ids, np.repeat(np.arange(len(docs)), [len(d) for d in docs]))
    size = grammar.end - grammar.first
    assert len(grammar.rule) == len(ids) - sum(map(bool, docs))  # inner nodes of binary trees
    assert len(grammar.first) < len(grammar.rule)  # nonterminals are shared
    for rule, at in zip(grammar.rule.tolist(), grammar.at.tolist()):
        assert (ids[at : at + size[rule]] == ids[grammar.first[rule] : grammar.end[rule]]).all()


def test_chunks_do_not_change_the_result():
    draw = random.Random(9)
    docs = [[bytes([97 + draw.randrange(3)]) for _ in range(draw.randrange(60))] * draw.choice([1, 1, 5]) for _ in range(60)]
    whole = periodic_runs.chunk_rows(list(range(60)), docs, True).to_pylist()
    assert whole == [r for i, d in enumerate(docs) for r in periodic_runs.chunk_rows([i], [d], True).to_pylist()]


@pytest.mark.parametrize("text", ["a " * 400_000, "a\tb\n" * 200_000, "", " \r\n" * 100_000])
def test_long_texts(spark, text):
    r = periodic_runs.find(spark.createDataFrame([(5, text)], "doc_id long, text string"), with_text=True).first()
    q = len(set(text.split()))
    n = len(text.split())
    assert (r["n_runs"], r["length"], r["period"], r["collapsed"].split()) == ((1, n, q, text.split()[:q]) if n else (0, None, None, []))


def test_query_against_brute_force(spark, sf):
    from gridweave.llm.queries import op11_periodic_runs

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = {r["doc_id"]: tuple(r) for r in op11_periodic_runs(spark, sf).select(CONTRACT).collect()}
    assert len(found) == len(docs)
    for key, text in docs:
        if len((text or "").split()) <= 700 or zlib.crc32(str(key).encode()) % 10 == 0 and len(text.split()) < 3000:
            assert found[key] == brute_row(key, text)
    assert sum(r[1] for r in found.values()) > 5


def test_edge_cases(spark):
    extra = [(i, "x y z " * i, None, None, None) for i in range(1, 60)]
    data = [r for r in rows() if r[1] is None or len(r[1]) < 10_000] + extra
    found = periodic_runs.find(crowded(frame(spark, data)), prepare=periodic_runs.planted).select(CONTRACT).collect()
    assert sorted(map(tuple, found), key=order) == sorted((brute_row(r[0], r[1]) for r in data), key=order)
    assert periodic_runs.find(frame(spark, [])).count() == 0


def test_long_loop_is_one_run(spark):
    found = {r["doc_id"]: r for r in periodic_runs.find(frame(spark)).collect()}
    assert (found[9]["n_runs"], found[9]["start"], found[9]["length"], found[9]["period"]) == (1, 0, 15_000, 5)
    assert found[3]["n_runs"] == 0
    assert (found[6]["n_runs"], found[6]["period"]) == (1, 977 * 13)
