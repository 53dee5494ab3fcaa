import random
import re

import numpy as np
import pytest
import xxhash
from samples import crowded, frame, prose, rows

from gridweave.llm import simhash
from gridweave.llm.components import components


def print_of(text, shingle):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_force(prints, distance):
    """id -> smallest id that it reaches."""
    ids = sorted(prints)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if (prints[i] ^ prints[j]).bit_count() <= distance and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def near_copies():
    draw, data = random.Random(2), []
    for group in range(12):
        words = prose(group, 120).split()
        for _ in range(8):
            data.append(" ".join(words))
            words[draw.randrange(len(words))] = f"changed{len(data)}"
    return [(i, t, "en", "s", len(t)) for i, t in enumerate(data)]


@pytest.mark.parametrize(("shingle", "distance"), [(4, 4), (5, 6)])
def test_classes(spark, shingle, distance):
    data = near_copies() + [(1_000 + i, t, *rest) for i, t, *rest in rows() if i is not None]
    prints = {i: print_of(t, shingle) for i, t, *_ in data}
    want = brute_force(prints, distance)
    found = simhash.classes(crowded(frame(spark, data)), shingle=shingle, distance=distance).collect()
    assert len(found) == len(data)
    assert {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in found} == {i: (prints[i], want[i]) for i in prints}
    assert len(set(want.values())) < len(prints)


def test_classes_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    prints = {r["doc_id"]: print_of(r["text"], 4) for r in docs.collect()}
    want = brute_force(prints, 4)
    assert {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.classes(docs).collect()} == {i: (prints[i], want[i]) for i in prints}


@pytest.mark.parametrize("points", [2, 5_000, 300_000, 10**7, 10**11])
@pytest.mark.parametrize("distance", [0, 1, 3, 4, 6, 9])
def test_segments_miss_nothing(points, distance):
    """Any pattern of changed bits stays within the ball of some segment."""
    plan, draw = simhash.segment_plan(points, distance), np.random.default_rng(points)
    assert sum(bits for _, bits, _ in plan) == 64 and all(bits <= 32 for _, bits, _ in plan)
    for _ in range(2_000):
        changed = draw.choice(64, distance, replace=False)
        assert any(((changed >= shift) & (changed < shift + bits)).sum() <= radius for shift, bits, radius in plan)


def test_dense_cluster_writes_one_row_a_point(spark, monkeypatch):
    """2,000 fingerprints within 4 bits of each other have two million pairs; links stay fewer than points."""
    draw, center = random.Random(5), 0x0123_4567_89AB_CDEF
    prints = {center ^ mask for mask in simhash.ball(64, 2)}
    prints = sorted(draw.sample(sorted(prints), 2_000)) + [draw.getrandbits(63) for _ in range(50)]
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    points = spark.createDataFrame([(p, i) for i, p in enumerate(signed)], "_fp long, _class long")
    written, count = [], len(prints)
    real = simhash.links

    def counted(*args):
        found = real(*args)
        written.append(found.count())
        return found

    monkeypatch.setattr(simhash, "links", counted)
    monkeypatch.setattr(simhash, "fingerprints", lambda *args: points.selectExpr("_class AS _id", "_fp"))
    found = {r["doc_id"]: r["component_id"] for r in simhash.classes(points).collect()}
    assert found == brute_force({i: p for i, p in enumerate(prints)}, 4)
    assert sum(written) <= count and written[-1] == 0


def test_rows_without_an_id(spark):
    data = [(None, "same words here now", "en", "s", 1), (3, "same words here now", "en", "s", 1), (None, "other text alone there", "en", "s", 1)]
    found = sorted((r["component_id"] or 0, r["doc_id"] or 0) for r in simhash.classes(frame(spark, data)).collect())
    assert found == [(0, 0), (3, 0), (3, 3)]


def test_ball():
    assert len(simhash.ball(16, 1)) == 17 and len(simhash.ball(21, 2)) == 1 + 21 + 210


def test_keep_one(spark):
    df = crowded(frame(spark))
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    found = [r["doc_id"] for r in kept.collect()]
    want = brute_force({i: print_of(t, 5) for i, t, *_ in rows() if i is not None}, 4)
    assert sorted(i for i in found if i is not None) == sorted(set(want.values()))
    assert found.count(None) == 1


def test_empty(spark):
    assert simhash.classes(frame(spark, [])).count() == 0
    assert simhash.keep_one(frame(spark, [])).count() == 0


def test_components(spark):
    """A long path, a star, a cycle and loops."""
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    found = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    want = {i: 0 for i in range(61)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200, 202: 200}
    assert {r["node"]: r["component"] for r in found} == want
    assert len(found) == len(want)
