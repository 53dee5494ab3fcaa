import random
from hashlib import sha256

import pytest
from samples import crowded, frame, rows

from gridweave.llm import exact_dedup
from gridweave.llm.common import lowered


def expected(data):
    """id -> (keep_id, size, digest), by brute force."""
    groups = {}
    for i, text, *_ in data:
        groups.setdefault(lowered(text or ""), []).append(i)
    out = {}
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        for i in ids:
            out[i] = (max(known, default=None), len(ids), sha256(text.encode()).hexdigest())
    return out


@pytest.mark.parametrize("support", [0.001, 0.2])
def test_memberships(spark, support):
    found = exact_dedup.memberships(crowded(frame(spark)), support=support).collect()
    want = expected(rows())
    assert len(found) == len(rows())
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["text_sha256"]) for r in found} == want
    kept = [r for r in found if r["kept"]]
    assert len(kept) == len({v[2] for v in want.values()})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_heavy_and_light_path_agree(spark):
    draw = random.Random(5)
    data = [(i, draw.choice(["a", "A", "b", f"t{i % 50}", f"u{i}"]), None, None, None) for i in range(2_000)]
    tables = [exact_dedup.memberships(frame(spark, data), support=s).orderBy("doc_id").collect() for s in (0.0005, 0.1, 0.9)]
    assert tables[0] == tables[1] == tables[2]
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["text_sha256"]) for r in tables[0]} == expected(data)


@pytest.mark.parametrize("support", [0.001, 0.2])
def test_keep_one(spark, support):
    df = crowded(frame(spark))
    kept = exact_dedup.keep_one(df, support=support)
    assert kept.columns == df.columns
    found = kept.collect()
    want = expected(rows())
    assert sorted(map(str, (r["doc_id"] for r in found))) == sorted(map(str, {v[0] for v in want.values()}))
    assert len(found) == len({v[2] for v in want.values()})


def test_empty(spark):
    assert exact_dedup.memberships(frame(spark, [])).count() == 0
    assert exact_dedup.keep_one(frame(spark, [])).count() == 0
