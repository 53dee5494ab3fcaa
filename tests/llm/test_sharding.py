import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import crowded, frame, prose, rows

from gridweave.llm import sharding


def check(found, data, shards):
    text = {i: t or "" for i, t, *_ in data}
    slots, homes = defaultdict(list), defaultdict(set)
    for r in found:
        raw = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, crc32(raw), "bytes", None)
        slots[r["shard"]].append(r["slot"])
        homes[text[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for s in homes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(shards))


def smallest(sizes, shards):
    """Smallest capacity by trying candidates in order, filling greedily."""
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle, used, room = (low + high) // 2, 1, 0
        for s in sizes:
            if room + s > middle:
                used, room = used + 1, 0
            room += s
        low, high = (low, middle) if used <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize("cell_bits", [1, 4, 14])
@pytest.mark.parametrize("shards", [1, 3, 24])
def test_capacity_is_the_smallest(spark, monkeypatch, cell_bits, shards):
    monkeypatch.setattr(sharding, "CELL_BITS", cell_bits)
    draw = random.Random(4)
    data = [(i, prose(draw.randrange(200), draw.randint(0, 90)), None, None, None) for i in range(400)]
    docs = frame(spark, data)
    groups = sharding.sized(docs, "doc_id", "text").groupBy("_key").agg(F.sum("size").alias("_size"))
    layout = sharding.make_layout(groups, shards)
    sizes = [r["_size"] for r in groups.orderBy("_key").collect() if r["_key"] not in layout.alone]
    assert layout.capacity == smallest(sizes, shards - len(layout.alone))
    found = sharding.shard(docs, shards).collect()
    check(found, data, shards)
    load = defaultdict(int)
    for r in found:
        load[r["shard"]] += r["size"]
    assert max(v for s, v in load.items() if s < shards - len(layout.alone)) <= layout.capacity


def test_large_group_is_alone_and_others_even(spark):
    data = [(i, "the same text in a third of all rows", None, None, None) for i in range(500)]
    data += [(1_000 + i, prose(i, 6), None, None, None) for i in range(1_000)]
    found = sharding.shard(frame(spark, data), 12).collect()
    check(found, data, 12)
    load = defaultdict(int)
    for r in found:
        load[r["shard"]] += r["size"]
    others = sorted(load.values())[:-1]
    assert len(load) == 12 and others[-1] < 1.1 * others[0]


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = sharding.shard(docs).collect()
    check(found, [(r["doc_id"], r["text"]) for r in docs.collect()], 24)
    assert len(found) == docs.count()


def test_edge_cases(spark):
    found = sharding.shard(crowded(frame(spark)), 5).collect()
    assert len(found) == len(rows())
    check(found, rows(), 5)
    assert sharding.shard(frame(spark, [])).count() == 0


def test_greedy_bounds():
    ends, solid = np.cumsum([5, 5, 5]), np.ones(3, bool)
    assert sharding.greedy(ends, solid, 7, 3) == [5, 10, 15]
    assert sharding.greedy(ends, ~solid, 7, 3) == [7, 14, 15]
    assert sharding.greedy(ends, solid, 4, 3) == []
    assert sharding.smallest_capacity(ends, solid, 2) == 10
