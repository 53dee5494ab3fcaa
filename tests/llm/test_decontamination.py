import random
import re

import pytest
from samples import LONG, crowded, frame, prose, rows

from gridweave.llm import decontamination

ITEMS = "item_id long, text string"


def brute_force(data, items):
    found = {}
    for item, text in items:
        words = re.findall(r"[^\W_]+", (text or "").lower())
        size = min(5, len(words))
        want = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()
        for i, doc, *_ in data:
            have = re.findall(r"[^\W_]+", (doc or "").lower())
            held = want & {tuple(have[j : j + size]) for j in range(len(have) - size + 1)}
            if want and len(held) >= 0.8 * len(want):
                found[i, item] = (len(want), len(held))
    return found


def table():
    draw = random.Random(8)
    items = [(i, prose(1_000 + i, draw.choice([1, 3, 5, 6, 14, 40, 70]), 5_000)) for i in range(60)]
    items += [(100, None), (101, " ... "), (102, items[4][1].upper()), (103, "word0x0 word1x1 word2x2 word3x3 word4x4 word5x5")]
    data = list(rows())
    for i in range(200):
        words = prose(i, 150, 5_000).split()
        _, text = items[draw.randrange(60)]
        copied = text.split()
        for _ in range(draw.choice([0, 0, 0, 1, 2, 4])):
            copied[draw.randrange(len(copied))] = "other"
        words[50:50] = copied
        data.append((1_000 + i, " ".join(words), None, None, None))
    return data, items


@pytest.mark.parametrize("block", [8_000_000, 2_000])
def test_leaks(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    data, items = table()
    found = decontamination.leaks(crowded(frame(spark, data)), spark.createDataFrame(items, ITEMS)).collect()
    want = brute_force(data, items)
    assert {(r["doc_id"], r["item_id"]): (r["item_shingles"], r["held"]) for r in found} == want
    assert any(held < total for total, held in want.values()) and LONG.startswith("word0x0")


@pytest.mark.parametrize("block", [8_000_000, 2_000])
def test_keep_clean(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    data, items = table()
    df = crowded(frame(spark, data))
    kept = decontamination.keep_clean(df, spark.createDataFrame(items, ITEMS))
    assert kept.columns == df.columns
    dirty = {i for i, _ in brute_force(data, items)}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, *_ in data if i not in dirty)


def test_documents(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute_force([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert {(r["doc_id"], r["item_id"]): (r["item_shingles"], r["held"]) for r in decontamination.leaks(docs, items).collect()} == want
    assert want


def test_empty(spark):
    items = spark.createDataFrame([(1, "a b c d e f")], ITEMS)
    assert decontamination.leaks(frame(spark, []), items).count() == 0
    assert decontamination.leaks(frame(spark), items.limit(0)).count() == 0
    assert decontamination.keep_clean(frame(spark), items.limit(0)).count() == len(rows())


def test_words_of_plain_and_other_texts():
    draw = random.Random(2)
    for alphabet in ("aZ09_ .-\n\x1f'", "aZ09_ .-\nÄßé中\xa0"):
        for _ in range(300):
            text = "".join(draw.choices(alphabet, k=40))
            assert decontamination.tokens(text) == re.findall(r"[^\W_]+", text.lower())
