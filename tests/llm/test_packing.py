import math
import random
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from samples import crowded, frame, rows
from tokenizers import Tokenizer

from gridweave.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(PATH)
    found.encode_special_tokens = True
    return found


def test_ids_are_those_of_tokenizers(tokenizer):
    encode, draw = packing.Encoder(PATH), random.Random(3)
    parts = ["a", "B", "é", " ", "  ", "\n", "\t", " \n", "'s", "'", "123", "ß", "　", "!", "中", "<|endoftext|>", "\xa0", "x", "ing", "😀", "\r"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 25))) for _ in range(3_000)] + ["ab" * 20_000]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_special_tokens_in_the_text_have_their_id(spark):
    plain, draw = Tokenizer.from_file(PATH), random.Random(4)
    parts = ["a", "B", "é", " ", "  ", "\n", "'s", "123", "!", "中", "<|endoftext|>", "<|endoftext|>", "<|endof", "text|>", "|>", "<"]
    texts = ["<|endoftext|>", "x <|endoftext|> y", *("".join(draw.choices(parts, k=draw.randint(0, 25))) for _ in range(500))]
    encode = packing.Encoder(PATH, special=True)
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text
    data = [(i, t, None, None, None) for i, t in enumerate(texts)]
    check(packing.pack(frame(spark, data), PATH, capacity=16).collect(), data, plain, 16)


def check(found, data, tokenizer, capacity):
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for inside in sequences.values():
        end = 0
        for offset, length in sorted(inside):
            assert offset == end
            end += length
        assert end <= capacity
    for i, text in {i: t for i, t, *_ in data}.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        pieces = {(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[i]}
        start = 0
        for piece, begin, length, crc in sorted(pieces):
            assert begin == start and (length == capacity or piece == 0)
            assert crc == zlib.crc32(np.array(ids[begin : begin + length], "<u4").tobytes())
            start += length
        assert start == len(ids) and [p[0] for p in sorted(pieces)] == list(range(len(pieces)))
        assert (len(pieces) > 1) == (len(ids) > capacity)
    return len(sequences)


@pytest.mark.parametrize("capacity", [16, 1024])
def test_pack(spark, tokenizer, capacity):
    found = packing.pack(crowded(frame(spark)), PATH, capacity=capacity).collect()
    used = check(found, rows(), tokenizer, capacity)
    assert used <= 1.01 * math.ceil(sum(r["length"] for r in found) / capacity) + 1


def test_ids_on_request(spark):
    for r in packing.pack(frame(spark, [(1, "some words", None, None, None)]), PATH, ids=True).collect():
        assert r["ids"][-1] == packing.END_ID and len(r["ids"]) == r["length"]


def test_empty(spark):
    assert packing.pack(frame(spark, []), PATH).count() == 0


def test_slices_of_a_length_rank_gaplessly(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLICE_ROWS", 7)
    data = [(i % 90, "a b c", None, None, None) for i in range(100)]
    found = packing.pack(frame(spark, data), PATH, capacity=10).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in found}) == 100
    assert len({r["sequence_id"] for r in found}) == 50


def brute_force(lengths, capacity):
    """Fewest bins for a few items."""
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= lengths[i]:
                place(i + 1, rooms[:j] + (rooms[j] - lengths[i],) + rooms[j + 1 :])
        place(i + 1, (*rooms, capacity - lengths[i]))

    place(0, ())
    return best


def test_plan_is_near_the_optimum():
    draw = random.Random(1)
    for _ in range(20):
        lengths = sorted((draw.randint(1, 20) for _ in range(9)), reverse=True)
        plan = packing.make_plan({x: lengths.count(x) for x in lengths}, 20)
        assert plan.sequences <= brute_force(lengths, 20) + 1


def test_program_beats_best_fit():
    """Best fit pairs 51 + 35 and so needs 30; the optimum takes 51 + 27 + 22 and 35 + 35 + 30."""
    histogram = {51: 12, 27: 12, 22: 12, 35: 24, 30: 12}
    plan = packing.make_plan(histogram, 100)
    assert plan.sequences == 24


def test_program_places_the_pieces():
    """Nearly all pieces come from patterns, and no more sequences are used than by best fit."""
    draw = random.Random(2)
    histogram = defaultdict(int)
    for _ in range(12_000):
        histogram[min(1024, 3 + int(draw.expovariate(1 / 250)))] += 1
    plan = packing.make_plan(dict(histogram))
    short = sum(n for x, n in histogram.items() if x < 1024)
    assert plan.by_pattern >= 0.9 * short
    alone = packing.make_plan(dict(histogram), settings=())
    assert alone.by_pattern == 0 and plan.sequences <= alone.sequences
    assert plan.sequences <= math.ceil(sum(x * n for x, n in histogram.items()) / 1024) + 2


def test_program_places_the_documents(spark, sf):
    docs = spark.read.parquet(f"{Path(sf).parent}/sf0.1/documents.parquet" if (Path(sf).parent / "sf0.1").is_dir() else f"{sf}/documents.parquet")
    histogram = {r["length"]: r["count"] for r in packing.pieces(docs, PATH).groupBy("length").count().collect()}
    plan = packing.make_plan(histogram)
    assert plan.by_pattern >= 0.9 * sum(n for x, n in histogram.items() if x < 1024)
    assert plan.sequences <= packing.make_plan(histogram, settings=()).sequences


def test_program_covers_the_histogram():
    lengths, counts = np.array([3, 5, 7, 10]), np.array([40, 30, 20, 1])
    solution = packing.solve_lp(lengths, counts, 10, 0.25, 0.5)
    assert all(p @ lengths <= 10 for p, _ in solution)
    assert (sum(p * amount for p, amount in solution) >= counts - 1e-9).all()
    # a lower bound of any covering, and what the last uncovered lengths may cost
    assert counts @ lengths / 10 <= sum(amount for _, amount in solution) <= 1.5 * (counts @ lengths) / 10


def test_knapsack_price():
    lengths, values = np.array([3, 5, 7]), np.array([3.0, 5.5, 7.0])
    best, pick = packing.knapsack(lengths, values, 10)
    assert best[10] == 11.0
    assert packing.pattern_through(1, lengths, pick, 10).tolist() == [0, 2, 0]
    assert packing.pattern_through(2, lengths, pick, 10).tolist() == [1, 0, 1]


LONG_RUNS = {
    "blanks": " " * 2_000_000,
    "line ends": "\n" * 1_000_000,
    "tabs inside": "a" + "\t" * 1_000_000 + "b",
    "mixed": "x" + " \n\t\u3000\xa0\u2028" * 200_000 + "word",
    "before a word and a special token": " " * 200_000 + "word " + "\n" * 20_000 + "<|endoftext|>" + " " * 9_999 + "x" + " " * 10_000 + "x",
    "at the end": "x" + "\r\n" * 100_000,
    "letters": "a" * 200_000,
    "marks": "!" * 200_000,
}


@pytest.mark.parametrize("name", LONG_RUNS)
def test_long_runs(name):
    encode, plain = packing.Encoder(PATH, special=True), Tokenizer.from_file(PATH)
    text = LONG_RUNS[name]
    assert np.array_equal(np.frombuffer(encode(text), "<u4"), plain.encode(text, add_special_tokens=False).ids)


def test_documents_of_blanks_are_packed(spark, tokenizer):
    data = [(i, text, None, None, None) for i, text in enumerate((" " * 1_500_000, "\n \n" * 100_000, "a b"))]
    check(packing.pack(frame(spark, data), PATH).collect(), data, tokenizer, 1024)
