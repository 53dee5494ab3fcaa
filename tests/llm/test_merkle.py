import random
import zlib
from hashlib import sha256

import pytest
from samples import SCHEMA, crowded, frame, rows

from gridweave.llm import merkle


def H(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf(i, source, lang, n_chars, text) -> str:
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n_chars, text)])


def tree(nodes: list[str], arity: int) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([H(*below[i : i + arity]) for i in range(0, len(below), arity)])
    return levels


def way(levels: list[list[str]], i: int, arity: int) -> list[tuple[list[str], list[str]]]:
    steps = []
    for level in levels[:-1]:
        first = i - i % arity
        steps.append((level[first:i], level[i + 1 : first + arity]))
        i //= arity
    return steps


def brute(data: list[tuple], arity: int) -> list[tuple]:
    """Ids, leaves, subroots, roots, proofs, folded roots; data are (doc_id, text, lang, source, n_chars)."""
    groups: dict = {}
    for i, text, lang, source, n in data:
        groups.setdefault(source, []).append((i, leaf(i, source, lang, n, text), lang, n, text))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for members in groups.values():
        members.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = [tree([r[1] for r in groups[s]], arity) for s in names]
    top = tree([t[-1][0] for t in trees], arity) if trees else []
    out = []
    for place, (source, levels) in enumerate(zip(names, trees)):
        for at, (i, own, lang, n, text) in enumerate(groups[source]):
            steps = way(levels, at, arity) + way(top, place, arity)
            if i is not None and zlib.crc32(str(i).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            found = leaf(i, source, lang, n, text)
            for left, right in steps:
                found = H(*left, found, *right)
            root = top[-1][0]
            out.append((i, own, levels[-1][0], root, H(*[h for left, right in steps for h in left + right]), found, found == root))
    return out


def same(found, wanted):
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted((tuple(r)[:7] for r in found), key=key) == sorted(wanted, key=key)


def corpus(seed: int, size: int) -> list[tuple]:
    """A source with half of the rows, some of a single row, nulls in every column, repeated rows and ids."""
    draw, data = random.Random(seed), []
    for i in range(size):
        source = draw.choice(["hot"] * 5 + ["a", "Z", "é", "", None]) if i > 3 else f"alone{i}"
        text = draw.choice([None, "", "one line", "two\nlines", "\n\n", f"text {i}\n"])
        data.append((draw.choice([i, i, i, None, 7]), text, draw.choice(["en", None]), source, draw.choice([None, i])))
    return data + data[:9] + [data[-1]] * 5


@pytest.mark.parametrize(("size", "arity"), [(1, 3), (28, 3), (90, 2), (60, 4)])
def test_against_brute_force(spark, size, arity):
    data = corpus(size, size)
    same(merkle.tamper_check(spark.createDataFrame(data, SCHEMA), arity=arity).collect(), brute(data, arity))


def test_edge_cases(spark):
    same(merkle.tamper_check(crowded(frame(spark))).collect(), brute(rows(), 3))
    assert merkle.tamper_check(frame(spark, [])).count() == 0


def test_positions_without_a_window_over_the_group(spark):
    data = [(i % 50, "x", "en", "one", None) for i in range(2000)]
    found = merkle.manifest(spark.createDataFrame(data, SCHEMA).repartition(7))
    assert sorted(r["position"] for r in found.collect()) == list(range(2000))


def test_every_bit_counts(spark):
    """A changed field of one row changes its group's subroot and the root, and no other subroot."""
    data = [(i, f"t{i}", "en", f"s{i % 3}", i) for i in range(30)]
    before = {r["doc_id"]: r for r in merkle.manifest(spark.createDataFrame(data, SCHEMA)).collect()}
    data[4] = (4, "t4", "fr", "s1", 4)
    after = {r["doc_id"]: r for r in merkle.manifest(spark.createDataFrame(data, SCHEMA)).collect()}
    for i in range(30):
        assert (before[i]["leaf"] == after[i]["leaf"]) == (i != 4)
        assert (before[i]["subroot"] == after[i]["subroot"]) == (i % 3 != 1)
        assert before[i]["root"] != after[i]["root"]
