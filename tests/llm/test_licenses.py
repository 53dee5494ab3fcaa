import random
import re
from re import _parser

import pytest
from samples import crowded, frame, rows

from gridweave.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
COMPILED = [(n, r, re.compile(f"^{r.pattern}(?= |$)")) for n, r in enumerate(licenses.RULES)]


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_base(words):
    found = []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return sorted(found)


def brute_rules(words):
    """Every rule at every word, then containment by comparing all pairs."""
    found = []
    for i, word in enumerate(words):
        context = " ".join(words[i : i + licenses.REACH])
        for number, rule, pattern in COMPILED:
            if rule.anchor == word and (m := pattern.match(context)) and m[0]:
                found.append((i, i + len(m[0].split()), (rule.priority, -len(m[0].split()), number), rule.label))

    def first_at_word(d):
        return d[2] == min(e[2] for e in found if e[0] == d[0])

    left = [d for d in found if first_at_word(d)]
    inside = lambda d, e: (e[0] <= d[0] and e[1] >= d[1]) or (e[0] >= d[0] and e[1] <= d[1])
    return sorted((d[0], d[1] - d[0], d[3]) for d in left if not any(e[0] != d[0] and inside(d, e) and e[2] < d[2] for e in left))


def compare(found, text_of):
    for r in found:
        words = words_of(text_of[r["doc_id"]])
        base = brute_base(words)
        kept = brute_rules(words) if len(words) < 5_000 else None
        assert r["n_words"] == len(words)
        assert r["n_base"] == len(base)
        assert (r["first_word"], r["last_word"]) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in base}))
        if kept is not None:
            assert [(d["start"], d["words"], d["label"]) for d in r["detections"]] == kept, text_of[r["doc_id"]]
            assert r["labels"] == ",".join(sorted({x for _, x in base} | {x for *_, x in kept}))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(base or r["detections"])


def test_rules():
    assert len(licenses.RULES) >= 300
    for rule in licenses.RULES:
        assert re.match(rule.anchor, rule.pattern.replace("(?:", "")) or "(?:" in rule.pattern
        assert not set("'\\\"") & set(rule.pattern)


SENTENCES = [
    "This work is licensed under the GNU General Public License, version 3.",
    "Released under the MIT License.",
    "Licensed under CC BY-NC 4.0.",
    "Licensed under the Apache License, Version 2.0.",
    "GNU Lesser General Public License v2.1 or later",
    "the GNU GPL version 2 only",
    "SPDX-License-Identifier: GPL-3.0-or-later",
    "Creative Commons Attribution-ShareAlike 4.0",
    "https://creativecommons.org/licenses/by-sa/3.0/",
    "BSD 3-Clause License. Copyright (c) 2019 someone. All rights reserved.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "cc by cc by", "the license of the house", "in the public domain", "mit der Hand", "CC, by the way",
]


def test_against_brute_force(spark):
    draw = random.Random(3)
    vocabulary = sorted({w for r in licenses.RULES for w in re.findall("[a-z0-9]+", r.pattern)} | {"x", "the"})
    data = [(i, s, None, None, None) for i, s in enumerate(SENTENCES)]
    data += [(100 + i, " ".join(draw.choices(SENTENCES, k=5)), None, None, None) for i in range(60)]
    data += [(1_000 + i, " ".join(draw.choices(vocabulary, k=60)) + " license", None, None, None) for i in range(150)]
    found = licenses.report(frame(spark, data)).collect()
    assert len(found) == len(data)
    compare(found, {i: t for i, t, *_ in data})


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        (SENTENCES[0], "gpl,gpl-3.0"),
        (SENTENCES[1], "mit"),
        (SENTENCES[2], "cc-by,cc-by-nc-4.0"),
        (SENTENCES[3], "apache,apache-2.0"),
        (SENTENCES[4], "lgpl-2.1-or-later"),
        (SENTENCES[5], "gpl-2.0-only"),
        (SENTENCES[6], "gpl-3.0-or-later"),
        (SENTENCES[7], "cc-by-sa-4.0"),
        (SENTENCES[14], ""),
        ("nothing to see", ""),
    ],
)
def test_labels(spark, text, labels):
    assert licenses.report(frame(spark, [(1, text, None, None, None)])).first()["labels"] == labels


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = licenses.report(docs).collect()
    assert len(found) == docs.count()
    compare(found, {r["doc_id"]: r["text"] for r in docs.collect()})


def test_edge_cases(spark):
    found = licenses.report(crowded(frame(spark))).collect()
    assert len(found) == len(rows())
    compare(found, {i: t for i, t, *_ in rows()})
    assert licenses.report(frame(spark, [])).count() == 0


def test_many_detections_in_one_text(spark):
    text = "Released under the MIT License. " * 4_000
    r = licenses.report(frame(spark, [(1, text, None, None, None)])).first()
    assert (r["n_base"], r["last_word"], r["labels"], len(r["detections"])) == (4_000, 5 * 3_999 + 3, "mit", 4_000)


def test_plan_has_no_python(spark, sf):
    plan = licenses.report(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def spelled(tree, longest):
    """The shortest or the longest text of a parsed rule, at most eight repetitions."""
    out = ""
    for kind, value in tree:
        match str(kind):
            case "LITERAL":
                out += chr(value)
            case "NOT_LITERAL":
                out += "x"
            case "IN":
                first = value[0]
                out += "x" if str(first[0]) == "NEGATE" else chr(first[1][0] if str(first[0]) == "RANGE" else first[1])
            case "MAX_REPEAT":
                least, most, inner = value
                out += spelled(inner, longest) * (min(int(most), 8) if longest else least)
            case "SUBPATTERN":
                out += spelled(value[-1], longest)
            case "BRANCH":
                out += (max if longest else min)((spelled(b, longest) for b in value[1]), key=len)
            case _:
                raise ValueError(kind)
    return out


def test_each_rule_alone(spark):
    # a word of its own after the anchor, as everywhere in the texts
    texts = [spelled(_parser.parse(r.pattern.replace(" ?", " ")), longest) for r in licenses.RULES for longest in (False, True)]
    texts += [t.upper().replace(" ", "-") for t in texts] + list(licenses.BASE)
    assert all(brute_rules(words_of(t)) or brute_base(words_of(t)) for t in texts)
    found = licenses.report(frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])).collect()
    assert len(found) == len(texts)
    compare(found, dict(enumerate(texts)))


def test_gate_is_made_from_the_rules(spark):
    rule = licenses.Rule("acme", "acme(?: terms)? v?[0-9]", "acme", licenses.SPECIFIC)
    data = [(1, "see ACME terms 4", None, None, None), (2, "acme4", None, None, None), (3, "of House Rules", None, None, None)]
    found = licenses.scan(frame(spark, data), rules=(rule,), base={"house rules": "house"}).orderBy("doc_id").collect()
    assert [len(r["detections"]) for r in found] == [1, 0, 0]
    assert [len(r["base_places"]) for r in found] == [0, 0, 1]
