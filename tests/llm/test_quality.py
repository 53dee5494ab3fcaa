import zlib
from pathlib import Path

import pytest
from samples import crowded, frame, rows

from gridweave.llm import quality

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def scored(spark, sf):
    folder = Path(sf).parent / "sf0.1"
    if not folder.is_dir():
        pytest.skip(f"no tables at {folder}")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    found = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    return docs, {r["doc_id"]: r["quality"] for r in labels.collect()}, found


def test_held_out_accuracy(scored):
    docs, labels, found = scored
    assert len(found) == docs.count()
    for i, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    tested = [(found[i], y) for i, y in labels.items() if found[i]["held_out"]]
    assert sum(r["predicted"] == y for r, y in tested) >= 0.97 * len(tested)
    good = [r["score"] for r, y in tested if y == 1]
    bad = [r["score"] for r, y in tested if y == 0]
    assert sum(g > b for g in good for b in bad) >= 0.97 * len(good) * len(bad)


def test_held_out_labels_are_not_used(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    a, b = (quality.classify(docs, x).orderBy("doc_id").collect() for x in (labels, turned))
    assert a == b


def test_paths_and_rules():
    printed = """DecisionTreeClassificationModel: depth=2
  If (feature 0 <= 1.5)
   If (feature 2 <= 0.25)
    Predict: 0.0
   Else (feature 2 > 0.25)
    Predict: 1.0
  Else (feature 0 > 1.5)
   Predict: 1.0"""
    low, high = (0, "<=", 1.5), (0, ">", 1.5)
    assert quality.tree_paths(printed) == [(low,), (low, (2, "<=", 0.25)), (low, (2, ">", 0.25)), (high,)]
    assert quality.simplified(((0, "<=", 3.0), (1, ">", 0.0), (0, "<=", 1.0))) == ((0, "<=", 1.0), (1, ">", 0.0))


def test_rule_column(spark):
    values = [0.0] * len(quality.STATISTICS)
    values[0], values[2] = 1.0, 0.5
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{s} double" for s in quality.STATISTICS))
    yes, no = ((0, "<=", 1.5), (2, ">", 0.25)), ((0, "<=", 0.5),)
    assert tuple(df.select(quality.rule_column(yes), quality.rule_column(no)).first()) == (1.0, 0.0)
    ensemble = quality.RuleEnsemble(((yes, 2.0), (no, 5.0)), -2.0)
    assert df.select(ensemble.score()).first()[0] == pytest.approx(0.5)


def test_statistics():
    named = dict(zip(quality.STATISTICS, quality.statistics("The the The\nA | b!!".encode())))
    assert named["digit"] == 0 and named["table"] == pytest.approx(1 / 19) and named["distinct"] == pytest.approx(5 / 6)
    assert named["marked"] == pytest.approx(2 / 6) and named["repeated_lines"] == 0
    assert quality.statistics(b" \n") == quality.statistics(b"") == [0.0] * len(quality.STATISTICS)


@pytest.mark.parametrize(("labels", "score"), [([], 0.5), ([(1, 1, 0), (2, 1, 0), (8, 1, 0)], 1.0), ([(1, None, 0)], 0.5)])
def test_nothing_to_learn(spark, labels, score):
    found = quality.classify(crowded(frame(spark)), spark.createDataFrame(labels, LABELS)).collect()
    assert len(found) == len(rows())
    assert {r["score"] for r in found} == {score}


def test_edge_cases(spark):
    labels = [(i, int(i < 100), 0) for i, *_ in rows() if i is not None]
    found = quality.classify(frame(spark), spark.createDataFrame(labels, LABELS)).collect()
    assert len(found) == len(rows()) and all(0 <= r["score"] <= 1 for r in found)
    assert quality.classify(frame(spark, []), spark.createDataFrame(labels, LABELS)).count() == 0
