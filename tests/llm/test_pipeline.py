import pytest
import test_decontamination
import test_exact_dedup
import test_packing
import test_simhash
from tokenizers import Tokenizer

import corpus_pipeline
from gridweave.llm.common import stored


@pytest.fixture(scope="module")
def steps(spark, sf):
    """Rows before the first and after every stage."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    edge = spark.createDataFrame(
        [(10_000, None, "en", "src1", None), (10_001, "", "en", "src1", 0), (10_002, "1234 5678", "en", "src1", 9)], docs.schema
    )
    docs = stored(docs.union(edge), "test-documents")
    found = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, sf), "test")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.schema.simpleString() == docs.schema.simpleString()
        docs = after
        found.append(docs.collect())
    return found


def ids(rows):
    return sorted(r["doc_id"] for r in rows)


def plain(rows):
    return [(r["doc_id"], r["text"]) for r in rows]


def test_language(steps):
    assert ids(steps[1]) == [i for i in ids(steps[0]) if i < 10_000]


def test_exact(steps):
    assert ids(steps[2]) == sorted({v[0] for v in test_exact_dedup.expected(plain(steps[1])).values()})


def test_near(steps):
    prints = {i: test_simhash.print_of(t, corpus_pipeline.SHINGLE) for i, t in plain(steps[2])}
    assert ids(steps[3]) == sorted(set(test_simhash.brute_force(prints, corpus_pipeline.DISTANCE).values()))


def test_leaks(steps, spark, sf):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    dirty = {i for i, _ in test_decontamination.brute_force(plain(steps[3]), items)}
    assert dirty and ids(steps[4]) == [i for i in ids(steps[3]) if i not in dirty]


def test_packed(steps):
    tokenizer = Tokenizer.from_file(test_packing.PATH)
    used = test_packing.check(steps[5], plain(steps[4]), tokenizer, 1024)
    total = sum(r["length"] for r in steps[5])
    assert total / 1024 <= used <= 1.02 * total / 1024 + 1


def test_run_applies_all_stages(spark, sf, steps):
    found = {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert found == set(ids(steps[4]))
