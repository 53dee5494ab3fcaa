import pytest
from pyspark.sql import functions as F
from samples import crowded, frame, rows

from gridweave.llm import language


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = language.identify(docs, "text", "lang", "source").collect()
    assert len(found) == docs.count()
    assert sum(r["language"] == r["row"]["lang"] for r in found) >= 0.99 * len(found)
    assert sum(r["text_language"] == r["row"]["lang"] for r in found) >= 0.9 * len(found)
    assert all(r["accepted"] for r in found)


def test_wrong_declarations_are_overruled(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars > 300")
    wrong = docs.withColumn("lang", F.when(F.col("doc_id") % 10 == 0, F.when(F.col("lang") == "en", "de").otherwise("en")).otherwise(F.col("lang")))
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    found = [r for r in language.identify(wrong, "text", "lang", "source").collect() if r["row"]["doc_id"] % 10 == 0]
    assert sum(r["language"] == truth[r["row"]["doc_id"]] for r in found) >= 0.9 * len(found)


def posterior(evidence, counts, own, declared, suffix):
    """The fusion in plain Python; ``counts``: host, suffix and all rows by language."""
    import math

    names = language.LANGUAGES
    total = sum(counts["all"]) + len(names)
    general = [(n + 1) / total for n in counts["all"]]
    smooth = lambda n, p: [(a + language.SMOOTHING * b) / (sum(n) + language.SMOOTHING) for a, b in zip(n, p)]
    parent = general if suffix is None else smooth(counts["suffix"], general)
    host = smooth([n - (name == own) for n, name in zip(counts["host"], names)], parent)
    logs = []
    for i, name in enumerate(names):
        x = evidence[i] + math.log(host[i])
        if declared in names:
            x += math.log(language.DECLARED_RIGHT if declared == name else (1 - language.DECLARED_RIGHT) / 3)
        said = language.SUFFIX_LANGUAGE.get(suffix)
        if said:
            x += math.log(language.SUFFIX_RIGHT if said == name else (1 - language.SUFFIX_RIGHT) / 3)
        logs.append(x)
    weights = [math.exp(x - max(logs)) for x in logs]
    return [w / sum(weights) for w in weights]


def test_fusion_against_plain_python(spark):
    texts = {"de": "der die das und nicht ein", "en": "the and of to in that", "es": "el la los que de en", "fr": "le les des et que dans"}
    data = [(texts[x], x, f"{h}.example.{s}", s) for x, h, s in [("de", "a", "de"), ("de", "a", "de"), ("en", "a", "de"), ("en", "b", "com"), ("fr", "b", "com"), ("es", "c", "com"), ("en", "d", "uk")]]
    data += [("???", "de", "a.example.de", "de"), ("the and", None, "a.example.de", "de"), ("le les", "xx", None, None)]
    df = spark.createDataFrame(data, "body string, markup string, host string, suffix string")
    found = language.identify(df, "body", "markup", "host", "suffix").collect()
    model = language.fit_text_model(df.select(F.col("body").alias("_text"), F.col("markup").alias("_declared")), language.LANGUAGES)
    tally = lambda keep: [sum(d[1] == name and keep(d) for d in data) for name in language.LANGUAGES]
    assert len(found) == len(data)
    for r in found:
        body, markup, host, suffix = r["row"]
        codes = language.bigrams(body)
        evidence = model[codes].mean(axis=0) * min(len(codes), language.TEXT_WEIGHT) if len(codes) else [0.0] * 4
        if host is None:
            continue
        counts = {"all": tally(lambda d: d[2] is not None), "suffix": tally(lambda d: d[3] == suffix), "host": tally(lambda d: d[2] == host and d[3] == suffix)}
        want = posterior(evidence, counts, markup, markup, suffix)
        assert r["language"] == language.LANGUAGES[want.index(max(want))]
        assert r["confidence"] == pytest.approx(max(want), rel=1e-4)
        assert r["accepted"] == (len(codes) > 0 and max(want) >= 0.5)


def test_keep_identified(spark):
    df = crowded(frame(spark))
    kept = language.keep_identified(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert not {3, 4, 5} & set(ids)
    assert {1, 2, 6, 8, 10, 11} <= set(ids) and ids.count(11) == 2


def test_empty(spark):
    assert language.identify(frame(spark, []), "text", "lang", "source").count() == 0
    assert len(rows()) == language.identify(frame(spark), "text").count()
