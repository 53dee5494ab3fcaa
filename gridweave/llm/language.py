"""Language identification by Bayesian fusion of four kinds of evidence.

- text: likelihood of its byte bigrams (lower case, everything but letters a blank) under each language,
  learned from all rows that declare a language. A bigram depends on its neighbours, so the likelihood is
  tempered: the mean over the whole text counts for at most ``TEXT_WEIGHT`` independent bigrams.
- declared language (markup or metadata), right with probability ``DECLARED_RIGHT``
- address suffix, where it belongs to a language
- host: how often its other rows declare each language, smoothed towards its suffix, and that towards all
  rows. The counts come from grouped aggregation; a row's own declaration is taken out of its prior.

A row is accepted when its text has a letter and the best language has probability ``LEAST`` or more.
Null or letterless text is not accepted. A null or unknown declaration, host or suffix is no evidence.
Nothing is dropped; repeated rows are judged each for itself (each counts as another row of its host).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridweave.llm.common import by_value, stored

by_value(__name__)

LANGUAGES = ("de", "en", "es", "fr")
DECLARED_RIGHT = 0.9
SUFFIX_RIGHT = 0.8
TEXT_WEIGHT = 60.0
#: Rows that the parent level of a host or suffix is worth.
SMOOTHING = 20.0
LEAST = 0.5
BIGRAMS = 1 << 16
#: Bigrams that a task holds before it counts them.
HELD_CODES = 4_000_000
#: Country suffixes and the main language of each.
SUFFIX_LANGUAGE = {
    "at": "de", "de": "de", "li": "de",
    "au": "en", "ie": "en", "nz": "en", "uk": "en", "us": "en",
    "ar": "es", "cl": "es", "co": "es", "es": "es", "mx": "es", "pe": "es",
    "fr": "fr", "mc": "fr", "sn": "fr",
}
#: Bytes that are neither ASCII letters nor part of a longer character become blanks.
LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def bigrams(text: str) -> np.ndarray:
    """Codes of neighbouring bytes; none if the text has no letter."""
    plain = np.frombuffer(b" " + text.lower().encode().translate(LETTERS) + b" ", np.uint8)
    codes = plain[:-1].astype(np.int32) * 256 + plain[1:]
    return codes[codes != 32 * 257]


def _count(batches: Iterator[pa.RecordBatch], languages: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((len(languages), BIGRAMS), np.int64)
    waiting: list[list[np.ndarray]] = [[] for _ in languages]
    place = {name: i for i, name in enumerate(languages)}
    held = 0

    def add() -> None:
        for row, parts in zip(total, waiting):
            if parts:
                row += np.bincount(np.concatenate(parts), minlength=BIGRAMS)
                parts.clear()

    for batch in batches:
        for text, declared in zip(batch.column("_text"), batch.column("_declared").to_pylist()):
            if declared in place and text.is_valid:
                codes = bigrams(text.as_py())
                waiting[place[declared]].append(codes)
                held += len(codes)
                if held >= HELD_CODES:
                    add()
                    held = 0
    add()
    language, code = np.nonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(language, pa.int32()), pa.array(code, pa.int32()), pa.array(total[language, code])], names=["language", "code", "n"]
    )


def fit_text_model(rows: DataFrame, languages: tuple[str, ...]) -> np.ndarray:
    """Log probability of every bigram (rows) in every language, from all rows with a declaration.

    The driver gets one number for each language and bigram at most.
    """
    counts = rows.select("_text", "_declared").mapInArrow(lambda b: _count(b, languages), "language int, code int, n long")
    table = np.ones((BIGRAMS, len(languages)))
    for r in counts.groupBy("language", "code").agg(F.sum("n").alias("n")).toLocalIterator():
        table[r["code"], r["language"]] += r["n"]
    return np.log(table / table.sum(axis=0))


def _score(batches: Iterator[pa.RecordBatch], model: np.ndarray) -> Iterator[pa.RecordBatch]:
    model = model.astype(np.float32)
    for batch in batches:
        scores = np.zeros((batch.num_rows, model.shape[1]))
        letters = np.zeros(batch.num_rows, np.int64)
        for i, text in enumerate(batch.column("_text")):
            codes = bigrams(text.as_py()) if text.is_valid else ()
            if len(codes):
                scores[i] = model[codes].mean(axis=0, dtype=np.float64) * min(len(codes), TEXT_WEIGHT)
                letters[i] = len(codes)
        kept = [n for n in batch.schema.names if n != "_text"]
        arrays = [*map(batch.column, kept), pa.array(letters), *map(pa.array, scores.T.copy())]
        yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "_letters", *(f"_t{i}" for i in range(model.shape[1]))])


def _smoothed(counts: list[Column], parent: list[Column]) -> list[Column]:
    total = reduce(lambda a, b: a + b, counts) + SMOOTHING
    return [(n + SMOOTHING * p) / total for n, p in zip(counts, parent)]


def host_counts(rows: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """(_host, _suffix, _n0.., _p0..): declared languages of each host, and the smoothed share of each
    language at its suffix."""
    ranks = range(len(languages))
    each = [F.sum((F.col("_declared") == name).cast("long")) for name in languages]
    counted = rows.groupBy("_host", "_suffix").agg(*[F.coalesce(n, F.lit(0)).alias(f"_n{i}") for i, n in zip(ranks, each)])
    hosts = stored(counted.where("_host IS NOT NULL OR _suffix IS NOT NULL"), "hosts")
    totals = hosts.agg(*[F.coalesce(F.sum(f"_n{i}"), F.lit(0)).alias(f"_a{i}") for i in ranks]).first()
    everywhere = sum(totals) + len(languages)
    general = [F.lit((totals[i] + 1.0) / everywhere) for i in ranks]
    suffixes = hosts.groupBy("_suffix").agg(*[F.sum(f"_n{i}").alias(f"_s{i}") for i in ranks])
    parents = suffixes.select(
        F.col("_suffix").alias("_suffix2"),
        *[
            F.when(F.col("_suffix").isNull(), g).otherwise(p).alias(f"_p{i}")
            for i, g, p in zip(ranks, general, _smoothed([F.col(f"_s{i}") for i in ranks], general))
        ],
    )
    return hosts.join(parents, F.col("_suffix").eqNullSafe(F.col("_suffix2"))).drop("_suffix2")


def identify(
    docs: DataFrame,
    text: Column | str = "text",
    declared: Column | str | None = None,
    host: Column | str | None = None,
    suffix: Column | str | None = None,
    languages: tuple[str, ...] = LANGUAGES,
    keep: list[str] | None = None,
) -> DataFrame:
    """``row`` (struct of the columns ``keep``, else all), language, confidence, text_language, accepted."""

    def given(value: Column | str | None) -> Column:
        return F.lit(None).cast("string") if value is None else (F.col(value) if isinstance(value, str) else value).cast("string")

    source = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"),
        given(text).alias("_text"),
        F.lower(given(declared)).alias("_declared"),
        F.lower(given(host)).alias("_host"),
        F.lower(given(suffix)).alias("_suffix"),
    )
    model = fit_text_model(source, languages)
    hosts = stored(host_counts(source, languages), "host-priors")
    ranks = range(len(languages))
    wide = StructType([f for f in source.schema.fields if f.name != "_text"]).add("_letters", "long")
    for i in ranks:
        wide = wide.add(f"_t{i}", "double")
    scored = source.mapInArrow(lambda batches: _score(batches, model), wide)
    prior = hosts.select(F.col("_host").alias("_host2"), F.col("_suffix").alias("_suffix2"), *[c for i in ranks for c in (f"_n{i}", f"_p{i}")])
    joined = scored.join(
        prior, F.col("_host").eqNullSafe(F.col("_host2")) & F.col("_suffix").eqNullSafe(F.col("_suffix2")), "left"
    )
    counts = [F.col(f"_n{i}") - F.coalesce((F.col("_declared") == name).cast("long"), F.lit(0)) for i, name in zip(ranks, languages)]
    shares = _smoothed(counts, [F.col(f"_p{i}") for i in ranks])
    known = F.coalesce(F.col("_declared").isin(*languages), F.lit(False))
    suffix_language = F.coalesce(
        *[F.when(F.col("_suffix").isin(*[s for s, x in SUFFIX_LANGUAGE.items() if x == name]), name) for name in languages if name in SUFFIX_LANGUAGE.values()],
        F.lit(None).cast("string"),
    )
    others = max(1, len(languages) - 1)

    def log_if(agrees: Column, applies: Column, right: float) -> Column:
        return F.when(~applies, 0.0).when(agrees, math.log(right)).otherwise(math.log((1 - right) / others))

    evidence = [
        F.col(f"_t{i}")
        + F.coalesce(F.log(share), F.lit(0.0))
        + log_if(F.col("_declared") == name, known, DECLARED_RIGHT)
        + log_if(F.col("_suffix_language") == name, F.col("_suffix_language").isNotNull(), SUFFIX_RIGHT)
        for i, name, share in zip(ranks, languages, shares)
    ]
    weighed = joined.withColumn("_suffix_language", suffix_language).select(
        "row", "_letters", *[f"_t{i}" for i in ranks], *[e.alias(f"_e{i}") for i, e in zip(ranks, evidence)]
    )

    def best(prefix: str) -> Column:
        top = F.greatest(*[F.col(f"{prefix}{i}") for i in ranks]) if len(languages) > 1 else F.col(f"{prefix}0")
        return F.coalesce(*[F.when(F.col(f"{prefix}{i}") == top, name) for i, name in zip(ranks, languages)])

    top = F.greatest(*[F.col(f"_e{i}") for i in ranks]) if len(languages) > 1 else F.col("_e0")
    confidence = 1.0 / reduce(lambda a, b: a + b, [F.exp(F.col(f"_e{i}") - top) for i in ranks])
    return weighed.select(
        "row",
        best("_e").alias("language"),
        confidence.alias("confidence"),
        F.when(F.col("_letters") > 0, best("_t")).alias("text_language"),
        ((F.col("_letters") > 0) & (confidence >= LEAST)).alias("accepted"),
    )


def keep_identified(docs: DataFrame, text: str = "text", declared: str = "lang", host: str = "source") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is clear."""
    return identify(docs, text, declared, host).where("accepted").select("row.*")
