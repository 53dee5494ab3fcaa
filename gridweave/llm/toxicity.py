"""Toxic passages by maximum-scoring segment search with extreme-value calibration.

1. Words of labelled documents are counted by class, once a document, so that a text which repeats a word
   weighs no more than another. Words that toxic documents hold more often than
   chance explains (log-odds with a flat Dirichlet prior, at least ``SCREEN`` standard errors) are the
   vocabulary; all other words are one class, "other".
2. One pass over all texts writes where the vocabulary stands. The whole corpus gives the informative
   Dirichlet prior of every vocabulary word, and labelled counts and prior give its final log-odds.
3. A passage is modelled as holding a share ``DENSITY`` of vocabulary words, so that word scores are
   log-likelihood ratios: positive for the vocabulary, slightly negative for other words. A scan in linear
   time finds all maximal-scoring segments (Ruzzo and Tompa), with a gap between vocabulary words as one item.
4. Scores of segments in unrelated text follow an extreme-value law: a text of n words has K n e^(-lambda S)
   segments of score S or more by chance. Lambda solves its equation for the corpus' word frequencies; K is
   its maximum likelihood estimate from clean labelled documents, those without a segment being censored.
   Segments of expected number below ``CHANCE`` are the toxic passages.
5. The evidence of a document is the sum of -log E over its toxic passages, or that of its best segment when
   none is significant. A logistic curve over evidence, fitted to the labelled documents, gives the score.

At most ``TRAIN_ROWS`` labelled rows are learned from, those of smallest id hash; the vocabulary has at most
``VOCABULARY`` words, those of the greatest standardised log-odds. Rows held out for testing (crc32 of the id
modulo 5 is 0) are never learned from; ids, labels, language and source are no inputs.

Null text counts as empty; texts without words get the score of a text without evidence. Repeated rows are
scored each for itself, and a null id is scored but not learned from. Without rows of both classes the score
is a constant: the only class, or 0.5. An empty table gives an empty result. Words are cut at white space and
ASCII punctuation and compared in lower case.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import by_value, stored, text_or_empty
from gridweave.llm.quality import held_out

by_value(__name__)

TRAIN_ROWS = 20_000
VOCABULARY = 50_000
#: Standard errors, and log-odds, that a word must have to enter the vocabulary.
SCREEN, LEAST_ODDS = 3.0, 2.0
#: Weight of the corpus-wide prior, in words.
PRIOR = 1_000.0
DENSITY = 0.05
CHANCE = 0.05
CUT = 0.5
RIDGE = 1e-3

SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
SPACES = bytes.maketrans(SEPARATORS, b" " * len(SEPARATORS))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(SPACES).split()


# --- vocabulary -------------------------------------------------------------------------------------


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for toxic, text in zip(batch.column("label").to_pylist(), batch.column("_text")):
            held = set(words_of(text.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), pa.array([toxic] * len(held), pa.int32())], names=["word", "label"])


def vocabulary(training: DataFrame, most: int = VOCABULARY) -> tuple[DataFrame, tuple[int, int]]:
    """(word, n1, n0) of the words that mark toxic documents, and the sums of these counts over all words."""
    seen = training.mapInArrow(_count, "word binary, label int")
    counts = stored(seen.groupBy("word").agg(F.sum("label").alias("n1"), F.sum(1 - F.col("label")).alias("n0")), "labelled-words")
    n1, n0 = counts.agg(F.sum("n1"), F.sum("n0")).first()
    n1, n0 = n1 or 0, n0 or 0
    odds = F.log((F.col("n1") + 0.5) / (n1 + 0.5)) - F.log((F.col("n0") + 0.5) / (n0 + 0.5))
    error = F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    scored = counts.where("n1 >= 2").select("word", "n1", "n0", odds.alias("odds"), (odds / error).alias("z"))
    chosen = scored.where((F.col("z") >= SCREEN) & (F.col("odds") >= LEAST_ODDS)).orderBy(F.desc("z"), "word").limit(most)
    return chosen.select("word", "n1", "n0"), (n1, n0)


HITS = "_id long, n_words long, n_distinct long, place array<int>, word array<int>"


def _locate(batches: Iterator[pa.RecordBatch], number: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    wanted = number.keys()
    for batch in batches:
        sizes, distinct, places, found = [], [], [], []
        for text in batch.column("_text"):
            words = words_of(text.as_py())
            held = set(words)
            at = [] if wanted.isdisjoint(held) else [i for i, w in enumerate(words) if w in number]
            sizes.append(len(words))
            distinct.append(len(held))
            places.append(at)
            found.append([number[words[i]] for i in at])
        ints = pa.list_(pa.int32())
        columns = [batch.column("_id"), pa.array(sizes, pa.int64()), pa.array(distinct, pa.int64()), pa.array(places, ints), pa.array(found, ints)]
        yield pa.RecordBatch.from_arrays(columns, names=["_id", "n_words", "n_distinct", "place", "word"])


# --- scores -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class WordScores:
    """Score of every vocabulary word and of any other, and lambda of their extreme-value law."""

    vocabulary: np.ndarray
    other: float
    decay: float


def decay(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum(shares * exp(root * scores)) = 1, for scores of negative mean."""

    def excess(x: float) -> float:
        return float(np.sum(shares * np.exp(np.minimum(x * scores, 700)))) - 1

    low, high = 0.0, 1.0
    while excess(high) < 0:
        low, high = high, 2 * high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return (low + high) / 2


def word_scores(toxic: np.ndarray, clean: np.ndarray, corpus: np.ndarray, totals: tuple[int, int, int]) -> WordScores:
    """From the numbers of toxic and clean labelled rows and of all rows that hold each vocabulary word, and
    the sums of these numbers over all words."""
    prior = PRIOR * (corpus + 0.5) / (totals[2] + 0.5 * (len(corpus) + 1))
    p1 = (toxic + prior) / (totals[0] + PRIOR)
    p0 = (clean + prior) / (totals[1] + PRIOR)
    rest = 1 - p0.sum()
    scores = np.log(DENSITY * p1 / p1.sum() / p0)
    other = math.log((1 - DENSITY) / rest)
    return WordScores(scores, other, decay(np.append(scores, other), np.append(p0, rest)))


def segments(places: list[int], scores: list[float], other: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first word, end, score) of a text with positive scores at ``places`` and
    ``other``, which is negative, everywhere else.

    ``before`` and ``after`` are the sums of all scores up to either side of a candidate; ``link`` leads to
    the nearest earlier candidate with a smaller sum before it.
    """
    begin: list[int] = []
    end: list[int] = []
    before: list[float] = []
    after: list[float] = []
    link: list[int] = []
    total, reached = 0.0, 0
    for place, score in zip(places, scores):
        total += other * (place - reached)
        first, low = place, total
        total, reached = total + score, place + 1
        high = total
        while True:
            j = len(begin) - 1
            while j >= 0 and before[j] >= low:
                j = link[j]
            if j < 0 or after[j] >= high:
                break
            first, low = begin[j], before[j]
            del begin[j:], end[j:], before[j:], after[j:], link[j:]
        begin.append(first)
        end.append(reached)
        before.append(low)
        after.append(high)
        link.append(j)
    return [(a, b, high - low) for a, b, low, high in zip(begin, end, before, after)]


SEGMENTS = "array<struct<start: long, end: long, score: double>>"
SEGMENT_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def _scan(batches: Iterator[pa.RecordBatch], scores: WordScores) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for place, word in zip(batch.column("place").to_pylist(), batch.column("word").to_pylist()):
            weights = scores.vocabulary[word].tolist() if word else []
            gained = [(p, w) for p, w in zip(place, weights) if w > 0]
            parts = segments([p for p, _ in gained], [w for _, w in gained], scores.other)
            found.append([{"start": a, "end": b, "score": s} for a, b, s in parts])
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("n_words"), pa.array(found, SEGMENT_TYPE)], names=["_id", "n_words", "segments"])


@dataclass(frozen=True)
class Calibration:
    """K and lambda of the extreme-value law, and the logistic curve over evidence."""

    k: float
    decay: float
    slope: float = 0.0
    intercept: float = 0.0

    def log_expected(self, score: Column) -> Column:
        """log E: the logarithm of how many segments of this score a text of this length has by chance."""
        return F.log(F.lit(self.k) * F.greatest(F.col("n_words"), F.lit(1))) - score * self.decay

    def passages(self) -> Column:
        """The significant segments, with their expected number by chance."""
        kept = F.filter("segments", lambda s: self.log_expected(s["score"]) < math.log(CHANCE))
        return F.transform(
            kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"), F.exp(self.log_expected(s["score"])).alias("expected"))
        )

    def evidence(self) -> Column:
        """Sum of -log E over the significant segments, or the best one's."""
        best = F.coalesce(F.array_max(F.transform("segments", lambda s: s["score"])), F.lit(0.0))
        gains = F.transform("segments", lambda s: -self.log_expected(s["score"]))
        total = F.aggregate(F.filter(gains, lambda g: g > -math.log(CHANCE)), F.lit(0.0), lambda a, g: a + g)
        return F.when(total > 0, total).otherwise(-self.log_expected(best))

    def score(self) -> Column:
        x = F.asinh("evidence")
        return 1.0 / (1.0 + F.exp(-(x * self.slope + self.intercept)))


def chance_rate(words: np.ndarray, best: np.ndarray, rate: float) -> float:
    """Maximum likelihood K from the best segments of clean texts; a text without one (best 0) is censored.

    words * exp(-rate * best) is exponential with mean 1 / K. Half a text is added so that K is never zero.
    """
    return (np.count_nonzero(best > 0) + 0.5) / max(1.0, float(np.sum(np.maximum(words, 1) * np.exp(-rate * best))))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and intercept of a logistic curve, by Newton steps with a small ridge."""
    shift, scale = float(x.mean()), float(x.std()) or 1.0
    design = np.stack([(x - shift) / scale, np.ones(len(x))], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        pull = np.array([RIDGE * len(x), 1e-9])
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag(pull), design.T @ (y - p) - pull * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    slope = max(0.0, beta[0]) / scale
    return slope, float(beta[1] - slope * shift) if slope else float(beta[1])


# --- the operator -----------------------------------------------------------------------------------


def detect(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", id_column: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS
) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted, evidence, n_words and ``passages``, the
    significant ones as (start, end, score, expected), in word numbers, end exclusive."""
    known = labels.select(F.col(f"`{id_column}`").cast("long").alias("_id"), F.col(f"`{label}`").cast("int").alias("label"))
    known = known.where("label IN (0, 1) AND _id IS NOT NULL").where(~held_out("_id"))
    chosen = stored(known.orderBy(F.xxhash64("_id"), "_id", "label").limit(train_rows), "labelled")
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("_id"), text_or_empty(f"`{text}`").alias("_text"))
    training = stored(rows.join(F.broadcast(chosen), "_id"), "labelled-texts")  # at most train_rows labels
    words, totals = vocabulary(training.where("label IN (0, 1)"))
    listed = words.collect()
    number = {bytes(r["word"]): i for i, r in enumerate(listed)}
    hits = stored(rows.mapInArrow(lambda batches: _locate(batches, number), HITS), "hits")

    corpus = np.zeros(len(listed))
    for r in hits.select(F.explode(F.array_distinct("word")).alias("w")).groupBy("w").count().collect():  # a row per vocabulary word
        corpus[r["w"]] = r["count"]
    every = hits.agg(F.sum("n_distinct")).first()[0] or 0
    toxic, clean = (np.array([r[c] for r in listed], float) for c in ("n1", "n0"))
    classes = [r["label"] for r in training.select("label").distinct().collect()]
    scores = word_scores(toxic, clean, corpus, (*totals, every)) if listed else WordScores(np.zeros(0), -1.0, 1.0)
    found = stored(hits.mapInArrow(lambda batches: _scan(batches, scores), f"_id long, n_words long, segments {SEGMENTS}"), "segments")

    calibration = fit(found, chosen, scores, train_rows) if len(classes) == 2 else Calibration(1.0, scores.decay)
    seen = found.select("*", calibration.evidence().alias("evidence"))
    score = calibration.score() if len(classes) == 2 else F.lit(float(classes[0]) if classes else 0.5)
    return seen.select(
        F.col("_id").alias(id_column),
        held_out("_id").alias("held_out"),
        score.alias("score"),
        F.when(score >= CUT, 1).otherwise(0).alias("predicted"),
        "evidence",
        "n_words",
        calibration.passages().alias("passages"),
    )


def fit(found: DataFrame, chosen: DataFrame, scores: WordScores, most: int) -> Calibration:
    """Calibration on the segments of the labelled rows; ids that repeat count as often, up to ``most`` rows."""
    known = found.join(F.broadcast(chosen), "_id")
    best = F.coalesce(F.array_max(F.transform("segments", lambda s: s["score"])), F.lit(0.0)).alias("best")
    clean = known.where("label = 0").select("n_words", best).orderBy(F.xxhash64("_id"), "_id", "n_words", "best").limit(most).toPandas()
    law = Calibration(chance_rate(clean["n_words"].to_numpy(float), clean["best"].to_numpy(float), scores.decay), scores.decay)
    rows = known.select("_id", "label", F.asinh(law.evidence()).alias("x")).orderBy(F.xxhash64("_id"), "_id", "label", "x").limit(most).toPandas()
    slope, intercept = logistic(rows["x"].to_numpy(float), rows["label"].to_numpy(float))
    return Calibration(law.k, law.decay, slope, intercept)
