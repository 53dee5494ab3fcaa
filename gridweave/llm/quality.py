"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

1. Statistics of every whole text are written once.
2. A random forest is fitted to labelled rows; every path from a root to a node is a rule, a conjunction
   of comparisons of statistics.
3. A logistic regression with lasso penalty weighs the rules; most weights become zero.
4. The remaining rules are compiled into one Spark column, which scores all documents.

The fit uses at most ``TRAIN_ROWS`` labelled rows, those of smallest id hash. Rows held out for testing
(crc32 of the id modulo 5 is 0) are never used, and ids, labels, language and source are no inputs.
Null text counts as empty, with all statistics zero. Rows with a null label are not learned from. If the
labels hold one class or none, the score is a constant: that class, or 0.5. Repeated rows are scored each
for itself.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log1p

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import by_value, stored, text_or_empty

by_value(__name__)

TRAIN_ROWS = 20_000
TREES, DEPTH, SEED = 20, 4, 7
LASSO = 0.001
CUT = 0.3

CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "sentence": b".,;:?",
    "loud": b"!",
    "symbol": b"#$%&*+/<=>@\\^_`~",
    "table": b"|",
    "bracket": b"()[]{}",
    "quote": b"\"'",
    "line": b"\n",
    "space": b" \t",
}
STATISTICS = (
    "bytes", "words", "word_bytes", "distinct", "top_word", "same_as_before", "marked", "capitalized", "short",
    "wide", "line_words", "repeated_lines", "unfinished_lines", *CLASSES,
)


def statistics(raw: bytes) -> list[float]:
    """The statistics of one text; shares lie between 0 and 1."""
    words = raw.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, size = len(words), len(raw)
    counts = Counter(words)
    lines = [line for line in raw.split(b"\n") if line]
    letters = raw.translate(None, b" \t\n\r\v\f")
    return [
        log1p(size),
        log1p(n),
        len(letters) / n,
        len(counts) / n,
        max(counts.values()) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        sum(c for w, c in counts.items() if w[-1] in b"!#$%&*|~^@+=") / n,
        sum(c for w, c in counts.items() if w[:1].isupper()) / n,
        sum(c for w, c in counts.items() if len(w) <= 3) / n,
        (size - len(raw.translate(None, HIGH))) / size,
        log1p(n / len(lines)),
        1.0 - len(set(lines)) / len(lines),
        sum(line[-1] not in b".!?:;|\"'" for line in lines) / len(lines),
        *((size - len(raw.translate(None, members))) / size for members in CLASSES.values()),
    ]


HIGH = bytes(range(128, 256))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(text.as_buffer().to_pybytes()) for text in batch.column("_text")]
        columns = [pa.array(c, pa.float64()) for c in zip(*rows)] if rows else [pa.array([], pa.float64())] * len(STATISTICS)
        yield pa.RecordBatch.from_arrays([batch.column("_id"), *columns], names=["_id", *STATISTICS])


def measured(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    rows = docs.select(F.col(id_column).cast("long").alias("_id"), text_or_empty(text).alias("_text"))
    return rows.mapInArrow(_measure, "_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


# --- rules ------------------------------------------------------------------------------------------

NODE = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)$")
Condition = tuple[int, str, float]


def tree_paths(described: str) -> list[tuple[Condition, ...]]:
    """The conjunction of every node below the root, from the printed form of a tree."""
    path: list[tuple[int, Condition]] = []
    found = []
    for line in described.splitlines():
        if m := NODE.match(line):
            depth = len(m[1])
            path = [p for p in path if p[0] < depth] + [(depth, (int(m[2]), m[3], float(m[4])))]
            found.append(tuple(c for _, c in path))
    return found


def simplified(conditions: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """One bound for each statistic and direction, in a fixed order."""
    bounds: dict[tuple[int, str], float] = {}
    for feature, sign, value in conditions:
        old = bounds.get((feature, sign), value)
        bounds[feature, sign] = min(old, value) if sign == "<=" else max(old, value)
    return tuple((f, s, v) for (f, s), v in sorted(bounds.items()))


def rule_column(rule: tuple[Condition, ...]) -> Column:
    """1 where all comparisons hold, else 0."""
    text = " AND ".join(f"{STATISTICS[f]} {sign} {value!r}D" for f, sign, value in rule)
    return F.expr(f"CASE WHEN {text} THEN 1D ELSE 0D END")


@dataclass(frozen=True)
class RuleEnsemble:
    """Weighted rules and an intercept; ``constant`` replaces them when there was nothing to learn."""

    rules: tuple[tuple[tuple[Condition, ...], float], ...]
    intercept: float
    constant: float | None = None

    def score(self) -> Column:
        """Probability of label 1 as a column over the statistics."""
        if self.constant is not None:
            return F.lit(self.constant)
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + rule_column(rule) * weight
        return 1.0 / (1.0 + F.exp(-total))


def fit(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> RuleEnsemble:
    """``rows``: statistics and ``label`` (0 or 1). A bounded table."""
    classes = {r["label"] for r in rows.select("label").distinct().collect()}
    if len(classes) < 2:
        return RuleEnsemble((), 0.0, classes.pop() if classes else 0.5)
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="x").transform(rows).select("x", "label")
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=SEED).fit(vectors)
    rules = sorted({simplified(p) for tree in forest.trees for p in tree_paths(tree.toDebugString)})
    if not rules:
        return RuleEnsemble((), 0.0, rows.agg(F.avg("label")).first()[0])
    fired = rows.select("label", *[rule_column(r).alias(f"r{i}") for i, r in enumerate(rules)])
    fired = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="r").transform(fired).select("r", "label")
    lasso_fit = LogisticRegression(featuresCol="r", labelCol="label", elasticNetParam=1.0, regParam=lasso, maxIter=60, standardization=False)
    model = lasso_fit.fit(stored(fired, "rules"))
    weighted = tuple((r, float(w)) for r, w in zip(rules, model.coefficients.toArray()) if w != 0.0)
    return RuleEnsemble(weighted, float(model.intercept))


def held_out(name: str) -> Column:
    return F.expr(f"crc32(cast(coalesce(cast(`{name}` AS string), '') AS binary)) % 5 = 0")


def classify(
    docs: DataFrame, labels: DataFrame, label: str = "quality", id_column: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS
) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted."""
    all_rows = stored(measured(docs, id_column, text), "statistics")
    known = labels.select(F.col(id_column).alias("_lid"), F.col(label).cast("double").alias("label"))
    known = known.where("label IS NOT NULL").where(~held_out("_lid"))
    chosen = all_rows.join(known, F.col("_id") == F.col("_lid")).orderBy(F.xxhash64("_id"), "_id", "label").limit(train_rows)
    ensemble = fit(stored(chosen.select("label", *STATISTICS), "training").coalesce(4))
    score = ensemble.score()
    return all_rows.select(
        F.col("_id").alias(id_column),
        held_out("_id").alias("held_out"),
        score.alias("score"),
        F.when(score >= CUT, 1).otherwise(0).alias("predicted"),
    )
