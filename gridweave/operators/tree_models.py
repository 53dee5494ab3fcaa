"""Fitted trees and ensembles as one Spark expression.

The nodes of all trees stand in flat arrays, each tree in the order node, left subtree, right subtree, so the
left child of a node is the next entry. A walk is a fold over the depth of the ensemble; an ensemble is a fold
over its roots. The expression has a fixed size whatever the number of nodes: the arrays are constants that
Catalyst folds once, not nested conditions, which would outgrow code generation at a few thousand nodes.

The same walk gives the leaf that a row reaches in every tree, so that ensembles can be checked leaf by leaf.

``read_trees`` holds the nodes on the driver and in the expression, for a model of a few thousand nodes.
``write_trees`` leaves them in a table that the walk reads through a scalar subquery: neither the driver nor
the plan, which Spark prints and keeps for every query, grows with the number of nodes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.functions.text import Expr, add, array, col, let, num, select
from gridweave.operators.quality import DataQualityError
from gridweave.session import scratch_path, spread, stored

TREE = re.compile(r"^\s*Tree \d+ \(weight (\S+)\):$")
SPLIT = re.compile(r"^\s*(If|Else) \(feature (\d+) (?:<=|>) (\S+)\)$")
LEAF = re.compile(r"^\s*Predict: (\S+)$")
#: Ensembles whose trees are averaged; others are weighted sums.
AVERAGED = "RandomForest"
#: Column that holds the nodes of written trees.
NODES = "_nodes"


class Walk:
    """The walk of a row through every tree; ``constants`` are the arrays that it needs, the outermost last."""

    features: tuple[str, ...]
    roots: tuple[int, ...]
    weights: tuple[float, ...]
    depth: int
    constants: dict[str, Expr]

    def attached(self, df: DataFrame) -> DataFrame:
        """The rows with what the expressions need besides the inputs."""
        return df

    def _inside(self, body: Expr) -> Expr:
        inputs = array(f"double({col(f)})" for f in self.features)
        for name, constant in {"_x": inputs, **self.constants}.items():
            body = let(name, constant, body)
        return body

    def _leaf(self, root: Expr) -> Expr:
        child = "if(_f[_n] < 0, _n, if(_x[_f[_n]] <= _v[_n], _n + 1, _r[_n]))"
        return f"aggregate(sequence(0, {self.depth}), {root}, (_n, _d) -> {child})"

    def leaves(self) -> Expr:
        """array<int>: the node number of the leaf that the row reaches, tree by tree."""
        roots = array(str(r) for r in self.roots)
        return self._inside(f"transform({roots}, _t -> {self._leaf('_t')})")

    def stages(self) -> Expr:
        """array<struct<leaf, value, weight>>, tree by tree."""
        entries = array(f"struct({r} AS root, {num(w)} AS weight)" for r, w in zip(self.roots, self.weights))
        step = let("_l", self._leaf("_t.root"), "struct(_l AS leaf, _v[_l] AS value, _t.weight AS weight)")
        return self._inside(f"transform({entries}, _t -> {step})")

    def prediction(self) -> Expr:
        return f"aggregate({self.stages()}, 0.0D, (_s, _e) -> _s + _e.weight * _e.value)"


@dataclass(frozen=True)
class Trees(Walk):
    """``feature`` is -1 for a leaf; ``value`` is a threshold or a leaf's prediction; ``right`` the right child."""

    features: tuple[str, ...]
    feature: tuple[int, ...]
    value: tuple[float, ...]
    right: tuple[int, ...]
    roots: tuple[int, ...]
    weights: tuple[float, ...]
    depth: int

    @cached_property
    def constants(self) -> dict[str, Expr]:
        def listed(values: tuple, kind: str) -> Expr:
            return f"cast(split('{','.join(map(repr, values))}', ',') AS array<{kind}>)"

        return {"_f": listed(self.feature, "int"), "_v": listed(self.value, "double"), "_r": listed(self.right, "int")}


def read_trees(model, features: list[str]) -> Trees:
    """The nodes of a fitted ``pyspark.ml`` tree, forest or boosted model, from its printed form."""
    feature: list[int] = []
    value: list[float] = []
    right: list[int] = []
    roots: list[int] = []
    weights: list[float] = []
    open_: list[int] = []  # inner nodes whose right side has not begun
    deepest = 0
    printed = model.toDebugString.splitlines()
    single = not any(TREE.match(line) for line in printed)
    for line in printed[1:] if not single else ["Tree 0 (weight 1.0):", *printed[1:]]:
        if not line.strip():
            continue
        if m := TREE.match(line):
            roots.append(len(feature))
            weights.append(float(m[1]))
            open_ = []
        elif m := SPLIT.match(line):
            if m[1] == "If":
                open_.append(len(feature))
                feature.append(int(m[2]))
                value.append(float(m[3]))
                right.append(-1)
                deepest = max(deepest, len(open_))
            else:
                # the innermost node without a right side
                node = next(n for n in reversed(open_) if right[n] < 0)
                del open_[open_.index(node) + 1 :]
                right[node] = len(feature)
        elif m := LEAF.match(line):
            feature.append(-1)
            value.append(float(m[1]))
            right.append(-1)
        else:
            raise DataQualityError(f"not a split of a number: {line.strip()}")
    if type(model).__name__.startswith(AVERAGED):
        weights = [1 / len(roots)] * len(roots)
    return Trees(tuple(features), tuple(feature), tuple(value), tuple(right), tuple(roots), tuple(weights), deepest)


@dataclass(frozen=True)
class WrittenTrees(Walk):
    """``nodes`` is a table of one row, the arrays of ``Trees``."""

    features: tuple[str, ...]
    nodes: DataFrame
    roots: tuple[int, ...]
    weights: tuple[float, ...]
    depth: int

    @cached_property
    def constants(self) -> dict[str, Expr]:
        return {"_f": "_m.feature", "_v": "_m.value", "_r": "_m.right", "_m": NODES}

    def attached(self, df: DataFrame) -> DataFrame:
        # used once by an expression, so the optimizer puts the subquery in its place
        return df.select("*", self.nodes.select(F.struct("feature", "value", "right")).scalar().alias(NODES))


def write_trees(model, features: list[str], spark: SparkSession) -> WrittenTrees:
    """The nodes of a fitted ``pyspark.ml`` tree, forest or boosted model, from its written form."""
    saved = scratch_path(spark, "tree-model")
    model.write().save(saved)
    data = spark.read.parquet(f"{saved}/data")
    # only ensembles number their trees
    nodes = data.selectExpr("treeID AS tree", "nodeData.*") if "treeID" in data.columns else data.selectExpr("0 AS tree", "*")
    sizes = nodes.groupBy("tree").agg(F.count("*").alias("nodes"), F.expr("count_if(split.numCategories >= 0)").alias("other")).orderBy("tree").collect()
    if any(r["other"] for r in sizes):
        raise DataQualityError("not a split of a number")
    roots = [sum(r["nodes"] for r in sizes[:k]) for k in range(len(sizes))]
    inner = "rightChild >= 0"
    flat = nodes.selectExpr(
        "tree", "id", f"if({inner}, split.featureIndex, -1) AS feature", f"if({inner}, split.leftCategoriesOrThreshold[0], prediction) AS value",
        f"if({inner}, rightChild + {array(map(str, roots))}[tree], -1) AS right",
    )
    trees = flat.groupBy("tree").agg(F.expr("array_sort(collect_list(struct(id, feature, value, right))) AS nodes"))
    whole = trees.agg(F.expr("flatten(array_sort(collect_list(struct(tree, nodes))).nodes) AS n"))
    table = stored(whole.selectExpr("n.feature AS feature", "n.value AS value", "n.right AS right"), "trees")
    if type(model).__name__.startswith(AVERAGED):
        weights = [1 / len(roots)] * len(roots)
    else:
        weights = [float(w) for w in model.treeWeights] if hasattr(model, "trees") else [1.0]
    deepest = max(t.depth for t in model.trees) if hasattr(model, "trees") else model.depth
    return WrittenTrees(tuple(features), table, tuple(roots), tuple(weights), deepest)


def linear_prediction(model, features: list[str]) -> Expr:
    terms = [f"{num(float(c))} * double({col(f)})" for c, f in zip(model.coefficients, features)]
    return " + ".join([num(float(model.intercept)), *terms])


def expression(model, features: list[str]) -> Expr:
    """The prediction of a fitted linear, tree, forest or boosted model as SQL text over its input columns."""
    return linear_prediction(model, features) if hasattr(model, "coefficients") else read_trees(model, features).prediction()


def predicted(df: DataFrame, model, features: list[str], name: str) -> DataFrame:
    """The rows with the prediction of a fitted model as column ``name``, from an expression whose text and
    plan are of one size for any number of nodes."""
    if hasattr(model, "coefficients"):
        return add(df, {name: linear_prediction(model, features)})
    trees = write_trees(model, features, df.sparkSession)
    return trees.attached(df).selectExpr(f"* EXCEPT ({NODES})", f"{trees.prediction()} AS {col(name)}")


def stage_rows(df: DataFrame, trees: Walk, label: Expr) -> DataFrame:
    """(stage, leaf, value, before, label) for every row and tree; ``before`` is what the earlier trees add up to."""
    sums = (
        "aggregate(_stages, struct(0.0D AS total, cast(array() AS array<double>) AS seen), "
        "(_a, _e) -> struct(_a.total + _e.weight * _e.value AS total, array_append(_a.seen, _a.total) AS seen)).seen"
    )
    walked = trees.attached(spread(df)).selectExpr(f"double({label}) AS label", f"{trees.stages()} AS _stages").selectExpr("label", f"arrays_zip(_stages, {sums}) AS _both")
    rows = walked.selectExpr("label", "posexplode(_both) AS (stage, _b)")
    return rows.selectExpr("stage", "_b._stages.leaf AS leaf", "_b._stages.value AS value", "_b.seen AS before", "label")


def wrong_boosted_leaves(df: DataFrame, trees: Walk, label: Expr, tolerance: float = 1e-6) -> int:
    """Leaves that are not the mean of what they were fitted to: the label in the first stage, twice the
    residual of the stages before (the negative gradient of the squared error) in the others."""
    wanted = F.expr("avg(if(stage = 0, label, 2D * (label - before)))")
    leaves = stage_rows(df, trees, label).groupBy("stage", "leaf", "value").agg(wanted.alias("mean"))
    return leaves.where(f"NOT coalesce(abs(value - mean) <= {num(tolerance)} * greatest(1D, abs(mean)), false)").count()


def wrong_forest_leaves(df: DataFrame, trees: Walk, label: Expr, tolerance: float = 1e-9) -> int:
    """Leaves outside the labels of the rows that reach them; each averages some of these."""
    inputs = select([], {"label": f"double({label})"})
    rows = trees.attached(spread(df)).selectExpr(*inputs, f"posexplode(transform({trees.stages()}, _e -> struct(_e.leaf, _e.value))) AS (tree, _e)")
    leaves = rows.groupBy("tree", "_e").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    return leaves.where(f"NOT _e.value BETWEEN low - {num(tolerance)} * greatest(1D, abs(low)) AND high + {num(tolerance)} * greatest(1D, abs(high))").count()
