"""Merkle manifest of a dataset: one digest for all rows, one proof for each row.

Every row is a leaf: the SHA-256 of its fields, each written as its length in bytes, a colon and its value,
``-`` where it is null. The leaves of a group (a source) ascend by id; ``arity`` consecutive nodes become
the digest of their concatenated digests, level by level, until one node is left, the subroot. The subroots,
ordered by group, give the root in the same way.

1. Leaves get their place in the group without a window over it: they are sorted by range, numbered inside
   each partition, and the partition counts of each group are added up.
2. A level is a self join with shifted places: a node looks up its siblings at computed indices (XOR for
   binary trees, offsets from the slot otherwise). The nodes of slot zero emit the parents. Keys are
   (group, index), which no two nodes share, so a group with a third of all rows is dealt out evenly.
3. Proofs go down the same way: a node takes over the siblings of its parent by one join a level and puts
   its own in front.

The driver holds the number of levels and the root. Each level is a written table.

Null is a value of its own in every field; a null group comes first, and so does a null id in its group.
Equal ids are ordered by the rest of the row, repeated rows are leaves of their own. A group of one row has
its leaf as subroot, and a table of one group has the subroot as root. An empty table gives an empty result.
Long texts are hashed as a whole inside one expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.common import stored

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Low bits of ``monotonically_increasing_id`` that count rows; the high ones are the partition.
ROW_BITS = 33


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """Length in bytes and value, or ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def named(name: str) -> Column:
    return F.col(f"`{name}`")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``idx``, the place from 0 among the rows of one ``grp`` by ``order``, and ``n``, their number.

    ``order`` must be total. The sort deals even one group over many partitions.
    """
    by = ["grp", *order]
    placed = stored(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    placed = placed.withColumn("_part", F.shiftright("_at", ROW_BITS))
    parts = placed.groupBy("grp", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    group = Window.partitionBy("grp")
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")
    offsets = parts.select("grp", "_part", shift.alias("_shift"), F.sum("_n").over(group).alias("n"))
    joined = placed.join(stored(offsets, "offsets"), ["grp", "_part"])
    return joined.withColumn("idx", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def sibling(idx: Column, offset: int, arity: int) -> Column:
    """Index of the sibling that stands ``offset`` slots further, around the end of the run."""
    if arity == 2:
        return idx.bitwiseXOR(F.lit(1))
    slot = idx % arity
    return idx - slot + (slot + offset) % arity


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes (grp, idx, n, h) with ``left`` and ``right``, the digests of the siblings on either side."""
    shifts = range(1, arity)
    found = nodes.select("*", *[sibling(F.col("idx"), j, arity).alias(f"_i{j}") for j in shifts])
    for j in shifts:
        other = nodes.select(F.col("grp").alias("_g"), F.col("idx").alias("_i"), F.col("h").alias(f"_h{j}"))
        found = found.join(other, (F.col("grp") == F.col("_g")) & (F.col(f"_i{j}") == F.col("_i")), "left").drop("_g", "_i")

    def beside(before: bool) -> Column:
        # offsets that go around the end are slots before the own one; both kinds ascend with the offset
        around = [((F.col("idx") % arity + j >= arity) == F.lit(before), F.col(f"_h{j}")) for j in shifts]
        return F.concat(*[F.when(side & h.isNotNull(), h).otherwise("") for side, h in around])

    return found.select("grp", "idx", "n", "h", beside(True).alias("left"), beside(False).alias("right"))


@dataclass(frozen=True)
class Tree:
    """Levels from the leaves up: nodes with siblings, and the tops (one node left) that end at each."""

    levels: list[DataFrame]
    tops: list[DataFrame]
    arity: int

    def top_nodes(self) -> DataFrame:
        """(grp, h) of every group."""
        found = self.tops[0].select("grp", "h")
        for more in self.tops[1:]:
            found = found.unionByName(more.select("grp", "h"))
        return found

    def paths(self, above: DataFrame) -> DataFrame:
        """(grp, idx, path, top) of every leaf, path being its siblings from the leaf up.

        ``above`` (grp, path) is what follows above the top of each group.
        """
        found = None
        for number in range(len(self.tops) - 1, -1, -1):
            tops = self.tops[number].join(above, "grp").select("grp", "idx", "path", F.col("h").alias("top"))
            if found is None:
                found = tops
            else:
                parents = stored(found, "paths").select(F.col("grp").alias("_g"), F.col("idx").alias("_i"), "path", "top")
                below = self.levels[number].join(parents, (F.col("grp") == F.col("_g")) & F.expr(f"idx div {self.arity} = _i"))
                step = F.concat(F.array(F.struct("left", "right")), F.col("path"))
                found = below.select("grp", "idx", step.alias("path"), "top").unionByName(tops)
        return found


def build(leaves: DataFrame, arity: int = ARITY) -> Tree:
    """The trees of all groups of ``leaves`` (grp, idx, n, h), all groups at once."""
    largest = leaves.agg(F.max("n")).first()[0] or 0
    levels, tops, nodes = [], [], leaves.select("grp", "idx", "n", "h")
    while True:
        tops.append(nodes.where("n = 1"))
        if largest <= 1:
            return Tree(levels, tops, arity)
        level = stored(with_siblings(nodes.where("n > 1"), arity), "level")
        levels.append(level)
        nodes = level.where(F.col("idx") % arity == 0).select(
            "grp",
            F.expr(f"idx div {arity}").alias("idx"),
            F.expr(f"(n + {arity - 1}) div {arity}").alias("n"),
            digest(F.col("h"), F.col("right")).alias("h"),
        )
        largest = -(-largest // arity)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda found, step: digest(step["left"], found, step["right"]))


NO_PATH = "cast(array() AS array<struct<left: string, right: string>>)"


def manifest(
    docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_column: str = "doc_id", group: str = "source", arity: int = ARITY, changed: dict[str, Column] | None = None
) -> DataFrame:
    """One row per row of ``docs``: id, leaf, position, subroot, root, path (siblings left and right of the
    way up, level by level), and ``changed_leaf``, the leaf with the columns in ``changed`` put in their place."""
    shown = [field(named(f)) for f in fields]
    other = [field((changed or {}).get(f, named(f))) for f in fields]
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), named(group).cast("string")), F.lit("")).alias("grp"),  # null first, then by bytes
        named(id_column).cast("long").alias("_id"),
        digest(*shown).alias("h"),
        digest(*other).alias("_changed"),
        F.monotonically_increasing_id().alias("_row"),
    )
    leaves = stored(numbered(stored(rows, "leaves"), ["_id", "h", "_row"]), "numbered")
    trees = build(leaves, arity)
    subroots = stored(trees.top_nodes().select(F.lit(0).alias("grp"), F.col("grp").alias("_name"), "h"), "subroots")
    subroots = stored(numbered(subroots, ["_name"]), "subroots-numbered")
    upper = build(subroots, arity)
    top = upper.top_nodes().first()
    root = F.lit(top["h"] if top else None).cast("string")
    ends = stored(upper.paths(subroots.select("grp").distinct().withColumn("path", F.expr(NO_PATH))), "upper-paths")
    above = subroots.join(ends, ["grp", "idx"]).select(F.col("_name").alias("grp"), "path")
    paths = trees.paths(stored(above, "above"))
    return leaves.join(paths, ["grp", "idx"]).select(
        F.col("_id").alias(id_column),
        F.col("h").alias("leaf"),
        F.col("idx").alias("position"),
        F.col("top").alias("subroot"),
        root.alias("root"),
        "path",
        F.col("_changed").alias("changed_leaf"),
    )


def tamper_check(docs: DataFrame, id_column: str = "doc_id", text: str = "text", fields: tuple[str, ...] = FIELDS, group: str = "source", arity: int = ARITY) -> DataFrame:
    """The manifest with a test of its proofs: line ends are deleted from the text of every row whose id has
    an even CRC-32 (a null id has none), and the root is computed again from the leaf and its siblings.

    id, leaf, subroot, root, proof_sha256, folded_root, verified, position.
    """
    even = F.crc32(named(id_column).cast("long").cast("string").cast("binary")) % 2 == 0
    without = F.when(even, F.replace(named(text), F.lit("\n"), F.lit(""))).otherwise(named(text))
    rows = manifest(docs, fields, id_column, group, arity, {text: without})
    siblings = F.concat_ws("", F.transform("path", lambda step: F.concat(step["left"], step["right"])))
    folded = rows.select(
        id_column, "leaf", "subroot", "root", digest(siblings).alias("proof_sha256"), fold(F.col("changed_leaf"), F.col("path")).alias("folded_root"), "position"
    )
    return folded.select(id_column, "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "position")
