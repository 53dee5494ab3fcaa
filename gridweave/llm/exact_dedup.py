"""Exact dedup with a heavy-hitter split.

Texts are equal when they are identical after lower-casing A-Z. Misra-Gries counters find the digests
that may be frequent. Their exact sizes and winners are computed and broadcast (at most ``1 / support``
rows), and the losers of those groups are settled in the map tasks. All other digests, each rarer than
``support`` of the rows, go through an ordinary shuffle. Only DataFrame functions are used.

Null text counts as empty. Of rows that repeat the winning id one stays. A row without an id can only
stay where no equal text has one. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.common import ascii_lower, stored, text_or_empty

#: A digest held by more than this share of the rows is surely among the Misra-Gries candidates.
SUPPORT = 0.001


def with_digest(docs: DataFrame, text: str, *columns: str) -> DataFrame:
    """``columns`` and the SHA-256 of the normalised text."""
    return docs.select(*columns, F.sha2(ascii_lower(text_or_empty(text)), 256).alias("_digest"))


def heavy_winners(digests: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(_digest, _heavy_id, _heavy_size) of every digest with at least ``support`` of the rows.

    ``freqItems`` keeps ``1 / support`` Misra-Gries counters per task and merges them: it misses no
    frequent digest but may name rare ones, so a second pass counts the candidates.
    """
    least = digests.count() * support
    candidates = digests.stat.freqItems(["_digest"], support).select(
        F.explode("_digest_freqItems").alias("_digest")
    )
    return (
        digests.join(F.broadcast(candidates), "_digest")
        .groupBy("_digest")
        .agg(F.max("_id").alias("_heavy_id"), F.count("*").alias("_heavy_size"))
        .where((F.col("_heavy_size") >= least) & F.col("_heavy_id").isNotNull())
    )


def _split(rows: DataFrame, winners: DataFrame) -> DataFrame:
    """Rows with the winner of their heavy group; ``_loser`` marks rows settled without a shuffle."""
    joined = rows.join(F.broadcast(winners), "_digest", "left")
    return joined.withColumn("_loser", F.coalesce(F.col("_id") != F.col("_heavy_id"), F.col("_heavy_id").isNotNull()))


def memberships(docs: DataFrame, id_column: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256."""
    named = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text"))
    digests = stored(with_digest(named, "_text", "_id"), "digests")
    winners = stored(heavy_winners(digests, support), "winners")
    rows = _split(digests, winners)
    group = Window.partitionBy("_digest")
    rest = (
        rows.where(~F.col("_loser"))
        .withColumn("_rank", F.row_number().over(group.orderBy(F.col("_id").desc_nulls_last())))
        .select(
            "_id",
            F.max("_id").over(group).alias("_keep"),
            F.coalesce("_heavy_size", F.count("*").over(group)).alias("_size"),
            (F.col("_rank") == 1).alias("_kept"),
            "_digest",
        )
    )
    losers = rows.where("_loser").select(
        "_id", F.col("_heavy_id").alias("_keep"), F.col("_heavy_size").alias("_size"), F.lit(False).alias("_kept"), "_digest"
    )
    return losers.unionByName(rest).select(
        F.col("_id").alias(id_column),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.col("_kept").alias("kept"),
        F.col("_digest").alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_column: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs``, all columns, one for each text.

    Losers of heavy groups leave in the map tasks; whole rows are shuffled for the others only.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col(id_column).alias("_id"),
        F.col(text).alias("_text"),
    )
    digests = stored(with_digest(rows, "_text", "_id"), "digests")
    winners = stored(heavy_winners(digests, support), "winners")
    light = _split(with_digest(rows, "_text", "_row", "_id"), winners).where(~F.col("_loser"))
    first = F.row_number().over(Window.partitionBy("_digest").orderBy(F.col("_id").desc_nulls_last()))
    return light.withColumn("_rank", first).where("_rank = 1").select("_row.*")
