"""Corpus pipeline: language, exact copies, near copies, benchmark leaks, packing.

Every stage works on all that its predecessor kept, and its decisions take effect. All stages but the last
return the columns of ``documents``. Null and empty texts go in the first stage, for lack of a language.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gridweave.llm import decontamination, exact_dedup, language, packing, simhash  # noqa: E402
from gridweave.llm.common import stored  # noqa: E402
from gridweave.llm.queries import table, tokenizer_path  # noqa: E402

#: Words in a shingle and differing bits of the near-copy stage, those of the operator's own query.
SHINGLE, DISTANCE = 4, 4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear stay; ``lang`` is the declared language, ``source`` the host."""
    return language.keep_identified(docs, "text", "lang", "source")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays: the one with the largest id."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: the one with the smallest id."""
    return simhash.keep_one(docs, shingle=SHINGLE, distance=DISTANCE)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every remaining document with its sequence and offset."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language identification", identify_language),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("best-fit packing", pack_sequences),
]

#: Fingerprints and token ids have no SQL form; tests/llm/test_pipeline.py checks by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; every stage but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
