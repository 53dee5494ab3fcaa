"""Registered queries of the text operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm import decontamination, exact_dedup, language, licenses, merkle, packing, periodic_runs, quality, secret_scan, sharding, simhash, substring_dedup, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_path() -> str:
    """The vocabulary that packing uses; every executor has it at the same place."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.memberships(table(spark, sf, "documents"))


def op1_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), tokenizer_path())


def op10_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.report(table(spark, sf, "documents"))


def op2_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.classes(table(spark, sf, "documents"))


def op6_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard(table(spark, sf, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op9_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf, "documents"))


def op3_language_id(spark: SparkSession, sf: str) -> DataFrame:
    found = language.identify(table(spark, sf, "documents"), "text", declared="lang", host="source", keep=["doc_id"])
    return found.select("row.doc_id", "language", "confidence", "text_language", "accepted")


def op4_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op11_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    return periodic_runs.find(table(spark, sf, "documents"), prepare=periodic_runs.planted).drop("runs")


def op12_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    found = toxicity.detect(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", "evidence", F.size("passages").alias("n_passages"))


def op13_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.tamper_check(table(spark, sf, "documents")).drop("position")


def language_id_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The same operator on raw pages, which have markup, an address suffix and a host."""
    pages = table(spark, sf, "pages")
    bare = F.regexp_replace("html", "(?is)<(script|style).*?</\\1>|<!--.*?-->|<[^>]*>|&[a-z]+;", " ")
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1))
    found = language.identify(
        pages.select("page_id", "html", "url"),
        bare,
        declared=F.regexp_extract("html", '(?i)<html[^>]*\\blang="?([a-z]{2})', 1),
        host=host,
        suffix=F.substring_index(host, ".", -1),
        keep=["page_id"],
    )
    return found.select("row.page_id", "language", "confidence", "text_language", "accepted")


QUERIES: dict[str, Query] = {
    "op7_exact_dedup": op7_exact_dedup,
    "op1_best_fit_packing": op1_best_fit_packing,
    "op10_license_scan": op10_license_scan,
    "op2_secret_scan": op2_secret_scan,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_sharding": op6_sharding,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_substring_dedup": op9_substring_dedup,
    "op3_language_id": op3_language_id,
    "op4_quality_rules": op4_quality_rules,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_toxicity": op12_toxicity,
    "op13_merkle_manifest": op13_merkle_manifest,
    "language_id_pages": language_id_pages,
}


def crc32(text: str) -> str:
    """CRC-32 of an ASCII text in SQL: a fold that takes in a byte and shifts out its eight bits."""
    steps = f"flatten([[ord(c), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split({text}, '')])"
    fold = "lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) ELSE xor(acc >> 1, 3988292384 * (acc & 1)) END"
    return f"xor(list_reduce({steps}::BIGINT[], {fold}, 4294967295::BIGINT), 4294967295)"


ORACLE: dict[str, str] = {
    "op7_exact_dedup": """
        WITH d AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
            FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id,
               count(*) OVER (PARTITION BY h) AS group_size,
               row_number() OVER (PARTITION BY h ORDER BY doc_id DESC) = 1 AS kept,
               h AS text_sha256
        FROM d""",
    # levels are lists; a proof step is the text "left|right", so that one fold over texts recomputes the root
    "op13_merkle_manifest": f"""
        WITH RECURSIVE rows AS (
            SELECT doc_id, source, text,
                   CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END
                   || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
                   || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END
                   || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END AS head
            FROM documents),
        hashed AS (
            SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i,
                   sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
                   replace(text, chr(10), '') AS cut, head, text, {crc32('doc_id::VARCHAR')} AS crc
            FROM rows),
        levels AS (
            SELECT source, 0 AS k, list(leaf ORDER BY i) AS nodes FROM hashed GROUP BY source
            UNION ALL
            SELECT source, k + 1, [sha256(array_to_string(nodes[3 * j + 1 : 3 * j + 3], '')) FOR j IN range((len(nodes) + 2) // 3)]
            FROM levels WHERE len(nodes) > 1),
        subroots AS (
            SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i
            FROM levels WHERE len(nodes) = 1),
        upper AS (
            SELECT 0 AS k, list(subroot ORDER BY i) AS nodes FROM subroots
            UNION ALL
            SELECT k + 1, [sha256(array_to_string(nodes[3 * j + 1 : 3 * j + 3], '')) FOR j IN range((len(nodes) + 2) // 3)]
            FROM upper WHERE len(nodes) > 1),
        steps AS (
            SELECT h.source, h.i, l.k AS k, l.nodes, h.i // (3 ** l.k)::BIGINT AS place
            FROM hashed h JOIN levels l ON l.source IS NOT DISTINCT FROM h.source WHERE len(l.nodes) > 1
            UNION ALL
            SELECT h.source, h.i, 1000 + u.k, u.nodes, s.i // (3 ** u.k)::BIGINT
            FROM hashed h JOIN subroots s ON s.source IS NOT DISTINCT FROM h.source CROSS JOIN upper u WHERE len(u.nodes) > 1),
        proofs AS (
            SELECT source, i, list(array_to_string(nodes[place - place % 3 + 1 : place], '') || '|'
                                   || array_to_string(nodes[place + 2 : place - place % 3 + 3], '') ORDER BY k) AS path
            FROM steps GROUP BY source, i),
        joined AS (
            SELECT h.*, s.subroot, (SELECT nodes[1] FROM upper WHERE len(nodes) = 1) AS root, coalesce(p.path, []) AS path
            FROM hashed h JOIN subroots s ON s.source IS NOT DISTINCT FROM h.source
            LEFT JOIN proofs p ON p.source IS NOT DISTINCT FROM h.source AND p.i = h.i),
        folded AS (
            SELECT doc_id, leaf, subroot, root, path, list_reduce(list_prepend(CASE WHEN crc % 2 = 0 THEN sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(cut) || ':' || cut END) ELSE leaf END, path),
                                  lambda acc, s: sha256(split_part(s, '|', 1) || acc || split_part(s, '|', 2))) AS folded_root
            FROM joined)
        SELECT doc_id, leaf, subroot, root, folded_root, folded_root = root AS verified,
               sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256
        FROM folded""",
}
