"""The registered queries of this subpackage, each over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import bpe, chat_format, conversation_repair, exact_dedup, license_scan, line_dedup, packing, periodic_runs, pii, quality, quality_rules, simhash, tables, toxicity


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.encode(tables.documents(spark, sf_dir).select("doc_id", "text"), ranks, pattern).drop("text")
    decoded = bpe.decode(encoded, ranks, pattern)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(tables.documents(spark, sf_dir))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(tables.documents(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(tables.documents(spark, sf_dir), tables.labels(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.documents(spark, sf_dir)
    return quality_rules.judge(docs, quality_rules.fit(docs, tables.labels(spark, sf_dir)))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(tables.documents(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(tables.documents(spark, sf_dir).select("doc_id", "text"))
    deleted = F.array_join(F.transform("deleted", lambda x: x.cast("string")), ",")
    return kept.select("doc_id", F.size("deleted").cast("long").alias("n_deleted"), deleted.alias("deleted"), F.sha2(tables.whole_text(), 256).alias("kept_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(tables.documents(spark, sf_dir), tables.labels(spark, sf_dir))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(tables.documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    counts = [F.size(F.filter("pii", pii.is_kind(k))).cast("long").alias(f"n_{k}") for k in pii.BASE]
    base = F.filter("pii", pii.is_kind(*pii.BASE))
    scores = F.array_join(F.transform("pii", lambda x: F.round(x["score"], 2).cast("string")), ",")  # of the spans, in their order
    return found.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("pii")).alias("spans"), scores.alias("scores"))


def op10_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(tables.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(tables.conversations(spark, sf_dir), conversation_repair.damaged)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.documents(spark, sf_dir).select("doc_id", "text")
    return periodic_runs.summary(periodic_runs.periodic_runs(docs, change=periodic_runs.planted))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = chat_format.log_of(chat_format.with_probe(tables.conversations(spark, sf_dir)))
    return chat_format.read_back(chat_format.format_log(log))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") or name == "pipeline"}


OP2_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM n
"""


OP13_SQL = r"""
WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
              UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
turns AS (SELECT *, regexp_replace(text, '([<[])(\\*)(/?s>|/?INST\]|ANS\]|/?ROLE\]|END\])', '\1\\\2\3', 'g') AS escaped FROM said)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(escaped) + CASE role WHEN 'user' THEN 16 WHEN 'assistant' THEN 9 ELSE 21 + length(role) END)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op4_license_scan": license_scan.oracle_sql(), "op7_line_dedup": line_dedup.ORACLE_SQL, "op13_chat_format": OP13_SQL}
