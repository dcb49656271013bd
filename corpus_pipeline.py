"""Corpus preparation: five stages over ``documents``, each written as Parquet and reread by the next.

Every stage sees all rows that its predecessor kept, and its decisions take effect. All but the
last return the columns of ``documents``; more columns pass through. For every stage an empty table
gives an empty result, and null or empty texts count as empty ones.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import exact_dedup, packing, pii, simhash, tables, toxicity
from tidewell.session import drop_path, materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold; each row is judged by its own text, whatever its id."""
    known = tables.labels(spark, sf_dir)
    model = toxicity.fit(docs, known.where(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest ``doc_id``; rows without an id come last.

    Rows are told apart by id and text, so of two rows that share an id only the copy goes.
    Of rows that repeat with id and text one stays.
    """
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group, the row with the smallest ``doc_id``; null and repeated ids as in ``drop_copies``."""
    return simhash.without_near_copies(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data replaced by tags; ``n_chars`` follows the new text (null for a null text)."""
    clean = pii.redact(pii.detect(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences; a null or empty text is one piece, rows that repeat are packed each."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("pii", redact_personal_data),
    ("packing", pack),
]

#: The toxicity model and the packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply ``STAGES`` to ``documents``; the stages between are Parquet tables in the shared folder."""
    docs, before = tables.documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs, path = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            drop_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
