"""A corpus pipeline: quality rules, language ID, near-dedup, secret scans, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and reread as the next stage's docs.  All but the last
return the columns of documents, whatever their names.

Defined results, stage by stage: a null, empty or blank text goes with the
quality rules; very long texts are read whole everywhere; ties are those of
the operators (smallest doc_id, then fingerprint, stays); of repeated rows one
stays, but rows with a null id all stay; an empty table passes as it is; the pieces at the end
carry the doc_id of their document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinblock.llm import langid, packing, quality, secrets, simhash
from kinblock.llm.common import staged, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the default policy rejects."""
    return quality.apply_policy(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents without a letter, and those whose language is told with a score below
    ``langid.MIN_SCORE``; without labels to learn from, only the former."""
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class of near copies: those whose sets of
    shingles have a cosine similarity of ``simhash.SIMILARITY`` or more, by fingerprints."""
    return simhash.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; no document goes."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token ids of the documents; one row per piece."""
    return packing.op5(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("pack", pack),
]

#: Token ids and the trained forest have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
