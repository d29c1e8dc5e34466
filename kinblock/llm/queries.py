"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, langid, licences, packing, quality, secrets, simhash, tokenfile, topk, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_license_scan": lambda s, d: licences.op1(table(s, d, "documents")),
        "op2_language_id": lambda s, d: langid.op2(table(s, d, "documents")),
        "op3_token_ids": lambda s, d: tokenfile.op3(table(s, d, "documents")),
        "op4_secret_scan": lambda s, d: secrets.op4(table(s, d, "documents")),
        "op5_packing": lambda s, d: packing.op5(table(s, d, "documents")),
        "op6_bpe": lambda s, d: bpe.op6(table(s, d, "documents")),
        "op7_exact_topk": lambda s, d: topk.op7(table(s, d, "embeddings")),
        "op8_warc": lambda s, d: warc.op8(table(s, d, "pages")),
        "op9_quality_rules": lambda s, d: quality.op9(table(s, d, "documents")),
        "quality_ablation": lambda s, d: quality.quality_ablation(table(s, d, "documents")),
        "op10_simhash": lambda s, d: simhash.op10(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_topk": topk.OP7_SQL, "op8_warc": warc.OP8_SQL, "op9_quality_rules": quality.OP9_SQL, "quality_ablation": quality.ABLATION_SQL}
