"""The corpus operators' queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nearmix.llm import decontam, langid, licenses, pieces, secrets, simhash, tokencount, topk, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": licenses.op1_licenses,
        "op2_language_id": langid.op2_langid,
        "op3_token_counts": tokencount.op3_tokens,
        "op4_simhash_dedup": simhash.op4_simhash,
        "op5_decontamination": decontam.op5_decontamination,
        "op6_exact_topk": topk.op6_topk,
        "op7_warc": warc.op7_warc,
        "op8_secret_scan": secrets.op8_secrets,
        "op9_sentencepiece": pieces.op9_pieces,
        "op10_toxicity": toxicity.op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": licenses.oracle(),
        "op6_exact_topk": topk.OP6_SQL,
        "op7_warc": warc.OP7_SQL,
        "op8_secret_scan": secrets.oracle(),
    }
