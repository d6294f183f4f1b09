"""From raw documents to token ids in five stages, each with one of the corpus operators.

Every stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as
the next stage's docs. All stages but the last return the columns of documents. Before a stage the
executors return the heap that the stage before has left.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from nearmix.llm.common import Scratch, collect_garbage, table
from nearmix.llm.decontam import decontam_stage
from nearmix.llm.langid import langid_stage
from nearmix.llm.pieces import pieces_stage
from nearmix.llm.secrets import redact_stage
from nearmix.llm.simhash import dedup_stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _emptied(stage: Stage) -> Stage:
    """The stage, begun on executors without the garbage of the one before."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        collect_garbage(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("language_id", _emptied(langid_stage)),
    ("simhash_dedup", _emptied(dedup_stage)),
    ("decontamination", _emptied(decontam_stage)),
    ("secret_scan", _emptied(redact_stage)),
    ("sentencepiece", _emptied(pieces_stage)),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = scratch.store(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
