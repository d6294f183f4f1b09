"""spark-submit -m nearmix.jobs.store_values --input corpus.txt --output values: a corpus of lines as token storage."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from nearmix.operators import tokens
from nearmix.sources import stores


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--vocab", help="where the vocabulary is read from, or written to if it isn't there")
    p.add_argument("--least", type=int, default=1, help="times a word has to occur to be in a new vocabulary")
    p.add_argument("--mode", default="error", choices=["error", "overwrite"])
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    corpus = stores.lines(spark, a.input)
    where = a.vocab or a.output + "-vocab"
    if not stores.exists(spark, where):
        tokens.vocabulary(corpus, a.least).write.parquet(where)
    stores.save_storage(tokens.storage(tokens.sequences(corpus, spark.read.parquet(where), eos=True)), a.output, a.mode)


if __name__ == "__main__":
    main()
