"""spark-submit -m nearmix.jobs.store_keys --input corpus.txt --output keys --encoder hashing: a vector for each line."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from nearmix.functions import encoders
from nearmix.sources import stores


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--encoder", default="hashing")
    p.add_argument("--feature", default="avg", choices=encoders.FEATURES)
    p.add_argument("--compression", default="zstd")
    p.add_argument("--mode", default="error", choices=["error", "overwrite"])
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    rows = stores.lines(spark, a.input).select(F.col("seq_id").alias("row_id"), encoders.encode("text", a.encoder, a.feature).alias("vec"))
    stores.KeyStore(spark, a.output, compression=a.compression).write(rows, a.mode)


if __name__ == "__main__":
    main()
