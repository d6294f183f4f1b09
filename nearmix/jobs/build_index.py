"""spark-submit -m nearmix.jobs.build_index --keys keys --output index --ivf-lists 4096: fit an index and add all keys."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from nearmix.operators.index import IndexConfig, build_index, load_index
from nearmix.sources.shared import exists
from nearmix.sources.stores import KeyStore


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--keys", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--metric", default="l2")
    p.add_argument("--chunk-size", type=int, default=0, help="row ids a batch; 0: all at once")
    p.add_argument("--train-size", type=int, default=1_000_000)
    for name in ("hnsw-edges", "ivf-lists", "pq-subvec"):
        p.add_argument(f"--{name}", type=int, default=0)
    p.add_argument("--transform-dim", type=int, default=-1)
    p.add_argument("--use-opq", action="store_true")
    p.add_argument("--use-pca", action="store_true")
    p.add_argument("--mode", default="error", choices=["error", "overwrite"])
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    config = IndexConfig("spark", a.metric, a.hnsw_edges, a.ivf_lists, a.pq_subvec, a.transform_dim, a.use_opq, a.use_pca)
    keys = KeyStore(spark, a.keys).read()
    index = build_index(spark, a.output, config)
    if exists(spark, a.output + "/config.json") and a.mode != "overwrite":
        index = load_index(spark, a.output)
        if index.config != config:
            raise FileExistsError(f"another index is stored in {a.output}")
    else:
        index.fit(keys, a.train_size)
        index.save(overwrite=True)
    index.clear()
    if a.chunk_size <= 0:
        index.add(keys)
        return
    # A chunk is durable once it is written; what is read is pushed down by row_id.
    top = keys.agg(F.max("row_id")).first()[0]
    for n in range(0 if top is None else top // a.chunk_size + 1):
        index.add(keys.where((F.col("row_id") >= n * a.chunk_size) & (F.col("row_id") < (n + 1) * a.chunk_size)), n)


if __name__ == "__main__":
    main()
