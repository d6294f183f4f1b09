"""Inverted lists: keys are dealt to their nearest centroid, a query reads the lists of its nearest centroids.

Keys are assigned in one map without a shuffle, and leave it with their vectors; centroids are sent
whole, at most CENTROID_NUMBERS numbers, and met block by block. A search never shuffles vectors
either: a block of queries goes to the tasks, the scan reads the lists that the block asks for, and
each task hands on k rows a query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearmix.functions import vectors as V
from nearmix.operators import pq
from nearmix.operators.topk import Best, matrix, nearest, offer_slice

#: Centroids that a task holds against a slice of points at a time.
CENTROID_BLOCK = 16_384
#: Numbers (lists x dimensions) of a table of centroids: 1 GB.
CENTROID_NUMBERS = 1 << 27


def nearest_centroids(points: DataFrame, centroids: DataFrame, k: int, metric: str = "l2", key: str = "row_id", with_vec: bool = False) -> DataFrame:
    """points(key, vec), centroids(list_id, centroid) -> (key, rank, list_id, raw): k nearest, ties to the smaller list.

    ``with_vec`` adds the points' vectors as they were given.
    """
    if k < 1:
        raise ValueError("at least one centroid must be asked for")
    V.known_metric(metric)
    kinds = dict(points.dtypes)
    ids, centres = centroid_arrays(centroids, metric)
    if not len(ids):
        raise ValueError("no centroids")
    sent = points.sparkSession.sparkContext.broadcast((ids, centres))
    schema = f"`{key}` {kinds[key]}, rank long, list_id int, raw double" + (f", vec {kinds['vec']}" if with_vec else "")
    ready = points.select(key, V.prepared("vec", metric).alias("_ready"), *(["vec"] if with_vec else [])).where("_ready IS NOT NULL")
    sign = 1.0 if metric == "l2" else -1.0

    def run(batches):
        ids, centres = sent.value
        for batch in batches:
            x = matrix(batch.column(1))
            best = Best(len(x), k)
            for at in range(0, len(x), 512):
                which = np.arange(at, min(at + 512, len(x)))
                for block in range(0, len(ids), CENTROID_BLOCK):
                    offer_slice(best, centres[block : block + CENTROID_BLOCK], ids[block : block + CENTROID_BLOCK], x[which], metric, which)
            there = np.isfinite(best.values)
            place, ranks = np.nonzero(there)
            arrays = [batch.column(0).take(pa.array(place)), pa.array(ranks + 1, pa.int64()), pa.array(best.rows[there], pa.int32()), pa.array(best.values[there] * sign, pa.float64())]
            names = [key, "rank", "list_id", "raw"]
            if with_vec:
                arrays.append(batch.column(2).take(pa.array(place)))
                names.append("vec")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return ready.mapInArrow(run, schema)


def centroid_arrays(centroids: DataFrame, metric: str = "l2") -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the lists, in order, and their centroids."""
    rows = sorted(centroids.select("list_id", V.prepared("centroid", metric).alias("c")).toLocalIterator(), key=lambda r: r["list_id"])
    if rows and len(rows) * len(rows[0]["c"]) > CENTROID_NUMBERS:
        raise ValueError(f"more than {CENTROID_NUMBERS} numbers of centroids")
    return np.array([r["list_id"] for r in rows], np.int64), np.array([r["c"] for r in rows], np.float64)


def assign(keys: DataFrame, centroids: DataFrame, metric: str = "l2") -> DataFrame:
    """keys(row_id, vec) -> (row_id, list_id)."""
    return nearest_centroids(keys, centroids, 1, metric).select("row_id", "list_id")


def probe(queries: DataFrame, centroids: DataFrame, nprobe: int, metric: str = "l2") -> DataFrame:
    """queries(qid, vec) -> (qid, rank, list_id)."""
    if nprobe < 1:
        raise ValueError("nprobe must be at least 1")
    return nearest_centroids(queries, centroids, nprobe, metric, "qid").select("qid", "rank", "list_id")


def postings(keys: DataFrame, centroids: DataFrame, metric: str = "l2") -> DataFrame:
    """keys(row_id, vec) -> (row_id, list_id, vec), a row per key with a vector."""
    return nearest_centroids(keys, centroids, 1, metric, with_vec=True).select("row_id", "list_id", "vec")


def residual_codes(posted: DataFrame, centroids: np.ndarray, codebook: np.ndarray) -> DataFrame:
    """postings(row_id, list_id, vec) -> (row_id, list_id, vec): codes of what the list's centroid leaves."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                lists = batch.column(1).to_numpy(zero_copy_only=False)
                code = pq.codes_of(matrix(batch.column(2)) - centroids[lists], codebook)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pq._array_of(code, pa.int16())], names=["row_id", "list_id", "vec"])

    return posted.select("row_id", "list_id", V.doubles("vec").alias("vec")).mapInArrow(run, "row_id long, list_id int, vec array<smallint>")


def residual_decoder(centroids: np.ndarray, codebook: np.ndarray):
    return lambda codes, lists: pq.decoded(codes, codebook) + centroids[lists]


def search(queries: DataFrame, posted: DataFrame, centroids: DataFrame, k: int, nprobe: int, metric: str = "l2", decode=None, digits: int | None = None) -> DataFrame:
    """queries(qid, vec), postings(row_id, list_id, vec) -> (qid, rank, row_id, score); fewer than k rows where the lists hold fewer."""
    probed = probe(queries, centroids, nprobe, metric).groupBy("qid").agg(F.collect_list("list_id").alias("lists"))
    return nearest(queries.join(probed, "qid"), posted, k, metric, decode=decode, digits=digits)


def list_sizes(posted: DataFrame, centroids: DataFrame) -> DataFrame:
    """(list_id, n) for every centroid, empty lists included."""
    counted = posted.groupBy("list_id").agg(F.count("*").alias("n"))
    return centroids.select("list_id").join(counted, "list_id", "left").select("list_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
