"""Exact nearest neighbours: the k best keys of each query, as a plan of local top-k and a merge.

Queries are a stated set held against all keys. They are read in blocks of bounded size; a block is
broadcast, every task keeps the k best of its own keys for each query while its batches pass, and
only k rows a task and query are shuffled to a window that merges them. A batch's distances come from
one matrix product; rows near the k-th value are then computed by direct differences, so values are
exact and ties go to the smaller row_id.

``reference_topk`` says the same in built-in expressions (a theta join); tests hold one to the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearmix.functions import vectors as V
from nearmix.sources.shared import materialised

QUERY_BLOCK = 4096
KEY_SLICE = 1024
#: Queries that meet a slice of keys at a time: what a task holds of distances doesn't grow with the block.
QUERY_SLICE = 512
NEIGHBOURS = "qid long, row_id long, raw double"


def matrix(lists: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column as a float64 matrix; all of one length."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    n = len(lists)
    if n and (len(flat) % n or len(np.unique(np.diff(lists.offsets.to_numpy()))) > 1):
        raise ValueError("vectors of different lengths")
    return flat.reshape(n, -1)


class Best:
    """The k best (value, row) so far of each of n queries; smaller values are better."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.values = np.full((n, k), np.inf)
        self.rows = np.full((n, k), np.iinfo(np.int64).max)

    def offer(self, at: int, values: np.ndarray, rows: np.ndarray) -> None:
        v, r = np.concatenate((self.values[at], values)), np.concatenate((self.rows[at], rows))
        order = np.lexsort((r, v))[: self.k]
        self.values[at], self.rows[at] = v[order], r[order]

    def table(self, qids: np.ndarray, sign: float) -> pa.RecordBatch:
        there = np.isfinite(self.values)
        q = np.repeat(qids, self.k).reshape(len(qids), self.k)[there]
        return pa.RecordBatch.from_arrays(
            [pa.array(q, pa.int64()), pa.array(self.rows[there], pa.int64()), pa.array(self.values[there] * sign, pa.float64())], names=["qid", "row_id", "raw"]
        )


#: Postings are stored in folders by this column: numbers of LISTS_PER_PART lists each.
LIST_PART = "list_part"
LISTS_PER_PART = 32


def offer_slice(
    best: Best, x: np.ndarray, rows: np.ndarray, q: np.ndarray, metric: str, which: np.ndarray | None = None, digits: int | None = None
) -> None:
    """Offer keys x to queries q: preselect by a matrix product, compute the rest exactly.

    which: places of q among the queries of ``best``; all of them, if not given. Distances are rounded
    to ``digits``. QUERY_SLICE queries are met at a time.
    """
    which = np.arange(len(q)) if which is None else which
    for at in range(0, len(q), QUERY_SLICE):
        _offer(best, x, rows, q[at : at + QUERY_SLICE], metric, which[at : at + QUERY_SLICE], digits)


def _offer(best: Best, x: np.ndarray, rows: np.ndarray, q: np.ndarray, metric: str, which: np.ndarray, digits: int | None) -> None:
    product = q @ x.T
    rough = (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * product if metric == "l2" else -product
    slack = 1e-9 * (1 + np.abs(rough).max()) if rough.size else 0.0
    if digits is not None:
        slack += 10.0**-digits
    k = min(best.k, rough.shape[1])
    local = np.partition(rough, k - 1, axis=1)[:, k - 1]
    bound = np.minimum(local, best.values[which, -1]) + slack
    for i in np.nonzero((rough <= bound[:, None]).any(1))[0].tolist():
        pick = np.nonzero(rough[i] <= bound[i])[0]
        exact = ((x[pick] - q[i]) ** 2).sum(1) if metric == "l2" else -(x[pick] * q[i]).sum(1)
        best.offer(int(which[i]), exact if digits is None else np.round(exact, digits), rows[pick])


def query_blocks(queries: DataFrame, size: int = QUERY_BLOCK) -> Iterator[list]:
    """Rows of queries in blocks, read by the driver one partition at a time."""
    block = []
    for r in queries.toLocalIterator():
        block.append(r)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def merged(parts: DataFrame, k: int, metric: str) -> DataFrame:
    """Local winners -> (qid, rank, row_id, score), rank from 1."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "row_id")
    scored = parts.withColumn("score", V.score(F.col("raw"), metric)).drop("raw")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", F.col("rank").cast("long").alias("rank"), "row_id", "score")


def nearest(
    queries: DataFrame,
    keys: DataFrame,
    k: int,
    metric: str = "l2",
    block: int = QUERY_BLOCK,
    decode: Callable[[np.ndarray, np.ndarray | None], np.ndarray] | None = None,
    digits: int | None = None,
) -> DataFrame:
    """queries(qid, vec), keys(row_id, vec) -> (qid, rank, row_id, score).

    If queries have ``lists`` (an array of list numbers) and keys ``list_id``, a query meets the keys
    of its lists only. ``decode`` makes vectors of what keys.vec holds (codes) and the list numbers.
    Rows without a vector take no part. ``digits``: distances are rounded so before they are compared,
    so that rows whose sums differ in their last digits tie, and the smaller row_id is first.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    V.known_metric(metric)
    spark = keys.sparkSession
    listed = "lists" in queries.columns
    stored = F.col("vec") if decode else V.prepared("vec", metric)
    own = [c for c in ("list_id", LIST_PART) if c in keys.columns]
    ready = keys.select(F.col("row_id").cast("long").alias("row_id"), stored.alias("vec"), *own).where("vec IS NOT NULL")
    asked = queries.select(F.col("qid").cast("long").alias("qid"), V.prepared("vec", metric).alias("vec"), *(["lists"] if listed else []))
    found, waiting, held = None, None, None
    for rows in query_blocks(asked.where("vec IS NOT NULL"), block):
        if waiting is not None:
            # What a block found is stored before the next is sent.
            stored_part = materialised(waiting, "block")
            found = stored_part if found is None else found.unionByName(stored_part)
            held.destroy()
        held = _sent(spark, rows, listed)
        waiting = _asked_for(ready, rows, listed).mapInArrow(_local(held, k, metric, decode, bool(own), digits), NEIGHBOURS)
    if waiting is None:
        return merged(spark.createDataFrame([], NEIGHBOURS), k, metric)
    return merged(waiting if found is None else found.unionByName(waiting), k, metric)


def without_own(found: DataFrame, k: int) -> DataFrame:
    """Neighbours less a query's own row, whose row_id is the qid; ranks close up and go to k."""
    own = F.max(F.when(F.col("row_id") == F.col("qid"), F.col("rank"))).over(Window.partitionBy("qid"))
    after = F.coalesce((F.col("rank") > own).cast("long"), F.lit(0))
    rest = found.withColumn("rank", (F.col("rank") - after).cast("long")).where("row_id <> qid")
    return rest.where(F.col("rank") <= k).select(*found.columns)


def _asked_for(keys: DataFrame, rows: list, listed: bool) -> DataFrame:
    """The keys of the lists that a block of queries asks for; on stored postings the scan is pruned by folder and by row group."""
    if listed:
        lists = sorted({n for r in rows for n in r["lists"] or []})
        if LIST_PART in keys.columns:
            keys = keys.where(F.col(LIST_PART).isin(sorted({n // LISTS_PER_PART for n in lists})))
        keys = keys.where(F.col("list_id").isin(lists))
    return keys.drop(LIST_PART)


def _sent(spark, rows: list, listed: bool):
    """A block of queries as a broadcast: ids, vectors and, by list, the places of the queries that ask for it."""
    of_list = None
    if listed:
        of_list = {}
        for i, r in enumerate(rows):
            for n in r["lists"] or []:
                of_list.setdefault(n, []).append(i)
        of_list = {n: np.array(v, np.int64) for n, v in of_list.items()}
    return spark.sparkContext.broadcast((np.array([r["qid"] for r in rows], np.int64), np.array([r["vec"] for r in rows], np.float64), of_list))


def _local(sent, k: int, metric: str, decode, has_list: bool, digits: int | None):
    """A task's keys, batch by batch -> its k best for each query."""

    def run(batches):
        qids, q, of_list = sent.value
        best = Best(len(qids), k)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column(0).to_numpy(zero_copy_only=False)
            held = matrix(batch.column(1))
            lists = batch.column(2).to_numpy(zero_copy_only=False) if has_list else None
            groups = [(np.arange(len(rows)), None)]
            if of_list is not None:
                groups = [(np.nonzero(lists == n)[0], of_list[n]) for n in np.unique(lists).tolist() if n in of_list]
            for mine, which in groups:
                for at in range(0, len(mine), KEY_SLICE):
                    pick = mine[at : at + KEY_SLICE]
                    x = held[pick] if decode is None else decode(held[pick], None if lists is None else lists[pick])
                    offer_slice(best, x, rows[pick], q if which is None else q[which], metric, which, digits)
        yield best.table(qids, 1.0 if metric == "l2" else -1.0)

    return run


def reference_topk(queries: DataFrame, keys: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """The definition in built-in expressions: every pair, then a window. For small inputs and tests."""
    asked = queries.select("qid", V.prepared("vec", metric).alias("q"))
    ready = keys.select("row_id", V.prepared("vec", metric).alias("x"))
    pairs = ready.join(asked, F.lit(True)).select("qid", "row_id", V.distance("q", "x", metric).alias("raw"))
    return merged(pairs, k, metric)


def distance_table(a: DataFrame, b: DataFrame, metric: str = "l2") -> DataFrame:
    """a(a_id, vec), b(b_id, vec) -> (a_id, b_id, raw): each row against each centre of a bounded table b."""
    left = a.select("a_id", V.prepared("vec", metric).alias("x"))
    right = b.select("b_id", V.prepared("vec", metric).alias("y"))
    return left.join(F.broadcast(right), F.lit(True)).select("a_id", "b_id", V.distance("x", "y", metric).alias("raw"))
