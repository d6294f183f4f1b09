"""Fitting of centroids, codebooks and rotations on the first keys.

The sample is the first ``rows`` keys by row_id, a documented parameter, as in every index of this
kind; assignment and encoding then cover all keys. Centroids are fitted by distributed Lloyd steps
over the whole sample: tasks add up their rows by nearest centre, and a table of a row per centre
reaches the driver. Codebooks (256 codewords a sub-space at most) and rotations are fitted from at
most ``code_rows`` of these rows: the driver holds them, tasks fit the sub-spaces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmix.functions import vectors as V
from nearmix.operators import pq
from nearmix.operators.order import ranked
from nearmix.operators.topk import matrix
from nearmix.operators.transform import random_rotation
from nearmix.sources.shared import materialised

TRAIN_ROWS = 1_000_000
#: Rows that codebooks and rotations learn from, drawn by a hash of the row_id: 256 for each codeword.
CODE_ROWS = 1 << 16
#: Up to so many centres start from k-means++ draws, more from rows drawn by hash.
SPREAD_CENTRES = 1024


def first_rows(keys: DataFrame, rows: int = TRAIN_ROWS, metric: str = "l2") -> DataFrame:
    """(row_id, vec) of the first keys by row_id, stored."""
    ready = keys.select(F.col("row_id").cast("long").alias("row_id"), V.prepared("vec", metric).alias("vec")).where("vec IS NOT NULL")
    return materialised(ranked(ready, [F.col("row_id")], "_rank").where(F.col("_rank") < rows).select("row_id", "vec"), "sample")


def bounded(rows: DataFrame, most: int = CODE_ROWS) -> np.ndarray:
    """Vectors of ``most`` rows drawn by a hash of the row_id, all of them if there are fewer, by row_id."""
    total = rows.count()
    if not total:
        raise ValueError("no keys to train on")
    drawn = rows
    if total > most:
        drawn = rows.orderBy(F.xxhash64("row_id"), "row_id").limit(most)
    held = drawn.select("row_id", "vec").toArrow()
    order = np.argsort(held.column(0).to_numpy(), kind="stable")
    return np.stack(held.column(1).to_numpy()).astype(np.float64)[order]


def sample(keys: DataFrame, rows: int = TRAIN_ROWS, metric: str = "l2", most: int = CODE_ROWS) -> np.ndarray:
    """Vectors of at most ``most`` of the first ``rows`` keys by row_id."""
    return bounded(first_rows(keys, rows, metric), most)


def lloyd(points: DataFrame, k: int, rounds: int = 20, seed: int = 0) -> np.ndarray:
    """k centres of points(row_id, vec) by distributed Lloyd steps.

    A centre without a row moves beside the centre with most rows. Sums are rounded to 9 digits, so
    that the order in which tasks end doesn't show.
    """
    if k < 1:
        raise ValueError("at least one centre")
    start = bounded(points, max(k, min(CODE_ROWS, 256 * k)))
    if len(start) <= k:
        return np.concatenate((start, np.repeat(start[:1], k - len(start), 0)))
    if k <= SPREAD_CENTRES:
        centres = kmeans(start, k, 0, seed)
    else:
        centres = start[np.sort(np.random.default_rng(seed).choice(len(start), k, replace=False))]
    spark = points.sparkSession
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(centres)

        def add_up(batches, sent=sent):
            centres = sent.value
            sums, counts = np.zeros_like(centres), np.zeros(len(centres), np.int64)
            for batch in batches:
                x = matrix(batch.column(0))
                if len(x):
                    at, _ = nearest_centre(x, centres)
                    counts += np.bincount(at, minlength=len(centres))
                    np.add.at(sums, at, x)
            met = np.nonzero(counts)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(met, pa.int32()), pa.array(counts[met], pa.int64()), pa.array(list(sums[met]), pa.list_(pa.float64()))], names=["c", "n", "sums"]
            )

        parts = points.select("vec").mapInArrow(add_up, "c int, n long, sums array<double>")
        each = parts.select("c", "n", F.posexplode("sums").alias("i", "v")).groupBy("c", "i").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
        new, counts = centres.copy(), np.zeros(k, np.int64)
        told = each.toArrow()
        c, i, n, v = (told.column(x).to_numpy() for x in range(4))
        new[c, i] = np.round(v / n, 9)
        counts[c] = n
        sent.destroy()
        full = np.argsort(-counts, kind="stable")
        for turn, e in enumerate(np.nonzero(counts == 0)[0].tolist()):
            new[e] = new[full[turn % max(1, int((counts > 0).sum()))]] * (1 + 1e-4 * (turn + 1))
        if np.allclose(new, centres, atol=1e-9):
            return new
        centres = new
    return centres


def kmeans(x: np.ndarray, k: int, rounds: int = 20, seed: int = 0) -> np.ndarray:
    """k centres by Lloyd's iterations from k-means++ draws; empty centres take the rows farthest from theirs."""
    if k < 1:
        raise ValueError("at least one centre")
    if len(x) <= k:
        return np.concatenate((x, np.repeat(x[:1], k - len(x), 0)))
    rng = np.random.default_rng(seed)
    near = np.full(len(x), np.inf)
    picked = [int(rng.integers(len(x)))]
    for _ in range(k - 1):
        near = np.minimum(near, ((x - x[picked[-1]]) ** 2).sum(1))
        total = near.sum()
        picked.append(int(rng.choice(len(x), p=near / total)) if total > 0 else int(rng.integers(len(x))))
    centres = x[picked].copy()
    for _ in range(rounds):
        at, far = nearest_centre(x, centres)
        counts = np.bincount(at, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        if empty := np.nonzero(counts == 0)[0].tolist():
            new[empty] = x[np.argsort(-far)[: len(empty)]]
        if np.allclose(new, centres, atol=1e-9):
            return new
        centres = new
    return centres


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, far = np.empty(len(x), np.int64), np.empty(len(x))
    norms = (centres**2).sum(1)
    rows = max(1, min(4096, (1 << 23) // max(len(centres), 1)))  # 64 MB of distances at a time
    for i in range(0, len(x), rows):
        d = norms[None] - 2 * x[i : i + rows] @ centres.T
        at[i : i + rows] = d.argmin(1)
        far[i : i + rows] = d.min(1) + (x[i : i + rows] ** 2).sum(1)
    return at, far


def codebook(x: np.ndarray, n_sub: int, n_code: int = pq.CODEWORDS, rounds: int = 15, seed: int = 0, spark: SparkSession | None = None) -> np.ndarray:
    """Codewords of each sub-space; with ``spark``, each sub-space is fitted by a task of its own."""
    size = pq.sub_size(x.shape[1], n_sub)
    if spark is None:
        return np.stack([kmeans(x[:, m * size : (m + 1) * size], n_code, rounds, seed + m) for m in range(n_sub)])
    sent = spark.sparkContext.broadcast(x)

    def fit(m: int) -> np.ndarray:
        return kmeans(sent.value[:, m * size : (m + 1) * size], n_code, rounds, seed + m)

    made = np.stack(spark.sparkContext.parallelize(range(n_sub), n_sub).map(fit).collect())
    sent.destroy()
    return made


def rotation(
    x: np.ndarray, n_sub: int, to: int, n_code: int = pq.CODEWORDS, turns: int = 5, seed: int = 0, spark: SparkSession | None = None
) -> np.ndarray:
    """A rotation that lowers the quantisation error: codebook and rotation are fitted in turn.

    Published method (Ge et al., "Optimized Product Quantization", 2013): with codes fixed, the best
    rotation comes from the singular vectors of x' y.
    """
    if n_sub < 1:
        raise ValueError("a fitted rotation needs sub-vectors")
    a = random_rotation(x.shape[1], to, seed)
    for turn in range(turns):
        y = x @ a.T
        words = codebook(y, n_sub, n_code, 5, seed + turn, spark)
        u, _, w = np.linalg.svd(x.T @ pq.decoded(pq.codes_of(y, words), words), full_matrices=False)
        a = (u @ w).T
    return a
