"""Linear maps of vectors before they are indexed: rotations, PCA, and rotations fitted to a codebook.

A map is a matrix of at most a few thousand numbers a side; it is sent to the tasks with the kernel.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearmix.functions import vectors as V
from nearmix.operators import pq


def apply(df: DataFrame, matrix: np.ndarray | None, bias: np.ndarray | None = None, key: str = "row_id") -> DataFrame:
    """(key, vec) with matrix @ vec + bias; vectors stay where there is no matrix."""
    if matrix is None:
        return df.select(key, V.doubles("vec").alias("vec"))
    return pq.map_vectors(df.select(key, V.doubles("vec").alias("vec")), [key], "vec", "vec", "double", lambda x: x @ matrix.T + (0 if bias is None else bias))


def undo(df: DataFrame, matrix: np.ndarray | None, bias: np.ndarray | None = None, key: str = "row_id") -> DataFrame:
    """The inverse of ``apply`` for a matrix with orthonormal rows."""
    if matrix is None:
        return df.select(key, V.doubles("vec").alias("vec"))
    return pq.map_vectors(df.select(key, V.doubles("vec").alias("vec")), [key], "vec", "vec", "double", lambda x: (x - (0 if bias is None else bias)) @ matrix)


def moments(keys: DataFrame, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and covariance of keys(vec), from one row of sums for each task."""
    import pyarrow as pa

    from nearmix.operators.topk import matrix

    def add_up(batches):
        n, total, square = 0, np.zeros(dim), np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                n, total, square = n + len(x), total + x.sum(0), square + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[*total, *square.ravel()]], pa.list_(pa.float64()))], names=["n", "sums"])

    parts = keys.where("vec IS NOT NULL").select(V.doubles("vec").alias("vec")).mapInArrow(add_up, "n long, sums array<double>")
    n, sums = 0, np.zeros(dim + dim * dim)
    for r in parts.toLocalIterator():
        n, sums = n + r["n"], sums + np.array(r["sums"])
    mean = sums[:dim] / max(n, 1)
    return n, mean, sums[dim:].reshape(dim, dim) / max(n, 1) - np.outer(mean, mean)


def pca(keys: DataFrame, dim: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, bias) onto the ``to`` directions of largest variance; each direction's largest number is positive."""
    if not 1 <= to <= dim:
        raise ValueError(f"PCA keeps 1 to {dim} numbers")
    _, mean, covariance = moments(keys, dim)
    values, vectors = np.linalg.eigh(covariance)
    a = vectors[:, np.argsort(-values)[:to]].T
    a *= np.sign(a[np.arange(to), np.abs(a).argmax(1)])[:, None]
    return a, -(a @ mean)


def random_rotation(dim: int, to: int, seed: int = 0) -> np.ndarray:
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q[:to]


def is_orthonormal(matrix: np.ndarray, within: float = 1e-9) -> bool:
    return bool(np.abs(matrix @ matrix.T - np.eye(len(matrix))).max() < within)


def normalised(df: DataFrame, key: str = "row_id") -> DataFrame:
    return df.select(key, V.normalized("vec").alias("vec")).where(F.col("vec").isNotNull())
