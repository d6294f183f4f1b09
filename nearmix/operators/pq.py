"""Product quantisation: vectors cut into sub-vectors, each stored as the number of its nearest codeword.

A codebook is a table (m, c, centroid), at most CODEWORDS rows for each of m sub-spaces, so it is
bounded and travels to tasks as an array. Codes are array<smallint>, as a code of one byte has no
unsigned type. Ties go to the smaller codeword.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmix.functions import vectors as V
from nearmix.operators.topk import NEIGHBOURS, QUERY_BLOCK, QUERY_SLICE, Best, matrix, merged, query_blocks
from nearmix.sources.shared import materialised

CODEWORDS = 256
CODEBOOK = "m int, c int, centroid array<double>"
#: Codes that meet a slice of queries at a time.
CODE_SLICE = 4096


def as_array(codebook: DataFrame) -> np.ndarray:
    """The codebook as (sub-spaces, codewords, numbers of a sub-vector); checked to be complete."""
    rows = sorted(codebook.select("m", "c", "centroid").collect(), key=lambda r: (r["m"], r["c"]))
    if not rows:
        raise ValueError("an empty codebook")
    n_sub, n_code = rows[-1]["m"] + 1, max(r["c"] for r in rows) + 1
    if n_code > CODEWORDS or len(rows) != n_sub * n_code:
        raise ValueError(f"a codebook needs the same codewords, {CODEWORDS} at most, in each sub-space")
    return np.array([r["centroid"] for r in rows], np.float64).reshape(n_sub, n_code, -1)


def as_table(spark: SparkSession, codebook: np.ndarray) -> DataFrame:
    rows = [(m, c, [float(x) for x in w]) for m, words in enumerate(codebook) for c, w in enumerate(words)]
    return spark.createDataFrame(rows, CODEBOOK)


def group_means(rows: DataFrame, group: str, dim: int, digits: int | None = None) -> DataFrame:
    """rows(group, vec) -> (group, mean array<double>): one pass, combined on the map side."""
    v = V.doubles("vec")
    sums = rows.groupBy(group).agg(*[F.avg(F.get(v, F.lit(i))).alias(f"x{i}") for i in range(dim)])
    told = [F.col(f"x{i}") if digits is None else F.round(f"x{i}", digits) for i in range(dim)]
    return sums.select(group, F.array(*told).alias("mean"))


def group_codebook(rows: DataFrame, group: str, dim: int, n_sub: int, digits: int | None = None) -> DataFrame:
    """A codebook without iterations: in each sub-space the mean of each group; groups are numbered from 0."""
    size = sub_size(dim, n_sub)
    means = group_means(rows.where(F.col(group).isNotNull()), group, dim, digits)
    each = means.select(F.col(group).cast("int").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(n_sub - 1))).alias("m"), "mean")
    return each.select("m", "c", F.slice("mean", F.col("m") * size + 1, F.lit(size)).alias("centroid"))


def sub_size(dim: int, n_sub: int) -> int:
    if n_sub < 1 or dim % n_sub:
        raise ValueError(f"{dim} numbers can't be cut into {n_sub} sub-vectors")
    return dim // n_sub


def codes_of(x: np.ndarray, codebook: np.ndarray) -> np.ndarray:
    """Nearest codeword of each sub-vector, by direct differences."""
    n_sub, _, size = codebook.shape
    out = np.empty((len(x), n_sub), np.int16)
    for m in range(n_sub):
        part = x[:, m * size : (m + 1) * size]
        for at in range(0, len(x), 1024):
            out[at : at + 1024, m] = ((part[at : at + 1024, None, :] - codebook[m][None]) ** 2).sum(2).argmin(1)
    return out


def decoded(codes: np.ndarray, codebook: np.ndarray) -> np.ndarray:
    codes = codes.astype(np.int64)
    return np.concatenate([codebook[m][codes[:, m]] for m in range(codebook.shape[0])], axis=1)


def _array_of(x: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32) if x.size else np.zeros(len(x) + 1, np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(x).ravel(), kind))


def map_vectors(df: DataFrame, keep: list[str], vec: str, name: str, kind: str, fn) -> DataFrame:
    """(keep.., name): fn on the matrix of ``vec`` of each batch; rows without a vector are left out."""
    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), f"{name} array<{kind}>"])
    arrow = {"double": pa.float64(), "float": pa.float32(), "smallint": pa.int16()}[kind]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = fn(matrix(batch.column(len(keep))))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), _array_of(out, arrow)], names=[*keep, name])

    return df.where(F.col(vec).isNotNull()).select(*keep, F.col(vec).alias("_v")).mapInArrow(run, schema)


def encode(keys: DataFrame, codebook: np.ndarray, key: str = "row_id") -> DataFrame:
    """keys(row_id, vec) -> (row_id, code)."""
    return map_vectors(keys, [key], "vec", "code", "smallint", lambda x: codes_of(x, codebook))


def decode(codes: DataFrame, codebook: np.ndarray, key: str = "row_id") -> DataFrame:
    """codes(row_id, code) -> (row_id, vec)."""
    return map_vectors(codes, [key], "code", "vec", "double", lambda x: decoded(x, codebook))


def tables_of(q: np.ndarray, codebook: np.ndarray, metric: str) -> np.ndarray:
    """(queries, sub-spaces, codewords): what each codeword adds to the distance."""
    n_sub, _, size = codebook.shape
    parts = q.reshape(len(q), n_sub, 1, size)
    return ((parts - codebook[None]) ** 2).sum(3) if metric == "l2" else (parts * codebook[None]).sum(3)


def lookup_tables(queries: DataFrame, codebook: np.ndarray, metric: str = "l2") -> DataFrame:
    """queries(qid, vec) -> (qid, lut), a row of sub-spaces x codewords numbers."""
    V.known_metric(metric)
    asked = queries.select("qid", V.prepared("vec", metric).alias("vec"))
    return map_vectors(asked, ["qid"], "vec", "lut", "double", lambda q: tables_of(q, codebook, metric).reshape(len(q), -1))


def table_distance(lut: Column | str, code: Column | str, n_code: int) -> Column:
    """Distance of a code by a query's lookup table."""
    lut, code = (F.col(c) if isinstance(c, str) else c for c in (lut, code))
    return F.aggregate(F.transform(code, lambda c, m: F.get(lut, m * n_code + c)), F.lit(0.0).cast("double"), lambda s, x: s + x)


def nearest_by_table(
    queries: DataFrame, codes: DataFrame, codebook: np.ndarray, k: int, metric: str = "l2", block: int = QUERY_BLOCK, digits: int | None = None
) -> DataFrame:
    """queries(qid, vec), codes(row_id, code) -> (qid, rank, row_id, score) by asymmetric distances, the sums of lookup tables.

    Codes are read from a stored table by every block of queries. A task decodes a slice of them at a
    time, preselects by one matrix product and computes what is near the k-th value as the tables' sums.
    ``digits``: distances are rounded so before they are compared.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    V.known_metric(metric)
    spark = codes.sparkSession
    asked = queries.select(F.col("qid").cast("long").alias("qid"), V.prepared("vec", metric).alias("vec")).where("vec IS NOT NULL")
    ready = materialised(codes.select(F.col("row_id").cast("long").alias("row_id"), "code").where("code IS NOT NULL"), "codes")
    found, waiting, sent = None, None, None
    for rows in query_blocks(asked, block):
        if waiting is not None:
            stored = materialised(waiting, "block")
            found = stored if found is None else found.unionByName(stored)
            sent.destroy()
        sent = spark.sparkContext.broadcast((np.array([r["qid"] for r in rows], np.int64), np.array([r["vec"] for r in rows], np.float64), codebook))
        waiting = ready.mapInArrow(_scan(sent, k, metric, digits), NEIGHBOURS)
    if waiting is None:
        return merged(spark.createDataFrame([], NEIGHBOURS), k, metric)
    return merged(waiting if found is None else found.unionByName(waiting), k, metric)


def table_sums(q: np.ndarray, y: np.ndarray, n_sub: int, metric: str) -> np.ndarray:
    """What the lookup table of q says of decoded codes y, added up by sub-space in order; products are negated."""
    parts = (q - y) ** 2 if metric == "l2" else q * y
    sums = parts.reshape(len(y), n_sub, -1).sum(2).cumsum(1)[:, -1]
    return sums if metric == "l2" else -sums


def _scan(sent, k: int, metric: str, digits: int | None):
    def run(batches):
        qids, asked, codebook = sent.value
        best = Best(len(qids), k)
        own = (asked**2).sum(1)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, codes = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1))
            for at in range(0, len(rows), CODE_SLICE):
                y, ids = decoded(codes[at : at + CODE_SLICE], codebook), rows[at : at + CODE_SLICE]
                norms = (y**2).sum(1)
                n = min(k, len(y))
                for first in range(0, len(qids), QUERY_SLICE):
                    which = slice(first, first + QUERY_SLICE)
                    rough = asked[which] @ y.T
                    rough *= -2.0 if metric == "l2" else -1.0
                    if metric == "l2":
                        rough += own[which, None]
                        rough += norms[None]
                    # The product is off by the rounding of numbers as large as the norms.
                    slack = 1e-9 * (1 + np.nanmax(own[which], initial=0.0) + np.nanmax(norms, initial=0.0)) + (0.0 if digits is None else 10.0**-digits)
                    bound = best.values[which, -1] + slack
                    unfilled = np.nonzero(~np.isfinite(bound))[0]
                    if len(unfilled):
                        bound[unfilled] = np.partition(rough[unfilled], n - 1, axis=1)[:, n - 1] + slack
                    for i in np.nonzero((rough <= bound[:, None]).any(1))[0].tolist():
                        pick = np.nonzero(rough[i] <= bound[i])[0]
                        exact = table_sums(asked[first + i], y[pick], len(codebook), metric)
                        best.offer(first + i, exact if digits is None else np.round(exact, digits), ids[pick])
        yield best.table(qids, 1.0 if metric == "l2" else -1.0)

    return run
