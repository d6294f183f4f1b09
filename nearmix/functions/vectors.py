"""Column expressions on vectors (arrays of numbers), evaluated in DOUBLE on the JVM.

These define what a metric means; the Arrow kernels of ``operators.topk`` compute the same values
in blocks. A null vector gives null; vectors of unequal length give null, so ``checked`` rejects
them where a table comes in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("l2", "ip", "cos")
FLOOR = 1e-9


def known_metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {METRICS}")
    return metric


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0).cast("double"), lambda s, x: s + x)


def squared_l2(a: Column | str, b: Column | str) -> Column:
    """Sum of squared differences, without a root."""
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def inner_product(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column | str) -> Column:
    return F.sqrt(_sum(F.transform(doubles(v), lambda x: x * x)))


def normalized(v: Column | str) -> Column:
    """v over its norm, the norm at least FLOOR; a zero vector stays zero."""
    v = doubles(v)
    length = F.greatest(norm(v), F.lit(FLOOR))
    return F.transform(v, lambda x: x / length)


def prepared(v: Column | str, metric: str) -> Column:
    """What a vector becomes before it is stored or asked for: unit length for cos, else itself."""
    return normalized(v) if known_metric(metric) == "cos" else doubles(v)


def distance(a: Column | str, b: Column | str, metric: str) -> Column:
    """Raw value of two prepared vectors: squared L2, or the inner product."""
    return squared_l2(a, b) if known_metric(metric) == "l2" else inner_product(a, b)


def score(raw: Column, metric: str) -> Column:
    """Larger is nearer: squared L2 is negated (0 stays 0, without a sign), products stay."""
    return F.lit(0.0) - raw if known_metric(metric) == "l2" else raw


def affine(v: Column | str, matrix: list[list[float]], bias: list[float] | None = None) -> Column:
    """matrix @ v + bias, one unrolled sum for each row of the matrix (for small matrices)."""
    v = doubles(v)
    out = []
    for i, row in enumerate(matrix):
        term = F.lit(float(bias[i]) if bias else 0.0)
        for j, w in enumerate(row):
            if w:
                term = term + F.lit(float(w)) * F.get(v, F.lit(j))
        out.append(term)
    return F.array(*out)


def checked(df: DataFrame, vec: str = "vec", dim: int | None = None) -> DataFrame:
    """df, failing at run time on a vector that is null or not of ``dim`` numbers."""
    if dim is None:
        return df
    ok = F.size(F.col(vec)) == dim
    return df.withColumn(vec, F.when(ok, F.col(vec)).otherwise(F.raise_error(F.lit(f"a vector of {vec} does not have {dim} numbers"))))
