"""Registered queries on neighbours: search by each metric, vector functions, inverted lists, quantisation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmix.functions import vectors as V
from nearmix.operators import ivf, pq, train, transform
from nearmix.operators.topk import distance_table, nearest
from nearmix.plans import tables as T

TOPK = 16
NPROBE = 3


def _told(df: DataFrame) -> DataFrame:
    return df.select("qid", "rank", "row_id", F.round("score", 6).alias("score"))


def _topk(metric: str):
    return lambda spark, sf_dir: _told(nearest(T.queries(spark, sf_dir), T.keys(spark, sf_dir), TOPK, metric))


def flat(vec, digits: int = 4) -> F.Column:
    """A vector as text of rounded numbers, which engines can compare."""
    return F.array_join(F.transform(vec, lambda v: F.format_string(f"%.{digits}f", F.round(v, digits) + F.lit(0.0))), " ")


FLAT_SQL = "array_to_string(list_transform({0}, lambda v: printf('%.4f', round(v, 4) + 0e0)), ' ')"


def normalize_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = T.keys(spark, sf_dir).select("row_id", V.norm("vec").alias("norm"), V.normalized("vec").alias("vec"))
    return unit.select("row_id", F.round("norm", 6).alias("norm"), flat("vec").alias("unit"))


def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key against every centroid, by all metrics."""
    a = T.keys(spark, sf_dir).withColumnRenamed("row_id", "a_id")
    b = T.means(spark, sf_dir).selectExpr("list_id AS b_id", "centroid AS vec")
    out = None
    for metric in V.METRICS:
        part = distance_table(a, b, metric).select("a_id", "b_id", F.round("raw", 6).alias(metric))
        out = part if out is None else out.join(part, ["a_id", "b_id"])
    return out


def rotation_matrix() -> np.ndarray:
    """A plain map for the registered query: half the numbers, each the sum and difference of a pair."""
    a = np.zeros((T.DIM // 2, T.DIM))
    for i in range(T.DIM // 2):
        a[i, 2 * i], a[i, 2 * i + 1] = 0.6, -0.8
    return a


def rotate_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform.apply(T.keys(spark, sf_dir), rotation_matrix(), np.arange(T.DIM // 2) * 0.01)
    return made.select("row_id", flat("vec").alias("rotated"))


def pq_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = pq.encode(T.keys(spark, sf_dir), T.codebook(spark, sf_dir))
    return codes.select("row_id", F.array_join(F.col("code").cast("array<string>"), " ").alias("code"))


def pq_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = T.codebook(spark, sf_dir)
    return pq.decode(pq.encode(T.keys(spark, sf_dir), book), book).select("row_id", flat("vec", T.DIGITS).alias("vec"))


def pq_adc_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = T.codebook(spark, sf_dir)
    return _told(pq.nearest_by_table(T.queries(spark, sf_dir), pq.encode(T.keys(spark, sf_dir), book), book, TOPK, digits=6))


def pq_flat_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = T.codebook(spark, sf_dir)
    codes = pq.encode(T.keys(spark, sf_dir), book).withColumnRenamed("code", "vec")
    return _told(nearest(T.queries(spark, sf_dir), codes, TOPK, "l2", decode=lambda code, _: pq.decoded(code, book), digits=6))


def ivf_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivf.assign(T.keys(spark, sf_dir), T.means(spark, sf_dir))


def ivf_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivf.probe(T.queries(spark, sf_dir), T.means(spark, sf_dir), NPROBE)


def ivf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    centroids = T.means(spark, sf_dir)
    return _told(ivf.search(T.queries(spark, sf_dir), ivf.postings(T.keys(spark, sf_dir), centroids), centroids, TOPK, NPROBE))


def ivfpq_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of what the centroid leaves; the codebook holds the labels' mean sub-vectors, halved."""
    centroids, book = T.means(spark, sf_dir), T.codebook(spark, sf_dir) * 0.5
    rows = {r["list_id"]: r["centroid"] for r in centroids.collect()}
    held = np.array([rows[i] for i in range(len(rows))])
    coded = ivf.residual_codes(ivf.postings(T.keys(spark, sf_dir), centroids), held, book)
    found = ivf.search(T.queries(spark, sf_dir), coded, centroids, TOPK, NPROBE, decode=ivf.residual_decoder(held, book), digits=6)
    return _told(found)


def ivf_list_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    centroids = T.means(spark, sf_dir)
    return ivf.list_sizes(ivf.assign(T.keys(spark, sf_dir), centroids), centroids)


def pca_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in the 16 directions of largest variance."""
    keys = T.keys(spark, sf_dir)
    matrix, bias = transform.pca(keys, T.DIM, 16)
    return transform.apply(keys, matrix, bias).select("row_id", F.transform("vec", lambda v: F.round(v, 6)).alias("vec"))


def kmeans_ivf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverted lists with fitted centroids."""
    keys = T.keys(spark, sf_dir)
    fitted = train.lloyd(train.first_rows(keys), 16)
    centroids = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(fitted)], "list_id int, centroid array<double>")
    return _told(ivf.search(T.queries(spark, sf_dir), ivf.postings(keys, centroids), centroids, TOPK, 12))


def opq_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asymmetric search behind a rotation that was fitted with the codebook."""
    keys = T.keys(spark, sf_dir)
    x = train.sample(keys)
    a = train.rotation(x, T.DIM, T.DIM, 64, turns=1, spark=spark)
    book = train.codebook(x @ a.T, T.DIM, 64, spark=spark)
    codes = pq.encode(transform.apply(keys, a), book)
    return _told(pq.nearest_by_table(transform.apply(T.queries(spark, sf_dir), a, key="qid"), codes, book, TOPK))


QUERIES = {
    "knn_l2_topk": _topk("l2"),
    "knn_ip_topk": _topk("ip"),
    "knn_cos_topk": _topk("cos"),
    "normalize_vectors": normalize_vectors,
    "distance_table": distances,
    "rotate_vectors": rotate_vectors,
    "pq_encode": pq_encode,
    "pq_decode": pq_decode,
    "pq_adc_topk": pq_adc_topk,
    "pq_flat_topk": pq_flat_topk,
    "ivf_assign": ivf_assign,
    "ivf_probe": ivf_probe,
    "ivf_topk": ivf_topk,
    "ivfpq_topk": ivfpq_topk,
    "ivf_list_sizes": ivf_list_sizes,
    "pca_transform": pca_transform,
    "kmeans_ivf_topk": kmeans_ivf_topk,
    "opq_topk": opq_topk,
}

_UNIT_K = f"u AS (SELECT row_id, {T.UNIT_SQL.format('x')} AS x FROM k)"
_UNIT_Q = f"v AS (SELECT qid, {T.UNIT_SQL.format('y')} AS y FROM q)"
_NEAR = "SELECT qid, rank, row_id, round(score, 6) AS score FROM near"
_ASSIGN = f"""
posted AS (
  SELECT row_id, list_id FROM (
    SELECT row_id, list_id, row_number() OVER (PARTITION BY row_id ORDER BY {T.L2_SQL.format('x', 'centroid')}, list_id) AS n
    FROM k, means) WHERE n = 1)"""
_PROBE = f"""
probed AS (
  SELECT qid, list_id, rank FROM (
    SELECT qid, list_id, row_number() OVER (PARTITION BY qid ORDER BY {T.L2_SQL.format('y', 'centroid')}, list_id) AS rank FROM q, means)
  WHERE rank <= {NPROBE})"""
_DECODED = "dec AS (SELECT row_id, flatten(list(word ORDER BY m)) AS z FROM code GROUP BY row_id)"
_ADC = """
adc AS (
  SELECT qid, row_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rank
  FROM (SELECT qid, row_id, round(0e0 - {0}, 6) AS score FROM q, dec) QUALIFY rank <= {1})"""
_LISTED = f"""
near AS (
  SELECT qid, row_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rank
  FROM (SELECT qid, row_id, 0e0 - {T.L2_SQL.format('x', 'y')} AS score FROM q JOIN probed USING (qid) JOIN posted USING (list_id) JOIN k USING (row_id))
  QUALIFY rank <= {TOPK})"""
_RESIDUAL = f"""
left_over AS (SELECT row_id, list_id, list_transform(range(1, {T.DIM + 1}), lambda i: x[i] - centroid[i]) AS r, centroid FROM k JOIN posted USING (row_id) JOIN means USING (list_id)),
pieces AS (SELECT row_id, m, r[m * {T.SIZE} + 1:(m + 1) * {T.SIZE}] AS part FROM left_over, range({T.N_SUB}) AS t(m)),
half AS (SELECT m, c, list_transform(word, lambda v: v * 0.5) AS word FROM book),
coded AS (
  SELECT row_id, m, word FROM (
    SELECT row_id, pieces.m AS m, word, row_number() OVER (PARTITION BY row_id, pieces.m ORDER BY {T.L2_SQL.format('part', 'word')}, c) AS n
    FROM pieces JOIN half ON pieces.m = half.m) WHERE n = 1),
back AS (SELECT row_id, flatten(list(word ORDER BY m)) AS z FROM coded GROUP BY row_id),
whole AS (SELECT row_id, list_id, list_transform(range(1, {T.DIM + 1}), lambda i: z[i] + centroid[i]) AS z FROM back JOIN left_over USING (row_id)),
adc AS (
  SELECT qid, row_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rank
  FROM (SELECT qid, row_id, round(0e0 - {T.L2_SQL.format('y', 'z')}, 6) AS score FROM q JOIN probed USING (qid) JOIN whole USING (list_id)) QUALIFY rank <= {TOPK})"""

SQL = {
    "knn_l2_topk": T.sql(T.K_SQL, T.Q_SQL, T.l2_near(TOPK), select=_NEAR),
    "knn_ip_topk": T.sql(T.K_SQL, T.Q_SQL, T.NEAR_SQL.format(score=T.IP_SQL.format("x", "y"), q="q", k="k", n=TOPK), select=_NEAR),
    "knn_cos_topk": T.sql(T.K_SQL, T.Q_SQL, _UNIT_K, _UNIT_Q, T.NEAR_SQL.format(score=T.IP_SQL.format("x", "y"), q="v", k="u", n=TOPK), select=_NEAR),
    "normalize_vectors": T.sql(
        T.K_SQL, _UNIT_K,
        select=f"SELECT row_id, round(sqrt(list_sum(list_transform(k.x, lambda v: v * v))), 6) AS norm, {FLAT_SQL.format('u.x')} AS unit FROM k JOIN u USING (row_id)",
    ),
    "distance_table": T.sql(
        T.K_SQL, T.MEANS_SQL, _UNIT_K, f"c AS (SELECT list_id, {T.UNIT_SQL.format('centroid')} AS z FROM means)",
        select=f"SELECT k.row_id AS a_id, means.list_id AS b_id, round({T.L2_SQL.format('k.x', 'centroid')}, 6) AS l2, "
        f"round({T.IP_SQL.format('k.x', 'centroid')}, 6) AS ip, round({T.IP_SQL.format('u.x', 'z')}, 6) AS cos FROM k JOIN u USING (row_id), means JOIN c USING (list_id)",
    ),
    "rotate_vectors": T.sql(
        T.K_SQL, f"r AS (SELECT row_id, list_transform(range({T.DIM // 2}), lambda i: 0.6e0 * x[2 * i + 1] - 0.8e0 * x[2 * i + 2] + i * 0.01e0) AS y FROM k)",
        select=f"SELECT row_id, {FLAT_SQL.format('y')} AS rotated FROM r",
    ),
    "pq_encode": T.sql(T.K_SQL, T.CODES_SQL, select="SELECT row_id, string_agg(CAST(c AS VARCHAR), ' ' ORDER BY m) AS code FROM code GROUP BY row_id"),
    "pq_decode": T.sql(T.K_SQL, T.CODES_SQL, _DECODED, select=f"SELECT row_id, {FLAT_SQL.format('z').replace('4', str(T.DIGITS))} AS vec FROM dec"),
    "pq_adc_topk": T.sql(T.K_SQL, T.Q_SQL, T.CODES_SQL, _DECODED, _ADC.format(T.L2_SQL.format("y", "z"), TOPK), select="SELECT qid, rank, row_id, score FROM adc"),
    "pq_flat_topk": T.sql(T.K_SQL, T.Q_SQL, T.CODES_SQL, _DECODED, _ADC.format(T.L2_SQL.format("y", "z"), TOPK), select="SELECT qid, rank, row_id, score FROM adc"),
    "ivf_assign": T.sql(T.K_SQL, T.MEANS_SQL, _ASSIGN, select="SELECT row_id, list_id FROM posted"),
    "ivf_probe": T.sql(T.K_SQL, T.Q_SQL, T.MEANS_SQL, _PROBE, select="SELECT qid, rank, list_id FROM probed"),
    "ivf_topk": T.sql(
        T.K_SQL, T.Q_SQL, T.MEANS_SQL, _ASSIGN, _PROBE,
        _LISTED,
        select=_NEAR,
    ),
    "ivfpq_topk": T.sql(T.K_SQL, T.Q_SQL, T.CODEBOOK_SQL, _ASSIGN, _PROBE, _RESIDUAL, select="SELECT qid, rank, row_id, score FROM adc"),
    "ivf_list_sizes": T.sql(T.K_SQL, T.MEANS_SQL, _ASSIGN, select="SELECT means.list_id, count(row_id) AS n FROM means LEFT JOIN posted USING (list_id) GROUP BY 1"),
}
