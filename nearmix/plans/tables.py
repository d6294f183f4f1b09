"""The inputs of the registered queries: roles that the given tables play.

Keys and values are the embeddings (row_id = vec_id, token_id = label); queries are the rows whose
vec_id is divisible by 20, held against all rows. Eight rows in a row make a sentence. The model's
distribution is the smoothed frequency of the labels. Centroids and codewords are the labels' means,
rounded, so that SQL can compute them too.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmix.operators import pq

DIM = 64
N_SUB = 8
EVERY = 20
PER_SENTENCE = 8
DIGITS = 6
#: As the embeddings table holds none, other missing tokens are told by this label.
PAD = 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id AS row_id", "embedding AS vec")


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id AS row_id", "label AS token_id")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") % EVERY == 0).selectExpr(
        "vec_id AS qid", f"vec_id div {PER_SENTENCE} AS sent_id", "embedding AS vec"
    )


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, begin, end): the rows of each sentence."""
    seq = F.expr(f"vec_id div {PER_SENTENCE}")
    return table(spark, sf_dir, "embeddings").groupBy(seq.alias("seq_id")).agg(F.min("vec_id").alias("begin"), (F.max("vec_id") + 1).alias("end"))


def sentence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr(f"vec_id div {PER_SENTENCE} AS seq_id", "embedding AS vec", "label AS token_id")


def means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(list_id, centroid): one for each label."""
    rows = table(spark, sf_dir, "embeddings").selectExpr("label AS list_id", "embedding AS vec")
    return pq.group_means(rows, "list_id", DIM, DIGITS).selectExpr("list_id", "mean AS centroid")


def codebook(spark: SparkSession, sf_dir: str) -> np.ndarray:
    rows = table(spark, sf_dir, "embeddings").selectExpr("label AS c", "embedding AS vec")
    return pq.as_array(pq.group_codebook(rows, "c", DIM, N_SUB, DIGITS))


def model(spark: SparkSession, sf_dir: str, power: float = 1.0) -> DataFrame:
    """(qid, token_id, lprob) for each query and label; a power other than 1 makes another model."""
    labels = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("token_id")).agg(F.count("*").alias("n"))
    weighed = labels.withColumn("w", F.pow(F.col("n") + F.lit(1.0), F.lit(float(power))))
    total = weighed.agg(F.sum("w").alias("t"))
    each = weighed.join(F.broadcast(total), F.lit(True)).select("token_id", F.ln(F.col("w") / F.col("t")).alias("lprob"))
    # One row a label: a distribution over the vocabulary, for every query.
    return queries(spark, sf_dir).select("qid").join(F.broadcast(each), F.lit(True)).select("qid", "token_id", "lprob")


# The same in DuckDB's SQL.

K_SQL = "k AS (SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS x, label AS token_id FROM embeddings WHERE embedding IS NOT NULL)"
Q_SQL = f"q AS (SELECT row_id AS qid, row_id // {PER_SENTENCE} AS sent_id, x AS y FROM k WHERE row_id % {EVERY} = 0)"
UNIT_SQL = "list_transform({0}, lambda v: v / greatest(sqrt(list_sum(list_transform({0}, lambda w: w * w))), 1e-9))"
L2_SQL = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: ({0}[i] - {1}[i]) * ({0}[i] - {1}[i])))"
IP_SQL = "list_inner_product({0}, {1})"
MEANS_SQL = f"""
g AS (SELECT token_id AS list_id, i, round(avg(x[i]), {DIGITS}) AS v FROM k, range(1, {DIM + 1}) AS r(i) GROUP BY 1, 2),
means AS (SELECT list_id, list(v ORDER BY i) AS centroid FROM g GROUP BY 1)"""
SIZE = DIM // N_SUB
CODEBOOK_SQL = f"""{MEANS_SQL},
book AS (SELECT m, list_id AS c, centroid[m * {SIZE} + 1:(m + 1) * {SIZE}] AS word FROM means, range({N_SUB}) AS r(m))"""
CODES_SQL = f"""{CODEBOOK_SQL},
sub AS (SELECT row_id, m, x[m * {SIZE} + 1:(m + 1) * {SIZE}] AS part FROM k, range({N_SUB}) AS r(m)),
code AS (
  SELECT row_id, m, c, word FROM (
    SELECT row_id, sub.m AS m, c, word, row_number() OVER (PARTITION BY row_id, sub.m ORDER BY {L2_SQL.format('part', 'word')}, c) AS n
    FROM sub JOIN book ON sub.m = book.m) WHERE n = 1)"""
NEAR_SQL = """
near AS (
  SELECT qid, row_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rank
  FROM (SELECT qid, row_id, {score} AS score FROM {q}, {k}) QUALIFY rank <= {n})"""


def model_sql(name: str, power: float = 1.0) -> str:
    return f"""
w_{name} AS (SELECT token_id, pow(count(*) + 1e0, {power}) AS w FROM (SELECT label AS token_id FROM embeddings) GROUP BY 1),
{name} AS (SELECT qid, token_id, ln(w / (SELECT sum(w) FROM w_{name})) AS lprob FROM q, w_{name})"""


def l2_near(n: int) -> str:
    return NEAR_SQL.format(score=f"0e0 - {L2_SQL.format('x', 'y')}", q="q", k="k", n=n)


def sql(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n" + select
