"""Registered queries on distributions: softmax, gates, mixing, ensembles, pooling, retrieval inside sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmix.functions import sequences
from nearmix.functions import vectors as V
from nearmix.operators import mix, pq, subset
from nearmix.operators.topk import nearest
from nearmix.plans import tables as T
from nearmix.plans.neighbours import FLAT_SQL, flat
from nearmix.plans.retrieval import KnnQuery, Subset, Vanilla

#: Squared distances of unit vectors lie in 0..4; scores are their negatives.
THRESHOLD = -1.2
TEMPERATURE = 0.5
WEIGHT = 0.5
VANILLA = KnnQuery(topk=16, weight=WEIGHT, temperature=TEMPERATURE, pad=T.PAD)
GATED = KnnQuery(topk=16, weight=WEIGHT, temperature=TEMPERATURE, pad=T.PAD, threshold=THRESHOLD, leave_own=True)
SUBSET = KnnQuery(topk=16, src_topk=5, weight=WEIGHT, temperature=TEMPERATURE, pad=T.PAD)


def _vanilla(query: KnnQuery, spark: SparkSession, sf_dir: str) -> Vanilla:
    return Vanilla(query, T.values(spark, sf_dir), keys=T.keys(spark, sf_dir))


def knn_vanilla_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _vanilla(VANILLA, spark, sf_dir).mixed(T.model(spark, sf_dir), T.queries(spark, sf_dir))
    return made.select("qid", "token_id", F.round("lprob", 6).alias("lprob"))


def knn_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The softmax of each query's neighbours."""
    made = _vanilla(VANILLA, spark, sf_dir).probs(T.queries(spark, sf_dir))
    return made.select("qid", "rank", "row_id", "token_id", F.round("prob", 6).alias("prob"))


def knn_threshold_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours below the threshold go; queries whose best isn't above it keep the model's own distribution.

    A query's own row is no neighbour here, so that some have no near one.
    """
    made = _vanilla(GATED, spark, sf_dir).mixed(T.model(spark, sf_dir), T.queries(spark, sf_dir))
    return made.select("qid", "token_id", F.round("lprob", 6).alias("lprob"))


def sentence_mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subset.sentence_vectors(T.sentence_rows(spark, sf_dir), T.DIM, T.PAD).select("seq_id", flat("vec").alias("vec"))


def last_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector of each sentence's last row."""
    rows = T.table(spark, sf_dir, "embeddings").withColumn("seq_id", F.expr(f"vec_id div {T.PER_SENTENCE}"))
    made = rows.groupBy("seq_id").agg(F.max("vec_id").alias("row_id"), F.max_by("embedding", "vec_id").alias("vec"))
    return made.select("seq_id", "row_id", flat(V.doubles("vec")).alias("vec"))


def model_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with the centroids as logits, sharpened and normalised."""
    logits = T.queries(spark, sf_dir).join(F.broadcast(T.means(spark, sf_dir)), F.lit(True))
    logits = logits.select("qid", F.col("list_id").alias("token_id"), V.inner_product("vec", "centroid").alias("logit"))
    return mix.model_probs(logits, TEMPERATURE).select("qid", "token_id", F.round("lprob", 6).alias("lprob"))


def ensemble_logmeanexp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three models; the second has no row for the pad token, which counts as probability 0."""
    parts = [T.model(spark, sf_dir), T.model(spark, sf_dir, 2.0).where(F.col("token_id") != T.PAD), T.model(spark, sf_dir, 0.0)]
    union = None
    for i, p in enumerate(parts):
        p = p.withColumn("model", F.lit(i))
        union = p if union is None else union.unionByName(p)
    return mix.log_mean(union, len(parts)).select("qid", "token_id", F.round("lprob", 6).alias("lprob"))


def _ensemble(mix_first: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        queries, keys, values = T.queries(spark, sf_dir), T.keys(spark, sf_dir), T.values(spark, sf_dir)
        found = [mix.with_values(nearest(queries, keys, 16, metric), values) for metric in ("l2", "ip")]
        models = [T.model(spark, sf_dir), T.model(spark, sf_dir, 2.0)]
        made = mix.ensemble(models, found, mix_first, WEIGHT, TEMPERATURE, None, T.PAD)
        return made.select("qid", "token_id", F.round("lprob", 6).alias("lprob"))

    return run


def subset_of(spark: SparkSession, sf_dir: str) -> Subset:
    """Sentences are asked by their mean vectors; every sentence asks."""
    pooled = subset.sentence_vectors(T.sentence_rows(spark, sf_dir), T.DIM)
    book = T.codebook(spark, sf_dir)
    codes = pq.encode(T.keys(spark, sf_dir), book)
    return Subset(SUBSET, pooled.withColumnRenamed("seq_id", "sent_id"), pooled, T.sentences(spark, sf_dir), T.values(spark, sf_dir), codes, book)


def sentence_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = subset_of(spark, sf_dir).sentence_neighbours()
    return found.select("sent_id", "rank", "seq_id", F.round("score", 6).alias("score"))


def subset_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subset_of(spark, sf_dir).rows()


def subset_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = subset_of(spark, sf_dir).neighbours(T.queries(spark, sf_dir))
    return found.select("qid", "rank", F.round("score", 6).alias("score"))


def subset_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = subset_of(spark, sf_dir).mixed(T.model(spark, sf_dir), T.queries(spark, sf_dir))
    return made.select("qid", "token_id", F.round("lprob", 6).alias("lprob"))


def retrieval_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = subset_of(spark, sf_dir).sentence_neighbours()
    lists = found.groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("rank", "seq_id"))).alias("l"))
    return lists.select("sent_id", sequences.trace("sent_id", F.transform("l", lambda x: x["seq_id"])).alias("trace"))


def beam_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences in a batch of two beams each; after a step every second sentence stays."""
    state = T.sentences(spark, sf_dir).selectExpr("seq_id AS sent_id", "begin", "end")
    order = state.selectExpr("sent_id AS s").where("s % 2 = 1").selectExpr("explode(array(0, 1)) AS b", "s")
    order = order.selectExpr("(s div 2) * 2 + b AS place", "s * 2 + 1 - b AS source")
    return subset.reorder(state, order, 2).select("sent_id", "begin", "end")


QUERIES = {
    "knn_vanilla_mix": knn_vanilla_mix,
    "knn_probs": knn_probs,
    "knn_threshold_gate": knn_threshold_gate,
    "sentence_mean_pool": sentence_mean_pool,
    "last_step": last_step,
    "model_temperature": model_temperature,
    "ensemble_logmeanexp": ensemble_logmeanexp,
    "knn_ensemble_mix_first": _ensemble(True),
    "knn_ensemble_mix_after": _ensemble(False),
    "sentence_topk": sentence_topk,
    "subset_rows": subset_rows,
    "subset_knn": subset_knn,
    "subset_mix": subset_mix,
    "retrieval_trace": retrieval_trace,
    "beam_reorder": beam_reorder,
}


def _softmax(name: str, near: str, temperature: float = TEMPERATURE, threshold: float | None = None) -> str:
    """(qid, row_id, rank, token_id, prob) of neighbours with tokens."""
    where = "" if threshold is None else f"WHERE score >= {threshold}"
    return f"""
e_{name} AS (
  SELECT *, exp(score / {temperature} - max(score / {temperature}) OVER (PARTITION BY qid)) AS w FROM {near} {where}),
{name} AS (SELECT qid, rank, row_id, token_id, w / sum(w) OVER (PARTITION BY qid) AS prob FROM e_{name})"""


def _mixed(name: str, model: str, probs: str, gate: str | None = None) -> str:
    """(qid, token_id, lprob) of a model and (qid, token_id, prob)."""
    mixes = "true" if gate is None else "coalesce(mixes, false)"
    joined = "" if gate is None else f"LEFT JOIN {gate} g USING (qid)"
    return f"""
s_{name} AS (SELECT qid, token_id, sum(prob) AS prob FROM {probs} WHERE token_id <> {T.PAD} GROUP BY 1, 2),
{name} AS (
  SELECT qid, token_id, CASE WHEN p > 0 THEN ln(p) ELSE CAST('-inf' AS DOUBLE) END AS lprob FROM (
    SELECT qid, token_id, CASE WHEN {mixes} THEN {1 - WEIGHT} * exp(lprob) + {WEIGHT} * coalesce(prob, 0e0) ELSE exp(lprob) END AS p
    FROM {model} LEFT JOIN s_{name} USING (qid, token_id) {joined}))"""


def _mean(name: str, parts: list[str]) -> str:
    union = " UNION ALL ".join(f"SELECT qid, token_id, exp(lprob) AS p FROM {p}" for p in parts)
    return f"{name} AS (SELECT qid, token_id, CASE WHEN sum(p) > 0 THEN ln(sum(p) / {len(parts)}) ELSE CAST('-inf' AS DOUBLE) END AS lprob FROM ({union}) GROUP BY 1, 2)"


_VALUED = "valued AS (SELECT near.*, token_id FROM near JOIN k USING (row_id))"
_LPROB = "SELECT qid, token_id, round(lprob, 6) AS lprob FROM "
_IP_NEAR = T.NEAR_SQL.format(score=T.IP_SQL.format("x", "y"), q="q", k="k", n=16).replace("near AS", "near_ip AS")
_IP_VALUED = "valued_ip AS (SELECT near_ip.*, token_id FROM near_ip JOIN k USING (row_id))"
_POOLED = f"""
pool AS (
  SELECT seq_id, list(v ORDER BY i) AS z FROM (
    SELECT row_id // {T.PER_SENTENCE} AS seq_id, i, avg(x[i]) AS v FROM k, range(1, {T.DIM + 1}) AS r(i) GROUP BY 1, 2) GROUP BY 1),
near_s AS (
  SELECT sent_id, seq_id, score, row_number() OVER (PARTITION BY sent_id ORDER BY score DESC, seq_id) AS rank
  FROM (SELECT a.seq_id AS sent_id, b.seq_id AS seq_id, 0e0 - {T.L2_SQL.format('a.z', 'b.z')} AS score FROM pool a, pool b) QUALIFY rank <= {SUBSET.src_topk})"""
_SUBSET = f"""
cand AS (
  SELECT sent_id, row_number() OVER (PARTITION BY sent_id ORDER BY rank, row_id) - 1 AS cand_pos, row_id, token_id
  FROM near_s JOIN k ON k.row_id // {T.PER_SENTENCE} = near_s.seq_id)"""
_SUBSET_KNN = f"""
dec AS (SELECT row_id, flatten(list(word ORDER BY m)) AS z FROM code GROUP BY row_id),
best AS (
  SELECT qid, row_id, token_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cand_pos) AS rank
  FROM (SELECT qid, cand_pos, row_id, token_id, 0e0 - {T.L2_SQL.format('y', 'z')} AS score FROM q JOIN cand USING (sent_id) JOIN dec USING (row_id))
  QUALIFY rank <= {SUBSET.topk})"""
_GATED_NEAR = T.l2_near(16).replace("FROM q, k)", "FROM q, k WHERE row_id <> qid)")

SQL = {
    "knn_vanilla_mix": T.sql(T.K_SQL, T.Q_SQL, T.l2_near(16), _VALUED, _softmax("soft", "valued"), T.model_sql("model"), _mixed("made", "model", "soft"), select=_LPROB + "made"),
    "knn_probs": T.sql(T.K_SQL, T.Q_SQL, T.l2_near(16), _VALUED, _softmax("soft", "valued"), select="SELECT qid, rank, row_id, token_id, round(prob, 6) AS prob FROM soft"),
    "knn_threshold_gate": T.sql(
        T.K_SQL, T.Q_SQL, _GATED_NEAR, _VALUED, _softmax("soft", "valued", threshold=THRESHOLD), T.model_sql("model"),
        f"gate AS (SELECT qid, max(score) > {THRESHOLD} AS mixes FROM valued GROUP BY qid)", _mixed("made", "model", "soft", "gate"), select=_LPROB + "made",
    ),
    "sentence_mean_pool": T.sql(
        T.K_SQL, f"""
m AS (SELECT row_id // {T.PER_SENTENCE} AS seq_id, i, coalesce(sum(x[i]) FILTER (token_id <> {T.PAD}), 0e0) / greatest(CAST(count(*) FILTER (token_id <> {T.PAD}) AS DOUBLE), 1e-9) AS v
  FROM k, range(1, {T.DIM + 1}) AS r(i) GROUP BY 1, 2),
n AS (SELECT seq_id, list(v ORDER BY i) AS z FROM m GROUP BY 1)""", select=f"SELECT seq_id, {FLAT_SQL.format('z')} AS vec FROM n",
    ),
    "last_step": T.sql(
        T.K_SQL, f"l AS (SELECT row_id // {T.PER_SENTENCE} AS seq_id, max(row_id) AS row_id FROM k GROUP BY 1)",
        select=f"SELECT seq_id, l.row_id AS row_id, {FLAT_SQL.format('x')} AS vec FROM l JOIN k USING (row_id)",
    ),
    "model_temperature": T.sql(
        T.K_SQL, T.Q_SQL, T.MEANS_SQL, f"g2 AS (SELECT qid, list_id AS token_id, {T.IP_SQL.format('y', 'centroid')} / {TEMPERATURE} AS s FROM q, means)",
        select="SELECT qid, token_id, round(s - ln(sum(exp(s)) OVER (PARTITION BY qid)), 6) AS lprob FROM g2",
    ),
    "ensemble_logmeanexp": T.sql(
        T.K_SQL, T.Q_SQL, T.model_sql("a"), T.model_sql("b", 2.0), T.model_sql("c", 0.0), f"b2 AS (SELECT * FROM b WHERE token_id <> {T.PAD})",
        _mean("made", ["a", "b2", "c"]), select=_LPROB + "made",
    ),
    "knn_ensemble_mix_first": T.sql(
        T.K_SQL, T.Q_SQL, T.l2_near(16), _VALUED, _IP_NEAR, _IP_VALUED, _softmax("soft", "valued"), _softmax("soft_ip", "valued_ip"), T.model_sql("a"), T.model_sql("b", 2.0),
        _mixed("first_mix", "a", "soft"), _mixed("second_mix", "b", "soft_ip"), _mean("made", ["first_mix", "second_mix"]), select=_LPROB + "made",
    ),
    "knn_ensemble_mix_after": T.sql(
        T.K_SQL, T.Q_SQL, T.l2_near(16), _VALUED, _softmax("soft", "valued"), T.model_sql("a"), T.model_sql("b", 2.0), _mean("mean_ab", ["a", "b"]),
        _mixed("made", "mean_ab", "soft"), select=_LPROB + "made",
    ),
    "sentence_topk": T.sql(T.K_SQL, _POOLED, select="SELECT sent_id, rank, seq_id, round(score, 6) AS score FROM near_s"),
    "subset_rows": T.sql(T.K_SQL, _POOLED, _SUBSET, select="SELECT sent_id, cand_pos, row_id, token_id FROM cand"),
    "subset_knn": T.sql(T.K_SQL, T.Q_SQL, _POOLED, _SUBSET, T.CODES_SQL, _SUBSET_KNN, select="SELECT qid, rank, round(score, 6) AS score FROM best"),
    "subset_mix": T.sql(
        T.K_SQL, T.Q_SQL, _POOLED, _SUBSET, T.CODES_SQL, _SUBSET_KNN, _softmax("soft", "best"), T.model_sql("model"), _mixed("made", "model", "soft"), select=_LPROB + "made",
    ),
    "retrieval_trace": T.sql(T.K_SQL, _POOLED, select="SELECT sent_id, 'R-' || sent_id || chr(9) || string_agg(CAST(seq_id AS VARCHAR), ' ' ORDER BY rank) AS trace FROM near_s GROUP BY sent_id"),
    "beam_reorder": f"""
WITH s AS (SELECT vec_id // {T.PER_SENTENCE} AS seq_id, min(vec_id) AS "begin", max(vec_id) + 1 AS "end" FROM embeddings GROUP BY 1)
SELECT seq_id // 2 AS sent_id, "begin", "end" FROM s WHERE seq_id % 2 = 1""",
}
