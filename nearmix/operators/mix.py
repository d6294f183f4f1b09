"""From neighbours to a mixed next-token distribution.

All steps are windows and aggregations on long tables: neighbours(qid, rank, row_id, token_id, score)
and model probabilities (qid, token_id, lprob). A missing row means probability 0; negative infinity
appears only in results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def log_or_minus_infinity(p: Column) -> Column:
    """ln(p), minus infinity where p is not above 0 (the built-in ln gives null there)."""
    return F.when(p > 0, F.ln(p)).otherwise(F.lit("-Infinity").cast("double"))


def with_values(neighbours: DataFrame, values: DataFrame) -> DataFrame:
    """Neighbours with the token of their row; values(row_id, token_id)."""
    return neighbours.join(values.select("row_id", "token_id"), "row_id").select("qid", "rank", "row_id", "token_id", "score")


def neighbour_probs(neighbours: DataFrame, temperature: float = 1.0, threshold: float | None = None) -> DataFrame:
    """Adds prob: the softmax of score / temperature over a query's neighbours.

    Neighbours with a score below the threshold go; a query whose neighbours all go has no rows.
    """
    if temperature <= 0:
        raise ValueError("the temperature must be positive")
    kept = neighbours if threshold is None else neighbours.where(F.col("score") >= threshold)
    query = Window.partitionBy("qid")
    scaled = kept.withColumn("_s", F.col("score") / F.lit(float(temperature)))
    weighed = scaled.withColumn("_w", F.exp(F.col("_s") - F.max("_s").over(query)))
    return weighed.withColumn("prob", F.col("_w") / F.sum("_w").over(query)).drop("_s", "_w")


def token_probs(probs: DataFrame) -> DataFrame:
    """(qid, token_id, prob): neighbours of one token are summed."""
    return probs.groupBy("qid", "token_id").agg(F.sum("prob").alias("prob"))


def gate(neighbours: DataFrame, threshold: float | None) -> DataFrame:
    """(qid, mixes): whether a query's best score is above the threshold; strictly, unlike the threshold of neighbours."""
    if threshold is None:
        return neighbours.select("qid").distinct().withColumn("mixes", F.lit(True))
    return neighbours.groupBy("qid").agg((F.max("score") > threshold).alias("mixes"))


def mixed(
    model: DataFrame, neighbours: DataFrame, weight: float = 0.5, temperature: float = 1.0, threshold: float | None = None, pad: int | None = None
) -> DataFrame:
    """model(qid, token_id, lprob), neighbours with tokens -> (qid, token_id, lprob) over the model's tokens.

    p = (1 - weight) exp(lprob) + weight x retrieved probability, where the gate lets a query mix;
    else the model's own. The pad token's retrieved mass is dropped and not redistributed.
    """
    if not 0 <= weight <= 1:
        raise ValueError("the weight must lie between 0 and 1")
    retrieved = token_probs(neighbour_probs(neighbours, temperature, threshold))
    if pad is not None:
        retrieved = retrieved.where(F.col("token_id") != pad)
    joined = model.join(retrieved, ["qid", "token_id"], "left")
    if threshold is not None:
        joined = joined.join(gate(neighbours, threshold), "qid", "left")
        mixes = F.coalesce("mixes", F.lit(False))
    else:
        mixes = F.lit(True)
    own = F.exp("lprob")
    p = F.when(mixes, F.lit(1.0 - weight) * own + F.lit(float(weight)) * F.coalesce("prob", F.lit(0.0))).otherwise(own)
    return joined.select("qid", "token_id", log_or_minus_infinity(p).alias("lprob"))


def log_mean(models: DataFrame, n_models: int, column: str = "lprob") -> DataFrame:
    """models(model, qid, token_id, lprob) -> the log of the mean probability.

    Divided by the number of models, so a token that a model doesn't have counts as 0 there. The
    largest log-probability is taken out first, so small probabilities don't underflow.
    """
    if n_models < 1:
        raise ValueError("an ensemble needs a model")
    key = Window.partitionBy("qid", "token_id")
    finite = models.where(F.col(column) > F.lit("-Infinity").cast("double")).withColumn("_top", F.max(column).over(key))
    total = finite.groupBy("qid", "token_id").agg(F.first("_top").alias("_top"), F.sum(F.exp(F.col(column) - F.col("_top"))).alias("_sum"))
    known = models.select("qid", "token_id").distinct().join(total, ["qid", "token_id"], "left")
    value = F.col("_top") + F.ln("_sum") - F.lit(math.log(n_models))
    return known.select("qid", "token_id", F.coalesce(value, F.lit("-Infinity").cast("double")).alias(column))


def ensemble(
    models: list[DataFrame], neighbours: list[DataFrame], mix_first: bool, weight: float, temperature: float, threshold: float | None = None, pad: int | None = None
) -> DataFrame:
    """Mean of several models: each mixed with its own neighbours before the mean, or the mean mixed once with the first's."""
    tagged = lambda parts: [p.withColumn("model", F.lit(i)) for i, p in enumerate(parts)]

    def union(parts):
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    if mix_first:
        each = [mixed(m, n, weight, temperature, threshold, pad) for m, n in zip(models, neighbours, strict=True)]
        return log_mean(union(tagged(each)), len(models))
    mean = log_mean(union(tagged(models)), len(models))
    return mixed(mean, neighbours[0], weight, temperature, threshold, pad)


def model_probs(logits: DataFrame, temperature: float = 1.0) -> DataFrame:
    """logits(qid, token_id, logit) -> log-probabilities of logit / temperature."""
    key = Window.partitionBy("qid")
    scaled = logits.withColumn("_s", F.col("logit") / F.lit(float(temperature)))
    top = F.max("_s").over(key)
    shifted = scaled.withColumn("_top", top).withColumn("_sum", F.sum(F.exp(F.col("_s") - F.col("_top"))).over(key))
    return shifted.select("qid", "token_id", (F.col("_s") - F.col("_top") - F.ln("_sum")).alias("lprob"))
