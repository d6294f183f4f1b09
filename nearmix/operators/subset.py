"""Search inside what a query's sentence retrieved: sentence neighbours, their rows, and the best of those rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearmix.functions import vectors as V
from nearmix.operators import pq


def sentence_vectors(rows: DataFrame, dim: int, pad: int | None = None) -> DataFrame:
    """rows(seq_id, vec[, token_id]) -> (seq_id, vec): the mean over rows that aren't padding.

    A sentence of padding alone has the zero vector.
    """
    v = V.doubles("vec")
    real = F.lit(True) if pad is None else F.col("token_id") != pad
    n = F.greatest(F.count(F.when(real, 1)).cast("double"), F.lit(V.FLOOR))
    sums = [(F.coalesce(F.sum(F.when(real, F.get(v, F.lit(i)))), F.lit(0.0)) / n).alias(f"x{i}") for i in range(dim)]
    return rows.groupBy("seq_id").agg(*sums).select("seq_id", F.array(*[F.col(f"x{i}") for i in range(dim)]).alias("vec"))


def subset_rows(neighbours: DataFrame, sentences: DataFrame, values: DataFrame) -> DataFrame:
    """Rows of each sentence's retrieved sentences, in order of rank, then row.

    neighbours(sent_id, rank, seq_id), sentences(seq_id, begin, end), values(row_id, token_id)
    -> (sent_id, cand_pos, row_id, token_id). Empty sentences add nothing.
    """
    spans = neighbours.join(sentences.select("seq_id", "begin", "end").where("end > begin"), "seq_id")
    each = spans.select("sent_id", "rank", F.explode(F.sequence("begin", F.col("end") - 1)).alias("row_id"))
    order = Window.partitionBy("sent_id").orderBy("rank", "row_id")
    placed = each.withColumn("cand_pos", (F.row_number().over(order) - 1).cast("long"))
    return placed.join(values.select("row_id", "token_id"), "row_id").select("sent_id", "cand_pos", "row_id", "token_id")


def best_of_subset(queries: DataFrame, subset: DataFrame, codes: DataFrame, codebook: np.ndarray, k: int, metric: str = "l2") -> DataFrame:
    """queries(qid, sent_id, vec) -> (qid, rank, row_id, token_id, score): the k best by asymmetric distances.

    Ties go to the candidate that stands first. The join is on the sentence, so a query meets only
    its own candidates.
    """
    luts = pq.lookup_tables(queries.select("qid", "vec"), codebook, metric)
    asked = queries.select("qid", "sent_id").join(luts, "qid")
    held = subset.join(codes.select("row_id", "code"), "row_id")
    raw = pq.table_distance("lut", "code", codebook.shape[1])
    scored = asked.join(held, "sent_id").select("qid", "cand_pos", "row_id", "token_id", V.score(raw, metric).alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "cand_pos")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("qid", "rank", "row_id", "token_id", "score")


def reorder(state: DataFrame, new_order: DataFrame, beam: int) -> DataFrame:
    """state(sent_id, ..) for sentences that stay after a search step.

    new_order(place, source): place i of the new batch of beams takes what stood at ``source``; of each
    ``beam`` places the first tells its sentence's former number.
    """
    picked = new_order.where(F.col("place") % beam == 0).select((F.col("place") / beam).cast("long").alias("_new"), F.floor(F.col("source") / beam).cast("long").alias("sent_id"))
    return state.join(picked, "sent_id").withColumn("sent_id", F.col("_new")).drop("_new")
