"""Connected components of an edge table by alternating large-star and small-star rounds.

Published algorithm (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014).
Each round is a minimum per node, which combines on the map side, and an equi-join back on
the node. Both join inputs are stored tables, so their shuffles stand directly below the
join and adaptive execution can split the partition of a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearmix.llm.common import Scratch


def _fixed(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges(u, v) of orderable ids -> (node, label), label the smallest id reachable.

    Nodes without an edge to another node do not appear. Self-loops, repeated edges and
    nulls are ignored.
    """
    ordered = edges.where("u is not null and v is not null and u <> v")
    ordered = ordered.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = scratch.store(ordered.distinct(), "edges")
    state = _fixed(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.store(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = scratch.store(large.distinct(), "large")
        low = scratch.store(star.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = star.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v")))
        after = scratch.store(small.distinct(), "edges")
        scratch.drop(now, least, star, low)
        now, before, state = after, state, _fixed(after)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )
