"""Global ranks and running sums without a one-partition window.

A window without a partition key moves all rows to one task. Here rows are dealt by ranges of the
order and sorted there, each range is numbered and summed by the task that sorted it, and the sums of
the ranges before (one row for each range) are broadcast and added.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from nearmix.sources.shared import materialised


def ranked(df: DataFrame, order: list[Column], rank: str = "slot", running: dict[str, str] | None = None, parts: int | None = None) -> DataFrame:
    """df with ``rank`` (from 0) in a total order and, for each (name: column) of running, the column's sum over earlier rows."""
    running = running or {}
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names, columns = list(running), list(running.values())

    def number(batches):
        """A range's rows come in order: their places and sums inside the range, without another shuffle."""
        part, at, sums = TaskContext.get().partitionId(), 0, [0] * len(columns)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            arrays = [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n, dtype=np.int64))]
            for i, c in enumerate(columns):
                own = pc.fill_null(batch.column(c).cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
                ends = np.cumsum(own) + sums[i]
                arrays.append(pa.array(ends - own))
                sums[i] = int(ends[-1])
            at += n
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *added])

    added = ["_range", "_in_range", *[f"_in_sum_{n}" for n in names]]
    schema = StructType([*df.schema.fields, StructField("_range", IntegerType()), *[StructField(c, LongType()) for c in added[1:]]])
    dealt = materialised(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(number, schema), "ranges")
    sums = [F.count("*").alias("_rows"), *[F.sum(F.col(c).cast("long")).alias(f"_sum_{n}") for n, c in running.items()]]
    by_range = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range: at most ``parts`` of them.
    before = dealt.groupBy("_range").agg(*sums)
    totals = ["_rows", *[f"_sum_{n}" for n in names]]
    before = before.select("_range", *[F.coalesce(F.sum(c).over(by_range), F.lit(0)).alias(f"_before{c}") for c in totals])
    out = dealt.join(F.broadcast(before), "_range")
    out = out.withColumn(rank, F.col("_before_rows") + F.col("_in_range"))
    for n in names:
        out = out.withColumn(n, (F.col(f"_before_sum_{n}") + F.col(f"_in_sum_{n}")).cast("long"))
    return out.select(*df.columns, rank, *names)
