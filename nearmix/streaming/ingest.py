"""Keys that arrive as a stream: each micro-batch becomes a batch of an index.

A micro-batch is written under its number, so an epoch that Spark repeats after a failure replaces
itself: every key is stored once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from nearmix.operators.index import VectorIndex

#: Numbers of streamed batches begin here, apart from those of batch jobs.
FIRST_BATCH = 1_000_000


def stream_into(index: VectorIndex, keys: DataFrame, checkpoint: str, available_now: bool = True, every: str = "1 minute") -> StreamingQuery:
    """Append a stream of keys(row_id, vec) to a fitted index."""
    if not keys.isStreaming:
        raise ValueError("keys must come from readStream")
    if not index.is_trained:
        raise ValueError("the index has to be fitted before keys are added")
    writer = keys.writeStream.foreachBatch(lambda batch, n: index.add(batch, FIRST_BATCH + n)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start()
