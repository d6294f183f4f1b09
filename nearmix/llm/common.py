"""Helpers that the corpus operators share: reading, shared scratch tables, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDS = 4
HELD_OUT = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id="doc_id"):
    """crc32 of the id as text, modulo FOLDS; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS


def held_out(doc_id="doc_id"):
    """True for rows of the held-out fold; a null id is never held out."""
    return F.coalesce(fold(doc_id) == HELD_OUT, F.lit(False))


def learnable(doc_id="doc_id"):
    """True for rows a model may learn from; a null id has no fold, so it is left out."""
    return F.coalesce(fold(doc_id) != HELD_OUT, F.lit(False))


class Scratch:
    """Parquet tables in the folder all executors share (spark.checkpoint.dir).

    A table cuts the lineage: a lost executor costs its own running tasks, not the
    iterations before. Where the setting is absent, a local session makes a folder up and any other
    raises an error.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not f"{spark.conf.get('spark.master', '')}[".startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.gettempdir() + "/nearmix-scratch"
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def path(self, name: str = "t") -> str:
        self.count += 1
        return f"{self.root}/{name}{self.count}"

    def store(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write df and return it as read back; ``drop`` removes it."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._nearmix_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete stored tables that no later plan reads."""
        for df in frames:
            self.drop_path(df._nearmix_path)

    def drop_path(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def _slices(batch: pa.RecordBatch, rows: int, size: int | None) -> Iterator[tuple[int, int]]:
    if size is None:
        yield from ((at, rows) for at in range(0, batch.num_rows, rows))
        return
    lengths = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            lengths += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    past, at = np.concatenate(([0], np.cumsum(lengths))), 0
    while at < batch.num_rows:
        end = int(np.searchsorted(past, past[at] + size, "right")) - 1
        n = max(1, min(end - at, rows, batch.num_rows - at))
        yield at, n
        at += n


def give_back() -> None:
    """Return freed memory to the system; a worker that waits for its next task would keep it otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # not every libc has it
        ctypes.CDLL(None).malloc_trim(0)


def collect_garbage(spark: SparkSession) -> None:
    """Have the executors' JVMs collect their garbage and return free heap to the system.

    A heap keeps the size that the largest need so far gave it, beside which Python workers need
    room. One short task a core; an executor that gets none keeps its heap.
    """
    n = max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def map_texts(
    df: DataFrame,
    columns: list[str],
    schema: str,
    make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch] | None]],
    rows: int = 256,
    size: int | None = None,
) -> DataFrame:
    """Run a batch function over ``columns`` of df, at most ``rows`` rows at a time.

    With ``size`` a slice also ends where it would hold more bytes than that (a single row may).

    ``make`` is called once per task and returns the batch function; results are cast to
    ``schema`` by Spark. Slices keep Python's share of a batch of long texts small. When a task
    ends, what it took goes back to the system.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for at, n in _slices(batch, rows, size):
                out = step(batch.slice(at, n))
                if out is None:
                    continue
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out
        step = batch = out = None  # noqa: F841
        give_back()

    return df.select(*columns).mapInArrow(run, schema)


def values_sql(rows: list[tuple], names: list[str]) -> str:
    """A VALUES list as a SQL table expression."""

    def lit(x) -> str:
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    body = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    return f"(VALUES {body}) AS t({', '.join(names)})"
