"""Key and token stores as Parquet tables with explicit row ids, and text lines as a source.

Rows are named by row_id, never by their position in a file, so reading a range is a pushed-down
filter, appending needs no write pointer, and overwriting a range replaces rows by id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmix.functions import vectors as V
from nearmix.operators.order import ranked
from nearmix.sources.shared import exists, materialised


@dataclass
class KeyStore:
    """keys(row_id, vec array<float>) in a folder."""

    spark: SparkSession
    path: str
    dim: int | None = None
    compression: str = "zstd"

    def _typed(self, keys: DataFrame) -> DataFrame:
        rows = keys.select(F.col("row_id").cast("long").alias("row_id"), F.col("vec").cast("array<float>").alias("vec"))
        return V.checked(rows, "vec", self.dim)

    def read(self) -> DataFrame:
        if not exists(self.spark, self.path):
            raise FileNotFoundError(self.path)
        return self.spark.read.parquet(self.path)

    def range(self, begin: int, end: int) -> DataFrame:
        return self.read().where((F.col("row_id") >= begin) & (F.col("row_id") < end))

    def rows(self, ids: DataFrame) -> DataFrame:
        return self.read().join(ids.select("row_id"), "row_id", "left_semi")

    def write(self, keys: DataFrame, mode: str = "error") -> None:
        self._typed(keys).write.mode(mode).option("compression", self.compression).parquet(self.path)

    def append(self, keys: DataFrame) -> None:
        """keys(row_id, vec) numbered from 0 among themselves, put behind what is stored."""
        self._typed(keys.withColumn("row_id", F.col("row_id") + self.size())).write.mode("append").option("compression", self.compression).parquet(self.path)

    def overwrite(self, keys: DataFrame) -> None:
        """Replace the rows that keys names."""
        whole = materialised(replaced(self.read(), self._typed(keys)), "keys")
        whole.write.mode("overwrite").option("compression", self.compression).parquet(self.path)

    def size(self) -> int:
        return self.spark.read.parquet(self.path).count() if exists(self.spark, self.path) else 0


def replaced(stored: DataFrame, rows: DataFrame, key: str = "row_id") -> DataFrame:
    return stored.join(rows.select(key), key, "left_anti").unionByName(rows)


def facts(keys: DataFrame) -> DataFrame:
    """One row: rows, smallest and largest number of dimensions."""
    return keys.agg(F.count("*").alias("n"), F.min(F.size("vec")).cast("long").alias("least_dim"), F.max(F.size("vec")).cast("long").alias("most_dim"))


def save_storage(sentences: DataFrame, path: str, mode: str = "error") -> None:
    sentences.write.mode(mode).parquet(path)


def load_storage(spark: SparkSession, path: str) -> DataFrame:
    """Sentences as stored, with offsets computed anew."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    stored = spark.read.parquet(path).drop("begin", "end")
    placed = ranked(stored, [F.col("slot")], "_place", {"begin": "length"}).drop("_place")
    return placed.select("seq_id", "slot", "length", "begin", (F.col("begin") + F.col("length")).alias("end"), "tokens")


def lines(spark: SparkSession, path: str, strip: bool = True) -> DataFrame:
    """(seq_id, text): the lines of a text file in order, numbered from 0.

    Spark numbers lines by file split and place within it, so a whole file keeps its order.
    """
    read = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("_at"))
    text = F.trim("value") if strip else F.col("value")
    return ranked(read.select(text.alias("text"), "_at"), [F.col("_at")], "seq_id").select("seq_id", "text")


def with_raw(rows: DataFrame, raw: DataFrame | None) -> DataFrame:
    """rows(seq_id, ..) with the raw sentence of raw(seq_id, text), null where there is none."""
    if raw is None:
        return rows.withColumn("sentence", F.lit(None).cast("string"))
    return rows.join(raw.select("seq_id", F.col("text").alias("sentence")), "seq_id", "left")


def shard_path(paths: list[str], split: str, epoch: int = 1) -> str:
    """Training reads one path an epoch in turn; other splits read the first."""
    return paths[(epoch - 1) % len(paths)] if split == "train" else paths[0]


def key_path(base: str, key: str, model: int = 0) -> str:
    """Where the keys of a member of an ensemble stand."""
    return f"{base}/keys{model or ''}.{key}"
