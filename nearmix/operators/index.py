"""A stored index over key vectors: configuration, fitted tables, and postings that grow by appends.

Layout of an index folder (all Parquet but the configuration):

    config.json   one object of the eight fields of IndexConfig
    transform     (matrix, bias) of the linear map before everything else, if there is one
    centroids     (list_id, centroid), if keys are dealt to lists
    codebook      (m, c, centroid), if keys are quantised
    postings      (row_id, vec[, list_id]), a folder for each batch of keys, in it folders of some lists
                  each, sorted by list: a search reads the folders and row groups it asks for

Fitting never touches postings, and clearing them keeps what was fitted. A batch is written under
its number, so writing it again (a retried job, a repeated streaming epoch) replaces it.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmix.functions import vectors as V
from nearmix.operators import ivf, pq, train, transform
from nearmix.operators.topk import LIST_PART, LISTS_PER_PART, nearest
from nearmix.sources.shared import exists, read_text, remove, write_text


@dataclass(frozen=True)
class IndexConfig:
    """hnsw_edges is kept for configurations that name it; centroids and keys are always scanned exactly."""

    backend: str = "spark"
    metric: str = "l2"
    hnsw_edges: int = 0
    ivf_lists: int = 0
    pq_subvec: int = 0
    transform_dim: int = -1
    use_opq: bool = False
    use_pca: bool = False

    def __post_init__(self):
        V.known_metric(self.metric)
        if self.use_opq and self.use_pca:
            raise ValueError("a fitted rotation and PCA exclude each other")
        if self.use_opq and self.pq_subvec < 1:
            raise ValueError("a fitted rotation needs pq_subvec")
        if min(self.hnsw_edges, self.ivf_lists, self.pq_subvec) < 0:
            raise ValueError("numbers of edges, lists and sub-vectors must not be negative")

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> IndexConfig:
        return cls(**json.loads(text))


@dataclass
class Fitted:
    """Bounded tables that fitting made, as arrays."""

    matrix: np.ndarray | None = None
    bias: np.ndarray | None = None
    centroids: np.ndarray | None = None
    codebook: np.ndarray | None = None


@dataclass
class VectorIndex:
    """An index in a folder. ``add`` and ``search`` follow the configuration; scores are larger for nearer keys."""

    spark: SparkSession
    path: str
    config: IndexConfig = field(default_factory=IndexConfig)
    fitted: Fitted = field(default_factory=Fitted)
    nprobe: int = 1
    efsearch: int = 64

    # configuration

    def set_nprobe(self, n: int) -> None:
        if n < 1:
            raise ValueError("nprobe must be at least 1")
        self.nprobe = n

    def set_efsearch(self, n: int) -> None:
        """Checked and kept, but without effect: there is no graph."""
        if n < 1:
            raise ValueError("efsearch must be at least 1")
        self.efsearch = n

    @property
    def is_trained(self) -> bool:
        c, f = self.config, self.fitted
        return not ((c.ivf_lists and f.centroids is None) or (c.pq_subvec and f.codebook is None) or ((c.use_opq or c.use_pca) and f.matrix is None))

    # fitting

    def fit(
        self, keys: DataFrame, rows: int = train.TRAIN_ROWS, seed: int = 0, n_code: int = pq.CODEWORDS, code_rows: int = train.CODE_ROWS
    ) -> VectorIndex:
        """Fit what the configuration asks for on the first ``rows`` keys(row_id, vec).

        Centroids and PCA are fitted by distributed passes over all of these; rotations and
        codebooks, of at most 256 codewords a sub-space, on ``code_rows`` of them.
        """
        c = self.config
        learnt = train.first_rows(keys, rows, c.metric)
        x = train.bounded(learnt, code_rows)
        to = c.transform_dim if c.transform_dim > 0 else x.shape[1]
        self.fitted = Fitted()
        if c.use_pca:
            self.fitted.matrix, self.fitted.bias = transform.pca(learnt, x.shape[1], to)
        elif c.use_opq:
            self.fitted.matrix = train.rotation(x, c.pq_subvec, to, min(n_code, len(x)), seed=seed, spark=self.spark)
        y = x if self.fitted.matrix is None else x @ self.fitted.matrix.T + (0 if self.fitted.bias is None else self.fitted.bias)
        if c.ivf_lists:
            moved = transform.apply(learnt, self.fitted.matrix, self.fitted.bias, "row_id")
            self.fitted.centroids = train.lloyd(moved, c.ivf_lists, seed=seed)
            if c.pq_subvec:
                y = y - self.fitted.centroids[train.nearest_centre(y, self.fitted.centroids)[0]]
        if c.pq_subvec:
            self.fitted.codebook = train.codebook(y, c.pq_subvec, min(n_code, len(y)), seed=seed, spark=self.spark)
        return self

    # contents

    def _moved(self, df: DataFrame, key: str) -> DataFrame:
        """Vectors as the index stores them: normalised for cos, then mapped."""
        made = df.select(F.col(key).cast("long").alias(key), V.prepared("vec", self.config.metric).alias("vec"))
        return transform.apply(made.where("vec IS NOT NULL"), self.fitted.matrix, self.fitted.bias, key)

    def _inner(self) -> str:
        """The metric between stored vectors: after normalisation cos is the inner product."""
        return "l2" if self.config.metric == "l2" else "ip"

    def _centroid_table(self) -> DataFrame:
        rows = [(i, [float(v) for v in c]) for i, c in enumerate(self.fitted.centroids)]
        return self.spark.createDataFrame(rows, "list_id int, centroid array<double>")

    def add(self, keys: DataFrame, batch: int = 0) -> None:
        """Store keys(row_id, vec) as batch number ``batch``, which replaces a former batch of that number."""
        if not self.is_trained:
            raise ValueError("the index has to be fitted before keys are added")
        moved = self._moved(keys, "row_id")
        out = moved
        if self.fitted.centroids is not None:
            out = ivf.postings(moved, self._centroid_table(), self._inner())
            if self.fitted.codebook is not None:
                out = ivf.residual_codes(out, self.fitted.centroids, self.fitted.codebook)
        elif self.fitted.codebook is not None:
            out = pq.encode(moved, self.fitted.codebook).withColumnRenamed("code", "vec")
        writer = out.write
        if "list_id" in out.columns:
            # Lists side by side; the ranges go by rows too, so that one list may fill many of them.
            out = out.withColumn(LIST_PART, F.floor(F.col("list_id") / LISTS_PER_PART).cast("int"))
            dealt = out.repartitionByRange(F.col(LIST_PART), F.col("list_id"), F.col("row_id")).sortWithinPartitions(LIST_PART, "list_id", "row_id")
            writer = dealt.write.partitionBy(LIST_PART)
        writer.mode("overwrite").parquet(f"{self.path}/postings/batch={batch}")

    def _stored(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings").drop("batch")

    def postings(self) -> DataFrame:
        """(row_id, vec[, list_id]): what is stored."""
        return self._stored().drop(LIST_PART)

    def __len__(self) -> int:
        return self.postings().count() if exists(self.spark, f"{self.path}/postings") else 0

    def clear(self) -> None:
        """Drop all keys; what was fitted stays."""
        remove(self.spark, f"{self.path}/postings")

    def search(self, queries: DataFrame, k: int, idmap: DataFrame | None = None) -> DataFrame:
        """queries(qid, vec) -> (qid, rank, row_id, score); with idmap(row_id, value), value too."""
        asked, metric, f = self._moved(queries, "qid"), self._inner(), self.fitted
        if f.centroids is not None:
            decode = ivf.residual_decoder(f.centroids, f.codebook) if f.codebook is not None else None
            found = ivf.search(asked, self._stored(), self._centroid_table(), k, self.nprobe, metric, decode)
        elif f.codebook is not None:
            found = pq.nearest_by_table(asked, self.postings().withColumnRenamed("vec", "code"), f.codebook, k, metric)
        else:
            found = nearest(asked, self.postings(), k, metric)
        return found if idmap is None else found.join(idmap.select("row_id", "value"), "row_id").select("qid", "rank", "row_id", "score", "value")

    # persistence

    def save(self, overwrite: bool = False) -> None:
        if not overwrite and exists(self.spark, f"{self.path}/config.json"):
            held = IndexConfig.from_json(read_text(self.spark, f"{self.path}/config.json"))
            if held != self.config:
                raise FileExistsError(f"another index is stored in {self.path}")
        spark, f = self.spark, self.fitted
        write_text(spark, f"{self.path}/config.json", self.config.to_json())
        if f.matrix is not None:
            bias = None if f.bias is None else [float(x) for x in f.bias]
            rows = [([[float(x) for x in r] for r in f.matrix], bias)]
            spark.createDataFrame(rows, "matrix array<array<double>>, bias array<double>").write.mode("overwrite").parquet(f"{self.path}/transform")
        if f.centroids is not None:
            self._centroid_table().write.mode("overwrite").parquet(f"{self.path}/centroids")
        if f.codebook is not None:
            pq.as_table(spark, f.codebook).write.mode("overwrite").parquet(f"{self.path}/codebook")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        if not exists(spark, f"{path}/config.json"):
            raise FileNotFoundError(f"{path} holds no index")
        config, f = IndexConfig.from_json(read_text(spark, f"{path}/config.json")), Fitted()
        if config.use_opq or config.use_pca:
            row = spark.read.parquet(f"{path}/transform").first()
            f.matrix, f.bias = np.array(row["matrix"]), None if row["bias"] is None else np.array(row["bias"])
        if config.ivf_lists:
            rows = sorted(spark.read.parquet(f"{path}/centroids").collect(), key=lambda r: r["list_id"])
            f.centroids = np.array([r["centroid"] for r in rows])
        if config.pq_subvec:
            f.codebook = pq.as_array(spark.read.parquet(f"{path}/codebook"))
        return cls(spark, path, config, f)


BACKENDS = {"spark": VectorIndex}


def build_index(spark: SparkSession, path: str, config: IndexConfig | None = None) -> VectorIndex:
    config = config or IndexConfig()
    if config.backend not in BACKENDS:
        raise ValueError(f"unknown backend {config.backend!r}; one of {tuple(BACKENDS)}")
    return BACKENDS[config.backend](spark, path, config)


def load_index(spark: SparkSession, path: str) -> VectorIndex:
    return VectorIndex.load(spark, path)
