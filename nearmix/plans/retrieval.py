"""From a configuration to a plan: plain model, retrieval over the whole store, or inside retrieved sentences."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from nearmix.functions import vectors as V
from nearmix.operators import mix, subset
from nearmix.operators.index import VectorIndex
from nearmix.operators.topk import nearest, without_own


@dataclass(frozen=True)
class KnnQuery:
    """Defaults of a task's options. A weight of 0 leaves the model alone."""

    topk: int = 16
    nprobe: int = 32
    efsearch: int = 64
    src_topk: int = 5
    src_nprobe: int = 64
    src_efsearch: int = 64
    threshold: float | None = None
    weight: float = 0.0
    temperature: float = 100.0
    ensemble: bool = False
    pad: int | None = 1
    language_token: int | None = None
    #: Queries are rows of the store themselves (qid is their row_id), and none is its own neighbour.
    leave_own: bool = False

    def mode(self, src_model: str | None = None, src_key: str = "senttr") -> str:
        """plain, vanilla or subset: sentences are asked first if a sentence model or the encoder's own states are named."""
        if self.weight <= 0:
            return "plain"
        return "subset" if src_model or src_key == "enc" else "vanilla"


class Retriever(ABC):
    """queries -> neighbours(qid, rank, row_id, token_id, score)."""

    def __init__(self, query: KnnQuery):
        self.query = query

    @abstractmethod
    def neighbours(self, queries: DataFrame) -> DataFrame: ...

    def probs(self, queries: DataFrame) -> DataFrame:
        """Neighbours with their softmax weight."""
        return mix.neighbour_probs(self.neighbours(queries), self.query.temperature, self.query.threshold)

    def mixed(self, model: DataFrame, queries: DataFrame) -> DataFrame:
        """The model's (qid, token_id, lprob) mixed with what is retrieved."""
        q = self.query
        out = model if q.weight <= 0 else mix.mixed(model, self.neighbours(queries), q.weight, q.temperature, q.threshold, q.pad)
        return out if q.language_token is None else out.where(f"token_id <> {int(q.language_token)}")


class Vanilla(Retriever):
    """Over all keys of an index, or of a table of keys."""

    def __init__(self, query: KnnQuery, values: DataFrame, index: VectorIndex | None = None, keys: DataFrame | None = None, metric: str = "l2"):
        super().__init__(query)
        if (index is None) == (keys is None):
            raise ValueError("either an index or keys")
        V.known_metric(metric)
        self.values, self.index, self.keys, self.metric = values, index, keys, metric

    def neighbours(self, queries: DataFrame) -> DataFrame:
        k = self.query.topk + self.query.leave_own
        if self.index is None:
            found = nearest(queries, self.keys, k, self.metric)
        else:
            self.index.set_nprobe(self.query.nprobe)
            self.index.set_efsearch(self.query.efsearch)
            found = self.index.search(queries, k)
        if self.query.leave_own:
            found = without_own(found, self.query.topk)
        return mix.with_values(found, self.values)


class Subset(Retriever):
    """Over the rows of the sentences that a query's sentence retrieves; keys are product-quantised."""

    def __init__(self, query: KnnQuery, sentence_queries: DataFrame, sentence_keys: DataFrame, sentences: DataFrame, values: DataFrame, codes: DataFrame, codebook: np.ndarray, metric: str = "l2"):
        super().__init__(query)
        self.sentence_queries, self.sentence_keys, self.sentences = sentence_queries, sentence_keys, sentences
        self.values, self.codes, self.codebook, self.metric = values, codes, codebook, metric

    def sentence_neighbours(self) -> DataFrame:
        """(sent_id, rank, seq_id, score)."""
        asked = self.sentence_queries.selectExpr("sent_id AS qid", "vec")
        found = nearest(asked, self.sentence_keys.selectExpr("seq_id AS row_id", "vec"), self.query.src_topk, self.metric)
        return found.selectExpr("qid AS sent_id", "rank", "row_id AS seq_id", "score")

    def rows(self) -> DataFrame:
        return subset.subset_rows(self.sentence_neighbours(), self.sentences, self.values)

    def neighbours(self, queries: DataFrame) -> DataFrame:
        return subset.best_of_subset(queries, self.rows(), self.codes, self.codebook, self.query.topk, self.metric)
