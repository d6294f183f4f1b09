"""Every registered query of the engine against its SQL, or its invariants."""

from __future__ import annotations

import numpy as np
import pytest

from nearmix import catalog
from nearmix.operators import tokens
from nearmix.plans import tables as T
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert not compare(catalog.queries()[name](spark, SF), con, SQL[name])


def test_queries_without_sql():
    assert set(catalog.queries()) - set(SQL) == {"pca_transform", "kmeans_ivf_topk", "opq_topk"}


@pytest.mark.parametrize("name", ["batch_sampler", "token_intervals", "batch_order", "raw_sentences"])
def test_lengths_need_no_vocabulary(spark, con, name, monkeypatch):
    monkeypatch.setattr(tokens, "vocabulary", None)
    assert not compare(catalog.queries()[name](spark, SF), con, SQL[name])


@pytest.mark.parametrize("name", ["non_pad_counts", "pad_sequences"])
def test_tokens_stay_in_their_rows(spark, name):
    """Counts are taken, and widths known, without a row a token or a join of sentences to their batches."""
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Join") == plan.count("rightHint=(strategy=broadcast)")


def _vectors(spark):
    rows = sorted(T.keys(spark, SF).collect(), key=lambda r: r["row_id"])
    return np.array([r["row_id"] for r in rows]), np.array([r["vec"] for r in rows], float)


def _recall(spark, name, k=16):
    ids, x = _vectors(spark)
    found = {}
    for r in catalog.queries()[name](spark, SF).collect():
        found.setdefault(r["qid"], set()).add(r["row_id"])
    asked = ids[ids % T.EVERY == 0]
    assert set(found) == set(asked.tolist())
    hits = 0
    for q in asked.tolist():
        d = ((x - x[ids == q][0]) ** 2).sum(1)
        hits += len(found[q] & set(ids[np.argsort(d, kind="stable")[:k]].tolist()))
    return hits / (k * len(asked))


def test_fitted_lists_recall(spark):
    assert _recall(spark, "kmeans_ivf_topk") >= 0.9


def test_fitted_rotation_recall(spark):
    assert _recall(spark, "opq_topk") >= 0.9


def test_pca_keeps_most_variance(spark):
    ids, x = _vectors(spark)
    made = sorted(catalog.queries()["pca_transform"](spark, SF).collect(), key=lambda r: r["row_id"])
    y = np.array([r["vec"] for r in made])
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1][:16]
    assert np.allclose(y.mean(0), 0, atol=1e-5)
    assert np.allclose(np.sort(y.var(0))[::-1], values, atol=1e-5)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["qid", "token_id", "lprob"]
