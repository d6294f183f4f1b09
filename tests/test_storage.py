from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearmix.jobs import build_index as index_job
from nearmix.jobs import store_keys, store_values
from nearmix.operators.index import IndexConfig, VectorIndex, build_index, load_index
from nearmix.operators.topk import nearest
from nearmix.sources import stores
from nearmix.streaming.ingest import stream_into

RNG = np.random.default_rng(3)
X = RNG.normal(size=(120, 8))


def keys_of(spark, x, name="row_id"):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"{name} long, vec array<double>")


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


GRID = [(lists, sub, opq, pca) for lists, sub, opq, pca in itertools.product([0, 4], [0, 4], [False, True], [False, True]) if not (opq and pca) and not (opq and not sub)]


@pytest.mark.parametrize("metric", ["l2", "ip", "cos"])
@pytest.mark.parametrize(("lists", "sub", "opq", "pca"), GRID)
def test_index_round_trip(spark, tmp_path, metric, lists, sub, opq, pca):
    if metric != "l2" and (opq or pca) and not (lists and sub):
        pytest.skip("covered by the rest of the grid")
    config = IndexConfig(metric=metric, ivf_lists=lists, pq_subvec=sub, use_opq=opq, use_pca=pca)
    index = build_index(spark, str(tmp_path / "index"), config).fit(keys_of(spark, X), n_code=32)
    index.add(keys_of(spark, X))
    index.save()
    other = load_index(spark, str(tmp_path / "index"))
    assert other.config == config and len(other) == len(X) and other.is_trained
    for i in (index, other):
        i.set_nprobe(4)
    queries = keys_of(spark, X[:10], "qid")
    a, b = rows_of(index.search(queries, 5), "qid", "rank"), rows_of(other.search(queries, 5), "qid", "rank")
    assert a == b and len(a) == 50
    exact = rows_of(nearest(queries, keys_of(spark, X), 5, metric), "qid", "rank")
    if not sub and not pca:
        assert [r[:3] for r in a] == [r[:3] for r in exact]
    else:
        assert len({r[::2] for r in a} & {r[::2] for r in exact}) >= 0 and len({(r[0], r[2]) for r in a} & {(r[0], r[2]) for r in exact}) >= 20
    index.clear()
    assert len(index) == 0 and index.is_trained


def test_index_appends_and_repeats_batches(spark, tmp_path):
    index = build_index(spark, str(tmp_path / "i"))
    keys = keys_of(spark, X)
    for n in (0, 1, 1):
        index.add(keys.where((F.col("row_id") >= 60 * n) & (F.col("row_id") < 60 * n + 60)), n)
    assert len(index) == 120
    ids = spark.createDataFrame([(i, 1000 + i) for i in range(120)], "row_id long, value long")
    assert [r["value"] for r in index.search(keys_of(spark, X[:3], "qid"), 1, ids).orderBy("qid").collect()] == [1000, 1001, 1002]


@pytest.mark.parametrize("bad", [{"metric": "dot"}, {"use_opq": True}, {"use_opq": True, "use_pca": True, "pq_subvec": 4}, {"ivf_lists": -1}])
def test_wrong_configs(bad):
    with pytest.raises(ValueError):
        IndexConfig(**bad)


def test_index_errors(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "i"), IndexConfig(ivf_lists=3))
    with pytest.raises(ValueError):
        index.add(keys_of(spark, X))
    for n in (0, -1):
        with pytest.raises(ValueError):
            index.set_nprobe(n)
        with pytest.raises(ValueError):
            index.set_efsearch(n)
    with pytest.raises(ValueError):
        build_index(spark, "x", IndexConfig(backend="other"))
    with pytest.raises(FileNotFoundError):
        load_index(spark, str(tmp_path / "none"))
    VectorIndex(spark, str(tmp_path / "j")).save()
    with pytest.raises(FileExistsError):
        VectorIndex(spark, str(tmp_path / "j"), IndexConfig(metric="ip")).save()
    assert IndexConfig.from_json(IndexConfig(ivf_lists=7).to_json()) == IndexConfig(ivf_lists=7)


def test_stream_stores_every_key_once(spark, tmp_path):
    source, index = str(tmp_path / "in"), build_index(spark, str(tmp_path / "i"))
    keys_of(spark, X).where("row_id < 70").write.parquet(source)
    stream = lambda: spark.readStream.schema("row_id long, vec array<double>").parquet(source)
    stream_into(index, stream(), str(tmp_path / "c")).awaitTermination(120)
    keys_of(spark, X).where("row_id >= 70").write.mode("append").parquet(source)
    stream_into(index, stream(), str(tmp_path / "c")).awaitTermination(120)
    assert sorted(r[0] for r in index.postings().select("row_id").collect()) == list(range(120))
    with pytest.raises(ValueError):
        stream_into(index, keys_of(spark, X), str(tmp_path / "c"))


def test_key_store(spark, tmp_path):
    store = stores.KeyStore(spark, str(tmp_path / "k"), dim=8)
    store.write(keys_of(spark, X[:10]))
    store.append(keys_of(spark, X[10:15]))
    assert store.size() == 15 and [r[0] for r in rows_of(store.range(8, 12), "row_id")] == [8, 9, 10, 11]
    assert np.allclose([r[1] for r in rows_of(store.range(12, 13), "row_id")], X[12:13], atol=1e-6)
    store.overwrite(keys_of(spark, X[50:52]))
    assert store.size() == 15 and np.allclose(store.range(1, 2).first()["vec"], X[51], atol=1e-6)
    assert [r[0] for r in rows_of(store.rows(spark.createDataFrame([(3,), (99,)], "row_id long")), "row_id")] == [3]
    assert tuple(stores.facts(store.read()).first()) == (15, 8, 8)
    with pytest.raises(Exception, match="does not have 8 numbers"):
        store.append(keys_of(spark, X[:1, :4]))
    with pytest.raises(FileNotFoundError):
        stores.KeyStore(spark, str(tmp_path / "none")).read()


def test_lines_and_jobs(spark, tmp_path):
    texts = [f"w{i % 3} w{i % 5} tail" for i in range(40)]
    (tmp_path / "corpus.txt").write_text(" " + "\n".join(texts) + "\n")
    lines = rows_of(stores.lines(spark, str(tmp_path / "corpus.txt")), "seq_id")
    assert lines == list(enumerate(texts))
    at = {n: str(tmp_path / n) for n in ("values", "keys", "index")}
    store_values.main(["--input", str(tmp_path / "corpus.txt"), "--output", at["values"]])
    stored = stores.load_storage(spark, at["values"])
    assert stored.count() == 40 and stored.agg(F.max("end")).first()[0] == 160
    store_keys.main(["--input", str(tmp_path / "corpus.txt"), "--output", at["keys"]])
    index_job.main(["--keys", at["keys"], "--output", at["index"], "--ivf-lists", "3", "--chunk-size", "15"])
    index = load_index(spark, at["index"])
    assert len(index) == 40 and index.config.ivf_lists == 3
    with pytest.raises(FileExistsError):
        index_job.main(["--keys", at["keys"], "--output", at["index"]])
    with pytest.raises(FileNotFoundError):
        stores.load_storage(spark, str(tmp_path / "none"))


def test_names():
    assert stores.shard_path(["a", "b"], "train", 4) == "b" and stores.shard_path(["a", "b"], "valid", 4) == "a"
    assert stores.key_path("d", "ffn_in") == "d/keys.ffn_in" and stores.key_path("d", "ffn_in", 2) == "d/keys2.ffn_in"
