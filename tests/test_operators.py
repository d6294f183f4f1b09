from __future__ import annotations

import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearmix.functions import encoders, sequences
from nearmix.functions import vectors as V
from nearmix.operators import ivf, mix, pq, subset, tokens, train, transform
from nearmix.operators.index import IndexConfig, build_index
from nearmix.operators.order import ranked
from nearmix.operators.topk import Best, _asked_for, nearest, offer_slice, reference_topk, without_own
from nearmix.plans.retrieval import KnnQuery, Vanilla

RNG = np.random.default_rng(5)


def keys_of(spark, x, name="row_id"):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"{name} long, vec array<double>")


def table_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.mark.parametrize("metric", V.METRICS)
@pytest.mark.parametrize("k", [1, 4, 50])
def test_nearest_equals_definition(spark, metric, k):
    x = RNG.integers(-2, 3, (40, 8)).astype(float)  # many ties
    keys, queries = keys_of(spark, x), keys_of(spark, x[:7], "qid")
    a = nearest(queries, keys, k, metric, block=3)
    b = reference_topk(queries, keys, k, metric)
    told = lambda df: [(q, r, i, round(s, 9)) for q, r, i, s in table_of(df, "qid", "rank")]
    if metric == "cos":  # equal directions of other lengths differ in the last digits
        assert [(q, r, s) for q, r, _, s in told(a)] == [(q, r, s) for q, r, _, s in told(b)]
    else:
        assert told(a) == told(b)


def test_nearest_finds_itself_and_skips_null(spark):
    x = RNG.normal(size=(20, 6))
    keys = keys_of(spark, x).unionByName(spark.createDataFrame([(99, None)], "row_id long, vec array<double>"))
    best = {q: (i, s) for q, r, i, s in table_of(nearest(keys_of(spark, x, "qid"), keys, 1), "qid")}
    assert best == {i: (i, 0.0) for i in range(20)}
    noisy = nearest(keys_of(spark, x + 1e-3, "qid"), keys, 1).collect()
    assert all(r["row_id"] == r["qid"] and math.isclose(r["score"], -6e-6, rel_tol=1e-6) for r in noisy)


def test_nearest_empty_tables(spark):
    none = spark.createDataFrame([], "row_id long, vec array<double>")
    assert nearest(keys_of(spark, np.ones((2, 3)), "qid"), none, 3).count() == 0
    assert nearest(none.withColumnRenamed("row_id", "qid"), keys_of(spark, np.ones((2, 3))), 3).count() == 0


@pytest.mark.parametrize("bad", [lambda s: nearest(s, s, 0), lambda s: nearest(s, s, 1, "dot"), lambda s: ivf.probe(s, s, 0), lambda s: mix.neighbour_probs(s, 0.0)])
def test_wrong_parameters(spark, bad):
    with pytest.raises(ValueError):
        bad(keys_of(spark, np.ones((1, 2))).withColumn("qid", F.lit(0)))


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 30), st.integers(1, 5), st.integers(1, 40), st.integers(0, 10**6))
def test_best_over_slices(n, k, size, seed):
    rng = np.random.default_rng(seed)
    x, q = rng.integers(-3, 4, (n, 3)).astype(float), rng.integers(-3, 4, (4, 3)).astype(float)
    best = Best(4, k)
    for at in range(0, n, size):
        offer_slice(best, x[at : at + size], np.arange(at, min(at + size, n)), q, "l2")
    d = ((q[:, None] - x[None]) ** 2).sum(2)
    for i in range(4):
        order = np.lexsort((np.arange(n), d[i]))[:k]
        assert best.rows[i][: len(order)].tolist() == order.tolist()


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_memory_of_a_slice_does_not_grow_with_the_block(metric):
    x = RNG.integers(-3, 4, (1024, 8)).astype(float)
    most = []
    for n in (512, 4096):
        q, best = RNG.integers(-3, 4, (n, 8)).astype(float), Best(n, 4)
        tracemalloc.start()
        offer_slice(best, x, np.arange(1024), q, metric)
        most.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        i = n - 1
        d = ((q[i] - x) ** 2).sum(1) if metric == "l2" else -(x @ q[i])
        assert best.rows[i].tolist() == np.lexsort((np.arange(1024), d))[:4].tolist()
    assert most[1] < 1.5 * most[0]


def test_normalized(spark):
    rows = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, None)], "row_id long, vec array<float>")
    assert table_of(rows.select("row_id", V.normalized("vec")), "row_id") == [(0, [0.6, 0.8]), (1, [0.0, 0.0]), (2, None)]


def test_checked_dimension(spark):
    with pytest.raises(Exception, match="does not have 3 numbers"):
        V.checked(keys_of(spark, np.ones((1, 2))), dim=3).collect()


# quantisation and lists


def test_codes_and_tables(spark):
    x, book = RNG.normal(size=(50, 8)), RNG.normal(size=(4, 16, 2))
    codes = {r["row_id"]: r["code"] for r in pq.encode(keys_of(spark, x), book).collect()}
    for i in range(50):
        for m in range(4):
            assert codes[i][m] == ((book[m] - x[i, 2 * m : 2 * m + 2]) ** 2).sum(1).argmin()
    back = pq.decode(pq.encode(keys_of(spark, x), book), book)
    for metric in ("l2", "ip"):
        a = pq.nearest_by_table(keys_of(spark, x[:5], "qid"), pq.encode(keys_of(spark, x), book), book, 50, metric, block=2)
        b = reference_topk(keys_of(spark, x[:5], "qid"), back, 50, metric)
        scores = lambda df: {(r["qid"], r["row_id"]): r["score"] for r in df.collect()}
        sa, sb = scores(a), scores(b)
        assert sa.keys() == sb.keys() and all(math.isclose(sa[k], sb[k], abs_tol=1e-9) for k in sa)


def test_blocks_of_queries_read_stored_codes(spark):
    """Each block of queries reads the codes, which are made once; values are the tables' sums to the last digit."""
    x, book, met = RNG.normal(size=(60, 8)) + 1e3, RNG.normal(size=(4, 16, 2)) + 1e3, spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            met.add(b.num_rows)
            yield b

    codes = pq.encode(keys_of(spark, x), book)
    counted = codes.mapInArrow(count, "row_id long, code array<smallint>")
    code = np.array([r["code"] for r in codes.orderBy("row_id").collect()])
    for metric, sign in (("l2", -1), ("ip", 1)):
        met.value = 0
        found = pq.nearest_by_table(keys_of(spark, x[:7], "qid"), counted, book, 5, metric, block=2).collect()
        assert met.value == 60
        luts = pq.tables_of(x[:7], book, metric)
        raw = np.zeros((7, 60))
        for m in range(4):
            raw += luts[:, m][:, code[:, m]]
        want = [(q, n + 1, int(i), sign * raw[q, i]) for q in range(7) for n, i in enumerate(np.lexsort((np.arange(60), -sign * raw[q]))[:5])]
        assert sorted(tuple(r) for r in found) == want


def test_sub_spaces_are_fitted_by_tasks_alike(spark):
    x = RNG.normal(size=(300, 8))
    assert np.array_equal(train.codebook(x, 4, 16), train.codebook(x, 4, 16, spark=spark))
    assert np.array_equal(train.rotation(x, 4, 8, 16, 2), train.rotation(x, 4, 8, 16, 2, spark=spark))


def test_codebook_round_trip(spark):
    book = RNG.normal(size=(3, 5, 2))
    assert np.array_equal(pq.as_array(pq.as_table(spark, book)), book)
    with pytest.raises(ValueError):
        pq.as_array(pq.as_table(spark, book).where("NOT (m = 1 AND c = 2)"))
    with pytest.raises(ValueError):
        pq.sub_size(10, 3)


@pytest.mark.parametrize("nprobe", [1, 2, 5])
def test_lists(spark, nprobe):
    x, c = RNG.normal(size=(60, 4)), RNG.normal(size=(5, 4))
    centroids = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(c)], "list_id int, centroid array<double>")
    posted = ivf.postings(keys_of(spark, x), centroids)
    lists = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
    assert {r["row_id"]: r["list_id"] for r in posted.collect()} == dict(enumerate(lists.tolist()))
    assert dict(table_of(ivf.list_sizes(posted, centroids), "list_id")) == {i: int((lists == i).sum()) for i in range(5)}
    found = ivf.search(keys_of(spark, x[:6], "qid"), posted, centroids, 4, nprobe)
    for q in range(6):
        probed = np.argsort(((x[q] - c) ** 2).sum(1))[:nprobe]
        mine = np.nonzero(np.isin(lists, probed))[0]
        d = ((x[mine] - x[q]) ** 2).sum(1)
        assert [r["row_id"] for r in found.where(F.col("qid") == q).orderBy("rank").collect()] == mine[np.lexsort((mine, d))[:4]].tolist()


def test_postings_of_repeated_ids_and_pruned_reads(spark, tmp_path):
    """A row per key, whatever the ids; a stored index reads the folders of the lists asked for, without a shuffle of vectors."""
    x = np.random.default_rng(4).normal(size=(200, 4))
    centroids = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(x[:100])], "list_id int, centroid array<double>")
    twice = spark.createDataFrame([(1, x[0].tolist()), (1, x[1].tolist()), (None, x[2].tolist()), (3, None)], "row_id long, vec array<double>")
    assert sorted(r["list_id"] for r in ivf.postings(twice, centroids).collect()) == [0, 1, 2]
    assert "Exchange" not in ivf.postings(twice, centroids)._jdf.queryExecution().executedPlan().toString()
    index = build_index(spark, f"file://{tmp_path}/pruned", IndexConfig(ivf_lists=100))
    index.fit(keys_of(spark, x))
    index.set_nprobe(2)
    index.add(keys_of(spark, x))
    stored = index._stored()
    one = _asked_for(stored, [{"lists": [3, 5]}], True)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "list_part" in plan.split("PartitionFilters")[1].split("PushedFilters")[0] and "In(list_id, [3,5])" in plan
    held = {r["row_id"] for r in stored.where("list_id IN (3, 5)").collect()}
    assert {r["row_id"] for r in one.collect()} == held and 0 < len(held) < 200
    best = {r["qid"]: r["row_id"] for r in index.search(keys_of(spark, x, "qid"), 1).collect()}
    assert best == {i: i for i in range(200)}


def test_distributed_centres(spark):
    """Lloyd steps over tasks end where those on one machine end."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(60, 3)) * 0.1 + c for c in ((0, 0, 0), (5, 0, 0), (0, 5, 5))])
    made = train.lloyd(train.first_rows(keys_of(spark, x).repartition(5)), 3)
    want = np.stack([x[i * 60 : i * 60 + 60].mean(0) for i in range(3)])
    assert np.allclose(made[np.lexsort(made.T[::-1])], want[np.lexsort(want.T[::-1])], atol=1e-6)
    first = train.first_rows(keys_of(spark, x), 70)
    assert sorted(r["row_id"] for r in first.collect()) == list(range(70)) and train.bounded(first, 9).shape == (9, 3)


def test_centroid_blocks(spark, monkeypatch):
    x, c = RNG.normal(size=(30, 4)), RNG.normal(size=(7, 4))
    centroids = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(c)], "list_id int, centroid array<double>")
    one = table_of(ivf.nearest_centroids(keys_of(spark, x), centroids, 3), "row_id", "rank")
    monkeypatch.setattr(ivf, "CENTROID_BLOCK", 2)
    assert one == table_of(ivf.nearest_centroids(keys_of(spark, x), centroids, 3), "row_id", "rank")


def test_kmeans_and_rotation():
    centres = np.array([[0, 0], [10, 0], [0, 10]], float)
    x = np.concatenate([c + RNG.normal(scale=0.1, size=(30, 2)) for c in centres])
    found = train.kmeans(x, 3)
    assert sorted(np.round(found).tolist()) == sorted(centres.tolist())
    y = RNG.normal(size=(200, 8)) @ RNG.normal(size=(8, 8))
    a = train.rotation(y, 4, 8, 16, turns=3)
    assert transform.is_orthonormal(a)
    error = lambda z: ((z - pq.decoded(pq.codes_of(z, b := train.codebook(z, 4, 16)), b)) ** 2).sum()
    assert error(y @ a.T) < error(y)
    assert len(train.kmeans(x[:2], 5)) == 5


def test_linear_maps(spark):
    x = RNG.normal(size=(12, 6))
    a, b = transform.random_rotation(6, 4), RNG.normal(size=4)
    got = np.array([r["vec"] for r in transform.apply(keys_of(spark, x), a, b).orderBy("row_id").collect()])
    assert np.allclose(got, x @ a.T + b)
    back = np.array([r["vec"] for r in transform.undo(transform.apply(keys_of(spark, x), a, b), a, b).orderBy("row_id").collect()])
    assert np.allclose(back, x @ a.T @ a)
    assert np.allclose([r["vec"] for r in transform.apply(keys_of(spark, x), None).orderBy("row_id").collect()], x)


# distributions


def neighbours_of(spark, rows):
    return spark.createDataFrame(rows, "qid long, rank long, row_id long, token_id int, score double")


def model_of(spark, probs):
    return spark.createDataFrame([(0, t, math.log(p)) for t, p in probs.items()], "qid long, token_id int, lprob double")


@pytest.mark.parametrize("weight", [0.0, 0.5, 1.0])
@pytest.mark.parametrize("threshold", [None, 0.5])
def test_mixing(spark, weight, threshold):
    found = neighbours_of(spark, [(0, 1, 10, 5, 0.9), (0, 2, 11, 6, 0.5), (0, 3, 12, 5, 0.2), (0, 4, 13, 1, 0.8)])
    own = {1: 0.1, 5: 0.2, 6: 0.3, 7: 0.4}
    made = {r["token_id"]: r["lprob"] for r in mix.mixed(model_of(spark, own), found, weight, 2.0, threshold, pad=1).collect()}
    kept = [(t, s) for _, _, _, t, s in [tuple(r) for r in found.collect()] if threshold is None or s >= threshold]
    total = sum(math.exp(s / 2) for _, s in kept)
    for t, p in own.items():
        retrieved = sum(math.exp(s / 2) for u, s in kept if u == t) / total if t != 1 else 0.0
        want = (1 - weight) * p + weight * retrieved
        assert made[t] == -math.inf if want == 0 else math.isclose(made[t], math.log(want), abs_tol=1e-9)


def test_gate_is_strict(spark):
    found = neighbours_of(spark, [(0, 1, 10, 5, 0.5)])
    own = {5: 0.25, 6: 0.75}
    made = {r["token_id"]: r["lprob"] for r in mix.mixed(model_of(spark, own), found, 0.5, 1.0, 0.5).collect()}
    assert math.isclose(made[5], math.log(0.25)) and math.isclose(made[6], math.log(0.75))
    assert mix.neighbour_probs(found, 1.0, 0.6).count() == 0


@pytest.mark.parametrize("mix_first", [True, False])
def test_ensemble(spark, mix_first):
    models = [model_of(spark, {5: 0.5, 6: 0.5}), model_of(spark, {5: 0.9, 6: 0.1})]
    found = [neighbours_of(spark, [(0, 1, 1, 5, 0.0)]), neighbours_of(spark, [(0, 1, 1, 6, 0.0)])]
    made = {r["token_id"]: math.exp(r["lprob"]) for r in mix.ensemble(models, found, mix_first, 0.5, 1.0).collect()}
    want = (0.75 + 0.45) / 2 if mix_first else 0.5 * 0.7 + 0.5
    assert math.isclose(made[5], want) and math.isclose(made[6], 1 - want)


def test_log_mean_counts_missing_rows_as_zero(spark):
    rows = spark.createDataFrame([(0, 0, 5, math.log(0.5)), (1, 0, 6, -math.inf), (0, 0, 7, -800.0), (1, 0, 7, -800.0)], "model int, qid long, token_id int, lprob double")
    made = {r["token_id"]: r["lprob"] for r in mix.log_mean(rows, 2).collect()}
    assert math.isclose(made[5], math.log(0.25)) and made[6] == -math.inf and math.isclose(made[7], -800.0)


def test_modes(spark):
    assert KnnQuery().mode() == "plain"
    assert KnnQuery(weight=0.5).mode() == "vanilla"
    assert KnnQuery(weight=0.5).mode("labse") == KnnQuery(weight=0.5).mode(None, "enc") == "subset"
    own = model_of(spark, {5: 0.5, 6: 0.5})
    plain = Vanilla(KnnQuery(), keys_of(spark, np.ones((1, 2))), keys=keys_of(spark, np.ones((1, 2)))).mixed(own, own)
    assert table_of(plain, "token_id") == table_of(own, "token_id")


def test_masked_mean(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0], 5), (0, [3.0, 4.0], 6), (0, [9.0, 9.0], 1), (1, [9.0, 9.0], 1)], "seq_id long, vec array<double>, token_id int")
    assert table_of(subset.sentence_vectors(rows, 2, pad=1), "seq_id") == [(0, [2.0, 3.0]), (1, [0.0, 0.0])]


def test_subset_rows_keep_rank_order(spark):
    near = spark.createDataFrame([(0, 1, 7), (0, 2, 3), (0, 3, 4)], "sent_id long, rank long, seq_id long")
    sentences = spark.createDataFrame([(3, 0, 2), (4, 2, 2), (7, 5, 7)], "seq_id long, begin long, end long")
    values = spark.createDataFrame([(i, 100 + i) for i in range(8)], "row_id long, token_id int")
    assert table_of(subset.subset_rows(near, sentences, values), "cand_pos") == [(0, 0, 5, 105), (0, 1, 6, 106), (0, 2, 0, 100), (0, 3, 1, 101)]


# corpora


def corpus_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "seq_id long, text string")


def storage_of(spark, lengths):
    rows = [(i, n, list(range(n))) for i, n in enumerate(lengths)]
    return tokens.storage(spark.createDataFrame(rows, "seq_id long, length int, tokens array<int>"))


def test_offsets(spark):
    made = storage_of(spark, [1, 1, 1, 1, 1, 5, 4, 3, 2, 1])
    rows = table_of(made.select("slot", "seq_id", "length", "begin", "end"), "slot")
    assert [r[1] for r in rows] == [5, 6, 7, 8, 9, 4, 3, 2, 1, 0]
    assert [r[3] for r in rows] == [0, 5, 9, 12, 14, 15, 16, 17, 18, 19] and rows[-1][4] == 20


def test_vocabulary_and_ids(spark):
    corpus = corpus_of(spark, ["b a b", " c\tb  a\n", None, ""])
    vocab = tokens.vocabulary(corpus, 2)
    assert table_of(vocab, "token_id") == [("b", 3, 4), ("a", 2, 5)]
    seqs = tokens.sequences(corpus, vocab, eos=True)
    assert table_of(seqs, "seq_id") == [(0, 4, [4, 5, 4, 2]), (1, 4, [3, 4, 5, 2]), (2, 1, [2]), (3, 1, [2])]


def test_large_vocabulary_is_joined_alike(spark, monkeypatch):
    corpus = corpus_of(spark, ["b a b", "c b a"])
    vocab = tokens.vocabulary(corpus)
    one = table_of(tokens.token_ids(corpus, vocab), "seq_id", "pos")
    monkeypatch.setattr(tokens, "BROADCAST_WORDS", 1)
    assert one == table_of(tokens.token_ids(corpus, vocab), "seq_id", "pos")


def test_words_are_cut_alike(spark, monkeypatch):
    texts = ["", None, "  a b\t\n", "a\x0bb\x0cc\rd", "x\x85y\xa0z\u2003w", "a\x1cb\x1f c", "\u00e9 \u65e5\u672c \u65e5", "one"]
    want = [r[0] for r in corpus_of(spark, texts).orderBy("seq_id").select(tokens.words("text")).collect()]
    for size in (1, 1 << 24):
        monkeypatch.setattr(tokens, "TEXT_BYTES", size)
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
        made = []
        for part in tokens._parts([batch], 0):
            flat, sizes = tokens._cut(part.column(0))
            made += tokens._lists(flat, sizes).to_pylist()
        assert made == want


def test_only_words_not_broadcast_are_shuffled(spark, monkeypatch):
    """A frequent word never leaves its row, and rows of equal ids stay rows of their own."""
    monkeypatch.setattr(tokens, "BROADCAST_WORDS", 1)
    seen, completed = [], tokens._completed
    monkeypatch.setattr(tokens, "_completed", lambda made, rest: (seen.append(made), completed(made, rest))[1])
    corpus = spark.createDataFrame([(1, "b a b z"), (1, "b c b a"), (2, None), (3, "c y")], "seq_id long, text string")
    vocab = tokens.vocabulary(corpus, 2)
    made = table_of(tokens.sequences(corpus, vocab, eos=True), "seq_id", "tokens")
    assert made == [(1, 5, [4, 5, 4, 3, 2]), (1, 5, [4, 6, 4, 5, 2]), (2, 1, [2]), (3, 3, [6, 3, 2])]
    assert sorted(w for r in seen[0].collect() for w in r["missed"]) == ["a", "a", "c", "c", "y", "z"]


def test_ranks_shuffle_rows_once(spark):
    """Rows that were dealt by ranges are numbered where they were sorted; only a row for each range is grouped."""
    rows = spark.range(100).withColumn("x", F.col("id") % 7)
    plan = ranked(rows, [F.desc("x"), F.col("id")], "r", {"before": "x"})._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window") == 1 and "row_number" not in plan


@pytest.mark.parametrize("lengths", [[5, 5, 5, 4, 4, 1, 1, 1], [9, 3, 3, 3, 2, 2, 0, 0, 0], [1] * 9, [7, 6, 5, 4, 3, 2, 1]])
@pytest.mark.parametrize(("most", "sentences"), [(10, None), (6, 2), (None, 3)])
def test_widths_of_batches(spark, lengths, most, sentences):
    made = tokens.in_batches(storage_of(spark, lengths), most, sentences).collect()
    longest = {}
    for r in made:
        longest[r["batch"]] = max(longest.get(r["batch"], 0), r["length"])
    assert len(made) == len(lengths) and all(r["width"] == longest[r["batch"]] and len(r["tokens"]) == r["length"] for r in made)


def test_merge(spark):
    a, b = storage_of(spark, [1, 3]), storage_of(spark, [2, 0])
    whole = table_of(tokens.merge(a, b).drop("tokens"), "slot")
    assert whole == [(1, 0, 3, 0, 3), (0, 1, 1, 3, 4), (2, 2, 2, 4, 6), (3, 3, 0, 6, 6)]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=30), st.one_of(st.none(), st.integers(1, 30)), st.one_of(st.none(), st.integers(1, 7)))
def test_batches(spark, lengths, max_tokens, max_sentences):
    made = table_of(tokens.batches(storage_of(spark, lengths), max_tokens, max_sentences), "slot")
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], -i))
    want, at, batch = [], 0, 0
    cap = max_sentences or (128 if max_tokens is None else 10**9)
    while at < len(order):
        size = min(cap, max(1, max_tokens // max(lengths[order[at]], 1)) if max_tokens else 10**9)
        want += [batch] * len(order[at : at + size])
        at, batch = at + size, batch + 1
    assert [r[0] for r in made] == order and [r[3] for r in made] == want


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_ranked(spark, parts):
    rows = spark.createDataFrame([(int(v), i) for i, v in enumerate(RNG.integers(0, 5, 50))], "x long, i long")
    made = table_of(ranked(rows, [F.desc("x"), F.col("i")], "r", {"before": "x"}, parts), "r")
    want = sorted([tuple(r) for r in rows.collect()], key=lambda t: (-t[0], t[1]))
    assert [(x, i) for x, i, _, _ in made] == want and [r for _, _, r, _ in made] == list(range(50))
    assert [b for *_, b in made] == [sum(x for x, _ in want[:n]) for n in range(50)]


def test_sequence_functions(spark):
    rows = spark.createDataFrame([(0, [7, 8, 2]), (1, [2]), (2, [])], "id int, t array<int>")
    got = lambda c: [r[0] for r in rows.orderBy("id").select(c).collect()]
    assert got(sequences.shifted_right("t")) == [[2, 7, 8], [2], []]
    assert got(sequences.padded("t", 4, 1)) == [[7, 8, 2, 1], [2, 1, 1, 1], [1, 1, 1, 1]]
    assert got(sequences.padded("t", 2, -1)) == [[7, 8, 2], [2, -1], [-1, -1]]
    assert got(sequences.without_prefix("t", 1)) == [[8, 2], [], []]
    assert got(sequences.interval(F.lit(3), F.lit(3))) == [[], [], []]
    assert got(sequences.trace("id", "t"))[0] == "R-0\t7 8 2"


def test_encoders(spark):
    rows = corpus_of(spark, ["a b", "b a", "c", None])
    made = [r[0] for r in rows.orderBy("seq_id").select(encoders.encode("text")).collect()]
    assert made[0] == made[1] != made[2] and not any(made[3])
    with pytest.raises(NotImplementedError):
        encoders.build("missing")
    with pytest.raises(NotImplementedError):
        encoders.build("hashing", "max")


def test_beam_reorder(spark):
    state = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "sent_id long, s string")
    order = spark.createDataFrame([(0, 5), (1, 4), (2, 0), (3, 1)], "place long, source long")
    assert table_of(subset.reorder(state, order, 2), "sent_id") == [(0, "c"), (1, "a")]


def test_own_row_is_left_out(spark):
    found = spark.createDataFrame([(1, 1, 5, 0.0), (1, 2, 1, 0.0), (1, 3, 7, -1.0), (2, 1, 3, 0.0), (2, 2, 4, 0.0), (2, 3, 6, -1.0)], "qid long, rank long, row_id long, score double")
    kept = [tuple(r)[:3] for r in without_own(found, 2).orderBy("qid", "rank").collect()]
    assert kept == [(1, 1, 5), (1, 2, 7), (2, 1, 3), (2, 2, 4)]
