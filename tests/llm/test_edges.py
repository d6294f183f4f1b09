"""Every operator on odd rows and on empty tables."""

from __future__ import annotations

from fractions import Fraction
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearmix.llm import decontam, langid, licenses, pieces, secrets, simhash, tokencount, topk, toxicity, warc

LONG = "ein sehr langer text mit vielen worten " * 6000
ROWS = [
    (1, None, "en"), (2, "", "en"), (None, "a text without an id", None), (3, "the same row", "en"), (3, "the same row", "en"), (4, LONG, "de"), (5, "  12 34 !!", None),
    (6, "the same row", "en"), (7, "\U0001f600 ünḯ", "fr"), (8, " \t\n ", None), (9, "one", "en"),
]
CLASHES = "count key fp spans text_key words n label score component_id pos kind start end fold value place".split()


def docs_of(spark, rows=None):
    df = spark.createDataFrame(ROWS if rows is None else rows, "doc_id long, text string, lang string")
    return df.withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long"), **{c: F.lit("x") for c in CLASHES}})


def labels_of(spark, rows=((1, 1, 0), (3, 0, 1), (4, None, 0), (None, 1, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def items_of(spark, rows=((1, None), (2, ""), (None, "a text without an id and some more words"), (3, "mit vielen worten ein sehr langer text mit vielen"), (3, "mit vielen worten ein sehr langer text mit vielen"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


PER_ROW = {
    "langid": lambda d: langid.identify(d),
    "tokens": lambda d: tokencount.token_counts(d),
    "simhash": lambda d: simhash.simhash_components(d),
    "simhash_similar": lambda d: simhash.simhash_components(d, 5, 256, similarity=0.75),
    "secrets": lambda d: secrets.secret_scan(d),
    "pieces": lambda d: pieces.encode(d),
    "toxicity": lambda d: toxicity.toxicity(d, labels_of(d.sparkSession)),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_for_each_row(spark, name):
    made = PER_ROW[name](docs_of(spark))
    ids = lambda df: sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in df.select("doc_id").collect())
    assert ids(made) == ids(docs_of(spark))
    same = [tuple(r)[1:] for r in made.where("doc_id = 3").collect()]
    assert len(same) == 2 and same[0] == same[1]
    assert PER_ROW[name](docs_of(spark, [])).count() == 0


def test_defined_results(spark):
    by = {r["doc_id"]: r for r in langid.identify(docs_of(spark)).collect()}
    assert {i for i, r in by.items() if r["lang_pred"] == "und"} == {1, 2, 5, 8}
    by = {r["doc_id"]: r for r in tokencount.token_counts(docs_of(spark)).collect()}
    assert (by[1]["n_bytes"], by[1]["n_tokens"]) == (0, 0) and by[4]["over_limit"] and by[4]["n_bytes"] == len(LONG)
    by = {r["doc_id"]: r["component_id"] for r in simhash.simhash_components(docs_of(spark)).collect()}
    assert by[1] == by[2] == by[8] == 1 and by[3] == by[6] == 3


def test_scans(spark):
    assert licenses.license_scan(docs_of(spark)).count() == 0
    assert licenses.license_scan(docs_of(spark, [])).count() == 0
    rows = [(1, "x. Released under the MIT License", "en")] * 2 + [(None, "All rights reserved", None)]
    made = licenses.license_scan(docs_of(spark, rows))
    assert sorted(r["license_id"] for r in made.collect()) == ["MIT-notice", "proprietary-notice"]
    leaks = decontam.contaminated(docs_of(spark), items_of(spark)).collect()
    # five words of nine suffice; null ids stay null
    assert sorted(((r["doc_id"], r["item_id"]) for r in leaks), key=str) == [(4, 3), (None, None)]
    assert decontam.contaminated(docs_of(spark), items_of(spark, [])).count() == 0
    assert decontam.contaminated(docs_of(spark, []), items_of(spark)).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.26]), (0, [0.5, -0.26]), (1, [1.0, 1.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (20, [1.0, 1.0]), (None, [1.0, 1.0]), (6, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("q", F.lit("x")).withColumn("key", F.lit("x"))
    made = sorted((tuple(r) for r in topk.top_k(df).collect()), key=str)
    # floor(64 x): (32, -17) and (64, 64); both rows of id 0 are queries and find each other
    want = [(0, 1, 0, 1313), (0, 2, 1, 960), (0, 3, 20, 960), (0, 4, None, 960), (0, 5, 6, 0)] * 2
    want += [(20, 1, 1, 8192), (20, 2, None, 8192), (20, 3, 0, 960), (20, 4, 0, 960), (20, 5, 6, 0)]
    assert made == sorted(want, key=str)
    assert topk.top_k(df.where("vec_id > 100")).count() == 0


def test_vectors_by_brute_force(spark):
    """Huge components, repeated and null ids, vectors of several lengths; several blocks and shards."""
    rng = np.random.default_rng(2)
    rows = [(i % 50, (rng.normal(size=4 if i % 3 else 3) * 10.0 ** float(rng.choice([0, 0, 0, 1, 6, 18, 300]))).tolist()) for i in range(120)]
    rows += [(None, [1.0, 2.0, 3.0, 4.0]), (40, [2.0] * 4), (40, [3.0] * 4), (41, [3.0] * 4)]
    q = [[floor(Fraction(v) * 64) for v in x] for _, x in rows]
    want = []
    for a, (vec, _) in enumerate(rows):
        if vec is None or vec % 20:
            continue
        score = lambda b: min(max(sum(x * y for x, y in zip(q[a], q[b], strict=False)), -(2**63)), 2**63 - 1)  # noqa: E731, B023
        best = sorted(((-score(b), i is None, i or 0, i) for b, (i, _) in enumerate(rows) if b != a))[:20]
        want += [(vec, n, i, -s) for n, (s, _, _, i) in enumerate(best, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block, shard in ((4096, 16384), (3, 10)):
        made = [tuple(r) for r in topk.top_k(df, block_rows=block, shard_rows=shard).collect()]
        assert sorted(made, key=str) == sorted(want, key=str)


def test_pages(spark):
    rows = [(1, "http://a/", "x" * 50_000), (2, None, None), (3, "u", ""), (4, "u", "x" * 50_000), (None, "u", "y"), (None, "u", "y"), (5, "u", "ü\r\n\r\nWARC/1.1\r\n"), (4, "u", "x" * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("z")).withColumn("first", F.lit(1))
    made = sorted(((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.warc_round_trip(df).collect()), key=str)
    want = [(0, "response", None, 1)] * 2 + [(1, "revisit", 4, 50_000), (2, "revisit", 3, 0), (3, "response", None, 0), (4, "response", None, 50_000), (4, "response", None, 50_000), (5, "response", None, 16)]
    assert made == sorted(want, key=str)
    assert warc.warc_round_trip(df.where("page_id > 100")).count() == 0


def test_stages_keep_columns(spark):
    docs = docs_of(spark)
    for stage in (langid.langid_stage, simhash.dedup_stage, secrets.redact_stage):
        made = stage(spark, docs, None)
        assert made.columns == docs.columns and made.count() > 0
        assert stage(spark, docs_of(spark, []), None).count() == 0
    kept = simhash.dedup_stage(spark, docs, None)
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 7, 9]
