"""Registered queries on corpora: vocabulary, ids, token storage and its derived tables, batches, stores.

The corpus is documents; conversations are the second one of a merge. Words that occur once are
outside the vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearmix.functions import sequences, vectors
from nearmix.operators import tokens
from nearmix.operators.order import ranked
from nearmix.plans import tables as T
from nearmix.sources import stores
from nearmix.sources.shared import materialised

LEAST = 2
MAX_TOKENS, MAX_SENTENCES = 6000, 128
PREFIX = 3
CHUNK = 100


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "documents").selectExpr("doc_id AS seq_id", "text")


def second_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in order, numbered from 0."""
    turns = T.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return ranked(turns, [F.col(c) for c in ("conv_id", "turn", "role", "text")], "seq_id").select("seq_id", "text")


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.vocabulary(corpus(spark, sf_dir), LEAST)


def _sequences(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None, vocab: DataFrame | None = None) -> DataFrame:
    """Sequences with end marks, under the vocabulary of the first corpus."""
    rows = corpus(spark, sf_dir) if rows is None else rows
    return tokens.sequences(rows, _vocabulary(spark, sf_dir) if vocab is None else vocab, eos=True)


def _storage(spark: SparkSession, sf_dir: str, vocab: DataFrame | None = None) -> DataFrame:
    return tokens.storage(_sequences(spark, sf_dir, vocab=vocab))


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The storage without its tokens, for what follows from lengths alone: no vocabulary is made."""
    return tokens.storage(tokens.lengths(corpus(spark, sf_dir), eos=True))


def digest(ids: Column | str) -> Column:
    """A sequence of ids as a hash of its text."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    return F.md5(F.array_join(ids.cast("array<string>"), " "))


def vocab_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.vocabulary(corpus(spark, sf_dir))


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_ids(corpus(spark, sf_dir), _vocabulary(spark, sf_dir))


def token_storage_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _storage(spark, sf_dir).select("seq_id", "slot", "length", "begin", "end", digest("tokens").alias("tokens"))


def token_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.values(_storage(spark, sf_dir))


def token_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row ids of each sentence: how many, their ends, and a hash of all."""
    rows = _places(spark, sf_dir).select("seq_id", sequences.interval("begin", "end").alias("rows"))
    return rows.select("seq_id", F.size("rows").cast("long").alias("n"), F.get("rows", F.lit(0)).alias("first"), F.try_element_at("rows", F.lit(-1)).alias("last"), digest("rows").alias("rows"))


def token_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = materialised(_vocabulary(spark, sf_dir), "vocabulary")
    other = tokens.storage(_sequences(spark, sf_dir, second_corpus(spark, sf_dir), vocab))
    return tokens.merge(_storage(spark, sf_dir, vocab), other).select("seq_id", "slot", "length", "begin", "end", digest("tokens").alias("tokens"))


def shift_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequences(spark, sf_dir).select("seq_id", digest(sequences.shifted_right("tokens")).alias("prev_output"))


def pad_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences padded to the longest of their batch; padding beyond the end is counted, not told."""
    dealt = tokens.in_batches(_storage(spark, sf_dir), MAX_TOKENS, MAX_SENTENCES)
    filled = sequences.padded("tokens", F.col("width"), tokens.PAD)
    return dealt.select("seq_id", "batch", "width", digest(filled).alias("padded"))


def ignore_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _sequences(spark, sf_dir).select("seq_id", sequences.without_prefix("tokens", PREFIX).alias("t"))
    return made.select("seq_id", F.size("t").cast("long").alias("n"), digest("t").alias("tokens"))


def batch_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.batches(_places(spark, sf_dir), MAX_TOKENS, MAX_SENTENCES)


def batch_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each sentence in its batch and back: the longest text first, ties by id."""
    rows = tokens.batches(_places(spark, sf_dir), MAX_TOKENS, MAX_SENTENCES).select("batch", "seq_id", "length")
    by_length = Window.partitionBy("batch").orderBy(F.desc("length"), "seq_id")
    by_id = Window.partitionBy("batch").orderBy("seq_id")
    return rows.select("batch", "seq_id", (F.row_number().over(by_length) - 1).cast("long").alias("place"), (F.row_number().over(by_id) - 1).cast("long").alias("orig_order"))


def non_pad_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real tokens and unknown ones of each sequence."""
    without = lambda t: F.size(F.array_remove("tokens", F.lit(t))).cast("long")
    rows = _sequences(spark, sf_dir).select("seq_id", without(tokens.PAD).alias("n"), (F.size("tokens") - without(tokens.UNK)).alias("u"))
    return rows.groupBy("seq_id").agg(F.sum("n").alias("n_tokens"), F.sum("u").alias("n_unknown"))


def raw_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw texts beside the stored sentences, where the benchmark has an item of that number."""
    raw = T.table(spark, sf_dir, "benchmark").selectExpr("item_id AS seq_id", "text")
    rows = _places(spark, sf_dir).select("seq_id", "slot")
    return stores.with_raw(rows, raw).select("seq_id", "slot", F.trim("sentence").alias("sentence"))


def key_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the queries written again, negated, and the rest untouched."""
    keys = T.keys(spark, sf_dir).select("row_id", vectors.doubles("vec").alias("vec"))
    new = keys.where(F.col("row_id") % T.EVERY == 0).select("row_id", F.transform("vec", lambda v: F.lit(0.0) - v).alias("vec"))
    made = stores.replaced(keys, new)
    return made.select("row_id", F.round(F.aggregate("vec", F.lit(0.0).cast("double"), lambda s, v: s + v), 6).alias("total"))


def key_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.facts(T.keys(spark, sf_dir))


def key_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by chunk of an index build."""
    chunk = F.floor(F.col("row_id") / CHUNK)
    return T.keys(spark, sf_dir).groupBy(chunk.alias("chunk")).agg(F.count("*").alias("n"), F.min("row_id").alias("begin"), (F.max("row_id") + 1).alias("end"))


QUERIES = {
    "vocab_build": vocab_build,
    "token_ids": token_ids,
    "token_storage_sentences": token_storage_sentences,
    "token_values": token_values,
    "token_intervals": token_intervals,
    "token_merge": token_merge,
    "shift_right": shift_right,
    "pad_sequences": pad_sequences,
    "ignore_prefix": ignore_prefix,
    "batch_sampler": batch_sampler,
    "batch_order": batch_order,
    "non_pad_counts": non_pad_counts,
    "raw_sentences": raw_sentences,
    "key_overwrite": key_overwrite,
    "key_facts": key_facts,
    "key_chunks": key_chunks,
}


def _words(name: str, rows: str) -> str:
    return f"{name} AS (SELECT seq_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM ({rows}))"


_DOCS = "SELECT doc_id AS seq_id, text FROM documents"
_TURNS = "SELECT row_number() OVER (ORDER BY conv_id, turn, role, text) - 1 AS seq_id, text FROM conversations"


def _vocab(least: int) -> str:
    return f"""
vocab AS (
  SELECT token, cnt, CAST(row_number() OVER (ORDER BY cnt DESC, token) - 1 + {tokens.N_SPECIAL} AS INTEGER) AS token_id
  FROM (SELECT token, count(*) AS cnt FROM (SELECT unnest(words) AS token FROM d) GROUP BY 1 HAVING count(*) >= {least}))"""


def _stored(name: str, words: str) -> str:
    return f"""
e_{name} AS (SELECT seq_id, unnest(words) AS token, generate_subscripts(words, 1) - 1 AS pos FROM {words}),
l_{name} AS (SELECT seq_id, list(coalesce(token_id, {tokens.UNK}) ORDER BY pos) AS ids FROM e_{name} LEFT JOIN vocab USING (token) GROUP BY 1),
{name} AS (SELECT seq_id, list_append(coalesce(ids, []), {tokens.EOS}) AS tokens FROM {words} LEFT JOIN l_{name} USING (seq_id))"""


def _slots(name: str, seqs: str) -> str:
    return f"""
{name} AS (
  SELECT *, "begin" + length AS "end" FROM (
    SELECT *, coalesce(CAST(sum(length) OVER (ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS "begin" FROM (
      SELECT seq_id, CAST(len(tokens) AS INTEGER) AS length, tokens, row_number() OVER (ORDER BY len(tokens) DESC, seq_id DESC) - 1 AS slot FROM {seqs})))"""


def _digest(ids: str) -> str:
    return f"md5(array_to_string({ids}, ' '))"


_BASE = (_words("d", _DOCS), _vocab(LEAST), _stored("seqs", "d"))
_STORED = (*_BASE, _slots("st", "seqs"))
_BATCHES = f"""
steps AS (
  SELECT 0 AS first, least({MAX_SENTENCES}, greatest(1, {MAX_TOKENS} // greatest(length, 1))) AS size, 0 AS batch FROM st WHERE slot = 0
  UNION ALL
  SELECT st.slot, least({MAX_SENTENCES}, greatest(1, {MAX_TOKENS} // greatest(length, 1))), steps.batch + 1 FROM steps JOIN st ON st.slot = steps.first + steps.size),
dealt AS (SELECT seq_id, slot, length, CAST(batch AS BIGINT) AS batch, tokens FROM st JOIN steps ON slot >= first AND slot < first + size)"""
_STORE_COLUMNS = f"SELECT seq_id, slot, length, \"begin\", \"end\", {_digest('tokens')} AS tokens FROM "


def _recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


SQL = {
    "vocab_build": T.sql(_words("d", _DOCS), _vocab(1), select="SELECT token, cnt, token_id FROM vocab"),
    "token_ids": T.sql(
        _words("d", _DOCS), _vocab(LEAST),
        select=f"SELECT seq_id, CAST(pos AS INTEGER) AS pos, coalesce(token_id, {tokens.UNK}) AS token_id FROM "
        "(SELECT seq_id, unnest(words) AS token, generate_subscripts(words, 1) - 1 AS pos FROM d) LEFT JOIN vocab USING (token)",
    ),
    "token_storage_sentences": T.sql(*_STORED, select=_STORE_COLUMNS + "st"),
    "token_values": T.sql(
        *_STORED,
        select="SELECT \"begin\" + pos AS row_id, seq_id, CAST(pos AS INTEGER) AS pos, token_id FROM "
        '(SELECT "begin", seq_id, unnest(tokens) AS token_id, generate_subscripts(tokens, 1) - 1 AS pos FROM st)',
    ),
    "token_intervals": T.sql(
        *_STORED,
        select=f"SELECT seq_id, CAST(length AS BIGINT) AS n, CASE WHEN length > 0 THEN \"begin\" END AS \"first\", CASE WHEN length > 0 THEN \"end\" - 1 END AS \"last\", "
        f"{_digest('range(\"begin\", \"end\")')} AS rows FROM st",
    ),
    "token_merge": T.sql(
        *_STORED, _words("c", _TURNS), _stored("seqs_c", "c"), _slots("sc", "seqs_c"),
        "total AS (SELECT count(*) AS n, CAST(sum(length) AS BIGINT) AS r FROM st)",
        "whole AS (SELECT seq_id, slot, length, \"begin\", \"end\", tokens FROM st UNION ALL SELECT seq_id + n, slot + n, length, \"begin\" + r, \"end\" + r, tokens FROM sc, total)",
        select=_STORE_COLUMNS + "whole",
    ),
    "shift_right": T.sql(*_BASE, select=f"SELECT seq_id, {_digest('list_concat([tokens[len(tokens)]], tokens[1:len(tokens) - 1])')} AS prev_output FROM seqs"),
    "pad_sequences": _recursive(T.sql(
        *_STORED, _BATCHES, "w AS (SELECT batch, max(length) AS width FROM dealt GROUP BY 1)",
        select=f"SELECT seq_id, batch, CAST(width AS BIGINT) AS width, {_digest(f'list_resize(tokens, width, {tokens.PAD})')} AS padded FROM dealt JOIN w USING (batch)",
    )),
    "ignore_prefix": T.sql(*_BASE, f"p AS (SELECT seq_id, tokens[{PREFIX + 1}:] AS t FROM seqs)", select=f"SELECT seq_id, CAST(len(t) AS BIGINT) AS n, {_digest('t')} AS tokens FROM p"),
    "batch_sampler": _recursive(T.sql(*_STORED, _BATCHES, select="SELECT seq_id, slot, length, batch FROM dealt")),
    "batch_order": _recursive(T.sql(
        *_STORED, _BATCHES,
        select="SELECT batch, seq_id, row_number() OVER (PARTITION BY batch ORDER BY length DESC, seq_id) - 1 AS place, row_number() OVER (PARTITION BY batch ORDER BY seq_id) - 1 AS orig_order FROM dealt",
    )),
    "non_pad_counts": T.sql(
        *_BASE, "t AS (SELECT seq_id, unnest(tokens) AS token_id FROM seqs)",
        select=f"SELECT seq_id, count(*) FILTER (token_id <> {tokens.PAD}) AS n_tokens, count(*) FILTER (token_id = {tokens.UNK}) AS n_unknown FROM t GROUP BY 1",
    ),
    "raw_sentences": T.sql(*_STORED, select="SELECT seq_id, slot, trim(text) AS sentence FROM st LEFT JOIN benchmark ON item_id = seq_id"),
    "key_overwrite": T.sql(T.K_SQL, select=f"SELECT row_id, round(list_sum(list_transform(x, lambda v: CASE WHEN row_id % {T.EVERY} = 0 THEN 0e0 - v ELSE v END)), 6) AS total FROM k"),
    "key_facts": "SELECT count(*) AS n, min(len(embedding)) AS least_dim, max(len(embedding)) AS most_dim FROM embeddings",
    "key_chunks": f"SELECT vec_id // {CHUNK} AS chunk, count(*) AS n, min(vec_id) AS \"begin\", max(vec_id) + 1 AS \"end\" FROM embeddings GROUP BY 1",
}
