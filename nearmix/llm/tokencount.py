"""Token counts by distinct pre-token.

A byte-level BPE never merges across pre-tokens, so a text's count is the sum over its distinct
pre-tokens of frequency times pieces. Three steps: the pre-tokens of the whole corpus are made
distinct, with their frequencies; each of them is encoded once, which gives the table of pieces;
that table is joined to every document's pre-token frequencies and the products are summed. No
document's ids are materialised.

The join splits hot keys off: the pieces of the HOT most frequent pre-tokens, a fixed number, are
broadcast and joined where a document's frequencies are counted. Only the rows (document,
pre-token, frequency) of the rest are shuffled to the table, and no key of theirs is frequent.

Pre-tokens are cut by a pattern where a text has only characters that all regular-expression
libraries class alike, and by the library's own pre-tokenizer elsewhere. A text that holds one of
the tokenizer's special strings is counted by the library as a whole, as is every text where the
tokenizer doesn't pre-tokenize like that.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows give repeated
result rows; a null doc_id stays null.
"""

from __future__ import annotations

import json
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmix.llm.common import Scratch, map_texts, table

#: Pre-tokens whose pieces are broadcast.
HOT = 50_000
#: Distinct pre-tokens that a task gathers before it hands them on; about 100 bytes each.
GATHERED = 200_000
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of _PLAIN characters alone.
_LETTER, _NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
_LATIN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\s{_LETTER}{_NUMBER}]+|\s+(?!\S)|\s+"
_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e¡-ɏ]")


class PieceCounter:
    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [t["content"] for t in spec.get("added_tokens") or []]
        pre = spec.get("pre_tokenizer") or {}
        # Only this pre-tokenizer is known to split as _PATTERN does.
        self.known = (
            spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        )
        self.by_rank = self._ranks(spec["model"]) if self.known else None
        self.latin = re.compile(_LATIN).findall

    @staticmethod
    def _ranks(model: dict):
        """The same merges as a rank table (a faster encoder of single pre-tokens); None if ids don't follow the order of the merges."""
        vocab, merged = model["vocab"], []
        for pair in model["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            merged.append(vocab.get(left + right, -1))
        if any(a >= b for a, b in zip(merged, merged[1:], strict=False)) or merged[:1] == [-1]:
            return None
        import tiktoken

        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(map(letters.__getitem__, t)): i for t, i in vocab.items() if all(c in letters for c in t)}
        if not all(bytes([b]) in ranks for b in range(256)):
            return None
        ranks = {t: i for t, i in ranks.items() if len(t) == 1 or i >= merged[0]}
        return tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def lengths(self, texts: list[str]) -> list[int]:
        """Tokens of texts as the library gives them."""
        out = []
        for at in range(0, len(texts), 16):
            out += [len(e.ids) for e in self.tokenizer.encode_batch(texts[at : at + 16], add_special_tokens=False)]
        return out

    def pieces(self, tokens: list[str]) -> list[int]:
        """Tokens of single pre-tokens."""
        out = [0] * len(tokens)
        odd = [i for i, t in enumerate(tokens) if self.by_rank is None or _PLAIN.search(t)]
        for i, n in zip(odd, self.lengths([tokens[i] for i in odd]), strict=True):
            out[i] = n
        others = set(odd)
        for i, t in enumerate(tokens):
            if i not in others:
                out[i] = len(self.by_rank.encode_ordinary(t))
        return out

    def split(self, text: str) -> list[str] | None:
        """A text's pre-tokens, or None if it has to be counted as a whole."""
        if not self.known or any(s in text for s in self.specials):
            return None
        if _PLAIN.search(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self.latin(text)


def _counter(path: str | None) -> PieceCounter:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return PieceCounter(path)


def _gather(path: str | None):
    """Batches of texts -> (token, n), pre-tokens and how often they occurred since the last were handed on."""

    def run(batches):
        counter, met = _counter(path), Counter()

        def emit():
            batch = pa.RecordBatch.from_arrays([pa.array(list(met), pa.string()), pa.array(list(met.values()), pa.int64())], names=["token", "n"])
            met.clear()
            return batch

        for batch in batches:
            for text in batch.column(0):
                if text.is_valid and (tokens := counter.split(text.as_py())) is not None:
                    met.update(tokens)
                    if len(met) > GATHERED:
                        yield emit()
        yield emit()

    return run


def piece_table(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs(text, ..) -> (token, n, pieces), a row per distinct pre-token of the whole table."""
    met = docs.select("text").mapInArrow(_gather(path), "token string, n long")
    distinct = met.groupBy("token").agg(F.sum("n").alias("n"))

    def make():
        counter = _counter(path)

        def step(batch: pa.RecordBatch):
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counter.pieces(batch.column(0).to_pylist()), pa.int64())], names=["token", "n", "pieces"]
            )

        return step

    return map_texts(distinct, ["token", "n"], "token string, n long, pieces long", make, 4096)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 1024, hot: int = HOT, name: str = "tokens") -> DataFrame:
    """docs(doc_id, text, ..) -> (doc_id, n_bytes, n_tokens, over_limit), one row per row of docs.

    ``path``: a tokenizers JSON file that every executor can open; by default the file of that
    name in the installed tokenizer package.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, name)
    table_ = scratch.store(piece_table(docs, path), "pieces")
    frequent = table_.orderBy(F.desc("n"), "token").limit(hot)
    sent = spark.sparkContext.broadcast({r["token"]: r["pieces"] for r in frequent.select("token", "pieces").toLocalIterator()})

    def make():
        counter, known = _counter(path), sent.value

        def step(batch: pa.RecordBatch):
            rows, docs_, sizes, texts = (c.to_pylist() for c in batch.columns)
            sums, whole = [0] * len(texts), []
            cold: tuple[list, list, list] = ([], [], [])
            for i, text in enumerate(texts):
                tokens = counter.split(text) if text else ()
                if tokens is None:
                    whole.append(i)
                    continue
                for t, n in Counter(tokens).items():
                    p = known.get(t)
                    if p is None:
                        cold[0].append(rows[i])
                        cold[1].append(t)
                        cold[2].append(n)
                    else:
                        sums[i] += n * p
            for i, n in zip(whole, counter.lengths([texts[i] for i in whole]), strict=True):
                sums[i] = n
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            none = [None] * len(cold[0])
            columns = [rows + cold[0], docs_ + none, sizes + none, [None] * len(rows) + cold[1], sums + cold[2]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["row", "doc_id", "n_bytes", "token", "n"])

        return step

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text",
    )
    schema = "row long, doc_id long, n_bytes long, token string, n long"
    counted = scratch.store(map_texts(rows, ["row", "doc_id", "n_bytes", "text"], schema, make), "frequencies")
    cold = counted.where("token IS NOT NULL").select("row", "token", F.col("n").alias("times")).join(table_.select("token", "pieces"), "token")
    cold = cold.groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("n"))
    parts = counted.where("token IS NULL").select("row", "doc_id", "n_bytes", "n").unionByName(cold, allowMissingColumns=True)
    total = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return total.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), name="op3")
