"""Corpora as relational token storage: vocabulary, token ids, sentences with offsets, batches.

A storage is sentences(seq_id, slot, length, begin, end, tokens). Slots go from the longest sentence to
the shortest; ``begin`` and ``end`` bound a sentence's rows, so row ids are begin + position. Global
ranks and running sums come from ``order.ranked``: no window collects all rows in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearmix.operators.order import ranked
from nearmix.sources.shared import materialised

BOS, PAD, EOS, UNK = 0, 1, 2, 3
N_SPECIAL = 4
#: Words of a vocabulary that are broadcast, the most frequent ones; rarer ones are joined by shuffles.
BROADCAST_WORDS = 200_000
#: Text that is cut into words at a time.
TEXT_BYTES = 1 << 24


def words(text: Column | str) -> Column:
    """Tokens between runs of white space; null and blank texts have none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _parts(batches, column: int):
    """Batches cut into pieces of about TEXT_BYTES of text."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXT_BYTES, "right")))
            yield batch.slice(at, to - at)
            at = to


def _cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``words`` of texts as Arrow has them: all words, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    kept = pc.greater(pc.binary_length(flat), 0)
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    sizes = _by_row(kept.to_numpy(zero_copy_only=False), ends)
    return flat.filter(kept), sizes


def _by_row(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many flags are set in each row, rows ending at ``ends``."""
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[ends], prepend=0)


def _lists(flat: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), flat)


def vocabulary(corpus: DataFrame, least: int = 1) -> DataFrame:
    """corpus(text) -> (token, cnt, token_id): the most frequent first, ties by token, ids after the special ones.

    Words are counted by batch before they are shuffled.
    """

    def count(batches):
        for part in _parts(batches, 0):
            met = _cut(part.column(0))[0].value_counts()
            yield pa.RecordBatch.from_arrays([met.field("values"), met.field("counts")], names=["token", "n"])

    each = corpus.select("text").mapInArrow(count, "token string, n long")
    counted = each.groupBy("token").agg(F.sum("n").alias("cnt")).where(F.col("cnt") >= least)
    order = [F.desc("cnt"), F.col("token")]
    return ranked(counted, order, "_rank").select("token", "cnt", (F.col("_rank") + N_SPECIAL).cast("int").alias("token_id"))


def lengths(corpus: DataFrame, eos: bool = False) -> DataFrame:
    """corpus(seq_id, text) -> (seq_id, length) of ``sequences``, which no vocabulary changes."""

    def count(batches):
        for part in _parts(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_cut(part.column(1))[1] + int(eos), pa.int32())], names=["seq_id", "length"])

    return corpus.select("seq_id", "text").mapInArrow(count, f"seq_id {dict(corpus.dtypes)['seq_id']}, length int")


def sequences(corpus: DataFrame, vocab: DataFrame, eos: bool = False) -> DataFrame:
    """corpus(seq_id, text) -> (seq_id, length, tokens), a row per row of the corpus, empty ones included.

    Words outside the vocabulary are UNK, ``eos`` adds an end mark. The first BROADCAST_WORDS words of
    the vocabulary, by id, go to the tasks, and ids are looked up inside the row. If there are more, rows
    are stored so, with the words that were not found; these alone are shuffled, and what the rest
    of the vocabulary says of them is put in its place.
    """
    known = vocab.select("token", "token_id")
    held = known.where(F.col("token_id") < N_SPECIAL + BROADCAST_WORDS).toArrow()
    rest = known.where(F.col("token_id") >= N_SPECIAL + BROADCAST_WORDS)
    more = not rest.isEmpty()
    sent = corpus.sparkSession.sparkContext.broadcast((held.column(0).combine_chunks(), held.column(1).cast(pa.int32()).combine_chunks()))

    def look_up(batches):
        names, ids = sent.value
        for part in _parts(batches, 1):
            flat, sizes = _cut(part.column(1))
            found = ids.take(pc.index_in(flat, value_set=names))
            numbers = found.fill_null(UNK).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            full = sizes + int(eos)
            if eos:
                numbers = np.insert(numbers, ends, EOS)
            arrays = [part.column(0), pa.array(full, pa.int32()), _lists(pa.array(numbers, pa.int32()), full)]
            if more:
                missed = found.is_null().to_numpy(zero_copy_only=False)
                counts = _by_row(missed, ends)
                places = np.nonzero(missed)[0] - np.repeat(ends - sizes, counts)
                arrays += [_lists(pa.array(places, pa.int32()), counts), _lists(flat.filter(pa.array(missed)), counts)]
            yield pa.RecordBatch.from_arrays(arrays, names=["seq_id", "length", "tokens", "places", "missed"][: len(arrays)])

    kind = dict(corpus.dtypes)["seq_id"]
    schema = f"seq_id {kind}, length int, tokens array<int>" + (", places array<int>, missed array<string>" if more else "")
    made = corpus.select("seq_id", "text").mapInArrow(look_up, schema)
    return _completed(made, rest) if more else made


def _completed(made: DataFrame, rest: DataFrame) -> DataFrame:
    """Rows of ``sequences`` with the ids that ``rest`` has for words that were missed. No frequent word is among these."""
    stored = materialised(made.withColumn("_row", F.monotonically_increasing_id()), "looked-up")
    each = stored.select("_row", F.explode(F.arrays_zip("places", "missed")).alias("m")).select("_row", F.col("m.places").alias("place"), F.col("m.missed").alias("token"))
    named = each.join(rest, "token").groupBy("_row").agg(F.collect_list(F.struct("place", "token_id")).alias("named"))
    joined = stored.join(named, "_row", "left").select("seq_id", "length", "tokens", "named")

    def put(batches):
        for batch in batches:
            lists, named = batch.column(2), batch.column(3)
            numbers = lists.flatten().to_numpy(zero_copy_only=False).copy()
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            begins = np.repeat(np.cumsum(sizes) - sizes, pc.fill_null(pc.list_value_length(named), 0).to_numpy(zero_copy_only=False))
            places, ids = named.flatten().flatten()
            numbers[begins + places.to_numpy(zero_copy_only=False)] = ids.to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(pa.array(numbers, pa.int32()), sizes)], names=["seq_id", "length", "tokens"])

    return joined.mapInArrow(put, made.select("seq_id", "length", "tokens").schema)


def token_ids(corpus: DataFrame, vocab: DataFrame, eos: bool = False) -> DataFrame:
    """corpus(seq_id, text) -> (seq_id, pos, token_id), a row per token of ``sequences``."""
    return sequences(corpus, vocab, eos).select("seq_id", F.posexplode("tokens").alias("pos", "token_id"))


def storage(seqs: DataFrame) -> DataFrame:
    """sequences -> (seq_id, slot, length, begin, end[, tokens]), the longest first, ties by the larger id.

    Rows are stored first, as dealing them by ranges reads them twice.
    """
    stored = materialised(seqs, "sequences")
    placed = ranked(stored, [F.desc("length"), F.desc("seq_id")], "slot", {"begin": "length"})
    rest = [c for c in seqs.columns if c not in ("seq_id", "length")]
    return placed.select("seq_id", "slot", "length", "begin", (F.col("begin") + F.col("length")).alias("end"), *rest)


def values(sentences: DataFrame) -> DataFrame:
    """(row_id, seq_id, pos, token_id), one row a token."""
    each = sentences.select("seq_id", "begin", F.posexplode("tokens").alias("pos", "token_id"))
    return each.select((F.col("begin") + F.col("pos")).alias("row_id"), "seq_id", "pos", "token_id")


def merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two storages as one: the second's sentences, slots and rows follow the first's; the whole isn't sorted anew."""
    size = first.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("rows")).first()
    shift = {"seq_id": size["n"], "slot": size["n"], "begin": size["rows"], "end": size["rows"]}
    moved = second.withColumns({c: (F.col(c) + F.lit(n)).cast("long") for c, n in shift.items()})
    return first.unionByName(moved)


def batches(sentences: DataFrame, max_tokens: int | None = None, max_sentences: int | None = None) -> DataFrame:
    """(seq_id, slot, length, batch): sentences from the longest to the shortest, greedily, as ``in_batches`` has them."""
    return in_batches(sentences, max_tokens, max_sentences).select("seq_id", "slot", "length", "batch")


def in_batches(sentences: DataFrame, max_tokens: int | None = None, max_sentences: int | None = None) -> DataFrame:
    """Sentences with ``batch`` and ``width``, the length of the batch's longest one.

    A batch takes as many sentences of its first one's length as max_tokens allows (one at least),
    max_sentences at most. How batches begin follows from the number of sentences of each length, so
    one task looks at a row for each length that occurs, and batches are then computed from slots.
    """
    if max_tokens is None and max_sentences is None:
        max_sentences = 128
    for limit in (max_tokens, max_sentences):
        if limit is not None and limit < 1:
            raise ValueError("the limits of a batch must be positive")
    runs = sentences.groupBy("length").agg(F.count("*").alias("n"), F.min("slot").alias("slot"))

    def simulate(parts):
        rows = sorted((r for b in parts for r in zip(*[c.to_pylist() for c in b.columns], strict=True)), key=lambda r: -r[0])
        at = batch = width = 0
        out = []
        for length, n, slot in rows:
            size = max_tokens // max(length, 1) if max_tokens is not None else max_sentences
            size = max(1, min(size, max_sentences or size))
            starts = max(0, -(-(slot + n - at) // size))
            out.append((length, at, size, batch, width))
            if starts:
                at, batch, width = at + starts * size, batch + starts, length
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate([pa.int32(), *[pa.int64()] * 4])], names=["length", "_first", "_size", "_batch", "_width"])

    # One row a distinct length, so at most as many rows as the longest sentence has tokens.
    ordered = runs.select(F.col("length").cast("int").alias("length"), "n", "slot").coalesce(1).mapInArrow(simulate, "length int, _first long, _size long, _batch long, _width long")
    # A sentence before the first batch that begins with its length is in the last one of a greater length.
    earlier = F.col("slot") < F.col("_first")
    number = F.when(earlier, F.col("_batch") - 1).otherwise(F.col("_batch") + F.floor((F.col("slot") - F.col("_first")) / F.col("_size")))
    width = F.when(earlier, F.col("_width")).otherwise(F.col("length").cast("long"))
    joined = sentences.join(F.broadcast(ordered), "length")
    return joined.select(*sentences.columns, number.cast("long").alias("batch"), width.alias("width"))
