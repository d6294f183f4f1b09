"""Benchmark decontamination by spaced-seed hashing.

A spaced seed is a fixed mask over consecutive tokens: it hashes the tokens at its ones and
ignores those at its zeros, so a substituted token at an ignored place doesn't hide a hit. The
masks are hashed at every place of every benchmark item and of every training text; equal hashes
are joined, and around each hit the item is laid over the text at the offset of the hit and
compared token by token.

Overlap: at each offset, the item's stretches in which matches outnumber substitutions (+1 for a
match, -2 for a substitution, never below 0; each up to its highest score), of at least
LEAST_STRETCH matches. Stretches at other offsets are joined to a chain where they follow each other
in the item and in the text, with at most as many text tokens between them as the item has; what
two of them share counts once. So words inserted or left out don't split an item. An item counts
as leaked when its chain with most matches holds at least ``share`` of the item's tokens as
matches, or when one stretch alone holds RUN matches, however long the item. Items below
``least`` tokens leak only when the text holds all their tokens in a row; the hash of the whole
item finds them. Benchmark tables are small beside a corpus but not bounded: items are dealt in
blocks of BLOCK_TOKENS tokens, each block's hash table is broadcast, and every text is held
against each block.

Guarantee: 12 tokens with 2 substitutions anywhere, and 16 with 3, hold a hit of one of the
masks (shown by enumeration in the tests), so a stretch at no worse a rate over some such run of
its tokens is found. Shorter ones are found if 5 tokens in a row are equal.

Defined results: tokens are runs of letters and digits in lower case; null and empty texts and
items leak nothing; repeated rows give repeated result rows; repeated item ids are one item
each; null ids stay null. One row per (text, item), its chain with most matches, then the first.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmix.llm.common import map_texts, table

MASKS = ("11111", "1101011", "11100101")
#: Matches that a stretch of a chain needs, those of a mask's ones (fewer where ``share`` of the item is less).
LEAST_STRETCH = 5
#: Matches of one stretch that make a leak of an item of any length.
RUN = 25
#: Benchmark tokens whose seeds one broadcast holds: 3 seeds of 16 bytes each, so 50 MB.
BLOCK_TOKENS = 1 << 20
#: Cells of a comparison of an item with a text at many offsets, and seed hits, that are held at a time.
CELLS = 1 << 20
_TOKEN = regex.compile(r"[\p{L}\p{N}]+")
_GAPS = {i: " " for i in range(128) if not chr(i).isalnum()}
_MULTIPLIERS = np.array([xxhash.xxh64_intdigest(bytes([i])) | 1 for i in range(16)], np.uint64)


class TokenHasher:
    """Words to 64-bit hashes, the frequent ones remembered."""

    def __init__(self, entries: int = 300_000):
        self.memo: dict[str, int] = {}
        self.entries = entries

    def __call__(self, text: str | None) -> np.ndarray:
        text = (text or "").lower()
        words = text.translate(_GAPS).split() if text.isascii() else _TOKEN.findall(text)
        memo = self.memo
        if len(memo) > self.entries:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def seeds(tokens: np.ndarray, mask: str, which: int) -> np.ndarray:
    """The mask's hash at every place of tokens that it fits."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, which + 1, np.uint64)
    with np.errstate(over="ignore"):
        for place, bit in enumerate(mask):
            if bit == "1":
                h = (h ^ tokens[place : place + n]) * _MULTIPLIERS[place % 16]
                h ^= h >> np.uint64(29)
    return h


def stretches(equal: np.ndarray) -> list[tuple[int, int, int]]:
    """(begin, end, matches) of the disjoint stretches of a comparison that each end at their highest score."""
    found, hits = [], equal.tolist()
    i, n = 0, len(hits)
    while i < n:
        if not hits[i]:
            i += 1
            continue
        begin, score, matches = i, 0, 0
        best = (0, i, 0)
        while i < n:
            score += 1 if hits[i] else -2
            matches += hits[i]
            i += 1
            if score <= 0:
                break
            if hits[i - 1] and score >= best[0]:
                best = (score, i, matches)
        found.append((begin, best[1], best[2]))
        i = best[1]
    return found


def chain(parts: list[tuple[int, int, int, np.ndarray]], gap: int, enough: float = np.inf) -> tuple[int, int, int, int]:
    """(matches, begin and end in the item, offset of its first part) of the chain with most matches, or of the first with ``enough``.

    A part is (begin, end, offset, running sum of matches by place in the item).
    """
    parts = sorted(parts, key=lambda p: (p[0] + p[2], p[0], p[1]))
    ends = np.array([p[1] for p in parts], np.int64)
    past = ends + np.array([p[2] for p in parts], np.int64)
    held = np.zeros(len(parts), np.int64)
    best: list[tuple[int, int, int, int]] = []
    reach = 0
    for i, (begin, end, offset, sums) in enumerate(parts):
        own = (int(sums[end] - sums[begin]), begin, end, offset)
        while past[reach] + gap < begin + offset and reach < i:
            reach += 1
        if reach < i:
            e, t = ends[reach:i], past[reach:i]
            start = np.maximum(np.maximum(e, t - offset), begin)
            fits = (start < end) & (t + gap >= begin + offset)
            joined = np.where(fits, held[reach:i] + (sums[end] - sums[np.minimum(start, end)]), -1)
            j = int(joined.argmax())
            if joined[j] > own[0]:
                own = (int(joined[j]), best[reach + j][1], end, best[reach + j][3])
        held[i] = own[0]
        best.append(own)
        if own[0] >= enough:
            return own
    return max(best, key=lambda c: c[0])


class Block:
    """Seeds of some items, sorted by hash."""

    def __init__(self, items: list[tuple[int | None, str | None]], least: int):
        hasher = TokenHasher()
        kept = [(i, t) for i, t in ((i, hasher(text)) for i, text in items) if len(t)]
        self.ids, self.tokens, self.least = [i for i, _ in kept], [t for _, t in kept], least
        #: The masks by number; an item below ``least`` tokens has one of its own length, without zeros.
        whole = {n: len(MASKS) + n for n in {len(t) for t in self.tokens} if n < least}
        self.masks = {**dict(enumerate(MASKS)), **{w: "1" * n for n, w in whole.items()}}
        of = lambda t: [whole[len(t)]] if len(t) in whole else range(len(MASKS))
        parts = [(seeds(t, self.masks[w], w), k, len(self.masks[w])) for k, t in enumerate(self.tokens) for w in of(t)]
        parts = [p for p in parts if len(p[0])]
        self.hashes = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.uint64)
        self.item = np.concatenate([np.full(len(p[0]), p[1], np.int64) for p in parts]) if parts else np.empty(0, np.int64)
        self.place = np.concatenate([np.arange(len(p[0])) for p in parts]) if parts else np.empty(0, np.int64)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.item, self.place = self.hashes[order], self.item[order], self.place[order]
        # A small bitmap over the low bits of the hashes spares most binary searches.
        self.bits = max(16, min(26, int(len(self.hashes)).bit_length() + 4))
        self.filter = np.zeros(1 << self.bits, bool)
        self.filter[(self.hashes & np.uint64((1 << self.bits) - 1)).astype(np.int64)] = True

    def _offsets(self, tokens: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Items with a hit, and the sorted token offsets at which they are laid over the text."""
        low = np.uint64((1 << self.bits) - 1)
        base = 1 << 32
        codes = []
        for w, mask in self.masks.items():
            h = seeds(tokens, mask, w)
            at = np.nonzero(self.filter[(h & low).astype(np.int64)])[0]
            if not len(at):
                continue
            first, last = np.searchsorted(self.hashes, h[at], "left"), np.searchsorted(self.hashes, h[at], "right")
            past = np.cumsum(last - first)
            i = 0
            while i < len(at):
                j = max(i + 1, int(np.searchsorted(past, (past[i - 1] if i else 0) + CELLS, "right")))
                count = last[i:j] - first[i:j]
                hit = np.repeat(first[i:j] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                codes.append(np.unique(self.item[hit] * base + (np.repeat(at[i:j], count) - self.place[hit] + (base >> 1))))
                i = j
        every = np.unique(np.concatenate(codes)) if codes else np.empty(0, np.int64)
        if not len(every):
            return []
        items, heads = np.unique(every // base, return_index=True)
        return list(zip(items.tolist(), np.split(every % base - (base >> 1), heads[1:]), strict=True))

    def _may_leak(self, item: np.ndarray, tokens: np.ndarray, offsets: np.ndarray, share: float) -> bool:
        """False if no chain can reach ``share`` of the item, since it counts a place of the item once, and no stretch RUN."""
        ever, most = np.zeros(len(item), bool), 0
        rows = max(1, CELLS // len(item))
        for i in range(0, len(offsets), rows):
            at = offsets[i : i + rows, None] + np.arange(len(item))
            equal = (at >= 0) & (at < len(tokens)) & (tokens[np.clip(at, 0, len(tokens) - 1)] == item)
            ever |= equal.any(0)
            most = max(most, int(equal.sum(1).max()))
            if most >= RUN or ever.sum() >= share * len(item):
                return True
        return False

    def leaks(self, tokens: np.ndarray, share: float, one: bool = False) -> list[tuple[int, int, int, int, int, int]]:
        """(item index, matches, begin and end in the item, token offset of the item in the text, length).

        With ``one`` the search ends with the first leak that is certain, whose chain need not be the best.
        """
        found = []
        for k, offsets in self._offsets(tokens):
            item = self.tokens[k]
            n = len(item)
            if n < self.least:
                leak = next((o for o in offsets.tolist() if np.array_equal(item, tokens[o : o + n])), None)
                if leak is not None:
                    found.append((k, n, 0, n, leak, n))
            elif len(offsets) < 16 or self._may_leak(item, tokens, offsets, share):
                floor, enough = min(LEAST_STRETCH, share * n), min(share * n, RUN)
                some, held, most = [], 0, 0
                for offset in offsets.tolist():
                    a, b = max(0, -offset), min(n, len(tokens) - offset)
                    equal = np.zeros(n, bool)
                    equal[a:b] = item[a:b] == tokens[a + offset : b + offset]
                    good = [s for s in stretches(equal) if s[2] >= floor]
                    if good:
                        sums = np.concatenate(([0], np.cumsum(equal, dtype=np.int32)))
                        some += [(x, y, offset, sums) for x, y, _ in good]
                        own = [int(sums[y] - sums[x]) for x, y, _ in good]
                        held, most = held + sum(own), max(most, *own)
                        if one and most >= enough:
                            return [(k, most, 0, n, offset, n)]
                if not some or (held < share * n and most < RUN):
                    continue
                matches, begin, end, offset = chain(some, n, share * n if one else np.inf)
                if matches >= share * n or most >= RUN:
                    found.append((k, matches, begin, end, offset, n))
            if one and found:
                return found
        return found


def blocks(benchmark: DataFrame, least: int, block_tokens: int = BLOCK_TOKENS):
    """The benchmark as Blocks, read one partition at a time by the driver."""
    held, size = [], 0
    for r in benchmark.select("item_id", "text").distinct().toLocalIterator():
        held.append((r["item_id"], r["text"]))
        size += len(r["text"] or "") // 4 + 1
        if size >= block_tokens:
            yield Block(held, least)
            held, size = [], 0
    if held:
        yield Block(held, least)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, share: float = 0.5, least: int = 8, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> one row per leaked (doc, item).

    Columns: doc_id, item_id, n_matches, item_tokens, item_begin, item_end (of the stretch, in
    tokens of the item), text_begin (the stretch's first token in the text), overlap.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, n_matches int, item_tokens int, item_begin int, item_end int, text_begin int, overlap double"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for block in blocks(benchmark, least, block_tokens):
        sent = spark.sparkContext.broadcast(block)

        def make(sent=sent):
            here, hasher = sent.value, TokenHasher()

            def step(batch: pa.RecordBatch):
                out = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for k, matches, begin, end, offset, n in here.leaks(hasher(text), share):
                        out.append((doc, here.ids[k], matches, n, begin, end, begin + offset, round(matches / n, 6)))
                if not out:
                    return None
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64()] * 2 + [pa.int32()] * 5 + [pa.float64()]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=_NAMES)

            return step

        part = map_texts(rows, ["doc_id", "text"], schema, make)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


_NAMES = ["doc_id", "item_id", "n_matches", "item_tokens", "item_begin", "item_end", "text_begin", "overlap"]


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, share: float = 0.5, least: int = 8) -> DataFrame:
    """Drop documents that hold a leaked benchmark item; one pass per block of items, no join."""
    kept = docs
    at = docs.columns.index("text")
    for block in blocks(table(spark, sf_dir, "benchmark"), least):
        sent = spark.sparkContext.broadcast(block)

        def make(sent=sent):
            here, hasher = sent.value, TokenHasher()

            def step(batch: pa.RecordBatch):
                clean = [not here.leaks(hasher(t), share, one=True) for t in batch.column(at).to_pylist()]
                return batch.filter(pa.array(clean, pa.bool_()))

            return step

        kept = map_texts(kept, kept.columns, docs.schema, make)
    return kept
