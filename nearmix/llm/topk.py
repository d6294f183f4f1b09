"""Exact top-k inner-product search on a bit-sliced index.

Vectors are quantised to integers. A shard of rows, ordered by id, keeps per attribute one
bitmap for each bit of (value - smallest value of the attribute): the slices. A query's scores
over the whole shard are sums of slices shifted by the digits of its own values: the digits are
in canonical signed form, added by carry-save bitmap arithmetic from the highest digit down, and
the negative sum is subtracted at the end. The top rows are then taken from the most significant
score slice downward: rows above the others are certain, rows that tie so far are carried on;
rows that tie in every slice at the boundary are resolved exactly by id.

Shards are built once and stored; queries are a stated set against all rows, dealt in blocks that
are broadcast one after another: every shard meets each block once and hands on at most k rows a
query, so what is shuffled is k rows a shard and query.

Rows with a component beyond +-WIDE after quantisation, and queries that have one, are scored by
integers of any length instead, which is slow but exact.

Defined results: vectors that are null or hold a null or non-finite component take no part. Each
row is a candidate and a query of its own: rows that share an id are answered one by one, and each
finds the others. Rows with a null id are candidates and come last among ties. Vectors of unequal
length score over the attributes both have (an empty vector scores 0). A score beyond the range of
long counts as its end. Ties go to the smaller id.
"""

from __future__ import annotations

import pickle
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearmix.llm.common import Scratch, table

#: Queries that a task holds at once; 64 attributes of 8 bytes make 2 MB.
QUERY_BLOCK = 4096
#: Rows of a shard: bitmaps of 2 KB stay in the processor's cache.
SHARD_ROWS = 16_384
#: Quantised components up to this go into slices: sums over up to 2,048 attributes fit in 64 bits.
WIDE = 1 << 26
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def taking_part(df: DataFrame) -> DataFrame:
    """(vec_id, x array<double>) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    fine = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def quantise(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x): int64 where all fit below WIDE, Python integers else."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if not len(y) or np.abs(y).max() <= WIDE:
        return y.astype(np.int64)
    exact = lambda v, w: int(w) if abs(w) < 2.0**52 else floor(Fraction(v) * Fraction(scale))
    return np.array([exact(v, w) for v, w in zip(x.tolist(), y.tolist(), strict=True)], object)


def _digits(q: np.ndarray) -> tuple[list[list[tuple[int, int]]], int]:
    """For each power from the highest: [(attribute, sign)] of the canonical signed digits of q."""
    found: dict[int, list[tuple[int, int]]] = {}
    for d, v in enumerate(q.tolist()):
        sign, v, at = (1, v, 0) if v >= 0 else (-1, -v, 0)
        while v:
            if v & 1:
                digit = 2 - (v & 3)
                found.setdefault(at, []).append((d, sign * digit))
                v -= digit
            v >>= 1
            at += 1
    top = max(found, default=-1)
    return [found.get(p, []) for p in range(top, -1, -1)], top + 1


class BitSlices:
    """The slices of one shard; rows in ascending order of id, which ``keys`` number over all shards."""

    def __init__(self, ids: list, keys: np.ndarray, values: np.ndarray):
        self.ids, self.keys, self.n = ids, keys, len(ids)
        self.place = np.argsort(keys)
        self.low = values.min(0)
        above = (values - self.low).astype(np.uint64)
        self.widths = [int(x).bit_length() for x in above.max(0)]
        self.words = (self.n + 63) // 64
        self.slices = []
        for d, width in enumerate(self.widths):
            bits = np.zeros((width, self.words * 64), np.uint8)
            for b in range(width):
                bits[b, : self.n] = (above[:, d] >> np.uint64(b)) & np.uint64(1)
            self.slices.append(np.packbits(bits, axis=1, bitorder="little").view(np.uint64))
        self.valid = np.packbits(np.arange(self.words * 64) < self.n, bitorder="little").view(np.uint64)

    def _sum(self, steps: list[list[tuple[int, int]]], sign: int) -> np.ndarray:
        """Slices of the sum over the digits of one sign, lowest slice first."""
        bound = 0
        for step in steps:
            bound = 2 * bound + sum((1 << self.widths[d]) - 1 for d, s in step if s == sign)
        size = max(bound.bit_length(), 1) + 1
        total = np.zeros((size, self.words), np.uint64)
        carry = np.zeros((size, self.words), np.uint64)
        used, bound = 0, 0
        for step in steps:
            if used:
                total[1 : used + 1] = total[:used].copy()
                total[0] = 0
                carry[1 : used + 1] = carry[:used].copy()
                carry[0] = 0
            bound *= 2
            used = min(bound.bit_length() + 1, size)
            for d, s in step:
                if s != sign or not self.widths[d]:
                    continue
                x, w = self.slices[d], self.widths[d]
                bound += (1 << w) - 1
                used = min(max(bound.bit_length() + 1, w + 1), size)
                t, c = total[:used], carry[:used]
                both = t & c
                t ^= c
                c[1:] = both[:-1]
                c[0] = 0
                # a slice with a carry from t and c has no bit left that could meet x
                c[1 : w + 1] |= (t[:w] & x)[: used - 1]
                t[:w] ^= x
        return self._settle(total, carry, used)

    @staticmethod
    def _settle(total: np.ndarray, carry: np.ndarray, used: int) -> np.ndarray:
        """total + carry by ripple."""
        out = np.empty((max(used, 1), total.shape[1]), np.uint64)
        over = np.zeros(total.shape[1], np.uint64)
        for b in range(len(out)):
            x, y = total[b], carry[b]
            half = x ^ y
            out[b] = half ^ over
            over = (x & y) | (half & over)
        return out

    def scores(self, q: np.ndarray) -> tuple[np.ndarray, int]:
        """Score slices in offset form and the number to add to what they read."""
        steps, _ = _digits(q)
        plus, minus = self._sum(steps, 1), self._sum(steps, -1)
        size = max(len(plus), len(minus)) + 1
        out = np.empty((size, self.words), np.uint64)
        over = np.full(self.words, ~np.uint64(0))
        ones, none = np.full(self.words, ~np.uint64(0)), np.zeros(self.words, np.uint64)
        for b in range(size):
            x = plus[b] if b < len(plus) else none
            y = ~minus[b] if b < len(minus) else ones
            half = x ^ y
            out[b] = half ^ over
            over = (x & y) | (half & over)
        out[-1] = ~out[-1]  # two's complement to offset form: slices compare as unsigned
        return out, int(q @ self.low) - (1 << (size - 1))

    def top(self, q: np.ndarray, k: int, own: int | None) -> tuple[list[int], list[int]]:
        """Ids and scores of the k best rows but that with key ``own``, ties to the smaller id."""
        slices, base = self.scores(q)
        open_ = self.valid.copy()
        if own is not None:
            at = int(np.searchsorted(self.keys, own, sorter=self.place))
            if at < self.n and self.keys[self.place[at]] == own:
                at = int(self.place[at])
                open_[at // 64] &= ~(np.uint64(1) << np.uint64(at % 64))
        certain, n_certain = np.zeros(self.words, np.uint64), 0
        for b in range(len(slices) - 1, -1, -1):
            high = open_ & slices[b]
            n = n_certain + int(np.bitwise_count(high).sum())
            if n > k:
                open_ = high
            else:
                certain |= high
                n_certain = n
                open_ &= ~slices[b]
                if n == k:
                    open_[:] = 0
                    break
        rows = self._rows(certain)
        if len(rows) < k:
            rows = np.concatenate((rows, self._rows(open_)[: k - len(rows)]))
        bits = (slices[:, rows // 64] >> (rows % 64).astype(np.uint64)) & np.uint64(1)
        values = [sum(int(x) << b for b, x in enumerate(column)) + base for column in bits.T.tolist()]
        return [self.ids[i] for i in rows.tolist()], values

    @staticmethod
    def _rows(bitmap: np.ndarray) -> np.ndarray:
        return np.nonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))[0]


class Shard:
    """Rows of one length: slices of the narrow ones, integers of any length of the others."""

    def __init__(self, rows: list[tuple[int | None, int, np.ndarray]], dim: int):
        rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        narrow = [r for r in rows if r[2].dtype != object and dim]
        self.dim = dim
        self.others = [r for r in rows if r[2].dtype == object or not dim]
        keys = np.array([r[1] for r in narrow], np.int64)
        self.index = BitSlices([r[0] for r in narrow], keys, np.stack([r[2] for r in narrow])) if narrow else None
        #: The narrow rows again, for wide queries.
        self.values = np.stack([r[2] for r in narrow]) if narrow else None

    def top(self, q: np.ndarray, k: int, own: int) -> list[tuple[int, int | None]]:
        """(score, id) of the k best rows but that with key ``own``."""
        found = []
        if self.index is not None:
            if q.dtype != object:
                full = np.zeros(self.dim, np.int64)
                n = min(len(q), self.dim)
                full[:n] = q[:n]
                ids, scores = self.index.top(full, k, own)
                found += zip(scores, ids, strict=True)
            else:
                found += [(self._score(v, q), i) for i, key, v in zip(self.index.ids, self.index.keys.tolist(), self.values, strict=True) if key != own]
        found += [(self._score(v, q), i) for i, key, v in self.others if key != own]
        found = [(min(max(s, _LEAST), _MOST), i) for s, i in found]
        return sorted(found, key=lambda f: (-f[0], f[1] is None, f[1] or 0))[:k]

    @staticmethod
    def _score(v: np.ndarray, q: np.ndarray) -> int:
        return sum(int(a) * int(b) for a, b in zip(v.tolist(), q.tolist(), strict=False))


def _vectors(batch: pa.RecordBatch, scale: float):
    """(vec_id, key, quantised vector) of rows (vec_id, key, x)."""
    lists = batch.column(2)
    offsets = lists.offsets.to_numpy().tolist()
    flat = lists.values.to_numpy(zero_copy_only=False)
    for i, (vec, key) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
        yield vec, key, quantise(flat[offsets[i] : offsets[i + 1]], scale)


def _build(scale: float, most: int):
    """Batches (vec_id, key, x) -> stored shards of at most ``most`` rows of one length."""

    def run(batches):
        held: dict[int, list] = {}
        shard = lambda dim: pa.RecordBatch.from_pydict({"shard": pa.array([pickle.dumps(Shard(held.pop(dim), dim))], pa.binary())})
        for batch in batches:
            for row in _vectors(batch, scale):
                own = held.setdefault(len(row[2]), [])
                own.append(row)
                if len(own) >= most:
                    yield shard(len(row[2]))
        for dim in list(held):
            yield shard(dim)

    return run


_ANSWER = pa.schema([("query_key", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _search(block, k: int):
    """Batches of stored shards -> (query_key, query_id, vec_id, score)."""

    def run(batches):
        out: list[tuple] = []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=_ANSWER)
        for batch in batches:
            for blob in batch.column(0):
                shard = pickle.loads(blob.as_py())
                for vec, key, q in block.value:
                    out += [(key, vec, i, s) for s, i in shard.top(q, k, key)]
                    if len(out) > 50_000:
                        yield pack()
                        out.clear()
        if out:
            yield pack()

    return run


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, name: str = "topk", block_rows: int = QUERY_BLOCK, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """vectors(vec_id, embedding, ..) -> (query_id, rank, vec_id, score); queries are ids divisible by ``every``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, name)
    rows = scratch.store(taking_part(vectors).withColumn("key", F.monotonically_increasing_id()).select("vec_id", "key", "x"), "rows")
    queries = scratch.store(rows.where(F.col("vec_id") % every == 0), "queries")
    n_rows, n_queries = rows.count(), queries.count()
    # A whole number of shards for each core, so that all work at once.
    cores = max(spark.sparkContext.defaultParallelism, 1)
    shards = max(1, -(-n_rows // shard_rows), min(cores, -(-n_rows // 2048)))
    built = scratch.store(rows.repartition(shards, "key").mapInArrow(_build(scale, shard_rows), "shard binary"), "shards")
    scratch.drop(rows)
    # One shard a task, whatever the files' sizes.
    spread = built.repartition(max(1, min(4 * shards, built.count())))
    blocks = max(1, -(-n_queries // block_rows))
    found = None
    for b in range(blocks):
        mine = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b)
        asked = [(r.vec_id, r.key, quantise(np.array(r.x), scale)) for r in mine.toLocalIterator()]
        block = spark.sparkContext.broadcast(asked)
        part = spread.mapInArrow(_search(block, k), "query_key long, query_id long, vec_id long, score long")
        if blocks > 1:
            part = scratch.store(part, "block")
            block.destroy()
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_key").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), name="op6")


OP6_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda v: CAST(floor(CAST(v AS DOUBLE) * 64) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0),
e AS MATERIALIZED (SELECT rid, vec_id, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM d),
s AS (
  SELECT a.rid AS query_rid, b.rid AS rid, CAST(sum(a.x * b.x) AS BIGINT) AS score
  FROM e a JOIN e b ON a.i = b.i AND a.rid <> b.rid
  WHERE a.vec_id % 20 = 0 GROUP BY 1, 2),
r AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, score,
    CAST(row_number() OVER (PARTITION BY query_rid ORDER BY score DESC, b.vec_id NULLS LAST) AS INTEGER) AS rank
  FROM s JOIN d a ON a.rid = query_rid JOIN d b ON b.rid = s.rid)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
