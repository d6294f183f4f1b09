"""SimHash near-duplicate detection with BK-trees over shards of fingerprints.

Every text gets a fingerprint: bit b is set when more than half of its word-shingle hashes
have bit b. Equal fingerprints collapse to one node at once, so copies cost nothing further.
Distinct fingerprints are dealt to shards such that two fingerprints within the radius share
at least one shard; a shard's task builds one BK-tree (children keyed by the integer Hamming
distance to their parent), searches it with every member before inserting it, following only
edges within the radius, and emits a star per local component, never pairs. A distributed
component search joins the stars.

The trees of all shards hold the fingerprints of all documents, which have no size bound, so
they are not broadcast: a shard's members are shuffled to its tree.

Shards
    ``radius`` below the block count: the pigeonhole principle. The bits are cut into m
    blocks; two fingerprints that differ in r bits agree on m - r whole blocks at least, and
    each choice of m - r blocks is a shard key. Complete for every pair. m grows with the
    number of distinct fingerprints, so that shards of unrelated texts stay small.
    ``similarity``: radii that no pigeonhole covers. Keys are groups of min-hashes over the
    same shingles; a pair of that Jaccard similarity misses all of them with a probability of
    at most ``miss``. The trees then only find candidates: the radius is wide enough that such
    a pair is beyond it with a probability of at most ``miss``, and what they link, a cluster,
    is compared again shingle set by shingle set. Only pairs whose sets have the similarity
    become edges. Fingerprints are of the sets here, so that the two measures agree.
    A hot shard (a passage that many texts share) is dealt again by new keys of more min-hashes,
    as many groups of them as miss a pair of that similarity with a chance of ``miss``, whatever
    other keys the pair has. What is still hot after the last level goes to the comparison whole.

Verification
    A node is a distinct shingle set. Clusters up to BLOCK_ROWS are compared in one task each.
    Larger ones are first dealt twice at random to blocks, which links a dense group; then all
    nodes outside the cluster's largest linked part are held against every other block, so no
    candidate pair is left out. That step is quadratic in what stays unlinked.

Defined results: a null text counts as empty; texts without a word have fingerprint zero and
link like any other; a text with fewer words than a shingle is one shingle. Repeated rows give
repeated result rows. A null doc_id takes part, and its component_id is the smallest id that
is not null (null if there is none). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations
from math import ceil, comb, log, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmix.llm.common import Scratch, map_texts, table
from nearmix.llm.components import components

SEED = 42
#: A shard of unrelated fingerprints should not hold more than this many.
SHARD_ROWS = 64
#: Shards above this are cut into sub-shards before trees are built.
TREE_ROWS = 128
#: Shards of min-hash keys above this are dealt again by keys of more min-hashes.
HOT_ROWS = 1024
#: Min-hashes of a key where a shard is dealt again, level by level.
DEEPER = (4, 6, 8)
#: Shingle sets of a cluster that a block of the verification holds.
BLOCK_ROWS = 256
#: Bits of the sieve that texts pass before they are shuffled: 2^18 rows of 16 bytes at most.
SIEVE_BITS = 1 << 24
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Unsigned XXH64 of each shingle of ``words`` words, repeats included."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(parts))
    hashed = xxhash.xxh64_intdigest
    spans = zip(starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.array([hashed(line[a:b], SEED) for a, b in spans], np.uint64)


def _remix(h: np.ndarray, lane: int) -> np.ndarray:
    """Another 64-bit hash for each hash (splitmix64 finaliser on a shifted stream)."""
    with np.errstate(over="ignore"):
        z = h + np.uint64(lane * _MIX[0] % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(_MIX[1])
        z = (z ^ (z >> np.uint64(27))) * np.uint64(_MIX[2])
        return z ^ (z >> np.uint64(31))


def fingerprint(h: np.ndarray, bits: int = 64) -> list[int]:
    """Majority bits as ``bits // 64`` unsigned 64-bit words, lowest lane first; the first lane is the hash itself."""
    if not len(h):
        return [0] * (bits // 64)
    out = []
    for lane in range(bits // 64):
        x = _remix(h, lane) if lane else h
        ones = np.zeros(64, np.int64)
        for at in range(0, len(x), 1 << 16):
            part = np.ascontiguousarray(x[at : at + (1 << 16)]).view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little"))
    return out


def minhash_keys(h: np.ndarray, groups: int, rows: int, first: int = 1000) -> list[int]:
    """One signed 64-bit key per group of ``rows`` min-hashes, of hash functions numbered from ``first`` on."""
    if not len(h):
        h = np.zeros(1, np.uint64)
    keys = []
    for g in range(groups):
        mins = [int(_remix(h, first + g * rows + r).min()) for r in range(rows)]
        key = xxhash.xxh64_intdigest(np.array([g, *mins], np.uint64).tobytes(), SEED)
        keys.append(key - 2**64 if key >= 2**63 else key)
    return keys


def groups_for(similarity: float, rows: int = 2, miss: float = 1e-4) -> int:
    """Groups of ``rows`` min-hashes that a pair of that similarity misses all of with a chance of ``miss`` at most."""
    return ceil(log(miss) / log(1 - similarity**rows))


def differing(common: int, only_a: int, only_b: int) -> float:
    """Chance that a majority bit differs between two sets with so many common and own hashes."""
    ways = 0
    for both in range(common + 1):
        above = sum(comb(only_a, x) for x in range(only_a + 1) if 2 * (both + x) > common + only_a)
        beyond = sum(comb(only_b, y) for y in range(only_b + 1) if 2 * (both + y) > common + only_b)
        apart = above * (2**only_b - beyond) + beyond * (2**only_a - above)
        ways += comb(common, both) * apart
    return ways / 2 ** (common + only_a + only_b)


def radius_for(similarity: float, bits: int, miss: float = 1e-4) -> int:
    """Smallest distance that two sets of that Jaccard similarity exceed with a chance of ``miss`` at most.

    A bit differs as often as in the worst case over small sets (up to 32 common hashes) and
    over large ones, where the chance tends to the angle between the sets. Unequal sizes have
    the smaller angle.
    """
    worst = float(np.arccos(2 * similarity / (1 + similarity)) / pi)
    for common in range(1, 33):
        own = int(common * (1 - similarity) / similarity + 1e-9)
        worst = max([worst, *(differing(common, a, t - a) for t in range(own + 1) for a in range(t // 2 + 1))])
    beyond = 1.0
    for radius in range(bits):
        beyond -= comb(bits, radius) * worst**radius * (1 - worst) ** (bits - radius)
        if beyond <= miss:
            return radius
    return bits


class BKTree:
    """Nodes are [value, {distance: node}]; a search follows only edges within the radius."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = None

    def near(self, value: int, radius: int):
        """Yield the values within the radius, most promising branches first."""
        todo = [self.root] if self.root else []
        while todo:
            at, children = todo.pop()
            d = (at ^ value).bit_count()
            if d <= radius:
                yield at
            if len(children) == 1:
                ((e, child),) = children.items()
                if d - radius <= e <= d + radius:
                    todo.append(child)
            elif children:
                todo += [children[e] for e in sorted(children, key=lambda e: -abs(e - d)) if d - radius <= e <= d + radius]

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = [value, {}]
            return
        node = self.root
        while d := (node[0] ^ value).bit_count():
            if d not in node[1]:
                node[1][d] = [value, {}]
                return
            node = node[1][d]


class _Sets:
    """Union-find with the smallest member as root."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while x != r:
            up[x], x = r, up.get(x, x)
        return r

    def join(self, a, b) -> bool:
        """True if a and b were apart."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        low, high = (a, b) if a < b else (b, a)
        self.up[high] = low
        return True


def _link_tree(values: list[int], radius: int, sets: _Sets) -> None:
    """Join all pairs within the radius. A search ends early once the tree's values are one component."""
    tree, apart = BKTree(), 0
    for x in values:
        apart += 1
        for y in tree.near(x, radius):
            if sets.root(x) != sets.root(y):
                sets.join(x, y)
                apart -= 1
                if apart <= 1:
                    break
        tree.add(x)


def link_shard(values: list[int], radius: int, divide: bool = True) -> list[tuple[int, int]]:
    """Star edges (member, smallest of its local component) among distinct values of one shard.

    A large shard is first cut by the pigeonhole principle over the bits that vary in it:
    of radius + 1 groups of bits, two values within the radius agree on one.
    """
    sets = _Sets()
    todo = [(values, 0)]
    while todo:
        part, depth = todo.pop()
        if divide and len(part) > TREE_ROWS and depth < 3:
            vary = 0
            for x in part:
                vary |= x ^ part[0]
            spots = [b for b in range(vary.bit_length()) if vary >> b & 1]
            if len(spots) <= radius:
                for x in part:
                    sets.join(x, part[0])
                continue
            for g in range(radius + 1):
                mask = sum(1 << b for b in spots[g :: radius + 1])
                buckets: dict[int, list[int]] = {}
                for x in part:
                    buckets.setdefault(x & mask, []).append(x)
                todo += [(v, depth + 1) for v in buckets.values() if len(v) > 1]
            continue
        local = _Sets()
        _link_tree(part, radius, local)
        for x in part:
            sets.join(x, local.root(x))
    return [(x, r) for x in values if (r := sets.root(x)) != x]


def _shard_links(radius: int, bits: int, divide: bool):
    """Batches (key, node) sorted by key -> star edges of each shard; a node is a fingerprint's bytes and any more that tell it apart."""
    width = bits // 8

    def run(batches):
        key, members = None, []
        out_u: list[bytes] = []
        out_v: list[bytes] = []

        def flush():
            if len(members) > 1:
                first: dict[int, bytes] = {}
                for node in sorted(set(members)):
                    if (low := first.setdefault(int.from_bytes(node[:width], "big"), node)) != node:
                        out_u.append(node)
                        out_v.append(low)
                for a, b in link_shard(list(first), radius, divide):
                    out_u.append(first[a])
                    out_v.append(first[b])

        def emit():
            batch = pa.RecordBatch.from_arrays([pa.array(out_u, pa.binary()), pa.array(out_v, pa.binary())], names=["u", "v"])
            out_u.clear()
            out_v.clear()
            return batch

        for batch in batches:
            keys = batch.column(0).to_pylist()
            prints = batch.column(1).to_pylist()
            for k, f in zip(keys, prints, strict=True):
                if k != key:
                    flush()
                    key, members = k, []
                members.append(f)
            if len(out_u) > 20_000:
                yield emit()
        flush()
        yield emit()

    return run


def blocks_for(distinct: int, radius: int, bits: int = 64) -> int:
    """Smallest block count whose keys keep shards of unrelated fingerprints at SHARD_ROWS or fewer."""
    for m in range(radius + 1, 4 * radius + 8):
        if distinct / 2.0 ** (bits * (m - radius) / m) <= SHARD_ROWS or comb(m + 1, radius) > 120:
            return m
    return 4 * radius + 7


def _block_keys(radius: int, bits: int, m: int):
    """Batches of fingerprints -> (key, fp), one row for each choice of m - radius blocks."""
    cuts = [round(i * bits / m) for i in range(m + 1)]
    choices = list(combinations(range(m), m - radius))

    def step(batch: pa.RecordBatch):
        prints = batch.column(0).to_pylist()
        keys: list[bytes] = []
        for f in prints:
            x = int.from_bytes(f, "big")
            parts = [(x >> cuts[i]) & ((1 << (cuts[i + 1] - cuts[i])) - 1) for i in range(m)]
            for c, choice in enumerate(choices):
                key = 0
                for i in choice:
                    key = key << (cuts[i + 1] - cuts[i]) | parts[i]
                keys.append(c.to_bytes(2, "big") + key.to_bytes(bits // 8, "big").lstrip(b"\0"))
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), pa.array([f for f in prints for _ in choices], pa.binary())], names=["key", "fp"]
        )

    return lambda: step


def _prints(words: int, bits: int, groups: int, rows: int):
    """Batches of texts -> (doc_id, text_key, fp), with groups also keys, and fp is of the set and ends in its digest."""

    def step(batch: pa.RecordBatch):
        fps, keys = [], []
        for text in batch.column(1).to_pylist():
            h = shingle_hashes(text, words)
            if groups:
                h = np.unique(h)
            fp = b"".join(x.to_bytes(8, "big") for x in reversed(fingerprint(h, bits)))
            if groups:
                fp += xxhash.xxh3_128_digest(h.tobytes(), SEED)
                keys.append(minhash_keys(h, groups, rows))
            fps.append(fp)
        arrays = [batch.column(0).cast(pa.int64()), batch.column(2), pa.array(fps, pa.binary())]
        names = ["doc_id", "text_key", "fp"]
        if groups:
            arrays.append(pa.array(keys, pa.list_(pa.int64())))
            names.append("keys")
        return pa.RecordBatch.from_arrays(arrays, names=names)

    return lambda: step


def _row_bit(id_, text_key):
    """Number of the sieve's bit that stands for a row."""
    return F.pmod(F.xxhash64(F.coalesce(id_.cast("long"), F.lit(0)), text_key), F.lit(SIEVE_BITS))


def _sieve(rows: DataFrame) -> DataFrame:
    """rows(id, text_key) -> (sieve_word, sieve_held), words of 64 bits: one bit is set for each row."""
    spots = rows.select(_row_bit(F.col("id"), F.col("text_key")).alias("at"))
    bit = F.expr("shiftleft(1L, cast(at & 63 AS int))")
    return spots.groupBy(F.shiftright("at", 6).alias("sieve_word")).agg(F.bit_or(bit).alias("sieve_held"))


def _through(rows: DataFrame, sieve: DataFrame) -> tuple[DataFrame, Column]:
    """rows(id, text_key, ..) beside their word of a broadcast sieve, and whether the bit of a row is set."""
    at = _row_bit(F.col("id"), F.col("text_key"))
    marked = rows.withColumn("sieve_at", at).withColumn("sieve_word", F.shiftright("sieve_at", 6))
    marked = marked.join(F.broadcast(sieve), "sieve_word", "left")
    return marked, F.coalesce(F.expr("shiftright(sieve_held, cast(sieve_at & 63 AS int)) & 1") == 1, F.lit(False))


def _with_sets(asked: DataFrame, docs: DataFrame, words: int, scratch: Scratch) -> DataFrame:
    """asked(own, ..) -> the same rows with ``shingles``, the sorted set of the text that ``own``, (id, text_key), names.

    Sets are larger than their texts, so they are made where they are needed instead of stored for
    all rows; texts are shuffled in their place. Only texts that pass a sieve are: a table of SIEVE_BITS
    bits at most, one set for each hash of an ``own``, is broadcast as rows of 64 bits. The join on
    ``own`` itself decides, so a sieve that is full costs shuffling and changes no result. Rows that
    repeat an id and a text are combined first.
    """
    asked = scratch.store(asked.select("*", "own.id", "own.text_key").drop("own"), "asked")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("text").alias("text_key"), "text")
    marked, passes = _through(texts, _sieve(asked))
    texts = marked.where(passes)
    texts = texts.groupBy("id", "text_key").agg(F.min("text").alias("text"))
    found = asked.join(texts, ["id", "text_key"]).drop("id", "text_key")
    more = [c for c in found.columns if c != "text"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema if f.name != "text") + ", shingles binary"

    def step(batch: pa.RecordBatch):
        sets = [np.unique(shingle_hashes(text, words)).tobytes() for text in batch.column(len(more)).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(more)], pa.array(sets, pa.binary())], names=[*more, "shingles"])

    return map_texts(found, [*more, "text"], schema, lambda: step, size=4 << 20)


def link_sets(nodes: list[bytes], sets: list[np.ndarray], known: list[bytes], radius: int, similarity: float, bits: int) -> list[tuple[bytes, bytes]]:
    """Star edges (node, smallest of its local component) among nodes whose sets have the similarity.

    Nodes of one ``known`` label are linked already. Sets are sorted and without repeats.
    """
    links = _Sets()
    first: dict[bytes, bytes] = {}
    for x, label in zip(nodes, known, strict=True):
        links.join(first.setdefault(label, x), x)
    prints = np.frombuffer(b"".join(x[: bits // 8] for x in nodes), np.uint64).reshape(len(nodes), -1)
    sizes = np.array([len(s) for s in sets], np.int64)
    for i in range(1, len(nodes)):
        fits = np.minimum(sizes[:i], sizes[i]) >= similarity * np.maximum(sizes[:i], sizes[i]) - 1e-9
        away = np.bitwise_count(prints[:i] ^ prints[i]).sum(1, dtype=np.int64)
        near = np.nonzero(fits & (away <= radius))[0]
        for j in near[np.argsort(away[near], kind="stable")].tolist():
            if links.root(nodes[i]) == links.root(nodes[j]):
                continue
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if common >= similarity * (sizes[i] + sizes[j] - common) - 1e-9:
                links.join(nodes[i], nodes[j])
    return [(x, r) for x in nodes if (r := links.root(x)) != x]


def _block_links(radius: int, similarity: float, bits: int):
    """Batches (label, part, fp, known, shingles) sorted by label and part -> verified edges of each part."""

    def run(batches):
        now, nodes, sets, known = None, [], [], []
        found: list[tuple[bytes, bytes]] = []

        def flush():
            if len(nodes) > 1:
                found.extend(link_sets(nodes, sets, known, radius, similarity, bits))
            for held in (nodes, sets, known):
                held.clear()

        def emit():
            arrays = [pa.array([e[i] for e in found], pa.binary()) for i in (0, 1)]
            found.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["u", "v"])

        for batch in batches:
            for label, part, fp, mark, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (label, part) != now:
                    flush()
                    now = (label, part)
                nodes.append(fp)
                sets.append(np.frombuffer(shingles, np.uint64))
                known.append(mark)
            if len(found) > 20_000:
                yield emit()
        flush()
        yield emit()

    return run


def _verified(
    clusters: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, radius: int, similarity: float, bits: int, scratch: Scratch
) -> DataFrame:
    """clusters(node, label) of candidates -> edges (u, v) of pairs in one cluster that have the similarity."""
    counts = clusters.groupBy("label").agg(F.count("*").alias("n"))
    members = clusters.join(counts, "label").join(nodes.selectExpr("fp AS node", "own"), "node").selectExpr("node AS fp", "label", "n", "own")
    sets = scratch.store(_with_sets(members, docs, words, scratch), "sets")
    links = _block_links(radius, similarity, bits)

    def compared(parts: DataFrame) -> DataFrame:
        dealt = parts.select("label", "part", "fp", "known", "shingles").repartition("label", "part").sortWithinPartitions("label", "part", "fp")
        return dealt.mapInArrow(links, "u binary, v binary")

    spot = lambda seed, n: F.pmod(F.xxhash64("fp", F.lit(seed)), F.greatest(n, F.lit(1)))
    spread = F.ceil(F.col("n") / BLOCK_ROWS)
    deals = F.when(F.col("n") <= BLOCK_ROWS, F.array(F.lit("0"))).otherwise(
        F.array(*(F.concat_ws("/", F.lit(d), spot(d, spread)) for d in (1, 2)))
    )
    edges = scratch.store(compared(sets.withColumn("known", F.col("fp")).withColumn("part", F.explode(deals))), "verified")
    large = sets.where(F.col("n") > BLOCK_ROWS)
    if large.isEmpty():
        scratch.drop(sets)
        return edges
    linked = scratch.store(components(edges, scratch).selectExpr("node AS fp", "label AS known"), "known")
    marked = large.select("fp", "label", "n").join(linked, "fp", "left").select("fp", "label", "n", F.coalesce("known", "fp").alias("known"))
    marked = scratch.store(marked, "marked")
    sizes = marked.groupBy("label", "n", "known").agg(F.count("*").alias("size"))
    main = sizes.groupBy("label", "n").agg(F.max_by("known", F.struct("size", "known")).alias("main"), F.max("size").alias("held"))
    main = scratch.store(main.where("held < n").drop("n"), "main")
    if main.isEmpty():
        scratch.drop(sets)
        return edges
    todo = large.join(main, "label").join(marked.select("fp", "known"), "fp")
    inner, outer = F.ceil(F.col("held") / BLOCK_ROWS), F.ceil((F.col("n") - F.col("held")) / BLOCK_ROWS)
    own_g, own_r = spot(3, inner), spot(3, outer)
    g = lambda i, j: F.concat_ws("/", F.lit("g"), i, j)
    r = lambda i, j: F.concat_ws("/", F.lit("r"), F.least(i, j), F.greatest(i, j))
    outside = F.concat(
        F.transform(F.sequence(F.lit(0).cast("long"), inner - 1), lambda i: g(i, own_r)),
        F.transform(F.sequence(F.lit(0).cast("long"), outer - 1), lambda i: r(i, own_r)),
    )
    inside = F.transform(F.sequence(F.lit(0).cast("long"), outer - 1), lambda j: g(own_g, j))
    parts = F.explode(F.when(F.col("known") == F.col("main"), inside).otherwise(outside))
    edges = edges.unionByName(scratch.store(compared(todo.withColumn("part", parts)), "verified"))
    scratch.drop(sets)
    return edges


def _deeper_keys(groups: int, rows: int, first: int):
    """Batches of (fp, shingles) -> (fp, keys) by min-hashes that no other level uses."""

    def step(batch: pa.RecordBatch):
        keys = [minhash_keys(np.frombuffer(x, np.uint64), groups, rows, first) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64()))], names=["fp", "keys"])

    return lambda: step


def _divide_hot(
    keyed: DataFrame, sets: DataFrame | Callable[[DataFrame], DataFrame], similarity: float, miss: float, scratch: Scratch
) -> tuple[DataFrame, DataFrame | None]:
    """keyed(key, fp), sets(fp, shingles), or a function that makes them of a table of fp -> shards (key, fp) of at most HOT_ROWS members, and star edges of hotter ones.

    Each level deals the members of a hot shard by its own groups of longer keys. A pair that shares
    a shard at one level shares one at the next but for a chance of ``miss``. A level starts from the
    hot shard of the first level, so that the rows of a member don't multiply.
    """
    out, held = None, None
    find = sets if callable(sets) else lambda asked: asked.join(sets, "fp")
    now = keyed.select(F.col("key").cast("string").alias("shard"), F.col("key").cast("string").alias("key"), "fp")
    for level, rows in enumerate((*DEEPER, None)):
        hot = scratch.store(now.groupBy("key").count().where(F.col("count") > HOT_ROWS).select("key"), "hot")
        if hot.isEmpty():
            part, now = now, None
        else:
            part, now = now.join(hot, "key", "left_anti"), now.join(hot, "key")
        part = part.select("key", "fp")
        out = part if out is None else out.unionByName(part)
        if now is None:
            return out, None
        if rows is None:
            break
        members = scratch.store(now.select("shard", "fp").distinct(), "members")
        groups = groups_for(similarity, rows, miss)
        asked = members.select("fp").distinct()
        if held is None:
            # Later levels' members are among those of the first.
            asked = held = scratch.store(find(asked).select("fp", "shingles"), "hotsets")
        else:
            asked = asked.join(held, "fp").select("fp", "shingles")
        keys = map_texts(asked, ["fp", "shingles"], "fp binary, keys array<long>", _deeper_keys(groups, rows, 10_000 * (level + 1)))
        again = members.join(keys, "fp").select("shard", F.explode("keys").alias("own"), "fp")
        now = scratch.store(again.select("shard", F.concat_ws("/", "shard", F.lit(level), "own").alias("key"), "fp"), "again")
    lowest = now.groupBy("key").agg(F.min("fp").alias("v"))
    return out, now.join(lowest, "key").where("fp <> v").select(F.col("fp").alias("u"), "v")


def _classified(
    docs: DataFrame, words: int, bits: int, radius: int, similarity: float | None, miss: float, scratch: Scratch
) -> tuple[DataFrame, DataFrame]:
    """Two stored tables: rows (doc_id, text_key, fp), one per row of docs, and classes (fp, label, component_id)."""
    groups = rows = 0
    if similarity is not None:
        rows, radius = 2, radius_for(similarity, bits, miss)
        groups = groups_for(similarity, rows, miss)
    schema = "doc_id long, text_key long, fp binary" + (", keys array<long>" if groups else "")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    prints = map_texts(texts, ["doc_id", "text", "text_key"], schema, _prints(words, bits, groups, rows))
    prints = scratch.store(prints, "prints")
    own = F.struct(F.coalesce("doc_id", F.lit(0)).alias("id"), "text_key")
    lowest = [F.min("doc_id").alias("first"), *([F.min(own).alias("own"), F.first("keys").alias("keys")] if groups else [])]
    nodes = scratch.store(prints.groupBy("fp").agg(*lowest), "nodes")
    stars = None
    if groups:
        # Equal sets have equal keys, and one set's keys differ; each distinct (key, fp) is one row.
        keyed = nodes.select(F.explode("keys").alias("key"), "fp")
        find = lambda asked: _with_sets(asked.join(nodes.select("fp", "own"), "fp"), docs, words, scratch)
        keyed, stars = _divide_hot(keyed, find, similarity, miss, scratch)
    else:
        m = blocks_for(nodes.count(), radius, bits)
        keyed = map_texts(nodes, ["fp"], "key binary, fp binary", _block_keys(radius, bits, m), 4096)
    dealt = keyed.repartition("key").sortWithinPartitions("key", "fp")
    edges = dealt.mapInArrow(_shard_links(radius, bits, not groups), "u binary, v binary")
    if groups:
        edges = edges if stars is None else edges.unionByName(stars)
        clusters = scratch.store(components(edges, scratch), "clusters")
        edges = _verified(clusters, docs, nodes, words, radius, similarity, bits, scratch)
    labels = scratch.store(components(edges, scratch).join(nodes.selectExpr("fp AS node", "first"), "node"), "labels")
    firsts = scratch.store(labels.groupBy("label").agg(F.min("first").alias("component_id")), "firsts")
    linked = scratch.store(labels.join(firsts, "label").select(F.col("node").alias("fp"), "label", "component_id"), "linked")
    classes = nodes.join(linked, "fp", "left").select(
        "fp", F.coalesce("label", "fp").alias("label"), F.coalesce("component_id", "first").alias("component_id")
    )
    return prints, scratch.store(classes, "classes")


def simhash_components(
    docs: DataFrame,
    words: int = 3,
    bits: int = 64,
    radius: int = 3,
    similarity: float | None = None,
    miss: float = 1e-4,
    name: str = "simhash",
) -> DataFrame:
    """docs(doc_id, text, ..) -> (doc_id, fp binary, component_id), one row per row of docs.

    With ``similarity`` texts link when their shingle sets have that Jaccard similarity; a pair
    is missed with a chance of at most ``miss`` by the min-hashes, by each level of a hot shard
    and by the radius. Else shards come from blocks of the fingerprint and no pair is missed.
    """
    prints, classes = _classified(docs, words, bits, radius, similarity, miss, Scratch(docs.sparkSession, name))
    fp = F.substring("fp", 1, bits // 8).alias("fp")
    return prints.select("doc_id", "fp").join(classes, "fp").select("doc_id", fp, "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"), words=3, bits=64, radius=3, name="op4")
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def dedup_stage(
    spark: SparkSession, docs: DataFrame, sf_dir: str, words: int = 5, similarity: float = 0.8, bits: int = 256, miss: float = 1e-4
) -> DataFrame:
    """Keep one row of each near-duplicate group: that with the smallest doc_id.

    Two texts link when the sets of their five-word shingles have a Jaccard similarity of 0.8 or
    more. Groups are of rows, so of one id's unlike texts each stays in its own group. Where the
    smallest id has several rows in a group, the text with the smallest hash stays, and of its
    rows the one with the smallest hash over all columns. Fingerprints of 256 bits find the
    candidates and miss a pair of 0.8 with a chance of at most 2 in 10,000, in hot shards ``miss``
    more a level (see the top of this module). Rows with a null doc_id stay.
    """
    scratch = Scratch(spark, "dedup")
    prints, classes = _classified(docs, words, bits, 0, similarity, miss, scratch)
    rows = scratch.store(prints.where("doc_id is not null").select("doc_id", "text_key", "fp").join(classes.select("fp", "label"), "fp"), "rows")
    own = F.struct("doc_id", "text_key")
    best = scratch.store(rows.groupBy("label").agg(F.min(own).alias("best")), "best")
    gone = rows.join(best, "label").where(own != F.col("best")).select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    gone = scratch.store(gone, "gone")
    again = rows.groupBy("doc_id", "text_key").count().where("count > 1").selectExpr("doc_id AS gone_id", "text_key AS gone_key")
    again = scratch.store(again, "repeated")
    # Texts whose row is no other's copy don't pass the sieve, and aren't shuffled.
    touched = gone.unionByName(again).select(F.col("gone_id").alias("id"), F.col("gone_key").alias("text_key"))
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    marked, passes = _through(rows.select(F.col("row.doc_id").alias("id"), F.xxhash64("row.text").alias("text_key"), "row"), _sieve(touched))
    at = lambda other: (F.col("id") == other["gone_id"]) & (F.col("text_key") == other["gone_key"])
    asked = marked.where(passes).select("id", "text_key", "row").join(gone, at(gone), "left_anti")
    kept = marked.where(~passes).select("row.*")
    if again.isEmpty():
        return kept.unionByName(asked.select("row.*"))
    once = asked.join(again, at(again), "left_semi").groupBy("id", "text_key").agg(F.min_by("row", F.xxhash64(*[F.col("row")[c] for c in docs.columns])).alias("row"))
    return kept.unionByName(asked.join(again, at(again), "left_anti").select("row.*")).unionByName(once.select("row.*"))
