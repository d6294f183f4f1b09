"""SentencePiece encoding and decoding, with sampled segmentations drawn without replacement.

Encoding. Where no piece of the model holds two neighbouring characters, no piece bridges the place
between them, so a normalised text falls into units there. Units are encoded, decoded and compared
once while a task remembers them (the units met most often stay); a text's ids are its units' ids
in order. 64-bit hashes stand for units: with the million units that a task remembers at most, two
share one with a chance below 1 in 10 million.

Sampling. The lattice of a text has a node between any two characters and an edge for each piece;
a path's weight is exp(alpha x sum of piece scores). Per unit, weights summed backwards give every
node the distribution of its next edge, so drawing edges in order draws paths by weight. Distinct
paths with the k largest perturbed log-weights (Gumbel top-k) are found by an A-star search over
sets of paths: the set of all paths has the Gumbel of mass 0; taking its best path leaves the sets
of paths that follow it up to an edge and differ there; each set's best value is a Gumbel of the
set's mass cut off at the value taken, the best of all sets is opened next, and its path is drawn
inside the set. Values are exact bounds, so k openings give k distinct paths, in order.

A path's inclusion score is its chance to be among the k, given the (k+1)-th value kappa:
1 - exp(-exp(log-weight - kappa)); 1 where the lattice has no more paths. The numbers that perturb
come from a counter hash of the row's key and text, so results don't depend on partitions.

Characters without a piece are spelt by the pieces of their bytes: one edge.

Defined results: a null text counts as empty and has no pieces; its one path is empty. Rows that
repeat in id and text have equal results; a null doc_id is a key like another.
"""

from __future__ import annotations

import heapq
import math
import zlib
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmix.llm.common import map_texts, table

ALPHA = 1e-3
SAMPLES = 2
#: Edges a task remembers; 24 bytes each. Above this the units met least are forgotten.
MEMO_EDGES = 1_600_000
#: Bytes of text that are worked on at a time (a longer text alone).
BATCH_BYTES = 256 << 10
#: Characters of new units whose lattices are made at a time (a longer unit alone).
ADD_CHARS = 1 << 15
_BLANK = "▁"
_U = np.uint64


def uniforms(seed: np.ndarray, counter: int | np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) of 53 bits from 64-bit seeds and counters (a multiply-xorshift hash)."""
    z = seed + (_U(counter * 0x9E3779B97F4A7C15 % 2**64) if isinstance(counter, int) else counter * _U(0x9E3779B97F4A7C15))
    z ^= z >> _U(32)
    z *= _U(0xD6E8FEB86659FD93)
    z ^= z >> _U(32)
    z *= _U(0xD6E8FEB86659FD93)
    z >>= _U(11)
    u = z.astype(np.float64)
    u += 0.5
    u *= 2.0**-53
    return u


def _hashed(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hashes of strings that are one character longer; never 0 in practice, which marks a free slot."""
    h = (h ^ (codes.astype(_U) + _U(0x9E3779B97F4A7C15))) * _U(0xFF51AFD7ED558CCD)
    return h ^ (h >> _U(29))


#: No Gumbel value made from such a number lies outside of these.
_GUMBEL_LOW, _GUMBEL_HIGH = -3.7, 37.5


def _bridge_slots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Places of character pairs in the table of pairs that pieces hold."""
    return (left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA6B)) >> np.uint32(10)


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin, begin + 1, .. for each pair, one after another."""
    heads = np.cumsum(count) - count
    return np.repeat(begin - heads, count) + np.arange(int(count.sum()))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Lattices:
    """Units met so far: their pieces, and the nodes and edges of their lattices in flat arrays."""

    #: name -> dtype of what is kept per edge, per node, per unit and per id.
    #: hop: upto as a float32 and the first edge of the node that the edge leads to (-1: the unit's end) as an int32, read together.
    EDGE = {"hop": np.uint64, "logq": np.float64, "rest": np.float32, "piece": np.int32}
    UNIT = {"start": np.int64, "ids_from": np.int64, "ids_count": np.int32, "hits": np.int64, "same": bool}

    def __init__(self, path: str, alpha: float = ALPHA, memo_edges: int = MEMO_EDGES):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.alpha, self.memo_edges = alpha, memo_edges
        n = self.model.get_piece_size()
        self.bytes = {}
        self.pieces: dict[str, tuple[int, float]] = {}
        for i in range(n):
            if self.model.is_byte(i):
                self.bytes[int(self.model.id_to_piece(i)[1:-1], 16)] = i
            elif not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i)):
                self.pieces[self.model.id_to_piece(i)] = (i, self.model.get_score(i))
        # Scores like -1e9 mark pieces that no merge makes; they rank behind all others.
        real = [s for _, s in self.pieces.values() if s > -1e8]
        floor = min(real, default=0.0) - 10
        self.floor = floor
        self.pieces = {p: (i, max(s, floor) * alpha) for p, (i, s) in self.pieces.items()}
        self._table()
        self.weight = np.zeros(n)
        for i, w in self.pieces.values():
            self.weight[i] = w
        self.longest = max(map(len, self.pieces), default=1)
        self.bridges = np.zeros(1 << 22, bool)
        codes = _codes("".join(self.pieces))
        inner = np.ones(len(codes), bool)
        inner[np.cumsum(np.fromiter(map(len, self.pieces), np.int64, len(self.pieces))) - 1] = False
        inner = np.nonzero(inner)[0]
        self.bridges[_bridge_slots(codes[inner], codes[inner + 1])] = True
        self.fence = self._fence()
        self.spelt: list[tuple[int, ...]] = []
        self.spelt_at: dict[str, int] = {}
        rng = np.random.default_rng(11)
        self.letters = rng.integers(0, 2**64, 1 << 12, np.uint64)
        self.clear()

    def _fence(self) -> tuple[str, int, int | None]:
        """A character that no piece holds, how many ids it takes at the front of a text, and its id where it takes one."""
        held = {c for p in self.pieces for c in p}
        for c in ("\n", *map(chr, range(0xE000, 0xF8FF))):
            if c not in held and self.model.normalize(c).endswith(c):
                front, twice = self.model.encode(c), self.model.encode(c * 2)
                return c, len(front), front[-1] if len(twice) == len(front) + 1 else None
        raise ValueError("no character stands outside all pieces")

    def _table(self) -> None:
        """An open-addressing table of the hashes of all pieces and their prefixes: the piece's id, or -1."""
        known: dict[str, int] = {}
        for p, (i, _) in self.pieces.items():
            for n in range(1, len(p)):
                known.setdefault(p[:n], -1)
            known[p] = i
        self.shift = _U(64 - (max(len(known), 1) * 4).bit_length())
        self.slots = np.zeros(1 << (64 - int(self.shift)), _U)
        self.values = np.full(len(self.slots), -2, np.int32)
        by_length: dict[int, list[str]] = {}
        for p in known:
            by_length.setdefault(len(p), []).append(p)
        for n, group in by_length.items():
            codes = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
            h = np.zeros(len(group), _U)
            for i in range(n):
                h = _hashed(h, codes[:, i])
            value = np.fromiter(map(known.__getitem__, group), np.int32, len(group))
            at = (h >> self.shift).astype(np.int64)
            while len(at):
                # Of those that ask for a free slot one takes it; the others go on.
                spots, taker = np.unique(at, return_index=True)
                taker = taker[self.slots[spots] == 0]
                self.slots[at[taker]], self.values[at[taker]] = h[taker], value[taker]
                on = np.ones(len(at), bool)
                on[taker] = False
                at, h, value = (at[on] + 1) % len(self.slots), h[on], value[on]

    def _look_up(self, h: np.ndarray) -> np.ndarray:
        """Ids of pieces by hash, -1 for prefixes of pieces only, -2 for others."""
        at = (h >> self.shift).astype(np.int64)
        there = self.slots[at]
        more = np.nonzero((there != h) & (there != 0))[0]
        while len(more):
            at[more] = (at[more] + 1) % len(self.slots)
            there = self.slots[at[more]]
            more = more[(there != h[more]) & (there != 0)]
        return self.values[at]

    def clear(self) -> None:
        self.known, self.unit_of = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.n_units = self.n_nodes = self.n_edges = self.n_ids = 0
        for name, kind in (*self.EDGE.items(), *self.UNIT.items(), ("first", np.int32), ("ids", np.int32)):
            setattr(self, name, np.zeros(1 << 12, kind))

    @property
    def upto(self) -> np.ndarray:
        """Sums of chances up to each edge of its node; 2 for a node's last edge."""
        return self.hop.view(np.float32)[::2]

    @property
    def goto(self) -> np.ndarray:
        """First edges of the nodes that edges lead to, -1 at a unit's end."""
        return self.hop.view(np.int32)[1::2]

    @property
    def next(self) -> np.ndarray:
        """Nodes that edges lead to, -1 at a unit's end."""
        goto = self.goto[: self.n_edges]
        return np.where(goto < 0, -1, np.searchsorted(self.first[: self.n_nodes], goto))

    def _append(self, name: str, at: int, values: np.ndarray) -> None:
        """Set values from ``at`` on, growing the array where it is too short."""
        a = getattr(self, name)
        if at + len(values) > len(a):
            b = np.zeros(max(at + len(values), len(a) + len(a) // 2), a.dtype)
            b[:at] = a[:at]
            setattr(self, name, a := b)
        a[at : at + len(values)] = values

    def _pick(self, name: str, at: np.ndarray) -> None:
        """Keep the values at these places, in this order; the array keeps its room."""
        a = getattr(self, name)
        a[: len(at)] = a[at]

    def _spell(self, char: str) -> int:
        """Number of a character that is spelt by the pieces of its bytes."""
        if char not in self.spelt_at:
            unknown = self.model.unk_id()
            self.spelt_at[char] = len(self.spelt)
            self.spelt.append(tuple(self.bytes.get(b, unknown) for b in char.encode("utf-8", "surrogatepass")))
        return self.spelt_at[char]

    def normalised(self, text: str | None) -> str:
        return self.model.normalize(text) if text else ""

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """Unit numbers of each normalised text's units; new units are added."""
        if self.n_edges > self.memo_edges:
            self._keep_hot()
        text = "".join(texts)
        ends_of = np.cumsum([len(t) for t in texts])
        if not text:
            return [np.empty(0, np.int32) for _ in texts]
        codes = _codes(text)
        begins = np.ones(len(codes), bool)
        begins[1:] = ~self.bridges[_bridge_slots(codes[:-1], codes[1:])]
        begins[ends_of[ends_of < len(codes)]] = True
        starts = np.nonzero(begins)[0]
        ends = np.append(starts[1:], len(codes))
        hashes = self._unit_hashes(codes, starts, ends)
        # Like np.unique, but any of a kind's places will do, so that the sort needn't be stable.
        order = np.argsort(hashes)
        kinds = hashes[order]
        other = np.concatenate(([True], kinds[1:] != kinds[:-1]))
        kinds, first = kinds[other], order[other]
        back = np.empty(len(order), np.int64)
        back[order] = np.cumsum(other) - 1
        at = np.searchsorted(self.known, kinds)
        new = np.ones(len(kinds), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != kinds[inside]
        if new.any():
            base = self.n_units
            a, b = starts[first[new]], ends[first[new]]
            part, long = np.cumsum(b - a) // ADD_CHARS, b - a > ADD_CHARS
            cuts = [0, *(np.nonzero((np.diff(part) > 0) | long[1:] | long[:-1])[0] + 1).tolist(), len(a)]
            a, b = a.tolist(), b.tolist()
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                self._add([text[i:j] for i, j in zip(a[x:y], b[x:y], strict=True)])
            spots = at[new]
            self.known = np.insert(self.known, spots, kinds[new])
            self.unit_of = np.insert(self.unit_of, spots, np.arange(base, self.n_units, dtype=np.int32))
            at = np.searchsorted(self.known, kinds)
        units = self.unit_of[at]
        self.hits[units] += np.bincount(back, minlength=len(kinds))
        return np.split(units[back], np.searchsorted(starts, ends_of[:-1]))

    def _unit_hashes(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes that stand for units: the sum of letter numbers, each mixed with its place in the unit."""
        place = np.arange(len(codes), dtype=np.uint64)
        place -= np.repeat(starts.astype(np.uint64), ends - starts)
        x = self.letters[codes & np.uint32(0xFFF)] ^ (codes.astype(np.uint64) * _U(0xD6E8FEB86659FD93))
        x += place * _U(0x9E3779B97F4A7C15)
        x ^= x >> _U(32)
        x *= _U(0xFF51AFD7ED558CCD)
        x ^= x >> _U(29)
        return np.add.reduceat(x, starts)

    def _keep_hot(self) -> None:
        """Forget all but the units met most often, down to half of what may be kept.

        Those met most come first, so that what is read most often lies close together.
        """
        n = self.n_units
        node_from = np.append(self.start[:n], self.n_nodes)
        edge_from = np.append(self.first[self.start[:n]].astype(np.int64), self.n_edges)
        nodes, edges = np.diff(node_from), np.diff(edge_from)
        order = np.argsort(-self.hits[:n], kind="stable")
        keep = order[np.cumsum(edges[order]) <= self.memo_edges // 2]
        nodes, edges, ids = nodes[keep], edges[keep], self.ids_count[keep].astype(np.int64)
        at_nodes, at_edges, at_ids = (_ranges(f, c) for f, c in ((node_from[keep], nodes), (edge_from[keep], edges), (self.ids_from[keep], ids)))
        moved_edges = np.cumsum(edges) - edges - edge_from[keep]
        for name, at in (("first", at_nodes), ("ids", at_ids), *((x, at_edges) for x in self.EDGE), *((x, keep) for x in self.UNIT)):
            self._pick(name, at)
        self.first[: len(at_nodes)] += np.repeat(moved_edges, nodes).astype(np.int32)
        goto = self.goto[: len(at_edges)]
        goto += np.where(goto < 0, 0, np.repeat(moved_edges, edges)).astype(np.int32)
        self.start[: len(keep)], self.ids_from[: len(keep)] = np.cumsum(nodes) - nodes, np.cumsum(ids) - ids
        self.hits //= 2
        number = np.full(n, -1, np.int32)
        number[keep] = np.arange(len(keep), dtype=np.int32)
        there = number[self.unit_of] >= 0
        self.known, self.unit_of = self.known[there], number[self.unit_of[there]]
        self.n_units, self.n_nodes, self.n_edges, self.n_ids = len(keep), len(at_nodes), len(at_edges), len(at_ids)

    def _encoded_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all units, one after another, their number for each, and whether decoding them gives the unit back.

        Units are encoded behind a fence each, all in one line: no piece reaches over a fence.
        """
        fence, front, own = self.fence
        line = (fence + fence.join(units)).replace(_BLANK, " ")
        flat = self.model.encode(line, return_type="numpy").astype(np.int32, copy=False)
        marks = np.nonzero(flat == own)[0] if own is not None else ()
        # The fence may be a unit of its own or stand in one: then there are more marks.
        if len(marks) == len(units) and self.model.decode(flat) == line:
            counts = np.diff(marks, append=len(flat)) - 1
            return flat[_ranges(marks + 1, counts)], counts, np.ones(len(units), bool)
        lines = [(fence + u).replace(_BLANK, " ") for u in units]
        ids = self.model.encode(lines, num_threads=1)
        same = np.array([d == x for d, x in zip(self.model.decode(ids, num_threads=1), lines, strict=True)], bool)
        counts = np.fromiter((len(x) - front for x in ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(x[front:] for x in ids), np.int32, int(counts.sum())), counts, same

    def _add(self, units: list[str]) -> None:
        base = self.n_units
        self.n_units += len(units)
        text = "".join(units)
        # Units with the fence are encoded apart, so that it doesn't count as a mark.
        if self.fence[0] in text:
            parts = [self._encoded_units(list(group)) for _, group in groupby(units, key=lambda u: self.fence[0] in u)]
            ids, counts, same = (np.concatenate(x) for x in zip(*parts, strict=True))
        else:
            ids, counts, same = self._encoded_units(units)
        self._append("ids", self.n_ids, ids)
        self._append("ids_from", base, self.n_ids + np.cumsum(counts) - counts)
        self._append("ids_count", base, counts)
        self.n_ids += len(ids)
        self._append("same", base, same)
        self._append("hits", base, np.zeros(len(units), np.int64))
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        ends_at = np.cumsum(lengths)
        starts = np.concatenate(([0], ends_at))
        nodes = int(ends_at[-1])
        # Pieces at all places of all units at once, grown by a character a round.
        codes = _codes(text)
        left = np.repeat(ends_at, lengths) - np.arange(nodes)
        place, h = np.arange(nodes), np.zeros(nodes, _U)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        count = np.zeros(nodes, np.int64)
        alone = None
        while len(place):
            n = len(found)
            h = _hashed(h, codes[place + n])
            value = self._look_up(h)
            hit = value >= 0
            at = place[hit]
            found.append((at, value[hit]))
            count[at] += 1
            if alone is None:
                alone = np.nonzero(~hit)[0]
            on = (value >= -1) & (left[place] > n + 1)
            place, h = place[on], h[on]
        count[alone] += 1
        # Edges by node, the longest first: it is drawn most often.
        first = np.concatenate(([0], np.cumsum(count)))
        edges = int(first[-1])
        size, what = np.ones(edges, np.int64), np.empty(edges, np.int64)
        free = first[:-1].copy()
        for n in range(len(found), 0, -1):
            at, value = found[n - 1]
            spot = free[at]
            size[spot], what[spot] = n, value
            free[at] += 1
        spot = free[alone]
        what[spot] = 0
        w = self.weight[what]
        w[spot] = self.floor * self.alpha
        what[spot] = [-1 - self._spell(text[i]) for i in alone.tolist()]
        owner = np.repeat(np.arange(nodes), count)
        to_ = owner + size
        final = size == left[owner]
        # Backward sums, all nodes of one distance to their unit's end at a time: nodes and edges are
        # put in that order, so that a round is a slice.
        order = np.argsort(left.astype(np.uint16) if int(left.max()) < 1 << 16 else left, kind="stable")
        rank = np.empty(nodes + 1, np.int64)
        rank[order] = np.arange(nodes)
        rank[nodes] = nodes
        c_all = count[order]
        heads_all = np.concatenate(([0], np.cumsum(c_all)))
        e_all = np.repeat(first[:-1][order] - heads_all[:-1], c_all) + np.arange(edges)
        t_all = w[e_all]
        to_all = np.where(final[e_all], nodes, rank[np.minimum(to_[e_all], nodes)])
        value = np.zeros(nodes + 1)  # by rank; the last stands for a unit's end
        cuts = np.searchsorted(left[order], np.arange(1, int(left.max()) + 2))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a < b:
                x, y = heads_all[a], heads_all[b]
                t = t_all[x:y]
                t += value[to_all[x:y]]
                heads = heads_all[a:b] - x
                top = np.maximum.reduceat(t, heads)
                value[a:b] = top + np.log(np.add.reduceat(np.exp(t - np.repeat(top, c_all[a:b])), heads))
        total = np.empty(edges)
        total[e_all] = t_all
        beta = value[rank[:nodes]]
        logq = total - beta[owner]
        q = np.exp(logq)
        # For the heaviest edge the rest is summed, since 1 - q would round it off; in logarithms where it is tiny.
        most = np.maximum.reduceat(q, first[:-1])
        peak = np.nonzero(q == most[owner])[0]
        of = owner[peak]
        heavy = peak[np.diff(of, prepend=-1) > 0]
        light = q.copy()
        light[heavy] = 0.0
        others = np.add.reduceat(light, first[:-1])
        with np.errstate(divide="ignore"):
            rest = np.log(np.maximum(1 - q, 0.0))
            rest[heavy] = np.log(others)
        tiny = np.nonzero((others < 1e-200) & (count > 1))[0]
        if len(tiny):
            held = count[tiny]
            heads = np.cumsum(held) - held
            light = logq[_ranges(first[tiny], held)]
            light[heads + heavy[tiny] - first[tiny]] = -np.inf
            top = np.maximum.reduceat(light, heads)
            rest[heavy[tiny]] = top + np.log(np.add.reduceat(np.exp(light - np.repeat(top, held)), heads))
        # Sums along a node's edges, edge by edge: they don't depend on the other units of a call.
        upto, at, place = q.copy(), np.nonzero(count > 1)[0], 1
        while len(at):
            e = first[at] + place
            upto[e] += upto[e - 1]
            place += 1
            at = at[count[at] > place]
        upto[first[1:] - 1] = 2.0  # the last edge takes what rounding leaves
        a, b = self.n_nodes, self.n_edges
        self._append("first", a, first[:-1] + b)
        self._append("start", base, starts[:-1] + a)
        hop = np.empty(edges, _U)
        hop.view(np.float32)[::2], hop.view(np.int32)[1::2] = upto, np.where(final, -1, first[to_] + b)
        for name, values in (("hop", hop), ("logq", np.minimum(logq, 0.0)), ("rest", rest), ("piece", what)):
            self._append(name, b, values)
        self.n_nodes, self.n_edges = a + nodes, b + edges

    def node_edges(self, edge: int) -> range:
        """All edges of the node that an edge leaves."""
        upto, low, past = self.upto, edge, edge + 1
        while low and upto[low - 1] < 2.0:
            low -= 1
        while upto[past - 1] < 2.0:
            past += 1
        return range(low, past)

    def walk(self, begin: np.ndarray, seeds: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
        """Draw each unit's edges from a node to its end.

        begin: the nodes' first edges, -1 for units already at their end. Returns the edges in order
        and each unit's number of edges. Numbers depend on the unit's seed, its step and the salt alone.
        """
        rounds: list[tuple[np.ndarray, np.ndarray]] = []
        at = np.nonzero(begin >= 0)[0]
        e = begin[at].astype(np.int64)
        mine = seeds[at]
        step = 0
        while len(at):
            hop = self.hop[e]
            upto = hop.view(np.float32)[::2]
            draw = np.nonzero(upto < 2.0)[0]  # others have one edge
            if len(draw):
                u = uniforms(mine[draw], (salt << 40) + step)
                over = np.nonzero(upto[draw] < u)[0]
                while len(over):
                    draw, u = draw[over], u[over]
                    e[draw] += 1
                    hop[draw] = now = self.hop[e[draw]]
                    over = np.nonzero(now.view(np.float32)[::2] < u)[0]
            rounds.append((at, e))
            e = hop.view(np.int32)[1::2]
            go = np.nonzero(e >= 0)[0]
            if len(go) < len(e):
                at, e, mine = at[go], e[go], mine[go]
            e = e.astype(np.int64)
            step += 1
        counts = np.zeros(len(begin), np.int64)
        for at, _ in rounds:
            counts[at] += 1
        heads = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(begin) else counts
        edges = np.empty(int(counts.sum()), np.int32)
        for step, (at, e) in enumerate(rounds):
            edges[heads[at] + step] = e
        return edges, counts

    def expand(self, paths: list[np.ndarray]) -> list[np.ndarray]:
        """Piece ids of paths."""
        if not paths:
            return []
        p = self.piece[np.concatenate(paths)]
        ends = np.cumsum([len(x) for x in paths])
        odd = np.nonzero(p < 0)[0]
        if len(odd):
            spelt = [self.spelt[-1 - x] for x in p[odd].tolist()]
            width = np.ones(len(p), np.int64)
            width[odd] = [len(x) for x in spelt]
            past = np.concatenate(([0], np.cumsum(width)))
            p = np.repeat(p, width)
            p[_ranges(past[odd], width[odd])] = np.fromiter(chain.from_iterable(spelt), np.int32, int(width[odd].sum()))
            ends = past[ends]
        return np.split(p, ends[:-1])

    def encoded(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """Ids of each text's units in order."""
        if not texts:
            return []
        units = np.concatenate(texts)
        n = self.ids_count[units].astype(np.int64)
        past = np.concatenate(([0], np.cumsum(n)))
        return np.split(self.ids[_ranges(self.ids_from[units], n)], past[np.cumsum([len(t) for t in texts])][:-1])


def _cut(value: float, bound: float) -> float:
    """A Gumbel value cut off at a bound: its distribution given that it lies below."""
    return min(bound, float(-np.logaddexp(-bound, -value)))


class _Search:
    """The sets of paths of one text that are left, by their best perturbed value."""

    __slots__ = ("counts", "edges", "heap", "lattices", "logs", "seed", "weights")

    def __init__(self, lattices: Lattices, seed: int):
        self.lattices, self.seed = lattices, seed
        self.heap: list[tuple] = []
        self.edges: list[np.ndarray] = []
        self.logs: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.weights: list[float] = []

    def take(self, edges: np.ndarray, logs: np.ndarray, counts: np.ndarray, weight: float) -> int:
        """Record a path; logs: its edges' log-weights."""
        self.edges.append(edges)
        self.logs.append(logs)
        self.counts.append(counts)
        self.weights.append(weight)
        return len(self.edges) - 1

    def file(self, path: int, value: float, since: int, taken: frozenset, g: np.ndarray, best: list[int]) -> None:
        """File the sets that differ from a path at the places since + best, by their perturbed values g."""
        edges = self.edges[path]
        for b in best:
            if g[b] > -math.inf:
                place = since + b
                others = taken | {int(edges[place])} if b == 0 else frozenset((int(edges[place]),))
                heapq.heappush(self.heap, (-_cut(float(g[b]), value), path, place, others))


def file_sets(lattices: Lattices, made: list[tuple[_Search, int, float, int, frozenset]], wanted: int) -> None:
    """File the sets that new paths leave: those that follow a path up to a place and differ there.

    made: (search, path, its value, first place that its set left open, edges taken there before).
    Only the ``wanted`` best sets of a path can still be opened. A set's mass is at most the weight
    of what it shares with the path, which falls along the path, and its value lies between mass +
    _GUMBEL_LOW and mass + _GUMBEL_HIGH; so places behind the point where no set can be among the
    best are left out. Paths are looked at together, in a window of places that grows for those
    that need more.
    """
    size = 160
    todo = [m for m in made if m[3] < len(m[0].edges[m[1]])]
    while todo:
        rows, lengths = len(todo), np.array([len(s.edges[p]) - since for s, p, _, since, _ in todo])
        width = min(size, int(lengths.max()))
        edges = np.zeros((rows, width), np.int64)
        shared = np.zeros((rows, width + 1))  # past a path's end: 0
        for r, (s, p, _, since, _) in enumerate(todo):
            part = s.edges[p][since : since + width]
            edges[r, : len(part)] = part
            shared[r, 1 : len(part) + 1] = s.logs[p][since : since + width]
            if since:
                shared[r, 0] = s.logs[p][:since].sum()
        real = np.arange(width) < lengths[:, None]
        np.cumsum(shared, axis=1, out=shared)
        mass = np.where(real, shared[:, :-1] + lattices.rest[edges], -np.inf)
        for r, (_, _, _, _, taken) in enumerate(todo):
            if taken:  # at the first place other edges are taken too
                rest = [e for e in lattices.node_edges(int(edges[r, 0])) if e not in taken and e != edges[r, 0]]
                mass[r, 0] = shared[r, 0] + np.logaddexp.reduce(lattices.logq[rest]) if rest else -math.inf
        keep = min(wanted, width)
        least = np.partition(mass, width - keep, axis=1)[:, width - keep] if width >= wanted else np.full(rows, -np.inf)
        done = (lengths <= width) | (shared[:, -1] + _GUMBEL_HIGH < least + _GUMBEL_LOW)
        seeds = np.array([(s.seed ^ (0xA5A5 + 7919 * p)) % 2**64 for s, p, *_ in todo], _U)
        places = np.array([since for *_, since, _ in todo])[:, None] + np.arange(width)
        g = np.full((rows, width), -np.inf)
        row, at = np.nonzero(real & (shared[:, :-1] + _GUMBEL_HIGH >= (least + _GUMBEL_LOW)[:, None]))
        g[row, at] = mass[row, at] - np.log(-np.log(uniforms(seeds[row], places[row, at].astype(_U) + _U(1 << 40))))
        best = (np.argpartition(-g, keep - 1, axis=1)[:, :keep] if keep > 1 else g.argmax(axis=1)[:, None]).tolist()
        for r, (s, p, value, since, taken) in enumerate(todo):
            if done[r]:
                s.file(p, value, since, taken, g[r], best[r])
        todo = [m for m, d in zip(todo, done.tolist(), strict=True) if not d]
        size *= 4


def sample_batch(lattices: Lattices, numbers: list[np.ndarray], keys: list[int], k: int) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text the k best perturbed paths: (edges, log-weight, inclusion score)."""
    sizes = np.array([len(n) for n in numbers], np.int64)
    heads = np.concatenate(([0], np.cumsum(sizes)))
    units = np.concatenate(numbers) if numbers else np.empty(0, np.int32)
    key = np.repeat(np.array(keys, _U), sizes)
    ordinal = (np.arange(len(units)) - np.repeat(heads[:-1], sizes)).astype(_U)
    with np.errstate(over="ignore"):
        seeds = (key ^ (ordinal * _U(0xD6E8FEB86659FD93))) * _U(0xFF51AFD7ED558CCD)
        seeds ^= seeds >> _U(33)
    start = lattices.first[lattices.start[units]] if len(units) else np.empty(0, np.int32)
    seed_of = np.array(keys, _U)
    searches = [_Search(lattices, s) for s in keys]
    opened: list[tuple] = [(i, -math.log(-math.log(u)), None, 0, frozenset(), None, 0) for i, u in enumerate(uniforms(seed_of, 1 << 50).tolist())]
    begin = start
    for n in range(k):
        if n:
            opened, begin = [], np.full(len(units), -1, np.int32)
            for i, (s, u) in enumerate(zip(searches, uniforms(seed_of, (1 << 51) + n).tolist(), strict=True)):
                if not s.heap:
                    continue
                value, path, place, taken = heapq.heappop(s.heap)
                rest = [e for e in lattices.node_edges(int(s.edges[path][place])) if e not in taken]
                q = np.cumsum(np.exp(lattices.logq[rest] - lattices.logq[rest].max()))
                new = rest[min(int(np.searchsorted(q, u * q[-1], "right")), len(rest) - 1)]
                unit = int(np.searchsorted(np.cumsum(s.counts[path][: place + 1]), place, "right"))
                begin[heads[i] + unit + 1 : heads[i + 1]] = start[heads[i] + unit + 1 : heads[i + 1]]
                begin[heads[i] + unit] = lattices.goto[new]
                opened.append((i, -value, path, place, taken, new, unit))
        if not opened:
            break
        edges, counts = lattices.walk(begin, seeds, n)
        logs_of = lattices.logq[edges]
        ends = np.concatenate(([0], np.cumsum(counts)))
        made = []
        for i, value, path, place, taken, new, unit in opened:
            s = searches[i]
            a, b = int(ends[heads[i] + unit]), int(ends[heads[i + 1]])
            own, logs, count = edges[a:b], logs_of[a:b], counts[heads[i] + unit : heads[i + 1]]
            weight = float(logs.sum())
            if path is not None:
                before = s.logs[path][:place]
                held = s.counts[path]
                count = np.concatenate((held[:unit], [place + 1 - int(held[:unit].sum()) + int(count[0])], count[1:]))
                own = np.concatenate((s.edges[path][:place], np.array([new], np.int32), own))
                logs = np.concatenate((before, lattices.logq[new : new + 1], logs))
                weight += float(before.sum() + lattices.logq[new])
            made.append((s, s.take(own, logs, count, weight), value, place, taken))
        file_sets(lattices, made, k - n)
    out = []
    for s in searches:
        kappa = -s.heap[0][0] if s.heap else -math.inf
        out.append(
            [(e, w, 1.0 if kappa == -math.inf else -math.expm1(-math.exp(min(50.0, w - kappa)))) for e, w in zip(s.edges, s.weights, strict=True)]
        )
    return out


def _lists(values: pa.Array, parts: list) -> pa.ListArray:
    """Values as lists as long as the parts."""
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def encode(
    docs: DataFrame,
    path: str | None = None,
    samples: int = SAMPLES,
    alpha: float = ALPHA,
    seed: int = 1,
    with_ids: bool = False,
    with_sample_ids: bool = False,
) -> DataFrame:
    """docs(doc_id, text, ..) -> one row per row of docs.

    Columns: doc_id, n_pieces, ids_crc (CRC-32 of the ids as little-endian 32-bit numbers),
    round_trip (decoding gives the normalised text back), and per sample, best perturbed value
    first, sample_pieces, sample_crcs, log_weights and inclusions. ``with_ids`` adds ids,
    ``with_sample_ids`` sample_ids.
    """
    fields = [
        ("doc_id", pa.int64()), ("n_pieces", pa.int32()), ("ids_crc", pa.int64()), ("round_trip", pa.bool_()), ("sample_pieces", pa.list_(pa.int32())),
        ("sample_crcs", pa.list_(pa.int64())), ("log_weights", pa.list_(pa.float64())), ("inclusions", pa.list_(pa.float64())),
    ]
    schema = "doc_id long, n_pieces int, ids_crc long, round_trip boolean, sample_pieces array<int>, sample_crcs array<long>, log_weights array<double>, inclusions array<double>"
    if with_ids:
        fields.append(("ids", pa.list_(pa.int32())))
        schema += ", ids array<int>"
    if with_sample_ids:
        fields.append(("sample_ids", pa.list_(pa.list_(pa.int32()))))
        schema += ", sample_ids array<array<int>>"

    def make():
        where = path
        if where is None:
            import public_tokenizers

            where = public_tokenizers.path("piece_bpe_32k.model")
        lattices = Lattices(where, alpha)

        def step(batch: pa.RecordBatch):
            docs_, texts = batch.column(0), batch.column(1).to_pylist()
            numbers = lattices.numbers([lattices.normalised(t) for t in texts])
            keys = [xxhash.xxh64_intdigest(f"{i}\0{t or ''}".encode("utf-8", "surrogatepass"), seed) for i, t in zip(docs_.to_pylist(), texts, strict=True)]
            drawn = sample_batch(lattices, numbers, keys, samples)
            whole = lattices.encoded(numbers)
            flat = iter(lattices.expand([e for found in drawn for e, _, _ in found]))
            paths = [[next(flat) for _ in found] for found in drawn]
            same = [bool(lattices.same[n].all()) for n in numbers]
            crc = lambda ids: zlib.crc32(ids.tobytes())
            columns = [
                docs_, [len(x) for x in whole], [crc(x) for x in whole], same, [[len(x) for x in p] for p in paths], [[crc(x) for x in p] for p in paths],
                [[round(w, 6) for _, w, _ in found] for found in drawn], [[round(i, 6) for _, _, i in found] for found in drawn],
            ]
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=False)]
            if with_ids:
                arrays.append(_lists(pa.array(np.concatenate(whole) if whole else np.empty(0, np.int32)), whole))
            if with_sample_ids:
                every = list(chain.from_iterable(paths))
                ids = _lists(pa.array(np.concatenate(every) if every else np.empty(0, np.int32)), every)
                arrays.append(_lists(ids, paths))
            return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])

        return step

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id", "text"], schema, make, 256, BATCH_BYTES)


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids, and the ids, digests and inclusion scores of its sampled segmentations."""
    return encode(table(spark, sf_dir, "documents"), with_ids=True, with_sample_ids=True)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as ids, with the ids, digests and inclusion scores of two sampled segmentations."""
    return encode(docs, with_ids=True, with_sample_ids=True)
