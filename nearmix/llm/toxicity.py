"""Toxicity by compression distance: two zstandard dictionaries, one of ordinary and one of toxic text.

The ordinary dictionary is trained by the library's cover algorithm on windows of ordinary
documents. The toxic dictionary is that content plus segments of toxic documents, picked as a
cover algorithm picks them - by how many bytes they save over how many occurrences, greedily, each
choice discounting what earlier ones cover - but with contrast: only segments that ordinary
documents hold RATIO times more rarely. A segment needs support by documents and by the words
before it, so neither one long document nor copies of a document make one. With the ordinary part shared and of equal place, the two lengths of a
window differ only where toxic segments save bytes. A pair of dictionaries that the library trains on the
two classes by itself separates them much worse (the README has the figures of both).

A whole text is read as windows of WINDOW words; each window is compressed with either dictionary,
and the saved bytes of the windows make a document's features: the largest saving, shares and
numbers of windows that save at least so much, and the number of windows. Their logistic regression, fitted on
labelled documents that the dictionaries haven't seen and weighted to the labels' own rate of
toxic rows, is the calibrated score.

Learning uses a bounded sample of the labelled rows, whose bounds are parameters: ``toxic`` +
``ordinary`` rows drawn by a hash of the id, with texts of at most ``longest`` characters; the
base of the dictionaries is trained on at most ``base_windows`` of the sample's windows, evenly
spread. The held-out fold is never learnt from. Prediction uses the text alone, whole.

Defined results: null and empty texts have no window and get the score of no saving; without
labels of both kinds every score is 0; repeated rows give repeated result rows; a null doc_id is
scored, not held out and not learnt from; of several labels of an id the largest counts, of its
several texts the smallest.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmix.llm.common import held_out, learnable, map_texts, table

TOXIC, ORDINARY = 1200, 3000
LONGEST = 100_000
BASE_WINDOWS = 8000
WINDOW = 16
#: A toxic segment is so many times as frequent in toxic documents as in ordinary ones, and in this share and number of them.
RATIO = 5
SHARE, LEAST = 0.03, 6
CONTEXTS = 4096
BASE_BYTES = 32_768
THRESHOLD = 0.3
_SHORT, _LONG = 4, 10


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(0, len(words), size)]


def _stems(word: str) -> set[str]:
    w = f" {word} "
    return {w[i : i + n] for n in range(_SHORT, _LONG + 1) for i in range(len(w) + 1 - n)}


def toxic_segments(toxic: list[str], ordinary: list[str]) -> list[str]:
    """Segments of toxic documents that save most and that ordinary documents hold RATIO times more rarely.

    The support of a segment is the number of documents that hold it or of words that precede it,
    whichever is smaller: one long document counts once by the first, copies by the second. Both
    are sets as bits, preceding words dealt to CONTEXTS bits by their hashes.
    """
    least = max(LEAST, math.ceil(SHARE * len(toxic)))
    docs: dict[str, int] = defaultdict(int)
    contexts: dict[str, int] = defaultdict(int)
    for i, text in enumerate(toxic):
        before = ""
        for w in text.lower().split():
            docs[w] |= 1 << i
            contexts[w] |= 1 << zlib.crc32(before.encode("utf-8", "surrogatepass")) % CONTEXTS
            before = w
    ordinary_words: Counter = Counter()
    for text in ordinary:
        ordinary_words.update(set(text.lower().split()))
    scale = RATIO * len(toxic) / max(len(ordinary), 1)
    rare = {w for w, d in docs.items() if d.bit_count() > scale * ordinary_words[w]}
    held: dict[str, list[str]] = defaultdict(list)
    for w in rare:
        for s in _stems(w):
            held[s].append(w)

    def support(words) -> int:
        d = c = 0
        for w in words:
            d |= docs[w]
            c |= contexts[w]
        return min(d.bit_count(), c.bit_count())

    supported = {s: n for s, ws in held.items() if (n := support(ws)) >= least}
    common: Counter = Counter()
    for w, n in ordinary_words.items():
        for s in _stems(w):
            if s in supported:
                common[s] += n
    weights = {s: n for s, n in supported.items() if n > scale * common[s]}
    gone: set[str] = set()
    kept: list[str] = []
    while weights:
        value, best = max(((n * (len(s) - 2.5), s) for s, n in weights.items() if n >= least), default=(0, ""))
        if not value:
            break
        kept.append(best)
        new = set(held[best]) - gone
        gone |= new
        for s in {s for w in new for s in _stems(w) if s in weights}:
            weights[s] = support(w for w in held[s] if w not in gone)
    return kept


def dictionaries(toxic: list[str], ordinary: list[str], base_windows: int = BASE_WINDOWS) -> tuple[bytes, bytes]:
    """Contents of the toxic and the ordinary dictionary, of equal length."""
    samples = [w for t in ordinary for w in windows(t)]
    samples = samples[:: max(1, -(-len(samples) // base_windows))]
    try:
        base = zstandard.train_dictionary(BASE_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: they are the dictionary
        base = b"".join(samples)[:BASE_BYTES]
    segments = "".join(s + "\0" for s in reversed(toxic_segments(toxic, ordinary))).encode("utf-8", "surrogatepass")
    return base + b"\0" + segments, base + b"\0" + b"\0" * len(segments)


class Scorer:
    """Features of texts under two dictionaries, and the fitted score."""

    def __init__(self, toxic: bytes, ordinary: bytes, weights: list[float] | None = None):
        self.toxic, self.ordinary, self.weights = toxic, ordinary, weights
        self.compress = [self._compressor(x) for x in (ordinary, toxic)]

    def __reduce__(self):
        return Scorer, (self.toxic, self.ordinary, self.weights)

    @staticmethod
    def _compressor(content: bytes):
        words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters(
            window_log=17, hash_log=15, chain_log=15, search_log=3, min_match=4, strategy=zstandard.STRATEGY_GREEDY,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        return zstandard.ZstdCompressor(dict_data=words, compression_params=how).compress

    def features(self, text: str | None) -> tuple[float, ...]:
        """The largest saving, shares and numbers of windows by what they save, and how many windows there are."""
        plain, toxic = self.compress
        saved = [len(plain(w)) - len(toxic(w)) for w in windows(text)]
        n = max(len(saved), 1)
        above = lambda least: sum(s >= least for s in saved)
        most = max(0.0, min(float(max(saved, default=0)), 16.0))
        return most / 4, above(2) / n, above(3) / n, math.log1p(above(3)), math.log1p(above(5)), math.log(n) / 3

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return 0.0
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], self.features(text), strict=True))
        return round(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), 6)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> list[float]:
    """Newton's method with a small ridge; the intercept comes first and is free."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    penalty = np.diag([1e-9] + [ridge] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (weight * (p - y)) + penalty @ w
        hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + penalty + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


def train(
    docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, ordinary: int = ORDINARY, longest: int = LONGEST, base_windows: int = BASE_WINDOWS
) -> Scorer:
    """Learn dictionaries and score from a bounded sample of the labelled rows outside the held-out fold."""
    marked = labels.where(learnable() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    none = Scorer(b"", b"")
    if not sizes.get(0) or not sizes.get(1):
        return none
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    drawn = marked.where("toxic = 1").orderBy(*order).limit(toxic).unionByName(marked.where("toxic = 0").orderBy(*order).limit(ordinary))
    texts = docs.where(F.col("text").isNotNull() & (F.length("text") <= longest)).select("doc_id", "text")
    rows = texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    kinds = {k: [r["text"] for r in rows if r["toxic"] == k] for k in (0, 1)}
    if not kinds[0] or not kinds[1]:
        return none
    # Two of three go to the dictionaries, the third calibrates.
    own = {k: [t for i, t in enumerate(v) if i % 3] or v for k, v in kinds.items()}
    rest = {k: v[::3] for k, v in kinds.items()}
    scorer = Scorer(*dictionaries(own[1], own[0], base_windows))
    x = np.array([scorer.features(t) for k in (0, 1) for t in rest[k]])
    y = np.array([k for k in (0, 1) for _ in rest[k]], float)
    rate = sizes[1] / (sizes[0] + sizes[1])
    weight = np.where(y == 1, rate / len(rest[1]), (1 - rate) / len(rest[0])) * len(y)
    return Scorer(scorer.toxic, scorer.ordinary, logistic(x, y, weight))


def toxicity(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, toxic: int = TOXIC, ordinary: int = ORDINARY, longest: int = LONGEST, base_windows: int = BASE_WINDOWS
) -> DataFrame:
    """docs(doc_id, text, ..), labels(doc_id, toxic, ..) -> (doc_id, held_out, score, predicted)."""
    scorer = train(docs, labels, toxic, ordinary, longest, base_windows)

    def make():
        def step(batch: pa.RecordBatch):
            scores = [scorer.score(t) for t in batch.column(2).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    scored = map_texts(rows, ["doc_id", "held_out", "text"], "doc_id long, held_out boolean, score double", make)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
