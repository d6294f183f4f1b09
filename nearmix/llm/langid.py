"""Language identification with hyperdimensional profiles.

Every letter class has a random vector of +-1. An n-gram (three letters, words bounded by a
blank) is bound into one vector by multiplying the letters' vectors, each permuted by its place
(a rotation by the place). A document's profile bundles (adds) the vectors of all its n-grams,
repeats included; a language's prototype bundles the unit profiles of its training rows. The
language is that of the prototype with the largest cosine.

The bundle is computed from n-gram counts, so the cost of a text is one pass over its letters
and one product of (letter pairs met x letter classes) with the letter vectors.

Learning: prototypes are sums, so they are learnt in one distributed pass over at most
``per_language`` rows of each language (in expectation; rows are drawn by a hash of the id), of
the folds that may be learnt from. Prediction uses the text alone, whole.

Defined results: a null text or one without a letter is ``und`` with score 0; ties go to the
language first in order; without any learnable row every document is ``und``; repeated rows give
repeated result rows; a row with a null doc_id is scored, is not held out and isn't learnt from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmix.llm.common import held_out, learnable, map_texts, table

DIMENSIONS = 1024
#: Training rows of a language, in expectation.
PER_LANGUAGE = 1500
#: Letter classes: blank, a-z, and 37 classes that all other letters are dealt to.
CLASSES = 64
_LETTERS = regex.compile(r"\p{L}+")
_PARTS = 16


def letter_vectors(dimensions: int = DIMENSIONS, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 2, (CLASSES, dimensions)) * 2 - 1).astype(np.float32)


class Encoder:
    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 7):
        self.dimensions = dimensions
        self.third = letter_vectors(dimensions, seed)
        second, first = np.roll(self.third, 1, axis=1), np.roll(self.third, 2, axis=1)
        self.pairs = (first[:, None, :] * second[None, :, :]).reshape(CLASSES * CLASSES, dimensions)
        table_ = np.zeros(0x3000, np.int64)
        for c in range(0x3000):
            table_[c] = self._class(c)
        self.table = table_

    @staticmethod
    def _class(code: int) -> int:
        if 97 <= code <= 122:
            return code - 96
        return 0 if code == 32 else 27 + code % 37

    def classes(self, text: str | None) -> np.ndarray | None:
        """Letter classes of a text: words in lower case between blanks; None if there is no letter."""
        words = _LETTERS.findall((text or "").lower())
        if not words:
            return None
        codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        if codes.max() >= len(self.table):
            return np.where(codes < len(self.table), self.table[np.minimum(codes, len(self.table) - 1)], 27 + codes % 37)
        return self.table[codes]

    def profile(self, text: str | None) -> np.ndarray | None:
        """The bundle of all n-grams of the whole text, or None if it has no letter."""
        c = self.classes(text)
        return None if c is None else self.bundle(c)

    def bundle(self, c: np.ndarray) -> np.ndarray:
        """The sum of the n-gram vectors of a text's letter classes."""
        pair, last = c[:-2] * CLASSES + c[1:-1], c[2:]
        met, place = np.unique(pair, return_inverse=True)
        counts = np.bincount(place * CLASSES + last, minlength=len(met) * CLASSES).reshape(len(met), CLASSES).astype(np.float32)
        used = np.unique(last)
        return np.einsum("rd,rd->d", counts[:, used] @ self.third[used], self.pairs[met])


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, dimensions: int = DIMENSIONS, seed: int = 7) -> tuple[list[str], np.ndarray]:
    """Languages in order and their unit prototypes."""
    rows = docs.where(learnable() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [], np.zeros((0, dimensions), np.float32)
    spark = docs.sparkSession
    shares = spark.createDataFrame([(k, min(1.0, per_language / n)) for k, n in sizes.items()], "lang string, share double")
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("share") * (1 << 20)
    sample = rows.select("doc_id", "lang", "text").join(F.broadcast(shares), "lang").where(drawn).select("lang", "text")

    def add_up(batches):
        encoder = Encoder(dimensions, seed)
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                p = encoder.profile(text)
                if p is not None and (norm := float(np.linalg.norm(p))):
                    sums[lang] = sums.get(lang, 0) + p.astype(np.float64) / norm
        names = sorted(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([sums[k].tolist() for k in names], pa.list_(pa.float64()))], names=["lang", "sums"]
        )

    # At most _PARTS vectors a language reach the driver.
    parts = sample.repartition(_PARTS).mapInArrow(add_up, "lang string, sums array<double>").collect()
    total: dict[str, np.ndarray] = {}
    for r in parts:
        total[r["lang"]] = total.get(r["lang"], 0) + np.array(r["sums"])
    langs = sorted(k for k in total if np.linalg.norm(total[k]))
    if not langs:
        return [], np.zeros((0, dimensions), np.float32)
    # Rounded, so that the order in which parts arrive doesn't show.
    return langs, np.stack([np.round(total[k] / np.linalg.norm(total[k]), 9) for k in langs]).astype(np.float32)


def predictor(langs: list[str], prototypes: np.ndarray, dimensions: int = DIMENSIONS, seed: int = 7):
    """texts -> (languages, cosines clipped to 0..1)."""
    encoder = Encoder(dimensions, seed)

    def predict(texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for text in texts:
            p = encoder.profile(text) if langs else None
            norm = float(np.linalg.norm(p)) if p is not None else 0.0
            if not norm:
                names.append("und")
                scores.append(0.0)
                continue
            cosine = prototypes @ p / norm
            best = int(np.argmax(cosine))
            names.append(langs[best])
            scores.append(min(1.0, max(0.0, round(float(cosine[best]), 6))))
        return names, scores

    return predict


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE, dimensions: int = DIMENSIONS, seed: int = 7) -> DataFrame:
    """docs(doc_id, text, lang, ..) -> (doc_id, held_out, lang_pred, score), one row per row of docs."""
    langs, prototypes = train(docs, per_language, dimensions, seed)

    def make():
        predict = predictor(langs, prototypes, dimensions, seed)

        def step(batch: pa.RecordBatch):
            names, scores = predict(batch.column(2).to_pylist())
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return map_texts(rows, ["doc_id", "held_out", "text"], "doc_id long, held_out boolean, lang_pred string, score double", make)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def speaks(encoder: Encoder, prototypes: np.ndarray, text: str | None, least: float = 0.3, half: float = 200.0) -> bool:
    """Whether a text's best cosine is as high as text in a known language must reach at its number of unlike n-grams.

    That number is m = n^2 / sum of squared counts, which the profile's own norm tells: n equal
    n-grams count as one, n unlike ones as n. The bar is least * m / (m + half), less the noise that
    random vectors of so many dimensions leave, 1 / sqrt(dimensions). It grows smoothly from below
    zero, where a few words can't tell a language, to ``least`` for any amount of text.
    """
    c = encoder.classes(text)
    if c is None or not len(prototypes):
        return False
    p = encoder.bundle(c)
    norm = float(np.linalg.norm(p))
    if not norm:
        return False
    unlike = (len(c) - 2) ** 2 * encoder.dimensions / norm**2
    return float((prototypes @ p).max()) / norm >= least * unlike / (unlike + half) - encoder.dimensions**-0.5


def langid_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.3, half: float = 200.0) -> DataFrame:
    """Drop documents that are no text in a known language: those without a letter (``und``), and those that ``speaks`` denies."""
    langs, prototypes = train(docs)
    at = docs.columns.index("text")

    def make():
        encoder = Encoder()

        def step(batch: pa.RecordBatch):
            keep = [speaks(encoder, prototypes, text, least, half) for text in batch.column(at).to_pylist()]
            return batch.filter(pa.array(keep, pa.bool_()))

        return step

    return map_texts(docs, docs.columns, docs.schema, make)
