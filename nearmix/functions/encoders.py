"""Encoders turn texts into vectors; models come from outside, by name.

An encoder is a function of a list of texts to a float32 matrix. Registered ones are applied with
``encode`` in Arrow batches. ``hashing`` needs no model: words are hashed to signed places, which
makes equal texts equal vectors and similar texts near ones; it stands in for a model in tests.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

FEATURES = ("avg", "cls", "senttr")
SENTENCE_PREFIX = "sentence-transformers/"
Encoder = Callable[[list], np.ndarray]
_makers: dict[str, Callable[..., Encoder]] = {}


def register(name: str, maker: Callable[..., Encoder]) -> None:
    """maker(feature=..) returns an encoder; it is called once a task."""
    _makers[name] = maker


def build(name: str, feature: str = "avg") -> Encoder:
    """An encoder by name; names of sentence models imply their own feature."""
    if name.startswith(SENTENCE_PREFIX):
        feature = "senttr"
    if feature not in FEATURES:
        raise NotImplementedError(f"unknown feature {feature!r}; one of {FEATURES}")
    if name not in _makers:
        raise NotImplementedError(f"no encoder {name!r} is registered")
    return _makers[name](feature=feature)


def hashing(dim: int = 64) -> Callable[..., Encoder]:
    def maker(feature: str = "avg") -> Encoder:
        def run(texts: list) -> np.ndarray:
            out = np.zeros((len(texts), dim), np.float32)
            for i, text in enumerate(texts):
                for w in (text or "").lower().split():
                    h = xxhash.xxh64_intdigest(w)
                    out[i, h % dim] += 1 if h >> 63 else -1
            return out

        return run

    return maker


register("hashing", hashing())


def encode(text: Column | str, name: str = "hashing", feature: str = "avg") -> Column:
    build(name, feature)
    makers = dict(_makers)

    @F.pandas_udf("array<float>")
    def run(batches: pd.Series) -> pd.Series:
        encoder = makers[name](feature="senttr" if name.startswith(SENTENCE_PREFIX) else feature)
        return pd.Series(list(encoder(batches.tolist())))

    return run(text)
