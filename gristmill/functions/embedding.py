"""Vectors of texts: a surface for models that are loaded once in a worker, and a hashing embedder that needs none.

A model is a function without arguments that loads it and returns a function from a list
of texts to as many vectors. It is called in each worker once for all batches of a task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Model = Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]]
#: Texts that a model gets at once, and the length of vectors.
BATCH, DIMENSION = 64, 1024
_WORD = re.compile(r"[一-鿿]|[^\W_]+")


def hashing(dimension: int = DIMENSION) -> Model:
    """Words, Han characters and their pairs, hashed to signed places; the same text gives the same vector everywhere."""

    def load():
        def embed(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dimension))
            for i, text in enumerate(texts):
                words = _WORD.findall(text.lower())
                for w in [*words, *map(" ".join, zip(words, words[1:], strict=False))]:
                    h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                    out[i, h % dimension] += 1 if h >> 63 else -1
            return out

        return embed

    return load


def embed(text: Column, model: Model | None = None, dimension: int = DIMENSION, batch: int = BATCH) -> Column:
    """The unit vector of each text (of an empty or null one, what the model gives for an empty text; zeros stay zeros).

    An error if the model gives vectors of another length or number.
    """
    load = model or hashing(dimension)

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vectors = load()
        for part in parts:
            texts, out = part.fillna("").tolist(), []
            for at in range(0, len(texts), batch):
                some = texts[at : at + batch]
                got = np.asarray(vectors(some), np.float64)
                if got.shape != (len(some), dimension):
                    raise ValueError(f"the model gave {got.shape} for {len(some)} texts of dimension {dimension}")
                out += list(got / np.maximum(np.linalg.norm(got, axis=1, keepdims=True), 1e-12))
            yield pd.Series(out, dtype=object)

    return run(text)


def rerank_score(query: Column, text: Column, model: Callable[[], Callable[[list[tuple[str, str]]], Sequence[float]]], batch: int = BATCH) -> Column:
    """A score of each pair of query and text by a model that is loaded once in a worker; for `retrieval.rerank`."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        scores = model()
        for queries, texts in parts:
            pairs, out = list(zip(queries.fillna(""), texts.fillna(""), strict=True)), []
            for at in range(0, len(pairs), batch):
                some = pairs[at : at + batch]
                got = [float(x) for x in scores(some)]
                if len(got) != len(some):
                    raise ValueError(f"the model gave {len(got)} scores for {len(some)} pairs")
                out += got
            yield pd.Series(out, dtype="float64")

    return run(query, text)
