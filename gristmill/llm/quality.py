"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms are words, hashed to buckets and weighted by how rare they are among the labelled
documents, trigrams of byte classes, which catch mark-up, symbols and case, and steps of
how often words repeat, follow themselves or vary in length. A truncated singular value
decomposition of a bounded labelled sample gives the space; its unit vectors are
broadcast. Every document is projected, its cosines to all of them are computed in
blocks, and the nearest vote with their labels, weighted by similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gristmill.llm.textkit import SPACED_CASED, Lexed, lex, map_texts, slices, trim
from gristmill.llm.toxicity import labelled_sample

#: Labelled documents of each label, bytes of their texts, dimensions, neighbours.
SAMPLE_DOCS, SAMPLE_BYTES, DIMENSIONS, NEIGHBOURS = 1500, 24 << 20, 48, 25
_CLASSES = 12
_STEPS = 16
#: Buckets of words, and the length of their part of a document's vector beside that of its form.
_WORDS, _WORD_SHARE = 2048, 0.5


def _byte_classes() -> np.ndarray:
    kind = np.full(256, 9, np.int16)  # other symbols
    kind[ord("a") : ord("z") + 1], kind[ord("A") : ord("Z") + 1], kind[ord("0") : ord("9") + 1] = 0, 1, 2
    kind[0x80:] = 3
    for i, group in enumerate((b" \t", b"\n\r", b".", b",;", b"|", b"!?", b"*#$%&"), 4):
        kind[list(group)] = min(i, 8) if i < 9 else 10
    kind[ord("!")], kind[ord("?")] = 11, 11
    return kind


_KIND = _byte_classes()
FORMS = _CLASSES**3 + 4 * _STEPS


def form_terms(lx: Lexed) -> np.ndarray:
    """Frequencies of trigrams and steps of each text, damped and of unit length; a text without bytes is all zero."""
    kind = _KIND[lx.raw].astype(np.int64)
    code = kind[:-2] * _CLASSES**2 + kind[1:-1] * _CLASSES + kind[2:] if len(kind) > 2 else np.zeros(0, np.int64)
    out = np.zeros((lx.n, FORMS), np.float32)
    stops = np.append(lx.base[1:] - 1, len(lx.raw) - 1)
    doc = lx.doc()
    same = np.zeros(len(doc), bool)
    same[1:] = (lx.hash[1:] == lx.hash[:-1]) & (doc[1:] == doc[:-1])
    repeated = np.bincount(doc[same], minlength=lx.n)
    distinct = np.bincount((np.unique(np.stack([doc, lx.hash.view(np.int64)], 1), axis=0)[:, 0]) if len(doc) else doc, minlength=lx.n)
    size = np.bincount(doc, weights=lx.ends - lx.starts, minlength=lx.n)
    for i in range(lx.n):
        got = code[lx.base[i] : max(lx.base[i], stops[i] - 2)]
        out[i, : _CLASSES**3] = np.bincount(got, minlength=_CLASSES**3) / max(1, len(got))
    out = np.sqrt(out)
    n = np.maximum(1, lx.counts)
    for j, x in enumerate((repeated / n, distinct / n, np.minimum(1, size / n / 40), np.minimum(1, np.log1p(lx.counts) / 12))):
        at = np.minimum(_STEPS - 1, (x * _STEPS).astype(np.int64))
        out[np.arange(lx.n), _CLASSES**3 + j * _STEPS + at] = 0.25
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(length, 1e-12)


def word_terms(lx: Lexed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, bucket and damped frequency of each distinct bucket of words of each text, by text."""
    pair, n = np.unique(lx.doc() * _WORDS + (lx.hash & np.uint64(_WORDS - 1)).astype(np.int64), return_counts=True)
    return pair // _WORDS, pair % _WORDS, 1 + np.log(n.astype(np.float32))


@dataclass
class Model:
    rarity: np.ndarray
    centre: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    marks: np.ndarray

    def project(self, lx: Lexed) -> np.ndarray:
        """Unit vectors of some texts in the space; words are summed up sparsely."""
        x = form_terms(lx) @ self.axes[:FORMS] - self.centre
        doc, bucket, weight = word_terms(lx)
        if len(doc):
            weight = weight * self.rarity[bucket]
            length = np.sqrt(np.bincount(doc, weights=weight.astype(np.float64) ** 2, minlength=lx.n)).astype(np.float32)
            first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
            parts = self.axes[FORMS:][bucket] * (_WORD_SHARE * weight / length[doc])[:, None]
            x[doc[first]] += np.add.reduceat(parts, first, axis=0)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _main_axes(terms: np.ndarray, dimensions: int, turns: int = 8) -> np.ndarray:
    """The first right singular vectors, by subspace iteration from a fixed start."""
    start = np.random.default_rng(5).standard_normal((terms.shape[1], dimensions + 16)).astype(np.float32)
    for _ in range(turns):
        start = np.linalg.qr(terms.T @ (terms @ start))[0]
    _, _, turn = np.linalg.svd(terms @ start, full_matrices=False)
    return (start @ turn.T)[:, :dimensions]


def fit(texts: pa.Array, marks: np.ndarray, dimensions: int = DIMENSIONS) -> Model:
    """Axes of the space, and the unit vectors of the labelled texts in it."""
    lexed = [lex(p.column(0), SPACED_CASED) for p in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), 0)]
    terms = np.zeros((len(texts), FORMS + _WORDS), np.float32)
    at = 0
    for lx in lexed:
        terms[at : at + lx.n, :FORMS] = form_terms(lx)
        doc, bucket, weight = word_terms(lx)
        terms[at + doc, FORMS + bucket] = weight
        at += lx.n
    rarity = (1 + np.log((1 + len(terms)) / (1 + (terms[:, FORMS:] > 0).sum(0)))).astype(np.float32)
    terms[:, FORMS:] *= rarity
    terms[:, FORMS:] *= _WORD_SHARE / np.maximum(np.linalg.norm(terms[:, FORMS:], axis=1, keepdims=True), 1e-12)
    mean = terms.mean(0) if len(terms) else np.zeros(FORMS + _WORDS, np.float32)
    terms -= mean
    axes = _main_axes(terms, dimensions)
    model = Model(rarity, mean @ axes, axes, np.zeros((0, dimensions), np.float32), marks.astype(np.float32))
    if lexed:
        model.vectors = np.concatenate([model.project(lx) for lx in lexed])
    return model


def votes(model: Model, x: np.ndarray, neighbours: int) -> np.ndarray:
    """Share of label 1 among the nearest, weighted by similarity; 1 where there is nothing to compare with.

    Cosines count to six places; of equally near ones at the end, the first of the sample vote.
    """
    if not len(model.vectors):
        return np.ones(len(x))
    k = min(neighbours, len(model.vectors))
    out = np.empty(len(x))
    for at in range(0, len(x), 256):
        near = np.round(x[at : at + 256] @ model.vectors.T, 6)
        last = np.partition(near, -k, axis=1)[:, -k, None]
        chosen, equal = near > last, near == last
        chosen |= equal & (np.cumsum(equal, axis=1) <= k - chosen.sum(1, keepdims=True))
        row, best = np.nonzero(chosen)
        weight = np.maximum(near[row, best].astype(np.float64), 1e-6) ** 4
        out[at : at + 256] = np.bincount(row, weight * model.marks[best], len(near)) / np.bincount(row, weight, len(near))
    return np.clip(out, 0, 1)


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    label: str = "quality",
    keep: tuple[str, ...] = ("doc_id",),
    sample_docs: int = SAMPLE_DOCS,
    sample_bytes: int = SAMPLE_BYTES,
    neighbours: int = NEIGHBOURS,
) -> DataFrame:
    """`keep` columns with score (0 to 1).

    Only labels outside the held-out fold are learnt from; without any, all scores are
    1. A null or empty text is compared like any other. Each row gives a row, an empty
    table an empty one; of neighbours with equal cosines the first of the sample vote.
    """
    model = fit(*labelled_sample(docs, labels, label, sample_docs, sample_bytes))
    trim()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        known = shared.value

        def kernel(column: pa.Array):
            return [pa.array(votes(known, known.project(lex(column, SPACED_CASED)), neighbours))]

        return kernel

    return map_texts(docs, make, [("score", T.DoubleType())], keep=keep)
