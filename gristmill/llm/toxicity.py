"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence gets a logistic score from its words
and their beginnings; the document's score is the noisy-or of them. Weights are fitted
to document labels through the noisy-or on a bounded sample, so that the model learns
by itself which sentences of a toxic document offend. Scoring finds those sentences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.textkit import ALNUM, SLICE_BYTES, Lexed, char_offsets, lex, map_texts, slices, trim

#: Documents of each label that the fit uses, and bytes of their texts at most.
SAMPLE_DOCS = 1000
SAMPLE_BYTES = 24 << 20
#: Features: least number of toxic documents, least log-odds, most in all.
_LEAST_DOCS, _LEAST_ODDS, _MOST = 5, 1.5, 50_000
_PREFIXES = (3, 4, 5, 6)
_PLACE_BITS = 23
_ENDS = np.isin(np.arange(256), [0, *b".!?\n"])


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; a null id counts as empty text, whose crc32 is 0."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, most_bytes: int) -> tuple[pa.Array, np.ndarray]:
    """Whole texts and labels of a bounded sample of labelled documents outside the held-out fold, in an order drawn by hash.

    Each label has half the bytes; a text that doesn't fit is passed over, not those after
    it. A doc_id of several rows counts once, with the shortest of its texts.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).alias("label")).distinct()
    drawn = [r for y in (0, 1) for r in ids.where(F.col("label") == y).orderBy(F.xxhash64(F.col("doc_id"), F.lit(y)), "doc_id").limit(per_class).collect()]
    small = docs.sparkSession.createDataFrame([(r["doc_id"], int(r["label"])) for r in drawn], "doc_id long, label int")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("size", F.octet_length("text"))
    sizes = rows.join(F.broadcast(small), "doc_id").groupBy("doc_id", "label").agg(F.min("size").alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").collect()
    fitting, used = [], [0, 0]
    for r in sizes:
        if used[r["label"]] + r["size"] <= most_bytes // 2:
            used[r["label"]] += r["size"]
            fitting.append(tuple(r))
    fit_in = docs.sparkSession.createDataFrame(fitting, "doc_id long, label int, size int")
    least = rows.join(F.broadcast(fit_in), ["doc_id", "size"]).groupBy("doc_id", "label").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id", "label")
    texts, marks = [], []
    for r in least.toLocalIterator():
        texts.append(r["text"])
        marks.append(r["label"])
    return pa.array(texts, pa.string()), np.array(marks, np.int64)


def _features(lx: Lexed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words and of their beginnings, the word of each, and the sentence of each word."""
    sentence = np.cumsum(_ENDS[lx.raw])[lx.starts] if len(lx.starts) else np.zeros(0, np.int64)
    word = np.arange(len(lx.starts))
    parts, owner = [lx.hash], [word]
    for k in _PREFIXES:
        long = lx.prefix[k] != 0
        parts.append(lx.prefix[k][long])
        owner.append(word[long])
    return np.concatenate(parts), np.concatenate(owner), sentence


@dataclass
class Model:
    vocabulary: np.ndarray
    weights: np.ndarray
    bias: float


def _lexed(texts: pa.Array) -> Iterator[Lexed]:
    for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), 0):
        yield lex(part.column(0), ALNUM, _PREFIXES)


def _odds(toxic: np.ndarray, with_it: np.ndarray, marks: np.ndarray) -> np.ndarray:
    n1 = marks.sum()
    return np.log((toxic + 0.5) / (n1 + 1)) - np.log((with_it - toxic + 0.5) / (len(marks) - n1 + 1))


def _likely_places(texts: pa.Array, marks: np.ndarray) -> np.ndarray:
    """Of the places that hashes have by their top bits, those whose features occur more in toxic documents.

    The tables have a fixed size. A feature that shares its place with a common one can
    be lost, one in a few thousand of a sample's.
    """
    with_it, toxic = np.zeros((2, 1 << _PLACE_BITS), np.int32)
    at = 0
    for lx in _lexed(texts):
        f, w, _ = _features(lx)
        pair = np.unique((lx.doc()[w] << _PLACE_BITS) | (f >> np.uint64(64 - _PLACE_BITS)).astype(np.int64))
        place, mark = pair & ((1 << _PLACE_BITS) - 1), marks[at + (pair >> _PLACE_BITS)]
        for table, of in ((with_it, place), (toxic, place[mark == 1])):
            found, n = np.unique(of, return_counts=True)
            table[found] += n.astype(np.int32)
        at += lx.n
    often = np.flatnonzero(toxic >= _LEAST_DOCS)
    out = np.zeros(1 << _PLACE_BITS, bool)
    out[often[_odds(toxic[often], with_it[often], marks) >= _LEAST_ODDS]] = True
    return out


def fit(texts: pa.Array, marks: np.ndarray, steps: int = 300, decay: float = 1e-3) -> Model:
    """Weights by Adam on the noisy-or likelihood; without both labels, or a word that tells them apart, scores close to 0.

    Texts are read twice in slices, so that memory holds what the model may use and
    tables of fixed size, not all features of the sample.
    """
    rate = float(marks.mean()) if len(marks) else 0.0
    if not 0 < rate < 1:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -12.0)
    likely = _likely_places(texts, marks)
    feature, doc, sentence, sentences = [], [], [], np.zeros(len(marks), np.int64)
    at = base = 0
    for lx in _lexed(texts):
        f, w, s = _features(lx)
        d = lx.doc()
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
        sentences[at : at + lx.n] = np.bincount(d[new], minlength=lx.n)
        kept = likely[(f >> np.uint64(64 - _PLACE_BITS)).astype(np.int64)]
        feature.append(f[kept])
        doc.append(d[w[kept]] + at)
        sentence.append(s[w[kept]] + base)
        at, base = at + lx.n, base + (int(s[-1]) + 1 if len(s) else 0) + 1
    feature, doc, sentence = np.concatenate(feature), np.concatenate(doc), np.concatenate(sentence)
    names, index = np.unique(feature, return_inverse=True)
    pair = np.unique(index.astype(np.int64) * len(marks) + doc)
    with_it, toxic = np.bincount(pair // len(marks), minlength=len(names)), np.bincount(pair // len(marks), weights=marks[pair % len(marks)], minlength=len(names))
    odds = _odds(toxic, with_it, marks)
    chosen = np.flatnonzero((toxic >= _LEAST_DOCS) & (odds >= _LEAST_ODDS))
    chosen = np.sort(chosen[np.argsort(-odds[chosen] * np.sqrt(toxic[chosen]), kind="stable")[:_MOST]])
    if not len(chosen):
        return Model(np.zeros(0, np.uint64), np.zeros(0), -12.0)
    place = np.full(len(names), -1)
    place[chosen] = np.arange(len(chosen))
    kept = place[index] >= 0
    pair = np.unique(sentence[kept].astype(np.int64) * len(chosen) + place[index[kept]])  # once in a sentence
    col = pair % max(1, len(chosen))
    sid, row = np.unique(pair // max(1, len(chosen)), return_inverse=True)
    of = dict(zip(sentence[kept].tolist(), doc[kept].tolist(), strict=True))
    owner = np.array([of[s] for s in sid.tolist()], np.int64)
    rest = sentences - np.bincount(owner, minlength=len(marks))
    w, b = np.zeros(len(chosen)), -6.0
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, steps + 1):
        z = b + np.bincount(row, weights=w[col], minlength=len(sid))
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-b))
        clean = np.bincount(owner, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(marks)) + rest * np.log1p(-p0)
        whole = np.maximum(-np.expm1(clean), 1e-9)
        pull = np.where(marks == 1, -(1 - whole) / whole, 1.0)  # of each sentence, times its score
        g = pull[owner] * p
        grad = np.append(np.bincount(col, weights=g[row], minlength=len(chosen)) / len(marks) + decay * w, (g.sum() + (pull * rest * p0).sum()) / len(marks))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], min(-3.0, b - move[-1])
    return Model(names[chosen], w, float(b))


def _kernel(model: Model):
    marks = np.zeros(1 << 16, bool)  # most features are none of the model's
    marks[(model.vocabulary >> np.uint64(48)).astype(np.int64)] = True

    def kernel(column: pa.Array):
        lx = lex(column, ALNUM, _PREFIXES)
        f, w, s = _features(lx)
        d = lx.doc()
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
        sentences = np.bincount(d[new], minlength=lx.n)
        likely = np.flatnonzero(marks[(f >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(model.vocabulary, f[likely]), max(0, len(model.vocabulary) - 1))
        hit = likely[model.vocabulary[at] == f[likely]] if len(model.vocabulary) else likely[:0]
        col = np.searchsorted(model.vocabulary, f[hit])
        pair, first = np.unique(s[w[hit]].astype(np.int64) * max(1, len(model.vocabulary)) + col, return_index=True)
        sid, head, row = np.unique(s[w[hit]][first], return_index=True, return_inverse=True)
        owner = d[w[hit]][first][head]
        z = model.bias + np.bincount(row, weights=model.weights[pair % max(1, len(model.vocabulary))], minlength=len(sid))
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-model.bias))
        clean = np.bincount(owner, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=lx.n) + (sentences - np.bincount(owner, minlength=lx.n)) * np.log1p(-p0)
        found: list[list[dict]] = [[] for _ in range(lx.n)]
        if (p >= 0.5).any():
            stops = np.flatnonzero(_ENDS[lx.raw])
            for i in np.flatnonzero(p >= 0.5).tolist():
                doc, begin = int(owner[i]), int(stops[sid[i] - 1]) + 1
                end = int(stops[sid[i]]) if sid[i] < len(stops) else len(lx.raw) - 1
                base = int(lx.base[doc])
                stop = int(lx.base[doc + 1]) - 1 if doc + 1 < lx.n else len(lx.raw) - 1
                a, b = char_offsets(lx.raw[base:stop], [begin - base, min(end, stop) - base]).tolist()
                found[doc].append({"begin": a, "end": b, "score": float(p[i])})
        span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        return [pa.array(-np.expm1(clean)), pa.array(sentences, pa.int64()), pa.array(found, span)]

    return kernel


_FIELDS = [
    ("score", T.DoubleType()),
    ("n_sentences", T.LongType()),
    ("offending", T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))),
]


def score_toxicity(
    docs: DataFrame, labels: DataFrame, *, label: str = "toxic", keep: tuple[str, ...] = ("doc_id",), sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES
) -> DataFrame:
    """`keep` columns with score (0 to 1), n_sentences and offending (code points, end exclusive, and score).

    docs: doc_id, text; labels: doc_id and a 0/1 column, others and nulls are ignored.
    Only ids outside the held-out fold are learnt from. Without labels of both kinds all
    scores are close to 0. Null, empty and wordless texts score 0. Each row gives a row.
    """
    model = fit(*labelled_sample(docs, labels, label, sample_docs, sample_bytes))
    trim()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, lambda: _kernel(shared.value), _FIELDS, keep=keep, limit=SLICE_BYTES)
