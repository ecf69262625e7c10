"""Secret scans with a linear-chain conditional random field.

Tokens are tagged as outside, begin or inside of a secret. Scores of a tag come from
the token's shape, fine and coarse, the shapes and the words beside it, and features of
the whole file; transitions join neighbouring tags. The field is fitted to what fixed
patterns find in a bounded sample, with windows that it tags wrongly joining the fit in
turns, and a fourth of the sample sets what each span must lead by. It is decoded by
Viterbi in every whole text. Where "outside" leads by
more than transitions, and a following "inside" that would turn to "begin", can make up
for, it holds on every best path, so the search falls apart there; the stretches between
are walked side by side.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.scan import digest, in_characters, listed, ordered, secret_spans, texts_of
from gristmill.llm.textkit import SPACED, Lexed, lex, map_texts, releasing, slices, trim

KINDS = ("assign", "access", "hex", "crf")
#: Texts that the fit uses (half with pattern matches) and bytes of them at most.
SAMPLE_DOCS, SAMPLE_BYTES = 800, 16 << 20
#: Words count that stand beside so many secrets of the sample; all others are one.
WORD_SUPPORT = 3
#: Turns in which wrongly tagged windows join the fit.
FIT_TURNS = 4
#: In the part of the sample held out: base spans that the lead may not lose, and the share of spans that must be base ones; and the leads tried.
RECALL, PRECISION = 0.95, 0.9
LEADS = (0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 5.0, 6.0, 7.0, 8.0)
_SHAPES, _COARSE, _FILES = 1 << 11, 1 << 8, 8
#: A text with none of these, in lower or upper case, is not drawn as one with a likely secret.
_HINTS = ("password", "passwd", "secret", "token", "api_key", "apikey", "akia")


def _shape_table() -> np.ndarray:
    bits = np.zeros(256, np.int64)
    bits[65:91], bits[97:123], bits[48:58] = 1, 2, 4
    bits[list(b"=:")] = 8
    bits[list(b"\"'`")] = 16
    bits[list(b"+/_-")] = 32
    bits[[c for c in range(33, 127) if not bits[c]]] = 64
    return bits


_BITS = _shape_table()


def shapes(lx: Lexed) -> np.ndarray:
    """Classes of a token's characters, and its length in eight steps times how many digits, as one number."""
    if not len(lx.starts):
        return np.zeros(0, np.int64)
    kind = _BITS[lx.raw]
    shape = np.bitwise_or.reduceat(kind, lx.starts)  # separators have no class
    size = lx.ends - lx.starts
    digits = np.concatenate(([0], np.cumsum(kind == 4)))
    many = 2 * (digits[lx.ends] - digits[lx.starts]) > size // 2
    step = np.minimum(7, np.searchsorted([4, 8, 12, 16, 20, 28, 40], size, "right"))
    return shape | step << 7 | many.astype(np.int64) << 10


def file_features(lx: Lexed, shape: np.ndarray) -> np.ndarray:
    """Whether a text has tokens with assignments, with digits and letters, or long ones: a number below 8 for each."""
    doc = lx.doc()
    out = np.zeros(lx.n, np.int64)
    for i, on in enumerate((shape & 8 > 0, (shape & 4 > 0) & (shape & 3 > 0), shape >> 7 & 7 >= 4)):
        out |= (np.bincount(doc[on], minlength=lx.n) > 0).astype(np.int64) << i
    return out


def _coarse(shape: np.ndarray) -> np.ndarray:
    """A shape without case or lesser signs: whether it has letters, digits, an assignment or quotes, mostly digits, and its length."""
    letters = (shape & 3 > 0).astype(np.int64)
    return letters | (shape >> 2 & 7) << 1 | (shape >> 7 & 15) << 4


def _beside(values: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """The values of the tokens before and after, 0 at a text's ends."""
    first, last = np.ones(len(doc), bool), np.ones(len(doc), bool)
    first[1:] = doc[1:] != doc[:-1]
    last[:-1] = first[1:]
    return [np.where(first, 0, np.roll(values, 1)), np.where(last, 0, np.roll(values, -1))]


def indices(lx: Lexed, words: np.ndarray) -> list[np.ndarray]:
    """For each token, its place in each score table: shape, coarse shape, the shapes and words before and after, file.

    `words` are the sorted hashes of those that count, numbered from 1; others are 0.
    """
    shape, doc = shapes(lx), lx.doc()
    at = np.searchsorted(words, lx.hash)
    known = at < len(words)
    known[known] = words[at[known]] == lx.hash[known]
    return [shape, _coarse(shape), *_beside(shape, doc), *_beside(np.where(known, at + 1, 0), doc), file_features(lx, shape)[doc]]


@dataclass
class Field:
    """Scores of begin and inside against outside, and of transitions (from, to) over the tags outside, begin, inside.

    `words` are the hashes that count, `lead` what a span must be better by than none.
    """

    tables: list[np.ndarray]
    moves: np.ndarray
    words: np.ndarray
    lead: float = 0.0

    def scores(self, index: list[np.ndarray]) -> np.ndarray:
        return sum(t[i] for t, i in zip(self.tables, index, strict=True))


def _silver(lx: Lexed, texts: list[bytes]) -> np.ndarray:
    """Tags from the fixed patterns; a match of a pattern covers all tokens that it touches."""
    tags = np.zeros(len(lx.starts), np.int64)
    for d, raw in enumerate(texts):
        for _, a, b in sorted(secret_spans(raw), key=lambda s: s[1]):
            at = np.arange(lx.first[d], lx.first[d + 1])
            hit = at[(lx.ends[at] > a + lx.base[d]) & (lx.starts[at] < b + lx.base[d])]
            if len(hit) and not tags[hit].any():
                tags[hit[0]], tags[hit[1:]] = 1, 2
    return tags


def _windows(lx: Lexed, size: int) -> np.ndarray:
    """The tokens of each window of `size`, by rows; windows do not cross texts, and -1 fills up the last of each."""
    n = -(-lx.counts // size)
    start = np.repeat(lx.first[:-1], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * size
    at = start[:, None] + np.arange(size)
    return np.where(at < np.repeat(lx.first[1:], n)[:, None], at, -1)


def _words(parts: list[tuple[Lexed, np.ndarray]]) -> np.ndarray:
    """Sorted hashes of the words that stand before or after WORD_SUPPORT secrets or more."""
    near = []
    for lx, gold in parts:
        doc = lx.doc()
        for value in _beside(np.arange(len(gold)) + 1, doc):
            own = value[(gold > 0) & (value > 0)] - 1
            near.append(lx.hash[own])
    words, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *near]), return_counts=True)
    return words[n >= WORD_SUPPORT]


def _untaught(words: np.ndarray) -> Field:
    """Before any evidence, a token is outside."""
    sizes = (_SHAPES, _COARSE, _SHAPES, _SHAPES, len(words) + 1, len(words) + 1, _FILES)
    field = Field([np.zeros((n, 2)) for n in sizes], np.zeros((3, 3)), words)
    field.tables[0] -= 4.0
    field.moves[0, 2] = -30.0  # inside never follows outside
    return field


def _spans(tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First tokens and ends (exclusive) of tagged stretches."""
    at = np.flatnonzero(tags == 1)
    stop = at + 1
    while (more := (stop < len(tags)) & (tags[np.minimum(stop, len(tags) - 1)] == 2)).any():
        stop = stop + more
    return at, stop


def _lead(field: Field, held: list[tuple[Lexed, np.ndarray]]) -> float:
    """The most of LEADS that still finds RECALL of the base spans found without, in texts held out; infinity if less than PRECISION of what it finds touch one.

    So what is added is about as sure as nearly all of what the patterns confirm.
    """
    best, most = np.inf, 0
    for lead in LEADS:
        field.lead = lead
        right = found = 0
        for lx, gold in held:
            at, stop = _spans(tag(field, lx))
            sure = np.concatenate(([0], np.cumsum(gold > 0)))
            found, right = found + len(at), right + int((sure[stop] > sure[at]).sum())
        most = max(most, right)
        if right < RECALL * most:
            break
        if right >= PRECISION * found:
            best = lead
    return best


def fit(sample: pa.Array, steps: int = 120, window: int = 12, decay: float = 0.3) -> Field:
    """Gradient ascent on the likelihood of windows: all around a match, one in eight of the rest by position, and those tagged wrongly so far.

    Weights are drawn to what they were before any evidence, so that what is seen once
    or twice decides nothing. Every fourth text is held out and sets the lead.
    """
    parts = []
    for part in slices(pa.RecordBatch.from_arrays([sample], names=["text"]), 0):
        for keep in (np.arange(len(part)) % 4 != 3, np.arange(len(part)) % 4 == 3):
            column = part.column(0).filter(pa.array(keep))
            lx = lex(column, SPACED)
            parts.append((lx, _silver(lx, texts_of(column))))
    taught, held = parts[::2], parts[1::2]
    field = _untaught(_words(taught))
    if not any(gold.any() for _, gold in taught):
        return field
    prior = [x.copy() for x in field.tables]
    windows = [_windows(lx, window) for lx, _ in taught]
    golds = [np.where(at < 0, 0, gold[at]) for at, (_, gold) in zip(windows, taught, strict=True) if len(at)]
    places = [np.where(at < 0, -1, x[at]) if len(at) else None for at, (lx, _) in zip(windows, taught, strict=True) for x in indices(lx, field.words)]
    n = len(field.tables)
    places = [np.concatenate([p for p in places[i::n] if p is not None]) for i in range(n)]
    gold = np.concatenate(golds)
    use = gold.any(1) | (np.arange(len(gold)) % 8 == 0)
    for turn in range(FIT_TURNS):
        _ascend(field, prior, [p[use] for p in places], gold[use], steps // 2 if turn else steps, decay)
        tags = [np.where(at < 0, 0, tag(field, lx)[at]) for at, (lx, _) in zip(windows, taught, strict=True) if len(at)]
        wrong = ((np.concatenate(tags) > 0) != (gold > 0)).any(1) & ~use
        if not wrong.any():
            break
        use |= wrong
    field.lead = _lead(field, held)
    return field


def _ascend(field: Field, prior: list[np.ndarray], index: list[np.ndarray], tags: np.ndarray, steps: int, decay: float) -> None:
    """Steps of the fit on windows of tokens' places and tags; -1 is behind a text's end, where all is outside."""
    past = index[0] < 0
    index, known = [np.maximum(i, 0) for i in index], ~past[..., None]
    right = np.eye(3)[tags]
    steps_right = np.bincount((3 * tags[:, :-1] + tags[:, 1:]).ravel(), minlength=9).reshape(3, 3)
    memory = [np.zeros_like(x) for x in (*field.tables, field.moves)]
    for _ in range(steps):
        unary = np.concatenate((np.zeros((*tags.shape, 1)), np.where(known, field.scores(index), -30.0)), 2)
        unary[:, 0, 2] = field.moves[0, 2] = -30.0
        single, double = _marginals(unary, field.moves)
        error = np.where(known, single - right, 0)[..., 1:]
        grads = [np.stack([np.bincount(i.ravel(), weights=error[..., k].ravel(), minlength=len(t)) for k in (0, 1)], 1) + decay * (t - b) for t, b, i in zip(field.tables, prior, index, strict=True)]
        grads.append(double - steps_right)
        for x, g, m in zip((*field.tables, field.moves), grads, memory, strict=True):
            m += g * g
            x -= 0.3 * g / np.sqrt(m + 1e-8)
        np.clip(field.moves, -8, 8, out=field.moves)
    field.moves[0, 2] = -30.0


def _marginals(unary: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of tags, and expected numbers of transitions, by forward and backward sums."""
    n, length, _ = unary.shape
    fore, back = np.empty_like(unary), np.zeros_like(unary)
    fore[:, 0] = unary[:, 0]
    for t in range(1, length):
        fore[:, t] = unary[:, t] + np.logaddexp.reduce(fore[:, t - 1, :, None] + moves, axis=1)
    for t in range(length - 2, -1, -1):
        back[:, t] = np.logaddexp.reduce(moves + (unary[:, t + 1] + back[:, t + 1])[:, None, :], axis=2)
    total = np.logaddexp.reduce(fore[:, -1], axis=1)
    single = np.exp(fore + back - total[:, None, None])
    double = np.zeros((3, 3))
    for t in range(1, length):
        double += np.exp(fore[:, t - 1, :, None] + moves + (unary[:, t] + back[:, t])[:, None, :] - total[:, None, None]).sum(0)
    return single, double


def viterbi(scores: np.ndarray, moves: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Best tags of stretches of tokens that outside stands before and after; tokens in none are outside. All stretches advance together."""
    tags = np.zeros(len(scores), np.int64)
    order = np.argsort(starts - ends, kind="stable")  # the longest first
    start, size = starts[order], (ends - starts)[order]
    longest = int(size[0]) if len(size) else 0
    going = np.searchsorted(-size, -np.arange(longest), "left")  # stretches of more than t tokens
    unary = np.concatenate((np.zeros((len(scores), 1)), scores), 1)
    best, links = moves[0] + unary[start], []
    for t in range(1, longest):
        n = going[t]
        step = best[:n, :, None] + moves
        links.append(step.argmax(1).astype(np.int8))
        best[:n] = step.max(1) + unary[start[:n] + t]
    now = (best + moves[:, 0]).argmax(1) if longest else tags[:0]
    for t in range(longest - 1, -1, -1):
        n = going[t]
        tags[start[:n] + t] = now[:n]
        if t:
            now[:n] = links[t - 1][np.arange(n), now[:n]]
    return tags


def _losses(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What transitions can lose at most when a token turns from begin or inside to outside: before outside or begin, and before an inside that turns to begin."""
    into = (m[:, 1:] - m[:, :1]).max(0)
    return into + (m[1:, :2] - m[0, :2]).max(1), into + m[1:, 2] - m[0, 1] + (m[2] - m[1]).max()


def tag(field: Field, lx: Lexed) -> np.ndarray:
    """Tags of all tokens; a span pays the field's lead where it begins."""
    if not len(lx.starts) or np.isinf(field.lead):
        return np.zeros(len(lx.starts), np.int64)
    return tagged(field.scores(indices(lx, field.words)) - [field.lead, 0.0], field.moves, lx.doc())


def tagged(scores: np.ndarray, moves: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Tags of the tokens of some texts, by scores of begin and inside against outside."""
    alone, ahead = _losses(moves)
    new = np.ones(len(doc) + 1, bool)
    new[1:-1] = doc[1:] != doc[:-1]
    gained = np.full(len(scores), -np.inf)  # by the next token as inside rather than begin
    gained[:-1] = np.where(new[1:-1], -np.inf, scores[1:, 1] - scores[1:, 0])
    maybe = np.maximum((scores + alone).max(1), (scores + ahead).max(1) + gained) >= -1e-9
    starts = np.flatnonzero(maybe & (new[:-1] | ~np.concatenate(([False], maybe[:-1]))))
    ends = np.flatnonzero(maybe & (new[1:] | ~np.concatenate((maybe[1:], [False])))) + 1
    return viterbi(scores, moves, starts, ends)


def _sample(docs: DataFrame, text: str, size: int, most: int) -> pa.Array:
    """Whole texts for the fit in an order drawn by hash of their content: those with a likely secret, and as many of any kind.

    Copies count once. Each kind has half the bytes; a text that does not fit is passed over, not those after it.
    """
    spark, each = docs.sparkSession, size // 2
    own = docs.select(F.col(f"`{text}`").cast("string").alias("t")).where(F.octet_length("t") > 0)
    hinted = F.lit(False)
    for hint in _HINTS:
        hinted = hinted | F.contains("t", F.lit(hint)) | F.contains("t", F.lit(hint.upper()))
    likely = hinted & F.col("t").rlike(r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]|AKIA[A-Z0-9]{14}")
    named = own.select(F.xxhash64("t").alias("h"), F.octet_length("t").alias("size"), likely.alias("likely"))

    def least(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first hashes of a partition, of either kind."""
        kept = np.zeros((0, 3), np.int64)
        for batch in batches:
            rows = np.stack([np.asarray(c, np.int64) for c in batch.columns], 1)
            kept = np.unique(np.concatenate((kept, rows)), axis=0)
            kept = kept[(np.arange(len(kept)) < each) | ((kept[:, 2] > 0) & (np.cumsum(kept[:, 2]) <= each))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in kept.T], names=["h", "size", "likely"])

    first = named.withColumn("likely", F.col("likely").cast("long")).withColumn("size", F.col("size").cast("long"))
    first = first.mapInArrow(releasing(least), "h long, size long, likely long").distinct().persist(StorageLevel.DISK_ONLY)
    chosen: set[int] = set()
    for kind in (first.where("likely = 1"), first):
        used = 0
        for row in kind.orderBy("h").limit(each).collect():
            if used + row["size"] <= most // 2:
                used += row["size"]
                chosen.add(row["h"])
    first.unpersist()
    names = spark.createDataFrame([(h,) for h in sorted(chosen)], "h long")
    texts = own.withColumn("h", F.xxhash64("t")).join(F.broadcast(names), "h").groupBy("h").agg(F.min("t").alias("t")).orderBy("h")
    return pa.array([r["t"] for r in texts.collect()], pa.string())


def scan_secrets(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """`keep` columns with found (kind, begin, end; code points), n_assign, n_access, n_hex, base_sha256 and spans.

    Base spans are those of the fixed patterns. The field adds spans of kind "crf" where
    it tags a stretch of tokens that no base span touches and that leads by what the fit
    found needed; if nothing is enough, it adds none. Null and empty texts have
    none. Each row gives a row; further columns play no part.
    """
    field = fit(_sample(docs, text, sample_docs, sample_bytes))
    trim()
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def make():
        field = shared.value

        def kernel(column: pa.Array):
            lx, texts = lex(column, SPACED), texts_of(column)
            tags = tag(field, lx)
            at, stop = _spans(tags)
            owner = np.searchsorted(lx.first, at, "right") - 1
            extra: list[list] = [[] for _ in texts]
            for d, a, b in zip(owner.tolist(), at.tolist(), stop.tolist(), strict=True):
                extra[d].append(("crf", int(lx.starts[a] - lx.base[d]), int(lx.ends[b - 1] - lx.base[d])))
            found, counts, digests, names = [], [[], [], []], [], []
            for raw, more in zip(texts, extra, strict=True):
                base = ordered(secret_spans(raw), KINDS)
                added = [s for s in more if all(s[2] <= b[1] or s[1] >= b[2] for b in base)]
                everything = ordered(base + added, KINDS)
                chars = in_characters(raw, everything)
                for n, kind in zip(counts, KINDS, strict=False):
                    n.append(sum(s[0] == kind for s in base))
                digests.append(digest(listed([s for s in chars if s[0] != "crf"])))
                names.append(listed(chars))
                found.append([{"kind": k, "begin": a, "end": b} for k, a, b in chars])
            span = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))
            return [pa.array(found, span), *[pa.array(n, pa.int64()) for n in counts], pa.array(digests, pa.string()), pa.array(names, pa.string())]

        return kernel

    kind = T.StructType([T.StructField("kind", T.StringType()), T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())])
    fields = [("found", T.ArrayType(kind)), *[(f"n_{k}", T.LongType()) for k in KINDS[:3]], ("base_sha256", T.StringType()), ("spans", T.StringType())]
    return map_texts(docs, make, fields, text=text, keep=keep)
