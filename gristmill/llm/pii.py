"""Personal data by bootstrapped contextual extraction.

Fixed patterns give seed entities, each of them whole. What stands around them are
lexical patterns: the words before and after, numbers among them as a class, with the
entity's shape; coarse ones take its class alone and need more evidence. Patterns and
instances (values in context) form a graph that Spark counts over the whole corpus and
scores in turns: a pattern by the trusted share of what it extracts, an instance by the
best sure pattern that extracts it. Other values with digits or at signs in the context
of a sure pattern are new finds; numbers written in several groups are one value.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.scan import digest, in_characters, listed, ordered, personal_spans, texts_of
from gristmill.llm.textkit import SPACED, ensure_checkpoint_dir, lex, map_texts, releasing, slices, small_batches

KINDS = ("email", "ip", "card", "phone", "found")
#: A pattern is sure from this score on and so many distinct trusted instances.
SURE, SUPPORT = 0.8, 5
#: The same for patterns that look at the class of a value alone, not at its shape.
COARSE_SURE, COARSE_SUPPORT = 0.9, 20
_MARK = "\u0001"
#: Turns of scoring at least; more follow until the sure patterns stay the same, and an error beyond the most.
TURNS, MOST_TURNS = 3, 100
#: Sure patterns that are broadcast; beyond, finds come by a join.
BROADCAST_PATTERNS = 200_000
_KEY, _FINDS = "\u0001key", "\u0001finds"
_CLASS = bytes(57 if 48 <= c <= 57 else 97 if c >= 0x80 or chr(c).isalpha() else c for c in range(256))
_RUN = re.compile(rb"(.)\1+", re.DOTALL)
_DIGITS = np.isin(np.arange(256), list(b"0123456789@"))
_NUMBER = re.compile(rb"[0-9().+-]*[0-9)]")
_NUMBERS, _LETTERS = re.compile(rb"[0-9]"), re.compile(rb"[A-Za-z\x80-\xff]")
_EDGE = ".,;:!?\"'()"


def _shape(token: bytes) -> str:
    """Characters by class, runs shortened: 9 for digits, a for letters, others as they are; of a long shape, the beginning and a hash."""
    return _short(_RUN.sub(rb"\1", token.strip(b".,;:!?\"'()[]{}").translate(_CLASS)).decode())


def _short(value: str) -> str:
    """A value of up to 64 characters as it is, of a longer one the beginning and a hash."""
    return value if len(value) <= 64 else f"{value[:32]}\u0001{hashlib.sha256(value.encode()).hexdigest()}"


def _neighbour(token: bytes) -> str:
    """A word beside a value: without case and signs at its edges; a number by its shape."""
    if _NUMBERS.search(token) and not _LETTERS.search(token):
        return _shape(token)
    word = token.decode("utf-8", "replace").replace(_MARK, "")
    return _short(word.strip(_EDGE).lower() or word)


def _patterns(before: list[str], after: str, value: bytes) -> list[str]:
    """Contexts of a value: one word or two and its shape, and the coarse ones; `before` is the word before and the one before that."""
    shape, (last, earlier) = _shape(value), before
    kind = "@" if b"@" in value else "a9" if _LETTERS.search(value) else "9"
    fine = [f"{last} _ |{shape}", f"_ {after} |{shape}", f"{last} _ {after} |{shape}", f"{earlier}{_MARK}{last} _ |{shape}"]
    return [*fine, *[f"{_MARK}{c} |{kind}" for c in (f"{last} _", f"_ {after}", f"{last} _ {after}", f"{earlier}{_MARK}{last} _")]]


def _entities(raw: bytes, base: list[tuple[str, int, int]], starts: np.ndarray, ends: np.ndarray, like: list[int]) -> list[tuple[str, int, int, int, int]]:
    """Kind ("" for none), begin and end in bytes, first word and the one behind the last: base spans, and other runs of identifier-like words.

    `like` are the numbers of words with a digit or at sign. Words that a base span touches are part of no other value.
    """
    out, covered = [], set()
    for kind, a, b in base:
        lo, hi = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left"))
        covered.update(range(lo, hi))
        out.append((kind, a, b, lo, hi))
    runs: list[list[int]] = []
    for i in like:
        if i in covered:
            continue
        word = raw[starts[i] : ends[i]]
        joins = runs and runs[-1][1] == i and raw[ends[i - 1] : starts[i]] == b" " and _NUMBER.fullmatch(raw, starts[i - 1], ends[i - 1]) and _NUMBER.match(word)
        if joins:
            runs[-1][1] = i + 1
        else:
            runs.append([i, i + 1])
    for lo, hi in runs:
        whole = raw[starts[lo] : ends[hi - 1]]
        value = whole.rstrip(b".,;:!?\"'[]{}")
        a = int(starts[lo]) + len(value) - len(value.lstrip(b".,;:!?\"'[]{}"))
        if a < starts[lo] + len(value):
            out.append(("", a, int(starts[lo]) + len(value), lo, hi))
    return out


def _contexts(column: pa.Array) -> tuple[list[bytes], list[tuple[int, str, str, list[str], int, int]]]:
    """Texts, and for each base span and each other value with a digit or at sign: text, kind of the base span ("" for none), value, patterns, begin and end in bytes."""
    lx, texts = lex(column, SPACED), texts_of(column)
    marks = np.concatenate(([0], np.cumsum(_DIGITS[lx.raw])))
    like = np.flatnonzero(marks[lx.ends] - marks[lx.starts] > 0)
    owner = np.searchsorted(lx.first, like, "right") - 1
    out = []
    for d in np.unique(owner).tolist():
        raw, first, count = texts[d], int(lx.first[d]), int(lx.first[d + 1] - lx.first[d])
        here = slice(first, first + count)
        starts, ends = lx.starts[here] - lx.base[d], lx.ends[here] - lx.base[d]
        word = lambda i: "^" if i < 0 else "$" if i >= count else _neighbour(raw[starts[i] : ends[i]])  # noqa: B023, E731
        for kind, a, b, lo, hi in _entities(raw, personal_spans(raw), starts, ends, (like[owner == d] - first).tolist()):
            value = raw[a:b]
            out.append((d, kind, _short(value.decode("utf-8", "replace")), _patterns([word(lo - 1), word(lo - 2)], word(hi), value), a, b))
    return texts, out


def is_sure() -> Column:
    """Whether a pattern's score and support are enough."""
    need = lambda score, support: (F.col("score") >= score) & (F.col("support") >= support)
    return F.when(F.startswith("pattern", F.lit(_MARK)), need(COARSE_SURE, COARSE_SUPPORT)).otherwise(need(SURE, SUPPORT))


def pattern_scores(docs: DataFrame, *, text: str = "text", turns: int = TURNS) -> DataFrame:
    """pattern, score and support, from the pattern-instance graph of all texts, after `turns` turns and as many more as change which patterns are sure.

    Null and empty texts have no patterns, copies of a text count once, and an empty table gives an empty one.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                _, found = _contexts(part.column(0))
                rows = [(p, value, kind != "") for _, kind, value, patterns, _, _ in found for p in patterns]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.bool_()))], names=["pattern", "value", "seed"])

    edges = docs.select(F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(releasing(run), "pattern string, value string, seed boolean")
    edges = edges.groupBy("pattern", "value").agg(F.max("seed").alias("seed")).checkpoint()  # read twice
    often = edges.groupBy("pattern").agg(F.count("*").alias("degree")).where(F.col("degree") >= SUPPORT)
    graph = edges.join(often, "pattern").checkpoint()
    known = graph.groupBy("value").agg(F.max("seed").alias("seed")).checkpoint()
    trust = known.select("value", F.col("seed").cast("double").alias("trust"))
    last = None
    for turn in range(1, MOST_TURNS + 1):
        scored = graph.join(trust, "value").groupBy("pattern").agg((F.sum("trust") / (F.count("*") + 1)).alias("score"), F.sum((F.col("trust") >= SURE).cast("long")).alias("support")).checkpoint()
        sure = scored.where(is_sure()).agg(F.count("*"), F.bit_xor(F.xxhash64("pattern"))).first()
        if turn >= turns and sure == last:
            return scored
        last = sure
        best = graph.join(scored.where(is_sure()).select("pattern", "score"), "pattern").groupBy("value").agg(F.max("score").alias("best"))
        trust = known.join(best, "value", "left").select("value", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("trust")).checkpoint()
    raise RuntimeError(f"sure patterns still change after {MOST_TURNS} turns")


def _finds(keyed: DataFrame, sure: DataFrame, text: str) -> DataFrame:
    """By the hash of a text: begin and end (bytes) of its values in the context of a sure pattern; copies count once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                keys, (_, context) = part.column(0).to_pylist(), _contexts(part.column(1))
                rows = [(keys[d], p, a, b) for d, kind, _, patterns, a, b in context if not kind for p in patterns]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.int32()))], names=["key", "pattern", "begin", "end"])

    candidates = keyed.select(_KEY, F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(releasing(run), "key string, pattern string, begin int, end int").distinct()
    return candidates.join(sure, "pattern", "left_semi").groupBy(F.col("key").alias(_KEY)).agg(F.collect_set(F.struct("begin", "end")).alias(_FINDS))


def _replaced(value: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span's kind in angle brackets in its place; overlapping spans are one, named by the first."""
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    pieces, past = [], 0
    for kind, a, b in merged:
        pieces += [value[past:a], f"<{kind}>"]
        past = b
    return "".join([*pieces, value[past:]])


def _columns(column: pa.Array, texts: list[bytes], extra: list[list], mask_too: bool) -> list[pa.Array]:
    """What find_personal_data returns, from texts and their finds."""
    found, counts, digests, names, masked = [], [[], [], [], []], [], [], []
    for raw, more in zip(texts, extra, strict=True):
        base = ordered(personal_spans(raw), KINDS)
        added = sorted({s for s in more if all(s[2] <= b[1] or s[1] >= b[2] for b in base)})
        chars = in_characters(raw, ordered(base + added, KINDS))
        for n, kind in zip(counts, KINDS, strict=False):
            n.append(sum(s[0] == kind for s in base))
        digests.append(digest(listed([s for s in chars if s[0] != "found"])))
        names.append(listed(chars))
        found.append([{"kind": k, "begin": a, "end": b} for k, a, b in chars])
        if mask_too:
            masked.append(_replaced(raw.decode(), chars))
    more = [pc.if_else(pc.is_valid(column), pa.array(masked, pa.string()), None)] if mask_too else []
    span = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))
    return [pa.array(found, span), *[pa.array(n, pa.int64()) for n in counts], pa.array(digests, pa.string()), pa.array(names, pa.string()), *more]


def find_personal_data(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), broadcast_patterns: int = BROADCAST_PATTERNS, mask_too: bool = False) -> DataFrame:
    """`keep` columns with found (kind, begin, end; code points), n_email, n_ip, n_card, n_phone, base_sha256 and spans.

    Base spans are those of the fixed patterns; values with digits or at signs in the context
    of a sure pattern, no word of which a base span touches, are added as kind "found". Null and empty texts have none.
    Each row gives a row; further columns play no part. More than `broadcast_patterns`
    sure patterns are not broadcast but joined, with the same finds. `mask_too` adds
    `masked`, the text as `mask` gives it, in the same pass.
    """
    sure = pattern_scores(docs, text=text).where(is_sure()).select("pattern").checkpoint()
    kind = T.StructType([T.StructField("kind", T.StringType()), T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())])
    fields = [("found", T.ArrayType(kind)), *[(f"n_{k}", T.LongType()) for k in KINDS[:4]], ("base_sha256", T.StringType()), ("spans", T.StringType()), *([("masked", T.StringType())] if mask_too else [])]
    if sure.count() > broadcast_patterns:
        keyed = docs.withColumn(_KEY, F.sha2(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), 256))
        placed = keyed.join(_finds(keyed, sure, text), _KEY, "left")

        def joined():
            return lambda column, finds: _columns(column, texts_of(column), [[("found", s["begin"], s["end"]) for s in f or ()] for f in finds.to_pylist()], mask_too)

        return map_texts(placed, joined, fields, text=text, keep=keep, beside=[F.col(_FINDS)])
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(r["pattern"] for r in sure.toLocalIterator()))

    def make():
        known = shared.value

        def kernel(column: pa.Array):
            texts, context = _contexts(column)
            extra: list[list] = [[] for _ in texts]
            for d, kind, _, patterns, a, b in context:
                if not kind and any(p in known for p in patterns):
                    extra[d].append(("found", a, b))
            return _columns(column, texts, extra, mask_too)

        return kernel

    return map_texts(docs, make, fields, text=text, keep=keep)


def mask(found: DataFrame, *, text: str = "text") -> DataFrame:
    """All columns, with each span of `found` in the text replaced by its kind in angle brackets; overlapping spans are one.

    A null text stays null; rows without spans stay as they are.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                values = zip(part.column(at).to_pylist(), part.column(where).to_pylist(), strict=True)
                out = [_replaced(v, [(x["kind"], x["begin"], x["end"]) for x in spans]) if spans else v for v, spans in values]
                columns = list(part.columns)
                columns[at] = pa.array(out, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = found.columns
    at, where = names.index(text), names.index("found")
    return found.mapInArrow(releasing(run), found.schema)
