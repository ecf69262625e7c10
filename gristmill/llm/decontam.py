"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

A pattern is a window of `WINDOW` consecutive words of a benchmark item (a shorter
item is one window). For each pattern length, a block shift table tells how far a
search may jump from a position, so most positions are never looked at; where the
shift is 0, suffix-hash buckets select the patterns that end in that block, and a
direct comparison of the words' bytes confirms the occurrence. The searches of many
pieces of text advance side by side in numpy.

Windows lie in the benchmark's text as a sequence of word numbers, each by its place, so
a block of patterns takes little more room than its text. Blocks are cut at a bound in
bytes; where there are several, each is a further pass over the texts that adds to what
the one before has hit. No pass shuffles.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.textkit import ALNUM, SLICE_BYTES, Lexed, ensure_checkpoint_dir, lex, map_texts, mix

WINDOW = 13
#: UTF-8 bytes of benchmark text in one block of patterns; a longer item is a block of its own.
BLOCK_BYTES = 8 << 20
#: Passes that run as one stage, each with a Python process of its own; then their result is written.
_CHAINED = 3
_TEXT = "\u0001whole"
_TABLE_BITS = 18
#: Ends of windows that one lane of the search looks at.
_LANE = 128


def _blocks(hashes: np.ndarray, text: np.ndarray | None, ends: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` words that end at each position; `text` numbers the words, unless each has its own hash."""

    def word(at: np.ndarray) -> np.ndarray:
        return hashes[at] if text is None else hashes[text[at]]

    h = word(ends)
    return h if size == 1 else mix(word(ends - 1) * np.uint64(0x9E3779B97F4A7C15) + h)


class Vocabulary:
    """The words of a block: numbered, with their bytes and hashes."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.hash = np.zeros(0, np.uint64)

    def numbers(self, lx: Lexed) -> np.ndarray:
        """The number of each word of some texts; new words get one."""
        known = len(self.number)
        out = np.fromiter((self.number.setdefault(lx.word(i), len(self.number)) for i in range(len(lx.starts))), np.int32, len(lx.starts))
        new, at = np.unique(out, return_index=True)
        self.hash = np.concatenate((self.hash, lx.hash[at[new >= known]]))
        return out

    def words(self) -> list[bytes]:
        return list(self.number)


class PatternSet:
    """Windows of one length, with their shift table and suffix buckets."""

    def __init__(self, words: list[bytes], hashes: np.ndarray, text: np.ndarray, starts: np.ndarray, owners: np.ndarray, length: int):
        """`text`: word numbers; `starts`, `owners`: where each window begins, and the number of its item."""
        self.length, self.block = length, min(2, length)
        self.words, self.hashes, self.text = words, hashes, text
        rows = text[starts[:, None] + np.arange(length)]
        _, first, same = np.unique(rows.view(np.dtype((np.void, rows.dtype.itemsize * length))).ravel(), return_index=True, return_inverse=True)
        self.starts = starts[first]
        pairs = np.unique(np.stack([same.ravel(), owners]), axis=1)  # of each distinct window, its items
        self.items, self.item_at = pairs[1], np.searchsorted(pairs[0], np.arange(len(first) + 1))
        mask = (1 << _TABLE_BITS) - 1
        self.shift = np.full(mask + 1, min(255, length - self.block + 1), np.uint8)
        for end in range(self.block - 1, length):
            slot = _blocks(hashes, text, self.starts + end, self.block) & np.uint64(mask)
            np.minimum.at(self.shift, slot.astype(np.int64), np.uint8(min(255, length - 1 - end)))
        suffix = _blocks(hashes, text, self.starts + length - 1, self.block)
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]

    def search(self, lx: Lexed) -> tuple[np.ndarray, np.ndarray]:
        """First word and pattern of all occurrences in the words of some texts."""
        m, mask = self.length, np.uint64((1 << _TABLE_BITS) - 1)
        lo, hi = lx.first[:-1] + m - 1, lx.first[1:]
        n = np.maximum(0, -(-(hi - lo) // _LANE))
        own = np.repeat(np.arange(lx.n), n)
        pos = lo[own] + (np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)) * _LANE
        stop = np.minimum(pos + _LANE, hi[own])
        found = []
        while len(pos):
            jump = self.shift[(_blocks(lx.hash, None, pos, self.block) & mask).astype(np.int64)].astype(np.int64)
            if (jump == 0).any():
                found.append(pos[jump == 0])
            pos = pos + np.maximum(jump, 1)
            go = pos < stop
            pos, stop = pos[go], stop[go]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        end = np.concatenate(found)
        key = _blocks(lx.hash, None, end, self.block)
        left, right = np.searchsorted(self.suffix, key, "left"), np.searchsorted(self.suffix, key, "right")
        n = right - left
        at, slot = np.repeat(end, n) - m + 1, np.repeat(left - (np.cumsum(n) - n), n) + np.arange(n.sum())
        which = self.order[slot] if len(slot) else np.zeros(0, np.int64)
        for k in range(m):  # words by hash, then by bytes
            same = lx.hash[at + k] == self.hashes[self.text[self.starts[which] + k]]
            at, which = at[same], which[same]
        begins = self.starts[which].tolist()
        sure = [all(lx.word(a + k) == self.words[w] for k, w in enumerate(self.text[p : p + m].tolist())) for a, p in zip(at.tolist(), begins, strict=True)]
        sure = np.array(sure, bool)
        return at[sure], which[sure]

    def owners(self, own: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (text, item number) of occurrences of the patterns `which` in the texts `own`, once each."""
        n = self.item_at[which + 1] - self.item_at[which]
        at = np.repeat(self.item_at[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        found = np.unique(np.stack([np.repeat(own, n), self.items[at]]), axis=1)
        return found[0], found[1]


class Patterns:
    """The windows of some items, by length; `names` are the items' ids, in order."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        """`items`: (item id, text); a null or wordless text has no window."""
        self.names = sorted({i for i, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        vocabulary, parts, counts = Vocabulary(), [], []
        for texts in _bounded(items, SLICE_BYTES):
            lx = lex(pa.array([t for _, t in texts], pa.string()), ALNUM)
            parts.append(vocabulary.numbers(lx))
            counts.append(lx.counts)
        text = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        begin = np.cumsum(counts) - counts
        owner = np.array([number[i] for i, _ in items], np.int64)
        words, self.sets = vocabulary.words(), []
        for length in np.unique(np.minimum(counts[counts > 0], window)).tolist():
            own = counts == length if length < window else counts >= length
            n = np.where(own, counts - length + 1, 0)
            starts = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
            self.sets.append(PatternSet(words, vocabulary.hash, text, starts, np.repeat(owner, n), length))


def _bounded(items: Iterable[tuple[str, str | None]], most: int) -> Iterator[list[tuple[str, str | None]]]:
    """Items in lists of at most `most` bytes of ids and texts, or one item."""
    some, size = [], 0
    for item in items:
        n = sum(len((x or "").encode()) for x in item) + 16
        if some and size + n > most:
            yield some
            some, size = [], 0
        some.append(item)
        size += n
    if some:
        yield some


def _kernel(patterns: Patterns):
    def kernel(column: pa.Array, hits: pa.Array | None = None, items: pa.Array | None = None):
        lx = lex(column, ALNUM)
        depth = np.zeros(len(lx.starts) + 1, np.int32)
        names: list[set[str]] = [set(x or ()) for x in items.to_pylist()] if items is not None else [set() for _ in range(lx.n)]
        for d, runs in enumerate(hits.to_pylist() if hits is not None else ()):
            for run in runs or ():  # what passes before this one have hit
                depth[lx.first[d] + run["begin"]] += 1
                depth[lx.first[d] + run["end"]] -= 1
        for p in patterns.sets:
            at, which = p.search(lx)
            np.add.at(depth, at, 1)
            np.add.at(depth, at + p.length, -1)
            for d, item in zip(*(x.tolist() for x in p.owners(np.searchsorted(lx.first, at, "right") - 1, which)), strict=True):
                names[d].add(patterns.names[item])
        hit = np.cumsum(depth[:-1]) > 0
        edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
        begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        spans: list[list[dict]] = [[] for _ in range(lx.n)]
        for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
            d = int(np.searchsorted(lx.first, b, "right")) - 1
            while b < e:  # a run may go on in the next text
                to = min(e, int(lx.first[d + 1]))
                if to > b:
                    spans[d].append({"begin": b - int(lx.first[d]), "end": to - int(lx.first[d])})
                b, d = max(b, to), d + 1
        span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        return [pa.array(lx.counts, pa.int64()), pa.array(spans, span), pa.array([sorted(x) for x in names], pa.list_(pa.string()))]

    return kernel


_FIELDS = [
    ("n_words", T.LongType()),
    ("hits", T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    ("items", T.ArrayType(T.StringType())),
]


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """`keep` columns with n_words, hits (runs of hit words, end exclusive), n_hit, items (sorted ids) and contaminated.

    benchmark: item_id, text; further columns are ignored. Null texts, empty texts and
    an empty benchmark give no hits; rows with one item_id are one item, a null id is
    called "null". Each row of `docs` gives one row, repeated rows included, and an empty
    table an empty one. A kept column named like a new one gives way.
    contaminated: at least one hit word, and at least one in twenty. The benchmark passes
    through the driver in blocks of at most `block_bytes`, or one item.
    """
    new = ("n_words", "hits", "n_hit", "items", "contaminated")
    kept = [c for c in dict.fromkeys(keep) if c not in new]
    bench = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("string").alias("words"))
    spark = docs.sparkSession
    found = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias(_TEXT))
    blocks = _bounded(((r["item"], r["words"]) for r in bench.toLocalIterator()), block_bytes)
    items, passes = next(blocks, []), 0
    while items is not None:
        if passes and passes % _CHAINED == 0:
            ensure_checkpoint_dir(spark)
            found = found.checkpoint()
        following = next(blocks, None)
        found = _search(found, Patterns(items, window), kept if following is None else [*kept, _TEXT], passes > 0)
        items, passes = following, passes + 1
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, h: s + (h["end"] - h["begin"]))
    found = found.withColumn("n_hit", n_hit)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _search(docs: DataFrame, patterns: Patterns, kept: list[str], more: bool) -> DataFrame:
    """One pass; `more`: it adds to the hits and items that `docs` have."""
    shared = docs.sparkSession.sparkContext.broadcast(patterns)
    beside = [F.col("hits"), F.col("items")] if more else []
    return map_texts(docs, lambda: _kernel(shared.value), _FIELDS, text=_TEXT, keep=kept, beside=beside)
