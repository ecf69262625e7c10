"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are split at safe boundaries, and each distinct piece is encoded once, in batches
balanced by their bytes; a text's count is the sum over its pieces. What a worker has
counted it keeps, up to a bound in bytes, so that common words never reach the
tokenizer again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gristmill.llm.textkit import map_texts, one_thread, utf8_view

#: Bytes that one call of the tokenizer gets, and bytes of pieces whose counts a worker keeps.
BATCH_BYTES = 128 << 10
KEPT_BYTES = 64 << 20

#: White space with the word behind it. The pre-tokenizer of byte-level vocabularies has a
#: boundary before each run of white space, looks ahead only past such a run, and no
#: special string contains white space: pieces have the same tokens alone as together.
_PIECE = re.compile(r"\s*\S+|\s+").findall
#: Characters of which libraries differ on whether they are white space: a text that has one stays whole.
_DOUBTFUL = ("\x1c", "\x1d", "\x1e", "\x1f", "\x85", "᠎")


def pieces(text: str) -> list[str]:
    """Splits a text before its runs of white space; put together, the parts are the text."""
    return [text] if any(c in text for c in _DOUBTFUL) else _PIECE(text)


def batches(parts: list[str], most: int) -> Iterator[list[str]]:
    """Parts in batches of at most `most` UTF-8 bytes, or one part; long ones come first, so that batches even out."""
    order = sorted(parts, key=len, reverse=True)
    sizes = np.array([len(x.encode()) for x in order], np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(order):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + most, "right")))
        yield order[at:to]
        at = to


class Counter:
    """A tokenizer that gives lengths, with the counts of pieces that it has seen."""

    def __init__(self, path: str):
        one_thread()
        if path.endswith(".model"):  # pieces of such a vocabulary may cross spaces
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode, self.splits = (lambda xs: model.encode(xs, num_threads=1)), False
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_padding()
            model.no_truncation()
            self.encode, self.splits = (lambda xs: model.encode_batch_fast(xs, add_special_tokens=False)), splits_at_spaces(path)
        self.kept: dict[str, int] = {}
        self.bytes = 0

    def counts(self, texts: list[str], batch_bytes: int = BATCH_BYTES, kept_bytes: int = KEPT_BYTES) -> list[int]:
        if self.bytes > kept_bytes:
            self.kept, self.bytes = {}, 0
        cut: Callable[[str], list[str]] = pieces if self.splits else lambda x: [x]
        parts = [cut(x) if x else [] for x in texts]
        new = list(set().union(*parts) - self.kept.keys())
        for batch in batches(new, batch_bytes):
            self.kept.update(zip(batch, map(len, self.encode(batch)), strict=True))
            self.bytes += sum(map(len, batch)) + 100 * len(batch)
        return [sum(map(self.kept.__getitem__, x)) for x in parts]


def splits_at_spaces(path: str) -> bool:
    """Whether a tokenizers file has a byte-level vocabulary whose pre-tokenizer and special strings allow to split before white space."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before = spec.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True) and not spec.get("normalizer")
    return plain and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in spec.get("added_tokens", []))


_counters: dict[str, Counter] = {}


def _counter(path: str) -> Counter:
    """One for each worker process, which later tasks use again."""
    if path not in _counters:
        _counters.clear()
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, tokenizer: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 1024, batch_bytes: int = BATCH_BYTES, kept_bytes: int = KEPT_BYTES) -> DataFrame:
    """`keep` columns with n_bytes, n_tokens and over_limit (more than `limit` tokens).

    tokenizer: path of a tokenizers JSON file or a sentencepiece model. Texts are split
    only where the vocabulary is known to allow it (see splits_at_spaces). Null texts
    count as empty: 0 bytes, 0 tokens. Each input row gives one row, repeated rows too,
    and an empty table an empty one; further columns play no part, and a kept column
    named like a new one gives way.
    """

    def make():
        counter = _counter(tokenizer)

        def kernel(column: pa.Array):
            _, offsets = utf8_view(column)
            counts = counter.counts(column.to_pylist(), batch_bytes, kept_bytes)
            return [pa.array(offsets[1:] - offsets[:-1], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())]

        return kernel

    return map_texts(docs, make, [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())], text=text, keep=keep)
