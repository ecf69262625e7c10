"""BPE encoding and decoding with a pair occurrence index.

The words of a slice of a partition that are not known yet are laid out as one linked
list of symbols. An index maps each pair of neighbours to all its positions; the ranks
of the pairs that occur are active. They are applied in ascending order, each at all
its positions, and the lists of the pairs that this breaks or makes are updated.
"""

from __future__ import annotations

import heapq
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gristmill.llm.textkit import lists, map_texts, one_thread, releasing

#: Words whose ids a task remembers; at more, it forgets the long ones, or all.
_REMEMBERED = 200_000
#: Up to U+024F, composed form is given and lower case is that of Python.
_OTHER = re.compile("[^\x00-\u024f]")
_SHIFT = 20


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A tokenizers BPE file with byte-level symbols and a suffix at word ends."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        self.library_form = Tokenizer.from_file(path).normalizer.normalize_str
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"^\s", r"^\p{White_Space}")).findall
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = regex.compile("(" + "|".join(regex.escape(x) for x in self.special) + ")") if self.special else None
        symbols = byte_symbols()
        self.first = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + end] for s in symbols], np.int64)
        #: Of each rank: the pair's two symbols and the one they make.
        self.merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"])]
        self.ranks = {a << _SHIFT | b: rank for rank, (a, b, _) in enumerate(self.merges)}
        self.pairs = np.array(sorted(self.ranks), np.int64)
        self.pair_ranks = np.array([self.ranks[x] for x in self.pairs.tolist()], np.int64)
        self.tokens = _tokens(spec)
        del spec, model, vocab
        self.known: dict[str, bytes] = {}

    def normalize(self, text: str) -> str:
        """The normal form but for runs of white space, which no word has."""
        return self.library_form(text) if _OTHER.search(text) else text.lower()

    def split(self, text: str) -> list[str]:
        """The words of a text; special strings are words of their own."""
        if not text:
            return []
        if self.special_at is None or not self.special_at.search(text):
            return self.words(self.normalize(text))
        out: list[str] = []
        for part in self.special_at.split(text):
            out += [part] if part in self.special else self.words(self.normalize(part)) if part else []
        return out

    def learn(self, words: set[str]) -> None:
        """Finds the ids of new words, all at once."""
        for word in words & self.special.keys():
            self.known[word] = np.int32(self.special[word]).tobytes()
        new = [w for w in words if w not in self.known]
        if not new:
            return
        raw = np.frombuffer(("\n".join(new) + "\n").encode(), np.uint8)  # no word has a line feed
        ends = np.flatnonzero(raw == 10)
        flat = self.first[raw]
        flat[ends - 1] = self.last[raw[ends - 1]]
        flat[ends] = -1
        where = self.index(flat)
        active = sorted(where)
        sym = flat.tolist()
        after = list(range(1, len(sym) + 1))
        before = list(range(-1, len(sym) - 1))  # the first symbol has the last separator before it
        merges, ranks, pop, push = self.merges, self.ranks.get, heapq.heappop, heapq.heappush
        while active:
            rank = pop(active)
            places = where.pop(rank, None)
            if places is None:
                continue
            a, b, made = merges[rank]
            places.sort()
            for i, p in enumerate(places):
                q = after[p]
                if sym[p] != a or sym[q] != b:
                    continue  # an earlier merge took one of the two
                o, n = before[p], after[q]
                sym[p], sym[q] = made, -2
                after[p], before[n] = n, p
                x, y = sym[o], sym[n]
                lower = False
                if x >= 0 and (got := ranks(x << _SHIFT | made)) is not None:
                    if got in where:
                        where[got].append(o)
                    else:
                        where[got] = [o]
                        push(active, got)
                    lower = got < rank
                if y >= 0 and (got := ranks(made << _SHIFT | y)) is not None:
                    if got in where:
                        where[got].append(p)
                    else:
                        where[got] = [p]
                        push(active, got)
                    lower |= got < rank
                if lower and i + 1 < len(places):  # a rank below this one comes first
                    where.setdefault(rank, []).extend(places[i + 1 :])
                    push(active, rank)
                    break
        done = np.array(sym, np.int32)
        left = done >= 0
        ids = done[left].tobytes()
        bounds = (4 * np.cumsum(left)[ends]).tolist()
        self.known.update(zip(new, (ids[s:e] for s, e in zip([0, *bounds], bounds, strict=False)), strict=True))

    def index(self, flat: np.ndarray) -> dict[int, list[int]]:
        """All positions of each pair of neighbours that has a rank, by rank; -1 parts words."""
        pair = flat[:-1] << _SHIFT | flat[1:]  # negative beside a separator
        slot = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        at = np.flatnonzero(self.pairs[slot] == pair)
        rank = self.pair_ranks[slot[at]]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order].tolist(), rank[order]
        starts = np.flatnonzero(np.diff(rank, prepend=-1))
        bounds = [*starts.tolist(), len(at)]
        return {r: at[s:e] for r, s, e in zip(rank[starts].tolist(), bounds, bounds[1:], strict=False)}

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, and how many each has."""
        if len(self.known) > _REMEMBERED:
            short = {w: ids for w, ids in self.known.items() if len(w) <= 8}
            self.known = short if len(short) < _REMEMBERED // 2 else {}
        words = [self.split(x or "") for x in texts]
        self.learn(set(chain.from_iterable(words)) - self.known.keys())
        ids = [b"".join(map(self.known.__getitem__, ws)) for ws in words]
        return np.frombuffer(b"".join(ids), np.int32), np.array([len(x) // 4 for x in ids], np.int64)


def _tokens(spec: dict) -> pa.Array:
    """The token of each id."""
    ids = {**spec["model"]["vocab"], **{t["content"]: t["id"] for t in spec["added_tokens"]}}
    out = [""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        out[i] = token
    return pa.array(out)


def token_table(path: str) -> pa.Array:
    with open(path, encoding="utf-8") as f:
        return _tokens(json.load(f))


def decoded(tokens: pa.Array, ids: pa.ListArray) -> pa.Array:
    """As a library without a decoder does: tokens, joined by a space."""
    bounds = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), tokens.take(ids.flatten())), " ")


_models: dict[str, WordBpe] = {}


def _model(path: str) -> WordBpe:
    if path not in _models:
        one_thread()
        _models.clear()
        _models[path] = WordBpe(path)
    return _models[path]


def encode(docs: DataFrame, tokenizer: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decode_too: bool = False) -> DataFrame:
    """`keep` columns with n_tokens and ids. Null and empty texts, and those of white space, have no ids.

    Each row gives one row, repeated rows too; a kept column named like a new one gives
    way. `decode_too` adds `decoded` as `decode` does, without ids going to and from
    another Python process.
    """

    def make():
        model = _model(tokenizer)

        def kernel(column: pa.Array):
            flat, n = model.encode(column.to_pylist())
            ids = lists(flat, n, pa.int32())
            return [pa.array(n), ids, *([decoded(model.tokens, ids)] if decode_too else [])]

        return kernel

    fields = [("n_tokens", T.LongType()), ("ids", T.ArrayType(T.IntegerType())), *([("decoded", T.StringType())] if decode_too else [])]
    return map_texts(docs, make, fields, text=text, keep=keep)


def decode(encoded: DataFrame, tokenizer: str, *, ids: str = "ids") -> DataFrame:
    """All columns and `decoded`, the text of the ids with special tokens kept; null ids count as none.

    A column `decoded` of the input gives way.
    """
    names = [c for c in encoded.columns if c != "decoded"]
    at = names.index(ids)
    schema = T.StructType([*[encoded.schema[c] for c in names], T.StructField("decoded", T.StringType())])

    def run(batches):
        tokens = token_table(tokenizer)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, decoded(tokens, part.column(at))], names=[*names, "decoded"])

    return encoded.select(*[encoded[f"`{c}`"] for c in names]).mapInArrow(releasing(run), schema)
