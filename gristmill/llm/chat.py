"""Chat formatting by token-level assembly.

A turn is `<s>` role `[INST]` text `</s>`. Roles and texts are escaped and encoded as
segments of their own; the control strings are single reserved ids spliced between
them, so no content can make one. The loss mask follows from segment lengths by a
prefix sum: 1 on the tokens of assistant texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.bpe import byte_symbols
from gristmill.llm.textkit import lists, one_thread, releasing, slices, small_batches
from gristmill.llm.tokencount import BATCH_BYTES, KEPT_BYTES, batches, pieces, splits_at_spaces

OPEN, MIDDLE, CLOSE = CONTROLS = ("<s>", "[INST]", "</s>")
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROLS) + r"|\\")
_ESCAPED = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    """No control string is left: a backslash goes in after its first character; backslashes are doubled."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class _Codec:
    """Ids of texts and texts of ids; ids of pieces between white space are kept, as most occur again."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        one_thread()
        self.model = Tokenizer.from_file(path)
        self.model.no_padding()
        self.model.no_truncation()
        self.model.encode_special_tokens = True  # their strings in a text are ordinary text
        self.base = self.model.get_vocab_size(with_added_tokens=True)
        self.reserved = {self.base + i: c for i, c in enumerate(CONTROLS)}
        self.cut = pieces if splits_at_spaces(path) else lambda text: [text]
        self.kept: dict[str, bytes] = {}
        self.bytes = 0
        byte_of = {symbol: b for b, symbol in enumerate(byte_symbols())}
        tokens = [self.model.id_to_token(i) or "" for i in range(self.base)]
        plain = [bytes(map(byte_of.__getitem__, t)) if byte_of.keys() >= set(t) else t.encode() for t in tokens]
        self.tokens = [*plain, *(c.encode() for c in CONTROLS)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, four bytes each."""
        if self.bytes > KEPT_BYTES:
            self.kept, self.bytes = {}, 0
        parts = [self.cut(x) if x else [] for x in texts]
        for batch in batches(list(set().union(*parts) - self.kept.keys()), BATCH_BYTES):
            for piece, got in zip(batch, self.model.encode_batch_fast(batch, add_special_tokens=False), strict=True):
                ids = self.kept[piece] = np.array(got.ids, np.int32).tobytes()
                self.bytes += len(piece) + len(ids) + 150
        return [b"".join(map(self.kept.__getitem__, x)) for x in parts]


_codecs: dict[str, _Codec] = {}


def _codec(path: str) -> _Codec:
    """One for each worker process, which later tasks use again."""
    if path not in _codecs:
        _codecs.clear()
        _codecs[path] = _Codec(path)
    return _codecs[path]


def format_turns(turns: DataFrame, tokenizer: str) -> DataFrame:
    """conv_id, turn, ids and mask (1 on tokens to learn) of each turn, in the input's order.

    tokenizer: a byte-level tokenizers file, which loses nothing. A null role or text is
    empty. Repeated turns stay; further columns play no part. An empty table gives an empty one.
    """
    small_batches(turns.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(tokenizer)
        open_, middle, close = (np.int32(x).tobytes() for x in codec.reserved)
        for batch in batches:
            for part in slices(batch, 3, 1 << 18):
                roles, texts = part.column(2).to_pylist(), part.column(3).to_pylist()
                role_ids, text_ids = codec.encode([escape(x) for x in roles]), codec.encode([escape(x) for x in texts])
                ids = [open_ + r + middle + t + close for r, t in zip(role_ids, text_ids, strict=True)]
                size = np.array([len(x) // 4 for x in ids])
                step = np.zeros(int(size.sum()) + 1, np.int8)
                ends = np.cumsum(size) - 1
                learn = np.array([r == "assistant" for r in roles], np.int8)
                np.add.at(step, ends - [len(t) // 4 for t in text_ids], learn)
                np.add.at(step, ends, -learn)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), lists(np.frombuffer(b"".join(ids), np.int32), size, pa.int32()), lists(np.cumsum(step[:-1]).astype(np.int32), size, pa.int32())],
                    names=["conv_id", "turn", "ids", "mask"],
                )

    whole = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *whole).mapInArrow(releasing(run), "conv_id long, turn long, ids array<int>, mask array<int>")


_READ = "conv_id long, turn long, role string, text string, learnt string, n_chars long"
_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_turns(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """conv_id, turn, role, text, learnt (what the loss mask covers, null if nothing) and n_chars (of the formatted turn), from ids and mask alone."""
    small_batches(formatted.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(tokenizer)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                flat, mask = (part.column(i).flatten().to_numpy() for i in (2, 3))
                ends = np.cumsum(pc.list_value_length(part.column(2)).to_numpy())
                raw = list(map(codec.tokens.__getitem__, flat.tolist()))
                control = np.flatnonzero(flat >= codec.base).reshape(-1, 3).tolist()  # three in each turn
                roles = [b"".join(raw[a + 1 : b]).decode() for a, b, _ in control]
                texts = [b"".join(raw[b + 1 : c]).decode() for _, b, c in control]
                marks = [sum(len(raw[k]) for k in at) for at in control]
                learnt, under = [], np.flatnonzero(mask)
                for places in np.split(under, np.searchsorted(under, ends[:-1])):
                    learnt.append(unescape(b"".join(raw[k] for k in places.tolist()).decode()) if len(places) else None)
                chars = [n + len(r) + len(t) for n, r, t in zip(marks, roles, texts, strict=True)]
                columns = [*part.columns[:2], pa.array(map(unescape, roles), pa.string()), pa.array(map(unescape, texts), pa.string()), pa.array(learnt, pa.string()), pa.array(chars, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn", "role", "text", "learnt", "n_chars"])

    return formatted.select("conv_id", "turn", "ids", "mask").mapInArrow(releasing(run), _READ)


def read_back(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """Digests of each conversation, from the ids and masks of its turns alone.

    Turns are in order (a null turn first, ties by role and text). Ids are encoded and
    decoded wherever turns lie; what one task sees of a whole conversation is a stream
    of decoded turns that it only hashes. A null conv_id is a conversation of its own.
    """
    turns = read_turns(formatted, tokenizer).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = (), None

        def row():
            n, said, chars, loss, total = state
            values = [now[0], n, said.hexdigest(), chars, loss.hexdigest(), total]
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, values, strict=True))], schema=schema)

        for batch in batches:
            for conv, _, role, text, learnt, chars in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (conv,):
                    if state:
                        yield row()
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if learnt is not None:
                    state[2] += len(learnt)
                    state[3].update(learnt.encode())
                state[4] += chars
        if state:
            yield row()

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    return turns.mapInArrow(releasing(run), _DIGESTS)
