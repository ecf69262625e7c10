"""Shared pieces of the training-data operators: Arrow plumbing and a byte-level lexer.

Texts reach Python as Arrow batches and are worked on as UTF-8 bytes in numpy, in
slices bounded by bytes, so that memory does not depend on how many rows a batch
has. All separators that the lexers use are ASCII, hence splitting bytes is exact.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text in one slice; a single longer text is a slice of its own.
SLICE_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Bounds Arrow batches by bytes, as ten thousand long texts in one would fill an executor."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keeps the session's checkpoint folder; sets one only where none is set and all runs on this machine (tests)."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "checkpoints"))


def utf8_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null counts as an empty text."""
    column = pc.fill_null(column, "") if column.null_count else column
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part has at most `limit` bytes of text, or one row."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at, total = 0, 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, total + limit, "right")))
        yield batch.slice(at, to - at)
        at, total = to, int(ends[to - 1])


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[pa.Array], Sequence]],
    fields: Sequence[tuple[str, T.DataType]],
    *,
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
    beside: Sequence[Column] = (),
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """Adds `fields`, computed from whole texts, to the columns in `keep`.

    `make` runs once in each task and returns a function from a text column, and those
    in `beside`, to one column for each field. A kept column of the same name as a new
    one gives way to it.
    """
    small_batches(df.sparkSession)
    new = [name for name, _ in fields]
    kept = [c for c in keep if c not in new]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, t) for n, t in fields])
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("\u0001text"), *beside)
    at = len(kept)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in batches:
            for part in slices(batch, at, limit):
                out = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in kernel(*part.columns[at:])]
                yield pa.RecordBatch.from_arrays([*part.columns[:at], *out], names=[*kept, *new])

    return source.mapInArrow(releasing(_typed(run, schema)), schema)


def releasing(run):
    """`run`, whose process then gives freed memory back: workers are kept for later tasks, and several idle ones share an executor."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def trim() -> None:
    """Gives memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give(0)


def _typed(run, schema: T.StructType):
    """Casts what `run` yields to the declared types."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def typed(batches):
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(batch.columns, arrow, strict=True)], schema=pa.schema([f.with_nullable(True) for f in arrow]))

    return typed


def one_thread() -> None:
    """An executor's core runs one task; libraries must not start threads of their own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"


# --- lexer -----------------------------------------------------------------------------


def byte_table(separators: Iterable[int], lower: bool = True) -> np.ndarray:
    """256 byte values: 0 for separators, A-Z lower-cased if asked; a zero byte becomes 255, which UTF-8 lacks."""
    table = np.arange(256, dtype=np.uint8)
    table[0] = 255
    if lower:
        table[65:91] += 32
    table[list(separators)] = 0
    return table


#: Words are runs of anything but ASCII white space.
SPACED = byte_table([0x20, *range(0x09, 0x0E)])
SPACED_CASED = byte_table([0x20, *range(0x09, 0x0E)], lower=False)
#: Words are runs of ASCII letters, digits and all that is not ASCII.
ALNUM = byte_table([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SYMBOL = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, SLICE_BYTES + (1 << 16))
        _powers[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, np.uint64(b), np.uint64)))) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


class Lexed:
    """The words of some texts: where they start and end, their 64-bit hashes, and each text's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, pre: Sequence[int] = ()):
        n = len(offsets) - 1
        raw = np.zeros(len(data) + n + 1, np.uint8)
        for i in range(n):  # a separator between texts
            raw[offsets[i] + i + 1 : offsets[i + 1] + i + 1] = data[offsets[i] : offsets[i + 1]]
        self.raw, self.base, self.n = raw, offsets[:-1] + np.arange(n) + 1, n
        self.norm = table[raw]
        self.norm[self.base - 1] = self.norm[-1] = 0
        inside = self.norm != 0
        self.starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        self.ends = np.flatnonzero(~inside[1:] & inside[:-1]) + 1
        self.first = np.searchsorted(self.starts, np.append(self.base, len(raw)))
        self.counts = np.diff(self.first)
        up, down = _power_tables(len(raw) + 1)
        sums = np.cumsum(_SYMBOL[self.norm] * up[: len(raw)])
        head, back = sums[self.starts - 1], down[self.starts]
        self.hash = mix((sums[self.ends - 1] - head) * back)
        #: Hashes of each word's first k bytes, 0 for shorter words.
        self.prefix = {}
        for k in pre:
            long = self.ends - self.starts > k
            at = np.where(long, self.starts + k, self.ends) - 1
            self.prefix[k] = np.where(long, mix((sums[at] - head) * back + np.uint64(k)), np.uint64(0))

    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(self.n), self.counts)

    def word(self, i: int) -> bytes:
        return self.norm[self.starts[i] : self.ends[i]].tobytes()


def lex(column: pa.Array, table: np.ndarray, pre: Sequence[int] = ()) -> Lexed:
    return Lexed(*utf8_view(column), table, pre)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the number of them in each row."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values, kind))


def char_offsets(data: np.ndarray, at: Sequence[int]) -> np.ndarray:
    """Code points before each byte position of one text."""
    ahead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return ahead[np.asarray(at, np.int64)]
