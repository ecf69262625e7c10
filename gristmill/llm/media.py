"""Media columns: signature sniffing of stored bytes.

An Aho-Corasick automaton finds all magic bytes in one scan. A validator of each format
then walks the structure behind a hit and confirms its lengths. What stands at offset 0
corrects the declared type; what stands further in is carved as embedded media.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.textkit import map_texts, releasing, slices

UNIT = 64
RATE = 8000


def _wav(b: bytes, at: int) -> int:
    """Each validator: length of a whole object at `at`, 0 if it is none."""
    if b[at + 8 : at + 12] != b"WAVE" or len(b) < at + 44:
        return 0
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    p, seen = at + 12, set()
    while p + 8 <= min(end, len(b)):
        seen.add(b[p : p + 4])
        size = struct.unpack_from("<I", b, p + 4)[0]
        p += 8 + size + (size & 1)
    return end - at if p == end <= len(b) and {b"fmt ", b"data"} <= seen else 0


def _png(b: bytes, at: int) -> int:
    p = at + 8
    while p + 12 <= len(b):
        size, kind = struct.unpack_from(">I", b, p)[0], b[p + 4 : p + 8]
        if p + 12 + size > len(b) or struct.unpack_from(">I", b, p + 8 + size)[0] != zlib.crc32(b[p + 4 : p + 8 + size]):
            return 0
        p += 12 + size
        if kind == b"IEND":
            return p - at
    return 0


def _gif(b: bytes, at: int) -> int:
    if len(b) < at + 13:
        return 0
    p = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0)
    while p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at
        if b[p] == 0x2C and p + 10 < len(b):
            p += 11 + (3 << (b[p + 9] & 7) + 1 if b[p + 9] & 0x80 else 0)
        elif b[p] == 0x21:
            p += 2
        else:
            return 0
        while p < len(b) and b[p]:  # blocks of data
            p += b[p] + 1
        p += 1
    return 0


def _jpeg(b: bytes, at: int) -> int:
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        kind = b[p + 1]
        if kind == 0xD9:
            return p + 2 - at
        p += 2 + struct.unpack_from(">H", b, p + 2)[0]
        if kind == 0xDA:  # image data go on to the next marker that is no restart
            while p + 1 < len(b) and not (b[p] == 0xFF and b[p + 1] not in (0, *range(0xD0, 0xD8))):
                p += 1
    return p + 2 - at if b[p : p + 2] == b"\xff\xd9" else 0


def _gzip(b: bytes, at: int) -> int:
    engine, left = zlib.decompressobj(31), b[at:]
    try:
        while left and not engine.eof:
            engine.decompress(left, 1 << 16)
            left = engine.unconsumed_tail
    except zlib.error:
        return 0
    return len(b) - at - len(engine.unused_data) if engine.eof else 0


def _pdf(b: bytes, at: int) -> int:
    end = b.find(b"%%EOF", at)
    return end + 5 - at if end > 0 and b.find(b"startxref", at, end) > 0 else 0


#: Format: type, magic bytes, validator. Fixed values of the formats.
FORMATS: list[tuple[str, bytes, Callable[[bytes, int], int]]] = [
    ("audio/wav", b"RIFF", _wav),
    ("image/png", b"\x89PNG\r\n\x1a\n", _png),
    ("image/gif", b"GIF87a", _gif),
    ("image/gif", b"GIF89a", _gif),
    ("image/jpeg", b"\xff\xd8\xff", _jpeg),
    ("application/gzip", b"\x1f\x8b\x08", _gzip),
    ("application/pdf", b"%PDF-", _pdf),
]


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, (_, magic, _) in enumerate(FORMATS):
        found.add_word(magic.decode("latin-1"), (i, len(magic)))
    found.make_automaton()
    return found


def sniff_bytes(b: bytes, magic) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The confirmed type of the whole, and confirmed objects inside it (type, offset, length), none inside another."""
    kind, inside, past = None, [], 0
    for end, (i, size) in magic.iter(b.decode("latin-1")):
        at = end - size + 1
        if at and at < past:
            continue
        if length := FORMATS[i][2](b, at):
            if at == 0:
                kind = FORMATS[i][0]
            else:
                inside.append((FORMATS[i][0], at, length))
                past = at + length
    return kind, inside


def store_texts(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns with n_bytes, declared and media: the text's UTF-8 bytes, zeros up to a positive multiple of 64, as 8-bit mono WAV samples.

    A null text is empty: 64 zeros. The declared type is what a text column would claim, "text/plain"; sniffing corrects it.
    """

    def make():
        def kernel(column: pa.Array):
            sizes, media = [], []
            for value in column.to_pylist():
                raw = (value or "").encode()
                n = max(1, -(-len(raw) // UNIT)) * UNIT
                head = b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n)
                sizes.append(len(raw))
                media.append(head + raw.ljust(n, b"\0"))
            return [pa.array(sizes, pa.int64()), pa.array(["text/plain"] * len(sizes)), pa.array(media, pa.binary())]

        return kernel

    return map_texts(docs, make, [("n_bytes", T.LongType()), ("declared", T.StringType()), ("media", T.BinaryType())], text=text, keep=keep)


def sniff(stored: DataFrame, *, media: str = "media", declared: str = "declared") -> DataFrame:
    """All columns and: kind (confirmed type, else the declared one), corrected, embedded (kind, begin, length) and samples (payload of a WAV, else null).

    A null or empty value has no kind but its declared one. Columns of these names give way.
    """
    new = ("kind", "corrected", "embedded", "samples")
    names = [c for c in stored.columns if c not in new]
    at, said = names.index(media), names.index(declared)
    inner = T.StructType([T.StructField("kind", T.StringType()), T.StructField("begin", T.LongType()), T.StructField("length", T.LongType())])
    schema = T.StructType([*[stored.schema[c] for c in names], T.StructField("kind", T.StringType()), T.StructField("corrected", T.BooleanType()), T.StructField("embedded", T.ArrayType(inner)), T.StructField("samples", T.BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        magic = automaton()
        arrow = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("length", pa.int64())]))
        for batch in batches:
            for part in slices(batch, at):
                kinds, right, inside, samples = [], [], [], []
                for b, claim in zip(part.column(at).to_pylist(), part.column(said).to_pylist(), strict=True):
                    kind, carved = sniff_bytes(b, magic) if b else (None, [])
                    kinds.append(kind or claim)
                    right.append(kind is not None and kind != claim)
                    inside.append([{"kind": k, "begin": o, "length": n} for k, o, n in carved])
                    samples.append(wav_samples(b) if kind == "audio/wav" else None)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(kinds, pa.string()), pa.array(right), pa.array(inside, arrow), pa.array(samples, pa.binary())], names=[*names, *new])

    return stored.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(releasing(run), schema)


def wav_samples(b: bytes) -> bytes:
    """The data chunk of a valid WAV."""
    p = 12
    while b[p : p + 4] != b"data":
        size = struct.unpack_from("<I", b, p + 4)[0]
        p += 8 + size + (size & 1)
    return b[p + 8 : p + 8 + struct.unpack_from("<I", b, p + 4)[0]]


def features(sniffed: DataFrame) -> DataFrame:
    """All columns and feature: kind, samples, mean, deviation, zero crossings and embedded objects, of the bytes read back.

    A null payload counts as one of no samples. Each row gives a row; a column `feature` gives way.
    """
    names = [c for c in sniffed.columns if c != "feature"]
    schema = T.StructType([*[sniffed.schema[c] for c in names], T.StructField("feature", T.StringType())])
    kind, samples, inside = (names.index(c) for c in ("kind", "samples", "embedded"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, samples):
                out = []
                for k, b, e in zip(part.column(kind).to_pylist(), part.column(samples).to_pylist(), part.column(inside).to_pylist(), strict=True):
                    x = np.frombuffer(b or b"", np.uint8)
                    wave = x.astype(np.float64) - 128
                    crossings = int((np.signbit(wave[1:]) != np.signbit(wave[:-1])).sum())
                    out.append(f"{k}|{len(x)}|{wave.mean() if len(x) else 0:.4f}|{wave.std() if len(x) else 0:.4f}|{crossings}|{','.join(i['kind'] for i in e or [])}")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], names=[*names, "feature"])

    return sniffed.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(releasing(run), schema)
