"""SimHash near duplicates by meet-in-the-middle ball hashing.

1. One pass over the texts gives each row a 64-bit fingerprint: a bit is 1 where over
   half of the text's shingles have it in their XXH64. Equal fingerprints are one class
   from here on, so a group of copies, however large, is one row of what follows.
2. Every distinct fingerprint emits all variants within half the radius: itself and the
   64 with one bit flipped. Two fingerprints that differ in at most two bits have a
   variant in common, the one half way between them.
3. Variants are shuffled and those that several fingerprints have are kept. Who emitted
   a variant is told by the flipped bits alone, so a group's state is one long and a
   flag, combined before the shuffle; a variant has at most 65 owners.
4. Owners of a variant are paired with the smallest of them, pairs are made unique and
   verified, and components follow from the pairs. Any two owners of one variant are
   within the radius, so pairs with the smallest one connect all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.components import connected_components
from gristmill.llm.textkit import ensure_checkpoint_dir, map_texts, utf8_view

WORDS, SEED, RADIUS = 3, 42, 2
#: Shingles whose bits are counted at once (64 bytes each).
_BLOCK = 1 << 16
#: What a variant within half the radius flips, as longs.
_FLIPS = [0, *(1 << i for i in range(63)), -(1 << 63)]


def shingle_hashes(text: bytes, words: int = WORDS, seed: int = SEED) -> list[int]:
    """XXH64 of each shingle of a text in UTF-8, repeats included; fewer words: of the whole sequence."""
    from xxhash import xxh64_intdigest

    found = text.lower().split()  # of bytes: A-Z alone, and at ASCII white space alone
    if not found:
        return []
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    size = min(words, len(found))
    starts = np.concatenate(([0], ends[:-1]))[: len(found) - size + 1]
    return [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts.tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of `counts` hashes; 0 of none."""
    doc = np.repeat(np.arange(len(counts)), counts)
    ones = np.zeros((len(counts), 64), np.int64)
    for at in range(0, len(hashes), _BLOCK):
        part, owner = hashes[at : at + _BLOCK], doc[at : at + _BLOCK]
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[owner[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), words: int = WORDS) -> DataFrame:
    """The columns in `keep`, and fingerprint (a long) of each row's whole text.

    Null, empty and wordless texts have fingerprint 0. Repeated rows stay; a kept column
    named fingerprint gives way. An empty table gives an empty one.
    """

    def make():
        def kernel(column: pa.Array):
            data, offsets = utf8_view(column)
            found = [shingle_hashes(data[a:b].tobytes(), words) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            hashes = np.fromiter((h for one in found for h in one), np.uint64, int(counts.sum()))
            return [pa.array(majority(hashes, counts).view(np.int64))]

        return kernel

    return map_texts(docs, make, [("fingerprint", T.LongType())], text=text, keep=keep)


def colliding_pairs(prints: DataFrame) -> DataFrame:
    """x < y, pairs of the distinct longs `fingerprint` within the radius: enough of them to connect all that are."""
    flips = F.array(*map(F.lit, _FLIPS)).cast("array<long>")
    emitted = prints.select("fingerprint", F.explode(flips).alias("flip")).select(F.col("fingerprint").bitwiseXOR(F.col("flip")).alias("variant"), "flip")
    owners = emitted.groupBy("variant").agg(F.bit_or("flip").alias("flips"), F.bool_or(F.col("flip") == 0).alias("itself"))
    met = owners.where(F.bit_count("flips") + F.col("itself").cast("int") > 1)
    has = lambda flip: F.when(flip == 0, F.col("itself")).otherwise(F.col("flips").bitwiseAND(flip) != 0)
    members = met.select(F.transform(F.filter(flips, has), lambda flip: F.col("variant").bitwiseXOR(flip)).alias("members"))
    pairs = members.select(F.array_min("members").alias("x"), F.explode("members").alias("y")).where("x < y").distinct()
    return pairs.where(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= RADIUS)


def as_hex(fingerprint: Column) -> Column:
    """A fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, fingerprint (a long) and component_id (smallest id reachable by links) of each row.

    Rows link where their fingerprints differ in at most two bits. Null, empty and
    wordless texts have fingerprint 0 and link like any other. Rows with equal ids are
    one document, with links to all that any of its texts links to; each gives a row. A
    row without an id gets a fingerprint, but no component and no links. Ids are
    integers; further columns play no part. An empty table gives an empty one.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    named = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    rows = fingerprints(named, keep=("id",), words=words).checkpoint()
    known = rows.where("id is not null")
    classes = known.groupBy("fingerprint").agg(F.min("id").alias("first"))
    several = known.groupBy("id").agg(F.min("fingerprint").alias("x"), F.max("fingerprint").alias("z")).where("x < z").drop("z")
    same_id = known.join(several, "id").where("fingerprint > x").select("x", F.col("fingerprint").alias("y"))
    # dealt out again, not by the same key: a partition of classes is small until it emits 65 rows for each
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = connected_components(colliding_pairs(classes.select("fingerprint").repartition(parts)).unionByName(same_id))
    placed = classes.join(found.select(F.col("id").alias("fingerprint"), "component"), "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    smallest = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    labels = placed.join(smallest, "component").select("fingerprint", "component_id").checkpoint()
    # both sides are written, so that the join can split the rows of a class of very many copies
    out = rows.join(labels, "fingerprint", "left")
    return out.select(F.col("id").alias("doc_id"), "fingerprint", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
