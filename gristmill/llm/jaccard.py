"""N-gram Jaccard join with rare-first prefix, length, positional and suffix filters.

1. One pass over the texts makes each document's set of shingle hashes, its size, a
   128-bit signature, parity bits for the suffix filter, and a fixed-size count sketch
   of all shingles. Documents with one signature are copies; only the smallest id of
   each class goes on.
2. A second pass orders each set rare-first by the sketch and emits its prefix: sets
   with a similarity of at least t share one of their first (1 - t) n + 1 elements.
   Prefix elements that only one class has end here.
3. In each bucket of a shared element, all members are compared with one pivot, the
   member with the largest share of such elements: as many pairs as rows, however large
   the bucket, and mostly the same pivot in the buckets of one group. Pairs are filtered
   by length and parity bits, made unique and verified once on the whole sets. Their
   links give components. Another round goes on with buckets of several components.
4. Pairs of a bucket whose members are in different components by now can still be
   links; these alone are enumerated, under the length, positional (the smaller set must
   hold the element in its first n / 9 + 1) and parity filters, and verified. Links left
   out join members of one component, so the components are exact.

Parity bits: bit i of a set tells whether an odd number of its elements hash to i. Bits
that differ between two sets are at most as many as elements that only one of them has.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.components import connected_components
from gristmill.llm.textkit import SPACED, Lexed, ensure_checkpoint_dir, lex, lists, map_texts, mix, releasing, slices, small_batches

WORDS = 5
#: Similarity as a fraction, so that comparisons are exact.
SIMILARITY = (80, 100)
_SKETCH_BITS = 20
#: Bits of the map of documents that verification needs (4 MB).
_MEMBER_BITS = 25
#: Ids of documents to verify that are broadcast (16 bytes each).
_BROADCAST_IDS = 100_000
#: Parity bits that go with each shared element; longer texts have more in their summary.
_FEW_BITS = 512
_FEW = [f"b{i}" for i in range(_FEW_BITS // 64)]
_SLICES = 64
_SLICE = (1 << _SKETCH_BITS) // _SLICES
_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(lx: Lexed, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and how many each has."""
    ends = np.repeat(lx.first[1:], lx.counts)
    at = np.flatnonzero(np.arange(len(ends)) + k <= ends) if len(ends) else np.zeros(0, np.int64)
    value = np.zeros(len(at), np.uint64)
    for j in range(k):
        value = value * _STEP + lx.hash[at + j]
    doc = np.searchsorted(lx.first, at, "right") - 1 if len(at) else at
    values, docs = [mix(value)], [doc]
    for n in range(1, k):  # fewer words: the whole sequence
        short = np.flatnonzero(lx.counts == n)
        value = np.full(len(short), n, np.uint64)
        for j in range(n):
            value = value * _STEP + lx.hash[lx.first[short] + j]
        values.append(mix(value + np.uint64(n)))
        docs.append(short)
    value, doc = np.concatenate(values), np.concatenate(docs)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[new], np.bincount(doc[new], minlength=lx.n)


def parity(values: np.ndarray) -> np.ndarray:
    """Parity bits of sorted hashes by their top bits, one to two bits for each half element; 512 at least."""
    bits = max(int(math.log2(_FEW_BITS)), math.ceil(math.log2(2 * max(1, len(values)))))
    return (np.bincount((values >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1).astype(np.uint8)


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_xor.reduce(bits.reshape(size, -1), axis=1)


def least_difference(a: bytes, b: bytes) -> int:
    """Elements that only one of two sets has, at least, by their parity bits."""
    x, y = (np.unpackbits(np.frombuffer(v, np.uint8)) for v in (a, b))
    size = min(len(x), len(y))
    return int((_folded(x, size) ^ _folded(y, size)).sum())


def _summaries(docs: DataFrame, k: int) -> DataFrame:
    """For each document: id, n, s1, s2, all parity bits, and few of them as longs; for each task: its part of the sketch, in slices."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << _SKETCH_BITS, np.uint16)
        none = pa.nulls
        for batch in batches:
            for part in slices(batch, 1):
                values, n = shingle_sets(lex(part.column(1), SPACED), k)
                slot, c = np.unique((values & np.uint64((1 << _SKETCH_BITS) - 1)).astype(np.int64), return_counts=True)
                counts[slot] = np.minimum(counts[slot].astype(np.int64) + c, 65535)
                sums = [np.concatenate(([np.uint64(0)], np.cumsum(v))) for v in (values, mix(values + np.uint64(1)))]
                ends = np.cumsum(n)
                s1, s2 = [(s[ends] - s[ends - n]).view(np.int64) for s in sums]
                odd = [parity(values[e - c : e]) for e, c in zip(ends.tolist(), n.tolist(), strict=True)]
                few = np.packbits(np.stack([_folded(x, _FEW_BITS) for x in odd]), axis=1).view(np.int64)
                bits = pa.array([np.packbits(x).tobytes() for x in odd], pa.binary())
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(s1), pa.array(s2), bits, *map(pa.array, np.ascontiguousarray(few.T)), none(part.num_rows, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        if counts.any():
            parts = [counts[i * _SLICE : (i + 1) * _SLICE].tobytes() for i in range(_SLICES)]
            nil = none(_SLICES, pa.int64())
            yield pa.RecordBatch.from_arrays([nil, nil, nil, nil, pa.array(parts, pa.binary()), *[nil] * len(_FEW), pa.array(range(_SLICES), pa.int32())], names=names)

    names = ["id", "n", "s1", "s2", "bits", *_FEW, "slice"]
    return docs.select("id", "text").mapInArrow(releasing(run), f"id long, n long, s1 long, s2 long, bits binary, {' long, '.join(_FEW)} long, slice int")


def _sketch(summaries: DataFrame) -> np.ndarray:
    """The sketch of all tasks: a table of fixed size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.frombuffer(part, np.uint16)
                total[i] = np.minimum(total.get(i, 0) + got.astype(np.int64), 1 << 40)
        for i, counts in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.minimum(counts, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())], names=["slice", "part"])

    parts = summaries.where("slice is not null").select("slice", F.col("bits").alias("part")).repartition(8, "slice").mapInArrow(releasing(run), "slice int, part binary")
    table = np.zeros(1 << _SKETCH_BITS, np.int32)
    for row in parts.toLocalIterator():
        table[row["slice"] * _SLICE : (row["slice"] + 1) * _SLICE] = np.frombuffer(row["part"], np.int32)
    return table


def _prefixes(docs: DataFrame, sketch: np.ndarray, k: int, similarity: tuple[int, int]) -> DataFrame:
    """id, n and the rare-first prefix of each document."""
    shared, (num, den) = docs.sparkSession.sparkContext.broadcast(sketch), similarity

    def make():
        table = shared.value

        def kernel(column: pa.Array):
            values, n = shingle_sets(lex(column, SPACED), k)
            doc = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((values, table[(values & np.uint64((1 << _SKETCH_BITS) - 1)).astype(np.int64)], doc))
            length = np.where(n > 0, n * (den - num) // den + 1, 0)
            place = np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
            head = values[order][place < np.repeat(length, n)]
            return [pa.array(n, pa.int64()), lists(head.view(np.int64), length, pa.int64())]

        return kernel

    return map_texts(docs, make, [("n", T.LongType()), ("prefix", T.ArrayType(T.LongType()))], keep=("id",))


def _members(ids: DataFrame) -> np.ndarray:
    """A bit map of fixed size that has a bit for each id, by hash."""
    slot = F.pmod(F.xxhash64("id"), F.lit(1 << _MEMBER_BITS))
    words = ids.select(F.shiftright(slot, 5).alias("word"), (slot % 32).cast("int").alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    table = np.zeros(1 << (_MEMBER_BITS - 5), np.uint32)
    for batch in words.toArrow().to_batches():
        table[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return table


def _set_lists(column: pa.Array, k: int) -> pa.Array:
    values, n = shingle_sets(lex(column, SPACED), k)
    return lists(values.view(np.int64), n, pa.int64())


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """id and shingle set of the documents in `ids`. Few ids are broadcast; beyond, a bit map spares most other texts the way to the join."""
    if ids.count() <= _BROADCAST_IDS:
        few = docs.join(F.broadcast(ids), "id", "left_semi")
        return map_texts(few, lambda: lambda column: [_set_lists(column, k)], [("set", T.ArrayType(T.LongType()))], keep=("id",))
    shared = docs.sparkSession.sparkContext.broadcast(_members(ids))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            slot = batch.column(1).to_numpy()
            batch = batch.filter(pa.array((table[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1 == 1))
            for part in slices(batch, 2):
                yield pa.RecordBatch.from_arrays([part.column(0), _set_lists(part.column(2), k)], names=["id", "set"])

    slotted = docs.where("id is not null").select("id", F.pmod(F.xxhash64("id"), F.lit(1 << _MEMBER_BITS)).alias("slot"), "text")
    return slotted.mapInArrow(releasing(run), "id long, set array<long>").join(ids, "id", "left_semi")


def _suffix_filter(pairs: DataFrame, rows: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Drops pairs whose parity bits prove that too many elements are in one set only."""
    num, den = similarity
    for side in "xy":
        own = rows.where("id is not null").select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("bits").alias(f"b{side}"))
        pairs = pairs.join(own, side)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(2, 6)]
            ok = [(num + den) * least_difference(a, b) <= (den - num) * (n + m) for n, m, a, b in zip(*columns, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return pairs.select("x", "y", "nx", "ny", "bx", "by").mapInArrow(releasing(run), "x long, y long").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, k: int, similarity: tuple[int, int]) -> DataFrame:
    """The pairs that are links, by their whole sets."""
    num, den = similarity
    pairs = _written(pairs)
    ids = pairs.select(F.col("x").alias("id")).union(pairs.select("y")).distinct()
    ids = _written(ids)
    sets = _sets(docs, ids, k)
    both = pairs.join(sets.select(F.col("id").alias("x"), F.col("set").alias("sx")), "x").join(sets.select(F.col("id").alias("y"), F.col("set").alias("sy")), "y")
    common = F.size(F.array_intersect("sx", "sy"))
    return both.where((num + den) * common >= num * (F.size("sx") + F.size("sy"))).select("x", "y").distinct()


def _written(rows: DataFrame, each: int = 100_000) -> DataFrame:
    """A checkpoint, read in partitions of about `each` rows: few rows are no reason for many files in later shuffles."""
    rows = rows.checkpoint()
    return rows.coalesce(max(4, -(-rows.count() // each)))


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("x"), F.greatest(a, b).alias("y")]


def _placed(shared: DataFrame, found: DataFrame) -> DataFrame:
    return shared.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _alike(a: str, b: str, similarity: tuple[int, int]) -> Column:
    """Whether two rows of `shared`, with these endings of their columns' names, pass the length filter and that by few parity bits."""
    num, den = similarity
    n, m = F.col(f"n{a}"), F.col(f"n{b}")
    odd = sum((F.bit_count(F.col(f"{c}{a}").bitwiseXOR(F.col(f"{c}{b}"))) for c in _FEW), F.lit(0))
    return (den * F.least(n, m) >= num * F.greatest(n, m)) & ((num + den) * odd <= (den - num) * (n + m))


def _pivot_pairs(shared: DataFrame, found: DataFrame, turn: int, similarity: tuple[int, int]) -> DataFrame:
    """Members of each bucket of several components with its pivot, where that is in another component.

    The pivot is the member with the largest share of shared elements, a text amid its
    near copies; in odd rounds a hash draws it.
    """
    level = F.round(-16 * F.col("shares") / F.col("n"), 2) if turn % 2 == 0 else F.lit(0.0)
    first = F.struct(level.alias("level"), F.xxhash64("id", F.lit(turn)).alias("draw"), "id", "n", "component", *_FEW)
    placed = _placed(shared, found)
    mixed = placed.groupBy("sh").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.min(first).alias("p")).where("a < b")
    pivots = _written(mixed.select("sh", *[F.col(f"p.{c}").alias(f"{c}2") for c in ("id", "n", "component", *_FEW)]))
    rows = placed.withColumnsRenamed({c: f"{c}1" for c in ("id", "n", "component", *_FEW)}).join(pivots, "sh")
    return rows.where((F.col("component1") != F.col("component2")) & _alike("1", "2", similarity)).select(*_pair(F.col("id1"), F.col("id2"))).distinct()


def _rest_pairs(shared: DataFrame, found: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """All pairs of a bucket in different components that pass the length, positional and parity filters."""
    num, den = similarity
    placed = _placed(shared, found)
    mixed = placed.groupBy("sh").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("sh")
    placed = _written(placed.join(mixed, "sh", "left_semi"))
    names = ("id", "n", "pos", "component", *_FEW)
    # first common element at (pos, pos'): the rest of each set must still hold 4 / 9 of both sizes (for 0.8)
    index = placed.where((num + den) * (F.col("n") - F.col("pos")) >= 2 * num * F.col("n")).select("sh", *[F.col(c).alias(f"{c}2") for c in names])
    rows = placed.select("sh", *[F.col(c).alias(f"{c}1") for c in names])
    need = num * (F.col("n1") + F.col("n2"))
    smaller = (F.col("n2") < F.col("n1")) | ((F.col("n2") == F.col("n1")) & (F.col("id2") < F.col("id1")))
    fits = ((num + den) * (F.col("n2") - F.col("pos2")) >= need) & ((num + den) * (F.col("n1") - F.col("pos1")) >= need)
    across = rows.join(index, "sh").where((F.col("component1") != F.col("component2")) & smaller & fits & _alike("1", "2", similarity))
    return across.select(*_pair(F.col("id1"), F.col("id2"))).distinct()


def _merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components (id, component) after further links; only the components that these join are worked on."""
    labels = found.select("id", F.col("component").alias("c"))
    crossing = links.join(labels.withColumnsRenamed({"id": "x", "c": "cx"}), "x", "left").join(labels.withColumnsRenamed({"id": "y", "c": "cy"}), "y", "left")
    crossing = crossing.select(F.coalesce("cx", "x").alias("x"), F.coalesce("cy", "y").alias("y"))
    joined = connected_components(crossing).select(F.col("id").alias("c"), F.col("component").alias("top"))
    moved = labels.join(joined, "c", "left").select("id", F.coalesce("top", "c").alias("component"))
    return _written(moved.unionByName(joined.select(F.col("c").alias("id"), F.col("top").alias("component"))).distinct())


def near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: tuple[int, int] = SIMILARITY, rounds: int = 2
) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest id reachable by links) of each row.

    Null, empty and wordless texts have no shingles and no links: a component of their
    own. Rows with equal ids are one document, with links to all that any of its texts
    links to; each gives a row. A row without an id gets no component and no links.
    Ids are integers; further columns play no part. An empty table gives an empty one.
    Any number of `rounds` gives the same result.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    small_batches(docs.sparkSession)
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    summaries = _summaries(own, words).checkpoint()
    sketch = _sketch(summaries)
    rows = summaries.where("slice is null").drop("slice")
    key = ["s1", "s2", "n"]
    known = rows.where("n > 0 and id is not null").select("id", *key)
    # written, so that a join can split the rows of a class of very many copies
    copies = _written(known.groupBy(*key).agg(F.min("id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c"))
    members = known.join(copies, key, "left").select("id", F.coalesce("rep", "id").alias("rep"))
    several = members.groupBy("id").agg(F.min("rep").alias("x"), F.max("rep").alias("y"), F.min("id").alias("z"))
    same_id = several.where("x < y").select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("z").alias("x"), "y"))).alias("e")).select("e.x", "e.y").where("x <> y")
    reps = members.where("id = rep").select("id").distinct()

    heads = _prefixes(own.where("id is not null"), sketch, words, similarity).join(reps, "id", "left_semi")
    parts = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    elements = heads.select("id", "n", F.posexplode("prefix").alias("pos", "sh")).select("sh", "id", F.shiftleft("n", 32).bitwiseOR(F.col("pos").cast("long")).alias("np")).repartition(int(parts), "sh")
    order = Window.partitionBy("sh").orderBy("id")
    shared = elements.select("*", F.lag("id").over(order).alias("before"), F.lead("id").over(order).alias("next")).where("coalesce(before, next) is not null")
    shared = _written(shared.select("sh", "id", F.shiftright("np", 32).alias("n"), F.col("np").bitwiseAND(F.lit(0xFFFFFFFF)).alias("pos")))
    traits = rows.select("id", "n", *_FEW).join(shared.groupBy("id", "n").agg(F.count("*").alias("shares")), ["id", "n"]).distinct()
    shared = _written(shared.join(traits, ["id", "n"]))

    links = _written(same_id)
    none = links.select(F.col("x").alias("id"), F.col("y").alias("component")).limit(0)
    found = none if links.isEmpty() else _merged(none, links)
    tested = links.limit(0)
    for turn in range(rounds):
        pairs = _written(_pivot_pairs(shared, found, turn, similarity).join(tested, ["x", "y"], "left_anti"))
        tested = tested.unionByName(pairs)
        new = _written(_verified(_suffix_filter(pairs, rows, similarity), own, words, similarity))
        if new.isEmpty():
            break
        found = _merged(found, new)
    rest = _written(_rest_pairs(shared, found, similarity).join(tested, ["x", "y"], "left_anti"))
    if not rest.isEmpty():
        found = _merged(found, _verified(_suffix_filter(rest, rows, similarity), own, words, similarity))

    return (
        rows.join(copies, key, "left")
        .withColumn("node", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")))
        .join(found.select(F.col("id").alias("node"), "component"), "node", "left")
        .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))
    )
