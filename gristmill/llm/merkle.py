"""A Merkle manifest of a dataset by parent-preimage paths.

Each row is a leaf, the leaves of a group stand in the order of their ids, and every
eight consecutive nodes become one parent until one is left, the group's subroot; the
subroots become the root likewise. A parent's preimage, the concatenated hashes of its
children, is stored with it. A leaf joins the preimages of its ancestors: without its own
64-character slot a preimage is the leaf's siblings, with another hash spliced in there
it is what the parent becomes when the leaf changes.

Nothing holds a group whole: places are counted by ranges, parents gather eight rows, and
a leaf meets its parent, which brings the path above it, in one join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.textkit import ensure_checkpoint_dir

FAN, _WIDTH = 8, 64
#: Counts of rows by range and group that are broadcast (some 60 bytes each); more are joined by a shuffle.
BROADCAST_RANGES = 100_000
_STEPS = "array<struct<preimage:string,slot:bigint>>"


def row_hash(columns: Sequence[Column]) -> Column:
    """Lowercase hex sha256 of the columns one after the other: `-` for null, else the UTF-8 bytes' number, a colon, the value as text."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def places(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Rows with place, from 0 in their group (no nulls) by `order`, and n, the size of the group.

    Rows are dealt to ranges of group and order, which are written, as two readings must
    see the same ones. How many rows a group has in each range is a row for each range
    and group, from which follows where a range goes on.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_at", 33)
    sizes = dealt.groupBy(group, part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(group, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(Window.partitionBy(group)).alias("n")).checkpoint()
    if starts.count() <= BROADCAST_RANGES:
        starts = F.broadcast(starts)
    return dealt.withColumn("_part", part).join(starts, [group, "_part"]).withColumn("place", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


@dataclass
class Tree:
    """levels[k]: tree, place, n (nodes of that level in the tree) and preimage of the parents of level k + 1; roots: tree, hash of each tree's last node."""

    levels: list[DataFrame]
    roots: DataFrame


def grow(nodes: DataFrame) -> Tree:
    """The trees over nodes of tree, place, n, hash; every level is written once."""
    size = nodes.agg(F.max("n")).first()[0] or 0
    now, levels, roots = nodes.select("tree", "place", "n", "hash"), [], nodes.where("n = 1").select("tree", "hash")
    while size > 1:
        runs = now.where("n > 1").groupBy("tree", F.expr(f"place div {FAN}").alias("up"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"))
        children = F.array_sort(F.collect_list(F.struct("place", "hash")))  # FAN at most
        parents = runs.agg(F.array_join(F.transform(children, lambda c: c["hash"]), "").alias("preimage"))
        now = parents.select("tree", F.col("up").alias("place"), "n", "preimage", F.sha2("preimage", 256).alias("hash")).checkpoint()
        levels.append(now.drop("hash"))
        roots = roots.unionByName(now.where("n = 1").select("tree", "hash"))
        size = -(-size // FAN)
    return Tree(levels, roots)


def _under(children: DataFrame, parents: DataFrame | None, tops: DataFrame) -> DataFrame:
    """The children's columns, what `tops` has of their tree, and steps: the preimages and own slots from the parent upward."""
    more = [c for c in tops.columns if c not in ("tree", "steps")]
    last = children.where("n = 1").join(tops, "tree")
    if parents is None:
        return last
    above = parents.select("tree", F.col("place").alias("_up"), F.col("preimage").alias("_preimage"), F.col("steps").alias("_above"), *more)
    met = children.where("n > 1").withColumn("_up", F.expr(f"place div {FAN}")).join(above, ["tree", "_up"])
    own = F.array(F.struct(F.col("_preimage").alias("preimage"), (F.col("place") % FAN).alias("slot"))).cast(_STEPS)
    return met.withColumn("steps", F.concat(own, "_above")).drop("_up", "_preimage", "_above").unionByName(last)


def paths(nodes: DataFrame, tree: Tree, tops: DataFrame) -> DataFrame:
    """The nodes (tree, place, n and others) with their steps, those of `tops` (tree, steps) at the end, and further columns of `tops`."""
    found = None
    for level in reversed(tree.levels):
        found = _under(level, found, tops)
    return _under(nodes, found, tops)


def siblings(steps: Column) -> Column:
    """The hashes beside a leaf and its ancestors, level by level and from left to right, as one text."""
    return F.array_join(F.transform(steps, lambda s: F.concat(_left(s), _right(s))), "")


def fold(leaf: Column, steps: Column) -> Column:
    """The root that follows from a leaf's hash and the siblings on its path."""
    return F.aggregate(steps, leaf, lambda now, s: F.sha2(F.concat(_left(s), now, _right(s)), 256))


def _left(step: Column) -> Column:
    return F.substring(step["preimage"], F.lit(1), (step["slot"] * _WIDTH).cast("int"))


def _right(step: Column) -> Column:
    return F.substring(step["preimage"], ((step["slot"] + 1) * _WIDTH + 1).cast("int"), F.lit(FAN * _WIDTH))


def manifest(docs: DataFrame, *, doc_id: str = "doc_id", group: str = "lang", columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), also: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, group, leaf, subroot, root, steps (preimage and own slot of each ancestor, up to the root) and the columns in `also`.

    Leaves of a group ascend by id, null first; rows with equal ids by their hashes, so
    repeated rows stand side by side. Groups ascend bytewise, a null group first. Nulls in
    other columns enter the hash as `-`. Other columns than those named play no part. A
    lone leaf is its group's subroot, and a lone subroot the root. An empty table gives an
    empty one.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    extra = also or {}
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("-"))  # ascends like the group with null first
    leaves = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), key.alias("tree"), row_hash([F.col(f"`{c}`") for c in columns]).alias("hash"), *[c.alias(f"also_{name}") for name, c in extra.items()]).checkpoint()
    placed = places(leaves, "tree", ["doc_id", "hash"]).checkpoint()
    trees = grow(placed)
    # the subroots are the leaves of one more tree
    subroots = places(trees.roots.select(F.lit("").alias("top"), "tree", "hash"), "top", ["tree"]).withColumnsRenamed({"tree": "group", "top": "tree"}).checkpoint()
    above = grow(subroots)
    none = above.roots.select("tree", F.array().cast(_STEPS).alias("steps"), F.col("hash").alias("root"))
    tops = paths(subroots, above, none).select(F.col("group").alias("tree"), "steps", F.col("hash").alias("subroot"), "root")
    found = paths(placed, trees, tops)
    names = F.when(F.col("tree") != "-", F.expr("substr(tree, 2)")).alias(group)
    return found.select("doc_id", names, F.col("hash").alias("leaf"), "subroot", "root", "steps", *[F.col(f"also_{name}").alias(name) for name in extra])
