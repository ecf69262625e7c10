"""Nearest vectors by inverted lists around trained centroids, with exact ranking of what is probed.

The centroids are fitted on a bounded sample; every vector then goes into the list of its
nearest centroid, so none is left out. A long list is dealt to blocks, so no group grows
with the corpus. A request probes the nearest lists until they hold `num_candidates`
vectors (and `probes` lists at least); all of these are compared exactly. Requests stay
distributed: they are joined with lists, in blocks too. `probes` of all lists is the
exact answer; `operators.retrieval.nearest` is the exact way without an index.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.session import checkpoints
from gristmill.operators.retrieval import DEPTH, TILE, _Best, top_k
from gristmill.sources import versions

#: Vectors that centroids are fitted on, and centroids, at most.
SAMPLE, LISTS = 20_000, 1024
#: Vectors of a list in one block, and requests that meet it at once.
BLOCK, REQUESTS = 8192, 2048
#: Bytes of vectors that a task sends on at once.
SENT = 4 << 20
#: Lists that a request probes at least.
PROBES = 8


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def fit_centroids(items: DataFrame, lists: int | None = None, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Unit centroids by spherical k-means on SAMPLE vectors at most, those whose ids have the smallest hashes; the square root of the corpus as many, if not said."""
    n = items.count()
    lists = max(1, min(LISTS, lists or round(n**0.5)))
    rows = items.orderBy(F.xxhash64("item", F.lit(seed)), "item").limit(SAMPLE).select("vector").collect()  # a bounded sample
    if not rows:
        return np.zeros((0, 0))
    x = _unit(np.array([r[0] for r in rows], np.float64))
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        nearest = np.argmax(x @ centers.T, axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, x)
        empty = np.linalg.norm(sums, axis=1) < 1e-9
        sums[empty] = x[rng.choice(len(x), int(empty.sum()))]
        centers = _unit(sums)
    return centers


def build(items: DataFrame, path: str, lists: int | None = None) -> Lists:
    """Stores items (item, vector) by the list of their nearest centroid, as the newest version at `path`.

    Null items and vectors are left out; repeated rows stay. All vectors have one length.
    """
    spark = items.sparkSession
    known = items.where("item is not null and vector is not null").select("item", F.col("vector").cast("array<double>").alias("vector"))
    centers = fit_centroids(known, lists)
    shared = spark.sparkContext.broadcast(centers)  # LISTS rows at most
    kind = known.schema["item"].dataType.simpleString()

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = np.argmax(_unit(_matrix(batch.column(1))) @ shared.value.T, axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(own), batch.column(0), batch.column(1)], names=["list", "item", "vector"])

    name = f"lists/{uuid.uuid4().hex}"
    schema = f"list int, item {kind}, vector array<double>"
    placed = known.mapInArrow(assign, schema).withColumn("deal", F.pmod(F.xxhash64("item"), F.lit(1 << 20)).cast("int"))
    placed.repartitionByRange("list", "deal").sortWithinPartitions("list", "deal").write.parquet(f"{path}/{name}")
    sizes = {str(r["list"]): r["n"] for r in spark.read.schema(f"{schema}, deal int").parquet(f"{path}/{name}").groupBy("list").agg(F.count("*").alias("n")).collect()}  # LISTS rows at most
    versions.commit(spark, path, {"version": (versions.latest(spark, path) or {}).get("version", 0), "lists": name, "schema": f"{schema}, deal int", "centers": centers.tolist(), "sizes": sizes})
    return Lists(spark, path)


class Lists:
    """The newest version at `path`."""

    def __init__(self, spark: SparkSession, path: str):
        content = versions.latest(spark, path)
        if content is None:
            raise FileNotFoundError(f"no lists at {path}")
        self.spark = spark
        self.centers = np.array(content["centers"], np.float64)
        self.sizes = np.array([content["sizes"].get(str(i), 0) for i in range(len(self.centers))], np.int64)
        self.rows = spark.read.schema(content["schema"]).parquet(f"{path}/{content['lists']}")

    def __len__(self) -> int:
        return int(self.sizes.sum())


def _probed(batch: pa.RecordBatch, centers: np.ndarray, sizes: np.ndarray, least: int, probes: int) -> Iterator[pa.RecordBatch]:
    """request, vector and list of the lists that requests probe; a request's vector goes to each of its lists, so no more than SENT bytes of them are made at once."""
    step, sent = max(1, TILE // max(1, len(centers))), max(1, SENT // (8 * max(1, centers.shape[-1])))
    for cut in (batch.slice(i, step) for i in range(0, batch.num_rows if len(centers) else 0, step)):
        order = np.argsort(-(_unit(_matrix(cut.column(1))) @ centers.T), axis=1, kind="stable")
        held = np.cumsum(sizes[order], axis=1)
        take = (held - sizes[order] < least) | (np.arange(order.shape[1]) < probes)
        which, at = np.nonzero(take & (sizes[order] > 0))
        own = order[which, at].astype(np.int32)
        for i in range(0, len(which), sent):
            some = pa.array(which[i : i + sent])
            yield pa.RecordBatch.from_arrays([cut.column(0).take(some), cut.column(1).take(some), pa.array(own[i : i + sent])], names=["request", "vector", "list"])


def _compared(items: pa.Table, asked: pa.Table, k: int, digits: int) -> pa.Table:
    """request, item and score of the k best items of each request, scored in tiles."""
    names, x = items.column("item").combine_chunks(), _unit(_matrix(items.column("vector")))
    wanted, best = _unit(_matrix(asked.column("vector"))), _Best(asked.num_rows, k, names.type)
    step = max(1, TILE // max(1, len(wanted)))
    for i in range(0, len(x) if len(wanted) else 0, step):
        best.meet(np.round(wanted @ x[i : i + step].T, digits), names.slice(i, step))
    rows = best.rows()
    return pa.table({"request": asked.column("request").take(rows.column(0)), "item": rows.column(1), "score": rows.column(2)})


def nearest(index: Lists, requests: DataFrame, k: int = DEPTH, num_candidates: int | None = None, probes: int = PROBES, digits: int = 6) -> DataFrame:
    """request, item, score (cosine), rank: the best k of the probed lists.

    requests: request, vector, each request once; those without a vector get nothing.
    num_candidates: vectors that a request is compared with at least; max(5 k, 50) if not said.
    """
    spark = index.spark
    checkpoints(spark)
    kinds = {c: t.dataType.simpleString() for c, t in (("request", requests.schema["request"]), ("item", index.rows.schema["item"]))}
    least = max(5 * k, 50) if num_candidates is None else num_candidates
    shared = spark.sparkContext.broadcast((index.centers, index.sizes))  # LISTS rows at most

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _probed(batch, *shared.value, least, probes)

    asked = requests.where("vector is not null").select("request", F.col("vector").cast("array<double>").alias("vector"))
    probed = asked.mapInArrow(probe, f"request {kinds['request']}, vector array<double>, list int").checkpoint()
    load = {r["list"]: r["n"] for r in probed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # LISTS rows at most
    if not load:
        return requests.select("request", F.lit(None).cast(kinds["item"]).alias("item"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    # a list is dealt to blocks of vectors times blocks of requests; each pair of a list meets once
    deals = spark.createDataFrame([(i, -(-int(index.sizes[i]) // BLOCK), -(-n // REQUESTS)) for i, n in load.items()], "list int, of_rows int, of_requests int")
    rows = index.rows.join(F.broadcast(deals), "list").select("list", F.expr("deal % of_rows").alias("a"), F.explode(F.expr("sequence(0, of_requests - 1)")).alias("b"), "item", "vector")
    wanted = probed.join(F.broadcast(deals), "list").select("list", F.explode(F.expr("sequence(0, of_rows - 1)")).alias("a"), F.expr("cast(pmod(xxhash64(request), of_requests) as int)").alias("b"), "request", "vector")

    def best(items: pa.Table, asked: pa.Table) -> pa.Table:
        return _compared(items, asked, k, digits)

    key = ["list", "a", "b"]
    found = rows.groupBy(*key).cogroup(wanted.groupBy(*key)).applyInArrow(best, f"request {kinds['request']}, item {kinds['item']}, score double")
    return top_k(found, k).select("request", "item", "score", "rank")


def probes_for(index: Lists, k: int = DEPTH, target: float = 0.95, sample: int = 100, seed: int = 11) -> int:
    """How many lists a request must probe so that `target` of the nearest k are found, measured on `sample` stored vectors against all lists; PROBES at least."""
    checkpoints(index.spark)
    some = index.rows.orderBy(F.xxhash64("item", F.lit(seed)), "item").limit(sample).select(F.col("item").alias("request"), "vector").dropDuplicates(["request"]).checkpoint()
    exact = nearest(index, some, k, probes=max(1, len(index.centers))).select("request", "item")
    rows = exact.join(index.rows.select("item", "list"), "item").join(some, "request").select("vector", "list").collect()  # sample times k
    if not rows:
        return PROBES
    near = _unit(np.array([r["vector"] for r in rows], np.float64)) @ index.centers.T
    own = near[np.arange(len(rows)), [r["list"] for r in rows]]
    places = np.sort((near > own[:, None]).sum(axis=1))  # lists that are nearer than the one with the neighbour
    return max(PROBES, int(places[int(np.ceil(target * len(places))) - 1]) + 1)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """request, and the share of the exact list's items that were found; both: request, item."""
    hit = exact.select("request", "item").join(found.select("request", "item", F.lit(1).alias("hit")), ["request", "item"], "left")
    return hit.groupBy("request").agg((F.count("hit") / F.count("*")).alias("recall"))
