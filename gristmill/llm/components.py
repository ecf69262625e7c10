"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.textkit import ensure_checkpoint_dir

#: Edges for one partition.
_EDGES = 200_000


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """id and component (its smallest id) of all ends of the edges x, y (longs).

    Edges stay distributed; each round is written to the checkpoint folder. Equal ends
    and nulls are ignored, repeated edges count once. Rounds grow with the logarithm of
    the longest path; not to converge in `max_rounds` is an error.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    now = edges.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().checkpoint()
    state = _state(now)
    parts = max(2, -(-state[0] // _EDGES))  # edges become no more
    now = now.coalesce(parts)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a < b").coalesce(parts).distinct().coalesce(parts)
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), "b"))).alias("e"))
        now = small.select("e.a", "e.b").where("a < b").coalesce(parts).distinct().coalesce(parts).checkpoint()
        state, before = _state(now), state
        if state == before:
            break
    else:
        raise RuntimeError(f"components not found in {max_rounds} rounds")
    roots = now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    return now.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return row[0], row[1]
