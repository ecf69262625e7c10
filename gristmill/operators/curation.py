"""From texts to chunks: splitting, duplicates, quality reasons, validation, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos (from 0) and line."""
    return docs.select(key, F.posexplode(F.split(text, r"\n")).alias("pos", "line"))


def split_articles(docs: DataFrame, starts: Column, key: str = "doc_id") -> DataFrame:
    """Blocks that begin where `starts` holds for a line; lines before the first are dropped.

    A running sum of starts within a text numbers its blocks.
    """
    own = Window.partitionBy(key).orderBy("pos")
    numbered = lines(docs, key).withColumn("block", F.sum(starts.cast("long")).over(own)).where("block > 0")
    parts = numbered.groupBy(key, "block").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("parts"))
    return parts.select(key, "block", F.trim(F.array_join(F.transform("parts", lambda p: p["line"]), "\n")).alias("body"))


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines but for those equal to the line before, white space aside; blank lines never count as equal."""
    own = Window.partitionBy(key).orderBy("pos")
    bare = F.regexp_replace("line", r"[ \t\r]+", "")
    return lines(docs, key).withColumn("bare", bare).withColumn("before", F.lag("bare").over(own)).where("before is null or bare <> before or bare = ''").drop("bare", "before")


def first_of_each(rows: DataFrame, key: str | list[str], seq: str) -> DataFrame:
    """The row with the smallest `seq` of each key, by an aggregate that combines before the shuffle."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), seq).alias("kept")).select(*keys, "kept.*")


def rename_collisions(rows: DataFrame, name: str, seq: str, kept_kinds: Column) -> DataFrame:
    """First row of a name stays; later ones of kept kinds get -dup-n, others go."""
    nth = F.row_number().over(Window.partitionBy(name).orderBy(seq))
    out = rows.withColumn("nth", nth).where((F.col("nth") == 1) | kept_kinds)
    return out.withColumn(name, F.when(F.col("nth") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("-dup-"), F.col("nth").cast("string")))).drop("nth")


def resolve_stubs(rows: DataFrame, key: list[str], stub: Column) -> DataFrame:
    """Drops stubs from groups that have a full row, by a join with per-group flags."""
    flags = rows.groupBy(*key).agg(F.max((~stub).cast("int")).alias("full"))
    return rows.join(flags, key).where((F.col("full") == 0) | ~stub).drop("full")


def reasons(checks: Sequence[tuple[str, Column]], rescued: Column | None = None) -> Column:
    """Name of the first check that holds, null for none or for a rescued row."""
    out = F.lit(None).cast("string")
    for name, check in reversed(checks):
        out = F.when(check, F.lit(name)).otherwise(out)
    return out if rescued is None else F.when(rescued, None).otherwise(out)


def reason_report(rows: DataFrame, reason: Column, item: str, samples: int = 30) -> DataFrame:
    """reason, n and the first ids. Samples are ranked after a count by reason, never collected whole."""
    told = rows.select(reason.alias("reason"), item).where("reason is not null")
    counts = told.groupBy("reason").agg(F.count("*").alias("n"))
    first = Window.partitionBy("reason").orderBy(item)
    some = told.withColumn("r", F.row_number().over(first)).where(F.col("r") <= samples).groupBy("reason").agg(F.array_sort(F.collect_list(item)).alias("samples"))
    return counts.join(some, "reason")


def issues(rows: DataFrame, key: str, required: Sequence[str], tags: str | None = None) -> DataFrame:
    """key and issue: missing fields, repeated keys, mock keys, empty tags."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*required)) if required else F.lit(1)
    found = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(f"missing {c}")) for c in required]
    found.append(F.when(F.col("nth") > 1, F.lit("duplicate id")))
    found.append(F.when(F.col(key).cast("string").startswith("mock"), F.lit("mock id")))
    if tags:
        found.append(F.when(F.coalesce(F.size(tags), F.lit(0)) <= 0, F.lit("empty tags")))
    return rows.withColumn("nth", nth).select(key, F.explode(F.array_compact(F.array(*found))).alias("issue"))


def tag_histogram(rows: DataFrame, tags: Column) -> DataFrame:
    return rows.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def carry_over(previous: DataFrame, current: DataFrame, key: str, frozen: Column) -> DataFrame:
    """Current rows, and previous ones of frozen keys that the current build lacks."""
    return current.unionByName(previous.where(frozen).join(current.select(key).distinct(), key, "left_anti"))
