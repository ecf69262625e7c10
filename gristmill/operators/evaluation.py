"""Retrieval metrics and paired statistics."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import text
from gristmill.operators import retrieval

#: Up to so many differences Wilcoxon's p is counted, not approximated.
EXACT = 50


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 for an empty whole."""
    return F.when(F.coalesce(whole, F.lit(0)) > 0, part / whole).otherwise(F.lit(0.0))


def ir_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """request, recall, hit, mrr and ndcg at k. ranked: request, rank, item; relevant: request, item (those without relevant items score 0)."""
    pairs = relevant.select("request", "item").distinct()
    met = ranked.join(pairs.withColumn("met", F.lit(True)), ["request", "item"], "left")
    return _ir_scores(met, pairs.groupBy("request").agg(F.count("*").alias("size")), k)


def ir_metrics_by_class(ranked: DataFrame, requests: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """What ir_metrics gives where the items of a request's class are relevant; requests: request, class; items: item, class, one class each (null: none).

    Only ranked items meet classes, and sizes are those of classes: no pair of a request and a relevant item is made.
    """
    held, asked = items.select("item", "class").distinct(), requests.select("request", F.col("class").alias("own")).distinct()
    met = ranked.join(held, "item", "left").join(asked, "request", "left").withColumn("met", F.col("class") == F.col("own"))
    sizes = held.where("class is not null").groupBy(F.col("class").alias("own")).agg(F.count("*").alias("size"))
    return _ir_scores(met, asked.join(sizes, "own").select("request", "size"), k)


def _ir_scores(met: DataFrame, size: DataFrame, k: int) -> DataFrame:
    """met: request, rank and met (true where the item is relevant); size: request and how many items are relevant to it."""
    hit, near = F.coalesce("met", F.lit(False)), F.col("rank") <= k
    per = met.groupBy("request").agg(
        F.sum((hit & near).cast("int")).alias("found"), F.min(F.when(hit, F.col("rank"))).alias("first"), F.sum(F.when(hit & near, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("size", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    found = F.col("found")
    return per.join(size, "request", "left").select(
        "request",
        F.round(share(found, F.col("size")), 6).alias("recall"),
        F.when(found > 0, 1.0).otherwise(0.0).alias("hit"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.when(F.col("size") > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0), 6).alias("ndcg"),
    )


def finite(value: str) -> Column:
    """Whether a number is neither null, NaN nor infinite."""
    return F.abs(F.col(value).cast("double")) < F.lit(float("inf"))  # NaN is above infinity


def summary(rows: DataFrame, group: str, value: str) -> DataFrame:
    """n, mean, sd (0 for one row), median and quartiles of each group; NaN and infinite values are left out."""
    v = F.when(finite(value), F.col(value))
    return rows.groupBy(group).agg(
        F.count(v).alias("n"),
        F.round(F.avg(v), 6).alias("mean"),
        F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), 6).alias("sd"),
        F.round(F.median(v), 6).alias("median"),
        F.round(F.percentile(v, F.lit(0.25)), 6).alias("q1"),
        F.round(F.percentile(v, F.lit(0.75)), 6).alias("q3"),
    )


def cliffs_delta(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(greater - less) / all pairs of values for each two groups, x before y.

    Counts of each value are summed first; running sums over the values replace pairs.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    names = counts.select(F.col(group).alias("x")).distinct()
    pairs = names.join(names.withColumnRenamed("x", "y"), F.col("x") < F.col("y"))
    both = pairs.join(counts.withColumnRenamed(group, "x").withColumnRenamed("c", "cx"), "x").withColumn("cy", F.lit(0)).select("x", "y", value, "cx", "cy")
    both = both.unionByName(pairs.join(counts.withColumnRenamed(group, "y").withColumnRenamed("c", "cy"), "y").withColumn("cx", F.lit(0)).select("x", "y", value, "cx", "cy"))
    level = both.groupBy("x", "y", value).agg(F.sum("cx").alias("cx"), F.sum("cy").alias("cy"))
    below = F.sum("cy").over(Window.partitionBy("x", "y").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    sums = level.withColumn("below", F.coalesce(below, F.lit(0))).groupBy("x", "y").agg(
        F.sum(F.col("cx") * F.col("below")).alias("greater"), F.sum(F.col("cx") * F.col("cy")).alias("equal"), F.sum("cx").alias("nx"), F.sum("cy").alias("ny")
    )
    all_pairs = F.col("nx") * F.col("ny")
    return sums.select("x", "y", F.round((2 * F.col("greater") + F.col("equal") - all_pairs) / all_pairs, 6).alias("delta"))


def signed_rank(pairs: DataFrame, by: list[str], diff: Column) -> DataFrame:
    """Wilcoxon statistic: the lesser of the rank sums of positive and negative differences; zeros dropped, ties share ranks.

    Ranks come from counts of each absolute difference, not from single rows.
    """
    rows = pairs.select(*by, diff.alias("d")).where("d <> 0")
    levels = rows.groupBy(*by, F.abs("d").alias("a")).agg(F.count("*").alias("c"), F.sum((F.col("d") > 0).cast("int")).alias("up"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(*by).orderBy("a").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = levels.withColumn("rank", before + (F.col("c") + 1) / 2)
    sums = ranked.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("plus"), F.sum(F.col("rank") * (F.col("c") - F.col("up"))).alias("minus"))
    return sums.select(*by, "n", F.round(F.least("plus", "minus"), 6).alias("w"))


def _two_sided(n: int, zeros: int, w: float, ties: float) -> float:
    """p of Wilcoxon's statistic w of n differences: exact up to 50 without zeros and ties, else normal (no continuity correction)."""
    if not n:
        return 1.0
    if n <= EXACT and not zeros and not ties:
        ways = [1] + [0] * int(w)  # of reaching each rank sum
        for rank in range(1, n + 1):
            for at in range(len(ways) - 1, rank - 1, -1):
                ways[at] += ways[at - rank]
        return min(1.0, 2 * sum(ways) / 2**n)
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return math.erfc(abs(w - n * (n + 1) / 4) / spread / math.sqrt(2))


def wilcoxon(pairs: DataFrame, by: list[str], diff: Column) -> DataFrame:
    """signed_rank with the two-sided p; a group whose differences are all 0 (within 1e-8) has w 0 and p 1."""
    rows = pairs.select(*by, diff.cast("double").alias("d")).where("d is not null")
    size = rows.groupBy(*by).agg(F.count_if(F.col("d") == 0).alias("zeros"), F.max(F.abs("d")).alias("most"))
    levels = rows.where("d <> 0").groupBy(*by, F.abs("d").alias("a")).agg(F.count("*").cast("double").alias("c"))
    ties = levels.groupBy(*by).agg(F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("ties"))
    flat = F.col("most") <= 1e-8
    p = F.udf(_two_sided, "double")(F.col("n").cast("int"), F.col("zeros").cast("int"), "w", "ties")
    out = size.join(signed_rank(rows, by, F.col("d")), by, "left").join(ties, by, "left")
    out = out.withColumns({"n": F.when(flat, 0).otherwise(F.col("n")).cast("long"), "w": F.when(flat, 0.0).otherwise(F.col("w")), "ties": F.coalesce("ties", F.lit(0.0))})
    return out.select(*by, "n", "w", p.alias("p"))


def generation(runs: DataFrame) -> DataFrame:
    """The deterministic metrics of each run; sets are arrays, null is an empty one.

    runs: run, variant; cited_refs (CODE:article, may repeat), cited_norms and cited_cases
    (chunk ids, may repeat), links (for each norm cited, the case it comes from or null);
    norms and cases (chunk ids retrieved); hazards; gold_refs, gold_cases, gold_hazards.
    """
    names = ("cited_refs", "cited_norms", "cited_cases", "links", "norms", "cases", "hazards", "gold_refs", "gold_cases", "gold_hazards")
    a = {n: F.coalesce(F.col(n), F.array()) for n in names}
    among = lambda part, whole: F.size(F.filter(part, lambda x: F.array_contains(whole, x)))
    known = lambda kind, ids: F.array_compact(F.transform(F.filter(ids, lambda x: F.startswith(x, F.lit(f"{kind}::"))), text.chunk_reference))
    covered = lambda gold, got: share(F.size(F.array_intersect(gold, got)), F.size(F.array_distinct(gold)))
    cited = F.size(a["cited_norms"]) + F.size(a["cited_cases"])
    grounded = share(among(a["cited_norms"], a["norms"]) + among(a["cited_cases"], a["cases"]), cited)
    linked = share(F.size(F.filter(a["links"], lambda x: F.coalesce(x != "", F.lit(False)))), F.size(a["links"]))
    rates = {
        "norm_citation_validity": share(among(a["cited_refs"], a["gold_refs"]), F.size(a["cited_refs"])),
        "grounding_rate": grounded,
        "hallucination_rate": F.when(cited > 0, 1 - grounded).otherwise(0.0),
        "hazard_coverage": covered(a["gold_hazards"], a["hazards"]),
        "case_relevance": covered(a["gold_cases"], known("case", a["cited_cases"])),
        "norm_recall": covered(a["gold_refs"], known("norm", a["norms"])),
        "case_recall": covered(a["gold_cases"], known("case", a["cases"])),
        "link_resolution_rate": F.when(F.col("variant") == "proposed", linked).otherwise(0.0),
    }
    return runs.select("run", *[F.round(c, 6).alias(n) for n, c in rates.items()])


def link_resolution(refs: DataFrame, articles: DataFrame) -> DataFrame:
    """Of the references of cases (case_id, ref) those that articles (ref) hold: one row of counts and their rate."""
    found = refs.join(articles.select("ref").distinct().withColumn("hit", F.lit(True)), "ref", "left")
    out = found.agg(F.countDistinct("case_id").alias("cases"), F.countDistinct(F.when(F.col("hit"), F.col("case_id"))).alias("cases_with_resolved_refs"), F.count("ref").alias("total_refs"), F.count("hit").alias("resolved_refs"))
    return out.withColumn("resolution_rate", F.round(share(F.col("resolved_refs"), F.col("total_refs")), 4))


def holm(rows: DataFrame, family: list[str], p: str, key: str) -> DataFrame:
    """Holm's step-down adjusted p within each family; null p stays out and null."""
    order = Window.partitionBy(*family).orderBy(F.col(p).asc_nulls_last(), key)
    m = F.count(p).over(Window.partitionBy(*family))
    step = rows.withColumn("step", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col(p))))
    return step.withColumn("p_holm", F.when(F.col(p).isNotNull(), F.max("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("step")


def bootstrap(rows: DataFrame, group: str, value: str, draws: int = 10_000, seed: int = 7) -> DataFrame:
    """Mean and 95 % interval by the Poisson bootstrap: each row counts a Poisson(1) number of times in each draw.

    Rows of a group with the same value count together, by a Poisson(count) number that a
    hash of group and value seeds. Each task sums the draws of one group at a time in a
    vector, so that neither rows times draws nor a group is gathered.
    """
    levels = rows.groupBy(group, value).agg(F.count("*").alias("c"))
    keyed = levels.select(group, F.col(value).cast("double").alias("v"), "c", F.xxhash64(F.lit(seed), group, value).alias("key")).sortWithinPartitions(group)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.schema([("total", pa.list_(pa.float64())), ("times", pa.list_(pa.float64()))])
        made = lambda name, total, times: pa.RecordBatch.from_arrays([name, pa.array([total], names.types[0]), pa.array([times], names.types[1])], names=[group, *names.names])
        now, total, times = None, np.zeros(draws), np.zeros(draws)
        for batch in batches:
            for i, (v, c, key) in enumerate(zip(*(batch.column(n).to_pylist() for n in (1, 2, 3)))):
                name = batch.column(0).slice(i, 1)
                if now is None or not now.equals(name):
                    if now is not None:
                        yield made(now, total, times)
                    now, total, times = name, np.zeros(draws), np.zeros(draws)
                if v is not None:
                    n = np.random.Generator(np.random.Philox(key=key % (1 << 64))).poisson(c, draws)
                    total += n * v
                    times += n
        if now is not None:
            yield made(now, total, times)

    kind = keyed.schema[group].dataType.simpleString()
    sums = keyed.mapInArrow(run, f"`{group}` {kind}, total array<double>, times array<double>")
    drawn = sums.select(group, F.posexplode(F.arrays_zip("total", "times")).alias("draw", "s"))
    means = drawn.groupBy(group, "draw").agg(F.try_divide(F.sum("s.total"), F.sum("s.times")).alias("mean"))
    return means.groupBy(group).agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"), F.count("mean").alias("draws"))


def means(rows: DataFrame, group: str, metrics: Sequence[str], digits: int = 4) -> DataFrame:
    """n_tasks and the mean of each metric (name_mean) of each group; nulls are left out."""
    return rows.groupBy(group).agg(F.count("*").alias("n_tasks"), *[F.round(F.avg(m), digits).alias(f"{m}_mean") for m in metrics])


def ir_means(per_request: DataFrame, metrics: Sequence[str] = ("recall", "hit", "mrr", "ndcg"), digits: int = 4) -> DataFrame:
    """One row: requests, and the mean of each metric; 0 without requests."""
    return per_request.agg(F.count("*").alias("evaluated"), *[F.round(F.coalesce(F.avg(m), F.lit(0.0)), digits).alias(m) for m in metrics])


def case_gold(cases: DataFrame, chunks: DataFrame, most: int = 400) -> DataFrame:
    """case_id, query, hazard_tags, expected (sorted chunk ids), total_refs and resolved_refs: one row of each case.

    cases: case_id, chunk_id, chunk_kind, process, text, case_title, hazard_tags,
    related_standards; its summary counts, else the chunk with the smallest id. chunks:
    item, standard_code, article_id.
    """
    place = F.struct((F.col("chunk_kind") != "case_summary").cast("int"), "chunk_id")
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    one = F.struct(F.coalesce(filled("process"), filled("text"), filled("case_title"), F.lit("")).alias("query"), "hazard_tags", "related_standards")
    chosen = cases.groupBy("case_id").agg(F.min_by(one, place).alias("c"))
    refs = F.array_distinct(F.filter("c.related_standards", lambda r: F.contains(r, F.lit(":")) & ~F.startswith(r, F.lit("《"))))
    rows = chosen.select("case_id", F.substring(F.trim("c.query"), 1, most).alias("query"), "c.hazard_tags", F.coalesce(refs, F.array().cast("array<string>")).alias("refs"))
    found = retrieval.by_refs(rows.select(F.col("case_id").alias("request"), F.explode("refs").alias("ref")), chunks)
    expected = found.groupBy(F.col("request").alias("case_id")).agg(F.array_sort(F.collect_set("item")).alias("expected"))
    out = rows.join(expected, "case_id", "left").withColumn("expected", F.coalesce("expected", F.array().cast(expected.schema["expected"].dataType)))
    return out.select("case_id", "query", "hazard_tags", "expected", F.size("refs").alias("total_refs"), F.size("expected").alias("resolved_refs"))


def _compared(pairs: DataFrame, by: list[str], scope: str, level: float = 0.05) -> DataFrame:
    """Means, Wilcoxon, Cliff's delta, Holm's p over all comparisons of a metric, and whether that is below `level`; pairs: by, left, right."""
    pairs = pairs.where("left is not null and right is not null")
    sizes = pairs.groupBy(*by).agg(F.count("*").alias("n_pairs"), *[F.round(F.avg(c), 6).alias(f"{c}_mean") for c in ("left", "right")], F.round(F.avg(F.col("left") - F.col("right")), 6).alias("mean_delta"))
    tests = wilcoxon(pairs, by, F.col("left") - F.col("right")).drop("n")
    sides = pairs.select(*by, F.explode(F.array(F.struct(F.col("left").alias("v"), F.lit(1).alias("l"), F.lit(0).alias("r")), F.struct(F.col("right").alias("v"), F.lit(0).alias("l"), F.lit(1).alias("r")))).alias("s"))
    levels = sides.groupBy(*by, F.col("s.v").alias("v")).agg(F.sum("s.l").alias("l"), F.sum("s.r").alias("r"))
    below = F.coalesce(F.sum("r").over(Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    above = F.sum("r").over(Window.partitionBy(*by)) - below - F.col("r")
    n = F.sum("l") * F.sum("r")
    deltas = levels.withColumns({"below": below, "above": above}).groupBy(*by).agg(F.round(F.sum(F.col("l") * (F.col("below") - F.col("above"))) / n, 6).alias("cliffs_delta"))
    out = sizes.join(tests, by).join(deltas, by).withColumn("scope", F.lit(scope)).withColumn("\u0001key", F.concat_ws("\u0001", *[F.col(b).cast("string") for b in by]))
    return holm(out, ["scope", "metric"], "p", "\u0001key").drop("\u0001key").withColumn("significant", F.coalesce(F.col("p_holm") < level, F.lit(False)))


def within_datasets(rows: DataFrame) -> DataFrame:
    """Each group of a dataset against its reference (full of ablations, proposed of variants), paired by task.

    rows: dataset, family, grp, task, metric, value, one for each of them; a dataset
    without its reference gives none.
    """
    reference = F.when(F.col("family") == "ablation", "full").otherwise("proposed")
    key = ["dataset", "family", "task", "metric"]
    left = rows.where(F.col("grp") == reference).select(*key, F.col("grp").alias("reference"), F.col("value").alias("left"))
    right = rows.where(F.col("grp") != reference).select(*key, F.col("grp").alias("comparison"), F.col("value").alias("right"))
    return _compared(left.join(right, key), ["dataset", "family", "metric", "reference", "comparison"], "within_dataset")


def between_datasets(rows: DataFrame, order: str = "dataset") -> DataFrame:
    """The same groups of two datasets of a family, the earlier by `order` on the left, paired by task; rows as for within_datasets."""
    key = ["family", "grp", "task", "metric"]
    side = lambda name: rows.select(*key, F.col("dataset").alias(f"{name}_dataset"), F.col(order).alias(f"{name}_order"), F.col("value").alias(name))
    pairs = side("left").join(side("right"), key).where("left_order < right_order")
    return _compared(pairs, ["family", "metric", "grp", "left_dataset", "right_dataset"], "between_dataset")


def summary_with_interval(rows: DataFrame, group: str, value: str, draws: int = 10_000) -> DataFrame:
    """summary with the ends of the bootstrap's 95 % interval of the mean; a null group is one of its own."""
    ends = bootstrap(rows.where(finite(value)), group, value, draws).select(F.col(group).alias("\u0001g"), F.round("low", 6).alias("ci95_low"), F.round("high", 6).alias("ci95_high"))
    sums = summary(rows, group, value)
    return sums.join(ends, sums[group].eqNullSafe(F.col("\u0001g")), "left").drop("\u0001g")


def unmatched(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Values of one side only: side ('missing' from the left, 'extra' on it) and the value, once each."""
    a, b = left.select(column).distinct(), right.select(column).distinct()
    return b.exceptAll(a).select(F.lit("missing").alias("side"), column).unionByName(a.exceptAll(b).select(F.lit("extra").alias("side"), column))
