"""Gold tasks from cases: verified references, demands of articles, proxy articles, running ids, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.cleaning import clause, stripped
from gristmill.functions.session import checkpoints
from gristmill.operators import retrieval

# Words of demands, lengths of clauses, codes and articles in free text.
DEMANDS = "必须|严禁|禁止|不得|不应|应当|应|宜"
LEAST, LEAST_ALONE = 8, 12
CODE = r"(?:JGJ|GB)\s*/?\s*-?\s*(T)?\s*([0-9]+(?:\.[0-9]+)?)"
NUMBER = r"第\s*[0-9]+(?:\.[0-9]+)+\s*条|(?<![0-9.])[0-9]+\.[0-9]+(?:\.[0-9]+)*(?![0-9.])"


def demands(text: Column, most: int = 2, words: str = DEMANDS, ends: str = "[。；]+", body: str = r"(?s)正文：?\s*(.*)$") -> Column:
    """The first clauses that demand something, cleaned; else the first long one; else none.

    Clauses end with full stops and semicolons alone, as line feeds are no ends of them.
    """
    told = F.when(text.rlike(body), F.regexp_extract(text, body, 1)).otherwise(F.coalesce(text, F.lit("")))
    told = F.regexp_replace(stripped(told), r"^\d+(?:\.\d+)+\s*", "")
    clauses = F.transform(F.split(told, ends), clause)
    found = F.filter(clauses, lambda c: (F.length(c) >= LEAST) & c.rlike(words))
    return F.when(F.size(found) > 0, F.slice(found, 1, most)).otherwise(F.slice(F.filter(clauses, lambda c: F.length(c) >= LEAST_ALONE), 1, 1))


def core_code(code: Column) -> Column:
    """What stands between the first two dashes of a code: 80 of AB-80-2016, T46 of AB-T46-2024."""
    return F.get(F.split(code, "-"), F.lit(1))


def verified_refs(texts: DataFrame, library: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """key and refs: CODE:article of all codes and all articles that a text names, as far as the library holds them; sorted.

    library: standard_code, article_id. A code in a text is known by its core, with its T
    and without it; of several codes with one core the last by name counts. Texts without such references have an empty array; a null text too.
    """
    known = library.where("standard_code is not null and article_id is not null").select("standard_code", F.trim("article_id").alias("article")).distinct()
    named = library.where("standard_code is not null").select("standard_code", core_code(F.col("standard_code")).alias("core")).distinct()
    named = named.select("standard_code", F.explode(F.array_distinct(F.array("core", F.ltrim("core", F.lit("T"))))).alias("core"))
    named = named.groupBy("core").agg(F.max("standard_code").alias("standard_code"))
    whole = F.regexp_extract_all(text, F.lit(CODE), F.lit(0))
    cores = F.flatten(F.transform(whole, lambda m: F.array(F.concat(F.regexp_extract(m, CODE, 1), F.regexp_extract(m, CODE, 2)), F.regexp_extract(m, CODE, 2))))
    numbers = F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda m: F.regexp_extract(m, r"[0-9]+(?:\.[0-9]+)+", 0))
    rows = texts.select(key, F.array_distinct(cores).alias("cores"), F.array_distinct(numbers).alias("numbers"))
    codes = rows.select(key, F.explode("cores").alias("core")).join(named, "core").select(key, "standard_code").distinct()
    found = codes.join(rows.select(key, F.explode("numbers").alias("article")), key).join(known, ["standard_code", "article"], "left_semi")
    refs = found.groupBy(key).agg(F.array_sort(F.collect_set(F.concat_ws(":", "standard_code", "article"))).alias("refs"))
    return texts.select(key).join(refs, key, "left").withColumn("refs", F.coalesce("refs", F.array().cast("array<string>")))


def proxy_articles(requests: DataFrame, items: DataFrame, terms: Callable[[Column], Column], k: int = 2) -> DataFrame:
    """The k best articles within the code that a request names: request, item, score, rank.

    requests: request, code, text; items: item, code, text. The statistics are those of all
    items: df of a term counts it in every code, as a filter leaves them alone.
    """
    return retrieval.bm25(items, requests, terms, k, within="code")


def running_ids(rows: DataFrame, group: str, order: str, out: str = "nth", parts: int = 64) -> DataFrame:
    """Rows with their place in their group, from 1, by `order`, which must have no ties.

    Rows are dealt to ranges of `order`; counts of each group in each range give every
    range the place to go on from, so that one task never holds a whole group. The ranges
    are written to the checkpoint folder, as two readings must see the same ones.
    """
    checkpoints(rows.sparkSession)
    dealt = rows.repartitionByRange(parts, order).withColumn("\u0001part", F.spark_partition_id()).checkpoint()
    sizes = dealt.groupBy(group, "\u0001part").agg(F.count("*").alias("\u0001n"))
    before = F.coalesce(F.sum("\u0001n").over(Window.partitionBy(group).orderBy("\u0001part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(group, "\u0001part", before.alias("\u0001before"))
    place = F.row_number().over(Window.partitionBy(group, "\u0001part").orderBy(order))
    return dealt.join(starts, [group, "\u0001part"]).withColumn(out, place + F.col("\u0001before")).drop("\u0001part", "\u0001before")


def skipped_report(tasks: DataFrame, skipped: Column, theme: str = "theme", key: str = "id", samples: int = 30) -> DataFrame:
    """what ('theme' or 'skipped'), name, n and the first ids: tasks by theme, and those left out by reason (null: kept)."""
    rows = tasks.select(F.when(skipped.isNull(), "theme").otherwise("skipped").alias("what"), F.coalesce(skipped, F.col(theme)).alias("name"), key)
    counts = rows.groupBy("what", "name").agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy("what", "name").orderBy(key))
    some = rows.withColumn("r", first).where(F.col("r") <= samples).groupBy("what", "name").agg(F.array_sort(F.collect_list(key)).alias("ids"))
    return counts.join(some, ["what", "name"])
