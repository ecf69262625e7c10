"""From texts of standards and records of cases to chunks.

All splitting happens within a row, by Column expressions: no line of a text is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import layout, tagging
from gristmill.functions import text as tx
from gristmill.functions.cleaning import UNITS, stripped
from gristmill.functions.session import checkpoints
from gristmill.functions.text import any_of
from gristmill.operators.chunks import Rules, body, is_garbled, kept, requirement_type
from gristmill.operators.curation import first_of_each, rename_collisions

# Units, words of kinds, versions, the standard whose stubs give way, and accidents by the first word that occurs.
_UNIT = UNITS.removeprefix("^")
SCHEMA_VERSION, PIPELINE_VERSION = "norm_v1", "norm_chunker_v2"
STUB_CODE, REPEATABLE = "JGJ-T46-2024", ("table", "figure", "formula")
STUB_VERBS = ("应", "不得", "必须", "严禁", "宜", "不应")
FROZEN = ("JGJ-202-2010",)
#: What begins an article: a number on its own or before its title, which may be on a later line.
#: Numbers keep all their digits, and only line feeds end lines.
STRICT = r"(?mdU)^\s*((?:\d++\.)+\d++)\s+(.+)$"
STRICT_TITLE = rf"(?mdU)^\s*((?:\d++\.)+\d++)\s+(?!\s*{_UNIT})(.+)$"
LOOSE_TITLE = rf"(?mdU)^\s*((?:\d++\.){{2,}}\d++)[\s。．、]*(?![\s。．、]*{_UNIT})(.+)$"
_MARK = "\u0001"
TERM, FORMULA, FIGURE, TABLE = "术语", "公式", "图", "表"
ACCIDENTS = (
    ("坍塌", "坍塌"),
    ("触电", "触电"),
    ("起重伤害", "起重伤害"),
    ("机械伤害", "机械伤害"),
    ("物体打击", "物体打击"),
    ("高处坠落", "高处坠落"),
    ("高坠", "高处坠落"),
    ("坠落", "高处坠落"),
    ("跌落", "高处坠落"),
)
OTHER = "其他"
MOST_TITLE, MOST_PART = 80, 1200


def articles(text: Column) -> Column:
    """article_id, title and body of each article of a text, in order; none gives an empty array.

    An article begins where a line begins with its number, then white space and words; the
    number may stand alone, its title is then the next line that is not blank. Where
    nothing is like that, numbers of three levels or more count without the white space.
    Numbers before a unit measure something and begin none. Text before the first article
    belongs to none. The text is matched in whole passes, so work grows with its length.
    """
    whole = F.replace(F.coalesce(text, F.lit("")), F.lit(_MARK), F.lit(""))
    strict = whole.rlike(STRICT)
    cut = lambda pattern: F.slice(F.split(F.regexp_replace(whole, pattern, f"{_MARK}$0"), _MARK), F.lit(2), F.length(whole) + 1)
    found = lambda pattern: lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("article_id"), stripped(F.regexp_extract(x, pattern, 2)).substr(1, MOST_TITLE).alias("title"), stripped(x).alias("body"))
    return F.when(strict, F.transform(cut(STRICT_TITLE), found(STRICT_TITLE))).otherwise(F.transform(cut(LOOSE_TITLE), found(LOOSE_TITLE)))


def article_kind(chapter: Column, article_id: Column, text: Column) -> Column:
    return F.when(F.contains(F.concat_ws(" ", chapter, article_id, text), F.lit(TERM)), "term").otherwise("article")


def explanation_kind(item: Column, title: Column, path: Column) -> Column:
    """By item and title: formula before figure before table; then by the file's and its folder's name too; else a supplement."""
    near = F.array_join(F.slice(F.reverse(F.split(path, "/")), 1, 2), " ")
    own, whole = F.concat_ws(" ", item, title), F.concat_ws(" ", item, title, near)
    out = F.when(F.lit(False), "")
    for where in (own, whole):
        for word, kind in ((FORMULA, "formula"), (FIGURE, "figure"), (TABLE, "table")):
            out = out.when(F.contains(where, F.lit(word)), kind)
    return out.otherwise("supplement")


def related_article(text: Column) -> Column:
    """The first article number of a text, or null."""
    return F.nullif(F.regexp_extract(text, r"第?((?:\d+\.)+\d+)[条款]?", 1), F.lit(""))


def header_text(name: Column, chapter: Column, item: Column, body: Column) -> Column:
    """What is indexed: standard, chapter, number (if there is one) and body, a line each."""
    number = F.when(F.coalesce(item, F.lit("")) != "", F.concat(F.lit("编号："), item))
    return F.concat_ws("\n", F.concat(F.lit("标准："), F.coalesce(name, F.lit(""))), F.concat(F.lit("章节："), F.coalesce(chapter, F.lit(""))), number, F.concat(F.lit("正文："), body))


#: From the standard's code, the article's number and a text to the text with the recognition errors of single standards put right.
Repair = Callable[[Column, Column, Column], Column]
CHUNK = (
    "schema_version string, doc_type string, chunk_id string, chunk_kind string, standard_name string, standard_code string, year string, source_name string, source_path string, source string, chapter string, chapter_no string, chapter_title string, "
    "article_id string, page_start int, page_end int, title string, text string, scenario_tags array<string>, hazard_tags array<string>, requirement_type string, asset_path string, related_article_id string, content_hash string, pipeline_version string"
)
_INFO = ("standard_code", "standard_name", "chapter", "chapter_no", "chapter_title", "source_path", "year", "asset_path")


def _info(docs: DataFrame) -> DataFrame:
    """docs with the columns that tell where a text is from; an absent year or asset is null."""
    return docs.withColumns({c: F.lit(None).cast("string") for c in ("year", "asset_path") if c not in docs.columns})


def _finished(rows: DataFrame, taxonomy: tagging.Taxonomy, repair: Repair | None) -> DataFrame:
    """Chunks, and seq (their place in the file), of rows with the columns of _INFO, kind, item_id, title, article_id, related_article_id, body and seq."""
    if repair:
        rows = rows.withColumns({c: repair(F.col("standard_code"), F.col("article_id"), F.col(c)) for c in ("title", "body")})
    combined = F.concat_ws(" ", "standard_code", "chapter", "title", "body")
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    number = F.coalesce(filled("article_id"), filled("title"), filled("item_id"))
    rows = rows.withColumn("text", header_text(F.col("standard_name"), F.col("chapter"), number, tx.normalize(F.col("body"))))
    rows = rows.withColumn("scenarios", tagging.scenario_tags(combined, taxonomy, F.col("standard_code")))
    rows = rows.withColumn("hazards", tagging.hazard_tags(combined, F.col("scenarios"), taxonomy, F.col("standard_code")))
    tags = tagging.or_fallback(F.col("scenarios"), F.col("hazards"), taxonomy)
    item = tx.slug(F.coalesce(filled("item_id"), filled("title"), F.lit("chunk")))
    made = {
        "schema_version": F.lit(SCHEMA_VERSION), "doc_type": F.lit("norm"), "chunk_id": F.concat_ws("::", F.lit("norm"), "standard_code", "kind", item), "chunk_kind": F.col("kind"), "source_name": F.col("standard_name"), "source": F.col("standard_name"),
        "chapter_no": filled("chapter_no"), "chapter_title": filled("chapter_title"), "article_id": filled("article_id"), "page_start": F.lit(None).cast("int"), "page_end": F.lit(None).cast("int"), "scenario_tags": tags["scenarios"], "hazard_tags": tags["hazards"],
        "requirement_type": requirement_type(F.col("kind"), F.col("chapter"), F.col("body")), "content_hash": F.sha2(F.concat_ws("|", "text", F.coalesce("source_path", F.lit("")), F.lit(SCHEMA_VERSION)), 256), "pipeline_version": F.lit(PIPELINE_VERSION),
    }
    names = [c.split(" ")[0] for c in CHUNK.split(", ")]
    # a generator of one row: filters above read its columns, else each would compute texts and tags anew
    whole = F.struct(*[made.get(c, F.col(c)).alias(c) for c in names], "seq")
    return rows.select(F.explode(F.array(whole)).alias("c")).select("c.*")


def _made(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """withColumn by a generator of one row: filters above, also those that Spark infers for arrays that are exploded, read the column and neither compute it anew nor move below an exchange."""
    return rows.select("*", F.explode(F.array(F.struct(value.alias("v")))).alias("_made")).select(*rows.columns, F.col("_made.v").alias(name))


def _stem() -> Column:
    return F.regexp_extract("source_path", r"([^/]*?)(?:\.[^./]*)?$", 1)


def _article_rows(docs: DataFrame, taxonomy: tagging.Taxonomy | None, repair: Repair | None) -> DataFrame:
    text = tx.normalize(tx.join_numbers(F.col("text")))
    title = F.coalesce(F.nullif(F.col("chapter_title"), F.lit("")), _stem())
    number = F.coalesce(F.nullif(F.col("chapter_no"), F.lit("")), F.lit("x"))
    rows = _made(_made(_info(docs), "whole", text).where("whole <> ''"), "found", articles(F.col("whole")))
    chapter = F.array(F.struct(F.concat_ws("-", F.lit("ch"), number, title).alias("article_id"), title.alias("title"), F.col("whole").alias("body")))
    rows = rows.select(*_INFO, F.posexplode(F.when(F.size("found") > 0, F.col("found")).otherwise(chapter)).alias("nth", "a")).where(~is_garbled(F.col("a.body")))
    rows = _made(rows, "parts", tx.packed_paragraphs(F.col("a.body"), MOST_PART))
    rows = rows.select(*_INFO, "nth", "a", "parts", F.posexplode("parts").alias("at", "body"))
    item = F.when(F.size("parts") > 1, F.concat(F.col("a.article_id"), F.lit("-part-"), F.col("at") + 1)).otherwise(F.col("a.article_id"))
    kind = article_kind(F.col("chapter"), F.col("a.article_id"), F.col("body"))
    rows = rows.select(*_INFO, kind.alias("kind"), item.alias("item_id"), F.col("a.title").alias("title"), F.col("a.article_id").alias("article_id"), F.lit(None).cast("string").alias("related_article_id"), "body", F.struct("nth", "at").alias("seq"))
    return _finished(rows, taxonomy or tagging.Taxonomy(), repair)


def _explanation_rows(docs: DataFrame, taxonomy: tagging.Taxonomy | None, repair: Repair | None) -> DataFrame:
    rows = _info(docs).withColumn("whole", tx.normalize(F.col("text"))).where("whole <> ''").withColumn("found", layout.explanations(F.col("whole")))
    alone = F.array(F.struct(F.lit("").alias("item"), _stem().alias("title"), F.col("whole").alias("block")))
    rows = rows.select(*_INFO, F.posexplode(F.when(F.size("found") > 0, F.col("found")).otherwise(alone)).alias("nth", "e"))
    item = F.when(F.col("e.item") != "", F.col("e.item")).otherwise(F.concat(F.lit("item-"), F.col("nth") + 1))
    rows = rows.select(
        *_INFO, explanation_kind(F.col("e.item"), F.col("e.title"), F.col("source_path")).alias("kind"), item.alias("item_id"), F.coalesce(F.nullif(F.col("e.title"), F.lit("")), item).alias("title"),
        F.lit(None).cast("string").alias("article_id"), related_article(F.concat_ws(" ", "e.title", "e.block")).alias("related_article_id"), F.col("e.block").alias("body"), F.struct("nth", F.lit(0).alias("at")).alias("seq"),
    )
    return _finished(rows, taxonomy or tagging.Taxonomy(), repair)


def article_chunks(docs: DataFrame, taxonomy: tagging.Taxonomy | None = None, repair: Repair | None = None) -> DataFrame:
    """Chunks (the columns of CHUNK) of texts: one for each article, or each part of a long one, which -part-N names.

    docs: standard_code, standard_name, chapter, chapter_no, chapter_title, source_path,
    text, and year and asset_path where there are any. Numbers that extraction broke are
    mended first. A text without articles is one chapter. Blank texts and garbled articles
    give none; repeated rows give repeated chunks. A part is indexed under its article's number.
    """
    return _article_rows(docs, taxonomy, repair).drop("seq")


def explanation_chunks(docs: DataFrame, taxonomy: tagging.Taxonomy | None = None, repair: Repair | None = None) -> DataFrame:
    """Chunks of explanations of tables, figures and formulas; docs as for article_chunks.

    A text without marked explanations is one, named by its file; one without a name of
    its own is item-N, by its place, and indexed under its title.
    """
    return _explanation_rows(docs, taxonomy, repair).drop("seq")


def heading_stub() -> Column:
    """Whether an article of STUB_CODE is hardly more than a heading: short, no demand, no sentence."""
    whole = body(F.col("text"))
    plain = F.when(F.startswith(whole, F.col("article_id")), stripped(F.substring(whole, F.length("article_id") + 1, F.length(whole)))).otherwise(whole)
    short = (F.length(plain) <= 16) & ~any_of(plain, (*STUB_VERBS, "。", "："))
    return (F.col("standard_code") == STUB_CODE) & ~F.col("chunk_kind").isin(*REPEATABLE) & (F.coalesce("article_id", F.lit("")) != "") & short


def norm_chunks(
    files: DataFrame, taxonomy: tagging.Taxonomy | None = None, rules: Rules | None = None, repair: Repair | None = None, previous: DataFrame | None = None, frozen: Sequence[str] = FROZEN
) -> DataFrame:
    """From texts of files to the chunks that are indexed: split, carried over, filtered, without stubs, each content once, ids unique.

    files: what article_chunks reads, and explains (whether a file explains tables and
    figures; null: no). previous: chunks of an earlier build; those of frozen standards
    stay where no file gives any. Of equal contents (text, path and version) the first by path
    and place stays; of equal ids too, but tables, figures and formulas get -dup-N.
    """
    explains = F.coalesce("explains", F.lit(False))
    place = lambda rows: rows.withColumn("seq", F.struct(F.lit(0).alias("late"), F.coalesce("source_path", F.lit("")).alias("path"), F.col("seq.nth").alias("nth"), F.col("seq.at").alias("at"), F.col("chunk_id").alias("id")))
    checkpoints(files.sparkSession)
    # written once, as carrying over, stubs and duplicates all read it
    raw = place(_article_rows(files.where(~explains), taxonomy, repair).unionByName(_explanation_rows(files.where(explains), taxonomy, repair))).checkpoint()
    if previous is not None:
        codes = raw.select("standard_code").distinct()
        old = previous.where(F.col("standard_code").isin(*frozen)).join(codes, "standard_code", "left_anti")
        raw = raw.unionByName(old.withColumn("seq", F.struct(F.lit(1).alias("late"), F.coalesce("source_path", F.lit("")).alias("path"), F.lit(0).alias("nth"), F.lit(0).alias("at"), F.col("chunk_id").alias("id"))).checkpoint())
    filtered = kept(raw, rules).withColumn("_stub", heading_stub())
    full = filtered.where((F.col("standard_code") == STUB_CODE) & ~F.col("_stub") & ~F.col("chunk_kind").isin(*REPEATABLE) & F.col("article_id").isNotNull()).select("chunk_id").distinct()
    whole = filtered.where("not _stub").unionByName(filtered.where("_stub").join(full, "chunk_id", "left_anti")).drop("_stub")
    once = first_of_each(whole, "content_hash", "seq")
    named = rename_collisions(once, "chunk_id", "seq", F.col("chunk_kind").isin(*REPEATABLE))
    return named.select(*[c.split(" ")[0] for c in CHUNK.split(", ")])


def accident_type(title: Column, process: Column) -> Column:
    return tx.first_match(F.concat_ws(" ", title, process), ACCIDENTS, OTHER)


def case_chunks(cases: DataFrame, taxonomy: tagging.Taxonomy | None = None) -> DataFrame:
    """A summary of each case, and its causes where it tells any.

    cases: number, title, fields (a map of text by label), path. Absent fields are empty
    texts in texts, and null in columns of their own.
    """
    taxonomy = taxonomy or tagging.Taxonomy()
    f = lambda label: F.coalesce(F.col("fields").getItem(label), F.lit(""))
    title, process, place, direct, indirect, hurt, loss, org, violated = F.col("title"), f("事故经过"), f("地点"), f("直接原因"), f("间接原因"), f("伤亡情况"), f("直接经济损失"), f("来源"), f("违反规范")
    date, kind = tx.iso_date(f("时间")), accident_type(F.col("title"), f("事故经过"))
    filled = lambda label, v: F.when(v != "", F.concat(F.lit(f"{label}："), v))
    line = lambda pairs, between: F.nullif(tx.labelled(pairs, between), F.lit(""))
    summary = F.concat_ws(
        "\n", F.concat(F.lit("案例："), title), line([("类型", kind), ("日期", date)], " | "), filled("地点", place), filled("经过", process), line([("伤亡", hurt), ("损失", loss)], " | "), filled("违反规范", violated), filled("来源", org)
    )
    cause = F.concat_ws("\n", F.concat(F.lit("案例："), title, F.lit("（原因）")), filled("直接原因", direct), filled("间接原因", indirect))
    causes = tx.labelled([("直接原因", direct), ("间接原因", indirect)], "；")
    words = F.concat_ws(" ", title, place, process, direct, indirect, violated)
    null = F.lit(None).cast("string")
    case_id = F.format_string("case-%02d", F.col("number"))
    chunk = lambda name, text, told, why, cost: F.struct(F.concat_ws("::", F.lit("case"), case_id, F.lit(name)).alias("chunk_id"), F.lit(f"case_{name}").alias("chunk_kind"), told.alias("process"), why.alias("causes"), cost.alias("consequences"), text.alias("text"))
    first = chunk("summary", summary, F.nullif(process, F.lit("")), null, line([("伤亡", hurt), ("直接经济损失", loss)], "；"))
    rows = cases.withColumn("scenarios", tagging.scenario_tags(words, taxonomy))
    rows = rows.withColumn("hazards", tagging.hazard_tags(words, F.col("scenarios"), taxonomy))
    tags = tagging.or_fallback(F.col("scenarios"), F.col("hazards"), taxonomy)
    rows = rows.select(
        F.explode(F.array_compact(F.array(first, F.when(causes != "", chunk("cause", cause, null, causes, null))))).alias("c"), case_id.alias("case_id"), title.alias("case_title"), kind.alias("accident_type"),
        tags["scenarios"].alias("scenario_tags"), tags["hazards"].alias("hazard_tags"), F.nullif(place, F.lit("")).alias("location"), F.coalesce(layout.case_references(violated), F.array().cast("array<string>")).alias("related_standards"),
        F.nullif(org, F.lit("")).alias("source_org"), F.nullif(date, F.lit("")).alias("source_date"), F.nullif(tx.first_url(f("原文链接")), F.lit("")).alias("source_url"), F.col("path").alias("source_path"),
    )
    return rows.select("c.*", *rows.columns[1:], F.sha2("c.text", 256).alias("content_hash"))


def case_report(chunks: DataFrame, most: int = 1800) -> DataFrame:
    """One row: chunks, cases, chunks by kind and by accident, tags, cases without references, repeated ids, chunks over `most` characters.

    Counts by kind, accident and tag are maps sorted by key. Each is counted before it is
    gathered, and there are few of them.
    """
    case, refs = F.coalesce("case_id", F.lit("?")), F.coalesce(F.size("related_standards"), F.lit(0)) > 0
    whole = chunks.agg(F.count("*").alias("chunk_count"), F.countDistinct(case).alias("case_count"), (F.count("*") - F.countDistinct("chunk_id")).alias("duplicate_chunk_id_count"), F.count_if(F.length("text") > most).alias("oversized_chunk_count"))
    cases = chunks.groupBy("case_id").agg(F.max(refs).alias("has")).agg(F.count_if(~F.col("has") & F.col("case_id").isNotNull()).alias("cases_without_related_standards"))
    out = whole.crossJoin(F.broadcast(cases))  # one row each
    counted = {
        "by_chunk_kind": chunks.select(F.coalesce(F.nullif(F.col("chunk_kind"), F.lit("")), F.lit("unknown")).alias("k")),
        "by_accident_type": chunks.where("coalesce(accident_type, '') <> ''").select(F.col("accident_type").alias("k")),
        "tag_distribution": chunks.select(F.explode(F.concat("scenario_tags", "hazard_tags")).alias("k")),
    }
    for name, keys in counted.items():
        sizes = keys.groupBy("k").agg(F.count("*").alias("n"))
        out = out.crossJoin(F.broadcast(sizes.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name))))  # one row each
    return out
