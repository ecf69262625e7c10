"""Cleaning of recognised text as Column expressions: lines, pages, blocks and substitutions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Units behind a number that is no article's, marks that close a line, banners, and words of a block's kind.
UNITS = r"^(?:mm|cm|km|kV|kA|mA|kVA|kW|kN|MPa|Hz|min|kg|m[²2³]?|[VAWgsth]|°C|℃)(?![A-Za-z])"
CLOSING = "。；：、，)]”》"
BANNERS = ("住房城乡建设部信息公开", "浏览专用", "标准分享网 www.bzfxw.com 免费下载", "www.bzfxw.com", "免费 下载")
MEASURES = r"GB|JGJ|NB/T|mm|m/s|kV|kN|N\b"
ARTICLE = r"(?:\d+\.)+\d+"
HEADING = r"^(?:\d+(?:\.\d+)*\.?\s+.+|Abstract|Keywords|CRediT authorship contribution statement|Declaration of Competing Interest|Acknowledgments|Data availability)$"
RUNNING = ("Contents lists available at", "journal homepage:")


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def starts_with_unit(text: Column) -> Column:
    """Whether a text behind a number begins with a unit, so that the number measures something."""
    return stripped(text).rlike(UNITS)


def substituted(text: Column, pairs: Sequence[tuple[str, str]] | Mapping[str, str]) -> Column:
    """All pairs replaced one after the other, as plain strings, in their order."""
    for wrong, right in pairs.items() if isinstance(pairs, Mapping) else pairs:
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return text


def substituted_by(text: Column, key: Column, maps: Mapping[str, Sequence[tuple[str, str]] | Mapping[str, str]]) -> Column:
    """Texts with the substitutions of their key (a standard's code); other keys change nothing."""
    out = text
    for name, pairs in maps.items():
        out = F.when(key == name, substituted(text, pairs)).otherwise(out)
    return out


def overridden(rows: DataFrame, overrides: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Rows whose `column` gives way to that of the override with equal keys, if there is one. Of several, the smallest counts."""
    one = overrides.groupBy(*keys).agg(F.min(column).alias("\u0001new"))
    return rows.join(one, list(keys), "left").withColumn(column, F.coalesce("\u0001new", column)).drop("\u0001new").select(*rows.columns)


def without_banners(text: Column) -> Column:
    """Watermarks and banners gone, runs of blanks and of empty lines shortened, ends trimmed."""
    out = substituted(text, [(b, "") for b in BANNERS])
    return stripped(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def is_watermark_only(text: Column) -> Column:
    """Whether nothing but watermarks and white space is on a page."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(住房城乡建设部信息公开|浏览专用|\s)+", "") == ""


def is_meaningful(text: Column) -> Column:
    """Whether a page has at least 30 Han characters and 80 letters and digits, banners aside."""
    clean = without_banners(F.coalesce(text, F.lit("")))
    return (F.regexp_count(clean, F.lit("[一-鿿]")) >= 30) & (F.regexp_count(clean, F.lit(r"[\p{L}\p{N}]")) >= 80)


def page_report(pages: DataFrame, code: str = "code", text: str = "text") -> DataFrame:
    """pages, text_pages and watermark_only_pages of each code."""
    t = F.col(text)
    return pages.groupBy(code).agg(F.count("*").alias("pages"), F.count_if(is_meaningful(t)).alias("text_pages"), F.count_if(is_watermark_only(t)).alias("watermark_only_pages"))


def without_latin_lines(text: Column) -> Column:
    """Lines that are mostly Latin letters go, unless they hold a measure or a code; lines of digits alone become empty."""
    lines = F.transform(F.split(F.regexp_replace(text, r"(?m)^\s*\d+\s*$", ""), r"\r?\n"), stripped)

    def stays(line: Column) -> Column:
        han, latin = F.regexp_count(line, F.lit("[一-鿿]")), F.regexp_count(line, F.lit("[A-Za-z]"))
        return ~((han == 0) & (latin >= 8)) & ~((han <= 2) & (latin > F.greatest(F.lit(12), han * 6)) & ~line.rlike(MEASURES))

    return F.concat(stripped(F.regexp_replace(F.array_join(F.filter(lines, stays), "\n"), r"\n{3,}", "\n\n")), F.lit("\n"))


def lines_for_articles(text: Column) -> Column:
    """One line for each sentence that recognition broke.

    A line that begins with a closing mark is part of the line before. A line that is an
    article's number alone is followed by the next one. A number that touches its text
    gets a blank behind it, and one whose last digit stands apart is put together.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), stripped), lambda x: x != "")
    whole = F.concat(F.lit("\n"), F.array_join(lines, "\n"))
    whole = F.regexp_replace(whole, rf"(?<=[^\n])\n(?=[{CLOSING.replace(']', chr(92) + ']')}])", "")
    whole = F.regexp_replace(whole, rf"(?<=\n)({ARTICLE})\n(?={ARTICLE}(?:\n|$))", "$1\u0001\n")
    whole = F.regexp_replace(whole, rf"(?<=\n)({ARTICLE})\n", "$1 ")
    whole = F.regexp_replace(F.replace(whole, F.lit("\u0001\n"), F.lit("\n")), r"^\n", "")
    for _ in range(2):
        whole = F.regexp_replace(whole, rf"(?m)^({ARTICLE}) (\d) ", "$1$2 ")
    return F.regexp_replace(whole, rf"(?m)^({ARTICLE})(?=[^\d\s.])", "$1 ")


def unhyphenated(text: Column) -> Column:
    """One line: soft hyphens gone, words that a line's end broke put together, white space collapsed."""
    out = F.replace(F.replace(text, F.lit("­"), F.lit("")), F.lit("−"), F.lit("-"))
    out = F.regexp_replace(F.regexp_replace(out, r"(?U)(?<=\w)-\n(?=\w)", ""), r"[ \t]*\n[ \t]*", " ")
    return stripped(F.regexp_replace(out, r"\s+", " "))


def is_skipped_block(text: Column, running: Sequence[str] = RUNNING) -> Column:
    """Whether a block of a page is empty, a page number, or begins like a running title; those of a journal are the caller's."""
    out = (F.coalesce(text, F.lit("")) == "") | text.rlike(r"^\d+$")
    for start in running:
        out = out | F.startswith(text, F.lit(start))
    return out


def blocks(pages: DataFrame, doc: str = "doc", running: Sequence[str] = RUNNING) -> DataFrame:
    """id, page, type and text of a document's blocks (doc, page, pos, text) up to the page of its references.

    Blocks are cleaned, and cut before the word References; the first page with that word
    is the last. Skipped blocks have no id. Ids number the others from S001 on.
    """
    t, own = F.col("text"), Window.partitionBy(doc).orderBy("page", "pos")
    clean = pages.select(doc, "page", "pos", unhyphenated(t).alias("text"))
    last = F.min(F.when(t.rlike(r"\bReferences\b"), F.col("page"))).over(Window.partitionBy(doc))
    kept = clean.withColumn("last", last).where("last is null or page <= last")
    kept = kept.withColumn("text", F.when(t.rlike(r"\bReferences\b"), stripped(F.regexp_extract("text", r"(?s)^(.*?)\bReferences\b", 1))).otherwise(t)).where(~is_skipped_block(t, running))
    kind = F.when(t.startswith("Fig. ") | t.startswith("Figure "), "figure_caption").when(t.startswith("Table "), "table_or_caption").when(t.rlike(HEADING) & (F.length(t) < 120), "heading").otherwise("text")
    return kept.select(doc, F.format_string("S%03d", F.row_number().over(own)).alias("id"), "page", kind.alias("type"), "text")


def clause(text: Column) -> Column:
    """A clause without quotes, asterisks, white space and commas at its start."""
    out = F.regexp_replace(F.regexp_replace(text, "[”“’‘*]", ""), r"\s+", "")
    return F.regexp_replace(out, "^[,，、]+", "")
