"""Reading order of recognised words, sections of pages, and explanations, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import first_sentence, standard_code

# What begins an explanation, names its item, and how codes and articles are written.
_MARKS = r"(?=表格说明\d*[:：])|(?=图像说明\d*[:：])|(?=【(?:表|图|公式)[^】]+】)"
_ITEM = r"表\d+(?:\.\d+)*|图[A-Za-z]?\d+(?:\.\d+)*(?:-\d+)?|公式\d+(?:\.\d+)*"
#: Codes such as AB 12-2000, AB/T 12.3-99; and articles behind them.
_CODE = r"[A-Za-z]{2,3}\s*/?\s*[Tt]?\s*\d{2,5}(?:\.\d+)?\s*[-—－]\s*\d{2,4}"
_ARTICLE = r"第?\s*(\d+(?:\.\d+)+)\s*条"


def page_lines(words: Column) -> Column:
    """Text of a page from its words (structs of x, y, h and text).

    Words are taken from top to bottom. One belongs to the open line if it is at most 0.6
    of the larger of the two heights away from the line's height on the page, which moves
    with each word; lines are read from left to right. An empty page gives an empty text.
    """
    clean = F.filter(F.transform(words, lambda w: F.struct(w["y"].alias("y"), w["x"].alias("x"), w["h"].alias("h"), F.trim(w["text"]).alias("t"))), lambda w: w["t"] != "")
    ordered = F.array_sort(clean, lambda a, b: _compare((a["y"], b["y"]), (a["x"], b["x"])))
    line = "array<struct<x:bigint,i:int,t:string>>"
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast(line).alias("open"), F.lit(None).cast("bigint").alias("y"), F.lit(None).cast("bigint").alias("h"))

    def text(words: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(words), lambda w: w["t"]), "")

    def add(state: Column, w: Column) -> Column:
        same = state["y"].isNull() | (F.abs(state["y"] - w["y"]) <= F.greatest(w["h"], state["h"]) * 0.6)
        n = F.size(state["open"])
        item = F.struct(w["x"].cast("bigint").alias("x"), n.alias("i"), w["t"].alias("t"))
        moved = F.coalesce(F.floor((state["y"] * (n + 1) + w["y"]) / (n + 2)), w["y"].cast("bigint"))
        return F.struct(
            F.when(same, state["done"]).otherwise(F.concat(state["done"], F.array(text(state["open"])))).alias("done"),
            F.when(same, F.concat(state["open"], F.array(item))).otherwise(F.array(item.withField("i", F.lit(0)))).cast(line).alias("open"),
            F.when(same, moved).otherwise(w["y"].cast("bigint")).cast("bigint").alias("y"),
            w["h"].cast("bigint").alias("h"),
        )

    end = lambda s: F.array_join(F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(text(s["open"])))).otherwise(s["done"]), "\n")
    return F.coalesce(F.aggregate(ordered, start, add, end), F.lit(""))


def _compare(*pairs: tuple[Column, Column]) -> Column:
    out = F.lit(0)
    for a, b in reversed(pairs):
        out = F.when(a < b, -1).when(a > b, 1).otherwise(out)
    return out


def explanations(text: Column) -> Column:
    """item, title and block of each explanation of a table, figure or formula; those under 20 characters are none."""
    blocks = F.filter(F.transform(F.split(text, _MARKS), lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")), lambda b: (F.length(b) >= 20) & b.rlike(r"^(?:表格说明\d*[:：]|图像说明\d*[:：]|【(?:表|图|公式)[^】]+】)"))
    title = first_sentence
    return F.transform(
        blocks, lambda b: F.struct(F.coalesce(F.nullif(F.regexp_extract(b, _ITEM, 0), F.lit("")), title(b).substr(1, 24)).alias("item"), title(b).substr(1, 120).alias("title"), b.alias("block"))
    )


def case_references(text: Column) -> Column:
    """Laws in 《》, then CODE:article of each article behind a code (the code alone where it has none), each once.

    Semicolons end what a code owns.
    """
    laws = F.regexp_extract_all(text, F.lit("《[^》]+》"), F.lit(0))
    owned = F.flatten(F.transform(F.split(text, "[；;]"), lambda s: F.regexp_extract_all(s, F.lit(f"(?s){_CODE}(?:(?!{_CODE}).)*"), F.lit(0))))

    def refs(part: Column) -> Column:
        code = standard_code(F.regexp_extract(part, _CODE, 0))
        articles = F.regexp_extract_all(part, F.lit(_ARTICLE), F.lit(1))
        return F.when(F.size(articles) == 0, F.array(code)).otherwise(F.transform(articles, lambda a: F.concat_ws(":", code, a)))

    return F.array_distinct(F.concat(laws, F.flatten(F.transform(owned, refs))))


def by_prefix(code: Column, hints: dict[str, list[str]]) -> Column:
    """The hint of the first prefix that the code has, in the order given; none gives an empty array."""
    out = F.array().cast("array<string>")
    for prefix, tags in reversed(list(hints.items())):
        out = F.when(code.startswith(prefix), F.array(*[F.lit(t) for t in tags]).cast("array<string>")).otherwise(out)
    return out


def page_sections(pages: DataFrame, sections: DataFrame, most: int = 10_000) -> DataFrame:
    """doc, section and text of the pages from first to last; pages: doc, page, text; sections: doc, section, first, last.

    Without a doc, sections are those of every document. Each section lists its pages (at
    most `most`, else an error), so the join is on equality. Pages of one number follow
    each other by their text.
    """
    own = [c for c in ("doc",) if c in sections.columns]
    width = F.when(F.col("last") - F.col("first") >= most, F.raise_error(F.lit(f"a section has more than {most} pages"))).otherwise(F.col("last"))
    wanted = sections.where("last >= first").select(*own, "section", F.explode(F.sequence("first", width)).alias("page"))
    found = wanted.join(pages, [*own, "page"]).groupBy("doc", "section").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    return found.select("doc", "section", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))


def chapter(stem: Column) -> Column:
    """Number and title of a file name such as 03_title."""
    return F.struct(F.regexp_extract(stem, r"^(\d+)[_、\s-]*(.+)$", 1).alias("no"), F.coalesce(F.nullif(F.regexp_extract(stem, r"^(\d+)[_、\s-]*(.+)$", 2), F.lit("")), stem).alias("title"))


def source_info(path: Column) -> Column:
    """standard_code, standard_name, year, chapter, chapter_no and chapter_title of a path below the root: CODE[/chapter]/file."""
    parts = F.split(path, "/")
    stem = F.when(F.size(parts) <= 2, F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")).otherwise(F.get(parts, F.lit(1)))
    code, own = F.get(parts, F.lit(0)), chapter(stem)
    return F.struct(
        F.replace(code, F.lit(" "), F.lit("-")).alias("standard_code"),
        F.replace(code, F.lit("-"), F.lit(" ")).alias("standard_name"),
        F.regexp_extract(code, r"(?:19|20)\d{2}", 0).alias("year"),
        F.trim(F.concat_ws(" ", own["no"], own["title"])).alias("chapter"),
        own["no"].alias("chapter_no"),
        own["title"].alias("chapter_title"),
    )
