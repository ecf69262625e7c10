"""Evidence as citations, and as the ranked JSON lines that prompts hold. Missing fields are empty texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.text import shorten

# Characters of text in a prompt, in a citation, in an index line.
PROMPT, CITATION, HINT = 220, 480, 160

#: Output field and the fields that it is taken from, the first that is not empty.
Layout = Sequence[tuple[str, Sequence[str]]]
NORM: Layout = (("chunk_id", ("chunk_id",)), ("standard_code", ("standard_code",)), ("article_id", ("article_id", "related_article_id")), ("title", ("title", "chapter_title", "chapter")), ("requirement_type", ("requirement_type",)))
NORM_INDEX: Layout = (*NORM[:4], ("source", ("standard_name", "source_name", "source")), ("source_path", ("source_path", "asset_path")))
CASE: Layout = (("chunk_id", ("chunk_id",)), ("case_id", ("case_id",)), ("case_title", ("case_title", "title")), ("accident_type", ("accident_type",)), ("source_org", ("source_org", "source")), ("source_date", ("source_date",)))
CASE_INDEX: Layout = (*CASE[:3], ("source", ("source_org", "source")), ("source_path", ("source_path",)))
CASE_WARNING: Layout = (*CASE[:3], ("consequence", ("consequences",)), ("lesson", ("corrective_measures",)), ("source", ("source_org", "source")), ("source_path", ("source_path",)))
CASE_TEXT = ("process", "causes", "consequences", "corrective_measures")


def first_filled(item: Column, names: Sequence[str], known: Sequence[str]) -> Column:
    """The first of the fields that the item has and that is not empty, else an empty text."""
    return F.coalesce(*[F.nullif(item[n].cast("string"), F.lit("")) for n in names if n in known], F.lit(""))


def page_range(first: Column, last: Column) -> Column:
    """first-last, or the one that is known; zero is unknown."""
    return F.concat_ws("-", F.nullif(first.cast("string"), F.lit("0")), F.nullif(last.cast("string"), F.lit("0")))


def item_text(item: Column, known: Sequence[str], parts: Sequence[str] = CASE_TEXT) -> Column:
    """An item's text, else its parts that are not empty, a line each."""
    joined = F.concat_ws("\n", *[F.nullif(item[p].cast("string"), F.lit("")) for p in parts if p in known])
    return F.trim(F.coalesce(F.nullif(first_filled(item, ("text",), known), F.lit("")), joined))


def block(item: Column, known: Sequence[str], layout: Layout, most: int, text: str, rank: Column | None = None) -> Column:
    ranked = [] if rank is None else [rank.alias("rank")]
    return F.struct(*ranked, *[first_filled(item, names, known).alias(out) for out, names in layout], shorten(item_text(item, known), most).alias(text))


def evidence_lines(items: Column, known: Sequence[str], layout: Layout, none: str, most: int = PROMPT, text: str = "text") -> Column:
    """A line of JSON for each item of an array of structs with the fields `known`, ranked from 1; `none` for no items."""
    told = F.transform(items, lambda x, i: F.to_json(block(x, known, layout, most, text, i + 1)))
    return F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, F.lit(none)).otherwise(F.array_join(told, "\n"))


def case_warnings(items: Column, known: Sequence[str], most: int = CITATION) -> Column:
    """Citations of cases that have an id."""
    cited = F.filter(items, lambda x: first_filled(x, ("chunk_id",), known) != "")
    return F.transform(cited, lambda x: F.struct(*[first_filled(x, names, known).alias(out) for out, names in CASE_WARNING], shorten(F.when(first_filled(x, ("text",), known) != "", F.trim(x["text"]) if "text" in known else F.lit("")).otherwise(item_text(x, known, CASE_TEXT[:2])), most).alias("summary")))


def only_ids(citations: Column) -> Column:
    """Citations with their ids alone."""
    return F.transform(citations, lambda c: F.struct(F.coalesce(c["chunk_id"], F.lit("")).alias("chunk_id")))


def diagnostics(mode: Column, norms: Column, cases: Column, available: Column) -> Column:
    """Counts and ids (arrays) of the evidence; a note where there are no cases."""
    n = F.coalesce(F.size(cases), F.lit(0))
    note = F.when(~available, "no index of cases: case evidence must not be made up").when(n <= 0, "no cases found: case evidence must not be made up")
    filled = lambda ids: F.filter(ids, lambda x: x.isNotNull() & (x != ""))
    return F.struct(
        mode.alias("retrieval_mode"), F.coalesce(F.size(norms), F.lit(0)).alias("norm_count"), n.alias("case_count"), filled(norms).alias("norm_evidence_ids"), filled(cases).alias("case_evidence_ids"), available.alias("case_index_available"), note.alias("case_note")
    )
