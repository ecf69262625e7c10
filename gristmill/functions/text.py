"""Text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is replaced in a standard's code, in this order.
CODE_SPELLING = (
    (r"\s+", ""),
    ("—", "-"),
    ("－", "-"),
    ("／", "/"),
    (r"^([A-Za-z]+)/?[Tt]", "$1-T"),
    ("/", "-"),
    (r"^([A-Za-z]+(?:-T)?)(\d)", "$1-$2"),
    (r"-T-(\d)", "-T$1"),
)

#: Runs of ASCII characters that belong to no word.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def tokens(text: Column) -> Column:
    """Lower-cased words, in order; null gives none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def bigrams(text: Column) -> Column:
    """Overlapping character pairs of Han runs, single characters as they are, and lower-cased words of other scripts."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[一-鿿]+|[\p{L}\p{N}&&[^一-鿿]]+"), F.lit(0))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: r.substr(i, F.lit(2)))
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(r"^[一-鿿]{2,}$"), pairs(r)).otherwise(F.array(r))))


def letter_bigrams(text: Column) -> Column:
    """Overlapping pairs of each word's characters; one-letter words as they are."""
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: w.substr(i, F.lit(2)))
    return F.flatten(F.transform(tokens(text), lambda w: F.when(F.length(w) >= 2, pairs(w)).otherwise(F.array(w))))


def normalize(text: Column) -> Column:
    """Ideographic spaces become blanks, blanks are collapsed, at most one empty line stays, ends are trimmed."""
    out = F.regexp_replace(F.replace(text, F.lit("　"), F.lit(" ")), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def join_numbers(text: Column, passes: int = 4) -> Column:
    """Mends article numbers that extraction broke at dots, and the letter o between dots."""
    out = F.regexp_replace(text, r"(\d)\.[ \t]*[oO][ \t]*\.[ \t]*(\d)", "$1.0.$2")
    for _ in range(passes):
        out = F.regexp_replace(out, r"\.[ \t]*\n?[ \t]*(\d)", ".$1")
    return out


def slug(text: Column, length: int = 80) -> Column:
    """Words joined by single dashes, cut; twelve hex digits of a hash where nothing is left."""
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(text), r"\s+", "-"), r"(?U)[^\w\-.]+", "-"), r"-+", "-")
    out = F.regexp_replace(out, r"^-+|-+$", "").substr(1, length)
    return F.coalesce(F.nullif(out, F.lit("")), F.sha2(text, 256).substr(1, 12))


def first_sentence(text: Column, most: int = 120) -> Column:
    """Up to the first full stop or semicolon of a text without white space, else its start."""
    bare = F.regexp_replace(text, r"\s+", "")
    cut = F.lit(None).cast("string")
    for mark in ("；", "。"):
        cut = F.when(F.contains(bare, F.lit(mark)), F.substring_index(bare, mark, 1)).otherwise(cut)
    return F.coalesce(cut, bare.substr(1, most))


def standard_code(raw: Column) -> Column:
    """Codes of standards in one spelling: dashes for blanks and slashes, T before the number."""
    out = raw
    for pattern, to in CODE_SPELLING:
        out = F.regexp_replace(out, pattern, to)
    return F.upper(out)


def iso_date(raw: Column) -> Column:
    """A Chinese date as yyyy-mm-dd; other text trimmed, as it is."""
    pattern = r"(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日"
    part = [F.regexp_extract(raw, pattern, i).try_cast("int") for i in (1, 2, 3)]
    return F.when(raw.rlike(pattern), F.format_string("%04d-%02d-%02d", *part)).otherwise(F.trim(raw))


def first_url(raw: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(raw, r"https?://[^\s\])）]+", 0), F.lit("")), F.trim(raw))


def html_text(html: Column) -> Column:
    """Text of a page: scripts and styles dropped, tags as blanks, entities decoded, white space collapsed."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script.*?>.*?</script>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?is)<style.*?>.*?</style>", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(unescape(out), r"[ \t\n\r]+", " "))


def unescape(text: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&apos;", "'")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def escape(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def token_estimate(text: Column) -> Column:
    n = F.length(text)
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 1.6).cast("int")))


def shorten(text: Column, most: int) -> Column:
    """Cut with three dots where too long."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(text.substr(1, most)), F.lit("..."))).otherwise(text)


def labelled(pairs: Sequence[tuple[str, Column]], between: str = "\n") -> Column:
    """label：value of the values that are not empty."""
    return F.concat_ws(between, *[F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k}："), v)) for k, v in pairs])


def chunk_reference(chunk_id: Column) -> Column:
    """CODE:article of an article's chunk id, the case of a case's, else null."""
    part = F.split(chunk_id, "::")
    is_article = (F.try_element_at(part, F.lit(1)) == "norm") & (F.try_element_at(part, F.lit(3)) == "article") & (F.size(part) >= 4)
    return F.when(is_article, F.concat_ws(":", F.try_element_at(part, F.lit(2)), F.try_element_at(part, F.lit(4)))).when(
        F.try_element_at(part, F.lit(1)) == "case", F.try_element_at(part, F.lit(2))
    )


def any_of(text: Column, needles: Sequence[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(text, F.lit(n))
    return out


def first_match(text: Column, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """Label of the first rule whose needle occurs."""
    out = F.lit(default)
    for needle, label in reversed(rules):
        out = F.when(F.contains(text, F.lit(needle)), F.lit(label)).otherwise(out)
    return out


def ordered_tags(text: Column, rules: Sequence[tuple[str, str]], defaults: Column | None = None) -> Column:
    """Defaults, then tags of all rules whose needle occurs, in rule order, each once."""
    found = F.array_compact(F.array(*[F.when(F.contains(text, F.lit(n)), F.lit(t)) for n, t in rules]))
    return F.array_distinct(found if defaults is None else F.concat(defaults, found))


def packed_paragraphs(text: Column, most: int = 1200) -> Column:
    """A text that fits as it is, trimmed; else its paragraphs put together greedily up to `most` characters.

    A longer paragraph stays whole. An empty text is one empty part. One ordered fold.
    """
    trimmed = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    whole = trimmed(F.coalesce(text, F.lit("")))
    paragraphs = F.filter(F.transform(F.split(whole, r"\n+"), trimmed), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(state: Column, p: Column) -> Column:
        full = (state["open"] != "") & (F.length(state["open"]) + F.length(p) + 1 > most)
        longer = F.concat_ws("\n", F.nullif(state["open"], F.lit("")), p)
        return F.struct(F.when(full, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"]).alias("done"), F.when(full, p).otherwise(longer).alias("open"))

    packed = F.aggregate(paragraphs, start, add, lambda s: F.concat(s["done"], F.array(s["open"])))
    return F.when(F.length(whole) <= most, F.array(whole)).otherwise(packed)
