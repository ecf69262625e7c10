"""Which chunks of standards are fit as evidence: a chain of named checks, the first that holds counts.

Allow-lists and codes are rules that the caller gives; those of a library of standards are
hundreds of entries that change with it. All checks are Column expressions, evaluated in
one pass without a join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import any_of
from gristmill.operators.curation import reason_report, reasons

# Words, patterns and codes that decide what the checks find.
NORMATIVE = ("应", "不得", "必须", "严禁", "宜", "不应", "检查", "验收")
HEADING_NORMATIVE = ("应", "必须", "不得", "严禁", "不应", "检查")
PARAMETER_WORDS = ("荷载", "距离", "分级", "半径", "公式", "标准值")
DESIGN_TERMS = ("公式", "计算", "设计值", "标准值", "荷载组合", "截面", "惯性矩", "弹性模量", "抗弯", "挠度", "承载力计算")
DESIGN_SYMBOLS = r"≤|≥|σ|ϕ|λ|\bEI\b|\bkN\b|\bmm\b"
GARBLE = (
    r"十HH|二-HH|二二市|织旭|发E|剖动|主人带|安全者珊|吝诸|人坠落悬挂",
    r"clirect|EPE\)|1\.k|e：这posed|protectiye|naturaJ|electrodε|s\. o\.4|安全火员|接她",
    r"Ais hist|bupfloghypyipt|BAARHER|BERRY|AO GPE|MIRE ME|KX|HOR C|OAR AS|FIED",
    r"FETE|64044L|维修电王|信永|人亚控|防送电|绝缘胶闽|防静蝎|嫩塞|面音|户人Mt|剖应",
    r"[、,\.．]\s*[、,\.．]\s*[、,\.．].{0,30}[、,\.．]\s*[、,\.．]",
)
GARBLE_WITH_TITLE = (
    r"BANS\s*POH|IGF\s*PAY|符人台|HI00|xXx|满蔡|横癌|挠诬",
    r"NV7个|TREE|锡为术架|撑风|涩JJJ|维修寺f1c|操fl人员",
    r"脚于架|脚子架",
    r"[A-Za-z]{2,}\s*[，,]\s*[A-Za-z]{2,}\s*[，,]\s*[A-Za-z]{2,}",
)
PUBLISHER = r"本标准主编|本标准参编|主要起草人员|主要审查人员|出版\s*发行|邮政编码|住房和城乡建设部负责管理|标准编制组经广泛调查研究|根据住房和城乡建设部"
WATERMARKS = r"(?:住房城乡建设部信息公开|浏览专用|\s)+"


@dataclass(frozen=True)
class Allowed:
    """What a managed standard keeps; the other chunks of it go."""

    articles: Sequence[str] = ()
    prefixes: Sequence[str] = ()
    related: Sequence[str] = ()
    keywords: Sequence[str] = ()


@dataclass(frozen=True)
class Design:
    """A standard whose calculations are noise: chapters, article prefixes and articles that go whole."""

    chapters: Sequence[str] = ()
    prefixes: Sequence[str] = ()
    articles: Sequence[str] = ()


@dataclass(frozen=True)
class Rules:
    # The defaults of this class.
    rescued: Sequence[tuple[str, str]] = (("JGJ-T46-2024", "8.1.6"), ("GB-50194-2014", "7.5.4"))
    excluded: Sequence[str] = ("JGJ-196-2010",)
    #: The machinery standard: chapters, article prefixes, and table words of one chapter that stay.
    machinery: str = "JGJ-33-2012"
    machinery_chapters: Sequence[str] = ("01", "02", "04")
    machinery_prefixes: Sequence[str] = ("8.4.", "8.5.")
    machinery_tables: tuple[str, Sequence[str]] = ("08", ("混凝土泵", "泵车", "支腿", "输送管"))
    design: Mapping[str, Design] = field(
        default_factory=lambda: {
            "JGJ-162-2008": Design(chapters=("04", "05")),
            "GB-51210-2016": Design(chapters=("05", "06", "07")),
            "JGJ-130-2011": Design(prefixes=("4.", "5."), articles=("18.4", "6.9.6.9.5")),
        }
    )
    #: By code: articles, and articles that a chunk is related to.
    curated: Mapping[str, Allowed] = field(default_factory=dict)
    managed: Mapping[str, Allowed] = field(default_factory=dict)
    #: Standards whose listed articles stay even if they are as short as a heading, provided that they demand something.
    short_articles: Sequence[str] = ("JGJ-130-2011", "GB-50656-2011")


def _c(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def body(text: Column) -> Column:
    """What follows the first 正文：, else all of it; trimmed."""
    at = F.instr(text, "正文：")
    return F.regexp_replace(F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(text), r"^\s+|\s+$", "")


def compact(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def _starts(value: Column, prefixes: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | value.startswith(p)
    return out


def _unnumbered() -> Column:
    """The body without the article's number at its start."""
    whole = body(_c("text"))
    cut = F.regexp_replace(F.substring(whole, F.length(_c("article_id")) + 1, F.length(whole)), r"^\s+|\s+$", "")
    return F.when((_c("article_id") != "") & F.startswith(whole, _c("article_id")), cut).otherwise(whole)


def _near_heading(words: Sequence[str]) -> Column:
    """Hardly more than number and title, and none of the words."""
    bare, own, title = compact(body(_c("text"))), compact(_c("article_id")), compact(_c("title"))
    return F.startswith(bare, own) & (F.length(bare) <= F.length(own) + F.length(title) + 4) & ~any_of(body(_c("text")), words)


def _is_heading() -> Column:
    return compact(body(_c("text"))) == F.concat(compact(_c("article_id")), compact(_c("title")))


def allowed(rule: Allowed) -> Column:
    words = F.concat_ws(" ", _c("title"), _c("text"))
    return (
        _c("article_id").isin(*rule.articles) | _starts(_c("article_id"), rule.prefixes) | _c("related_article_id").isin(*rule.related) | any_of(words, rule.keywords)
    )


def checks(rules: Rules) -> list[tuple[str, Column]]:
    """(reason, whether it holds), in the order in which they are asked."""
    code, kind, article, chapter_no = _c("standard_code"), _c("chunk_kind"), _c("article_id"), _c("chapter_no")
    numbered = kind.isin("article", "term") & (article != "")
    levels = F.regexp_extract_all(article, F.lit(r"\d+"), F.lit(0))
    text, plain = body(_c("text")), _unnumbered()
    titled = F.concat_ws(" ", _c("title"), text)
    demands = any_of(text, NORMATIVE)

    def matched(value: Column, patterns: Sequence[str]) -> Column:
        return value.rlike("|".join(f"(?:{p})" for p in patterns))

    figures, words = rules.machinery_tables
    machinery_kept = chapter_no.isin(*rules.machinery_chapters) | _starts(article, rules.machinery_prefixes)
    machinery_kept = machinery_kept | (kind.isin("table", "figure", "formula") & (chapter_no == figures) & any_of(F.concat_ws(" ", _c("title"), _c("text")), words))

    about = F.concat_ws(" ", _c("chapter"), titled)
    terms = sum((F.contains(about, F.lit(t)).cast("int") for t in DESIGN_TERMS), F.lit(0))
    noise = F.lit(False)
    for name, d in rules.design.items():
        whole = (kind == "figure") | chapter_no.isin(*d.chapters) | _starts(article, d.prefixes) | article.isin(*d.articles)
        noise = noise | ((code == name) & (whole | (terms >= 3) | (F.regexp_count(about, F.lit(DESIGN_SYMBOLS)) >= 8)))

    listed = F.lit(False)
    for name in rules.short_articles:
        known = [*rules.curated.get(name, Allowed()).articles, *rules.managed.get(name, Allowed()).articles]
        listed = listed | ((code == name) & article.isin(*known))
    section = (kind == "article") & article.rlike(r"^\d+(\.\d+){1,2}$") & ((_is_heading() & ~(listed & demands)) | _near_heading(NORMATIVE))

    curated_gone = managed_gone = F.lit(False)
    for name, rule in rules.curated.items():
        curated_gone = curated_gone | ((code == name) & ~allowed(Allowed(rule.articles, (), rule.related)))
    for name, rule in rules.managed.items():
        managed_gone = managed_gone | ((code == name) & ~allowed(rule))

    stub = F.length(compact(plain))
    return [
        ("standard_not_in_scope", code.isin(*rules.excluded)),
        ("pseudo_article_number", numbered & F.exists(levels, lambda x: F.length(F.ltrim(x, F.lit("0"))) > 2)),
        ("jgj33_section_title", (code == rules.machinery) & (kind == "article") & article.rlike(r"^\d+\.\d+$") & (_is_heading() | _near_heading(HEADING_NORMATIVE))),
        ("jgj33_not_whitelisted", (code == rules.machinery) & ~machinery_kept),
        ("bibliography", F.contains(_c("chapter"), F.lit("参考文献"))),
        ("appendix", F.concat_ws(" ", *[_c(c) for c in ("chunk_id", "chapter", "title", "source_path", "asset_path", "related_article_id")]).rlike(r"附录|(?:图|表|公式)[A-Z]\.")),
        ("whole_chapter_fallback", numbered & article.startswith("ch-")),
        ("malformed_article_id", numbered & (article.rlike(r"^0\.|^[1-9]\.0$|\d{4}") | ((F.size(levels) >= 5) & (F.length(article) > 16)))),
        ("ocr_garble", matched(text, GARBLE)),
        ("preface_or_publisher", F.concat_ws(" ", _c("title"), _c("text")).rlike(PUBLISHER)),
        ("known_ocr_garble_v2", matched(titled, GARBLE_WITH_TITLE)),
        ("formula_design_noise", noise),
        ("contentless_fragment", kind.isin("article", "term") & (F.regexp_count(plain, F.lit("[一-鿿]")) < 2) & ~plain.rlike("[A-Za-z]{3}")),
        ("section_title_stub", numbered & ((stub <= 1) | (~any_of(plain, NORMATIVE) & ((stub <= 16) | ((stub <= 24) & (compact(plain) == compact(_c("title")))))))),
        ("curated_standard_not_whitelisted", curated_gone),
        ("managed_standard_section_title", code.isin(*rules.managed) & section),
        ("managed_standard_not_whitelisted", managed_gone),
    ]


def reason(rules: Rules | None = None) -> Column:
    """Why a chunk goes; null for one that stays. Null fields count as empty."""
    rules = rules or Rules()
    saved = F.lit(False)
    for code, article in rules.rescued:
        saved = saved | ((_c("standard_code") == code) & (_c("article_id") == article))
    return reasons(checks(rules), rescued=saved)


def kept(chunks: DataFrame, rules: Rules | None = None) -> DataFrame:
    return chunks.where(reason(rules).isNull())


def report(chunks: DataFrame, rules: Rules | None = None, samples: int = 30) -> DataFrame:
    """reason, n and the first chunk ids."""
    return reason_report(chunks, reason(rules), "chunk_id", samples)


def by_standard(chunks: DataFrame, rules: Rules | None = None) -> DataFrame:
    """standard_code, kept and excluded of the machinery and the managed standards."""
    rules = rules or Rules()
    seen = chunks.where(F.col("standard_code").isin(rules.machinery, *rules.managed)).select("standard_code", reason(rules).isNull().alias("stays"))
    return seen.groupBy("standard_code").agg(F.count_if("stays").alias("kept"), F.count_if(~F.col("stays")).alias("excluded"))


# Kinds of requirement by the first words that occur.
REQUIREMENTS = (
    ("术语定义", ("术语",)),
    ("禁止行为", ("严禁", "不得")),
    ("强制性要求", ("必须", "应", "不应")),
    ("检查验收", ("检查", "验收")),
    ("试验检测", ("试验", "测试")),
)


def requirement_type(kind: Column, chapter: Column, text: Column) -> Column:
    both = F.concat_ws(" ", F.coalesce(chapter, F.lit("")), text)
    parameters = F.when(any_of(both, PARAMETER_WORDS), "计算参数").otherwise("补充说明")
    out = F.lit("一般要求")
    for label, words in reversed(REQUIREMENTS):
        out = F.when(any_of(both, words), label).otherwise(out)
    return F.when(kind.isin("table", "figure", "formula"), parameters).otherwise(out)


def is_garbled(text: Column) -> Column:
    """Empty, nothing but watermarks, control characters, or too few letters and digits."""
    marked = any_of(text, ("住房城乡建设部信息公开", "浏览专用")) & (F.length(F.regexp_replace(text, WATERMARKS, "")) < 50)
    meaningful = F.regexp_count(text, F.lit(r"[\p{L}\p{N}]"))
    return (F.coalesce(text, F.lit("")) == "") | marked | text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\u0080-\u009F]") | (meaningful < 0.35 * F.length(text))


def is_front_matter(text: Column) -> Column:
    """A blank page, one of at least three dot leaders, or one with more Latin letters than Han characters."""
    leaders = F.regexp_count(text, F.lit(r"[oe.·…]{4,}"))
    return ~F.coalesce(text, F.lit("")).rlike(r"\S") | (leaders >= 3) | (F.regexp_count(text, F.lit("[A-Za-z]")) > F.regexp_count(text, F.lit("[一-鿿]")))
