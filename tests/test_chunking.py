import hashlib
import time

import pytest
from pyspark.sql import functions as F

from gristmill.functions import cleaning
from gristmill.operators import chunking, evaluation, evidence, retrieval, tasks
from gristmill.sources import sinks


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("前言\n1.1 总则\n续行\n 1.2  要求 \n", [("1.1", "总则", "1.1 总则\n续行"), ("1.2", "要求", "1.2  要求")]),
        ("1.1 甲\n2.5 mm 的导线\n1.2 乙", [("1.1", "甲", "1.1 甲\n2.5 mm 的导线"), ("1.2", "乙", "1.2 乙")]),
        ("1.0.1为了\n1.2也\n1.0.2。应当", [("1.0.1", "为了", "1.0.1为了\n1.2也"), ("1.0.2", "应当", "1.0.2。应当")]),
        ("1.0.1为了\n3.1 严格", [("3.1", "严格", "3.1 严格")]),  # one strict start ends the looser rule
        ("3.1\n应当检查全部设备\n3.2 其他要求", [("3.1", "应当检查全部设备", "3.1\n应当检查全部设备"), ("3.2", "其他要求", "3.2 其他要求")]),  # a number alone
        ("3.1\n\n 3.2 总则\n3.3 其他", [("3.1", "3.2 总则", "3.1\n\n 3.2 总则"), ("3.3", "其他", "3.3 其他")]),  # the next line is the title, whatever it is
        ("3.1 甲\n2.55\nmm 线\n3.2 乙", [("3.1", "甲", "3.1 甲\n2.55\nmm 线"), ("3.2", "乙", "3.2 乙")]),
        ("1.0.1为\n1.0.12mm线\n1.0.2、应", [("1.0.1", "为", "1.0.1为\n1.0.12mm线"), ("1.0.2", "应", "1.0.2、应")]),
        ("1.1 a\u2028b\r\n1.2 c", [("1.1", "a\u2028b", "1.1 a\u2028b"), ("1.2", "c", "1.2 c")]),  # line feeds alone end lines
        ("1.1 \u0001甲", [("1.1", "甲", "1.1 甲")]),
        ("没有条文", []),
        ("2.5 mm 导线", []),
        ("", []),
        (None, []),
    ],
)
def test_articles(spark, text, wanted):
    assert [tuple(x) for x in one(spark, text, chunking.articles)] == wanted


def test_titles_are_cut_at_eighty(spark):
    assert len(one(spark, "1.1 " + "字" * 100, chunking.articles)[0]["title"]) == 80


DOC = "standard_code string, standard_name string, chapter string, chapter_no string, chapter_title string, source_path string, text string"


def test_article_chunks(spark):
    long = "\n".join("应当检查" * 50 for _ in range(9))
    rows = [
        ("GB-1", "GB 1", "03 临边", "03", "临边", "GB-1/03_临边.docx", f"3.1 一般\n临边必须防护\n3.2 多\n{long}"),
        ("GB-2", "GB 2", "附", "", "", "GB-2/说明.docx", "没有编号的一章，严禁烟火"),
        ("GB-3", "GB 3", "x", "", "", "a", " \n "),
        ("GB-4", "GB 4", "x", "", "", "a", None),
    ]
    got = {r["chunk_id"]: r for r in chunking.article_chunks(spark.createDataFrame(rows, DOC)).collect()}
    assert sorted(got) == ["norm::GB-1::article::3.1", "norm::GB-1::article::3.2-part-1", "norm::GB-1::article::3.2-part-2", "norm::GB-2::article::ch-x-说明"]
    first = got["norm::GB-1::article::3.1"]
    assert first["text"] == "标准：GB 1\n章节：03 临边\n编号：3.1\n正文：3.1 一般\n临边必须防护" and first["article_id"] == "3.1" and first["requirement_type"] == "强制性要求"
    assert first["scenario_tags"] == ["高处作业"] and first["hazard_tags"] == ["高处坠落"]
    assert got["norm::GB-2::article::ch-x-说明"]["requirement_type"] == "禁止行为"
    assert chunking.article_chunks(spark.createDataFrame([], DOC)).count() == 0


CASES = [
    # path, code, text, explains
    ("GB-1/01_总则.pdf", "GB-1", "1. 0. 1 总则应当遵守\n1.0.\n2 要求必须满足全部条件", False),
    ("GB-1/02_重复.pdf", "GB-1", "1.0.1 总则应当遵守", False),  # the same words in another file
    ("GB-1/图表/说明.docx", "GB-1", "表格说明1：表3.1给出了安全网的规格和尺寸要求，见第4.2.1条。", True),
    ("GB-1/图表/说明2.docx", "GB-1", "表格说明1：表3.1给出了安全网的其他规格和尺寸。", True),
    ("JGJ-T46-2024/08_a.pdf", "JGJ-T46-2024", "8.1.4 架空线路的边线与在建工程之间应保持安全操作距离", False),
    ("JGJ-T46-2024/07_b.pdf", "JGJ-T46-2024", "8.1.4 条的有关规定执行情况一览", False),  # a stub with the same number, in an earlier file
    ("GB-2/x.pdf", "GB-2", "", False),
]


def files(spark, rows=CASES):
    df = spark.createDataFrame([(p, c, c.replace("-", " "), "章", "", "", t, e, None, "2024") for p, c, t, e in rows], "source_path string, standard_code string, standard_name string, chapter string, chapter_no string, chapter_title string, text string, explains boolean, asset_path string, year string")
    return df.repartition(3)


def test_numbers_that_extraction_broke_and_what_is_indexed(spark):
    got = {(r["source_path"], r["article_id"]): r for r in chunking.article_chunks(files(spark).where("not explains")).collect()}
    assert got["GB-1/01_总则.pdf", "1.0.1"]["text"] == "标准：GB 1\n章节：章\n编号：1.0.1\n正文：1.0.1 总则应当遵守" and ("GB-1/01_总则.pdf", "1.0.2") in got
    a, b = got["GB-1/01_总则.pdf", "1.0.1"], got["GB-1/02_重复.pdf", "1.0.1"]
    assert a["text"] == b["text"] and a["content_hash"] != b["content_hash"]
    assert a["content_hash"] == hashlib.sha256(f"{a['text']}|GB-1/01_总则.pdf|norm_v1".encode()).hexdigest()
    assert (a["schema_version"], a["doc_type"], a["year"], a["chapter_no"], a["page_start"], a["pipeline_version"]) == ("norm_v1", "norm", "2024", None, None, "norm_chunker_v2")
    assert ", ".join(f"{n} {t}" for n, t in chunking.article_chunks(files(spark)).dtypes) == chunking.CHUNK
    parts = chunking.article_chunks(files(spark, [("p.pdf", "C", "3.2 多\n" + "\n".join("应当检查" * 50 for _ in range(9)), False)])).collect()
    assert len(parts) > 1 and all("编号：3.2\n" in r["text"] and "-part-" in r["chunk_id"] for r in parts)
    odd = chunking.explanation_chunks(files(spark, [("图集/说明 一.docx", "C", "一段没有标记的说明文字", True), ("深/图/下/说明.docx", "C", "一段没有标记的说明文字", True)])).collect()
    assert sorted((r["chunk_kind"], r["chunk_id"], r["title"]) for r in odd) == [("figure", "norm::C::figure::item-1", "说明 一"), ("supplement", "norm::C::supplement::item-1", "说明")]
    assert all("编号：" + r["title"] in r["text"] for r in odd)
    fixed = chunking.article_chunks(files(spark, [("p.pdf", "C", "3.2 铟网应当检查", False)]), repair=lambda code, article, text: F.when((code == "C") & (article == "3.2"), F.replace(text, F.lit("铟"), F.lit("钢"))).otherwise(text)).first()
    assert fixed["title"] == "钢网应当检查" and "正文：3.2 钢网" in fixed["text"]


def test_norm_chunks_in_one_plan(spark):
    old = chunking.article_chunks(files(spark, [("JGJ-202-2010/1.pdf", "JGJ-202-2010", "5.1.1 旧的条文应当保留下来", False), ("GB-9/1.pdf", "GB-9", "5.1.1 旧的条文应当保留下来", False)]))
    done = chunking.norm_chunks(files(spark, CASES + CASES[:1]), previous=old)
    got = sorted((r["chunk_id"], r["source_path"]) for r in done.collect())
    assert got == [
        ("norm::GB-1::article::1.0.1", "GB-1/01_总则.pdf"),
        ("norm::GB-1::article::1.0.2", "GB-1/01_总则.pdf"),
        ("norm::GB-1::table::表3.1", "GB-1/图表/说明.docx"),
        ("norm::GB-1::table::表3.1-dup-2", "GB-1/图表/说明2.docx"),
        ("norm::JGJ-202-2010::article::5.1.1", "JGJ-202-2010/1.pdf"),
        ("norm::JGJ-T46-2024::article::8.1.4", "JGJ-T46-2024/08_a.pdf"),
    ]
    fresh = chunking.norm_chunks(files(spark, [("JGJ-202-2010/2.pdf", "JGJ-202-2010", "6.1.1 新的条文应当代替旧的", False)]), previous=old)
    assert [r["article_id"] for r in fresh.collect()] == ["6.1.1"]
    assert chunking.norm_chunks(files(spark, CASES[:1]).limit(0)).collect() == []


def test_long_texts_are_split_in_linear_time(spark):
    took = []
    for n in (2000, 16000):
        rows = files(spark, [("p.pdf", "C", "\n".join(f"{i}.{i}.1 应当检查第{i}项" if i % 3 == 0 else f"续行{i}" for i in range(1, n)), False)]).coalesce(1).cache()
        rows.count()
        began = time.time()
        assert rows.select(F.size(chunking.articles(F.col("text")))).first()[0] == (n - 1) // 3
        took.append(time.time() - began)
    assert took[1] < 8 * max(took[0], 0.4)


def test_explanation_chunks(spark):
    rows = [
        ("GB-1", "GB 1", "c", "", "", "GB-1/表.pdf", "前言 表格说明1：本表3.1给出了安全网的规格和尺寸，见第4.2.1条。其余从略。\n【图2.1】图中给出了各部分的名称以及全部的尺寸标注。"),
        ("GB-2", "GB 2", "c", "", "", "GB-2/补充.pdf", "一段补充的文字"),
    ]
    got = sorted((r["chunk_kind"], r["chunk_id"], r["title"][:3], r["related_article_id"]) for r in chunking.explanation_chunks(spark.createDataFrame(rows, DOC)).collect())
    assert got == [("figure", "norm::GB-1::figure::图2.1", "【图2", "2.1"), ("supplement", "norm::GB-2::supplement::item-1", "补充", None), ("table", "norm::GB-1::table::表3.1", "表格说", "3.1")]


def test_case_chunks_and_report(spark):
    fields = {"地点": "北京", "时间": "2024年3月5日", "事故经过": "工人从高处跌落", "直接原因": "未系安全带", "伤亡情况": "1人", "违反规范": "JGJ 80-2016 第3.0.5条", "原文链接": "见 https://a.b/c"}
    rows = [(7, "某事故", fields, "f.md"), (12, "无因", {}, "f.md")]
    chunks = chunking.case_chunks(spark.createDataFrame(rows, "number int, title string, fields map<string,string>, path string")).cache()
    got = {r["chunk_id"]: r for r in chunks.collect()}
    assert sorted(got) == ["case::case-07::cause", "case::case-07::summary", "case::case-12::summary"]
    summary = got["case::case-07::summary"]
    assert summary["text"] == "案例：某事故\n类型：高处坠落 | 日期：2024-03-05\n地点：北京\n经过：工人从高处跌落\n伤亡：1人\n违反规范：JGJ 80-2016 第3.0.5条"
    assert (summary["related_standards"], summary["consequences"], summary["causes"], summary["source_url"]) == (["JGJ-80-2016:3.0.5"], "伤亡：1人", None, "https://a.b/c")
    assert got["case::case-07::cause"]["text"] == "案例：某事故（原因）\n直接原因：未系安全带" and got["case::case-12::summary"]["text"] == "案例：无因\n类型：其他"
    report = chunking.case_report(chunks.unionByName(chunks.limit(1))).first()
    assert (report["chunk_count"], report["case_count"], report["duplicate_chunk_id_count"], report["cases_without_related_standards"]) == (4, 2, 1, 1)
    assert sum(report["by_chunk_kind"].values()) == 4 and chunking.case_report(chunks.limit(0)).first()["chunk_count"] == 0


@pytest.mark.parametrize(
    ("value", "column", "wanted"),
    [
        ("正文：4.1.19 必须系安全带。见图；严禁\n吸烟并 且喧哗。应当检查全部设备", tasks.demands, ["必须系安全带", "严禁吸烟并且喧哗"][1:] + ["应当检查全部设备"]),
        ("短句。这是一个没有要求的比较长的句子。", tasks.demands, ["这是一个没有要求的比较长的句子"]),
        ("短", tasks.demands, []),
        (None, tasks.demands, []),
        ("JGJ-T46-2024", tasks.core_code, "T46"),
        ("“,、 a * b”", cleaning.clause, "ab"),
        ("3.1\n总则\n，应\n3.2要求\n3.3 4 别的\n3.5\n3.6\n好", cleaning.lines_for_articles, "3.1 总则，应\n3.2 要求\n3.34 别的\n3.5\n3.6 好"),
        ("", cleaning.lines_for_articles, ""),
        ("co-\nop­erate  −1\n x", cleaning.unhyphenated, "cooperate -1 x"),
        (" 浏览专用 a \t b\n\n\n\nc", cleaning.without_banners, "a b\n\nc"),
        ("住房城乡建设部信息公开 \n浏览专用", cleaning.is_watermark_only, True),
        ("abc", cleaning.is_meaningful, False),
        ("安全网" * 30, cleaning.is_meaningful, True),
        ("12\n安全\nTHE QUICK BROWN FOX\n甲 abcdefghijklmnop\nthickness 10 mm 板\nshort", cleaning.without_latin_lines, "安全\nthickness 10 mm 板\nshort\n"),
        ("2", cleaning.is_skipped_block, True),
        ("mm 线", cleaning.starts_with_unit, True),
        ("mmx 线", cleaning.starts_with_unit, False),
        ("ab", lambda c: cleaning.substituted(c, [("a", "b"), ("bb", "c")]), "c"),
        ("ab", lambda c: cleaning.substituted_by(c, F.lit("K"), {"K": {"a": "x"}, "L": {"b": "y"}}), "xb"),
        ("第3.1.2条", chunking.related_article, "3.1.2"),
    ],
)
def test_cleaning(spark, value, column, wanted):
    assert one(spark, value, column) == wanted


def test_blocks_end_with_the_page_of_references(spark):
    rows = [("d", 1, 1, "1. Intro"), ("d", 1, 2, "7"), ("d", 1, 3, "Fig. 1 x"), ("d", 2, 1, "End. References [1] a"), ("d", 2, 2, "rest"), ("d", 3, 1, "gone"), ("e", 1, 1, "Table 1")]
    got = [tuple(r)[1:] for r in cleaning.blocks(spark.createDataFrame(rows, "doc string, page int, pos int, text string")).orderBy("doc", "id").collect()]
    assert got == [("S001", 1, "heading", "1. Intro"), ("S002", 1, "figure_caption", "Fig. 1 x"), ("S003", 2, "text", "End."), ("S004", 2, "text", "rest"), ("S001", 1, "table_or_caption", "Table 1")]


def test_overrides_and_page_report(spark):
    rows = spark.createDataFrame([("a", "1", "x"), ("a", "2", "y"), ("b", None, "住房城乡建设部信息公开")], "code string, article string, text string")
    new = spark.createDataFrame([("a", "2", "z")], "code string, article string, text string")
    assert sorted(r["text"] for r in cleaning.overridden(rows, new, ["code", "article"], "text").collect()) == ["x", "z", "住房城乡建设部信息公开"]
    assert [tuple(r) for r in cleaning.page_report(rows).orderBy("code").collect()] == [("a", 2, 0, 0), ("b", 1, 0, 1)]


def test_verified_refs(spark):
    library = spark.createDataFrame([("JGJ-80-2016", "3.0.5"), ("JGJ-T46-2024", "8.1.1"), ("GB-6095-2021", None)], "standard_code string, article_id string")
    texts = spark.createDataFrame([(1, "违反JGJ 80第3.0.5条、JGJ/T 46 8.1.1"), (2, "JGJ46 第 8.1.1 条及 9.9"), (3, "无"), (4, None)], "id int, text string")
    got = {r["id"]: r["refs"] for r in tasks.verified_refs(texts, library).collect()}
    assert got == {1: ["JGJ-80-2016:3.0.5", "JGJ-T46-2024:8.1.1"], 2: ["JGJ-T46-2024:8.1.1"], 3: [], 4: []}


def test_proxy_articles_by_the_df_of_all_items(spark):
    """In the code itself `beta` is as rare as `alpha`; over all items `alpha` is rarer, so it decides."""
    items = spark.createDataFrame([(1, "A", "beta x"), (2, "A", "alpha x"), (3, "B", "beta"), (4, "B", "beta"), (5, "B", "beta y"), (6, None, "alpha")], "item long, code string, text string")
    asked = spark.createDataFrame([(1, "A", "alpha beta"), (2, "B", "alpha"), (3, None, "alpha")], "request long, code string, text string")
    assert [tuple(r)[:2] for r in tasks.proxy_articles(asked, items, lambda c: F.split(c, " ")).select("request", "item", "rank").orderBy("request", "rank").collect()] == [(1, 2), (1, 1)]


def test_skipped_report(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", "no refs")], "id int, theme string, why string")
    got = {(r["what"], r["name"]): (r["n"], r["ids"]) for r in tasks.skipped_report(rows, F.col("why")).collect()}
    assert got == {("theme", "a"): (2, [1, 2]), ("skipped", "no refs"): (1, [3])}


ISSUE = "array<struct<type:string,description:string,location:string>>"


def test_consistency_of_drafts(spark):
    llm, conflict = [("hallucination", "?", "")], [("norm_case_conflict", "c", "")]
    rows = [
        (1, None, ["n1"], [], ["n1"], [], 0),
        (2, llm, ["n1"], [], ["n1"], [], 0),  # borne out by no citation
        (3, llm, ["n1", "n9", " ", None], ["c9"], ["n1"], ["c1"], 1),
        (4, conflict, [], [], ["n1"], [], 0),
        (5, [], None, None, None, None, 2),
    ]
    df = spark.createDataFrame(rows, f"id int, model_issues {ISSUE}, cited_norms array<string>, cited_cases array<string>, norms array<string>, cases array<string>, retries int")
    got = {r["id"]: ([i["type"] for i in r["issues"]], r["passed"], r["reason"], r["retries"]) for r in evidence.consistency(df).collect()}
    assert got == {1: ([], True, "", 0), 2: ([], True, "", 0), 3: (["hallucination"] * 3, False, "hallucination", 2), 4: (["norm_case_conflict", "evidence_insufficient"], False, "norm_case_conflict", 1), 5: ([], True, "", 2)}
    bare = {r["id"]: r["passed"] for r in evidence.consistency(df, deterministic_ground=False).collect()}
    assert bare == {1: True, 2: True, 3: True, 4: False, 5: True}
    asked = evidence.consistency(df).where("id = 4").select(evidence.evidence_request(F.col("issues"), F.lit(None)).alias("r")).first()["r"]
    assert asked["missing"] == [evidence.UNCITED] and asked["hazards"] == []


def test_selected_evidence_and_answers(spark):
    items = "array<struct<chunk_id:string,article_id:string,text:string,process:string>>"
    norms, cases = [("a", "3.1", "甲" * 200, None), ("b", "", "乙", None)], [("k", None, "", "经过")]
    rows = [(1, norms, cases, ["b", "x", "b"], False), (2, norms, cases, ["x"], False), (3, norms, cases, ["b"], True), (4, [], cases, None, False), (5, None, None, None, True)]
    df = spark.createDataFrame(rows, f"id int, norms {items}, cases {items}, ids array<string>, failed boolean")
    got = df.select("id", evidence.selected(F.col("ids"), F.col("norms"), F.col("failed"), F.array(F.lit("x"))).alias("s"), evidence.fallback_answer(F.col("norms"), F.col("cases")).alias("a")).orderBy("id").collect()
    assert [[x["chunk_id"] for x in r["s"]] if r["s"] is not None else None for r in got] == [["b", "b"], ["a", "b"], ["a", "b"], [], None]
    assert got[0]["a"] == "根据检索到的规范依据（3.1），" + "甲" * 180 + "..." and got[3]["a"] == "当前未形成完整生成回答；检索到的相似事故提示：经过" and got[4]["a"] == evidence.NO_ANSWER
    marked = df.where("id = 1").select(evidence.supplementary(F.col("cases"), F.lit(True)).alias("c")).first()["c"]
    assert (marked[0]["priority"], marked[0]["arbitration_note"]) == ("supplementary", evidence.SUPPLEMENTARY_NOTE)


def test_ties_of_fused_ranks(spark):
    routes = spark.createDataFrame([(1, r, n, i) for r, order in enumerate(([1, 2, 3, 4], [4, 3, 2, 1])) for n, i in enumerate(order, 1)], "request int, route int, rank int, item int")
    items = spark.createDataFrame([(1, [], ["s"]), (2, ["h"], []), (3, ["h"], ["s"]), (4, None, None)], "item int, hazard_tags array<string>, scenario_tags array<string>")
    requests = spark.createDataFrame([(1, ["h", "h"], ["s", "t"])], "request int, hazard_tags array<string>, scenario_tags array<string>")
    shared = retrieval.overlaps(routes, items, requests, ["hazard_tags", "scenario_tags"])
    assert [r["item"] for r in retrieval.fuse(routes, 9, shared).orderBy("rank").collect()] == [1, 4, 3, 2]  # 1/61 + 1/64 before 1/62 + 1/63


def test_blank_queries_and_modes(spark):
    items = spark.createDataFrame([(1, "scaffold net", ["h"], ["s"], [1.0, 0.0]), (2, "other", [], [], [0.0, 1.0])], "item long, text string, hazard_tags array<string>, scenario_tags array<string>, vector array<double>")
    requests = spark.createDataFrame([(7, ["h"], ["t"]), (8, ["h"], [])], "request long, hazard_tags array<string>, scenario_tags array<string>")
    queries = spark.createDataFrame([(7, " net ", [0.0, 1.0]), (7, " ", [1.0, 0.0]), (8, "", None)], "request long, text string, vector array<double>")
    words = lambda c: F.split(c, " ")
    got = {m: [(r["request"], r["item"]) for r in retrieval.retrieve(items, requests, queries, words, m, words={"text": 4.0}, keywords={}).orderBy("rank").collect()] for m in retrieval.MODES}
    assert got == {"bm25": [(7, 1)], "vector": [(7, 2), (7, 1)], "tag": [(7, 1)], "rrf_hybrid": [(7, 1), (7, 2)]}
    again = retrieval.retrieve(items, requests, queries, words, "vector", 1, F.length(F.col("text")), {"text": 4.0}, {}).collect()
    assert [r["item"] for r in again] == [1]
    with pytest.raises(ValueError, match="no mode"):
        retrieval.retrieve(items, requests, queries, words, "none")


def test_references_find_articles(spark):
    refs = spark.createDataFrame([(1, "A-1:3.1"), (1, "A-1: 3.1"), (1, "《法》:2"), (1, "A-1"), (1, ":3.1"), (1, None), (2, "B:9")], "request int, ref string")
    chunks = spark.createDataFrame([("x", "A-1", "3.1"), ("y", "A-1", "3.1"), ("z", "A-1", None)], "item string, standard_code string, article_id string")
    assert sorted(map(tuple, retrieval.by_refs(refs, chunks).collect())) == [(1, "x"), (1, "y")]


def test_gold_of_cases(spark):
    rows = [("k", "case::k::cause", "case_cause", None, "t", "", ["h"], ["A:1"]), ("k", "case::k::summary", "case_summary", "p" * 500, "t", "", ["h"], ["A:1", "A:1", "A:2", "《x》", "B"]), ("m", "case::m::cause", "case_cause", "", None, "title", None, None)]
    cases = spark.createDataFrame(rows, "case_id string, chunk_id string, chunk_kind string, process string, text string, case_title string, hazard_tags array<string>, related_standards array<string>")
    chunks = spark.createDataFrame([("n1", "A", "1")], "item string, standard_code string, article_id string")
    got = {r["case_id"]: r for r in evaluation.case_gold(cases, chunks).collect()}
    assert (len(got["k"]["query"]), got["k"]["expected"], got["k"]["total_refs"], got["k"]["resolved_refs"]) == (400, ["n1"], 2, 1)
    assert (got["m"]["query"], got["m"]["expected"], got["m"]["total_refs"]) == ("title", [], 0)


def test_comparisons_of_datasets(spark):
    rows = [(d, "variant", g, t, "m", float(v + (g == "proposed") * 2 + (d == "b"))) for d in "ab" for g in ("proposed", "other") for t, v in enumerate([1, 4, 2, 8, 5])]
    df = spark.createDataFrame(rows, "dataset string, family string, grp string, task int, metric string, value double")
    within = evaluation.within_datasets(df).orderBy("dataset").collect()
    assert [(r["dataset"], r["comparison"], r["n_pairs"], r["mean_delta"], r["w"], r["p"]) for r in within] == [("a", "other", 5, 2.0, 0.0, pytest.approx(within[0]["p"])), ("b", "other", 5, 2.0, 0.0, pytest.approx(within[0]["p"]))]
    left, right = [3, 6, 4, 10, 7], [1, 4, 2, 8, 5]
    assert within[0]["cliffs_delta"] == pytest.approx(sum((a > b) - (a < b) for a in left for b in right) / 25)
    assert all(r["p_holm"] >= r["p"] and not r["significant"] for r in within)
    between = evaluation.between_datasets(df).orderBy("grp").collect()
    assert [(r["left_dataset"], r["right_dataset"], r["grp"], r["mean_delta"]) for r in between] == [("a", "b", "other", -1.0), ("a", "b", "proposed", -1.0)]
    assert evaluation.within_datasets(df.where("grp = 'other'")).count() == 0


def test_summary_with_interval_and_unmatched(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 2.0)], "g string, v double")
    got = {r["g"]: r for r in evaluation.summary_with_interval(df, "g", "v", 200).collect()}
    assert got["a"]["mean"] == 2.0 and 1.0 <= got["a"]["ci95_low"] <= got["a"]["ci95_high"] <= 3.0 and got[None]["ci95_low"] == 2.0
    other = spark.createDataFrame([("a",), ("z",)], "g string")
    assert sorted(map(str, (tuple(r) for r in evaluation.unmatched(df, other, "g").collect()))) == ["('extra', None)", "('missing', 'z')"]


def test_index_and_results(spark, tmp_path):
    chunks = spark.createDataFrame([("c1", None, "t"), ("c2", ["x"], "u")], "chunk_id string, hazard_tags array<string>, text string")
    vectors = spark.createDataFrame([("c1", [0.5])], "chunk_id string, vector array<double>")
    assert sinks.rebuild_index(chunks.unionByName(chunks), str(tmp_path / "i"), vectors) == 2
    index = spark.read.parquet(str(tmp_path / "i"))
    assert [r["hazard_tags"] for r in index.orderBy("chunk_id").collect()] == [[], ["x"]] and sorted(map(str, sinks.chunks_of(index, chunks.schema).collect())) == sorted(map(str, chunks.collect()))
    with pytest.raises(RuntimeError, match="1 rows of 2"):
        sinks.guarded(chunks, index.limit(1))
    with pytest.raises(ValueError, match="no chunks"):
        sinks.guarded(chunks.limit(0), index)
    assert [r["metadata"] for r in sinks.vector_metadata(chunks, ["hazard_tags", "text"]).orderBy("chunk_id").collect()] == [{"hazard_tags": "", "text": "t"}, {"hazard_tags": "x", "text": "u"}]
    rows = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 1.5)], "id int, v double")
    sinks.write_results(rows, str(tmp_path / "r"), rows, {"a": "é"})
    assert sorted((r["id"], r["v"]) for r in spark.read.schema("id int, v double").json(str(tmp_path / "r/json")).collect()) == [(1, None), (2, None), (3, 1.5)]
    assert spark.read.text(str(tmp_path / "r/metadata")).first()[0] == '{"a": "é"}'
    sinks.append_rows(rows.where("id = 3"), str(tmp_path / "a"))
    sinks.append_rows(rows.where("id = 3"), str(tmp_path / "a"))
    assert spark.read.json(str(tmp_path / "a")).count() == 2
    assert one(spark, "https://a.b:1/c?d", sinks.domain) == "a.b:1" and one(spark, "a.b/c", sinks.domain) == "a.b"
    known = sinks.run_metadata(spark, "bench", [str(tmp_path / "none")], ["NO_SUCH_SETTING"])
    assert list(known["inputs"].values()) == [None] and known["settings"] == {}
    assert sinks.state_json(rows.where("id = 3")).first()["state"] == '{"id":3,"v":1.5}'
