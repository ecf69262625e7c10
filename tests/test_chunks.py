import json

import pytest
from pyspark.sql import functions as F

from gristmill.functions import jsontext, layout
from gristmill.functions.text import tokens
from gristmill.operators import chunks, evaluation, retrieval
from gristmill.plans import strategies

COLUMNS = ("chunk_id", "standard_code", "chunk_kind", "article_id", "chapter_no", "chapter", "title", "text", "source_path", "asset_path", "related_article_id")
RULES = chunks.Rules(managed={"M-1": chunks.Allowed(prefixes=("3.",), keywords=("吊装",))}, curated={"K-1": chunks.Allowed(articles=("5.1.1",), related=("5.2",))})
LONG = "作业人员应当佩戴安全带并且系挂在牢固的构件上面方可开始施工"


@pytest.mark.parametrize(
    ("row", "wanted"),
    [
        ({}, None),
        ({"standard_code": "JGJ-196-2010"}, "standard_not_in_scope"),
        ({"article_id": "3.100.1"}, "pseudo_article_number"),
        ({"article_id": "3.0099.1"}, "malformed_article_id"),
        ({"standard_code": "JGJ-33-2012", "article_id": "5.1", "title": "一般规定", "text": "正文：5.1 一般规定"}, "jgj33_section_title"),
        ({"standard_code": "JGJ-33-2012", "article_id": "5.1.2", "chapter_no": "05"}, "jgj33_not_whitelisted"),
        ({"standard_code": "JGJ-33-2012", "article_id": "8.4.2", "chapter_no": "08"}, None),
        ({"chapter": "参考文献"}, "bibliography"),
        ({"title": "附录A"}, "appendix"),
        ({"article_id": "ch-04"}, "whole_chapter_fallback"),
        ({"article_id": "7.0"}, "malformed_article_id"),
        ({"text": "正文：织旭" + LONG}, "ocr_garble"),
        ({"text": "正文：邮政编码" + LONG}, "preface_or_publisher"),
        ({"title": "脚子架"}, "known_ocr_garble_v2"),
        ({"standard_code": "JGJ-162-2008", "chapter_no": "05"}, "formula_design_noise"),
        ({"standard_code": "GB-51210-2016", "text": "正文：应按公式计算荷载组合" + LONG}, "formula_design_noise"),
        ({"text": "正文：3.1.1 35"}, "contentless_fragment"),
        ({"text": "正文：3.1.1 安全措施"}, "section_title_stub"),
        ({"standard_code": "K-1", "article_id": "5.1.2"}, "curated_standard_not_whitelisted"),
        ({"standard_code": "K-1", "article_id": "5.1.2", "related_article_id": "5.2"}, None),
        ({"standard_code": "M-1", "article_id": "4.1.1"}, "managed_standard_not_whitelisted"),
        ({"standard_code": "M-1", "article_id": "4.1.1", "title": "吊装"}, None),
        ({"standard_code": "JGJ-T46-2024", "article_id": "8.1.6", "text": "TREE"}, None),
        ({c: None for c in COLUMNS if c != "chunk_id"}, None),
    ],
)
def test_chunk_reasons(spark, row, wanted):
    full = dict.fromkeys(COLUMNS, "") | {"chunk_id": "c", "standard_code": "X-1", "chunk_kind": "article", "article_id": "3.1.1", "chapter_no": "03", "text": f"正文：3.1.1 {LONG}"} | row
    df = spark.createDataFrame([tuple(full[c] for c in COLUMNS)], ",".join(f"{c} string" for c in COLUMNS))
    assert df.select(chunks.reason(RULES).alias("r")).first()["r"] == wanted


@pytest.mark.parametrize(
    ("words", "wanted"),
    [
        ([], ""),
        ([(5, 10, 10, " ")], ""),
        ([(50, 10, 10, "b"), (5, 12, 10, "a")], "ab"),  # one line, from left to right
        ([(5, 16, 10, "a"), (50, 10, 10, "b")], "ab"),  # 6 is 0.6 of 10
        ([(5, 17, 10, "a"), (50, 10, 10, "b")], "b\na"),
        ([(5, 20, 18, "a"), (50, 10, 5, "b")], "ab"),  # the larger height counts
        ([(9, 10, 10, "a"), (8, 16, 10, "b"), (7, 18, 10, "c")], "cba"),  # the line is at 12 by now
        ([(9, 10, 10, "a"), (8, 16, 10, "b"), (7, 19, 10, "c")], "ba\nc"),
        ([(1, 0, 10, "x"), (1, 40, 10, "y"), (3, 41, 10, "z"), (1, 80, 10, " w ")], "x\nyz\nw"),
    ],
)
def test_page_lines(spark, words, wanted):
    df = spark.createDataFrame([(words,)], "w array<struct<x:int,y:int,h:int,text:string>>")
    assert df.select(layout.page_lines(F.col("w")).alias("o")).first()["o"] == wanted


@pytest.mark.parametrize(
    ("reply", "wanted"),
    [
        ('{"a": 1}', {"a": 1}),
        ('<think>{x}</think> {"a": None}', {"a": None}),
        ('so\n```json\n{"a": True}\n```', {"a": True}),
        ('so ```\n[1]\n``` end', [1]),
        ('x {"a": "}\\"{", "b": {"c": 2}} y }', {"a": '}"{', "b": {"c": 2}}),
        ("none here", None),
        ('{"a": 1', None),
        ("", None),
        (None, None),
    ],
)
def test_json_of_replies(spark, reply, wanted):
    got = spark.createDataFrame([(reply,)], "v string").select(jsontext.json_of(F.col("v")).alias("o")).first()["o"]
    assert (got and json.loads(got)) == wanted
    assert jsontext.repaired('{"a": null}', fill=True) == '{"a":""}'


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("o")).first()["o"]


def test_references_and_explanations(spark):
    assert one(spark, "《建筑法》；JGJ 80-2016 第3.0.5条、3.0.6条、GB 6095-2021；JGJ/T 46-2024", layout.case_references) == ["《建筑法》", "JGJ-80-2016:3.0.5", "JGJ-80-2016:3.0.6", "GB-6095-2021", "JGJ-T46-2024"]
    assert one(spark, None, layout.case_references) is None
    parts = one(spark, "前言 表格说明1：本表3.1给出了安全网的规格和尺寸。其余从略。\n【图2.1】短", layout.explanations)
    assert [(p["item"], p["title"][:6]) for p in parts] == [("表3.1", "表格说明1：")]


def test_source_info(spark):
    info = one(spark, "JGJ 80-2016/03_临边作业/a.docx", layout.source_info)
    assert (info["standard_code"], info["standard_name"], info["year"], info["chapter"]) == ("JGJ-80-2016", "JGJ 80 2016", "2016", "03 临边作业")
    assert one(spark, "GB-1/说明.pdf", layout.source_info)["chapter_title"] == "说明"


@pytest.fixture(scope="module")
def libraries(spark):
    requests = spark.createDataFrame([(1, "scaffold net", ["x"])], "request long, text string, tags array<string>")
    norms = spark.createDataFrame([(10, "scaffold rules", ["x"], 10), (11, "unrelated words", ["y"], 11)], "item long, text string, tags array<string>, ref long")
    cases = spark.createDataFrame([(20, "scaffold fell", ["z"], [11])], "item long, text string, tags array<string>, refs array<long>")
    return requests, norms, cases


def test_strategies_and_ablations(libraries):
    got = {(r["variant"], r["kind"], r["item"]) for r in strategies.benchmark(*libraries, strategies.EngineConfig()).collect()}
    seen = [("norm", "10"), ("case", "20")]
    wanted = {(v, *s) for v in ("naive_dual", "optimized", "proposed") for s in seen} | {("norm_only", "norm", "10"), ("proposed", "norm", "11")}
    assert {(v, k, str(i)) for v, k, i in got} == wanted
    ablations = strategies.ablation_study(*libraries, strategies.EngineConfig(), ["no_case_evidence", "no_case_norm_linker"]).collect()
    assert sorted((r["ablation"], r["kind"], str(r["item"])) for r in ablations) == [("no_case_evidence", "norm", "10"), ("no_case_norm_linker", "case", "20"), ("no_case_norm_linker", "norm", "10")]
    with pytest.raises(ValueError, match="no strategy"):
        strategies.chosen("none")


def test_hybrid_has_a_vector_route_and_a_list_for_each_wording(spark):
    rows = [(i, f"p{i}", ["n"], [0.0, 1.0]) for i in range(1, 26)] + [(98, "apart", ["n"], [1.0, 0.0]), (99, "c " + "pad " * 30, ["n"], None)]
    items = spark.createDataFrame(rows, "item long, text string, tags array<string>, vector array<double>")
    requests = spark.createDataFrame([(1, "q", ["x"], [1.0, 0.1])], "request long, text string, tags array<string>, vector array<double>")
    more = spark.createDataFrame([(1, " ".join(f"p{i}" for i in range(1, 26))), (1, "c")], "request long, text string")
    got = lambda i, r, m=None: [x["item"] for x in strategies.hybrid(i, r, strategies.EngineConfig(), m).orderBy("rank").collect()]
    assert got(items, requests)[0] == 98  # shares neither word nor tag
    assert 99 in got(items.drop("vector"), requests.drop("vector"), more)  # one bag of all wordings has 25 better ones
    assert got(items, requests.drop("vector"), more)[:2] == [99, 1]


def test_strategies_read_han_text(spark):
    requests = spark.createDataFrame([(1, "脚手架检查", ["x"])], "request long, text string, tags array<string>")
    norms = spark.createDataFrame([(10, "脚手架搭设应当检查", ["y"], 10), (11, "临边作业", ["y"], 11)], "item long, text string, tags array<string>, ref long")
    cases = spark.createDataFrame([(20, "某工地脚手架坍塌", ["z"], [11])], "item long, text string, tags array<string>, refs array<long>")
    found = lambda name, **c: [(r["kind"], r["item"]) for r in strategies.chosen(name)(requests, norms, cases, strategies.EngineConfig(**c)).collect()]
    assert found("norm_only") == [("norm", 10)] and sorted(found("naive_dual")) == [("case", 20), ("norm", 10)]
    assert found("norm_only", terms=tokens) == []


def test_wordings_keep_the_order_given(spark):
    items = spark.createDataFrame([(1, "alpha", ["n"]), (2, "beta", ["n"])], "item long, text string, tags array<string>")
    requests = spark.createDataFrame([(1, "q", ["x"])], "request long, text string, tags array<string>")
    more = spark.createDataFrame([(1, "beta", 0), (1, "alpha", 1)], "request long, text string, ordinal int")
    got = lambda m: [r["item"] for r in strategies.hybrid(items, requests, strategies.EngineConfig(), m).orderBy("rank").collect()]
    assert got(more) == [2, 1] and got(more.drop("ordinal")) == [1, 2]
    fields = {"words": {"text": 4.0}, "keywords": {}}
    asked = lambda m: [r["item"] for r in retrieval.retrieve(items, requests, m, tokens, "bm25", **fields).orderBy("rank").collect()]
    items = items.withColumns({f: F.array().cast("array<string>") for f in retrieval.FAMILIES})
    requests = requests.withColumns({f: F.array().cast("array<string>") for f in retrieval.FAMILIES})
    assert asked(more) == [2, 1] and asked(more.drop("ordinal")) == [1, 2]


def test_summary_leaves_out_what_is_not_finite(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", float("nan")), ("a", float("inf")), ("a", None), ("b", float("nan"))], "g string, v double")
    a, b = evaluation.summary(rows, "g", "v").orderBy("g").collect()
    assert (a["n"], a["mean"], a["sd"], a["median"], a["q1"], a["q3"]) == (2, 2.0, 1.414214, 2.0, 1.5, 2.5) and (b["n"], b["mean"], b["median"]) == (0, None, None)
    ends = {r["g"]: (r["ci95_low"], r["ci95_high"]) for r in evaluation.summary_with_interval(rows, "g", "v", 500).collect()}
    assert ends["b"] == (None, None) and 1.0 <= ends["a"][0] <= ends["a"][1] <= 3.0


def test_every_ablation_acts(spark):
    requests = spark.createDataFrame([(r, "scaffold", ["x"]) for r in (1, 2)], "request long, text string, tags array<string>")
    norms = spark.createDataFrame([(10, "scaffold rules", ["x"], 10), (11, "unrelated words", ["y"], 11), (12, "net", ["y"], 12)], "item long, text string, tags array<string>, ref long")
    cases = spark.createDataFrame([(20, "scaffold fell", ["z"], [11])], "item long, text string, tags array<string>, refs array<long>")
    config = strategies.EngineConfig(rewrite=lambda df: df.select("request", F.lit("net").alias("text")))
    found = strategies.ablation_study(requests, norms, cases, config).cache()
    stray = F.array(F.struct(F.lit("norm").alias("kind"), F.lit(99).cast("long").alias("item")))
    author = lambda df: df.withColumn("cited", F.when((F.col("request") == 1) & (F.col("passes") == 0), F.concat("evidence", stray)).otherwise(F.col("evidence")))
    judge = lambda df: df.withColumn("issues", F.when(F.col("request") == 2, F.array(F.lit("hallucination"))).otherwise(F.array().cast("array<string>")))
    drafts = strategies.ablated_drafts(requests, found, config, author, judge)
    shown = {n: sorted(r["item"] for r in found.where(F.col("ablation") == n).where("request = 1").collect()) for n in strategies.ABLATIONS}
    ended = {n: [(r["passes"], r["passed"], len(r["cited"]) - len(r["evidence"])) for r in drafts.where(F.col("ablation") == n).orderBy("request").collect()] for n in strategies.ABLATIONS}
    full, good = [10, 11, 12, 20], [(2, True, 0), (1, True, 0)]
    assert shown == {"full": full, "no_case_evidence": [10, 12], "no_case_norm_linker": [10, 12, 20], "no_query_rewrite": [10, 11, 20], "no_deterministic_ground": full, "no_arbitration": full}
    assert ended == dict.fromkeys(strategies.ABLATIONS, good) | {"no_deterministic_ground": [(1, True, 1), (3, False, 0)], "no_arbitration": [(1, False, 1), (1, True, 0)]}


def test_authoring_ends_after_retries(spark):
    states = spark.createDataFrame([(1, 0), (2, 1), (3, 9)], "request long, fails int")
    author = lambda df: df.withColumn("draft", F.col("passes"))
    check = lambda df: df.withColumns({"passed": F.col("passes") >= F.col("fails"), "reason": F.lit("hallucination"), "cases": F.lit(True)})
    got = {r["request"]: (r["passes"], r["passed"]) for r in strategies.authored(states, author, check).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (3, False)}
    off = strategies.authored(states, author, check, strategies.EngineConfig(arbitration=False)).collect()
    assert {r["passes"] for r in off} == {1}
    lacking = lambda df: df.withColumns({"passed": F.lit(False), "reason": F.lit("evidence_insufficient"), "cases": F.lit(True)})
    asked = strategies.authored(states, author, lacking, gather=lambda df: df).collect()
    assert {r["passes"] for r in asked} == {2}


def test_tags_and_themes(spark, tmp_path):
    from gristmill.functions import tagging

    (tmp_path / "t.yaml").write_text('scenario_rules:\n  - ["临边", "临边作业"]\n  - ["搭设", "脚手架搭设"]\nhazard_rules:\n  - ["荷载", "构件失稳"]\nstandard_tag_hints:\n  GB-6:\n    scenario: ["安全带"]\n  GB:\n    hazard: ["触电"]\nhazard_fallback:\n', encoding="utf-8")
    tax = tagging.read_taxonomy(str(tmp_path / "t.yaml"))
    assert tax.hazard_fallback == ("构件失稳",)
    rows = [("临边脚手架搭设荷载", "GB-1", "x"), ("无", "GB-6095", "坍塌"), ("", "X", "触电"), (None, None, None)]
    df = spark.createDataFrame(rows, "t string, c string, a string").withColumn("s", tagging.scenario_tags(F.col("t"), tax, F.col("c")))
    df = df.withColumn("h", tagging.hazard_tags(F.col("t"), F.col("s"), tax, F.col("c")))
    got = df.select("s", "h", tagging.theme(F.col("s"), F.col("a")).alias("theme"), tagging.or_fallback(F.col("s"), F.col("h"), tax).alias("f")).collect()
    assert got[0]["s"] == ["高处作业", "临边作业", "脚手架搭设", "脚手架使用"]
    assert got[0]["h"] == ["高处坠落", "构件失稳", "坍塌", "触电"]
    assert [r["theme"] for r in got] == ["脚手架", "高处作业", "临时用电", None]
    assert (got[1]["s"], got[1]["h"]) == (["安全带"], ["高处坠落"])
    assert (got[2]["f"]["scenarios"], got[2]["f"]["hazards"]) == (["脚手架使用"], ["构件失稳"])
    assert got[3]["s"] == []


def test_evidence_lines(spark):
    from gristmill.functions import prompts

    known = ("chunk_id", "title", "process", "causes", "text")
    df = spark.createDataFrame([([("a", "", "p", "c", None), (None, "t", "", "", "x" * 300)],), ([],), (None,)], "e array<struct<chunk_id:string,title:string,process:string,causes:string,text:string>>")
    got = [r["o"] for r in df.select(prompts.evidence_lines(F.col("e"), known, prompts.CASE, "none").alias("o")).collect()]
    lines = [json.loads(x) for x in got[0].split("\n")]
    assert [(x["rank"], x["chunk_id"], x["case_title"], len(x["text"])) for x in lines] == [(1, "a", "", 3), (2, "", "t", 223)]
    assert got[1:] == ["none", "none"]
    assert [[w["summary"] for w in r["o"]] for r in df.limit(2).select(prompts.case_warnings(F.col("e"), known).alias("o")).collect()] == [["p\nc"], []]
    told = df.limit(2).select(prompts.diagnostics(F.lit("bm25"), F.array(F.lit("n")), F.col("e")["chunk_id"], F.lit(True)).alias("d")).collect()
    assert [(r["d"]["norm_count"], r["d"]["case_note"] is None) for r in told] == [(1, True), (1, False)]
    pages = spark.createDataFrame([(1, 2), (3, None), (None, None)], "a int, b int").select(prompts.page_range(F.col("a"), F.col("b")).alias("p")).collect()
    assert [r["p"] for r in pages] == ["1-2", "3", ""]
