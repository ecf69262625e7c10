import pytest
from pyspark.sql import functions as F

from gristmill.functions import planning
from gristmill.plans import agents


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize(("text", "wanted"), [("塔吊班前如何交底？", "training"), ("安全带如何系挂", "qa"), ("what?", "qa"), ("脚手架搭设", "training"), ("", "training"), (None, "training")])
def test_intent(spark, text, wanted):
    assert one(spark, text, planning.intent) == wanted


def test_plans_without_a_model(spark):
    none = F.lit("")
    assert one(spark, "脚手架", lambda c: planning.hazards(c, none)) == ["高处坠落", "物体打击", "坍塌"]
    assert one(spark, "绿化", lambda c: planning.hazards(c, none)) == list(planning.ANY_HAZARDS)
    plan = one(spark, "吊篮安全培训", lambda c: planning.training_queries(c, none))
    assert (plan["norm_queries"], plan["case_queries"]) == (["吊篮", "吊篮 规范 要求 安全 防护", "吊篮 作业前 交底 检查"], ["吊篮 事故 案例", "吊篮 高处坠落 物体打击"])
    assert one(spark, "安全培训", lambda c: planning.training_queries(c, none))["norm_queries"][0] == "安全培训"
    assert one(spark, " 怎么系？? ", planning.qa_queries)["case_queries"] == ["怎么系", "怎么系 事故 案例"]
    assert one(spark, "吊装", planning.scenario).startswith("吊装作业前，班组准备")


def test_defaults_of_a_draft(spark):
    full = one(spark, " ", lambda c: planning.with_defaults(c, F.lit(None), F.lit(None), {}))
    assert full["scenario_description"].startswith("本次作业作业前") and full["expected_hazards"] == list(planning.EXPECTED_HAZARDS) and len(full["operation_points"]) == 5 and full["quiz_questions"][0]["options"] == []
    known = {"quiz_questions": F.array().cast("array<struct<type:string,question:string,options:array<string>,answer:string,explanation:string>>"), "operation_points": F.array(F.lit("x")), "remedial_feedback_guide": F.lit("y"), "learner_evaluation_guide": F.lit("")}
    part = one(spark, "吊装", lambda c: planning.with_defaults(c, F.lit("s"), F.array(*[F.lit("h" * 40)] * 6), known))
    assert (part["scenario_description"], part["operation_points"], part["remedial_feedback_guide"], part["expected_hazards"]) == ("s", ["x"], "y", ["h" * 30] * 5)
    assert "吊装" in part["learner_evaluation_guide"] and "吊装" in part["quiz_questions"][0]["question"]


def test_questions_are_answered_from_evidence(spark):
    arrays = "hazard_tags array<string>, scenario_tags array<string>"
    norms = spark.createDataFrame([("n1", "belt hook rule", "A-1", "3.1", [], []), ("n2", "unrelated", "B-2", "4.1", [], [])], f"item string, text string, standard_code string, article_id string, {arrays}")
    cases = spark.createDataFrame([("c1", "belt fell", ["B-2:4.1", "《x》"], [], [])], f"item string, text string, related_standards array<string>, {arrays}")
    requests = spark.createDataFrame([(1, "belt hook?"), (2, "nothing known?"), (3, "belt 培训")], "request long, text string")
    terms = lambda c: F.filter(F.split(c, r"[^a-z]+"), lambda w: w != "")
    fields = {"words": {"text": 4.0}, "keywords": {}}
    answer = lambda s: s.withColumns({"answer": F.lit("yes"), "cited_norms": F.array(F.lit("n1"), F.lit("zz")), "cited_cases": F.array().cast("array<string>"), "confidence": F.lit("high"), "gap": F.lit(None).cast("string"), "failed": F.col("request") == 2})
    qa = lambda model: lambda rows: agents.answers(rows, norms, cases, terms, model, **fields)
    got = {r["request"]: r for r in agents.dispatched(requests, lambda rows: rows.select("request", F.lit("t").alias("answer")), qa(answer)).collect()}
    assert (got[1]["answer"], got[1]["norms"], got[1]["cases"], got[1]["linked"], got[1]["confidence"], got[1]["mode"]) == ("yes", ["n1"], ["c1"], ["n2"], "high", "qa")
    assert (got[2]["norms"], got[2]["confidence"]) == ([], "low") and got[2]["answer"].startswith("（") and (got[3]["mode"], got[3]["answer"]) == ("training", "t")
    bare = {r["request"]: r for r in qa(None)(agents.classified(requests.where("request = 1"))).collect()}
    assert bare[1]["norms"] == ["n1", "n2"] and bare[1]["answer"] == "根据检索到的规范依据（3.1），belt hook rule"


def test_a_model_decides_bare_topics_alone(spark):
    requests = spark.createDataFrame([(1, "why?"), (2, " belts "), (3, "ropes"), (4, "培训")], "request long, text string")
    model = lambda rows: rows.withColumns({"model_mode": F.when(F.col("request") == 2, "qa"), "topic": F.when(F.col("request") == 3, "rope work")})
    got = {r["request"]: (r["mode"], r["subject"]) for r in agents.classified(requests, model).collect()}
    assert got == {1: ("qa", "why?"), 2: ("qa", "belts"), 3: ("training", "rope work"), 4: ("training", "培训")}
