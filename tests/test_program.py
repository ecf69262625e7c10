"""Tests of typed model calls, counters, the benchmark driver, and programs over streams."""

import itertools
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions import modelcalls
from gristmill.functions import text as tx
from gristmill.functions.counters import Counters, timed
from gristmill.functions.modelcalls import Reply
from gristmill.operators import evidence, index
from gristmill.plans import benchmark, strategies
from gristmill.streaming import ingest, program

SCHEMA = T.StructType(
    [modelcalls.required("title", T.StringType()), modelcalls.choice("level", ["Low", "High"], "Low"), T.StructField("steps", T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("n", T.IntegerType())]))), T.StructField("sure", T.BooleanType()), T.StructField("score", T.DoubleType())]
)
GOOD = {"title": "t", "level": "high", "steps": ["one", {"text": None, "n": "2"}], "sure": "True", "score": 1}
REPLIES = {
    "good": [Reply(json.dumps(GOOD))],
    "fenced": [Reply("<think>hm</think>```json\n" + json.dumps(GOOD) + "\n```")],
    "second": [Reply("no json"), Reply(json.dumps({"title": "late", "level": "odd", "steps": "only"}))],
    "never": [Reply("no"), Reply('{"level": "Low"}')],
    "cut": [Reply('{"title": ', truncated=True), Reply(json.dumps(GOOD))],
    "down": [Reply(None, error="timeout"), Reply(json.dumps(GOOD))],
    "wrong": [Reply('{"title": "x", "score": "many"}'), Reply('{"title": "x", "sure": "perhaps"}')],
}


def scripted(replies):
    def provider():
        def ask(asks):
            if any(a.prompt.startswith("boom") for a in asks):
                raise RuntimeError("no client")
            return [replies[a.prompt.split("\n")[0]][a.attempt - 1] for a in asks]

        return ask

    return provider


def test_typed_calls_of_every_kind(spark):
    provider = scripted(REPLIES)
    rows = spark.createDataFrame([(k, 1) for k in [*REPLIES, None]], "name string, reply int").coalesce(1)
    got = {r["name"]: r for r in modelcalls.call(rows, F.col("name"), provider, SCHEMA, batch=3).collect()}
    whole = (("t", "High", [("one", None), ("", 2)], True, 1.0), None, 1, False)
    view = lambda r: (None if r["reply"] is None else (r["reply"]["title"], r["reply"]["level"], [tuple(s) for s in r["reply"]["steps"]], r["reply"]["sure"], r["reply"]["score"]), r["error"], r["attempts"], r["truncated"])
    assert view(got["good"]) == view(got["fenced"]) == whole
    assert view(got["second"]) == (("late", "Low", [("only", None)], None, None), None, 2, False)
    assert view(got["never"]) == (None, "no valid reply after 2 attempts: no title", 2, False)
    assert view(got["cut"]) == (None, "truncated reply", 1, True) and view(got["down"]) == (None, "request failed: timeout", 1, False)
    assert got["wrong"]["attempts"] == 2 and "not true or false" in got["wrong"]["error"] and view(got[None]) == (None, None, 0, False)
    boom = modelcalls.call(spark.createDataFrame([("boom",), ("good",)], "name string").coalesce(1), F.col("name"), provider, SCHEMA, batch=1).collect()
    assert [r["error"] for r in boom] == ["request failed: RuntimeError: no client", None]
    assert modelcalls.call(rows.limit(0), F.col("name"), provider, SCHEMA).collect() == []


def test_rewriter_degrades(spark):
    def model():
        replies = {"both": '{"norm_queries": ["n2"], "case_queries": ["c2", "c3"]}', "one": '{"norm_queries": [], "case_queries": "c9"}', "bad": "?"}
        return lambda asks: [Reply(replies[a.prompt.split("\n")[0]]) for a in asks]

    rows = spark.createDataFrame([("both", ["n"], ["c"]), ("one", ["n"], ["c"]), ("bad", ["n"], None), ("empty", [], [])], "name string, norm_queries array<string>, case_queries array<string>")
    got = {r["name"]: (r["norm_queries"], r["case_queries"], r["error"] is None) for r in modelcalls.rewritten(rows, model, F.col("name")).collect()}
    assert got == {"both": (["n2"], ["c2", "c3"], True), "one": (["n"], ["c9"], True), "bad": (["n"], None, False), "empty": ([], [], True)}


def test_counters_add_no_job_and_equal_recounts(spark):
    counters = Counters()
    rows = counters.watch(spark.range(100), "read", total=F.sum("id"))
    kept = timed(counters, "kept")(lambda df: df.where("id % 3 = 0"))(rows)
    never = counters.watch(spark.range(3), "never")
    assert counters.snapshot() == {"read": None, "kept": None, "never": None}
    status, n = spark.sparkContext.statusTracker(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    assert len(kept.collect()) == 34
    assert counters.snapshot() == {"read": {"rows": 100, "total": 4950}, "kept": {"rows": 34}, "never": None}
    assert len(status.getJobIdsForGroup(None)) == n + 1
    with pytest.raises(ValueError):
        counters.watch(never, "never")
    said = counters.attach({"run": 1})
    assert said["run"] == 1 and said["counters"]["kept"] == {"rows": 34}
    counters.reset()
    assert counters.snapshot() == {}


def test_benchmark_goes_on_and_resumes(spark, tmp_path):
    tasks = spark.createDataFrame([(f"t{i}", i) for i in range(6)] + [("t0", 0), (None, 9)], "task_id string, n int")
    calls = spark.sparkContext.accumulator(0)

    def odd(row):
        calls.add(1)
        if row["n"] == 4:
            raise ValueError("four")
        return json.dumps({"score": row["n"] / 2})

    def broken(rows):
        raise RuntimeError("no such index")

    def late(rows):
        return rows.select("task_id", F.when(F.col("n") >= 0, F.raise_error(F.lit("at run time"))).cast("string").alias("output"))

    variants = {"odd": benchmark.by_task(odd, ["n"]), "broken": broken, "late": late, "some": lambda rows: rows.where("n < 3").select("task_id", F.lit("{}").alias("output"))}
    path = str(tmp_path)
    got = {(r["task_id"], r["variant"]): (r["output"], r["error"]) for r in benchmark.run(tasks, variants, path).collect()}
    assert len(got) == 24 and calls.value == 6
    assert got["t4", "odd"] == (None, "ValueError: four") and got["t3", "odd"] == ('{"score": 1.5}', None)
    assert all("no such index" in got[f"t{i}", "broken"][1] and "at run time" in got[f"t{i}", "late"][1] for i in range(6))
    assert got["t2", "some"] == ("{}", None) and got["t5", "some"] == (None, "no result")
    benchmark.run(tasks, variants, path)
    assert benchmark.runs(spark, path).count() == 24 and calls.value == 6
    mended = benchmark.run(tasks.unionByName(spark.createDataFrame([("t9", 1)], tasks.schema)), variants | {"broken": variants["some"]}, path, retry_errors=True)
    assert mended.where("variant = 'broken' and error is null").count() == 4 and mended.count() == 28
    about = spark.createDataFrame([("t1", "a", 1), ("t3", "a", 2), ("t5", "b", 1)], "task_id string, theme string, tier int")
    scores = benchmark.scored(mended, about, lambda df: df.select("variant", "theme", "tier", F.col("result.score").alias("score")), "score double").where("variant = 'odd'")
    cube = {(r["theme"], r["tier"], r["level"]): (r["n"], r["score"]) for r in benchmark.breakdown(scores, ["score"]).collect() if r["variant"]}
    assert cube["a", None, 1] == (2, 1.0) and cube[None, None, 3] == (3, 1.5) and cube[None, 1, 2] == (2, 1.5)


def test_decisions_are_the_table(spark):
    rows = list(itertools.product([True, False], ["", "hallucination", "evidence_insufficient", "norm_case_conflict", "other"], range(5), range(3), [True, False]))
    df = spark.createDataFrame(rows, "passed boolean, reason string, retries int, budget int, cases boolean")
    got = df.select("*", evidence.route(*map(F.col, df.columns)).alias("route")).collect()
    assert all(r["route"] == evidence.decided(*r[:5]) for r in got)


def test_program_over_a_stream_ends_like_the_batch(spark, tmp_path):
    kinds = ["", "hallucination", "evidence_insufficient", "norm_case_conflict"]
    plans = [p for p in itertools.product(range(4), repeat=3)] * 2
    states = spark.createDataFrame([(i, list(p), i < 64) for i, p in enumerate(plans)], "request long, plan array<int>, cases boolean")

    def check(drafts):
        kind = F.element_at(F.array(*map(F.lit, kinds)), F.element_at("plan", F.col("passes") + 1) + 1)
        return drafts.withColumns({"reason": kind, "passed": kind == "", "cases": F.col("request") < 64})

    want = {r["request"]: (r["passes"], r["route"]) for r in strategies.authored(states.drop("cases"), lambda d: d, check).collect()}
    verdicts = states.select("request", F.posexplode("plan").alias("p", "k"), "cases").select("request", (F.col("p") + 1).alias("pass"), (F.col("k") == 0).alias("passed"), F.element_at(F.array(*map(F.lit, kinds)), F.col("k") + 1).alias("reason"), "cases")
    before = spark.conf.get(program.STATE_STORE[0])
    spark.conf.set(*program.STATE_STORE)
    source, out, place = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    schema = "request long, `pass` int, passed boolean, reason string, cases boolean"

    def go():
        stream = program.routed(ingest.event_stream(spark, source, schema, 10))
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", place).trigger(availableNow=True).start()
        assert q.awaitTermination(240)

    try:
        first = verdicts.where("`pass` = 1")
        first.unionByName(first).coalesce(1).write.parquet(source)  # repeated verdicts
        go()
        rest = verdicts.where("`pass` > 1").unionByName(first)  # from here on with the state of the checkpoint
        rest.coalesce(1).write.mode("append").parquet(source)
        go()
    finally:
        spark.conf.set(program.STATE_STORE[0], before)
    rows = spark.read.parquet(out).collect()
    assert {r["request"]: (r["passes"], r["route"]) for r in rows if r["ended"]} == want
    assert len({(r["request"], r["passes"]) for r in rows}) == len(rows)


def test_index_of_a_stream_equals_one_build(spark, tmp_path):
    docs = [(i, f"word{i % 5} common text {i}") for i in range(40)]
    changed = [(3, "word3 changed"), (7, "word2 common text 7")]
    fields, schema = {"text": tx.tokens(F.col("text"))}, "item long, text string"
    source, path = str(tmp_path / "in"), str(tmp_path / "index")

    def go(checkpoint):
        assert ingest.index_stream(ingest.event_stream(spark, source, schema, 1), path, fields, checkpoint).trigger(availableNow=True).start().awaitTermination(240)

    spark.createDataFrame(docs[:25], schema).coalesce(1).write.parquet(source)
    go(str(tmp_path / "c1"))
    spark.createDataFrame(docs[20:] + changed[:1], schema).coalesce(1).write.mode("append").parquet(source)
    go(str(tmp_path / "c1"))
    rows = lambda x: sorted(map(tuple, x.contents().collect()))
    now = index.Index(spark, path)
    want = index.build(spark.createDataFrame([d for d in docs if d[0] != 3] + changed[:1], schema), str(tmp_path / "whole"), fields)
    assert rows(now) == rows(want) and now.n_items == want.n_items
    assert index.merge(spark.createDataFrame([(99, "never")], schema), path, fields, next(iter(now.content["batches"].items()))).n_items == 40  # a batch's number counts once
    asked = spark.createDataFrame([(1, "word3 common"), (2, "changed")], "request long, text string")
    hits = lambda x: sorted(map(tuple, index.search(x, asked, tx.tokens, k=5).collect()))
    assert hits(index.Index(spark, path)) == hits(want)
