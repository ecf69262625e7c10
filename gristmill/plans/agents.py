"""One entry for requests: each goes to the training program or to answers of questions.

Model calls are functions from DataFrame to DataFrame that the caller gives; without
them, what planning decides by itself stands.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import planning
from gristmill.operators import evidence, retrieval

Model = Callable[[DataFrame], DataFrame]


def classified(requests: DataFrame, model: Model | None = None) -> DataFrame:
    """Requests (request, text) with mode and subject.

    `model` sees those that neither words of training nor of questions decide, and sets
    model_mode and topic (null or empty where it fails).
    """
    told = requests.withColumn("mode", planning.intent(F.col("text")))
    if model is None:
        return told.withColumn("subject", F.trim("text"))
    open_ = ~planning.is_training(F.col("text")) & (F.col("mode") == "training")
    asked = model(told.where(open_)).withColumn("mode", F.coalesce(F.nullif(F.col("model_mode"), F.lit("")), F.col("mode")))
    subject = F.when(F.col("mode") == "training", F.trim(F.coalesce(F.nullif(F.col("topic"), F.lit("")), F.col("text")))).otherwise(F.trim("text"))
    asked = asked.withColumn("subject", subject).select(*told.columns, "subject")
    return asked.unionByName(told.where(~open_).withColumn("subject", F.trim("text")))


def _gathered(requests: DataFrame, queries: Column, items: DataFrame, terms: Callable[[Column], Column], mode: str, k: int, **fields) -> DataFrame:
    """Retrieval by several queries of each request, without hazards and vectors of their own."""
    none = F.array().cast("array<string>")
    asked = requests.select("request", F.explode(queries).alias("text")).withColumn("vector", F.lit(None).cast("array<double>"))
    tags = requests.select("request", *[(F.coalesce(F.col(n), none) if n in requests.columns else none).alias(n) for n in retrieval.FAMILIES])
    return retrieval.retrieve(items, tags, asked, terms, mode, k, **fields)


def answers(questions: DataFrame, norms: DataFrame, cases: DataFrame, terms: Callable[[Column], Column], answer: Model | None = None, mode: str = "bm25", k: int = 5, **fields) -> DataFrame:
    """request, answer, norms, cases and linked (arrays of ids in order), confidence and gap.

    questions: request, subject; norms and cases: item (a text), the fields of a chunk,
    for norms standard_code and article_id, for cases related_standards. Norms that
    retrieved cases refer to follow the retrieved ones. `answer` sees all that, and sets
    answer, cited_norms, cited_cases (arrays of ids), confidence, gap, and failed; citations outside the
    evidence are dropped, none left means all evidence. A failed one, or none, gives a text from the evidence.
    """
    planned = questions.withColumn("q", planning.qa_queries(F.col("subject")))
    near = _gathered(planned, F.col("q.norm_queries"), norms, terms, mode, k, **fields)
    told = _gathered(planned, F.col("q.case_queries"), cases, terms, mode, k, **fields)
    refs = told.join(cases.select("item", "related_standards"), "item").select("request", F.explode("related_standards").alias("ref"))
    extra = retrieval.by_refs(refs, norms).join(near.select("request", "item"), ["request", "item"], "left_anti")
    block = lambda rows, rank, known: rows.withColumn("rank", rank).join(known, "item").groupBy("request").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("item").alias("chunk_id"), *[F.col(c) for c in known.columns if c != "item"]))).alias("e"))
    later = extra.withColumn("rank", F.lit(k + 1))
    shown = block(near.unionByName(later.select(*near.columns)), F.col("rank"), norms.select("item", "article_id", "text")).withColumnRenamed("e", "norm_evidence")
    shown_cases = block(told, F.col("rank"), cases.select("item", "text", F.col("process") if "process" in cases.columns else F.lit(None).cast("string").alias("process"))).withColumnRenamed("e", "case_evidence")
    linked = extra.groupBy("request").agg(F.array_sort(F.collect_set("item")).alias("linked"))
    states = questions.join(shown, "request", "left").join(shown_cases, "request", "left").join(linked, "request", "left")
    fallback = evidence.fallback_answer(F.col("norm_evidence"), F.col("case_evidence"))
    if answer is None:
        none = F.lit(None).cast("array<string>")
        states = states.withColumns({"answer": F.lit(None).cast("string"), "cited_norms": none, "cited_cases": none, "confidence": F.lit(None).cast("string"), "gap": F.lit(None).cast("string"), "failed": F.lit(True)})
    else:
        states = answer(states)
    failed = F.coalesce("failed", F.lit(True))
    ids = lambda cited, items: F.coalesce(F.transform(evidence.selected(F.col(cited), F.col(items), failed), lambda x: x["chunk_id"]), F.array().cast("array<string>"))
    return states.select(
        "request", F.when(failed, fallback).otherwise(F.col("answer")).alias("answer"), ids("cited_norms", "norm_evidence").alias("norms"), ids("cited_cases", "case_evidence").alias("cases"),
        F.coalesce("linked", F.array().cast("array<string>")).alias("linked"), F.when(failed, "low").otherwise(F.col("confidence")).alias("confidence"), "gap",
    )


def dispatched(requests: DataFrame, training: Model, qa: Model, model: Model | None = None) -> DataFrame:
    """What the two programs return, with mode; each sees its own requests (request, text, subject)."""
    told = classified(requests, model)
    runs = [program(told.where(F.col("mode") == mode).drop("mode")).withColumn("mode", F.lit(mode)) for mode, program in (("training", training), ("qa", qa))]
    return runs[0].unionByName(runs[1], allowMissingColumns=True)
