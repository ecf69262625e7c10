"""Linking, grounding, hydration and arbitration of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import shorten

MAX_RETRIES = 2

# Texts of issues, notes and fallbacks.
STRAY_NORM, STRAY_CASE = "规范引用 chunk_id=%s 不在本轮检索证据中", "案例引用 chunk_id=%s 不在本轮检索证据中"
UNCITED = "本轮检索到规范证据，但草稿未引用任何有效规范 chunk_id"
SUPPLEMENTARY_NOTE = "补充警示：本案例经验仅作参考，安全要求以规范条文为准。"
REQUEST_NOTE = "针对上述未被充分支撑的危险源/要求，生成与上一轮明显不同的检索查询，补充规范条文与事故案例证据。"
NORM_ANSWER, CASE_ANSWER, NO_ANSWER = "根据检索到的规范依据（%s），%s", "当前未形成完整生成回答；检索到的相似事故提示：%s", "（回答生成失败，请以现场安全交底为准）"
ANY_ARTICLE, MOST_ANSWER = "相关条文", 180


def link_merge(refs: DataFrame, chunks: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Chunks that cases cite and retrieval did not bring, with the sorted cases that cite them, beside the retrieved ones.

    refs: request, case_id, ref; chunks: chunk_id, ref; retrieved: request, chunk_id.
    Retrieved chunks gain no provenance. Repeated references fall together with the cases' sets.
    """
    linked = refs.join(chunks, "ref").join(retrieved, ["request", "chunk_id"], "left_anti")
    linked = linked.groupBy("request", "chunk_id").agg(F.array_sort(F.collect_set("case_id")).alias("linked_from"))
    return retrieved.select("request", "chunk_id").withColumn("linked_from", F.lit(None).cast(linked.schema["linked_from"].dataType)).unionByName(linked)


def ungrounded(cited: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Cited rows without evidence; repeated citations stay repeated."""
    return cited.join(evidence.select(*keys).distinct(), keys, "left_anti")


def hydrate(selected: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence rows of the selected ids in their order, each once; a request that selected none gets all.

    selected: request, once, ids (array); evidence: request, chunk_id, pos. A request's
    evidence is together as an array; requests are all that meets in the join.
    """
    rest = [c for c in evidence.columns if c not in ("request", "chunk_id", "pos")]
    shown = evidence.groupBy("request").agg(F.collect_list(F.struct("chunk_id", "pos", *rest)).alias("_e"))
    ids = F.array_distinct("ids")
    met = selected.select("request", F.when(F.size("ids") > 0, ids).alias("_ids")).join(shown, "request").select("request", "_ids", F.explode("_e").alias("_e"))
    place = F.when(F.col("_ids").isNull(), F.col("_e.pos")).otherwise((F.array_position("_ids", F.col("_e.chunk_id")) - 1).cast(evidence.schema["pos"].dataType))
    out = met.where(F.col("_ids").isNull() | F.array_contains("_ids", F.col("_e.chunk_id")))
    return out.select("request", "_e.chunk_id", place.alias("pos"), *[F.col(f"_e.`{c}`") for c in rest])


def route(passed: Column, reason: Column, retries: Column, budget: Column, cases: Column) -> Column:
    """Where a checked draft goes: a fixed decision table."""
    on = F.lit("training_agent")
    return (
        F.when(passed | (retries > MAX_RETRIES) | (reason == "norm_case_conflict"), on)
        .when(reason == "evidence_insufficient", F.when((budget > 0) & cases, F.lit("evidence_subgraph")).otherwise(on))
        .when(reason == "hallucination", F.lit("authoring_subgraph"))
        .otherwise(on)
    )


def decided(passed: bool, reason: str | None, retries: int, budget: int, cases: bool) -> str:
    """`route` for one draft, where its state is not a column (streams)."""
    if passed or retries > MAX_RETRIES or reason not in ("evidence_insufficient", "hallucination"):
        return "training_agent"
    if reason == "hallucination":
        return "authoring_subgraph"
    return "evidence_subgraph" if budget > 0 and cases else "training_agent"


def retry_reason(kinds: Column) -> Column:
    """The gravest kind of issue in an array."""
    out = F.lit("")
    for kind in ("evidence_insufficient", "norm_case_conflict", "hallucination"):
        out = F.when(F.array_contains(kinds, kind), F.lit(kind)).otherwise(out)
    return out


def references(text: Column, code: str, article: str = r"\d+(?:\.\d+)+") -> Column:
    """CODE:article pairs: each code owns the articles up to the next code; a code without any stands alone."""
    parts = F.filter(F.split(text, f"(?={code})"), lambda p: p.rlike(f"^{code}"))
    own = lambda p: F.regexp_extract_all(F.regexp_replace(p, f"^{code}", ""), F.lit(article), F.lit(0))
    refs = lambda p: F.when(F.size(own(p)) > 0, F.transform(own(p), lambda a: F.concat(F.regexp_extract(p, code, 0), F.lit(":"), a))).otherwise(F.array(F.regexp_extract(p, code, 0)))
    return F.array_distinct(F.flatten(F.transform(parts, refs)))


def _ids(ids: Column) -> Column:
    return F.filter(F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")


def grounding_issues(cited_norms: Column, cited_cases: Column, norms: Column, cases: Column) -> Column:
    """Issues (type, description, location) of a draft's citations against the evidence, all arrays of ids.

    Each citation outside the evidence is a hallucination, repeated ones too; norms in the
    evidence of which none is cited are insufficient evidence.
    """
    issue = lambda kind, told, where: F.struct(F.lit(kind).alias("type"), told.alias("description"), F.lit(where).alias("location"))
    none = F.array().cast("array<string>")
    known, known_cases, said = F.coalesce(norms, none), F.coalesce(cases, none), _ids(cited_norms)
    stray = lambda ids, among, text, where: F.transform(F.filter(ids, lambda x: ~F.array_contains(among, x)), lambda x: issue("hallucination", F.format_string(text, x), where))
    empty = F.array().cast("array<struct<type:string,description:string,location:string>>")
    uncited = F.when((F.size(known) > 0) & ~F.exists(said, lambda x: F.array_contains(known, x)), F.array(issue("evidence_insufficient", F.lit(UNCITED), "norm_requirements"))).otherwise(empty)
    return F.concat(stray(said, known, STRAY_NORM, "norm_requirements"), uncited, stray(_ids(cited_cases), known_cases, STRAY_CASE, "accident_warnings"))


def consistency(drafts: DataFrame, deterministic_ground: bool = True) -> DataFrame:
    """Drafts with issues, passed, reason and retries, from the model's issues and the citations.

    drafts: model_issues (array of type, description, location; null: none), cited_norms,
    cited_cases, norms, cases (arrays of ids), retries. The model's hallucinations stay
    only where a citation bears them out; its other issues always do.
    """
    empty = F.array().cast("array<struct<type:string,description:string,location:string>>")
    own = grounding_issues(F.col("cited_norms"), F.col("cited_cases"), F.col("norms"), F.col("cases")) if deterministic_ground else empty
    out = drafts.withColumn("\u0001own", own)
    borne = F.exists("\u0001own", lambda i: i["type"] == "hallucination")
    model = F.filter(F.coalesce("model_issues", empty), lambda i: ~F.coalesce(i["type"] == "hallucination", F.lit(False)) | borne)
    out = out.withColumn("issues", F.concat(model, F.col("\u0001own"))).drop("\u0001own")
    passed = F.size("issues") == 0
    kinds = F.transform("issues", lambda i: i["type"])
    return out.withColumns({"passed": passed, "reason": F.when(passed, "").otherwise(retry_reason(kinds)), "retries": F.when(passed, F.col("retries")).otherwise(F.col("retries") + 1)})


def evidence_request(issues: Column, hazards: Column) -> Column:
    """What the next round of retrieval is asked for: the reason, what is missing, the hazards and an instruction."""
    missing = F.transform(F.filter(issues, lambda i: i["type"] == "evidence_insufficient"), lambda i: F.coalesce(i["description"], F.lit("")))
    return F.struct(F.lit("evidence_insufficient").alias("reason"), missing.alias("missing"), F.coalesce(hazards, F.array().cast("array<string>")).alias("hazards"), F.lit(REQUEST_NOTE).alias("instruction"))


def supplementary(cases: Column, conflict: Column) -> Column:
    """Cases (structs) with priority and arbitration_note, both null unless norms and cases are in conflict."""
    mark = lambda text: F.when(conflict, F.lit(text))
    return F.transform(cases, lambda c: c.withField("priority", mark("supplementary")).withField("arbitration_note", mark(SUPPLEMENTARY_NOTE)))


def selected(ids: Column, items: Column, failed: Column | None = None, linked: Column | None = None) -> Column:
    """The items (structs with chunk_id) that ids select, in their order, repeated ones too; all items if none is selected or the model failed.

    `linked` are ids that count as valid, though only items can be shown.
    """
    valid = F.transform(items, lambda x: x["chunk_id"])
    if linked is not None:
        valid = F.array_union(valid, linked)
    known = F.filter(F.coalesce(ids, F.array().cast("array<string>")), lambda i: F.array_contains(valid, i))
    chosen = F.filter(F.transform(known, lambda i: F.get(F.filter(items, lambda x: x["chunk_id"] == i), F.lit(0))), lambda x: x.isNotNull())
    return F.when((F.size(chosen) <= 0) | (F.lit(False) if failed is None else F.coalesce(failed, F.lit(False))), items).otherwise(chosen)


def fallback_answer(norms: Column, cases: Column) -> Column:
    """An answer from the first norm (article_id, text), else the first case (text, process), else a fixed one."""
    cut = lambda text: shorten(F.trim(F.coalesce(text, F.lit(""))), MOST_ANSWER)
    norm, case = F.get(norms, F.lit(0)), F.get(cases, F.lit(0))
    article = F.coalesce(F.nullif(norm["article_id"], F.lit("")), F.lit(ANY_ARTICLE))
    told = F.coalesce(F.nullif(case["text"], F.lit("")), case["process"])
    return F.when(F.coalesce(F.size(norms), F.lit(0)) > 0, F.format_string(NORM_ANSWER, article, cut(norm["text"]))).when(F.coalesce(F.size(cases), F.lit(0)) > 0, F.format_string(CASE_ANSWER, cut(told))).otherwise(NO_ANSWER)
