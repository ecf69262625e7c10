"""Strategies that answer requests from evidence, their ablations, and the staged program of the full one.

A strategy takes requests (request, text, tags) and the libraries of norms and cases
(item, text, tags; cases also refs, norms also ref), all with vector where there are
embeddings, and returns one row for each request
and evidence: request, kind, item, rank, linked. Model calls are functions that the
caller gives: they take and return DataFrames, so that they run on executors.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.session import checkpoints
from gristmill.functions.text import bigrams
from gristmill.operators import evidence, retrieval

MAX_RETRIES = 2
DIALOGUE_BUDGET = 1


@dataclass(frozen=True)
class EngineConfig:
    top_k: int = 5
    tag_weights: Mapping[str, float] | None = None
    case_evidence: bool = True
    case_norm_linker: bool = True
    query_rewrite: bool = True
    deterministic_ground: bool = True
    arbitration: bool = True
    #: Terms of a text, for the word routes.
    terms: Callable[[Column], Column] = bigrams
    #: From requests to request, text (and vector, ordinal): further wordings of a request; rewriting is the model's part.
    rewrite: Callable[[DataFrame], DataFrame] | None = None
    #: Lists that several runs over the same requests and libraries share, by what they depend on; each is made once, in the checkpoint folder.
    made: dict[tuple, DataFrame] | None = field(default=None, compare=False)


#: What each ablation switches off.
ABLATIONS: dict[str, dict[str, bool]] = {
    "full": {},
    "no_case_evidence": {"case_evidence": False},
    "no_case_norm_linker": {"case_norm_linker": False},
    "no_query_rewrite": {"query_rewrite": False},
    "no_deterministic_ground": {"deterministic_ground": False},
    "no_arbitration": {"arbitration": False},
}

Strategy = Callable[[DataFrame, DataFrame, DataFrame, EngineConfig], DataFrame]
STRATEGIES: dict[str, Strategy] = {}


def strategy(name: str):
    def register(f: Strategy) -> Strategy:
        STRATEGIES[name] = f
        return f

    return register


def chosen(name: str) -> Strategy:
    if name not in STRATEGIES:
        raise ValueError(f"no strategy {name!r}; there are {', '.join(STRATEGIES)}")
    return STRATEGIES[name]


def ablated(config: EngineConfig, name: str) -> EngineConfig:
    if name not in ABLATIONS:
        raise ValueError(f"no ablation {name!r}; there are {', '.join(ABLATIONS)}")
    return replace(config, **ABLATIONS[name])


def _as(rows: DataFrame, kind: str) -> DataFrame:
    return rows.select("request", F.lit(kind).alias("kind"), "item", "rank", F.lit(None).cast("array<string>").alias("linked"))


def _once(config: EngineConfig, name: str, kind: str, rewritten: bool, make: Callable[[], DataFrame]) -> DataFrame:
    if config.made is None:
        return make()
    key = (name, kind, rewritten)
    if key not in config.made:
        config.made[key] = make().checkpoint()
    return config.made[key]


def _words(items: DataFrame, requests: DataFrame, config: EngineConfig, k: int) -> DataFrame:
    return retrieval.bm25(items.select("item", "text"), requests.select("request", "text"), config.terms, k)


def _wordings(requests: DataFrame, more: DataFrame | None) -> DataFrame:
    """request, wording, text and vector (null without one): the request itself is wording 0, the others are numbered by their ordinal, or by their text where they have none."""
    shape = lambda df, n: df.select("request", n.alias("wording"), "text", (F.col("vector") if "vector" in df.columns else F.lit(None)).cast("array<double>").alias("vector"))
    out = shape(requests, F.lit(0))
    return out if more is None else out.unionByName(shape(more, F.row_number().over(Window.partitionBy("request").orderBy(*retrieval.given_order(more)))))


def hybrid(items: DataFrame, requests: DataFrame, config: EngineConfig, more: DataFrame | None = None) -> DataFrame:
    """Fused ranks of a word route and a vector route for each wording of a request, and a tag route.

    Each wording is ranked on its own, so that distinct wordings don't become one bag of terms.
    The vector route takes the items and wordings that have a vector.
    """
    asked = _wordings(requests, more).withColumn("request", F.struct("request", "wording"))
    lists = [_words(items, asked, config, retrieval.DEPTH)]
    if "vector" in items.columns:
        lists.append(retrieval.nearest(items.where("vector is not null"), asked.where("vector is not null"), retrieval.DEPTH))
    route = lambda n, wording: F.struct(F.lit(n).alias("kind"), wording.alias("wording")).alias("route")
    routes = [r.select("request.request", route(i, F.col("request.wording")), "item", "rank") for i, r in enumerate(lists)]
    tagged = retrieval.tag_route(items, requests, dict(config.tag_weights or {"tags": 1.0}))
    routes.append(tagged.select("request", route(len(lists), F.lit(0)), "item", "rank"))
    return retrieval.fuse(reduce(DataFrame.unionByName, routes), config.top_k).select("request", "item", "rank")


@strategy("llm_only")
def _none(requests: DataFrame, norms: DataFrame, cases: DataFrame, config: EngineConfig) -> DataFrame:
    return _as(requests.select("request", F.lit("").alias("item"), F.lit(0).alias("rank")), "norm").limit(0)


@strategy("norm_only")
def _norm_only(requests: DataFrame, norms: DataFrame, cases: DataFrame, config: EngineConfig) -> DataFrame:
    return _as(_once(config, "words", "norm", False, lambda: _words(norms, requests, config, config.top_k)), "norm")


@strategy("naive_dual")
def _naive_dual(requests: DataFrame, norms: DataFrame, cases: DataFrame, config: EngineConfig) -> DataFrame:
    words = lambda items, kind: _as(_once(config, "words", kind, False, lambda: _words(items, requests, config, config.top_k)), kind)
    return words(norms, "norm").unionByName(words(cases, "case"))


@strategy("optimized")
def _optimized(requests: DataFrame, norms: DataFrame, cases: DataFrame, config: EngineConfig) -> DataFrame:
    found = lambda items, kind: _as(_once(config, "hybrid", kind, False, lambda: hybrid(items, requests, config)), kind)
    return found(norms, "norm").unionByName(found(cases, "case"))


@strategy("proposed")
def _proposed(requests: DataFrame, norms: DataFrame, cases: DataFrame, config: EngineConfig) -> DataFrame:
    """Both libraries by all wordings; norms that retrieved cases refer to come along with the cases that do."""
    more = config.rewrite(requests) if config.rewrite and config.query_rewrite else None
    near = _once(config, "hybrid", "norm", more is not None, lambda: hybrid(norms, requests, config, more))
    found = _as(near, "norm")
    if not config.case_evidence:
        return found
    told = _once(config, "hybrid", "case", more is not None, lambda: hybrid(cases, requests, config, more))
    found = found.unionByName(_as(told, "case"))
    if not config.case_norm_linker:
        return found
    refs = told.join(cases.select("item", "refs"), "item").select("request", F.col("item").alias("case_id"), F.explode("refs").alias("ref")).distinct()
    linked = evidence.link_merge(refs, norms.select(F.col("item").alias("chunk_id"), "ref"), near.select("request", F.col("item").alias("chunk_id")))
    extra = linked.where("linked_from is not null").select("request", F.lit("norm").alias("kind"), F.col("chunk_id").alias("item"), F.lit(None).cast("int").alias("rank"), F.col("linked_from").cast("array<string>").alias("linked"))
    return found.unionByName(extra)


def benchmark(requests: DataFrame, norms: DataFrame, cases: DataFrame, config: EngineConfig, names: list[str] | None = None) -> DataFrame:
    """Evidence of every strategy, with its name as variant; lists that strategies share are made once."""
    checkpoints(requests.sparkSession)
    config = replace(config, made={})
    runs = [chosen(n)(requests, norms, cases, config).withColumn("variant", F.lit(n)) for n in names or list(STRATEGIES)]
    return reduce(DataFrame.unionByName, runs)


def ablation_study(requests: DataFrame, norms: DataFrame, cases: DataFrame, config: EngineConfig, names: list[str] | None = None, keep: bool = False) -> DataFrame:
    """Evidence of the full strategy under each ablation, with its name as ablation.

    Ablations that act on drafts alone (see ablated_drafts) share the evidence of the full strategy, which is retrieved once.
    With keep, each retrieval goes to the checkpoint folder before the next one is planned, and lists that ablations share are made once.
    """
    alike: dict[EngineConfig, list[str]] = {}
    for n in names or list(ABLATIONS):
        alike.setdefault(replace(ablated(replace(config, tag_weights=None), n), deterministic_ground=True, arbitration=True), []).append(n)
    if keep:
        checkpoints(requests.sparkSession)
        config = replace(config, made={})
    runs = []
    for c, ns in alike.items():
        found = STRATEGIES["proposed"](requests, norms, cases, replace(c, tag_weights=config.tag_weights, made=config.made))
        runs.append((found.checkpoint() if keep else found).withColumn("ablation", F.explode(F.array(*map(F.lit, ns)))))
    return reduce(DataFrame.unionByName, runs)


def checked(judge: Callable[[DataFrame], DataFrame], config: EngineConfig) -> Callable[[DataFrame], DataFrame]:
    """The check of drafts (evidence, cited: arrays of kind and item) by the model's `judge`, which sets issues, and by citations.

    A citation outside the evidence is a hallucination, norms in the evidence of which
    none is cited are insufficient evidence, and the model's hallucinations count only
    where a citation bears them out. Without deterministic_ground the model's issues stand alone.
    """
    outside = F.size(F.array_except("cited", "evidence")) > 0
    norm = lambda x: F.exists(x, lambda e: e["kind"] == "norm")
    issue = lambda where, kind: F.when(where, F.array(F.lit(kind))).otherwise(F.array().cast("array<string>"))
    found = F.concat(issue(outside, "hallucination"), issue(norm(F.col("evidence")) & ~norm(F.array_intersect("cited", "evidence")), "evidence_insufficient"))
    issues = F.concat(F.filter("issues", lambda i: (i != "hallucination") | outside), found) if config.deterministic_ground else F.col("issues")

    def check(drafts: DataFrame) -> DataFrame:
        judged = judge(drafts).withColumn("issues", issues)
        return judged.withColumns({"passed": F.size("issues") == 0, "reason": evidence.retry_reason(F.col("issues")), "cases": F.lit(config.case_evidence)})

    return check


def ablated_drafts(
    requests: DataFrame, found: DataFrame, config: EngineConfig, author: Callable[[DataFrame], DataFrame], judge: Callable[[DataFrame], DataFrame], gather: Callable[[DataFrame], DataFrame] | None = None, names: list[str] | None = None
) -> DataFrame:
    """Final drafts of every request under each ablation, from the evidence of ablation_study (read once for each ablation: keep it).

    `author` sees request, evidence (array of kind and item, in order) and passes, and sets
    cited (array of the same type). Returned: what authored() does, with ablation and evidence.
    """
    place = F.struct("kind", F.coalesce("rank", F.lit(2**31 - 1)).alias("rank"), "item")
    runs = []
    for n in names or list(ABLATIONS):
        c = ablated(config, n)
        shown = found.where(F.col("ablation") == n).groupBy("request").agg(F.transform(F.array_sort(F.collect_list(place)), lambda e: F.struct(e["kind"].alias("kind"), e["item"].alias("item"))).alias("evidence"))
        states = requests.select("request").join(shown, "request", "left")
        states = states.withColumn("evidence", F.coalesce("evidence", F.array().cast(shown.schema["evidence"].dataType)))
        runs.append(authored(states, author, checked(judge, c), c, gather).withColumn("ablation", F.lit(n)))
    return reduce(DataFrame.unionByName, runs)


def authored(states: DataFrame, author: Callable[[DataFrame], DataFrame], check: Callable[[DataFrame], DataFrame], config: EngineConfig | None = None, gather: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """states (request and whatever `author` needs) after authoring, checks and arbitration, with passes and route.

    `author` adds or replaces drafts; `check` sets passed (boolean), reason (string) and
    cases (boolean: whether case evidence can be asked for). A request whose draft fails
    goes where the decision table sends it: back to the author, back to `gather` for
    evidence once, or out. Each pass handles the unfinished requests alone and is
    written to the checkpoint folder; the table ends the loop after MAX_RETRIES retries.
    """
    config = config or EngineConfig()
    checkpoints(states.sparkSession)
    open_, done = states.withColumns({"passes": F.lit(0), "budget": F.lit(DIALOGUE_BUDGET)}), []
    for _ in range(MAX_RETRIES + 1):
        judged = check(author(open_)).withColumn("passes", F.col("passes") + 1)
        if not config.arbitration:
            return judged.withColumn("route", F.lit("training_agent")).drop("budget")
        retries = F.when(F.col("passed"), F.col("passes") - 1).otherwise(F.col("passes"))
        judged = judged.withColumn("route", evidence.route(F.col("passed"), F.col("reason"), retries, F.col("budget"), F.col("cases"))).checkpoint()
        done.append(judged.where("route = 'training_agent'"))
        open_ = judged.where("route <> 'training_agent'")
        if open_.isEmpty():
            break
        asked = F.col("route") == "evidence_subgraph"
        open_ = open_.withColumn("budget", F.when(asked, F.col("budget") - 1).otherwise(F.col("budget")))
        if gather is not None:
            open_ = gather(open_.where(asked)).unionByName(open_.where(~asked), allowMissingColumns=True)
        open_ = open_.drop("route", "passed", "reason", "cases")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), done).drop("budget")
