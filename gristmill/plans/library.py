"""Registered queries of chunk building, gold tasks, retrieval modes, checks and comparisons, each with its SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import text as tx
from gristmill.functions.session import TASK_TEXTS, dealt, shared_folder
from gristmill.operators import ann, chunking, evaluation, evidence, index, retrieval, tasks
from gristmill.plans import benchmark
from gristmill.plans.catalog import _TOK, _knn, _KNN, _requests, ORACLE_SQL, query, table

#: References that name one article at most, about, and meet its items in one task.
PART_ROWS = 2_000_000
_HEAD = "'标准：GB 1 2000' || chr(10) || '章节：03 通则' || chr(10) || '编号：' || n || chr(10) || '正文：'"


@query(f"""WITH p AS (SELECT *, '1.' || CAST(p_partkey % 9 + 1 AS VARCHAR) AS n FROM part),
a AS (SELECT p_partkey, n || '.1' AS n, '必须' || p_name AS title, '强制性要求' AS requirement_type, n || '.1 必须' || p_name || chr(10) || '续 ' || p_type || chr(10) || '2.5 mm ' || p_brand AS body FROM p
  UNION ALL SELECT p_partkey, n || '.2', '检查' || p_name, '检查验收', n || '.2 检查' || p_name FROM p)
SELECT CAST(p_partkey AS VARCHAR) AS source_path, 'norm::GB-1-2000::article::' || n AS chunk_id, title, requirement_type, md5({_HEAD} || body) AS digest FROM a""")
def article_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part is a text of two articles, with a measure that begins a line and no article."""
    n = F.concat(F.lit("1."), (F.col("p_partkey") % 9 + 1).cast("string"))
    lines = (F.lit("前言"), F.concat(n, F.lit(".1 必须"), "p_name"), F.concat(F.lit("续 "), "p_type"), F.concat(F.lit("2.5 mm "), "p_brand"), F.concat(n, F.lit(".2 检查"), "p_name"))
    fixed = {"standard_code": "GB-1-2000", "standard_name": "GB 1 2000", "chapter": "03 通则", "chapter_no": "03", "chapter_title": "通则"}
    # a file's few bytes hold many parts, so tasks by its size would be too few for the texts made of them
    parts = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand"), "p_partkey", TASK_TEXTS)
    docs = parts.select(*[F.lit(v).alias(k) for k, v in fixed.items()], F.col("p_partkey").cast("string").alias("source_path"), F.concat_ws("\n", *lines).alias("text"))
    return chunking.article_chunks(docs).select("source_path", "chunk_id", "title", "requirement_type", F.md5("text").alias("digest"))


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.create_map(
        F.lit("地点"), F.col("s_nationkey").cast("string"), F.lit("事故经过"), F.when(F.col("s_suppkey") % 3 == 0, "支架坍塌").otherwise("施工"), F.lit("直接原因"), F.when(F.col("s_suppkey") % 2 == 0, "失稳").otherwise("")
    )
    return chunking.case_chunks(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("number"), F.col("s_name").alias("title"), fields.alias("fields"), F.lit("cases.md").alias("path")))


_CASES = """c AS (SELECT s_name, s_suppkey, 'case::' || printf('case-%02d', s_suppkey) AS id, CASE WHEN s_suppkey % 3 = 0 THEN '坍塌' ELSE '其他' END AS accident_type, CASE WHEN s_suppkey % 3 = 0 THEN '支架坍塌' ELSE '施工' END AS process, s_nationkey FROM supplier),
k AS (SELECT id || '::summary' AS chunk_id, 'case_summary' AS kind, id, accident_type, '案例：' || s_name || chr(10) || '类型：' || accident_type || chr(10) || '地点：' || CAST(s_nationkey AS VARCHAR) || chr(10) || '经过：' || process AS text FROM c
  UNION ALL SELECT id || '::cause', 'case_cause', id, accident_type, '案例：' || s_name || '（原因）' || chr(10) || '直接原因：失稳' FROM c WHERE s_suppkey % 2 = 0)"""


@query(f"WITH {_CASES} SELECT chunk_id, accident_type, md5(text) AS digest FROM k")
def case_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir).select("chunk_id", "accident_type", F.md5("text").alias("digest"))


@query(f"""WITH {_CASES}, b AS (SELECT string_agg(kind || ':' || CAST(n AS VARCHAR), ',' ORDER BY kind) AS by_kind FROM (SELECT kind, count(*) AS n FROM k GROUP BY kind)),
a AS (SELECT string_agg(accident_type || ':' || CAST(n AS VARCHAR), ',' ORDER BY n, accident_type) AS by_accident FROM (SELECT accident_type, count(*) AS n FROM k GROUP BY accident_type))
SELECT count(*) AS chunk_count, count(DISTINCT id) AS case_count, count(*) - count(DISTINCT chunk_id) AS duplicates, by_kind, by_accident FROM k, a, b GROUP BY by_kind, by_accident""")
def case_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = chunking.case_report(_cases(spark, sf_dir))
    entries = lambda c, sort: F.array_join(F.transform(F.array_sort(F.transform(F.map_entries(c), sort)), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    by_key, by_n = lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")), lambda e: F.struct(e["value"].alias("value"), e["key"].alias("key"))
    return told.select("chunk_count", "case_count", F.col("duplicate_chunk_id_count").alias("duplicates"), entries("by_chunk_kind", by_key).alias("by_kind"), entries("by_accident_type", by_n).alias("by_accident"))


@query("""WITH lib AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN 'JGJ-' || CAST(p_size AS VARCHAR) || '-2000' ELSE 'GB-T' || CAST(p_size AS VARCHAR) || '-2010' END AS code, CAST(p_partkey % 25 AS VARCHAR) || '.1' AS article FROM part),
named AS (SELECT core, max(code) AS code FROM (SELECT code, unnest([string_split(code, '-')[2], ltrim(string_split(code, '-')[2], 'T')]) AS core FROM lib) GROUP BY core),
t AS (SELECT c_custkey AS id, CAST(c_nationkey AS VARCHAR) || '.1' AS article, unnest([CAST(c_custkey % 50 + 1 AS VARCHAR), 'T' || CAST(c_custkey % 30 + 1 AS VARCHAR), CAST(c_custkey % 30 + 1 AS VARCHAR)]) AS core FROM customer),
f AS (SELECT DISTINCT id, code || ':' || article AS ref FROM t JOIN named USING (core) WHERE (code, article) IN (SELECT (code, article) FROM lib))
SELECT c_custkey AS id, coalesce(string_agg(ref, ',' ORDER BY ref), '') AS refs FROM customer LEFT JOIN f ON f.id = c_custkey GROUP BY c_custkey""")
def verified_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size").cast("string"), F.col("p_partkey")
    code = F.when(key % 2 == 0, F.concat(F.lit("JGJ-"), size, F.lit("-2000"))).otherwise(F.concat(F.lit("GB-T"), size, F.lit("-2010")))
    library = table(spark, sf_dir, "part").select(code.alias("standard_code"), F.concat((key % 25).cast("string"), F.lit(".1")).alias("article_id"))
    told = F.concat(F.lit("违反JGJ "), F.col("c_custkey") % 50 + 1, F.lit(" 第"), "c_nationkey", F.lit(".1条，GB/T "), F.col("c_custkey") % 30 + 1, F.lit("。"))
    texts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), told.alias("text"))
    return tasks.verified_refs(texts, library).withColumn("refs", F.array_join("refs", ","))


@query(f"""WITH d AS MATERIALIZED (SELECT doc_id AS item, source AS code, {_TOK} AS t FROM documents), st AS (SELECT count(*) AS items, avg(len(t)) AS mean FROM d),
tf AS MATERIALIZED (SELECT item, code, term, count(*) AS tf, any_value(n) AS n FROM (SELECT item, code, len(t) AS n, unnest(t) AS term FROM d) GROUP BY item, code, term),
q AS (SELECT DISTINCT request, code, unnest(t) AS term FROM (SELECT item_id AS request, 'src' || CAST(item_id % 20 AS VARCHAR) AS code, {_TOK} AS t FROM benchmark)),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT request, item, round(sum(ln(1 + (items - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * n / mean))), 6) AS score FROM q JOIN tf USING (code, term) JOIN df USING (term), st GROUP BY request, item)
SELECT request, item, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, item) AS rank FROM s) WHERE rank <= 2""")
def proxy_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best documents of the source that a request is about."""
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.col("source").alias("code"), "text")
    requests = _requests(spark, sf_dir).withColumn("code", F.concat(F.lit("src"), F.col("request") % 20))
    return tasks.proxy_articles(requests, items, tx.tokens).select("request", "item", "score", "rank")


@query(f"""WITH r AS (SELECT item_id AS request, text FROM benchmark UNION ALL SELECT -1, 'en' UNION ALL SELECT -2, 'src3'),
w AS MATERIALIZED (SELECT 4.0::DOUBLE AS boost, doc_id AS item, {_TOK} AS t FROM documents UNION ALL SELECT 3.0::DOUBLE, doc_id, {_TOK.replace('text', "(source || ' ' || lang)")} FROM documents),
st AS (SELECT boost, count(*) AS items, avg(len(t)) AS mean FROM w GROUP BY boost),
tf AS MATERIALIZED (SELECT boost, item, term, count(*) AS tf, any_value(n) AS n FROM (SELECT boost, item, len(t) AS n, unnest(t) AS term FROM w) GROUP BY boost, item, term),
q AS (SELECT DISTINCT request, unnest(t) AS term FROM (SELECT request, {_TOK} AS t FROM r)),
df AS (SELECT boost, term, count(*) AS df FROM tf GROUP BY boost, term),
ws AS (SELECT request, item, round(sum(ln(1 + (items - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * n / mean))), 6) * boost AS score FROM q JOIN tf USING (term) JOIN df USING (boost, term) JOIN st USING (boost) GROUP BY request, item, boost),
kw AS (SELECT doc_id AS item, unnest([lang, source, lang, source, lang, source]) AS v, unnest([3.0, 5.0, 2.0, 2.0, 1.0, 1.0])::DOUBLE AS boost, unnest(range(6)) AS field FROM documents),
kd AS (SELECT field, v, count(*) AS df FROM kw GROUP BY field, v),
ks AS (SELECT request, item, round(ln(1 + ((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5)) / 2.2, 6) * boost AS score FROM r JOIN kw ON v = r.text JOIN kd USING (field, v)),
m AS (SELECT request, item, round(max(score), 6) AS score FROM (SELECT * FROM ws UNION ALL SELECT * FROM ks) GROUP BY request, item)
SELECT request, item, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, item) AS rank FROM m) WHERE rank <= 20""")
def bm25_eight_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of text and title, whole values of the six other fields, which language and source stand for."""
    keys = {"standard_code": F.col("lang"), "article_id": F.col("source"), "scenario_tags": F.array("lang"), "hazard_tags": F.array("source"), "requirement_type": F.col("lang"), "chunk_kind": F.col("source")}
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), "text", F.concat_ws(" ", "source", "lang").alias("title"), *[c.alias(n) for n, c in keys.items()])
    requests = _requests(spark, sf_dir).unionByName(spark.createDataFrame([(-1, "en"), (-2, "src3")], "request long, text string"))
    return retrieval.bm25_fields(items, requests, tx.tokens).select("request", "item", "score", "rank")


@query(f"""WITH d AS MATERIALIZED (SELECT doc_id AS item, lang, source, embedding, {_TOK} AS t FROM documents LEFT JOIN embeddings ON vec_id = doc_id), st AS (SELECT count(*) AS items, avg(len(t)) AS mean FROM d),
r AS MATERIALIZED (SELECT item_id AS request, 'src' || CAST(item_id % 20 AS VARCHAR) AS source, CASE item_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' ELSE 'es' END AS lang, embedding, {_TOK} AS t FROM benchmark LEFT JOIN embeddings ON vec_id = 3 * item_id),
tf AS MATERIALIZED (SELECT item, term, count(*) AS tf, any_value(n) AS n FROM (SELECT item, len(t) AS n, unnest(t) AS term FROM d) GROUP BY item, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT 0 AS kind, request, item, 4.0 * round(sum(ln(1 + (items - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * n / mean))), 6) AS score FROM (SELECT DISTINCT request, unnest(t) AS term FROM r) JOIN tf USING (term) JOIN df USING (term), st GROUP BY request, item
  UNION ALL SELECT 1, request, item, round(list_cosine_similarity(r.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) FROM r, d WHERE r.embedding IS NOT NULL AND d.embedding IS NOT NULL
  UNION ALL SELECT 2, request, item, (CASE WHEN d.source = r.source THEN 2.0 ELSE 0.0 END) + (CASE WHEN d.lang = r.lang THEN 1.0 ELSE 0.0 END) FROM r, d WHERE d.source = r.source OR d.lang = r.lang),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY kind, request ORDER BY score DESC, item) AS rank FROM s QUALIFY rank <= 20),
f AS (SELECT mode, request, item, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score, min(rank) AS best, min(kind * 1000 + rank) AS seen FROM l JOIN (VALUES ('bm25', 0), ('vector', 1), ('tag', 2), ('rrf_hybrid', 0), ('rrf_hybrid', 1), ('rrf_hybrid', 2)) m(mode, kind) USING (kind) GROUP BY mode, request, item)
SELECT mode, request, item, rank FROM (SELECT f.*, row_number() OVER (PARTITION BY mode, f.request ORDER BY score DESC, CAST(d.source = r.source AS INTEGER) DESC, CAST(d.lang = r.lang AS INTEGER) DESC, best, seen, f.item) AS rank FROM f JOIN d USING (item) JOIN r USING (request)) WHERE rank <= 5""")
def retrieval_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best items of each request by each mode; request r has the vector of number 3 r."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), "text", F.array("lang").alias("scenario_tags"), F.array("source").alias("hazard_tags"))
    items = items.join(vectors, F.col("item") == F.col("vec_id"), "left").drop("vec_id")
    lang = F.element_at(F.array(*[F.lit(x) for x in ("en", "de", "fr", "es")]), (F.col("request") % 4 + 1).cast("int"))
    requests = _requests(spark, sf_dir).select("request", F.array(lang).alias("scenario_tags"), F.array(F.concat(F.lit("src"), F.col("request") % 20)).alias("hazard_tags"))
    queries = _requests(spark, sf_dir).join(vectors, F.col("vec_id") == 3 * F.col("request"), "left").drop("vec_id")
    runs = retrieval.retrieve_all(items, requests, queries, tx.tokens, words={"text": 4.0}, keywords={})
    return reduce(DataFrame.unionByName, (found.select(F.lit(m).alias("mode"), "request", "item", "rank") for m, found in runs.items()))


@query("""SELECT DISTINCT l_orderkey AS request, p_partkey AS item FROM lineitem JOIN part ON p_partkey % 20 = l_partkey % 20 AND p_size = l_linenumber WHERE l_linenumber % 3 <> 0""")
def articles_by_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = lambda c: F.concat(F.lit("C-"), (F.col(c) % 20).cast("string"))
    ref = F.when(F.col("l_linenumber") % 3 == 0, "《law》:1").otherwise(F.concat(code("l_partkey"), F.lit(": "), "l_linenumber"))
    lines = table(spark, sf_dir, "lineitem")
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), code("p_partkey").alias("standard_code"), F.col("p_size").cast("string").alias("article_id"))
    return retrieval.by_refs(lines.select(F.col("l_orderkey").alias("request"), ref.alias("ref")), items, 1 + lines.count() // PART_ROWS)


def _lists(spark: SparkSession, sf_dir: str, **which: tuple[str, str]) -> DataFrame:
    """Orders with arrays, sorted by line: for each name, a column (as text) of the lines that a condition holds for."""
    lines = table(spark, sf_dir, "lineitem")
    some = lambda where, c: F.transform(F.array_sort(F.collect_list(F.when(F.expr(where), F.struct("l_linenumber", F.col(c).cast("string").alias("v"))))), lambda x: x["v"])
    sets = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(*[some(where, c).alias(n) for n, (where, c) in which.items()])
    return table(spark, sf_dir, "orders").join(sets, "o_orderkey", "left")


@query("""WITH s AS (SELECT o_orderkey, any_value(left(o_orderpriority, 1)) AS p, any_value(o_custkey % 3) AS before, coalesce(list(l_partkey) FILTER (l_returnflag = 'R'), []) AS cn, coalesce(list(l_suppkey) FILTER (l_tax > 0.03), []) AS cc,
  coalesce(list(l_partkey) FILTER (l_quantity > 25), []) AS en, coalesce(list(l_suppkey) FILTER (l_quantity < 40), []) AS ec FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey),
k AS (SELECT *, len(list_filter(cn, lambda x: NOT list_contains(en, x))) + len(list_filter(cc, lambda x: NOT list_contains(ec, x))) AS stray, CASE WHEN len(en) > 0 AND len(list_filter(cn, lambda x: list_contains(en, x))) = 0 THEN 1 ELSE 0 END AS lacking FROM s),
n AS (SELECT *, stray + lacking + CASE WHEN p = '1' OR (p = '2' AND stray > 0) THEN 1 ELSE 0 END AS n FROM k)
SELECT o_orderkey, CAST(n AS BIGINT) AS n_issues, n = 0 AS passed, CASE WHEN stray > 0 THEN 'hallucination' WHEN p = '1' THEN 'norm_case_conflict' WHEN lacking = 1 THEN 'evidence_insufficient' ELSE '' END AS reason, CAST(before + CASE WHEN n > 0 THEN 1 ELSE 0 END AS BIGINT) AS retries FROM n""")
def consistency_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lists(spark, sf_dir, cited_norms=("l_returnflag = 'R'", "l_partkey"), cited_cases=("l_tax > 0.03D", "l_suppkey"), norms=("l_quantity > 25", "l_partkey"), cases=("l_quantity < 40", "l_suppkey"))
    issue: Column = F.when(F.col("o_orderpriority").startswith("1"), "norm_case_conflict").when(F.col("o_orderpriority").startswith("2"), "hallucination")
    told = F.when(issue.isNotNull(), F.array(F.struct(issue.alias("type"), F.lit("").alias("description"), F.lit("").alias("location"))))
    out = evidence.consistency(rows.withColumns({"model_issues": told, "retries": F.col("o_custkey") % 3}))
    return out.select("o_orderkey", F.size("issues").cast("long").alias("n_issues"), "passed", "reason", F.col("retries").cast("long").alias("retries"))


@query("""WITH s AS (SELECT o_orderkey, any_value(o_custkey % 10 = 0) AS failed, coalesce(list(CAST(l_partkey AS VARCHAR) ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) FILTER (l_returnflag = 'R'), []) AS ids, coalesce(list(CAST(l_partkey AS VARCHAR) ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) FILTER (l_quantity > 25), []) AS items
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey), k AS (SELECT *, list_filter(ids, lambda x: list_contains(items, x)) AS chosen FROM s)
SELECT o_orderkey, coalesce(array_to_string(CASE WHEN failed OR len(chosen) = 0 THEN items ELSE chosen END, ','), '') AS shown FROM k""")
def selected_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lists(spark, sf_dir, ids=("l_returnflag = 'R'", "l_partkey"), chunk_ids=("l_quantity > 25", "l_partkey"))
    items = F.transform(F.coalesce("chunk_ids", F.array().cast("array<string>")), lambda x: F.struct(x.alias("chunk_id")))
    shown = evidence.selected(F.col("ids"), items, F.col("o_custkey") % 10 == 0)
    return rows.select("o_orderkey", F.array_join(F.transform(shown, lambda x: x["chunk_id"]), ",").alias("shown"))


@query("SELECT l_returnflag AS variant, count(*) AS n_tasks, round(avg(l_quantity), 4) AS l_quantity_mean, round(avg(l_discount), 4) AS l_discount_mean FROM lineitem GROUP BY l_returnflag")
def variant_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.means(table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "variant"), "variant", ["l_quantity", "l_discount"])


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, item) AS rank FROM ({_KNN}) QUALIFY rank <= 20), h AS (SELECT request, min(CASE WHEN ql = el THEN rank END) AS first, max(CASE WHEN ql = el THEN 1.0 ELSE 0.0 END)::DOUBLE AS hit FROM r GROUP BY request)
SELECT count(*) AS evaluated, round(avg(hit), 4) AS hit, round(avg(round(coalesce(1 / first, 0), 6)), 4) AS mrr FROM h""")
def ir_metric_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), F.col("label").alias("class"))
    requests = items.where("item % 100 = 0").withColumnRenamed("item", "request")
    return evaluation.ir_means(evaluation.ir_metrics_by_class(_knn(spark, sf_dir), requests, items, 20), ["hit", "mrr"])


_RUNS = "v AS MATERIALIZED (SELECT l_returnflag AS dataset, CASE WHEN l_linestatus = 'F' THEN 'proposed' ELSE 'optimized' END AS grp, l_suppkey AS task, round(avg(l_quantity), 6) AS value FROM lineitem GROUP BY ALL)"
_STATS = "count(*) AS n_pairs, round(avg(l), 6) AS left_mean, round(avg(r), 6) AS right_mean, round(avg(l - r), 6) AS mean_delta"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three datasets (return flags) and two groups (line states) over tasks (suppliers)."""
    group = F.when(F.col("l_linestatus") == "F", "proposed").otherwise("optimized")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("dataset"), group.alias("grp"), F.col("l_suppkey").alias("task")).agg(F.round(F.avg("l_quantity"), 6).alias("value"))
    return rows.withColumns({"family": F.lit("variant"), "metric": F.lit("quantity")})


@query(f"""WITH {_RUNS}, p AS (SELECT a.dataset, a.value AS l, b.value AS r FROM v a JOIN v b USING (dataset, task) WHERE a.grp = 'proposed' AND b.grp = 'optimized')
SELECT s.dataset, s.n_pairs, s.left_mean, s.right_mean, s.mean_delta, round(sum(sign(x.l - y.r)) / count(*), 6) AS cliffs_delta FROM (SELECT dataset, {_STATS} FROM p GROUP BY dataset) s JOIN p x ON x.dataset = s.dataset JOIN p y ON y.dataset = s.dataset GROUP BY ALL""")
def within_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.within_datasets(_runs(spark, sf_dir)).select("dataset", "n_pairs", "left_mean", "right_mean", "mean_delta", "cliffs_delta")


@query(f"""WITH {_RUNS}, p AS (SELECT a.grp, a.dataset AS left_dataset, b.dataset AS right_dataset, a.value AS l, b.value AS r FROM v a JOIN v b USING (grp, task) WHERE a.dataset < b.dataset)
SELECT s.grp, s.left_dataset, s.right_dataset, s.n_pairs, s.left_mean, s.right_mean, s.mean_delta, round(sum(sign(x.l - y.r)) / count(*), 6) AS cliffs_delta
FROM (SELECT grp, left_dataset, right_dataset, {_STATS} FROM p GROUP BY ALL) s JOIN p x USING (grp, left_dataset, right_dataset) JOIN p y USING (grp, left_dataset, right_dataset) GROUP BY ALL""")
def between_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.between_datasets(_runs(spark, sf_dir)).select("grp", "left_dataset", "right_dataset", "n_pairs", "left_mean", "right_mean", "mean_delta", "cliffs_delta")


@query("""SELECT 'missing' AS side, c_custkey FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'extra', o_custkey FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)""")
def unmatched_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.unmatched(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), table(spark, sf_dir, "customer"), "c_custkey")


def _inverted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, ann.Lists]:
    """Vectors, every hundredth of them as a request, and the stored lists of them all."""
    rows = table(spark, sf_dir, "embeddings")
    items = rows.select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector"))
    lists = ann.build(items, f"{shared_folder(spark)}/lists/{uuid.uuid4().hex}")
    return items, items.where("item % 100 = 0").withColumnRenamed("item", "request"), lists


@query(f"SELECT request, item, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, item) AS rank FROM ({_KNN})) WHERE rank <= 20")
def knn_all_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverted lists, all of them probed: the exact answer."""
    _, requests, lists = _inverted(spark, sf_dir)
    return ann.nearest(lists, requests, 20, probes=ann.LISTS, digits=4)


@query("SELECT count(*) AS requests, TRUE AS recall_reached FROM embeddings WHERE vec_id % 100 = 0")
def knn_lists_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether inverted lists, probed as far as a sample shows to be needed, find nine tenths of what is nearest."""
    items, requests, lists = _inverted(spark, sf_dir)
    exact = retrieval.nearest(items, requests, 20, digits=4)
    found = ann.recall(ann.nearest(lists, requests, 20, probes=ann.probes_for(lists, 20), digits=4), exact)
    return found.agg(F.count("*").alias("requests"), (F.avg("recall") >= 0.9).alias("recall_reached"))


def _stored(spark: SparkSession, sf_dir: str) -> index.Index:
    """The stored index of documents, which the first query of a state of the table writes."""
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), "text")
    return index.kept(items, f"{sf_dir}/documents.parquet", {"text": tx.tokens(F.col("text"))}, "tokens")


@query(f"SELECT term, count(*) AS df, CAST(max(tf) AS INTEGER) AS max_tf, CAST(min(length) AS INTEGER) AS min_length FROM (SELECT doc_id, term, count(*) AS tf, any_value(length) AS length FROM (SELECT doc_id, len(t) AS length, unnest(t) AS term FROM (SELECT doc_id, {_TOK} AS t FROM documents)) GROUP BY ALL) GROUP BY term")
def stored_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stored index of documents says of its terms."""
    return _stored(spark, sf_dir).table("terms").select("term", "df", "max_tf", "min_length")


@query(ORACLE_SQL["bm25_topk"])
def bm25_stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What bm25_topk gives, from the stored index: no text of a document is read once it is there."""
    return index.search(_stored(spark, sf_dir), _requests(spark, sf_dir), tx.tokens)


@query("""SELECT l_returnflag AS variant, l_linestatus AS theme, CAST(l_linenumber AS INTEGER) AS tier, CAST(GROUPING(l_returnflag, l_linestatus, l_linenumber) AS BIGINT) AS level, count(*) AS n,
  round(avg(CASE WHEN l_discount > 0.05 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS hit, round(avg(CAST(l_partkey % 10 AS DOUBLE)), 6) AS depth FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus, l_linenumber)""")
def metrics_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of two measures by variant, theme and tier in every combination; a line is a run."""
    scores = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("variant"), F.col("l_linestatus").alias("theme"), F.col("l_linenumber").cast("int").alias("tier"), F.when(F.col("l_discount") > 0.05, 1.0).otherwise(0.0).alias("hit"), (F.col("l_partkey") % 10).cast("double").alias("depth"))
    return benchmark.breakdown(scores, ["hit", "depth"])
