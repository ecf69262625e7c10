"""Registered queries over the star-schema and document tables, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions import jsontext, layout, planning
from gristmill.functions import text as tx
from gristmill.functions.session import dealt, fine, shared_folder
from gristmill.operators import chunks, curation, evaluation, evidence, retrieval, tasks
from gristmill.plans import strategies

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SEP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TOK = rf"list_filter(string_split_regex(lower(coalesce(text, '')), '{_SEP}'), lambda w: w <> '')"

_BM25 = f"""
d AS MATERIALIZED (SELECT doc_id AS item, {_TOK} AS t FROM documents),
p AS MATERIALIZED (SELECT item, len(t) AS length, unnest(t) AS term FROM d),
tf AS MATERIALIZED (SELECT item, term, count(*) AS tf, any_value(length) AS length FROM p GROUP BY item, term),
st AS (SELECT count(*) AS items, avg(len(t)) AS mean FROM d),
q AS (SELECT DISTINCT request, unnest(t) AS term FROM (SELECT item_id AS request, {_TOK} AS t FROM benchmark)),
df AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM q) GROUP BY term),
bm AS MATERIALIZED (SELECT request, item, round(sum(ln(1 + (items - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean))), 6) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY request, item)"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("request"), "text")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), "text")


@query(f"WITH {_BM25} SELECT request, item, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, item) AS rank FROM bm) WHERE rank <= 20")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25(_items(spark, sf_dir), _requests(spark, sf_dir), tx.tokens).select("request", "item", "score", "rank")


_KNN = """SELECT q.vec_id AS request, e.vec_id AS item, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 4) AS score, q.label AS ql, e.label AS el
  FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q, embeddings e"""


def _knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    items = rows.select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector"))
    return retrieval.nearest(items, items.where("item % 100 = 0").withColumnRenamed("item", "request"), digits=4)


@query(f"SELECT request, item, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, item) AS rank FROM ({_KNN})) WHERE rank <= 20")
def knn_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir)


_TAGS = """t AS MATERIALIZED (SELECT r.item_id AS request, d.doc_id AS item, (CASE WHEN d.lang = r.lang THEN 1.0 ELSE 0.0 END) + (CASE WHEN d.source = r.source THEN 2.0 ELSE 0.0 END)::DOUBLE AS score
  FROM (SELECT item_id, 'src' || CAST(item_id % 20 AS VARCHAR) AS source, CASE item_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' ELSE 'es' END AS lang FROM benchmark) r, documents d
  WHERE d.lang = r.lang OR d.source = r.source)"""


def _tag_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.array("lang").alias("scene"), F.array("source").alias("hazard"))
    lang = F.element_at(F.array(*[F.lit(x) for x in ("en", "de", "fr", "es")]), (F.col("item_id") % 4 + 1).cast("int"))
    requests = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("request"), F.array(lang).alias("scene"), F.array(F.concat(F.lit("src"), F.col("item_id") % 20)).alias("hazard"))
    return retrieval.tag_route(items, requests, {"scene": 1.0, "hazard": 2.0})


@query(f"WITH {_TAGS} SELECT request, item, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, item) AS rank FROM t) WHERE rank <= 20")
def tag_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tag_route(spark, sf_dir).select("request", "item", F.col("score").cast("double").alias("score"), "rank")


_FUSED = f"""WITH {_BM25}, {_TAGS},
r AS (SELECT request, item, row_number() OVER (PARTITION BY request ORDER BY score DESC, item) AS rank, 0 AS route FROM bm
  UNION ALL SELECT request, item, row_number() OVER (PARTITION BY request ORDER BY score DESC, item), 1 FROM t),
f AS (SELECT request, item, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score, min(rank) AS best_rank, min(route * 1000 + rank) AS seen, count(*) AS n_routes FROM r WHERE rank <= 20 GROUP BY request, item)
SELECT request, item, score, best_rank, n_routes, rank FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, best_rank, seen, item) AS rank FROM f) WHERE rank <= 10"""


@query(_FUSED)
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = retrieval.bm25(_items(spark, sf_dir), _requests(spark, sf_dir), tx.tokens).select("request", "item", "rank", F.lit(0).alias("route"))
    routes = routes.unionByName(_tag_route(spark, sf_dir).select("request", "item", "rank", F.lit(1).alias("route")))
    return retrieval.fuse(routes, 10).select("request", "item", "score", "best_rank", "n_routes", "rank")


@query(f"""WITH {_BM25},
pool AS (SELECT request, item, row_number() OVER (PARTITION BY request ORDER BY score DESC, item) AS prior FROM bm QUALIFY prior <= 20),
s AS (SELECT pool.request, pool.item, prior, CAST(len(list_intersect(d.t, b.t)) AS BIGINT) AS score FROM pool JOIN d USING (item)
  JOIN (SELECT item_id, {_TOK} AS t FROM benchmark) b ON b.item_id = pool.request)
SELECT request, item, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, prior, item) AS rank FROM s) WHERE rank <= 5""")
def rerank_max_over_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = retrieval.bm25(_items(spark, sf_dir), _requests(spark, sf_dir), tx.tokens)
    wide = retrieval.beside(pool, _items(spark, sf_dir)).join(_requests(spark, sf_dir).withColumnRenamed("text", "asked"), "request")
    score = F.size(F.array_intersect(tx.tokens(F.col("text")), tx.tokens(F.col("asked")))).cast("long")
    return retrieval.rerank(wide, score, 5).select("request", "item", "score", "rank")


_QUERIES = f"""wq AS MATERIALIZED (SELECT item_id AS request, unnest([0, 1, 2]) AS n, unnest([t, t[1:(len(t) + 1) // 2], t[(len(t) + 1) // 2 + 1:]]) AS t FROM (SELECT item_id, {_TOK} AS t FROM benchmark)),
qn AS (SELECT DISTINCT request, n, unnest(t) AS term FROM wq),
dn AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM qn) GROUP BY term),
bn AS MATERIALIZED (SELECT request, n, item, round(sum(ln(1 + (items - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean))), 6) AS score
  FROM qn JOIN tf USING (term) JOIN dn USING (term), st GROUP BY request, n, item)"""


@query(f"""WITH {_BM25}, {_TAGS}, {_QUERIES},
r AS (SELECT request, item, row_number() OVER (PARTITION BY request, n ORDER BY score DESC, item) AS rank, n AS route FROM bn
  UNION ALL SELECT request, item, row_number() OVER (PARTITION BY request ORDER BY score DESC, item), 3 FROM t),
f AS (SELECT request, item, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score, min(rank) AS best_rank, min(route * 1000 + rank) AS seen FROM r WHERE rank <= 20 GROUP BY request, item),
pool AS (SELECT request, item, row_number() OVER (PARTITION BY request ORDER BY score DESC, best_rank, seen, item) AS prior FROM f QUALIFY prior <= 30),
s AS (SELECT pool.request, pool.item, prior, max(round(len(list_intersect(d.t, wq.t)) / len(list_distinct(wq.t)), 6)) AS score FROM pool JOIN d USING (item) JOIN wq USING (request) WHERE len(wq.t) > 0 GROUP BY ALL)
SELECT request, item, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, prior, item) AS rank FROM s) WHERE rank <= 5""")
def rerank_fused_over_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request asks by its text and by each half of it; word lists of all three and tags are fused, the best 30 are reranked by the share of a query's words."""
    words = tx.tokens(F.col("text"))
    half = F.ceil(F.size(words) / 2).cast("int")
    parts = F.array(words, F.slice(words, F.lit(1), half), F.slice(words, half + 1, F.size(words)))
    queries = _requests(spark, sf_dir).select("request", F.posexplode(parts).alias("n", "asked")).where(F.size("asked") > 0)
    by_query = retrieval.bm25(_items(spark, sf_dir), queries.select(F.struct("request", "n").alias("request"), F.array_join("asked", " ").alias("text")), tx.tokens)
    routes = by_query.select("request.request", F.col("request.n").alias("route"), "rank", "item").unionByName(_tag_route(spark, sf_dir).select("request", F.lit(3).alias("route"), "rank", "item"))
    score = F.round(F.size(F.array_intersect("terms", "asked")) / F.size(F.array_distinct("asked")), 6)
    texts = _items(spark, sf_dir).select("item", words.alias("terms"))
    return retrieval.rerank_fused(routes, texts, queries.select("request", "asked"), score, 5).select("request", "item", "score", "rank")


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
  '<script.*?>.*?</script>', ' ', 'gsi'), '<style.*?>.*?</style>', ' ', 'gsi'), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&quot;', '"'), '&apos;', ''''),
  '[ \t\n\r]+', ' ', 'g')) AS body FROM pages""")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.html_text(F.col("html")).alias("body"))


@query("""SELECT o_orderkey AS request, l_partkey AS chunk_id, string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) AS linked_from FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  JOIN part ON p_partkey = l_partkey WHERE p_size > 25 GROUP BY ALL""")
def case_norm_link_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request"), F.col("l_linenumber").alias("case_id"), F.col("l_partkey").alias("ref"))
    fine(spark, refs.count())
    parts = table(spark, sf_dir, "part")
    chunks = parts.where("p_size > 25").select(F.col("p_partkey").alias("chunk_id"), F.col("p_partkey").alias("ref"))
    retrieved = refs.join(parts.where("p_size <= 25").select(F.col("p_partkey").alias("ref")), "ref").select("request", F.col("ref").alias("chunk_id")).distinct()
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request"))
    return evidence.link_merge(refs.join(orders, "request", "left_semi"), chunks, retrieved).where("linked_from is not null").withColumn("linked_from", F.array_join("linked_from", ","))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)")
def grounding_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return evidence.ungrounded(cited, table(spark, sf_dir, "part").where("p_size <= 40").select(F.col("p_partkey").alias("l_partkey")), ["l_partkey"])


@query("""WITH e AS (SELECT l_orderkey AS request, l_partkey AS chunk_id, min(l_linenumber) AS pos FROM lineitem GROUP BY ALL),
s AS (SELECT l_orderkey AS request, l_partkey AS chunk_id, min(l_linenumber) AS pos FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT request, chunk_id FROM s UNION ALL SELECT request, chunk_id FROM e WHERE request NOT IN (SELECT request FROM s)""")
def citation_hydrate_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request"), F.col("l_partkey").alias("chunk_id"), F.col("l_linenumber").alias("pos"), "l_returnflag")
    lines = dealt(lines, "request")
    shown = lines.groupBy("request", "chunk_id").agg(F.min("pos").alias("pos"))
    chosen = F.sort_array(F.collect_list(F.when(F.col("l_returnflag") == "R", F.struct("pos", "chunk_id"))))
    return evidence.hydrate(lines.groupBy("request").agg(F.transform(chosen, lambda x: x["chunk_id"]).alias("ids")), shown).select("request", "chunk_id")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' OR o_custkey % 5 > 2 OR reason = 'norm_case_conflict' THEN 'training_agent'
  WHEN reason = 'evidence_insufficient' THEN CASE WHEN o_custkey % 2 > 0 AND o_totalprice > 100000 THEN 'evidence_subgraph' ELSE 'training_agent' END
  WHEN reason = 'hallucination' THEN 'authoring_subgraph' ELSE 'training_agent' END AS arbitration_route
FROM (SELECT *, CASE left(o_orderpriority, 1) WHEN '1' THEN 'norm_case_conflict' WHEN '2' THEN 'evidence_insufficient' WHEN '3' THEN 'hallucination' ELSE 'other' END AS reason FROM orders)""")
def arbitration_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, kind = table(spark, sf_dir, "orders"), F.substring("o_orderpriority", 1, 1)
    reason = F.when(kind == "1", "norm_case_conflict").when(kind == "2", "evidence_insufficient").when(kind == "3", "hallucination").otherwise("other")
    out = evidence.route(F.col("o_orderstatus") == "F", reason, F.col("o_custkey") % 5, F.col("o_custkey") % 2, F.col("o_totalprice") > 100000)
    return orders.select("o_orderkey", out.alias("arbitration_route"))


_LINES = "ln AS MATERIALIZED (SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))"


@query(rf"""WITH {_LINES}, n AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^[A-Z][a-z]+ ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM ln)
SELECT doc_id, CAST(block AS BIGINT) AS block, md5(trim(string_agg(line, chr(10) ORDER BY pos), ' ')) AS body FROM n WHERE block > 0 GROUP BY doc_id, block""")
def article_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = curation.split_articles(table(spark, sf_dir, "documents"), F.col("line").rlike("^[A-Z][a-z]+ "))
    return parts.withColumn("body", F.md5("body"))


@query(r"""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS w FROM documents),
p AS (SELECT doc_id, w, list_filter(list_transform(string_split_regex(w, '\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ps FROM d),
f AS (SELECT doc_id, w, CASE WHEN length(w) > 1200 THEN list_reduce(list_transform(ps, lambda x: {'done': []::VARCHAR[], 'now': x}), lambda s, x: CASE WHEN length(s.now) + 1 + length(x.now) <= 1200
  THEN {'done': s.done, 'now': s.now || chr(10) || x.now} ELSE {'done': list_append(s.done, s.now), 'now': x.now} END) END AS r FROM p),
b AS (SELECT doc_id, CASE WHEN r IS NULL THEN [w] ELSE list_append(r.done, r.now) END AS parts FROM f)
SELECT doc_id, CAST(part - 1 AS INTEGER) AS part, length(parts[part]) AS size, md5(parts[part]) AS digest FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS part FROM b)""")
def paragraph_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.packed_paragraphs(F.col("text"))).alias("part", "body"))
    return packed.select("doc_id", "part", F.length("body").alias("size"), F.md5("body").alias("digest"))


_NORM = r"regexp_replace(regexp_replace(regexp_replace(replace(text, '　', ' '), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query(f"SELECT doc_id, sha256({_NORM}) AS content_hash FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.normalize(F.col("text")), 256).alias("content_hash"))


@query(f"SELECT min(doc_id) AS doc_id, sha256({_NORM}) AS content_hash FROM documents GROUP BY 2")
def dedupe_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.first_of_each(normalize_text(spark, sf_dir), "content_hash", "doc_id").select("doc_id", "content_hash")


@query("""SELECT p_partkey, CASE WHEN nth = 1 THEN p_brand ELSE p_brand || '-dup-' || CAST(nth AS VARCHAR) END AS p_brand
  FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS nth FROM part) WHERE nth = 1 OR p_size <= 25""")
def dedupe_rename_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.rename_collisions(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), "p_brand", "p_partkey", F.col("p_size") <= 25).drop("p_size")


@query("""SELECT doc_id FROM (SELECT doc_id, n_chars, max(CASE WHEN n_chars >= 400 THEN 1 ELSE 0 END) OVER (PARTITION BY lang, source) AS f FROM documents) WHERE f = 0 OR n_chars >= 400""")
def heading_stub_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.resolve_stubs(table(spark, sf_dir, "documents"), ["lang", "source"], F.col("n_chars") < 400).select("doc_id")


@query(rf"""WITH {_LINES}, b AS (SELECT *, regexp_replace(line, '[ \t\r]+', '', 'g') AS bare FROM ln),
k AS (SELECT *, lag(bare) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM b)
SELECT doc_id, count(*) AS n_lines FROM k WHERE before IS NULL OR bare <> before OR bare = '' GROUP BY doc_id""")
def adjacent_line_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.drop_repeated_lines(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count("*").alias("n_lines"))


_REASON = r"""CASE WHEN lang = 'en' AND source = 'src1' THEN NULL WHEN text IS NULL OR text = '' THEN 'empty' WHEN n_chars < 200 THEN 'short' WHEN regexp_matches(text, '[#*%&$]{3}') THEN 'symbols'
  WHEN regexp_matches(text, '!!') THEN 'shouting' WHEN contains(text, ' | ') THEN 'navigation' WHEN contains(text, 'Licensed') THEN 'license' END"""


def _reason():
    t = F.col("text")
    checks = [("empty", t.isNull() | (t == "")), ("short", F.col("n_chars") < 200), ("symbols", t.rlike(r"[#*%&$]{3}")), ("shouting", t.rlike("!!")), ("navigation", F.contains(t, F.lit(" | "))), ("license", F.contains(t, F.lit("Licensed")))]
    return curation.reasons(checks, rescued=(F.col("lang") == "en") & (F.col("source") == "src1"))


@query(f"SELECT reason, count(*) AS n, array_to_string(list_sort(list(doc_id))[1:30], ',') AS samples FROM (SELECT doc_id, {_REASON} AS reason FROM documents) WHERE reason IS NOT NULL GROUP BY reason")
def quality_reason_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.reason_report(table(spark, sf_dir, "documents"), _reason(), "doc_id").withColumn("samples", F.array_join("samples", ","))


@query(f"""SELECT 'raw' AS stage, count(*) AS n FROM documents UNION ALL SELECT 'filtered', count(*) FROM documents WHERE ({_REASON}) IS NULL
  UNION ALL SELECT 'deduplicated', count(DISTINCT text) FROM documents WHERE ({_REASON}) IS NULL""")
def stage_cardinalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("text", _reason().alias("reason"))
    counts = docs.agg(F.count("*").alias("raw"), F.count_if(F.col("reason").isNull()).alias("filtered"))
    kept = docs.where("reason is null").select(F.sha2("text", 256).alias("h")).distinct().agg(F.count("*").alias("deduplicated"))
    return counts.crossJoin(kept).select(F.expr("stack(3, 'raw', raw, 'filtered', filtered, 'deduplicated', deduplicated) AS (stage, n)"))  # one row each


@query("""SELECT doc_id, 'missing label' AS issue FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
  UNION ALL SELECT doc_id, 'empty tags' FROM documents WHERE NOT (contains(text, 'http') OR contains(text, '@') OR contains(text, 'License'))""")
def validation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("http", "link"), ("@", "mail"), ("License", "license")]
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", F.lit("yes").alias("label")).distinct(), "doc_id", "left")
    return curation.issues(docs.select("doc_id", "label", tx.ordered_tags(F.col("text"), rules).alias("tags")), "doc_id", ["label"], "tags")


@query("""SELECT lang, source, count(*) AS n, CAST(sum(CASE WHEN n_chars > 1800 THEN 1 ELSE 0 END) AS BIGINT) AS oversized, count(*) - count(DISTINCT sha256(text)) AS duplicates FROM documents GROUP BY ALL""")
def import_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("h", F.sha2("text", 256))
    return docs.groupBy("lang", "source").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 1800).alias("oversized"), (F.count("*") - F.count_distinct("h")).alias("duplicates"))


@query("""SELECT tag, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN contains(text, 'http') THEN 'link' END, CASE WHEN contains(text, '@') THEN 'mail' END, CASE WHEN contains(text, 'License') THEN 'license' END,
  CASE WHEN contains(text, 'password') THEN 'secret' END], lambda x: x IS NOT NULL)) AS tag FROM documents) GROUP BY tag""")
def tag_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("http", "link"), ("@", "mail"), ("License", "license"), ("password", "secret")]
    return curation.tag_histogram(table(spark, sf_dir, "documents"), tx.ordered_tags(F.col("text"), rules))


@query("""SELECT p_partkey, CASE WHEN contains(p_type, 'STEEL') THEN 'metal' WHEN contains(p_type, 'BRUSHED') THEN 'finish' WHEN contains(p_type, 'SMALL') THEN 'size' ELSE 'other' END AS theme FROM part""")
def theme_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("STEEL", "metal"), ("BRUSHED", "finish"), ("SMALL", "size")]
    return table(spark, sf_dir, "part").select("p_partkey", tx.first_match(F.col("p_type"), rules, "other").alias("theme"))


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(coalesce(text, ''), '培训|交底|班前|安全教育') THEN 'training' WHEN regexp_matches(coalesce(text, ''), '[?？]|为什么|为何|如何|怎么|怎样|是什么|能不能|可不可以|要不要|是否|多少|哪些|哪个|什么时候|有没有|该不该') THEN 'qa' ELSE 'training' END AS mode
FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN text || '如何' ELSE '班前' || text END AS text FROM conversations)""")
def intent_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third turn asks, every third names training."""
    text = F.when(F.col("turn") % 3 == 0, F.col("text")).when(F.col("turn") % 3 == 1, F.concat("text", F.lit("如何"))).otherwise(F.concat(F.lit("班前"), "text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", planning.intent(text).alias("mode"))


@query("""SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY k) - 1 AS route, md5(base || suffix) AS q FROM (SELECT conv_id, turn, regexp_replace(trim(coalesce(text, '')), '[？?]+$', '') AS base,
  unnest([0, 1, 2]) AS k, unnest(['', ' 规范 要求 安全 防护', ' 施工 安全 措施']) AS suffix FROM conversations)""")
def query_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = planning.qa_queries(F.col("text"))["norm_queries"]
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(asked).alias("route", "q")).select("conv_id", "turn", F.col("route").cast("long").alias("route"), F.md5("q").alias("q"))


@query("""WITH t AS (SELECT o_orderkey, o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS k FROM orders)
SELECT o_orderkey, 'task-' || left(o_orderpriority, 1) || '-' || printf('%03d', k) AS task_id FROM t""")
def gold_task_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tasks.running_ids(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey")
    return rows.select("o_orderkey", F.format_string("task-%s-%03d", F.substring("o_orderpriority", 1, 1), "nth").alias("task_id"))


@query("""SELECT a.c_custkey AS case_id, array_to_string(list_sort(list(b.c_custkey))[1:3], ',') AS similar FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS k FROM customer) b
  JOIN customer a ON a.c_mktsegment = b.c_mktsegment AND a.c_nationkey = b.c_nationkey AND a.c_custkey <> b.c_custkey
  WHERE b.k <= 3 OR (b.k = 4 AND a.c_custkey IN (SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS k FROM customer) WHERE k <= 3)) GROUP BY a.c_custkey""")
def similar_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three others of the same kind: only the first four of each kind take part in the join."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    kind = ["c_mktsegment", "c_nationkey"]
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy(*kind).orderBy("c_custkey"))).where("k <= 4").withColumnRenamed("c_custkey", "other").drop("k")
    return rows.join(first, kind).where("c_custkey <> other").groupBy(F.col("c_custkey").alias("case_id")).agg(F.array_join(F.slice(F.array_sort(F.collect_list("other")), 1, 3), ",").alias("similar"))


@query("""SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2 AND n_nationkey % 2 = 0""")
def frozen_carryover(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    previous, current = (nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), "n_regionkey") for _ in (0, 1))
    return curation.carry_over(previous, current.where("n_regionkey <> 2"), "k", (F.col("n_regionkey") == 2) & (F.col("k") % 2 == 0)).select("k", "name")


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, item) AS rank FROM ({_KNN}) QUALIFY rank <= 20),
n AS (SELECT q.vec_id AS request, count(*) AS size FROM embeddings q JOIN embeddings e ON q.label = e.label WHERE q.vec_id % 100 = 0 GROUP BY 1),
h AS (SELECT request, sum(CASE WHEN ql = el AND rank <= 10 THEN 1 ELSE 0 END) AS found, min(CASE WHEN ql = el THEN rank END) AS first,
  sum(CASE WHEN ql = el AND rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM r GROUP BY request)
SELECT request, round(found / size, 6) AS recall, CASE WHEN found > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit, round(coalesce(1 / first, 0), 6) AS mrr,
  round(dcg / list_sum(list_transform(range(1, least(size, 10) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM h JOIN n USING (request)""")
def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), F.col("label").alias("class"))
    requests = items.where("item % 100 = 0").withColumnRenamed("item", "request")
    return evaluation.ir_metrics_by_class(_knn(spark, sf_dir), requests, items, 10)


@query("""WITH c AS (SELECT l_orderkey AS run, list(DISTINCT l_partkey) AS cited, list(DISTINCT CASE WHEN l_returnflag <> 'R' THEN l_partkey END) AS gold, count(*) AS n, sum(CASE WHEN l_quantity > 10 THEN 1 ELSE 0 END) AS ok FROM lineitem GROUP BY 1)
SELECT run, round(ok / n, 6) AS grounding_rate, round(1 - ok / n, 6) AS hallucination_rate, round(CASE WHEN len(list_filter(gold, lambda x: x IS NOT NULL)) > 0 THEN 1.0 ELSE 0.0 END, 6)::DOUBLE AS recall FROM c""")
def generation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(
        F.count("*").alias("n"), F.count_if(F.col("l_quantity") > 10).alias("ok"), F.collect_set("l_partkey").alias("cited"), F.collect_set(F.when(F.col("l_returnflag") != "R", F.col("l_partkey"))).alias("gold")
    )
    rate = evaluation.share(F.col("ok"), F.col("n"))
    recall = evaluation.share(F.size(F.array_intersect("cited", "gold")), F.size("gold"))
    return runs.select("run", F.round(rate, 6).alias("grounding_rate"), F.round(F.when(F.col("n") > 0, 1 - rate).otherwise(0.0), 6).alias("hallucination_rate"), F.round(recall, 6).alias("recall"))


@query("""WITH l AS (SELECT o_orderkey AS run, o_orderstatus, lineitem.*, p_type, p_size FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey),
s AS (SELECT run, any_value(o_orderstatus) AS status, coalesce(list(l_partkey) FILTER (l_returnflag <> 'R'), []) AS cn, coalesce(list(l_suppkey) FILTER (l_tax > 0.03), []) AS cc,
  coalesce(list(DISTINCT l_partkey) FILTER (l_quantity > 10), []) AS rn, coalesce(list(DISTINCT l_suppkey) FILTER (l_quantity < 40), []) AS rc, coalesce(list(DISTINCT l_partkey) FILTER (l_discount > 0.04), []) AS gn,
  coalesce(list(DISTINCT l_suppkey) FILTER (p_size > 25), []) AS gc, coalesce(list(DISTINCT p_type) FILTER (l_linestatus = 'F'), []) AS h, coalesce(list(DISTINCT p_type) FILTER (l_discount <= 0.05), []) AS gh,
  count(*) FILTER (l_returnflag <> 'R' AND l_linenumber % 2 = 0) AS linked FROM l GROUP BY run),
n AS (SELECT *, len(list_filter(cn, lambda x: list_contains(rn, x))) + len(list_filter(cc, lambda x: list_contains(rc, x))) AS ok, len(cn) + len(cc) AS cited FROM s)
SELECT run, round(CASE WHEN len(cn) > 0 THEN len(list_filter(cn, lambda x: list_contains(gn, x))) / len(cn) ELSE 0.0 END, 6)::DOUBLE AS norm_citation_validity,
  round(CASE WHEN cited > 0 THEN ok / cited ELSE 0.0 END, 6)::DOUBLE AS grounding_rate, round(CASE WHEN cited > 0 THEN 1 - ok / cited ELSE 0.0 END, 6)::DOUBLE AS hallucination_rate,
  round(CASE WHEN len(gh) > 0 THEN len(list_intersect(gh, h)) / len(gh) ELSE 0.0 END, 6)::DOUBLE AS hazard_coverage, round(CASE WHEN len(gc) > 0 THEN len(list_intersect(gc, cc)) / len(gc) ELSE 0.0 END, 6)::DOUBLE AS case_relevance,
  round(CASE WHEN len(gn) > 0 THEN len(list_intersect(gn, rn)) / len(gn) ELSE 0.0 END, 6)::DOUBLE AS norm_recall, round(CASE WHEN len(gc) > 0 THEN len(list_intersect(gc, rc)) / len(gc) ELSE 0.0 END, 6)::DOUBLE AS case_recall,
  round(CASE WHEN status = 'F' AND len(cn) > 0 THEN linked / len(cn) ELSE 0.0 END, 6)::DOUBLE AS link_resolution_rate FROM n""")
def generation_metrics_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eight metrics of runs (orders), whose lines cite, retrieve and are gold by columns that don't depend on each other."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_size")
    lines = table(spark, sf_dir, "lineitem").join(parts, "l_partkey", "left").withColumnRenamed("l_orderkey", "run")
    ref, norm, case = F.concat(F.lit("P:"), "l_partkey"), F.concat(F.lit("norm::P::article::"), "l_partkey"), F.concat(F.lit("case::"), "l_suppkey", F.lit("::summary"))
    some = lambda where, value: F.collect_list(F.when(F.expr(where), value))
    link = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_suppkey").cast("string")).otherwise("")
    sets = lines.groupBy("run").agg(
        some("l_returnflag <> 'R'", ref).alias("cited_refs"), some("l_returnflag <> 'R'", norm).alias("cited_norms"), some("l_returnflag <> 'R'", link).alias("links"), some("l_tax > 0.03D", case).alias("cited_cases"),
        some("l_quantity > 10", norm).alias("norms"), some("l_quantity < 40", case).alias("cases"), some("l_linestatus = 'F'", F.col("p_type")).alias("hazards"),
        some("l_discount > 0.04D", ref).alias("gold_refs"), some("p_size > 25", F.col("l_suppkey").cast("string")).alias("gold_cases"), some("l_discount <= 0.05D", F.col("p_type")).alias("gold_hazards"),
    )
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.when(F.col("o_orderstatus") == "F", "proposed").otherwise("optimized").alias("variant"))
    return evaluation.generation(runs.join(sets, "run", "left"))


@query("""SELECT count(DISTINCT l_orderkey) AS cases, count(DISTINCT CASE WHEN p_partkey IS NOT NULL THEN l_orderkey END) AS cases_with_resolved_refs, count(*) AS total_refs, count(p_partkey) AS resolved_refs,
  round(count(p_partkey) / count(*), 4) AS resolution_rate FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 25) ON p_partkey = l_partkey""")
def link_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("ref"))
    return evaluation.link_resolution(refs, table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("ref")))


_STATS = "count(value) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sd, round(median(value), 6) AS median, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3"


@query(f"SELECT event_type, {_STATS} FROM events GROUP BY event_type")
def group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.summary(table(spark, sf_dir, "events"), "event_type", "value")


@query("""WITH v AS (SELECT event_type, round(value) AS value, count(*) AS c FROM events GROUP BY ALL)
SELECT a.event_type AS x, b.event_type AS y, round(sum(a.c * b.c * sign(a.value - b.value)) / sum(a.c * b.c), 6) AS delta FROM v a JOIN v b ON a.event_type < b.event_type GROUP BY ALL""")
def cliffs_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.cliffs_delta(table(spark, sf_dir, "events").select("event_type", F.round("value").alias("value")), "event_type", "value")


_PAIRED = """p AS (SELECT user_id, event_type, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS m FROM events GROUP BY ALL),
d AS (SELECT a.event_type AS x, b.event_type AS y, a.m - b.m AS d FROM p a JOIN p b ON a.user_id = b.user_id AND a.event_type < b.event_type)"""


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("m"))
    a, b = p.withColumnsRenamed({"event_type": "x", "m": "mx"}), p.withColumnsRenamed({"event_type": "y", "m": "my"})
    return a.join(b, "user_id").where("x < y").select("x", "y", (F.col("mx") - F.col("my")).alias("d"))


@query(f"WITH {_PAIRED} SELECT x, y, count(*) AS n, CAST(sum(d) AS BIGINT) AS cents FROM d GROUP BY x, y")
def paired_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paired(spark, sf_dir).groupBy("x", "y").agg(F.count("*").alias("n"), F.sum("d").alias("cents"))


@query(f"""WITH {_PAIRED}, r AS (SELECT x, y, d, rank() OVER w + (count(*) OVER (PARTITION BY x, y, abs(d)) - 1) / 2 AS rk FROM d WHERE d <> 0 WINDOW w AS (PARTITION BY x, y ORDER BY abs(d)))
SELECT x, y, count(*) AS n, round(least(sum(CASE WHEN d > 0 THEN rk ELSE 0 END), sum(CASE WHEN d < 0 THEN rk ELSE 0 END)), 6) AS w FROM r GROUP BY x, y""")
def wilcoxon_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.signed_rank(_paired(spark, sf_dir), ["x", "y"], F.col("d"))


@query()
def wilcoxon_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistic, p and Holm's p over all pairs of event types; SQL has no normal distribution."""
    rows = evaluation.wilcoxon(_paired(spark, sf_dir), ["x", "y"], F.col("d")).withColumns({"family": F.lit("all"), "pair": F.concat_ws(" ", "x", "y")})
    return evaluation.holm(rows, ["family"], "p", "pair").select("x", "y", "n", "w", "p", "p_holm")


@query("""WITH t AS (SELECT n_nationkey, n_regionkey, CASE WHEN n_nationkey % 7 = 0 THEN NULL ELSE (n_nationkey + 1) / 300.0::DOUBLE END AS p FROM nation),
s AS (SELECT *, least(1.0, (count(p) OVER (PARTITION BY n_regionkey) - row_number() OVER (PARTITION BY n_regionkey ORDER BY p NULLS LAST, n_nationkey) + 1) * p) AS step FROM t)
SELECT n_nationkey, round(CASE WHEN p IS NOT NULL THEN max(step) OVER (PARTITION BY n_regionkey ORDER BY p NULLS LAST, n_nationkey ROWS UNBOUNDED PRECEDING) END, 9) AS p_holm FROM s""")
def holm_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", F.when(F.col("n_nationkey") % 7 != 0, (F.col("n_nationkey") + 1) / 300.0).alias("p"))
    return evaluation.holm(rows, ["n_regionkey"], "p", "n_nationkey").select("n_nationkey", F.round("p_holm", 9).alias("p_holm"))


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.bootstrap(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), "event_type", "value")


@query("SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k_sum, count(*) AS n FROM events GROUP BY event_type")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("k_sum"), F.count("*").alias("n"))


@query("""WITH m AS (SELECT l_returnflag AS variant, l_linestatus AS metric, avg(l_quantity) AS v FROM lineitem GROUP BY ALL)
SELECT a.variant, a.metric, round(a.v, 6) AS mean, round(a.v - b.v, 6) AS delta FROM m a LEFT JOIN m b ON b.variant = 'N' AND b.metric = a.metric""")
def pivot_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("variant"), F.col("l_linestatus").alias("metric")).agg(F.avg("l_quantity").alias("v"))
    control = means.where("variant = 'N'").select("metric", F.col("v").alias("c"))
    return means.join(control, "metric", "left").select("variant", "metric", F.round("v", 6).alias("mean"), F.round(F.col("v") - F.col("c"), 6).alias("delta"))


@query("SELECT o_orderkey, unnest(['llm_only', 'norm_only', 'naive_dual', 'optimized', 'proposed']) AS variant FROM orders")
def variants_of_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    variants = F.array(*[F.lit(v) for v in ("llm_only", "norm_only", "naive_dual", "optimized", "proposed")])
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(variants).alias("variant"))


@query(r"""SELECT page_id, coalesce(nullif(regexp_extract(html, 'https?://[^\s\])）"<]+'), ''), trim(url)) AS first_link, left(sha256(url), 16) AS cache_key FROM pages""")
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = F.coalesce(F.nullif(F.regexp_extract("html", r'https?://[^\s\])）"<]+', 0), F.lit("")), F.trim("url"))
    return table(spark, sf_dir, "pages").select("page_id", link.alias("first_link"), F.substring(F.sha2("url", 256), 1, 16).alias("cache_key"))


@query(f"""SELECT term, count(*) AS n FROM (SELECT unnest(flatten(list_transform({_TOK}, lambda w: CASE WHEN length(w) >= 2 THEN list_transform(range(1, length(w)), lambda i: w[i:i + 1]) ELSE [w] END))) AS term FROM documents) GROUP BY term""")
def bigram_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(tx.letter_bigrams(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query(f"""WITH {_BM25}, k AS (SELECT r.item_id AS request, d.doc_id AS item, 3.0 AS score FROM benchmark r JOIN documents d ON d.source = 'src' || CAST(r.item_id % 20 AS VARCHAR)),
b AS (SELECT request, item, score * 4.0 AS score FROM bm QUALIFY row_number() OVER (PARTITION BY request ORDER BY score DESC, item) <= 20 UNION ALL SELECT * FROM k),
m AS (SELECT request, item, max(score) AS score FROM b GROUP BY ALL)
SELECT request, item, CAST(round(score, 6) AS DOUBLE) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, item) AS rank FROM m) WHERE rank <= 20""")
def bm25_multifield_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = retrieval.bm25(_items(spark, sf_dir), _requests(spark, sf_dir), tx.tokens)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("request"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("source"))
    keyword = asked.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), "source"), "source").select("request", "item", F.lit(1.0).alias("score"))
    return retrieval.best_fields([(text, 4.0), (keyword, 3.0)]).select("request", "item", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, item) AS rank FROM ({_KNN}) QUALIFY rank <= 20)
SELECT request, item, CAST(CASE WHEN ql = el THEN 1 ELSE 0 END AS INTEGER) AS overlap, place FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY CASE WHEN ql = el THEN 1 ELSE 0 END DESC, rank) AS place FROM r) WHERE place <= 10""")
def legacy_overlap_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), "label")
    near = _knn(spark, sf_dir).join(label, "item").join(label.withColumnsRenamed({"item": "request", "label": "asked"}), "request")
    near = near.withColumn("overlap", (F.col("label") == F.col("asked")).cast("int"))
    place = F.row_number().over(Window.partitionBy("request").orderBy(F.desc("overlap"), "rank"))
    return near.withColumn("place", place).where("place <= 10").select("request", "item", "overlap", "place")


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[0-9]+\.[0-9]+')) AS BIGINT) AS n_refs FROM documents")
def refs_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = F.regexp_extract_all("text", F.lit(r"[0-9]+\.[0-9]+"), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(refs).cast("long").alias("n_refs"))


@query(r"""WITH s AS (SELECT doc_id, list_transform(string_split_regex(regexp_replace(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), '^\d+(\.\d+)+\s*', ''), '[.;]+'),
  lambda x: regexp_replace(regexp_replace(regexp_replace(x, '[”“’‘*]', '', 'g'), '\s+', '', 'g'), '^[,，、]+', '')) AS c FROM documents),
d AS (SELECT doc_id, c, list_filter(c, lambda x: length(x) >= 8 AND regexp_matches(x, 'must|shall|the')) AS f FROM s)
SELECT doc_id, md5(coalesce(array_to_string(CASE WHEN len(f) > 0 THEN f[1:2] ELSE list_filter(c, lambda x: length(x) >= 12)[1:1] END, '|'), '')) AS clauses FROM d""")
def mandatory_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of English texts: other words and ends than the defaults."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(tasks.demands(F.col("text"), words="must|shall|the", ends="[.;]+"), "|")).alias("clauses"))


@query("""SELECT conv_id, CAST(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) AS BIGINT) AS demoted, count(*) AS n FROM conversations GROUP BY conv_id""")
def demote_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.struct("role", "turn").withField("supplementary", F.col("role") == "assistant")
    return table(spark, sf_dir, "conversations").select("conv_id", marked.alias("m")).groupBy("conv_id").agg(F.count_if("m.supplementary").alias("demoted"), F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(floor(length(text) / 1.6) AS INTEGER)) END AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


_BAD = r"text IS NULL OR text = '' OR regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x{80}-\x{9F}]') OR len(regexp_extract_all(text, '[\p{L}\p{N}]')) < 0.35 * length(text)"
_FRONT = r"NOT regexp_matches(coalesce(text, ''), '\S') OR len(regexp_extract_all(text, '[oe.·…]{4,}')) >= 3 OR len(regexp_extract_all(text, '[A-Za-z]')) > len(regexp_extract_all(text, '[一-鿿]'))"


@query(f"SELECT doc_id, {_BAD} AS garbled, {_FRONT} AS front_matter FROM documents")
def garbled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", chunks.is_garbled(t).alias("garbled"), chunks.is_front_matter(t).alias("front_matter"))


_CHUNKS = """SELECT p_partkey, 'C-' || CAST(p_partkey AS VARCHAR) AS chunk_id, CASE p_partkey % 4 WHEN 0 THEN 'JGJ-196-2010' WHEN 1 THEN 'JGJ-33-2012' ELSE 'GB-1-2000' END AS code,
  CAST(p_size AS VARCHAR) || '.' || CAST(p_partkey % 150 AS VARCHAR) AS article, CASE WHEN p_partkey % 7 = 0 THEN '04' ELSE '09' END AS chapter_no, p_name AS title, '正文：' || p_type AS text FROM part"""


@query(f"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN code = 'JGJ-196-2010' THEN 'standard_not_in_scope' WHEN p_partkey % 150 > 99 THEN 'pseudo_article_number'
  WHEN code = 'JGJ-33-2012' AND replace(p_type, ' ', '') = article || replace(title, ' ', '') THEN 'jgj33_section_title'
  WHEN code = 'JGJ-33-2012' AND chapter_no <> '04' AND NOT regexp_matches(article, '^8\\.[45]\\.') THEN 'jgj33_not_whitelisted' WHEN regexp_matches(article, '^0\\.|^[1-9]\\.0$') THEN 'malformed_article_id'
  WHEN length(replace(p_type, ' ', '')) <= 16 THEN 'section_title_stub' END AS reason FROM (SELECT c.*, p_type FROM ({_CHUNKS}) c JOIN part USING (p_partkey))) WHERE reason IS NOT NULL GROUP BY reason""")
def chunk_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    code = F.when(key % 4 == 0, "JGJ-196-2010").when(key % 4 == 1, "JGJ-33-2012").otherwise("GB-1-2000")
    rows = table(spark, sf_dir, "part").select(
        F.concat(F.lit("C-"), key).alias("chunk_id"), code.alias("standard_code"), F.lit("article").alias("chunk_kind"), F.concat_ws(".", size, (key % 150).cast("string")).alias("article_id"),
        F.when(key % 7 == 0, "04").otherwise("09").alias("chapter_no"), F.col("p_name").alias("title"), F.concat(F.lit("正文："), "p_type").alias("text"), *[F.lit("").alias(c) for c in ("chapter", "source_path", "asset_path", "related_article_id")]
    )
    return chunks.report(rows).select("reason", "n")


_SECTIONS = "SELECT n_nationkey AS section, n_nationkey * 3 AS first, n_nationkey * 3 + 4 AS last FROM nation"


@query(f"""SELECT l_orderkey AS doc, section, md5(string_agg(l_shipmode, chr(10) ORDER BY l_linenumber, l_shipmode)) AS digest FROM (SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus AS l_shipmode FROM lineitem)
  JOIN ({_SECTIONS}) ON l_linenumber BETWEEN first AND last GROUP BY ALL""")
def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"), F.concat("l_returnflag", "l_linestatus").alias("text"))
    spans = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("section"), (F.col("n_nationkey") * 3).alias("first"), (F.col("n_nationkey") * 3 + 4).alias("last"))
    return layout.page_sections(pages, spans).select("doc", "section", F.md5("text").alias("digest"))


@query("""SELECT p_partkey, CASE WHEN starts_with(p_type, 'STANDARD') THEN 'a,b' WHEN starts_with(p_type, 'S') THEN 'c' ELSE '' END AS hint FROM part""")
def standard_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(layout.by_prefix(F.col("p_type"), {"STANDARD": ["a", "b"], "S": ["c"]}), ",").alias("hint"))


@query("""SELECT p_partkey, CASE WHEN contains(p_type, 'STEEL') THEN '禁止行为' ELSE '一般要求' END AS kind FROM part""")
def requirement_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.contains("p_type", F.lit("STEEL")), F.lit("不得使用，应检查")).otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", chunks.requirement_type(F.lit("article"), F.lit(None).cast("string"), text).alias("kind"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def reply_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.concat(F.lit("<think>{no}</think> Here: "), "props", F.lit(" - that is all {"))
    return table(spark, sf_dir, "events").select("event_id", F.from_json(jsontext.json_of(reply), "k long")["k"].alias("k"))


@query()
def ocr_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are orders, words their lines."""
    word = F.struct((F.col("l_partkey") % 500).cast("int").alias("x"), (F.col("l_suppkey") % 40).cast("int").alias("y"), F.lit(12).alias("h"), F.col("l_linenumber").cast("string").alias("text"))
    pages = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(word)).alias("words"))
    return pages.select("l_orderkey", layout.page_lines(F.col("words")).alias("body"))


def _libraries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests from benchmark, norms and cases from documents with even and odd ids; a case refers to the norm before it.

    Documents have the vector of their number, where there is one; that of request r is 3 r, those after it are its rewordings'.
    """
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), "text", F.array("lang", "source").alias("tags"))
    # written once, as each list reads texts or vectors alone and would join them anew
    path = f"{shared_folder(spark)}/libraries/{uuid.uuid4().hex}"
    (joined := docs.join(vectors.withColumnRenamed("vec_id", "item"), "item", "left")).write.parquet(path)
    docs = spark.read.schema(joined.schema).parquet(path)
    norms = docs.where("item % 2 = 0").withColumn("ref", F.col("item"))
    cases = docs.where("item % 2 = 1").withColumn("refs", F.array(F.col("item") - 1))
    requests = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("request"), "text", F.array(F.concat(F.lit("src"), F.col("item_id") % 20)).alias("tags"))
    return requests.join(vectors.select((F.col("vec_id") / 3).cast("long").alias("request"), "vector").where("vec_id % 3 = 0"), "request", "left"), norms, cases


@query()
def strategy_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = strategies.benchmark(*_libraries(spark, sf_dir), strategies.EngineConfig())
    return runs.groupBy("variant", "kind").agg(F.count("*").alias("n"), F.count("linked").alias("n_linked"))


def _rewrite(spark: SparkSession, sf_dir: str) -> Callable[[DataFrame], DataFrame]:
    """In a model's place: the halves of a request's words are its further wordings."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    words, half = F.split("text", " +"), F.ceil(F.size(F.split("text", " +")) / 2).cast("int")
    halves = F.array(F.array_join(F.slice(words, F.lit(1), half), " "), F.array_join(F.slice(words, half + 1, F.size(words)), " "))

    def rewrite(requests: DataFrame) -> DataFrame:
        rows = requests.select("request", F.posexplode(halves).alias("n", "text"))
        return rows.join(vectors, F.col("vec_id") == 3 * F.col("request") + 1 + F.col("n"), "left").select("request", "text", "vector")

    return rewrite


def _draft(states: DataFrame) -> DataFrame:
    """In a model's place: cites two norms and a case; every third request's first draft cites what is in no evidence."""
    first = lambda kind, n: F.slice(F.filter("evidence", lambda e: e["kind"] == kind), 1, n)
    stray = F.array(F.struct(F.lit("norm").alias("kind"), F.lit(-1).cast("long").alias("item")))
    return states.withColumn("cited", F.concat(first("norm", 2), first("case", 1), F.slice(stray, 1, F.when((F.col("request") % 3 == 0) & (F.col("passes") == 0), 1).otherwise(0))))


def _judge(drafts: DataFrame) -> DataFrame:
    """In a model's place: every fifth request has a false alarm, every seventh's first draft lacks evidence."""
    kinds = F.array(F.when(F.col("request") % 5 == 0, "hallucination"), F.when((F.col("request") % 7 == 0) & (F.col("passes") == 0), "evidence_insufficient"))
    return drafts.withColumn("issues", F.array_compact(kinds))


@query()
def ablation_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of all six ablations by kind, with their final drafts: passes, those that passed the check, citations outside the evidence."""
    requests, norms, cases = _libraries(spark, sf_dir)
    config = strategies.EngineConfig(rewrite=_rewrite(spark, sf_dir))
    found = strategies.ablation_study(requests, norms, cases, config, keep=True)
    drafts = strategies.ablated_drafts(requests, found, config, _draft, _judge)
    told = drafts.groupBy("ablation").agg(F.sum("passes").alias("passes"), F.count_if("passed").alias("n_passed"), F.sum(F.size(F.array_except("cited", "evidence"))).alias("n_outside"))
    return found.groupBy("ablation", "kind").agg(F.count("*").alias("n"), F.count("linked").alias("n_linked")).join(told, "ablation")


QUERIES["flagship"] = rrf_fuse
ORACLE_SQL["flagship"] = _FUSED
