"""Retrieval routes for batches of requests, their fusion and reranking.

Ranked lists have request, route, rank, item and score. Requests are a stated set that
tasks hold; texts and vectors are read where they lie, each task keeps the k best of each
request that it met, and those are ranked. What is beyond the set's bound is joined by terms.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gristmill.functions.session import checkpoints, small_batches

K1, B, RRF_K, DEPTH = 1.2, 0.75, 60, 20
#: Of the fused list so many are reranked at least.
POOL = 30
#: Request vectors that one pass compares with; more are taken in several passes.
VECTOR_BLOCK = 4096
#: Pairs of request and term that are broadcast (some 50 bytes each); beyond, they are joined by a shuffle.
BROADCAST_TERMS = 200_000
#: Pairs of request and item that a task scores at once.
TILE = 1 << 19
#: Requests and items of an article that meet at once (Parquet puts 504 values into a run, and equal runs take least space).
TILE_SIDES = 80, 252
#: Tasks for each part of the requests that name an article.
PART_TASKS = 40


def top_k(scored: DataFrame, k: int, by: Column | str = "score") -> DataFrame:
    """The k best of each request, ties by item."""
    order = Window.partitionBy("request").orderBy(F.desc(by), "item")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def postings(items: DataFrame, terms: Column) -> DataFrame:
    """item, term, tf and the item's length."""
    words = items.select("item", terms.alias("terms"))
    return words.select("item", F.size("terms").alias("length"), F.explode("terms").alias("term")).groupBy("item", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def bm25_scores(items: DataFrame, requests: DataFrame, terms, digits: int = 6, within: str | None = None) -> DataFrame:
    """request, item and BM25 score of all items that share a term with a request; items: item, text; requests: request, text.

    within: a column of both; a request meets only items with an equal value, while df and
    lengths stay those of all items.

    Terms that no request has go first; the others are dealt by item, once. That order
    serves the counts of postings and, as long as the requests' terms are few enough to be
    broadcast, the sums of scores; beyond, postings and terms are joined by a shuffle.
    """
    own = [within] if within else []
    lengths = items.select("item", *own, terms(F.col("text")).alias("terms"))
    stats = lengths.agg(F.count("*").alias("items"), F.avg(F.size("terms")).alias("mean"))
    asked = requests.select("request", *own, F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    words = lengths.select("item", *own, F.size("terms").alias("length"), F.explode("terms").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    spread = words.repartition("item").groupBy("item", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"), *[F.first(c).alias(c) for c in own])
    found = spread.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log1p((F.col("items") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    rarity = asked.join(found, "term").crossJoin(F.broadcast(stats)).select("request", *own, "term", idf.alias("idf"), "mean")  # stats is one row
    if asked.count() <= BROADCAST_TERMS:
        rarity = F.broadcast(rarity)
    return spread.join(rarity, ["term", *own]).select("request", "item", (F.col("idf") * weight).alias("weight")).groupBy("request", "item").agg(F.round(F.sum("weight"), digits).alias("score"))


class _Best:
    """The k best items of each request among those that a task has met; ties by item."""

    def __init__(self, n: int, k: int, kind: pa.DataType):
        self.k, self.least = k, np.full(n, -np.inf)
        self.at, self.score, self.item = np.zeros(0, np.int64), np.zeros(0), pa.array([], kind)

    def meet(self, score: np.ndarray, items: pa.Array) -> None:
        """score: a row for each request, a column for each item, -inf where they don't meet."""
        n = score.shape[1]
        kth = np.partition(score, n - self.k, axis=1)[:, n - self.k] if n > self.k else -np.inf
        at, which = np.nonzero((score >= np.maximum(self.least, kth)[:, None]) & (score > -np.inf))
        if not len(at):
            return
        at, found, item = np.concatenate((self.at, at)), np.concatenate((self.score, score[at, which])), pa.concat_arrays([self.item, items.take(pa.array(which))])
        place = pc.rank(item, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        order = np.lexsort((place, -found, at))
        nth = np.arange(len(order)) - np.searchsorted(at[order], at[order])
        order = order[nth < self.k]
        self.at, self.score, self.item = at[order], found[order], item.take(pa.array(order))
        last = nth[nth < self.k] == self.k - 1
        self.least[self.at[last]] = self.score[last]

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.at), self.item, pa.array(self.score)], names=["at", "item", "score"])


def _numbered(requests: DataFrame, rows: list) -> DataFrame:
    """at and request of a stated request set, whose type is that of rows' first field."""
    return requests.sparkSession.createDataFrame([(i, r) for i, r in enumerate(rows)], StructType([StructField("at", LongType()), requests.schema["request"]]))


def _half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as Spark and SQL do; x is not negative."""
    return np.floor(np.round(x * 10.0**digits, 6) + 0.5) / 10.0**digits


def _met(terms: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, number of the term in the vocabulary and count of each known term of each row."""
    lengths = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False)
    number = pc.fill_null(pc.index_in(terms.flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
    key = (np.repeat(np.arange(len(lengths), dtype=np.int64), lengths) * len(vocabulary) + number)[number >= 0]
    key, tf = np.unique(key, return_counts=True)
    return key // max(1, len(vocabulary)), key % max(1, len(vocabulary)), tf


def _merged(items: DataFrame, own: list[str]) -> tuple[DataFrame, bool]:
    """One row of each item (item, own, length, terms); whether rows of an item had to be put together. Only those are shuffled."""
    rows = items.select("item", *own, F.size("terms").alias("length"), "terms")
    several = items.groupBy("item").agg(F.count("*").alias("c")).where("c > 1").select("item")
    if several.isEmpty():
        return rows, False
    several = several.checkpoint()
    few = F.broadcast(several) if several.count() <= BROADCAST_TERMS else several
    whole = rows.join(few, "item", "left_semi").groupBy("item").agg(*[F.first(c).alias(c) for c in own], F.first("length").alias("length"), F.flatten(F.collect_list("terms")).alias("terms"))
    return rows.join(few, "item", "left_anti").unionByName(whole), True


def bm25(items: DataFrame, requests: DataFrame, terms, k: int = DEPTH, digits: int = 6, within: str | None = None, boost: float = 1.0) -> DataFrame:
    """request, item, score, rank: the top k of bm25_scores times boost for each request.

    Requests of up to BROADCAST_TERMS terms are held by every task: texts are read where
    they lie, first for df and lengths, then for scores, and no posting is shuffled or
    kept. A task has a tile of scores and the k best of each request, however much it reads.
    """
    spark, own = items.sparkSession, [within] if within else []
    asked = requests.select("request", *own, F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).where(F.col("term").isNotNull())
    rows = asked.limit(BROADCAST_TERMS + 1).collect()
    if len(rows) > BROADCAST_TERMS:
        scores = bm25_scores(items, requests, terms, digits, within)
        return top_k(scores.withColumn("score", F.round(F.col("score") * boost, digits)) if boost != 1 else scores, k)
    checkpoints(spark)
    small_batches(spark)
    number = {r: i for i, r in enumerate(dict.fromkeys(r["request"] for r in rows))}
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys(r["term"] for r in rows))}
    codes = {c: i for i, c in enumerate(dict.fromkeys(r[within] for r in rows if r[within] is not None))} if within else {None: 0}
    met = [(vocabulary[r["term"]] * len(codes) + codes[r[within] if within else None], number[r["request"]]) for r in rows if not within or r[within] is not None]
    pairs = np.array(sorted(met), np.int64).reshape(-1, 2)  # term and code, request
    texts = items.select("item", *own, terms(F.col("text")).alias("terms"))
    one, several = _merged(texts, own)
    words = pa.array(list(vocabulary), pa.string())
    shared = spark.sparkContext.broadcast((words, pa.array(list(codes)) if within else None, pairs))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value[0]
        df, n, length = np.zeros(len(words), np.int64), 0, 0
        for batch in batches:
            df += np.bincount(_met(batch.column(1), words)[1], minlength=len(words))
            n, length = n + batch.num_rows, length + int(pc.sum(batch.column(0)).as_py() or 0)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-2, -1, at]), pa.array(np.r_[n, length, df[at]])], names=["term", "n"])

    counted = {r["term"]: r["n"] for r in one.select("length", "terms").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row for each term of the requests
    n_items, length = texts.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first() if several else (counted.get(-2, 0), counted.get(-1, 0))
    df = np.array([counted.get(i, 0) for i in range(len(vocabulary))], np.float64)
    idf, mean = spark.sparkContext.broadcast(np.log1p((n_items - df + 0.5) / (df + 0.5))), max(length / max(1, n_items), 1e-9)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, codes, pairs = shared.value
        keys, start, size = np.unique(pairs[:, 0], return_index=True, return_counts=True)
        n_codes, n, best = len(codes) if within else 1, len(number), None
        for batch in batches:
            best = best or _Best(n, k, batch.column(0).type)
            step = max(1, TILE // max(1, n))
            for part in (batch.slice(i, step) for i in range(0, batch.num_rows if len(keys) else 0, step)):
                row, term, tf = _met(part.column(2), words)
                code = pc.fill_null(pc.index_in(part.column(3), value_set=codes), -1).to_numpy(zero_copy_only=False)[row] if within else 0
                at = np.minimum(np.searchsorted(keys, term * n_codes + code), len(keys) - 1)
                same = (keys[at] == term * n_codes + code) & (code >= 0)
                row, term, tf, at = row[same], term[same], tf[same], at[same]
                lengths = part.column(1).to_numpy(zero_copy_only=False)[row]
                weight = idf.value[term] * (tf / (tf + K1 * (1 - B + B * lengths / mean)))
                # each posting meets the requests that have its term
                many = size[at]
                who = pairs[np.repeat(start[at] - np.cumsum(many) + many, many) + np.arange(many.sum()), 1]
                sums = np.bincount(who * part.num_rows + np.repeat(row, many), np.repeat(weight, many), n * part.num_rows).reshape(n, part.num_rows)
                rounded = _half_up(sums, digits)
                best.meet(np.where(sums > 0, rounded if boost == 1 else _half_up(rounded * boost, digits), -np.inf), part.column(0))
        if best is not None:
            yield best.rows()

    kind = items.schema["item"].dataType.simpleString()
    found = one.select("item", "length", "terms", *own).mapInArrow(score, f"at long, item {kind}, score double")
    return top_k(found.join(F.broadcast(_numbered(requests, list(number))), "at").select("request", "item", "score"), k)  # the request set


# Fields of a chunk and what their scores are worth; keywords match whole.
WORD_FIELDS = {"text": 4.0, "title": 3.0}
KEYWORD_FIELDS = {"article_id": 5.0, "standard_code": 3.0, "scenario_tags": 2.0, "hazard_tags": 2.0, "requirement_type": 1.0, "chunk_kind": 1.0}


def bm25_fields(items: DataFrame, requests: DataFrame, terms, k: int = DEPTH, words: dict[str, float] | None = None, keywords: dict[str, float] | None = None, digits: int = 6) -> DataFrame:
    """Top k of the best field's boosted score; items: item and the fields; requests: request, text.

    A keyword field (a string or an array of them) matches where the whole request is one
    of its values; it scores by BM25 over its values without regard to length, as keyword
    fields have none. An item of the top k is among the top k of its best field,
    so each field gives k items for each request, and those of a keyword are found once for each value.
    """
    words, keywords = WORD_FIELDS if words is None else words, KEYWORD_FIELDS if keywords is None else keywords
    found = []
    for name, boost in words.items():
        found.append(bm25(items.select("item", F.col(name).alias("text")), requests, terms, k, digits, boost=boost).select("request", "item", "score"))
    total = items.agg(F.count("*").alias("items"))
    for name, boost in keywords.items():
        value = F.col(name) if items.schema[name].dataType.typeName() == "array" else F.array(F.col(name).cast("string"))
        held = items.select("item", F.explode(F.array_distinct(value)).alias("text")).join(requests.select("text").distinct(), "text", "left_semi")
        spread = held.groupBy("text").agg(F.count("*").alias("df"))
        idf = F.log1p((F.col("items") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        score = F.round(F.round(idf / (1 + K1), digits) * boost, digits)
        worth = spread.crossJoin(F.broadcast(total)).select("text", score.alias("score"))  # total is one row
        first = held.withColumn("_nth", F.row_number().over(Window.partitionBy("text").orderBy("item"))).where(F.col("_nth") <= k)
        found.append(requests.select("request", "text").join(first.join(worth, "text"), "text").select("request", "item", "score"))
    out = reduce(DataFrame.unionByName, found)
    return top_k(out.groupBy("request", "item").agg(F.round(F.max("score"), digits).alias("score")), k)


def best_fields(routes: list[tuple[DataFrame, float]], k: int = DEPTH) -> DataFrame:
    """Scores of several fields times their boosts; an item's best field counts, and only the k best of each field can come out on top."""
    boosted = [top_k(r.select("request", "item", (F.col("score") * boost).alias("score")), k).drop("rank") for r, boost in routes]
    out = boosted[0]
    for other in boosted[1:]:
        out = out.unionByName(other)
    return top_k(out.groupBy("request", "item").agg(F.max("score").alias("score")), k)


def nearest(items: DataFrame, requests: DataFrame, k: int = DEPTH, digits: int = 6) -> DataFrame:
    """Exact cosine top k; items: item (a number), vector; requests: request (of any type), vector (a stated query set, taken in blocks).

    Each task keeps k candidates of each request, so the shuffle is k rows a task and
    request; a tile of scores is all that it has beside them.
    """
    spark = items.sparkSession
    small_batches(spark)
    rows = requests.select("request", "vector").orderBy("request").collect()
    named = _numbered(requests, [r["request"] for r in rows])
    out = None
    for at in range(0, max(1, len(rows)), VECTOR_BLOCK):
        block = rows[at : at + VECTOR_BLOCK]
        names = np.arange(at, at + len(block))
        wanted = np.array([r["vector"] for r in block], np.float64).reshape(len(block), -1 if block else 0)
        shared = spark.sparkContext.broadcast((names, wanted / np.maximum(np.linalg.norm(wanted, axis=1, keepdims=True), 1e-12)))

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, wanted = shared.value
            best = _Best(len(names), k, pa.int64())
            for batch in batches:
                step = max(1, TILE // max(1, len(names)))
                for cut in (batch.slice(i, step) for i in range(0, batch.num_rows if len(names) else 0, step)):
                    vectors = cut.column(1)
                    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
                    score = np.round(wanted @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).T, digits)
                    best.meet(score, cut.column(0))
            out = best.rows()
            if out.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(names[best.at]), *out.columns[1:]], names=["at", "item", "score"])

        part = items.select(F.col("item").cast("long").alias("item"), "vector").mapInArrow(run, "at long, item long, score double")
        out = part if out is None else out.unionByName(part)
    return top_k(out.join(F.broadcast(named), "at").select("request", "item", "score"), k)  # named is the request set


def tag_route(items: DataFrame, requests: DataFrame, families: dict[str, float], k: int = DEPTH) -> DataFrame:
    """Score of each family once where item and request share a tag of it; both have one array column for each family.

    Items with equal tags have equal scores, and ties go by item: the k smallest of each
    set of tags are all that can come out on top, and only they meet requests.
    """
    names = list(families)
    sets = items.select("item", *[F.array_sort(F.array_distinct(F.coalesce(F.col(n), F.array().cast(items.schema[n].dataType)))).alias(n) for n in names])
    items = sets.withColumn("place", F.row_number().over(Window.partitionBy(*names).orderBy("item"))).where(F.col("place") <= k)
    parts = []
    for name, weight in families.items():
        a = items.select("item", F.explode(name).alias("tag"))
        b = requests.select("request", F.explode(name).alias("tag"))
        parts.append(a.join(b, "tag").select("request", "item").distinct().withColumn("score", F.lit(weight)))
    out = parts[0]
    for other in parts[1:]:
        out = out.unionByName(other)
    return top_k(out.groupBy("request", "item").agg(F.sum("score").alias("score")), k)


def overlaps(pairs: DataFrame, items: DataFrame | None, requests: DataFrame, families: Sequence[str]) -> DataFrame:
    """request, item and overlap, a struct of how many distinct tags of each family both have, the first family first.

    pairs: request, item, once each; items and requests: item or request, and an array for each family; null is none.
    items None: pairs have the items' arrays.
    """
    theirs = requests.select("request", *[F.col(n).alias(f"r{n}") for n in families])
    met = pairs if items is None else pairs.select("request", "item").distinct().join(items.select("item", *families), "item")
    met = met.select("request", "item", *[F.col(n).alias(f"i{n}") for n in families])
    shared = F.struct(*[F.greatest(F.size(F.array_intersect(f"i{n}", f"r{n}")), F.lit(0)).alias(n) for n in families])
    return met.join(theirs, "request").select("request", "item", shared.alias("overlap"))


def fuse(routes: DataFrame, k: int, overlap: DataFrame | None = None, rrf_k: int = RRF_K, digits: int = 8) -> DataFrame:
    """Reciprocal rank fusion of request, route, rank, item. Ties: overlap (request, item, overlap: a number or a struct), best rank, first route and rank, item."""
    out = routes.groupBy("request", "item").agg(
        F.round(F.sum(1.0 / (rrf_k + F.col("rank"))), digits).alias("score"),
        F.min("rank").alias("best_rank"),
        F.min(F.struct("route", "rank")).alias("first_seen"),
        F.count("*").alias("n_routes"),
    )
    out = out.join(overlap, ["request", "item"], "left") if overlap is not None else out.withColumn("overlap", F.lit(0))
    if out.schema["overlap"].dataType.typeName() != "struct":
        out = out.withColumn("overlap", F.coalesce("overlap", F.lit(0)))
    order = Window.partitionBy("request").orderBy(F.desc("score"), F.desc_nulls_last("overlap"), "best_rank", "first_seen", "item")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("first_seen")


def rerank(pool: DataFrame, score: Column, k: int) -> DataFrame:
    """Pool rows: request, item, one row for each of the request's queries; the best query counts; earlier ranks win ties."""
    best = pool.groupBy("request", "item").agg(F.max(score).alias("score"), F.min("rank").alias("prior"))
    order = Window.partitionBy("request").orderBy(F.desc("score"), "prior", "item")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rerank_fused(routes: DataFrame, texts: DataFrame, queries: DataFrame, score: Column, k: int) -> DataFrame:
    """The max(POOL, k) best of all fused routes (request, route, rank, item), reranked by their best query.

    texts: item and what `score` reads of it; queries: request and what it reads of each of the request's queries.
    """
    pool = fuse(routes, max(POOL, k)).select("request", "item", "rank")
    return rerank(beside(pool, texts).join(queries, "request"), score, k)


def beside(pool: DataFrame, items: DataFrame) -> DataFrame:
    """pool (ranked lists of a request set) with the items' columns; a pool of BROADCAST_TERMS rows at most goes to the items, which then stay where they lie."""
    checkpoints(pool.sparkSession)
    pool = pool.checkpoint()
    return items.join(F.broadcast(pool) if pool.count() <= BROADCAST_TERMS else pool, "item")


MODES = ("bm25", "vector", "tag", "rrf_hybrid")
#: Kinds of lists that a mode fuses.
ROUTES = {"bm25": (0,), "vector": (1,), "tag": (2,), "rrf_hybrid": (0, 1, 2)}
# Families of tags, the more telling one first, and what one shared tag is worth.
FAMILIES = {"hazard_tags": 2.0, "scenario_tags": 1.0}


def given_order(queries: DataFrame) -> list[str]:
    """Columns that put a request's queries in order: ordinal, where there is one, and the text."""
    return [*(["ordinal"] if "ordinal" in queries.columns else []), "text"]


def retrieve(
    items: DataFrame, requests: DataFrame, queries: DataFrame, terms, mode: str = "rrf_hybrid", k: int = 5, score: Column | None = None, words: dict[str, float] | None = None, keywords: dict[str, float] | None = None
) -> DataFrame:
    """request, item, rank: the k best items of each request by one route or by all.

    items: item, the fields of a chunk, the arrays of FAMILIES, vector; requests: request
    and the arrays; queries: request, text, vector, and ordinal where their order counts (earlier
    lists win ties; by text without it). Blank queries are dropped; each other
    one is a ranked list of its own in the word and vector routes, and a request without any gets nothing.
    All lists are fused; ties go by shared tags of each family. With `score` (over the
    items' columns and asked, a query's text), the fused pool is reranked by the best query.
    """
    if mode not in MODES:
        raise ValueError(f"no mode {mode!r}; there are {', '.join(MODES)}")
    clean = queries.withColumn("text", F.trim("text")).where("text <> ''")
    lists = ranked_lists(items, requests, clean, terms, ROUTES[mode], words, keywords)
    pool = fused_lists(lists, items, requests, k if score is None else max(POOL, k))
    if score is None:
        return pool
    return rerank(beside(pool, items).join(clean.select("request", F.col("text").alias("asked")), "request"), score, k).select("request", "item", "rank")


def retrieve_all(items: DataFrame, requests: DataFrame, queries: DataFrame, terms, k: int = 5, words: dict[str, float] | None = None, keywords: dict[str, float] | None = None) -> dict[str, DataFrame]:
    """What `retrieve` gives by each mode; lists that several modes fuse are made once."""
    clean = queries.withColumn("text", F.trim("text")).where("text <> ''")
    lists = ranked_lists(items, requests, clean, terms, ROUTES["rrf_hybrid"], words, keywords)
    return {m: fused_lists(lists.where(F.col("route.kind").isin(*ROUTES[m])), items, requests, k) for m in MODES}


def ranked_lists(items: DataFrame, requests: DataFrame, clean: DataFrame, terms, kinds: Sequence[int], words: dict[str, float] | None = None, keywords: dict[str, float] | None = None) -> DataFrame:
    """request, route (kind: 0 words, 1 vectors, 2 tags; query), rank, item of each kind, DEPTH for each query; clean: queries without blank ones. Made once, in the checkpoint folder."""
    checkpoints(items.sparkSession)
    named = clean.withColumn("request", F.struct("request", F.row_number().over(Window.partitionBy("request").orderBy(*given_order(clean))).alias("query")))
    lists = []
    if 0 in kinds:
        found = bm25_fields(items, named.select("request", "text"), terms, DEPTH, words, keywords)
        lists.append(found.select("request.request", F.struct(F.lit(0).alias("kind"), F.col("request.query").alias("query")).alias("route"), "rank", "item"))
    if 1 in kinds:
        found = nearest(items.where("vector is not null").select("item", "vector"), named.where("vector is not null").select("request", "vector"), DEPTH)
        lists.append(found.select("request.request", F.struct(F.lit(1).alias("kind"), F.col("request.query").alias("query")).alias("route"), "rank", "item"))
    if 2 in kinds:
        asking = requests.join(clean.select("request").distinct(), "request", "left_semi")
        lists.append(tag_route(items, asking, FAMILIES, DEPTH).select("request", F.struct(F.lit(2).alias("kind"), F.lit(0).alias("query")).alias("route"), "rank", "item"))
    return reduce(DataFrame.unionByName, lists).checkpoint()


def fused_lists(lists: DataFrame, items: DataFrame, requests: DataFrame, k: int) -> DataFrame:
    """request, item, rank: the k best of all lists; ties go by shared tags of each family."""
    met = beside(lists.select("request", "item").distinct(), items.select("item", *FAMILIES))
    shared = overlaps(met, None, requests, list(FAMILIES))
    return fuse(lists, k, shared).select("request", "item", "rank")


def by_refs(refs: DataFrame, chunks: DataFrame, parts: int | None = None) -> DataFrame:
    """request and item of the articles that references name: CODE:article with both parts, no laws in 《》, each pair once.

    refs: request, ref; chunks: item, standard_code, article_id. Only items with several
    articles can meet a request twice, so only their pairs are told apart by a shuffle; all
    others leave the join as they are.

    `parts` is for pairs that far outnumber references: of an article, so many parts of the
    requests meet the items apart, see `_tiles`.
    """
    told = refs.where(F.contains("ref", F.lit(":")) & ~F.startswith("ref", F.lit("《")))
    code, article = F.trim(F.substring_index("ref", ":", 1)), F.trim(F.expr("substr(ref, instr(ref, ':') + 1)"))
    key = ["standard_code", "article_id"]
    named = told.select("request", code.alias("standard_code"), article.alias("article_id")).where("standard_code <> '' and article_id <> ''")
    held = chunks.where("standard_code is not null and article_id is not null").select("item", F.struct(*key).alias("key")).groupBy("item").agg(F.collect_set("key").alias("keys"))
    items = lambda some: held.where(some).select("item", F.explode("keys").alias("key")).select("item", "key.*")
    met = (lambda some: named.distinct().join(items(some), key).select("request", "item")) if parts is None else (lambda some: _tiles(named, items(some), key, parts))
    return met(F.size("keys") == 1).unionByName(met(F.size("keys") > 1).distinct())


def _blocks(rows: DataFrame, by: list[str], column: str, most: int) -> DataFrame:
    """Numbered blocks (block, and the column's name as an array) of at most so many values for each `by`."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(column))
    listed = F.transform(F.collect_list(F.struct(column)), lambda x: x[column])  # with nulls
    return rows.select(*by, column, F.floor((nth - 1) / most).alias("block")).groupBy(*by, "block").agg(listed.alias(column))


def _tiles(named: DataFrame, items: DataFrame, key: list[str], parts: int) -> DataFrame:
    """The join of named (request, key) without repetitions and items (item, key), blocks of requests with blocks of items.

    Requests are dealt into parts, and an article's items go to each part. A task holds few
    articles and requests, one tile's pairs at a time, and gives a block of items after
    the other, each request in a run: files store such rows in least space.
    """
    by = ["part", *key]
    n = max(int(named.sparkSession.conf.get("spark.sql.shuffle.partitions")), PART_TASKS * parts)
    deal = lambda rows: rows.repartition(n, *by).hint("merge")
    asking = _blocks(deal(named.withColumn("part", F.pmod(F.hash("request"), F.lit(parts)))).distinct(), by, "request", TILE_SIDES[0]).drop("block")
    held = deal(_blocks(items, key, "item", TILE_SIDES[1]).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))))
    tiles = asking.join(held, by).sortWithinPartitions(*by, "block")
    return tiles.select("item", F.explode("request").alias("request")).select("request", F.explode("item").alias("item"))
