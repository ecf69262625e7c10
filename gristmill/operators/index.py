"""A stored inverted index, and the best k items by BM25 without scoring all that share a word.

An index is a list of segments under one version (`sources.versions`). A segment never
changes and holds

* `postings`: the items of each term of each field in blocks, in folders by a hash of the
  term, in order of the terms; each block with its largest tf and smallest length, from
  which follows the most that one of its items can score;
* `terms`: df and the same bound of each term;
* `forward`: term counts of each item, for changes and for merging segments;
* `items`: what the segment holds, by content hash, and `dead`: items of older segments that it replaces.

A term of many items is dealt to blocks by the items' lengths and a hash of their ids, so
no group grows with the corpus, and where an item's entry lies can be told without a search.

Top k by block-max pruning. (1) A request's rarest terms find some items; their whole
scores, looked up in the blocks, give a score that the k-th best reaches at least. (2)
Terms whose bounds together stay below it cannot lift an item to the top by themselves;
only the other terms' blocks are opened, and of these not the ones that stay below with
all that the other terms can add. (3) What can still reach the score is looked up in the
blocks of the remaining terms, first for the items that lead so far, which raises that score. The
result is that of scoring everything.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions.session import checkpoints, shared_folder, small_batches
from gristmill.operators.retrieval import B, BROADCAST_TERMS, DEPTH, K1, KEYWORD_FIELDS, WORD_FIELDS, top_k
from gristmill.sources import versions

#: Items in a block, about, and folders of postings.
BLOCK, BUCKETS = 128, 16
#: Postings that one task puts into blocks, about.
PART_ROWS = 500_000
#: Postings of a request's rarest terms that the first step takes, for each of the k.
SEEDS = 128
#: Pairs of requests and items that are all scored, as finding out which ones to leave costs more.
PLAIN_PAIRS = 20_000_000
#: Segments, beyond which a merge makes one of all.
SEGMENTS = 8


def _bucket(field: Column, term: Column) -> Column:
    return F.pmod(F.xxhash64(field, term), F.lit(BUCKETS)).cast("int")


def _slots(df: Column) -> Column:
    """Hash slots for each class of lengths; 0 where all of a term's items are one block."""
    return F.when(df > BLOCK, F.ceil(df / (4 * BLOCK))).otherwise(0).cast("int")


def _block(item: Column, length: Column, slots: Column) -> Column:
    return F.when(slots == 0, F.lit(0).cast("long")).otherwise(F.shiftleft(F.floor(F.log2(length)).cast("long"), 32) + F.pmod(F.xxhash64(item), slots.cast("long")))


def _few(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= BROADCAST_TERMS else rows


# Columns of the tables; `?` is the type of items.
_TABLES = {
    "postings": "field string, term string, block long, max_tf int, min_length int, items array<?>, tfs array<int>, lengths array<int>, bucket int",
    "terms": "field string, term string, df long, max_tf int, min_length int, gone long",
    "forward": "item ?, field string, term string, tf int, length int",
    "items": "item ?, hash string",
    "dead": "item ?",
}


def _read(spark: SparkSession, folder: str, table: str, item: str) -> DataFrame:
    return spark.read.schema(_TABLES[table].replace("?", item)).parquet(f"{folder}/{table}")


class Index:
    """The newest version at `path`, as it was when this object was made."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        found = versions.latest(spark, path)
        if found is None:
            raise FileNotFoundError(f"no index at {path}")
        self.content = found
        self.segments: list[dict] = found["segments"]

    def table(self, name: str) -> DataFrame:
        """A table of all segments, with the segment's number as `segment`."""
        return reduce(DataFrame.unionByName, (_read(self.spark, f"{self.path}/{s['id']}", name, s["item"]).withColumn("segment", F.lit(i)) for i, s in enumerate(self.segments)))

    @property
    def n_items(self) -> int:
        return sum(s["items"] for s in self.segments)

    def mean_length(self, field: str) -> float:
        return sum(s["lengths"].get(field, 0) for s in self.segments) / max(1, self.n_items)

    def live(self, rows: DataFrame) -> DataFrame:
        """Rows (segment, item and others) of items that no later segment replaces."""
        if not any(s["dead"] for s in self.segments):
            return rows
        gone = self.table("dead").groupBy("item").agg(F.max("segment").alias("_by"))
        return rows.join(gone, "item", "left").where("_by is null or segment >= _by").drop("_by")

    def contents(self) -> DataFrame:
        """item, field, term, tf, length of all that the index holds."""
        return self.live(self.table("forward")).select("item", "field", "term", "tf", "length")


def spread(items: DataFrame, fields: Mapping[str, Column]) -> DataFrame:
    """item, field, term, tf and length (the item's terms in that field); items: item, unique, and what `fields`, arrays of terms, read.

    An item's terms are counted where its text lies; a task holds those of one Arrow batch.
    """
    small_batches(items.sparkSession)
    arrays = F.array(*[F.struct(F.lit(name).alias("field"), terms.alias("terms")) for name, terms in fields.items()])
    rows = items.select("item", F.explode(arrays).alias("f")).select("item", "f.field", "f.terms")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int32)
            words = batch.column(2).flatten().dictionary_encode()
            n, number = max(1, len(words.dictionary)), pc.fill_null(words.indices, -1).to_numpy(zero_copy_only=False)
            key, tf = np.unique((np.repeat(np.arange(len(lengths), dtype=np.int64), lengths) * n + number)[number >= 0], return_counts=True)
            row = pa.array(key // n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), words.dictionary.take(pa.array(key % n)), pa.array(tf.astype(np.int32)), pa.array(lengths[key // n])], names=["item", "field", "term", "tf", "length"])

    return rows.mapInArrow(count, f"item {items.schema['item'].dataType.simpleString()}, field string, term string, tf int, length int")


def _write_segment(spark: SparkSession, path: str, forward: DataFrame, items: DataFrame, dead: DataFrame | None = None, minus: DataFrame | None = None) -> dict:
    """Writes the tables of a segment; what its version says of it.

    forward: as `spread` gives it, read once; items: item, hash; dead: item, of items that
    the segment replaces, and minus: their rows of forward tables.
    """
    name = f"segments/{uuid.uuid4().hex}"
    folder, item = f"{path}/{name}", items.schema["item"].dataType.simpleString()
    read = lambda table: _read(spark, folder, table, item)
    forward.write.parquet(f"{folder}/forward")
    items.write.parquet(f"{folder}/items")
    (items.select("item").limit(0) if dead is None else dead).write.parquet(f"{folder}/dead")
    rows = read("forward")
    terms = rows.groupBy("field", "term").agg(F.count("*").alias("df"), F.max("tf").alias("max_tf"), F.min("length").alias("min_length")).withColumn("gone", F.lit(0).cast("long"))
    sums = rows.groupBy("field").agg(F.sum("tf").alias("n"), F.count("*").alias("rows")).collect()  # a row for each field
    lengths = {r["field"]: r["n"] for r in sums}
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(r["rows"] for r in sums) // PART_ROWS)
    n_dead = 0
    if dead is not None:
        n_dead = read("dead").count()
        for r in minus.groupBy("field").agg(F.sum("tf").alias("n")).collect():  # a row for each field
            lengths[r["field"]] = lengths.get(r["field"], 0) - r["n"]
        lost = minus.groupBy("field", "term").agg(F.count("*").alias("gone"))
        terms = terms.drop("gone").join(lost, ["field", "term"], "full").withColumns({"df": F.coalesce("df", F.lit(0)), "gone": F.coalesce("gone", F.lit(0))})
    terms.select("field", "term", "df", "max_tf", "min_length", "gone").write.parquet(f"{folder}/terms")
    dense = read("terms").where(F.col("df") > BLOCK).select("field", "term", _slots(F.col("df")).alias("slots"))
    placed = rows.join(_few(dense, dense.count()), ["field", "term"], "left").withColumn("slots", F.coalesce("slots", F.lit(0)))
    keyed = placed.select(_bucket(F.col("field"), F.col("term")).alias("bucket"), "field", "term", _block(F.col("item"), F.col("length"), F.col("slots")).alias("block"), "item", "tf", "length")
    key = ["bucket", "field", "term", "block"]
    entries = F.array_sort(F.collect_list(F.struct("item", "tf", "length")))  # a block's
    blocks = keyed.repartitionByRange(parts, *key).groupBy(*key).agg(F.max("tf").alias("max_tf"), F.min("length").alias("min_length"), entries.alias("e"))
    flat = [F.col(f"e.{c}").alias(f"{c}s") for c in ("item", "tf", "length")]
    blocks.select(*key, "max_tf", "min_length", *flat).sortWithinPartitions(*key).write.partitionBy("bucket").parquet(f"{folder}/postings")
    return {"id": name, "item": item, "items": read("items").count() - n_dead, "lengths": lengths, "dead": n_dead}


def _one_each(items: DataFrame) -> DataFrame:
    """One row of each item, that of the largest content hash, with its hash. Only items that come several times are shuffled."""
    rows = items.where("item is not null").withColumn("_hash", content_hash(items))
    several = rows.groupBy("item").agg(F.count("*").alias("c")).where("c > 1").select("item").checkpoint()
    if not (n := several.count()):
        return rows
    of = rows.join(_few(several, n), "item", "left_semi")
    largest = of.groupBy("item").agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != "item"]), "_hash").alias("r"))
    return rows.join(_few(several, n), "item", "left_anti").unionByName(largest.select("item", "r.*"))


def content_hash(items: DataFrame) -> Column:
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(items.columns)]), {"ignoreNullFields": "false"}), 256)


def build(items: DataFrame, path: str, fields: Mapping[str, Column], about: Mapping | None = None) -> Index:
    """Writes an index anew, as one segment, and makes it the newest version.

    items: item (not null) and what `fields` read. Rows without an item are left out, and
    of several with one item that of the largest content hash counts. about: what the
    version is to say of itself. Items without terms count in the mean length. An empty
    table gives an empty index.
    """
    spark = items.sparkSession
    checkpoints(spark)
    one = _one_each(items)
    segment = _write_segment(spark, path, spread(one, fields), one.select("item", F.col("_hash").alias("hash")))
    versions.commit(spark, path, {"version": (versions.latest(spark, path) or {}).get("version", 0), "segments": [segment], "batches": {}, "about": dict(about or {})})
    return Index(spark, path)


def kept(items: DataFrame, source: str, fields: Mapping[str, Column], name: str) -> Index:
    """The index of items read from the files at `source`, in the shared folder; built where there is none of their present size, number and time.

    name: tells apart indexes of one source by other fields.
    """
    spark = items.sparkSession
    place, fs = versions.place(spark, source)
    there = fs.getContentSummary(place)
    state = (name, source, there.getLength(), there.getFileCount(), fs.getFileStatus(place).getModificationTime(), sorted(fields), BLOCK, BUCKETS)
    path = f"{shared_folder(spark)}/indexes/{hashlib.sha256(repr(state).encode()).hexdigest()[:24]}"
    return Index(spark, path) if versions.latest(spark, path) else build(items, path, fields, {"source": source})


def merge(items: DataFrame, path: str, fields: Mapping[str, Column], batch: tuple[str, int] | None = None) -> Index:
    """Adds items as a segment of a new version; items that are there with the same content are left alone, others replaced.

    batch: name of a stream and number of its batch; a number that the version has seen
    is not taken again. Either way a repeated call changes nothing.
    """
    spark = items.sparkSession
    checkpoints(spark)
    if versions.latest(spark, path) is None:
        versions.commit(spark, path, {"segments": [], "batches": {}, "about": {}})
    now = Index(spark, path)
    content, one = now.content, _one_each(items)
    if batch and content["batches"].get(batch[0], -1) >= batch[1]:
        return now
    batches = content["batches"] | ({batch[0]: batch[1]} if batch else {})
    if now.segments:
        there = now.live(now.table("items")).select("item", F.col("hash").alias("_was"))
        news = one.select("item", F.col("_hash").alias("hash")).join(there, "item", "left").where("_was is null or _was <> hash")
        news = news.select("item", "hash", F.col("_was").isNotNull().alias("old")).checkpoint()
        one = one.join(_few(news.select("item"), news.count()), "item", "left_semi")
    else:
        news = one.select("item", F.col("_hash").alias("hash"), F.lit(False).alias("old")).checkpoint()
    if not news.isEmpty():
        dead = news.where("old").select("item")
        minus = None if dead.isEmpty() else now.contents().join(dead, "item", "left_semi")
        segment = _write_segment(spark, path, spread(one, fields), news.select("item", "hash"), None if minus is None else dead, minus)
        content = content | {"segments": [*content["segments"], segment]}
    versions.commit(spark, path, content | {"batches": batches})
    done = Index(spark, path)
    return compact(done) if len(done.segments) > SEGMENTS else done


def compact(index: Index) -> Index:
    """One segment of all, without reading any text again."""
    spark, path = index.spark, index.path
    items = index.live(index.table("items")).select("item", "hash")
    segment = _write_segment(spark, path, index.contents(), items)
    versions.commit(spark, path, index.content | {"segments": [segment]})
    return Index(spark, path)


def _weight(tf: Column, length: Column, mean: float, norms: bool) -> Column:
    return tf / (tf + (K1 * (1 - B + B * length / mean) if norms else K1))


def _rated(index: Index, requests: DataFrame, terms: Callable[[Column], Column], field: str, norms: bool) -> DataFrame:
    """request, term, df, idf and bound (the most that the term adds to a score)."""
    asked = requests.select("request", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    known = index.table("terms").where(F.col("field") == field)
    known = known.groupBy("term").agg((F.sum("df") - F.sum("gone")).alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_length").alias("min_length")).where("df > 0")
    idf = F.log1p((index.n_items - F.col("df") + 0.5) / (F.col("df") + 0.5))
    bound = idf * _weight(F.col("max_tf"), F.col("min_length"), max(index.mean_length(field), 1e-9), norms)
    return asked.join(known, "term").select("request", "term", "df", idf.alias("idf"), bound.alias("bound"))


class _Reader:
    """Blocks of the terms that a set of requests has."""

    def __init__(self, index: Index, field: str, rated: DataFrame, n: int, norms: bool):
        self.index, self.n, self.norms, self.mean = index, n, norms, max(index.mean_length(field), 1e-9)
        buckets = [r[0] for r in rated.select(_bucket(F.lit(field), F.col("term"))).distinct().collect()]  # BUCKETS at most
        self.blocks = index.table("postings").where((F.col("field") == field) & F.col("bucket").isin(buckets))
        self.slots = index.table("terms").where((F.col("field") == field) & (F.col("df") > 0)).select("segment", "term", _slots(F.col("df")).alias("slots"))

    def opened(self, wanted: DataFrame, least: Column | None = None) -> DataFrame:
        """request, item, length, part of all entries of the wanted terms (request, term, idf), but for blocks that fail `least`."""
        met = self.blocks.join(_few(wanted, self.n), "term")
        if least is not None:
            met = met.where(least)
        e = met.select("request", "idf", "segment", F.explode(F.arrays_zip("items", "tfs", "lengths")).alias("e"))
        part = F.col("idf") * _weight(F.col("e.tfs"), F.col("e.lengths"), self.mean, self.norms)
        return self.index.live(e.select("request", F.col("e.items").alias("item"), F.col("e.lengths").alias("length"), "segment", part.alias("part")))

    def looked_up(self, wanted: DataFrame, n: int) -> DataFrame:
        """request, item, part for the wanted items and terms (request, item, length, term, idf), n rows at most."""
        slots = self.slots.join(_few(wanted.select("term").distinct(), n), "term", "left_semi")
        lookups = wanted.join(slots, "term").withColumn("block", _block(F.col("item"), F.col("length"), F.col("slots")))
        met = self.blocks.select("segment", "term", "block", "items", "tfs", "lengths").join(_few(lookups.select("request", "item", "term", "idf", "segment", "block"), n * len(self.index.segments)), ["segment", "term", "block"])
        at = F.array_position("items", F.col("item"))
        met = met.withColumn("at", at.cast("int")).where("at > 0")
        part = F.col("idf") * _weight(F.element_at("tfs", F.col("at")), F.element_at("lengths", F.col("at")), self.mean, self.norms)
        return self.index.live(met.select("request", "item", "segment", part.alias("part"))).select("request", "item", "part")


def _asked(index: Index, requests: DataFrame, terms, field: str, norms: bool) -> tuple[DataFrame, int, int, _Reader]:
    """The rated terms, how many they are, the pairs of requests and items that they make, and the blocks."""
    checkpoints(index.spark)
    rated = _rated(index, requests, terms, field, norms).checkpoint()
    n, n_pairs = rated.agg(F.count("*"), F.coalesce(F.sum("df"), F.lit(0))).first()
    return rated, n, n_pairs, _Reader(index, field, rated, n, norms)


def _plan(rated: DataFrame, n: int, reader: _Reader, k: int, digits: int) -> DataFrame:
    """The rated terms with least (a score that the k-th best reaches), essential, the bounds of all the request's terms (most) and of those that are not essential (rest, n_others)."""
    rare = Window.partitionBy("request").orderBy("df", "term")
    before = F.coalesce(F.sum("df").over(rare.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seeds = rated.withColumn("_before", before).where(F.col("_before") < SEEDS * k).select("request", "term", "idf")
    found = reader.opened(seeds).groupBy("request", "item").agg(F.sum("part").alias("score"), F.first("length").alias("length"))
    some = top_k(found, k).select("request", "item", "length").join(rated.select("request", "term", "idf"), "request")
    whole = reader.looked_up(some, n * k).groupBy("request", "item").agg(F.sum("part").alias("score"))
    least = rated.join(_kth(whole, k, digits), "request", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    weak = Window.partitionBy("request").orderBy("bound", "term")
    ranked = least.withColumn("essential", F.sum("bound").over(weak) >= F.col("least"))
    each = Window.partitionBy("request")
    rest = F.coalesce(F.sum(F.when(~F.col("essential"), F.col("bound"))).over(each), F.lit(0.0))
    n_others = F.sum(F.when(~F.col("essential"), 1).otherwise(0)).over(each)
    return ranked.withColumns({"most": F.sum("bound").over(each), "rest": rest, "n_others": n_others}).checkpoint()


def _kth(whole: DataFrame, k: int, digits: int) -> DataFrame:
    """request and least: a score that the k-th best item reaches, less than which rounding may still lift to it; k items' whole scores are known."""
    return whole.groupBy("request").agg(F.count("*").alias("_n"), F.min("score").alias("_min")).select("request", F.when(F.col("_n") >= k, F.col("_min") - 1.01 * 10.0**-digits).alias("least"))


def search(index: Index, requests: DataFrame, terms: Callable[[Column], Column], field: str = "text", k: int = DEPTH, digits: int = 6, norms: bool = True) -> DataFrame:
    """request, item, score, rank: what `retrieval.bm25` gives for the items of the index. requests: request, text; each request once.

    A request without a known term gets nothing. No text of an item is read. Few pairs
    (PLAIN_PAIRS) are all scored; beyond, pruning spares most of them. Both give the same.
    """
    if not index.segments:
        return requests.select("request", F.lit(None).cast("long").alias("item"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    rated, n, n_pairs, reader = _asked(index, requests, terms, field, norms)
    if n_pairs <= PLAIN_PAIRS:
        scores = reader.opened(rated.select("request", "term", "idf")).groupBy("request", "item").agg(F.round(F.sum("part"), digits).alias("score"))
        return top_k(scores, k).select("request", "item", "score", "rank")
    plan = _plan(rated, n, reader, k, digits)
    essential = plan.where("essential").select("request", "term", "idf", "bound", F.col("most").alias("_most"), F.col("least").alias("_least"))
    block = F.col("idf") * _weight(F.col("max_tf"), F.col("min_length"), reader.mean, norms)
    opened = reader.opened(essential, block + F.col("_most") - F.col("bound") >= F.col("_least"))
    found = opened.groupBy("request", "item").agg(F.sum("part").alias("part"), F.first("length").alias("length"))
    limits = plan.select("request", "least", "rest").distinct()
    others = plan.where(~F.col("essential")).select("request", "term", "idf")
    found = found.join(_few(limits, n), "request").where(F.col("part") + F.col("rest") >= F.col("least")).select("request", "item", "part", "length", "rest").checkpoint()
    # the whole scores of those that lead so far raise what the others must reach
    leading = top_k(found, k, "part").select("request", "item", "part", "length")
    asked = lambda rows: rows.join(_few(others, n), "request").select("request", "item", "length", "term", "idf")
    whole = leading.select("request", "item", "part").unionByName(reader.looked_up(asked(leading), n * k)).groupBy("request", "item").agg(F.sum("part").alias("score"))
    hopeful = found.join(_kth(whole, k, digits), "request", "left").where(F.col("least").isNull() | (F.col("part") + F.col("rest") >= F.col("least"))).select("request", "item", "part", "length").checkpoint()
    more = reader.looked_up(asked(hopeful), hopeful.count() * plan.agg(F.max("n_others")).first()[0] if n else 0)
    scores = hopeful.select("request", "item", "part").unionByName(more).groupBy("request", "item").agg(F.round(F.sum("part"), digits).alias("score"))
    return top_k(scores, k).select("request", "item", "score", "rank")


def pairs(index: Index, requests: DataFrame, terms: Callable[[Column], Column], field: str = "text", k: int = DEPTH, digits: int = 6) -> DataFrame:
    """request, all_pairs (of the request and items that share a term, once for each), opened_pairs (those in blocks that `search` opens)."""
    rated, n, _, reader = _asked(index, requests, terms, field, True)
    plan = _plan(rated, n, reader, k, digits)
    block = F.col("idf") * _weight(F.col("max_tf"), F.col("min_length"), reader.mean, True)
    blocks = reader.blocks.join(plan, "term").groupBy("request").agg(F.sum(F.size("items")).alias("all_pairs"), F.sum(F.when(F.col("essential") & (block + F.col("most") - F.col("bound") >= F.col("least")), F.size("items")).otherwise(0)).alias("opened_pairs"))
    return blocks.select("request", "all_pairs", "opened_pairs")


def search_fields(index: Index, requests: DataFrame, terms: Callable[[Column], Column], k: int = DEPTH, words: Mapping[str, float] | None = None, keywords: Mapping[str, float] | None = None, digits: int = 6) -> DataFrame:
    """request, item, score, rank: what `retrieval.bm25_fields` gives: the best field's boosted score; keywords match whole requests.

    An item of the top k is among the top k of its best field, so each field is searched for k alone.
    """
    words, keywords = WORD_FIELDS if words is None else words, KEYWORD_FIELDS if keywords is None else keywords
    whole = lambda text: F.array(text)
    found = [search(index, requests, terms, f, k, digits).withColumn("score", F.col("score") * boost) for f, boost in words.items()]
    found += [search(index, requests, whole, f, k, digits, norms=False).withColumn("score", F.col("score") * boost) for f, boost in keywords.items()]
    best = reduce(DataFrame.unionByName, (r.select("request", "item", "score") for r in found)).groupBy("request", "item").agg(F.round(F.max("score"), digits).alias("score"))
    return top_k(best, k)


def chunk_fields(chunks: DataFrame, terms: Callable[[Column], Column], words: Mapping[str, float] | None = None, keywords: Mapping[str, float] | None = None) -> dict[str, Column]:
    """The fields of chunks for `build`: words by `terms`, keywords as they are (a string or an array of them)."""
    words, keywords = WORD_FIELDS if words is None else words, KEYWORD_FIELDS if keywords is None else keywords
    value = lambda f: F.array_distinct(F.col(f)) if chunks.schema[f].dataType.typeName() == "array" else F.array(F.col(f).cast("string"))
    return {f: terms(F.col(f)) for f in words} | {f: value(f) for f in keywords}
