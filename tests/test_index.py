"""Tests of the stored index, its pruned search, and its upkeep by merges and streams."""

import random

import pytest
from pyspark.sql import functions as F

from gristmill.functions import text as tx
from gristmill.operators import index, retrieval


@pytest.fixture(autouse=True)
def pruned(monkeypatch):
    monkeypatch.setattr(index, "PLAIN_PAIRS", -1)
    monkeypatch.setattr(index, "SEEDS", 4)


def corpus(n, seed=1):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]  # a few words are everywhere
    return [(i, " ".join(["the"] * rnd.randint(0, 9) + rnd.choices(words, weights, k=rnd.randint(0, 60) ** rnd.choice([1, 1, 1])))) for i in range(n)]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([*corpus(1500), (5000, None), (5001, "")], "item long, text string").repartition(4)


@pytest.fixture(scope="module")
def requests(spark):
    rnd = random.Random(2)
    rows = [(f"r{i}", "the " + " ".join(f"w{int(400 * rnd.random() ** 3)}" for _ in range(rnd.randint(1, 6)))) for i in range(40)]
    return spark.createDataFrame([*rows, ("none", "unknown words"), ("blank", ""), ("null", None), ("stop", "the w0 w1"), ("the", "the the")], "request string, text string")


@pytest.fixture(scope="module")
def stored(spark, items, tmp_path_factory):
    return index.build(items, str(tmp_path_factory.mktemp("index")), {"text": tx.tokens(F.col("text"))})


def listed(df):
    return sorted((r["request"], r["rank"], r["item"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("k,plain", [(1, -1), (20, -1), (3000, -1), (7, 10**9)])
def test_search_equals_scoring_everything(spark, items, requests, stored, monkeypatch, k, plain):
    monkeypatch.setattr(index, "PLAIN_PAIRS", plain)
    assert listed(index.search(stored, requests, tx.tokens, k=k)) == listed(retrieval.bm25(items, requests, tx.tokens, k).select("request", "item", "score", "rank"))


def test_search_opens_fewer_pairs_and_no_texts(spark, requests, stored):
    rows = index.pairs(stored, requests, tx.tokens, k=5).collect()
    every, opened = sum(r["all_pairs"] for r in rows), sum(r["opened_pairs"] for r in rows)
    assert opened < 0.7 * every, (opened, every)
    assert all(r["opened_pairs"] <= r["all_pairs"] for r in rows)
    assert "regexp" not in index.search(stored, requests.select("request", "text"), lambda c: F.split(c, " "))._jdf.queryExecution().toString()


def test_joins_without_broadcast_give_the_same(spark, items, requests, stored, monkeypatch):
    want = listed(index.search(stored, requests, tx.tokens, k=5))
    monkeypatch.setattr(index, "BROADCAST_TERMS", 0)
    assert listed(index.search(stored, requests, tx.tokens, k=5)) == want


def test_blocks_hold_what_their_bounds_say(spark, stored):
    rows = stored.table("postings").collect()
    assert max(len(r["items"]) for r in rows) < 8 * index.BLOCK
    for r in rows:
        assert r["max_tf"] == max(r["tfs"]) and r["min_length"] == min(r["lengths"]) and r["items"] == sorted(r["items"])
    assert sum(len(r["items"]) for r in rows if r["term"] == "the") == stored.table("terms").where("term = 'the'").first()["df"]


def test_fields_like_the_unstored_search(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choices("abcdefg", k=9)), " ".join(rnd.choices("abcdefg", k=2)), rnd.choice(["1.1", "1.2", "a"]), [*rnd.sample(["a", "b", "c"], 2)]) for i in range(200)]
    items = spark.createDataFrame(rows, "item long, text string, title string, article_id string, scenario_tags array<string>")
    words, keywords = {"text": 4.0, "title": 3.0}, {"article_id": 5.0, "scenario_tags": 2.0}
    asked = spark.createDataFrame([(1, "a b"), (2, "a"), (3, "1.1"), (4, "z")], "request long, text string")
    stored = index.build(items, str(tmp_path), index.chunk_fields(items, tx.tokens, words, keywords))
    got = index.search_fields(stored, asked, tx.tokens, 10, words, keywords)
    assert listed(got) == listed(retrieval.bm25_fields(items, asked, tx.tokens, 10, words, keywords))


def test_repeated_and_missing_items(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "a"), (2, "c c"), (None, "a")], "item long, text string")
    stored = index.build(rows, str(tmp_path / "x"), {"text": tx.tokens(F.col("text"))})
    assert stored.n_items == 2 and {r["item"] for r in stored.contents().collect()} == {1, 2}
    empty = index.build(rows.limit(0), str(tmp_path / "y"), {"text": tx.tokens(F.col("text"))})
    assert empty.n_items == 0 and index.search(empty, rows.select(F.col("item").alias("request"), "text"), tx.tokens).collect() == []
    with pytest.raises(FileNotFoundError):
        index.Index(spark, str(tmp_path / "none"))


def test_merges_equal_one_build(spark, items, requests, tmp_path):
    fields = {"text": tx.tokens(F.col("text"))}
    changed = items.where("item % 7 = 0").withColumn("text", F.concat("text", F.lit(" extra words")))
    last = items.where("item % 7 <> 0").unionByName(changed)
    path = str(tmp_path / "parts")
    for i in range(3):
        index.merge(items.where(F.col("item") % 3 == i), path, fields)
    merged = index.merge(changed, path, fields)
    version = merged.content["version"]
    again = index.merge(changed, path, fields)  # nothing is new
    assert [s["id"] for s in again.segments] == [s["id"] for s in merged.segments] and again.content["version"] == version + 1
    whole = index.build(last, str(tmp_path / "whole"), fields)
    rows = lambda x: sorted(map(tuple, x.contents().collect()))
    assert rows(merged) == rows(whole) and merged.n_items == whole.n_items and merged.mean_length("text") == whole.mean_length("text")
    want = listed(index.search(whole, requests, tx.tokens, k=6))
    assert listed(index.search(merged, requests, tx.tokens, k=6)) == want
    with pytest.raises(RuntimeError):
        index.compact(merged)  # not the newest version
    small = index.compact(again)
    assert len(small.segments) == 1 and rows(small) == rows(whole) and listed(index.search(small, requests, tx.tokens, k=6)) == want
    assert listed(index.search(merged, requests, tx.tokens, k=6)) == want  # an older version stays whole
