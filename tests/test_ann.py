"""Tests of inverted lists of vectors and of the embedder and reranker surface."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from gristmill.functions import embedding
from gristmill.operators import ann, retrieval


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(30, 16))
    x = centers[rng.integers(0, 30, 3000)] + 0.4 * rng.normal(size=(3000, 16))
    x[:900] = x[0]  # a third are one vector
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item long, vector array<double>").repartition(4)


def listed(df):
    return sorted((r["request"], r["rank"], r["item"], r["score"]) for r in df.collect())


@pytest.fixture(scope="module")
def lists(vectors, tmp_path_factory):
    return ann.build(vectors.unionByName(vectors.limit(0)), str(tmp_path_factory.mktemp("lists")), lists=40)


def test_every_vector_is_in_one_list(vectors, lists):
    assert len(lists) == vectors.count() == lists.rows.select("item").distinct().count()


def test_all_lists_are_exact_and_few_have_recall(vectors, lists, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 100)
    monkeypatch.setattr(ann, "REQUESTS", 20)
    asked = vectors.where("item % 50 = 7").withColumnRenamed("item", "request")
    exact = retrieval.nearest(vectors, asked, 10)
    assert listed(ann.nearest(lists, asked, 10, probes=40)) == listed(exact.select("request", "item", "score", "rank"))
    found = ann.nearest(lists, asked, 10, num_candidates=50, probes=4)
    assert ann.recall(found, exact).agg(F.avg("recall")).first()[0] >= 0.9
    assert 1 <= ann.probes_for(lists, 10, 0.5, sample=30) <= ann.probes_for(lists, 10, 1.0, sample=30) <= 40
    assert found.groupBy("request").count().agg(F.min("count"), F.count("*")).first()[:] == (10, 60)


def test_a_task_holds_tiles_not_all_requests_by_lists():
    rng = np.random.default_rng(4)
    centers, asked, items = rng.normal(size=(300, 16)), rng.normal(size=(2000, 16)), rng.normal(size=(6000, 16))
    table = lambda name, x: pa.table({name: np.arange(len(x)), "vector": x.tolist()})
    (batch,) = table("request", asked).to_batches()
    sent, own = list(ann._probed(batch, centers, np.full(300, 20), 10**9, 1)), []
    assert sum(b.num_rows for b in sent) == 2000 * 300 and max(b.num_rows for b in sent) * 16 * 8 <= ann.SENT  # one batch of 77 MB before
    for b in sent:
        own += zip(b.column(0).to_pylist(), b.column(2).to_pylist())
    assert len(set(own)) == 2000 * 300
    tracemalloc.start()
    got = ann._compared(table("item", items), table("request", asked), 7, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2000 * 6000 * 8  # one matrix of scores, of which there were four
    score = np.round(ann._unit(asked) @ ann._unit(items).T, 4)
    wanted = np.lexsort((np.broadcast_to(np.arange(6000), score.shape), -score), axis=1)[:, :7]
    assert got.column("item").to_pylist() == wanted.ravel().tolist() and got.column("request").to_pylist() == np.repeat(np.arange(2000), 7).tolist()


def test_named_items_and_nothing(spark, vectors, tmp_path):
    named = vectors.limit(50).withColumn("item", F.concat(F.lit("n"), F.col("item"))).unionByName(spark.createDataFrame([("x", None), (None, [1.0] * 16)], "item string, vector array<double>"))
    stored = ann.build(named, str(tmp_path / "a"))
    asked = spark.createDataFrame([("q", [1.0] * 16), ("none", None)], "request string, vector array<double>")
    got = listed(ann.nearest(stored, asked, 3, probes=99))
    assert [r[1] for r in got] == [1, 2, 3] and all(r[2].startswith("n") for r in got)
    empty = ann.build(named.limit(0), str(tmp_path / "b"))
    assert len(empty) == 0 and ann.nearest(empty, asked).collect() == [] and ann.nearest(stored, asked.limit(0)).collect() == []


def test_embedder_is_unit_stable_and_checked(spark, tmp_path):
    texts = [(1, "脚手架搭设应当检查"), (2, "scaffold checks"), (3, ""), (4, None), (5, "scaffold checks")]
    rows = spark.createDataFrame(texts, "item long, text string").repartition(3)
    got = {r["item"]: np.array(r["vector"]) for r in rows.select("item", embedding.embed(F.col("text"), dimension=64).alias("vector")).collect()}
    assert all(len(v) == 64 for v in got.values()) and (got[2] == got[5]).all() and not got[3].any() and not got[4].any()
    assert abs(np.linalg.norm(got[1]) - 1) < 1e-9
    for wrong in (embedding.hashing(8), lambda: lambda texts: [[0.0] * 64]):
        with pytest.raises(PythonException, match="the model gave"):
            rows.coalesce(1).select(embedding.embed(F.col("text"), wrong, dimension=64)).collect()
    stored = ann.build(rows.where("item in (1, 2)").select("item", embedding.embed(F.col("text"), dimension=64).alias("vector")), str(tmp_path))
    asked = spark.createDataFrame([(9, "检查脚手架")], "request long, text string").select("request", embedding.embed(F.col("text"), dimension=64).alias("vector"))
    assert ann.nearest(stored, asked, 1).first()["item"] == 1


def test_reranker_loads_once_in_a_worker(spark):
    pool = spark.createDataFrame([(1, i, i, "a b", "a " * (i % 5)) for i in range(1, 9)], "request int, item int, rank int, asked string, text string")

    def model():
        seen = []  # of one task

        def scores(pairs):
            seen.append(len(pairs))
            return [-abs(len(q.split()) - len(t.split())) for q, t in pairs]

        return scores

    score = embedding.rerank_score(F.col("asked"), F.col("text"), model, batch=3)
    got = retrieval.rerank(pool.withColumn("_s", score), F.col("_s"), 3).orderBy("rank").collect()
    assert [r["item"] for r in got] == [2, 7, 1]
    with pytest.raises(PythonException, match="scores for"):
        pool.select(embedding.rerank_score(F.col("asked"), F.col("text"), lambda: lambda pairs: [])).collect()
