import itertools
import statistics

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.functions import text as tx
from gristmill.operators import curation, evaluation, evidence, retrieval
from gristmill.plans import catalog, library  # noqa: F401
from gristmill.sources import files

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(rows):
    return sorted(tuple("NULL" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    ours = plain(df.select(*names).collect())
    cur = duck.execute(catalog.ORACLE_SQL[name])
    got = [d[0] for d in cur.description]
    assert sorted(got) == names
    theirs = plain(tuple(row[got.index(n)] for n in names) for row in cur.fetchall())
    assert ours == theirs


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize(
    ("value", "column", "wanted"),
    [
        ("脚手架 ABC", tx.bigrams, ["脚手", "手架", "abc"]),
        ("A　 B\n\n\n\nC ", tx.normalize, "A B\n\nC"),
        ("1. 0. 1 文", tx.join_numbers, "1.0.1 文"),
        ("2. o. 2", tx.join_numbers, "2.0.2"),
        ("JGJ 80-2016", tx.standard_code, "JGJ-80-2016"),
        ("JGJ/T 46-2024", tx.standard_code, "JGJ-T46-2024"),
        ("2024年3月5日", tx.iso_date, "2024-03-05"),
        (" about ", tx.iso_date, "about"),
        ("norm::JGJ-80-2016::article::3.0.5", tx.chunk_reference, "JGJ-80-2016:3.0.5"),
        ("case::case-01::summary", tx.chunk_reference, "case-01"),
        ("norm::x::table::1", tx.chunk_reference, None),
        ("", tx.token_estimate, 0),
        ("abcd", tx.token_estimate, 2),
        ("甲。乙", tx.first_sentence, "甲"),
        ("&lt;a&amp;quot;", tx.unescape, '<a"'),
        ("see https://a.b/c) now", tx.first_url, "https://a.b/c"),
    ],
)
def test_text_functions(spark, value, column, wanted):
    assert one(spark, value, column) == wanted


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("", [""]),
        (None, [""]),
        (" a\n\nb\t", ["a\n\nb"]),  # fits as it is
        ("xxxxxxxxxx\n\nyyyyyyyyy\nz", ["xxxxxxxxxx\nyyyyyyyyy", "z"]),  # 20 and the next line feed
        ("x" * 25 + "\ny\n \t\r\nz", ["x" * 25, "y\nz"]),
        ("a\n" + "x" * 25 + "\nb", ["a", "x" * 25, "b"]),
        ("x" * 30, ["x" * 30]),
    ],
)
def test_packed_paragraphs(spark, text, wanted):
    assert one(spark, text, lambda c: tx.packed_paragraphs(c, 20)) == wanted


def test_arbitration_has_all_outcomes(spark):
    rows = [(True, "", 0, 0, False), (False, "hallucination", 3, 1, True), (False, "norm_case_conflict", 0, 1, True), (False, "evidence_insufficient", 0, 1, True), (False, "evidence_insufficient", 0, 0, True), (False, "hallucination", 1, 0, False), (False, "other", 0, 0, False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p boolean, r string, n int, b int, c boolean")
    out = [x["o"] for x in df.select("i", evidence.route(F.col("p"), F.col("r"), F.col("n"), F.col("b"), F.col("c")).alias("o")).orderBy("i").collect()]
    assert out == ["training_agent"] * 3 + ["evidence_subgraph", "training_agent", "authoring_subgraph", "training_agent"]


def test_fuse_orders_ties(spark):
    routes = spark.createDataFrame([(1, 0, 1, 10), (1, 0, 2, 20), (1, 1, 1, 20), (1, 1, 2, 10)], "request int, route int, rank int, item int")
    assert [r["item"] for r in retrieval.fuse(routes, 5).orderBy("rank").collect()] == [10, 20]


def test_rerank_takes_thirty_of_all_routes_and_the_best_query(spark):
    words = [(1, 0, n, n) for n in range(1, 21)]
    routes = spark.createDataFrame(words + [(1, 1, n, 100 + n) for n in range(1, 21)], "request int, route int, rank int, item int")
    texts = spark.createDataFrame([(i, ["x"]) for n in range(1, 21) for i in (n, 100 + n) if i not in (15, 114)] + [(15, ["a", "b"]), (114, ["c", "d"])], "item int, terms array<string>")
    queries = spark.createDataFrame([(1, ["a", "b", "e"]), (1, ["c", "d"])], "request int, asked array<string>")
    got = retrieval.rerank_fused(routes, texts, queries, F.size(F.array_intersect("terms", "asked")) / F.size("asked"), 3)
    assert [r["item"] for r in got.orderBy("rank").collect()] == [114, 15, 1]  # fused ranks 28, 29 and 1


def test_wilcoxon_p(spark):
    """p by all signs of the ranks where they are few, by the normal distribution with ties."""
    groups = {"few": [3, -1, 7, 12, -5, 9, 2, 15], "ties": [1, 1, -1, 2, 2, 2, -3, 0, 4, 5], "none": [0, 0]}
    df = spark.createDataFrame([(g, d) for g, ds in groups.items() for d in ds], "g string, d long")
    got = {r["g"]: r for r in evaluation.wilcoxon(df, ["g"], F.col("d")).collect()}
    sums = [sum(r for r, up in zip(range(1, 9), signs) if up) for signs in itertools.product((0, 1), repeat=8)]
    assert (got["few"]["n"], got["few"]["w"]) == (8, 5.0)  # ranks 1 and 4
    assert got["few"]["p"] == pytest.approx(2 * sum(s <= 5 for s in sums) / 2**8)
    # ranks 2 2 2, 5 5 5, 7, 8, 9; minus 2 + 7; ties 24 + 24
    assert (got["ties"]["n"], got["ties"]["w"]) == (9, 9.0)
    assert got["ties"]["p"] == pytest.approx(2 * statistics.NormalDist().cdf((9 - 22.5) / (9 * 10 * 19 / 24 - 48 / 48) ** 0.5))
    assert (got["none"]["n"], got["none"]["w"], got["none"]["p"]) == (0, 0.0, 1.0)


def test_generation_metrics_of_a_run(spark):
    kinds = "run int, variant string, cited_refs array<string>, cited_norms array<string>, cited_cases array<string>, links array<string>, norms array<string>, cases array<string>, hazards array<string>, gold_refs array<string>, gold_cases array<string>, gold_hazards array<string>"
    n, t, c = "norm::A::article::1", "norm::A::term::2", "case::k::cause"
    full = (["A:1", "A:1", "A:9"], [n, t, t, "norm::B::article::1"], [c], ["k", "", None, "k"], [n, t, c], [c, "case::m::x"], ["h"], ["A:1", "A:2"], ["k", "m", "o"], ["h", "i"])
    df = spark.createDataFrame([(1, "proposed", *full), (2, "optimized", *full), (3, "proposed", *[None] * 10)], kinds)
    got = [tuple(r)[1:] for r in evaluation.generation(df).orderBy("run").collect()]
    wanted = (0.666667, 0.8, 0.2, 0.5, 0.333333, 0.5, 0.666667)
    assert got == [(*wanted, 0.5), (*wanted, 0.0), (0.0,) * 8]


def test_holm_and_references(spark):
    rows = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", None)], "fam string, k string, p double")
    assert [(r["k"], r["p_holm"]) for r in evaluation.holm(rows, ["fam"], "p", "k").orderBy("k").collect()] == [("a", 0.02), ("b", 0.04), ("c", None)]
    refs = one(spark, "GB1 3.0.1, 3.0.2 GB2", lambda c: evidence.references(c, "GB[0-9]"))
    assert refs == ["GB1:3.0.1", "GB1:3.0.2", "GB2"]


def test_bootstrap_draws_as_often_as_the_reference(spark):
    values = {"a": [float(i % 37) for i in range(400)], "b": [5.0], "c": [0.1 * i for i in range(100)]}
    df = spark.createDataFrame([(i, g, v) for g, vs in values.items() for i, v in enumerate(vs)], "k int, g string, v double")
    got = {r["g"]: r for r in evaluation.bootstrap(df, "g", "v").collect()}
    again = {r["g"]: r for r in evaluation.bootstrap(df.repartition(3, "k"), "g", "v").collect()}
    assert (got["a"]["draws"], got["b"]["low"], got["b"]["high"]) == (10_000, 5.0, 5.0)
    for g in "ac":
        x = np.array(values[g])
        means = x[np.random.default_rng(1).integers(0, len(x), (10_000, len(x)))].mean(1)
        half = (np.quantile(means, 0.975) - np.quantile(means, 0.025)) / 2
        for name, q in (("low", 0.025), ("high", 0.975)):
            assert abs(got[g][name] - np.quantile(means, q)) < 0.06 * half
            assert got[g][name] == pytest.approx(again[g][name], rel=1e-12)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert curation.drop_repeated_lines(none).count() == 0
    items = none.withColumnRenamed("doc_id", "item")
    assert retrieval.bm25(items, none.withColumnRenamed("doc_id", "request"), tx.tokens).count() == 0


def test_case_file(spark, tmp_path):
    (tmp_path / "cases.md").write_text("# x\n### 案例 1：甲\n- **地点**：北京\n续\n- **原因**：失稳\n---\n### 案例 2：乙\n- **地点**：上海\n", encoding="utf-8")
    rows = files.read_cases(spark, str(tmp_path / "cases.md")).orderBy("number").collect()
    assert [(r["number"], r["title"], r["fields"]) for r in rows] == [(1, "甲", {"地点": "北京\n续", "原因": "失稳"}), (2, "乙", {"地点": "上海"})]


def test_streaming_counts_match_batch(spark, tmp_path):
    from gristmill.streaming import ingest

    spark.read.parquet(f"{SF}/events.parquet").write.parquet(str(tmp_path / "e"))
    stream = ingest.event_stream(spark, str(tmp_path / "e"), "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    q = ingest.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM counts").first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()
