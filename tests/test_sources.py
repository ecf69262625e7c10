import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from gristmill.sources import files
from gristmill.streaming import ingest


def docx(text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document><w:p><w:t>{text}</w:t><w:tab/></w:p><w:p>b</w:p></w:document>")
    return out.getvalue()


def test_listing_skips_missing_roots(spark, tmp_path):
    for name in ("a/2010_x/2.docx", "a/2010_x/z.pdf", "a/2010_x/b.pdf", "a/1.pdf", "a/n.txt"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(docx("A &amp; B") if name.endswith("docx") else b"x")
    found = files.with_asset(files.list_sources(spark, [str(tmp_path / "a"), str(tmp_path / "none")])).orderBy("seq").collect()
    assert [(r["seq"], r["name"], r["asset"] and r["asset"].rsplit("/", 1)[1]) for r in found] == [(1, "1.pdf", "1.pdf"), (2, "2.docx", "b.pdf"), (3, "b.pdf", "b.pdf"), (4, "z.pdf", "z.pdf")]
    assert files.list_sources(spark, [str(tmp_path / "none")]).count() == 0


def test_texts_of_files(spark):
    known = spark.createDataFrame([("a", docx("A &amp; B")), ("b", docx("x")), ("c", docx("y")), ("d", b"no zip"), ("e", None)], "path string, content binary")
    side, cache = spark.createDataFrame([("b", "side")], "path string, text string"), spark.createDataFrame([("b", "cached"), ("c", "cached")], "path string, text string")
    assert {r["path"]: r["text"] for r in files.extracted(known, side, cache).collect()} == {"a": "A & B\t\nb\n", "b": "side", "c": "cached", "d": "", "e": ""}


@pytest.mark.parametrize(
    ("path", "semantic", "explanation"),
    [("GB/03_x.pdf", True, False), ("GB/3_表格/a说明.pdf", False, True), ("GB/表格提取与说明/a说明.pdf", True, True), ("GB/表格提取与说明/表1说明.pdf", False, True), ("GB/图提取与说明/附录A-图1.pdf", False, False), ("GB/图提取与说明/其他.pdf", False, False), ("补充.pdf", True, True)],
)
def test_kinds_of_pdfs(spark, path, semantic, explanation):
    row = spark.createDataFrame([(path,)], "p string").select(files.is_semantic_pdf(F.col("p")), files.is_explanation_pdf(F.col("p"))).first()
    assert tuple(row) == (semantic, explanation)


def test_harvest_by_kind(spark):
    rows = [("u/a.PDF", "", b"p"), ("u/b", "application/msword", docx("x")), ("u/c", "text/html", b"<p>hi &amp; you</p>"), ("u/d", None, None)]
    got = {r["url"]: (r["kind"], r["text"]) for r in files.harvested(spark.createDataFrame(rows, "url string, content_type string, content binary"), {"pdf": lambda b: b.decode()}).collect()}
    assert got == {"u/a.PDF": ("pdf", "p"), "u/b": ("docx", "x\t\nb\n"), "u/c": ("html", "hi & you"), "u/d": ("html", "")}


def test_tasks_tables_and_resuming(spark, tmp_path):
    rows = [{"task_id": f"t{i}", "theme": "ab"[i % 2], "_meta": {"tier": "SW"[i // 2 % 2]}} for i in range(8)]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, rows)))
    schema = spark.createDataFrame([], "task_id string, theme string, _meta struct<tier:string>").schema
    read = lambda **k: [r["task_id"] for r in files.read_tasks(spark, str(tmp_path / "t.jsonl"), schema, **k).orderBy("task_id").collect()]
    assert (len(read()), read(theme="a"), read(theme="a", tier="W"), read(tier="S", limit=3)) == (8, ["t0", "t2", "t4", "t6"], ["t2", "t6"], ["t0", "t1", "t4"])
    (tmp_path / "c.tsv").write_text("hazard\ttitle\turl\nh\tt\thttps://a\nh\tu\t \n")
    assert files.read_candidates(spark, str(tmp_path / "c.tsv")).count() == 1
    (tmp_path / "m.csv").write_text("ablation,v\nfull,0.5\n")
    metrics = files.read_metrics(spark, str(tmp_path / "m.csv"), spark.createDataFrame([], "ablation string, v double").schema, "d").first()
    assert (metrics["dataset"], metrics["family"], metrics["v"]) == ("d", "ablation", 0.5)
    out = spark.createDataFrame([(1, None), (2, "é")], "id int, t string")
    files.write_jsonl(out, str(tmp_path / "o"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "o")).collect()) == ['{"id":1}', '{"id":2,"t":"é"}']
    assert sorted(map(tuple, files.read_jsonl(spark, str(tmp_path / "o"), out.schema).collect())) == [(1, None), (2, "é")]
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\n{bad\n')
    assert files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), out.schema, strict=False).cache().where("_corrupt_record is not null").count() == 1
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), out.schema).collect()
    assert [r["id"] for r in files.pending(out, out.where("id = 1"), "id").collect()] == [2]


def test_sessions_and_ingest_once(spark, tmp_path):
    events = [(1, "2024-01-01 00:00:00", 7), (2, "2024-01-01 00:05:00", 7), (2, "2024-01-01 00:05:00", 7), (3, "2024-01-01 03:00:00", 7), (4, "2024-01-01 00:00:00", 8)]
    rows = spark.createDataFrame([(i, t, u, "click", 1.0, "{}") for i, t, u in events], "event_id long, t string, user_id long, event_type string, value double, props string")
    rows.selectExpr("event_id", "timestamp(t) AS ts", "user_id", "event_type", "value", "props").write.parquet(str(tmp_path / "e"))
    stream = ingest.event_stream(spark, str(tmp_path / "e"), "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    q = ingest.sessions(stream).writeStream.outputMode("complete").format("memory").queryName("sessions").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["user_id"], r["n"]) for r in spark.sql("SELECT * FROM sessions").collect()) == [(7, 1), (7, 3), (8, 1)]
    q = ingest.ingest_once(stream, key="event_id").writeStream.outputMode("append").format("memory").queryName("once").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["event_id"] for r in spark.sql("SELECT * FROM once").collect()) == [1, 2, 3, 4]
