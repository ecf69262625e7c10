"""Readers and writers of chunks, cases, candidates, metrics and raw files."""

from __future__ import annotations

import zipfile
from collections.abc import Callable, Iterable, Iterator, Mapping
from io import BytesIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions import text as tx


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """Rows of a declared schema; strict fails on a bad line, else it lands in _corrupt_record."""
    if strict:
        return spark.read.schema(schema).json(path, mode="FAILFAST")
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])).json(path, mode="PERMISSIVE")


def write_jsonl(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One object a line, nulls left out."""
    rows.write.mode(mode).json(path, ignoreNullFields=True)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """hazard, title, url of a tab-separated list with a header; rows without an address are dropped."""
    return spark.read.csv(path, sep="\t", header=True, schema="hazard string, title string, url string").where(F.coalesce(F.trim("url"), F.lit("")) != "")


def read_metrics(spark: SparkSession, path: str, schema: T.StructType, dataset: str) -> DataFrame:
    """A metrics table with its label; an ablation column makes it of that family."""
    rows = spark.read.csv(path, header=True, schema=schema)
    return rows.withColumns({"dataset": F.lit(dataset), "family": F.lit("ablation" if "ablation" in rows.columns else "variant")})


def read_files(spark: SparkSession, path: str, suffixes: Iterable[str]) -> DataFrame:
    """path, content and what the path tells: folder, name, year."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    wanted = F.lit(False)
    for s in suffixes:
        wanted = wanted | F.lower("path").endswith(s)
    parts = F.split("path", "/")
    return files.where(wanted).select(
        "path", "content", F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("name"), F.nullif(F.regexp_extract("path", r"((?:19|20)\d{2})", 1), F.lit("")).alias("year")
    )


# Names of folders and files that tell what a PDF holds.
PICTURE_FOLDERS = ("_表格", "_图像")
EXPLAINED_FOLDERS = ("表格提取与说明", "图提取与说明")
PICTURE_FILES = ("表", "附录A-图")
SEMANTIC_WORDS = ("说明", "公式", "图")
EXPLANATION_WORDS = ("说明", "补充", "公式", "图、公式")


def existing(spark: SparkSession, paths: Iterable[str]) -> list[str]:
    """Those of some paths that exist, in whatever store they are."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    return [p for p in paths if path(p).getFileSystem(conf).exists(path(p))]


def list_sources(spark: SparkSession, roots: Iterable[str], suffixes: Iterable[str] = (".pdf", ".docx")) -> DataFrame:
    """read_files of all roots that exist, with seq, the place of a file among all by path; no root gives no files."""
    found = existing(spark, roots)
    empty = spark.createDataFrame([], "path string, content binary, folder string, name string, year string")
    files = empty
    for root in found:
        files = files.unionByName(read_files(spark, root, suffixes))
    names = files.select("path").distinct()  # a file list, without contents
    return files.join(names.withColumn("seq", F.row_number().over(Window.orderBy("path"))), "path")


def with_asset(files: DataFrame) -> DataFrame:
    """Files with asset, the path of the first PDF beside a docx; a PDF is its own, other files have none."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    rows = files.withColumn("\u0001dir", folder)
    first = rows.where(F.lower("path").endswith(".pdf")).groupBy("\u0001dir").agg(F.min("path").alias("\u0001pdf"))
    asset = F.when(F.lower("path").endswith(".pdf"), F.col("path")).when(F.lower("path").endswith(".docx"), F.col("\u0001pdf"))
    return rows.join(first, "\u0001dir", "left").withColumn("asset", asset).drop("\u0001dir", "\u0001pdf")


def is_semantic_pdf(path: Column) -> Column:
    """Whether a PDF is to be read for text: none in folders of pictures, explanations alone in those of extracts."""
    parts = F.split(path, "/")
    name, parent = F.element_at(parts, -1), F.coalesce(F.get(parts, F.size(parts) - 2), F.lit(""))
    folder = F.regexp_replace(path, r"/?[^/]*$", "")
    pictures = F.endswith(parent, F.lit(PICTURE_FOLDERS[0])) | F.endswith(parent, F.lit(PICTURE_FOLDERS[1]))
    telling = tx.any_of(name, SEMANTIC_WORDS) & ~(F.startswith(name, F.lit(PICTURE_FILES[0])) | F.startswith(name, F.lit(PICTURE_FILES[1])))
    return ~pictures & F.when(tx.any_of(folder, EXPLAINED_FOLDERS), telling).otherwise(F.lit(True))


def is_explanation_pdf(path: Column) -> Column:
    return tx.any_of(F.element_at(F.split(path, "/"), -1), EXPLANATION_WORDS)


def content_kind(url: Column, content_type: Column) -> Column:
    """pdf, docx or html, by the end of an address or the declared type."""
    u, kind = F.lower(F.coalesce(url, F.lit(""))), F.coalesce(content_type, F.lit(""))
    return F.when(F.endswith(u, F.lit(".pdf")) | F.contains(kind, F.lit("pdf")), "pdf").when(F.endswith(u, F.lit(".docx")) | F.contains(kind, F.lit("word")) | F.contains(kind, F.lit("officedocument")), "docx").otherwise("html")


def harvested(pages: DataFrame, extract: Mapping[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """url, kind and text of fetched pages (url, content_type, content): HTML by Column expressions, docx and what `extract` names by functions; others are empty."""
    extract = {"docx": docx_text, **(extract or {})}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            texts = [extract[kind](c) if kind in extract and c else "" for kind, c in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["url", "kind", "text"])

    rows = pages.select("url", content_kind(F.col("url"), F.col("content_type")).alias("kind"), "content")
    web = rows.where("kind = 'html'").select("url", "kind", tx.html_text(F.decode("content", "UTF-8")).alias("text"))
    return web.unionByName(rows.where("kind <> 'html'").mapInArrow(run, "url string, kind string, text string"))


def read_tasks(spark: SparkSession, path: str, schema: T.StructType, theme: str | None = None, tier: str | None = None, limit: int | None = None) -> DataFrame:
    """Tasks of a theme and a tier (field _meta.tier), the first `limit` by task_id; without a filter, all."""
    rows = read_jsonl(spark, path, schema)
    rows = rows if theme is None else rows.where(F.col("theme") == theme)
    rows = rows if tier is None else rows.where(F.col("_meta.tier") == tier)
    return rows if limit is None else rows.orderBy("task_id").limit(limit)


def extracted(files: DataFrame, sidecars: DataFrame, cache: DataFrame, extract: Callable[[bytes], str] | None = None) -> DataFrame:
    """path and text: a sidecar text wins over the cache, that over the extractor (docx by default; others pluggable)."""
    extract = extract or docx_text

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(c) if c else "" for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["path", "text"])

    known = files.select("path").join(sidecars.select("path", F.col("text").alias("side")), "path", "left").join(cache.select("path", F.col("text").alias("cached")), "path", "left")
    known = known.withColumn("text", F.coalesce("side", "cached"))
    todo = files.join(known.where("text is null").select("path"), "path", "left_semi").select("path", "content")
    return known.where("text is not null").select("path", "text").unionByName(todo.mapInArrow(run, "path string, text string"))


def docx_text(content: bytes) -> str:
    """Text of a docx: tabs and paragraph ends kept, other tags dropped; empty for what is no docx."""
    import re

    try:
        with zipfile.ZipFile(BytesIO(content)) as z:
            xml = z.read("word/document.xml").decode("utf-8", "replace")
    except (zipfile.BadZipFile, KeyError):
        return ""
    xml = re.sub(r"<w:tab\b[^>]*/>", "\t", xml).replace("</w:p>", "\n")
    out = re.sub(r"<[^>]+>", "", xml)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&apos;", "'")):
        out = out.replace(entity, char)
    return out


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """path, number, title and fields (a map) of a Markdown file of cases; lines without a mark continue a field."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    head, field = r"^#{2,4}\s*案例\s*(\d+)\s*[：:]\s*(.+?)\s*$", r"^[-*]\s*\*\*(.+?)\*\*\s*[:：]\s*(.*)$"
    own = Window.partitionBy("path").orderBy("pos")
    rows = files.where("trim(line) not in ('', '---')").withColumn("case", F.sum(F.col("line").rlike(head).cast("int")).over(own)).where("case > 0")
    rows = rows.withColumn("field", F.sum(F.col("line").rlike(field).cast("int")).over(Window.partitionBy("path", "case").orderBy("pos")))
    titles = rows.where(F.col("line").rlike(head)).select("path", "case", F.regexp_extract("line", head, 1).cast("int").alias("number"), F.regexp_extract("line", head, 2).alias("title"))
    parts = rows.where("field > 0").groupBy("path", "case", "field").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("p"))
    first, more = F.col("p")[0]["line"], F.transform(F.slice("p", 2, 1 << 30), lambda x: F.trim(x["line"]))
    value = F.array_join(F.concat(F.array(F.regexp_extract(first, field, 2)), more), "\n")
    pairs = parts.select("path", "case", "field", F.trim(F.regexp_extract(first, field, 1)).alias("k"), F.trim(value).alias("v"))
    pairs = pairs.groupBy("path", "case", "k").agg(F.max_by("v", "field").alias("v")).groupBy("path", "case").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("fields"))
    return titles.join(pairs, ["path", "case"], "left").drop("case")


def read_pages(pages: DataFrame) -> DataFrame:
    """url, cache key and text of fetched pages."""
    return pages.select("url", F.substring(F.sha2("url", 256), 1, 16).alias("cache_key"), tx.html_text(F.col("html")).alias("text"))


def pending(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run has still to do."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")
