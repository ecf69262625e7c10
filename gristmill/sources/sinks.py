"""Writers of indexes, results and reports, and the guards around them."""

from __future__ import annotations

import json
import math
import os
import platform
import subprocess
import sys
from collections.abc import Mapping, Sequence
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def index_rows(chunks: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """What an index holds of chunks: all columns, tags never null, the vector, and the chunk itself as JSON without null fields.

    vectors: chunk_id, vector.
    """
    whole = chunks.withColumn("_json", F.to_json(F.struct(*[F.col(f"`{c}`") for c in chunks.columns])))
    tags = [c for c in ("scenario_tags", "hazard_tags") if c in chunks.columns]
    whole = whole.withColumns({c: F.coalesce(F.col(c), F.array().cast(chunks.schema[c].dataType)) for c in tags})
    return whole if vectors is None else whole.join(vectors.select("chunk_id", F.col("vector").alias("text_vector")), "chunk_id", "left")


def chunks_of(index: DataFrame, schema: T.StructType) -> DataFrame:
    """The chunks as they went into an index."""
    return index.select(F.from_json("_json", schema).alias("c")).select("c.*")


def rebuild_index(chunks: DataFrame, path: str, vectors: DataFrame | None = None) -> int:
    """Writes an index anew, one row of each chunk_id (the smallest by its JSON), and checks that all came in; the number of rows."""
    rows = index_rows(chunks, vectors)
    one = rows.groupBy("chunk_id").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), "_json").alias("r")).select("r.*")
    one.write.mode("overwrite").parquet(path)
    return guarded(chunks, chunks.sparkSession.read.parquet(path))


def guarded(chunks: DataFrame, index: DataFrame) -> int:
    """The number of rows of an index; an error if it is empty or not that of the distinct chunk ids."""
    wanted, got = chunks.agg(F.countDistinct("chunk_id")).first()[0], index.count()
    if not wanted:
        raise ValueError("no chunks to index")
    if wanted != got:
        raise RuntimeError(f"the index holds {got} rows of {wanted} chunks")
    return got


def vector_metadata(chunks: DataFrame, columns: Sequence[str]) -> DataFrame:
    """chunk_id, text and a map of plain texts: arrays joined by commas, nulls empty."""
    plain = lambda c: F.array_join(c, ",") if chunks.schema[c].dataType.typeName() == "array" else F.col(c).cast("string")
    entries = [x for c in columns for x in (F.lit(c), F.coalesce(plain(c), F.lit("")))]
    return chunks.select("chunk_id", "text", F.create_map(*entries).alias("metadata"))


def finite(rows: DataFrame) -> DataFrame:
    """Rows whose NaN and infinite numbers are null."""
    bad = lambda c: F.col(c).isin(math.inf, -math.inf) | F.isnan(c)
    return rows.select(*[F.when(~bad(f.name), F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f"`{f.name}`") for f in rows.schema])


def write_results(rows: DataFrame, path: str, summary: DataFrame | None = None, metadata: Mapping | None = None) -> None:
    """rows as CSV with a header and as JSON (NaN as null), the summary and the metadata as JSON, in folders of `path`."""
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f"`{f.name}`") for f in rows.schema]
    rows.select(*flat).write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    finite(rows).write.mode("overwrite").json(f"{path}/json", ignoreNullFields=False)
    if summary is not None:
        finite(summary).coalesce(1).write.mode("overwrite").json(f"{path}/summary", ignoreNullFields=False)
    if metadata is not None:
        rows.sparkSession.createDataFrame([(json.dumps(metadata, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def append_rows(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines behind those that are there."""
    rows.write.mode("append").json(path, ignoreNullFields=True)


def state_json(rows: DataFrame) -> DataFrame:
    """Each row as one JSON text; binary columns as hex."""
    shown = [F.hex(f.name).alias(f.name) if isinstance(f.dataType, T.BinaryType) else F.col(f"`{f.name}`") for f in rows.schema]
    return rows.select(F.to_json(F.struct(*shown)).alias("state"))


def domain(url: Column) -> Column:
    """The host of an address and its port; of one without scheme, what stands before the first slash."""
    return F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).otherwise(F.regexp_extract(url, r"^([^/]*)", 1))


def run_metadata(spark: SparkSession, run_kind: str, inputs: Sequence[str], settings: Sequence[str] = (), variants: Sequence[str] = ()) -> dict:
    """What a run is to be known by: time, command, sha256 of its inputs (by executors), commit, versions, and the named settings alone."""
    hashes = {p: None for p in inputs}
    for p in inputs:
        try:
            rows = spark.read.format("binaryFile").load(p).select("path", F.sha2("content", 256).alias("h")).orderBy("path").collect()  # files named by the caller
            hashes[p] = rows[0]["h"] if len(rows) == 1 else {r["path"]: r["h"] for r in rows} or None
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
    try:
        commit = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, check=True).stdout.strip()
    except (OSError, subprocess.CalledProcessError):
        commit = "unknown"
    return {
        "run_kind": run_kind,
        "created_at_utc": datetime.now(UTC).isoformat(),
        "command": sys.argv,
        "inputs": hashes,
        "variants": list(variants),
        "git_commit": commit,
        "python": platform.python_version(),
        "spark": spark.version,
        "platform": platform.platform(),
        "settings": {k: os.environ[k] for k in settings if k in os.environ},
    }
