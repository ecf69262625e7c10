"""Versions of a stored dataset: a reader sees the newest one as a whole, a writer adds the next.

Files of a version never change. What belongs to it is told by one small JSON file,
written beside its place and moved there. One writer at a time; a second one that wants
the same number gets an error. All goes through Spark's file systems.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def place(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def latest(spark: SparkSession, path: str) -> dict | None:
    """The newest version, None where there is none."""
    folder, fs = place(spark, f"{path}/versions")
    if not fs.exists(folder):
        return None
    names = sorted(f.getPath().getName() for f in fs.listStatus(folder) if f.getPath().getName().endswith(".json"))
    if not names:
        return None
    file, fs = place(spark, f"{path}/versions/{names[-1]}")
    stream = fs.open(file)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, content: dict) -> dict:
    """Makes `content`, numbered, the newest version; an error if another writer came first since content["version"]."""
    content = content | {"version": content.get("version", 0) + 1}
    file, fs = place(spark, f"{path}/versions/{content['version']:08d}.json")
    draft, _ = place(spark, f"{path}/versions/.{content['version']:08d}.draft")
    if fs.exists(file):
        raise RuntimeError(f"version {content['version']} of {path} is there already")
    stream = fs.create(draft, True)
    try:
        stream.write(bytearray(json.dumps(content, ensure_ascii=False, sort_keys=True).encode()))
    finally:
        stream.close()
    if not fs.rename(draft, file):
        raise RuntimeError(f"version {content['version']} of {path} could not be written")
    return content


def delete(spark: SparkSession, path: str) -> None:
    folder, fs = place(spark, path)
    fs.delete(folder, True)
