"""A benchmark of tasks and variants that goes on after errors and can be resumed.

Each pair of task and variant is one row of the runs, which are only appended to. A pair
whose variant fails is a row with an error; the others are whole. A second call runs
the pairs that are not there, so an interrupted benchmark repeats nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.sources import versions

#: From tasks to task_id, output (a text, as JSON) and, if it tells failures itself, error.
Variant = Callable[[DataFrame], DataFrame]
RUNS = "task_id string, variant string, output string, error string"
#: Characters of an error's message that are kept.
MESSAGE = 500


def by_task(run: Callable[[dict], str], columns: list[str]) -> Variant:
    """A variant that calls a function of one task's columns; what it raises is that task's error alone."""

    def variant(tasks: DataFrame) -> DataFrame:
        def each(parts):
            for part in parts:
                out = []
                for row in part.to_dict("records"):
                    try:
                        out.append((row["task_id"], run(row), None))
                    except Exception as e:  # noqa: BLE001  this task's error
                        out.append((row["task_id"], None, f"{type(e).__name__}: {e}"[:MESSAGE]))
                yield pd.DataFrame(out, columns=["task_id", "output", "error"])

        return tasks.select(*dict.fromkeys(["task_id", *columns])).mapInPandas(each, "task_id string, output string, error string")

    return variant


def runs(spark: SparkSession, path: str) -> DataFrame:
    """task_id, variant, output, error of all pairs that have run."""
    content = versions.latest(spark, path)
    parts = content["parts"] if content else []
    return spark.read.schema(RUNS).parquet(*[f"{path}/{p}" for p in parts]) if parts else spark.createDataFrame([], RUNS)


def run(tasks: DataFrame, variants: Mapping[str, Variant], path: str, retry_errors: bool = False) -> DataFrame:
    """All runs after those that were missing; tasks: task_id (text, not null) and what the variants read; repeated ids count once.

    A variant is one job; what it wrote counts only as a whole, so a lost driver leaves no
    halves. A variant that raises, or whose result lacks a task, gives rows with an error.
    With retry_errors, pairs that failed are run again, and their later row is the one that counts.
    """
    spark = tasks.sparkSession
    one = tasks.where("task_id is not null").dropDuplicates(["task_id"])
    for name, variant in variants.items():
        before = latest_runs(spark, path).where(F.col("variant") == name)
        done = (before.where("error is null") if retry_errors else before).select("task_id")
        open_ = one.join(done, "task_id", "left_anti")
        if open_.isEmpty():
            continue
        part = f"parts/{uuid.uuid4().hex}"
        try:
            got = variant(open_)
            got = got if "error" in got.columns else got.withColumn("error", F.lit(None).cast("string"))
            got = got.groupBy(F.col("task_id").cast("string").alias("task_id")).agg(F.first("output").cast("string").alias("output"), F.first("error").cast("string").alias("error"), F.lit(True).alias("_there"))
            rows = open_.select("task_id").join(got, "task_id", "left")
            missing = F.when(F.col("_there").isNull(), "no result")
            rows.select("task_id", F.lit(name).alias("variant"), "output", F.coalesce("error", missing).alias("error")).write.parquet(f"{path}/{part}")
        except Exception as e:  # noqa: BLE001  the variant's tasks get it, the other variants go on
            versions.delete(spark, f"{path}/{part}")
            message = e.getMessage() if isinstance(e, PySparkException) else str(e)
            said = f"{type(e).__name__}: {message}"[:MESSAGE]
            open_.select("task_id", F.lit(name).alias("variant"), F.lit(None).cast("string").alias("output"), F.lit(said).alias("error")).write.parquet(f"{path}/{part}")
        content = versions.latest(spark, path) or {"parts": []}
        versions.commit(spark, path, content | {"parts": [*content["parts"], part]})
    return latest_runs(spark, path)


def latest_runs(spark: SparkSession, path: str) -> DataFrame:
    """One row of each pair: a run that succeeded before one that failed."""
    order = F.struct(F.col("error").isNull().alias("ok"), "output", "error")
    best = runs(spark, path).groupBy("task_id", "variant").agg(F.max(order).alias("r"))
    return best.select("task_id", "variant", "r.output", "r.error")


def scored(found: DataFrame, tasks: DataFrame, metrics: Callable[[DataFrame], DataFrame], schema: T.StructType | str) -> DataFrame:
    """Metrics of the runs that succeeded and whose task is known; output is read by the schema."""
    ok = found.where("error is null").withColumn("result", F.from_json("output", schema))
    return metrics(ok.join(tasks, "task_id"))


def breakdown(scores: DataFrame, metrics: list[str], by: tuple[str, ...] = ("variant", "theme", "tier")) -> DataFrame:
    """Means and numbers of rows by every combination of the columns; level is the grouping id, so that a total is told from a null value.

    The first column's bit is the highest: a bit is 1 where its column is left out.
    """
    return scores.cube(*by).agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in metrics])
