"""From raw documents to token ids: toxicity, near duplicates, contamination, personal data, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. What
a stage returns is written as Parquet in the shared checkpoint folder and read again;
then what the one before wrote is deleted.

docs have the columns of documents; an absent one is an error, further ones are dropped.
An empty table gives an empty one. What nulls, empty texts, copies and repeated rows
give is said for each stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.bpe import encode
from gristmill.llm.decontam import decontaminate
from gristmill.llm.jaccard import near_duplicates
from gristmill.llm.pii import find_personal_data
from gristmill.llm.textkit import ensure_checkpoint_dir, read_table
from gristmill.llm.toxicity import score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5; null, empty and wordless texts score 0 and stay, repeated rows stay or go together."""
    return score_toxicity(docs, read_table(spark, sf_dir, "labels"), keep=COLUMNS).where("score < 0.5").select(*COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: that with the smallest id. Rows with that id all stay.

    Null, empty and wordless texts have no links and stay, and so do rows without an id.
    """
    gone = near_duplicates(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark windows do not contaminate; null, empty and wordless texts stay."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"), keep=COLUMNS).where(~F.col("contaminated")).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked and n_chars counted anew; a null text stays null, with 0 characters."""
    masked = find_personal_data(docs, keep=COLUMNS, mask_too=True).withColumn("text", F.col("masked"))
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long"))).select(*COLUMNS)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the text that they decode to; a null text has no tokens."""
    return encode(docs, public_tokenizers.path("word_bpe_49k.json"), keep=("doc_id", "lang", "source"), decode_too=True)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicate), ("decontamination", decontamination), ("personal_data", personal_data), ("bpe", bpe)]

#: SQL expresses neither the toxicity model nor BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table documents."""
    ensure_checkpoint_dir(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    folder = f"{folder}/pipeline-{uuid.uuid4()}"
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            _delete(spark, f"{folder}/{i - 1}")
    return docs


def _delete(spark: SparkSession, folder: str) -> None:
    """Deletes a folder in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
