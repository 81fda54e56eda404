"""Loaders of the Parquet tables and of derived relations."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: A search over a table takes as queries the rows whose id is divisible by this.
QUERY_STEP = 100


def reachable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, have]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder."""
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, vec, label of every embedding."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"), "label")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, qvec, qlabel of the query rows."""
    own = vectors(spark, sf_dir).where(F.col("item_id") % QUERY_STEP == 0)
    return own.select(F.col("item_id").alias("query_id"), F.col("vec").alias("qvec"), F.col("label").alias("qlabel"))


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, modificationTime, length, content of the files below a folder (PDFs, images, media)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def file_pages(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """doc, page (from 1), text of text files whose pages are separated by form feeds."""
    files = spark.read.format("text").option("wholetext", "true").option("pathGlobFilter", pattern).load(path).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("doc"), "value")
    return files.select("doc", F.posexplode(F.split("value", "\f")).alias("page", "text")).withColumn("page", F.col("page") + 1)


def data_uri(content: Column, kind: str = "image/png") -> Column:
    """Binary content as base64 text for a model's message."""
    return F.concat(F.lit(f"data:{kind};base64,"), F.base64(content))


def is_remote(path: str) -> bool:
    return "://" in path and not path.startswith("file:") or not os.path.exists(path)
