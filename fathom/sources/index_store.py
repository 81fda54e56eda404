"""Durable indexes: write once and reuse, upsert by id, load again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Paths of the intermediate tables written so far; the last list is that of the innermost scope().
_written: list[list[str]] = [[]]
_local: list[str] = []


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """The index at `path`, or None if there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def build_or_load(spark: SparkSession, path: str, build: Callable[[], DataFrame], rebuild: bool = False, partition_by: str | None = None) -> DataFrame:
    """Reads the index, or builds and writes it first if it is missing or `rebuild` is set."""
    found = None if rebuild else load(spark, path)
    if found is not None:
        return found
    writer = build().write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.parquet(path)


def latest(points: DataFrame, key: str, version: str) -> DataFrame:
    """The last version of each key (an upsert log read as a table); ties by all columns."""
    order = Window.partitionBy(key).orderBy(F.desc(version), *[F.desc(c) for c in points.columns if c not in (key, version) and not dict(points.dtypes)[c].startswith("map")])
    return points.withColumn("rk__", F.row_number().over(order)).where("rk__ = 1").drop("rk__")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local master, whose tasks run on this machine, may leave it unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="fathom-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return _local[0]


def stored(df: DataFrame, parts: int | None = None) -> DataFrame:
    """`df` written to the shared folder and read again: the lineage ends here, and losing an executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fathom-{uuid.uuid4().hex}"
    (df.coalesce(parts) if parts else df).write.parquet(path)
    _written[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> int:
    jvm, n = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, 0
    while paths:
        path = jvm(paths.pop())
        n += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


@contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Inside, keep(df) stores a result that outlives the block; all other tables stored in the block are deleted at its end."""
    _written.append([])

    def keep(df: DataFrame) -> DataFrame:
        out = stored(df)
        _written[-2].append(_written[-1].pop())
        return out

    try:
        yield keep
    finally:
        _delete(spark, _written.pop())


def forget(spark: SparkSession) -> int:
    """Deletes all intermediate tables of this process; call it when results are written."""
    return _delete(spark, _written[-1])
