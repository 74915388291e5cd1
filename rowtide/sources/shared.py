"""The folder that driver and executors share, and tables cut there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a temporary folder in local mode; on a cluster that is an error,
    as no folder of one machine is shared."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rowtide-"))
    return shared_dir(spark)


#: Spark removes the shuffle files of a query when it ends.
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there, so that a lost executor costs no recomputation.

    What was written is all that is read later, so the shuffle files behind it go at once: otherwise they stay until the driver
    happens to collect garbage, and loops of many small shuffles fill the disks.
    """
    spark = df.sparkSession
    shared_dir(spark)
    before = spark.conf.get(_CLEANED)
    spark.conf.set(_CLEANED, "true")
    try:
        # planned under the setting, whatever ``df`` was planned under
        return df.select("*").checkpoint()
    finally:
        spark.conf.set(_CLEANED, before)


#: Tables stored in the scratches that are open, each with its folder; the innermost is last.
_scratches: list[list[tuple[DataFrame, str]]] = []


def stored(df: DataFrame) -> DataFrame:
    """Like :func:`cut`, as Parquet files: a small table's many files are read by few tasks, and its size is known, so that joins with
    it need no exchange. A partitioning by key is not kept. The folder stays, unless a :func:`scratch` is open."""
    spark = df.sparkSession
    folder = new_folder(spark, "stored")
    before = spark.conf.get(_CLEANED)
    spark.conf.set(_CLEANED, "true")
    try:
        df.select("*").write.parquet(folder)
    finally:
        spark.conf.set(_CLEANED, before)
    table = spark.read.schema(df.schema).parquet(folder)
    if _scratches:
        _scratches[-1].append((table, folder))
    return table


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables that are stored within go at its end, but for those that are added to the list it gives."""
    kept: list[DataFrame] = []
    tables: list[tuple[DataFrame, str]] = []
    _scratches.append(tables)
    try:
        yield kept
    finally:
        _scratches.remove(tables)
        for table, folder in tables:
            if not any(table is k for k in kept):
                remove(spark, folder)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that :func:`new_folder` named, on any file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
