"""Readers and writers: histories, targets, samples, feature tables with a fingerprint, submissions, reports."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass
from os import environ

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from rowtide.operators.totals import running_totals

TARGET = StructType([StructField("id", LongType()), StructField("flag", IntegerType())])
SAMPLE = StructType([StructField("id", LongType()), StructField("flag", DoubleType())])


@dataclass(frozen=True)
class Folders:
    """Where inputs, built tables and results lie; any URI that Spark reads."""

    data: str
    work: str
    output: str

    @classmethod
    def from_environment(cls) -> Folders:
        return cls(environ.get("DATA_DIR", "data"), environ.get("WORK_DIR", "work"), environ.get("OUTPUT_DIR", "outputs"))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_target(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TARGET).option("header", True).csv(path)


def read_sample(spark: SparkSession, path: str) -> DataFrame:
    """(ord, id): the sample's ids with their place in the file, which Spark does not keep by itself."""
    # files are read in order; places in the file come from a distributed running total
    lines = spark.read.schema(SAMPLE).option("header", True).csv(path).select("id", F.monotonically_increasing_id().alias("_at"), F.lit(1).alias("_one"))
    return running_totals(lines, [F.col("_at")], {"_before": "_one"}).select((F.col("_before") + 1).cast("long").alias("ord"), "id")


def as_float(table: DataFrame) -> DataFrame:
    """All features as float, the id as long; shorts stay as they are."""
    small = {f.name for f in table.schema.fields if f.dataType.typeName() == "short"}
    return table.select(F.col("id").cast("long").alias("id"), *(F.col(c) if c in small else F.col(c).cast("float").alias(c) for c in table.columns if c != "id"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def mark(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of the files below ``path``: it changes when they do."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files, out = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True), []
    while files.hasNext():
        f = files.next()
        out.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return hashlib.md5("\n".join(sorted(out)).encode()).hexdigest()


def write_table(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("compression", "zstd").parquet(path)


def build_table(spark: SparkSession, path: str, fingerprint: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at ``path``, built if it is not there, was built from something else, or is forced.

    The fingerprint (of input and features) lies beside the table and is written last, so a broken build is built again.
    """
    mark = f"{path}.fingerprint"
    if not force and _exists(spark, mark) and [r.value for r in spark.read.text(mark).collect()] == [fingerprint]:  # one line
        return spark.read.parquet(path)
    write_table(build(), path)
    spark.createDataFrame([(fingerprint,)], "value string").coalesce(1).write.mode("overwrite").text(mark)
    return spark.read.parquet(path)


def write_submission(submitted: DataFrame, path: str, seven_digits: bool = True) -> None:
    """id, flag (with seven digits, or as it is), in the sample's order, as one CSV file with a header."""
    lines = submitted.orderBy("ord").select("id", F.format_string("%.7f", "flag").alias("flag") if seven_digits else "flag")
    lines.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """A small report as JSON, on any file system."""
    spark.createDataFrame([(json.dumps(report, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)
