"""Tables that lie by entity: bucketed and sorted by ``id``, so that what joins or groups by id reads them without an exchange."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rowtide.sources.shared import remove


def write(table: DataFrame, folder: str, buckets: int, dealt: bool = False) -> DataFrame:
    """``table`` (one row for each id) in ``buckets`` files below ``folder``. ``dealt``: its tasks hold one bucket each already, as
    those of a join of two such tables do."""
    name = f"by_id_{uuid.uuid4().hex}"
    lying = table if dealt else table.repartition(buckets, "id")
    lying.write.bucketBy(buckets, "id").sortBy("id").format("parquet").option("path", folder).saveAsTable(name)
    return table.sparkSession.table(name)


def read(spark: SparkSession, folder: str, buckets: int) -> DataFrame:
    """What :func:`write` left, for a session whose catalog does not know it."""
    name = f"by_id_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(folder).schema.fields)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (id) SORTED BY (id) INTO {buckets} BUCKETS LOCATION '{folder}'")
    return spark.table(name)


def delete(spark: SparkSession, folder: str) -> None:
    """Delete the files below ``folder``; a name that a catalog keeps for them reads nothing any more."""
    remove(spark, folder)
