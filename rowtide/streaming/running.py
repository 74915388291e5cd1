"""Entity features over a growing history: the same counts, kept up by Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.sources.shared import shared_dir

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def running_counts(events: DataFrame, entity: str, column: str, codes: tuple[str, ...]) -> DataFrame:
    """Rows of each entity, and those with each code; on a stream, an update for each batch from the counts so far."""
    return events.groupBy(F.col(entity).alias("id")).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(column) == c).alias(f"n_{c}") for c in codes))


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read ``events`` as a stream until it is used up; the counts of the last batch, from the shared folder."""
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "*.parquet").parquet(_folder(sf_dir))
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(counts: DataFrame, n: int) -> None:
        counts.write.mode("overwrite").parquet(f"{base}/counts")

    # the glob picks this table's files where all tables lie in one folder
    named = stream.withColumn("_file", F.col("_metadata.file_path")).where(F.col("_file").contains("/events.parquet")).drop("_file")
    counts = running_counts(named, "user_id", "event_type", EVENT_TYPES)
    query = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/counts")


def _folder(sf_dir: str) -> str:
    """The folder of the table, whether it is one file or a folder of parts."""
    return f"{sf_dir}/events.parquet*"
