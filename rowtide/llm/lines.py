"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without white space at its ends, A-Z lower-cased; a line counts from a number of code points on. Documents
come in batches of ascending ids. A run is a table of line hashes, bucketed and sorted by hash: a new batch, grouped by hash, is
merge-joined with the runs without moving them. What the runs hold is repeated; the rest is the batch's own run, so every hash
lies in one run. When a level has ``fan`` runs, they are merged to one run of the next level.

Only hashes travel by hash: of a text's lines, the numbers of those that go come back to it. Lines of very many rows meet their
facts by broadcast, so that no task gets all rows of one line. All of it is DataFrame work.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.llm.skew import common
from rowtide.sources.shared import new_folder, remove

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line's hash: two of 64 bits with seeds of their own.
HASH = ("h1", "h2")
#: A document without an id counts as the one with the greatest.
NO_ID = (1 << 63) - 1


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def text_id(text: Column) -> Column:
    """Tells the texts of rows that share a doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_keys(docs: DataFrame, least_chars: int) -> DataFrame:
    """(doc, text_id, pos, h1, h2) of the lines whose key has ``least_chars`` code points at least."""
    held = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), text_id(F.col("text")).alias("text_id"), lines_of(F.col("text")).alias("lines"))
    keyed = held.select("doc", "text_id", F.posexplode("lines").alias("pos", "line")).where(F.length("line") >= least_chars).select("doc", "text_id", "pos", key_of(F.col("line")).alias("key"))
    return keyed.where(F.length("key") >= least_chars).select("doc", "text_id", "pos", F.xxhash64("key").alias(HASH[0]), F.xxhash64(F.lit(1), "key").alias(HASH[1]))


class LineRuns:
    """The runs of all batches so far, as bucketed tables below ``folder``.

    ``fan``: runs of a level that are merged; ``buckets`` of every run (None: the session's shuffle partitions, so that a batch that
    is grouped by hash lies as the runs do). Batches must come in ascending order of ids.
    """

    def __init__(self, spark: SparkSession, folder: str, fan: int = 4, buckets: int | None = None):
        self.spark, self.folder, self.fan = spark, folder, fan
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: dict[int, list[str]] = defaultdict(list)

    def runs(self) -> list[str]:
        return [name for level in sorted(self.levels, reverse=True) for name in self.levels[level]]

    def _write(self, hashes: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        dealt = hashes.select(*HASH).repartition(self.buckets, *HASH)
        dealt.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).format("parquet").option("path", f"{self.folder}/{name}").saveAsTable(name)
        self.levels[level].append(name)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")  # a table with a path of its own: its files stay
        remove(self.spark, f"{self.folder}/{name}")

    def add(self, keys: DataFrame) -> DataFrame:
        """Lines (doc, text_id, pos) of the batch ``keys`` that an earlier document has, written; the batch's own hashes join the runs.

        ``keys`` is a written table: it is read for its hashes and for its lines.
        """
        at = f"{self.folder}/facts-{uuid.uuid4().hex}"
        facts = keys.groupBy(*HASH).agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n"))
        for k, run in enumerate(self.runs()):
            facts = facts.join(self.spark.table(run).select(*HASH, F.lit(True).alias(f"in_{k}")), list(HASH), "left")
        old = reduce(lambda a, b: a | b, (F.col(f"in_{k}").isNotNull() for k in range(len(self.runs()))), F.lit(False))
        facts.select(*HASH, "first", "last", "n", old.alias("old")).write.parquet(at)
        facts = self.spark.read.parquet(at)
        self._write(facts.where(~F.col("old")), 0)
        dropped = self._lines(keys, facts.where("old or first < last"))
        dropped.write.parquet(f"{at}-dropped")
        remove(self.spark, at)
        self._compact()
        return self.spark.read.parquet(f"{at}-dropped")

    def _lines(self, keys: DataFrame, repeated: DataFrame) -> DataFrame:
        """The lines of ``keys`` that go, by the facts of ``repeated`` hashes."""
        some = repeated.select(*HASH, F.when(~F.col("old"), F.col("first")).alias("keeper"), "n")
        often = common(some.withColumn("hash", F.struct(*HASH)), "hash", "n", keys.count()).select("hash.*")
        goes = F.col("keeper").isNull() | (F.col("doc") > F.col("keeper"))
        if often.isEmpty():
            return keys.join(some, list(HASH)).where(goes).select("doc", "text_id", "pos")
        few = F.broadcast(some.join(F.broadcast(often), list(HASH), "left_semi"))
        rest = keys.join(F.broadcast(often), list(HASH), "left_anti")
        return keys.join(few, list(HASH)).unionByName(rest.join(some, list(HASH))).where(goes).select("doc", "text_id", "pos")

    def _compact(self) -> None:
        level = 0
        while len(self.levels[level]) >= self.fan:
            names = self.levels[level]
            self.levels[level] = []
            self._write(reduce(DataFrame.unionByName, (self.spark.table(x).select(*HASH) for x in names)), level + 1)
            for x in names:
                self._drop(x)
            level += 1

    def close(self) -> None:
        """Forget and delete the runs; what :meth:`add` returned stays."""
        for x in self.runs():
            self._drop(x)
        self.levels.clear()


def without(lines: Column, places: Column) -> Column:
    """``lines`` less those at the sorted ``places`` (from 0): the slices between them, in one pass over the array."""
    starts = F.concat(F.array(F.lit(0)), F.transform(places, lambda p: p + 1))
    ends = F.concat(places, F.array(F.size(lines)))
    return F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a)))


def drop_repeated_lines(docs: DataFrame, least_chars: int = 10, batches: int = 4, fan: int = 2) -> DataFrame:
    """``row`` (all columns of ``docs``), ``kept`` (the text without repeated lines), ``n_lines`` and ``n_dropped``.

    A line whose key has ``least_chars`` code points and stands in two documents or more stays only in the smallest doc_id that has
    it, with all its repeats there. Null and empty texts are one empty line, which stays. Rows that share a doc_id are one document
    (repeated rows all stay); rows without one count as the greatest id. A text that loses all lines is empty. An empty table gives
    no rows. ``docs`` needs doc_id (whole numbers) and text; other columns may have any name.

    ``batches``: the documents are dealt to so many by ranges of doc_id; ``fan``: see :class:`LineRuns`.
    """
    spark, folder = docs.sparkSession, new_folder(docs.sparkSession, "lines")
    edges = [x for x in docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000)).first()[0] or []]
    batch = reduce(lambda a, b: a + b, ((F.col("doc") > e).cast("int") for e in sorted(set(edges))), F.lit(0))
    line_keys(docs, least_chars).withColumn("batch", batch).write.partitionBy("batch").parquet(f"{folder}/keys")
    keys = spark.read.schema("doc long, text_id long, pos int, h1 long, h2 long, batch int").parquet(f"{folder}/keys")
    runs = LineRuns(spark, folder, fan)
    dropped = [runs.add(keys.where(F.col("batch") == b).drop("batch")) for b in range(len(set(edges)) + 1)]
    runs.close()
    remove(spark, f"{folder}/keys")
    gone = reduce(DataFrame.unionByName, dropped).groupBy("doc", "text_id").agg(F.array_sort(F.collect_set("pos")).alias("places"))
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), text_id(F.col("text")).alias("text_id"))
    lines = lines_of(F.col("row.text"))
    places = F.coalesce("places", F.array().cast("array<int>"))
    kept = F.when(F.col("places").isNull(), F.coalesce("row.text", F.lit(""))).otherwise(F.array_join(without(lines, places), "\n"))
    return rows.join(gone, ["doc", "text_id"], "left").select("row", kept.alias("kept"), F.size(lines).cast("long").alias("n_lines"), F.size(places).cast("long").alias("n_dropped"))
