"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

Water-filling in closed form: source i with weight w and cap c (``max_epochs`` times its size) is full when the level
reaches c / w. In the order of c / w, a source is clamped while the level that the sources after it would get, (T - sum of
clamped caps) / (sum of weights left), lies above its own; the rest share what is left by weight. That is the fixed point of
clamping and redistributing until nothing is above its cap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowtide.operators.totals import running_totals
from rowtide.sources.shared import cut

#: Words are runs of characters other than these white space ones.
WORD = r"[^\x20\x09-\x0D]+"
#: Sources up to this many are broadcast when copies are made.
MOST_BROADCAST = 100_000


def water_fill(sources: DataFrame, max_epochs: float = 3.0) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target``: shares of the total size by weight, clamped at the cap.

    Null sizes count 0; a source of size 0 gets 0; null or non-positive weights get 0. Totals stay exact in longs while
    ``max_epochs`` is whole. An empty table gives an empty table.
    """
    cap = F.coalesce(F.col("source_size"), F.lit(0)) * F.lit(int(max_epochs) if float(max_epochs).is_integer() else float(max_epochs))
    live = sources.withColumn("_w", F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.lit(0))).withColumn("_cap", F.when(F.col("_w") > 0, cap).otherwise(F.lit(0)))
    live = live.withColumn("_level", F.coalesce(F.try_divide(F.col("_cap").cast("double"), F.col("_w")), F.lit(0.0)))
    ordered = running_totals(live, [F.col("_level"), F.col("source").asc_nulls_last()], {"_caps": "_cap", "_ws": "_w"})
    whole = live.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("_total"), F.coalesce(F.sum("_w"), F.lit(0)).alias("_weights"))
    judged = ordered.crossJoin(F.broadcast(whole))  # one row
    full = F.col("_cap").cast("double") * (F.col("_weights") - F.col("_ws")) <= F.col("_w").cast("double") * (F.col("_total") - F.col("_caps"))
    judged = cut(judged.withColumn("_full", full))
    left = judged.agg(
        F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))), F.lit(0)).alias("_full_caps"),
        F.coalesce(F.sum(F.when(F.col("_full"), F.col("_w"))), F.lit(0)).alias("_full_ws"),
    )
    share = F.try_divide((F.col("_w") * (F.col("_total") - F.col("_full_caps"))).cast("double"), F.col("_weights") - F.col("_full_ws"))
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(F.coalesce(share, F.lit(0.0)))
    return judged.crossJoin(F.broadcast(left)).withColumn("target", target).select(*sources.columns, "target")


def by_code_point(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Give the sources, by code point with null last, the weights in turn."""
    ranked = running_totals(sources.withColumn("_one", F.lit(1)), [F.col("source").asc_nulls_last()], {"_rank": "_one"})
    turn = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    return ranked.withColumn("weight", turn.cast("long")).drop("_one", "_rank")


def _size(size: Column | None) -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long") if size is None else size


def _key(seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def _drawn(docs: DataFrame, size: Column | None, weights: tuple[int, ...], max_epochs: int, seed: str) -> DataFrame:
    """doc_id, source, size, source_size, target, _key, _whole, _more for each row; texts are not carried along."""
    rows = cut(docs.select("doc_id", "source", _size(size).alias("size"), _key(seed).alias("_key")))
    sources = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows")))
    # a source is drawn in about as many windows as a window has rows
    targets = cut(water_fill(by_code_point(sources, weights), max_epochs).withColumn("_windows", F.floor(F.sqrt("_rows")) + 1))
    joined = rows.withColumnRenamed("source", "_s").join(targets, F.col("_s").eqNullSafe(F.col("source"))).drop("_s")
    cell = F.floor(F.conv(F.substring("_key", 1, 6), 16, 10).cast("long") * F.col("_windows") / F.lit(1 << 24))
    joined = joined.withColumn("_cell", cell)
    cells = joined.groupBy("source", "_cell").agg(F.sum("size").alias("_cell_size"))
    before = Window.partitionBy("source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(F.col("source").alias("_cs"), F.col("_cell").alias("_cc"), F.coalesce(F.sum("_cell_size").over(before), F.lit(0)).alias("_cell_from"))
    drawn = joined.join(cells, F.col("source").eqNullSafe(F.col("_cs")) & (F.col("_cell") == F.col("_cc")))
    within = Window.partitionBy("source", "_cell").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_cell_from") + F.coalesce(F.sum("size").over(within), F.lit(0))
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    drawn = drawn.withColumn("_start", start).withColumn("_whole", whole)
    rest = F.col("target") - F.col("_whole") * F.col("source_size")
    return drawn.withColumn("_more", (F.col("size") > 0) & (F.col("_start") + F.col("size") / 2 <= rest))


def mix(docs: DataFrame, size: Column | None = None, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix-1") -> DataFrame:
    """How often the mix takes each row of ``docs`` (doc_id, text, source): doc_id, source, size, source_size, target, copies, taken.

    Every document is taken floor(target / source_size) times; the rest of the target goes to documents in the order of
    md5(seed:doc_id), each of which is taken once more if its middle word still falls into it. A source's words differ from
    its target by half a document at most. Reruns agree, whatever the partitioning.

    Null source is a source of its own, null text has size 0 (taken 0), repeated rows are drawn one by one, other columns are
    left alone, an empty table gives none. A hot source is drawn in many windows.
    """
    drawn = _drawn(docs, size, weights, max_epochs, seed)
    drawn = drawn.withColumn("copies", F.col("_whole") + F.col("_more").cast("long"))
    return drawn.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeat_rows(docs: DataFrame, size: Column | None = None, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix-1") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as :func:`mix` takes it; its columns unchanged.

    What a source takes once more is a beginning of its order, so a row finds its copies from its source's last one taken,
    and texts are not shuffled. Rows that share id and size are taken alike.
    """
    drawn = _drawn(docs, size, weights, max_epochs, seed)
    last = F.max(F.when(F.col("_more"), F.struct("_key", "doc_id", "size")))
    sources = cut(drawn.groupBy("source").agg(F.first("_whole").alias("_whole"), last.alias("_last")).withColumnRenamed("source", "_source"))
    if sources.count() <= MOST_BROADCAST:
        sources = F.broadcast(sources)
    own = F.struct(_key(seed).alias("_key"), F.col("doc_id").alias("doc_id"), _size(size).alias("size"))
    more = F.coalesce((own["size"] > 0) & (own <= F.col("_last")), F.lit(False))
    placed = docs.join(sources, docs["source"].eqNullSafe(sources["_source"]))
    taken = placed.withColumn("_copies", F.col("_whole") + more.cast("long")).where("_copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*docs.columns)
