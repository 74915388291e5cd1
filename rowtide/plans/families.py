"""Feature families as tables: built where they are absent or out of date, scored, and their best features selected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.functions import vocab
from rowtide.operators import features, sampling, scoring
from rowtide.sources import tables

Built = dict[tuple[str, str], DataFrame]


def build(spark: SparkSession, where: tables.Folders, families, force=()) -> Built:
    """(family, part) -> table, built where it is absent or out of date. ``force``: families to build anew, or True for all."""
    out = {}
    for part in ("train", "test"):
        path = f"{where.data}/{part}_data.parquet"
        history, source = tables.read_history(spark, path), tables.mark(spark, path)
        for family in families:
            make = features.FAMILIES[family]
            to, said = f"{where.work}/{family}_{part}.parquet", f"{family}:{source}:{','.join(history.columns)}"
            anew = force if isinstance(force, bool) else family in force
            out[family, part] = tables.build_table(spark, to, said, lambda make=make, history=history: tables.as_float(make(history)), anew)
    return out


def scores(spark: SparkSession, where: tables.Folders, name: str, built: Built, target: DataFrame, families, population: bool = True, force: bool = False) -> DataFrame:
    """(family, feature, score): effect sizes on the training entities, kept beside the tables until those or the labels change."""
    sources = [f"{f}={tables.mark(spark, f'{where.work}/{f}_train.parquet')}" for f in families]
    said = ",".join([*sources, str(population), tables.mark(spark, f"{where.data}/train_target.csv")])

    def score() -> DataFrame:
        return reduce(DataFrame.unionByName, (scoring.effect_sizes(scoring.attach_target(built[f, "train"], target), population, f) for f in families))

    return tables.build_table(spark, f"{where.work}/{name}.parquet", said, score, force)


def best(scored: DataFrame, families: dict[str, int], joint: int | None = None) -> dict[str, list[str]]:
    """Family -> its best features, best first; of ``joint``, that many are the best of all families together."""
    if joint is None:
        top = scoring.top_by_family(scored, families)
    else:
        kept = (F.col("family") == "basic") & F.col("feature").isin(*vocab.MUST_KEEP)
        top = scoring.ranked(scored).where((F.col("place") <= joint) | kept)
    chosen: dict[str, list[str]] = {f: [] for f in families}
    for r in top.orderBy("family", "place").collect():  # a few hundred names
        chosen[r.family].append(r.feature)
    return chosen


def matrices(built: Built, chosen: dict[str, list[str]]) -> dict[str, DataFrame]:
    """Part -> id and the chosen features of all families; fails if the test tables lack one."""
    used = [f for f in chosen if chosen[f]]
    lacking = {f: x for f in used if (x := sorted(set(chosen[f]) - set(built[f, "test"].columns)))}
    if lacking:
        raise ValueError(f"the test tables lack {lacking}")
    return {part: sampling.join_families({f: built[f, part].select("id", *chosen[f]) for f in used}) for part in ("train", "test")}
