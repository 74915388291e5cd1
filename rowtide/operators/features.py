"""The four feature families, each one aggregation by entity (and one over its latest rows); extra and distribution are tallies.

A history has ``id``, ``rn`` (event order, the greatest is the latest) and coded columns. Rows without an id are left out.
All-history features are one hash aggregation, partial before its shuffle, so an entity with very many rows is no burden on
one task; features of the latest rows keep the last few of each entity before their shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowtide.functions import scalar, vocab
from rowtide.operators import tallies


#: Rows of an entity, as SQL: what shares are shares of.
ROWS = "count(1)"


def counts(buckets: dict[str, Iterable[int]], prefix: str, of: str | None = None) -> list[Column]:
    """Rows with each code of each column, or their share of ``of`` (SQL); codes that are not listed count nowhere.

    Wide families are made of SQL strings: hundreds of expressions are parsed within a second, where as many Python objects take
    the driver half a minute.
    """
    return [_counted(f"`{c}` = {v}", f"{prefix}_{c}_{v}", of) for c, codes in buckets.items() for v in codes]


def _counted(test: str, name: str, of: str | None) -> Column:
    n = f"count_if({test})"
    return F.expr(f"CAST({n} AS DOUBLE) AS `{name}`" if of is None else f"{n} / {of} AS `{name}`")


def cross_counts(crosses: dict[str, tuple[str, int, str, int]], prefix: str, of: str | None = None) -> list[Column]:
    """Rows with each pair of codes (left * 10 + right), or their share of ``of`` (SQL)."""
    out = []
    for name, (left, n_left, right, n_right) in crosses.items():
        code = f"CAST(`{left}` AS INT) * 10 + CAST(`{right}` AS INT)"
        out += [_counted(f"{code} = {v}", f"{prefix}_{name}_{v}", of) for v in (a * 10 + b for a in range(n_left) for b in range(n_right))]
    return out


_STATS = {
    "mean": "avg({c})", "max": "max({c})", "min": "min({c})", "std": "stddev_samp({c})", "sum": "sum({c})",
    "last": "max_by({c}, CASE WHEN {c} IS NOT NULL THEN rn END)",
}


def column_stats(columns: Iterable[str], stats: Iterable[str] = ("mean", "max", "std", "last"), prefix: str = "") -> list[Column]:
    """Statistics over an entity's rows that skip nulls (``last``: the latest non-null); without a value, 0."""
    return [F.expr(f"coalesce(CAST({_STATS[s].format(c=f'`{c}`')} AS DOUBLE), 0D) AS `{prefix}{c}_{s}`") for c in columns for s in stats]


#: Statistics of twelve columns (mean, max, std, last): they buffer 96 values.
STATS_AT_ONCE = 48


def _value(x: Column) -> Column:
    return F.coalesce(x.cast("double"), F.lit(0.0))


def payment_counts() -> list[Column]:
    """Payment statuses over all months and the latest six, and their summary; a null status is not zero."""
    out = [F.sum(scalar.count_of(vocab.PAYMENTS, _is(v))).cast("double").alias(f"paym_status_{v}_count") for v in range(5)]
    out += [F.sum(scalar.count_of(vocab.PAYMENTS[:6], _is(v))).cast("double").alias(f"paym_recent_status_{v}_count") for v in range(5)]
    return out


def payment_summary() -> list[Column]:
    nonzero = scalar.count_of(vocab.PAYMENTS, lambda c: ~c.eqNullSafe(F.lit(0)))
    return [
        F.sum(nonzero).cast("double").alias("paym_nonzero_count"),
        _value(F.avg(scalar.row_mean(vocab.PAYMENTS))).alias("paym_mean_all"),
        _value(F.max(scalar.row_max(vocab.PAYMENTS))).alias("paym_max_all"),
    ]


def _is(v: int):
    return lambda c: c == v


def payment_measures(history: DataFrame) -> DataFrame:
    """``history`` with the fourteen payment measures of each row."""
    every, recent, old = vocab.PAYMENTS, vocab.PAYMENTS[:6], vocab.PAYMENTS[19:]
    bad = lambda c: c.isin(1, 2)
    nonzero = lambda c: ~c.eqNullSafe(F.lit(0))
    names = ("zero", "one", "two", "three", "four")
    measures = {f"paym_{n}": scalar.count_of(every, _is(v)) for v, n in enumerate(names)}
    measures |= {
        "paym_nonzero": scalar.count_of(every, nonzero),
        "paym_recent_nonzero": scalar.count_of(recent, nonzero),
        "paym_recent_bad12": scalar.count_of(recent, bad),
        "paym_old_bad12": scalar.count_of(old, bad),
        "paym_max": scalar.row_max(every),
        "paym_mean": scalar.row_mean(every),
        "paym_recent_mean": scalar.row_mean(recent),
        "paym_old_mean": scalar.row_mean(old),
    }
    return history.withColumns(measures).withColumn("paym_trend_recent_minus_old", F.col("paym_recent_mean") - F.col("paym_old_mean"))


MEASURES = [*(f"paym_{x}" for x in ("zero", "one", "two", "three", "four", "nonzero", "recent_nonzero", "recent_bad12", "old_bad12", "max", "mean", "recent_mean", "old_mean", "trend_recent_minus_old"))]


def latest(history: DataFrame, rows: int) -> DataFrame:
    """The last ``rows`` rows of each entity with ``pos``, 0 for the latest. The filter on the row number limits each task's rows
    of an entity before the shuffle."""
    order = Window.partitionBy("id").orderBy(F.col("rn").desc())
    return history.where("id is not null").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= rows).withColumn("pos", F.col("_n") - 1).drop("_n")


def entity_counts(history: DataFrame, name: str = "loan_count") -> DataFrame:
    return history.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).cast("double").alias(name))


def by_entity(history: DataFrame, columns: list[Column], at_once: int | None = None) -> DataFrame:
    """Aggregates of each entity. With ``at_once``, that many in one aggregation, and those joined by id: Spark compiles aggregations of
    up to 100 buffered values as one loop, and wider ones take a multiple of their time a row (see ``STATS_AT_ONCE``)."""
    rows = history.where("id is not null")
    step = at_once or max(1, len(columns))
    parts = [rows.groupBy("id").agg(*columns[k : k + step]) for k in range(0, max(1, len(columns)), step)]
    return reduce(lambda a, b: a.join(b, "id"), parts)


def recent_stats(history: DataFrame, columns: Iterable[str] = vocab.RECENT_COLUMNS, rows: Iterable[int] = vocab.RECENT_ROWS) -> DataFrame:
    """Mean, max and min over the latest k rows."""
    columns, rows = list(columns), list(rows)
    return latest(history.select("id", "rn", *columns), max(rows)).groupBy("id").agg(*_recent_stats(columns, rows))


def _recent_stats(columns: list[str], rows: list[int], held: str = "") -> list[Column]:
    """The statistics as aggregates over rows with ``pos``; ``held``: what the columns' names begin with there."""
    kinds = {"mean": "avg", "max": "max", "min": "min"}
    return [F.expr(f"coalesce(CAST({f}(CASE WHEN pos < {k} THEN `{held}{c}` END) AS DOUBLE), 0D) AS `xrecent{k}_{c}_{s}`") for k in rows for c in columns for s, f in kinds.items()]


def id_norm(column: Column | None = None) -> Column:
    return ((F.col("id") if column is None else column).cast("float") / F.lit(vocab.ID_SCALE).cast("float")).cast("float")


def basic(history: DataFrame) -> DataFrame:
    """469 features: statistics of every column, row count, payment counts, bucket counts, scaled id."""
    columns = [*column_stats(vocab.HISTORY), F.count(F.lit(1)).cast("double").alias("loan_count"), *payment_counts(), *payment_summary(), *counts(vocab.BASIC_BUCKETS, "cnt")]
    return by_entity(history, columns, STATS_AT_ONCE).withColumn("id_norm", id_norm())


def layout(counted: dict[str, list[int]], crosses: dict[str, tuple[str, int, str, int]], measured: list[str], recent: list[str] = (), rows: int = 0, payments: bool = True) -> tallies.Layout:
    """What to count of a history: codes, crosses (after them), moments of columns and (with ``payments``) payment measures, latest rows."""
    pairs = {x: [a * 10 + b for a in range(n) for b in range(m)] for x, (_, n, _, m) in crosses.items()}
    needs = (*(vocab.PAYMENTS if payments else ()), *(c for left, _, right, _ in crosses.values() for c in (left, right)))

    def derive(held: dict[str, tallies.Numbers]) -> dict[str, tallies.Numbers]:
        return (payments_of(held) if payments else {}) | {x: _pair(held[left], held[right]) for x, (left, _, right, _) in crosses.items()}

    return tallies.Layout({**counted, **pairs}, list(measured), list(recent), rows, needs, (*(MEASURES if payments else ()), *crosses), derive)


def _pair(left: tallies.Numbers, right: tallies.Numbers) -> tallies.Numbers:
    """As :func:`scalar.cross_code`."""
    there = [x for x in (left[1], right[1]) if x is not None]
    return left[0].astype(np.int64) * 10 + right[0].astype(np.int64), np.logical_and.reduce(there) if there else None


def payments_of(held: dict[str, tallies.Numbers]) -> dict[str, tallies.Numbers]:
    """The measures of :func:`payment_measures` of a batch's columns: as expressions they are too many for compiled code."""
    x = np.stack([held[c][0].astype(np.float64) for c in vocab.PAYMENTS])
    full = np.ones(x.shape[1], bool)
    there = np.stack([full if held[c][1] is None else held[c][1] for c in vocab.PAYMENTS])
    out = {f"paym_{name}": ((x == v) & there).sum(0) for v, name in enumerate(("zero", "one", "two", "three", "four"))}
    nonzero, bad = ~((x == 0) & there), ((x == 1) | (x == 2)) & there
    out |= {"paym_nonzero": nonzero.sum(0), "paym_recent_nonzero": nonzero[:6].sum(0), "paym_recent_bad12": bad[:6].sum(0), "paym_old_bad12": bad[19:].sum(0)}
    found = {c: (v, None) for c, v in out.items()}
    found["paym_max"] = np.where(there.any(0), np.where(there, x, -np.inf).max(0), 0.0), there.any(0)
    for name, of in (("paym_mean", slice(None)), ("paym_recent_mean", slice(6)), ("paym_old_mean", slice(19, None))):
        n = there[of].sum(0)
        found[name] = np.where(there[of], x[of], 0.0).sum(0) / np.maximum(n, 1), n > 0
    (recent, both), (old, also) = found["paym_recent_mean"], found["paym_old_mean"]
    return found | {"paym_trend_recent_minus_old": (np.where(both & also, recent - old, 0.0), both & also)}


_EXTRA_STATS = ("mean", "max", "std", "sum", "last")


def _extra_names() -> list[str]:
    codes = [f"{c}_{v}" for c, known in vocab.EXTRA_BUCKETS.items() for v in known]
    pairs = [f"xcnt_{x}_{a * 10 + b}" for x, (_, n, _, m) in vocab.EXTRA_CROSSES.items() for a in range(n) for b in range(m)]
    stats = [f"x{c}_{s}" for c in MEASURES for s in _EXTRA_STATS]
    recent = [f"xrecent{k}_{c}_{s}" for k in vocab.RECENT_ROWS for c in vocab.RECENT_COLUMNS for s in ("mean", "max", "min")]
    return [*(f"xcnt_{c}" for c in codes), *(f"xprop_{c}" for c in codes), *stats, *pairs, "xloan_count_check", *recent]


def _listed(parts: list[np.ndarray]) -> list[pa.Array]:
    """Each entity's features, side by side, as one list."""
    every = np.concatenate(parts, 1)
    return [pa.ListArray.from_arrays(pa.array(np.arange(len(every) + 1, dtype=np.int32) * every.shape[1]), pa.array(every.ravel()))]


def _extra_of(found: tallies.Tally, digits: int | None = None) -> list[pa.Array]:
    """The features of :func:`extra` from tallies, in the order of their names; what is not whole is rounded to ``digits``."""
    k, rows, single = len(found.rows), found.rows[:, None].astype(float), sum(map(len, vocab.EXTRA_BUCKETS.values()))
    rounded = (lambda x: x) if digits is None else (lambda x: tallies.half_up(x, digits))
    codes, pairs = found.counts[:, :single].astype(float), found.counts[:, single:].astype(float)
    n, some = np.maximum(found.number, 1), found.number > 0
    stats = (found.sums / n, np.where(some, found.highest, 0.0), np.sqrt(found.squares / np.maximum(found.number - 1, 1)) * (found.number > 1), found.sums, np.where(found.at > tallies.UNKNOWN, found.last, 0.0))
    parts = [codes, rounded(codes / rows), rounded(np.stack(stats, 2).reshape(k, -1)), pairs, rows]
    for last in vocab.RECENT_ROWS:
        x, there = found.latest.data[:, :last], ~np.ma.getmaskarray(found.latest)[:, :last]
        n = there.sum(1)
        ends = (np.where(n > 0, f(np.where(there, x, fill), 1), 0.0) for f, fill in ((np.max, -np.inf), (np.min, np.inf)))
        parts.append(rounded(np.stack((np.where(there, x, 0.0).sum(1) / np.maximum(n, 1), *ends), 2).reshape(k, -1)))
    return _listed(parts)


def _named(made: DataFrame, names: list[str]) -> DataFrame:
    return made.selectExpr("id", *(f"f[{k}] AS `{name}`" for k, name in enumerate(names)))


def extra(history: DataFrame, dealt: bool = False, digits: int | None = None, adjacent: bool = False) -> DataFrame:
    """1066 features: bucket counts and shares, statistics of the latest rows, payment measures, crosses, row count.

    All come from one tally of the rows, made batch by batch. ``dealt``, ``adjacent``: how rows lie, as :func:`tallies.by_entity` has
    it; ``digits``: round to so many.
    """
    wanted = layout({c: list(codes) for c, codes in vocab.EXTRA_BUCKETS.items()}, vocab.EXTRA_CROSSES, MEASURES, vocab.RECENT_COLUMNS, max(vocab.RECENT_ROWS))
    return _named(tallies.by_entity(history, wanted, lambda found: _extra_of(found, digits), "f array<double>", dealt, adjacent), _extra_names())


def sequence(history: DataFrame, columns: Iterable[str] = vocab.HISTORY, rows: int = vocab.SEQUENCE_ROWS, kind: str = "SHORT") -> DataFrame:
    """Value of each column at each of the latest positions, 0..255, 255 for none, as ``kind``, and changes of the last step."""
    columns = list(columns)
    packed = latest(history.select("id", *({"rn", *columns, *(c for c in vocab.DELTAS.values() if c in columns)})), rows)
    rows_of = F.array_sort(F.collect_list(F.struct("pos", *columns)))
    held = packed.groupBy("id").agg(rows_of.alias("h"))
    clipped = lambda x: f"least(greatest({x}, 0), 255)"
    cell = lambda p, c: clipped(f"coalesce(CAST(get(h, {p}).`{c}` AS INT), 255)")
    cells = [f"CAST({cell(p, c)} AS {kind}) AS `seq{p}_{c}`" for p in range(rows) for c in columns]
    steps = [f"CAST({clipped(f'{cell(0, c)} - {cell(1, c)} + 128')} AS {kind}) AS `seq_delta0_1_{n}`" for n, c in vocab.DELTAS.items() if c in columns]
    return held.selectExpr("id", *cells, *steps)


def last_one_hot(buckets: dict[str, Iterable[int]] = vocab.DIST_BUCKETS) -> list[Column]:
    """1 for the code that the very last row has (aggregates over rows with ``pos``); a null there is no code."""
    return [F.expr(f"max(CASE WHEN pos = 0 AND `{c}` = {v} THEN 1D ELSE 0D END) AS `dlast_{c}_{v}`") for c, codes in buckets.items() for v in codes]


def recent_shares(columns: Iterable[str] = vocab.DIST_RECENT, rows: Iterable[int] = vocab.DIST_RECENT_ROWS) -> list[Column]:
    """Share of each code among the latest k rows, or as many as there are (aggregates over rows with ``pos``)."""
    return [_counted(f"pos < {k} AND `{c}` = {v}", f"dr{k}prop_{c}_{v}", f"count_if(pos < {k})") for k in rows for c in columns for v in vocab.DIST_BUCKETS[c]]


def _distribution_names() -> list[str]:
    codes = [f"{c}_{v}" for c, known in vocab.DIST_BUCKETS.items() for v in known]
    pairs = [f"{x}_{a * 10 + b}" for x, (_, n, _, m) in vocab.DIST_CROSSES.items() for a in range(n) for b in range(m)]
    near = [f"dr{k}prop_{c}_{v}" for k in vocab.DIST_RECENT_ROWS for c in vocab.DIST_RECENT for v in vocab.DIST_BUCKETS[c]]
    return [*(f"{p}_{c}" for p in ("d_cnt", "dprop", "dlast") for c in codes), *near, *(f"{p}_{x}" for p in ("dcross", "dcrossprop") for x in pairs)]


def _distribution_of(found: tallies.Tally, digits: int | None = None) -> list[pa.Array]:
    """The features of :func:`distribution` from tallies, in the order of their names; shares are rounded to ``digits``."""
    rows, single = found.rows[:, None].astype(float), sum(map(len, vocab.DIST_BUCKETS.values()))
    rounded = (lambda x: x) if digits is None else (lambda x: tallies.half_up(x, digits))
    codes, pairs = found.counts[:, :single].astype(float), found.counts[:, single:].astype(float)
    place = {c: j for j, c in enumerate(vocab.DIST_BUCKETS)}
    there = ~np.ma.getmaskarray(found.latest)
    has = lambda c, k: [((found.latest.data[:, :k, place[c]] == v) & there[:, :k, place[c]]).sum(1) for v in vocab.DIST_BUCKETS[c]]
    last = np.stack([n for c in vocab.DIST_BUCKETS for n in has(c, 1)], 1).astype(float)
    near = (np.stack([n for c in vocab.DIST_RECENT for n in has(c, k)], 1) / np.minimum(rows, k) for k in vocab.DIST_RECENT_ROWS)
    return _listed([codes, rounded(codes / rows), last, *map(rounded, near), pairs, rounded(pairs / rows)])


def distribution(history: DataFrame, dealt: bool = False, digits: int | None = None, adjacent: bool = False) -> DataFrame:
    """1998 features: counts and shares, last codes, shares among the latest rows, crosses as counts and shares. Made like :func:`extra`."""
    wanted = layout({c: list(codes) for c, codes in vocab.DIST_BUCKETS.items()}, vocab.DIST_CROSSES, [], list(vocab.DIST_BUCKETS), max(vocab.DIST_RECENT_ROWS), payments=False)
    return _named(tallies.by_entity(history, wanted, lambda found: _distribution_of(found, digits), "f array<double>", dealt, adjacent), _distribution_names())


#: Codes of one column in a tall key; all are smaller.
WIDTH = 1000


def _tall(history: DataFrame, codes: dict[str, Column]) -> DataFrame:
    """(id, key, n): rows with each code that occurs. A key is a number, the column's place times ``WIDTH`` and the code."""
    keys = F.array_compact(F.array(*(code.cast("int") + k * WIDTH for k, code in enumerate(codes.values()))))
    return history.where("id is not null").select("id", F.explode(keys).alias("key")).groupBy("id", "key").agg(F.count(F.lit(1)).alias("n"))


def _name_of(codes: dict[str, Column]) -> Column:
    return F.element_at(F.array(*map(F.lit, codes)), F.floor(F.col("key") / WIDTH).cast("int") + 1)


def tall_counts(history: DataFrame, buckets: dict[str, Iterable[int]]) -> DataFrame:
    """(id, column, bucket, n) of the codes that occur, in one aggregation by numbers: where nobody needs the wide form."""
    codes = {c: F.when(F.col(c).isin(*known), F.col(c)) for c, known in buckets.items()}
    return _tall(history, codes).select("id", _name_of(codes).alias("column"), (F.col("key") % WIDTH).alias("bucket"), "n")


def tall_crosses(history: DataFrame, crosses: dict[str, tuple[str, int, str, int]]) -> DataFrame:
    """(id, cross, code, n, share) of the pairs that occur within their vocabularies; an entity's rows are counted in the same pass."""
    codes = {
        name: F.when(F.col(left).between(0, n - 1) & F.col(right).between(0, m - 1), scalar.cross_code(F.col(left), F.col(right)))
        for name, (left, n, right, m) in crosses.items()
    } | {"": F.lit(0)}  # every row
    tall = _tall(history, codes).withColumn("cross", _name_of(codes))
    rows = F.max(F.when(F.col("cross") == "", F.col("n"))).over(Window.partitionBy("id"))
    return tall.withColumn("rows", rows).where("cross <> ''").select("id", "cross", (F.col("key") % WIDTH).alias("code"), "n", (F.col("n") / F.col("rows")).alias("share"))


FAMILIES = {"basic": basic, "extra": extra, "seq": sequence, "dist": distribution}
