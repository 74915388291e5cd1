"""Feature families from a mergeable state: one row for each entity, kept up batch by batch instead of built anew.

The state of an entity is bounded, however many rows it has: its number of rows, rows with each code and each pair of codes, moments
of each column (values, sum, squared deviations, greatest, latest), and its latest 14 rows. States of two batches merge by id, in any
order of the batches. Every feature of the four families is an expression over one state, so a family, some columns of it or the
scores of all its features are made without a shuffle and without joining families.

The state lies bucketed by id, a packed row for each entity, made in one pass over a batch. An entity with very many rows is aggregated before
its rows are shuffled.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from rowtide.functions import scalar, vocab
from rowtide.operators import features, scoring, tallies
from rowtide.sources import colocated, tables
from rowtide.sources.shared import remove

#: Columns with moments, and the place of each.
MEASURED = {c: k for k, c in enumerate([*vocab.HISTORY, *features.MEASURES])}
BUCKETS = {c: sorted({*vocab.BASIC_BUCKETS.get(c, ()), *vocab.EXTRA_BUCKETS.get(c, ()), *vocab.DIST_BUCKETS.get(c, ())}) for c in {**vocab.BASIC_BUCKETS, **vocab.EXTRA_BUCKETS, **vocab.DIST_BUCKETS}}
CROSSES = {**vocab.EXTRA_CROSSES, **vocab.DIST_CROSSES}


def _codes(cross: str) -> list[int]:
    _, n, _, m = CROSSES[cross]
    return [a * 10 + b for a in range(n) for b in range(m)]


#: What is counted, (column or cross, code), and the place of each.
COUNTED = {x: k for k, x in enumerate([*((c, v) for c, codes in BUCKETS.items() for v in codes), *((x, v) for x in CROSSES for v in _codes(x))])}


#: Columns of the latest rows, beside rn.
OTHERS = [c for c in vocab.HISTORY if c != "rn"]
#: What is counted, its codes ascending, columns with moments, and the latest rows.
LAYOUT = features.layout(BUCKETS, CROSSES, list(MEASURED), OTHERS, vocab.SEQUENCE_ROWS)
#: An entity's tally of ``LAYOUT`` as it is stored: one binary value, where Parquet writes and reads thousands of nested ones.
PACKED = "state binary"
_CELLS, _MEASURES = (LAYOUT.rows, len(OTHERS)), (len(MEASURED),)
_ROW = np.dtype([
    ("rows", "<i8"), ("counts", "<i8", (len(COUNTED),)), ("number", "<i8", _MEASURES), *((x, "<f8", _MEASURES) for x in ("sums", "squares", "highest")), ("at", "<i8", _MEASURES), ("last", "<f8", _MEASURES),
    ("order", "<i8", _CELLS[:1]), ("latest", "<f8", _CELLS), ("hidden", "u1", (-(-_CELLS[0] * _CELLS[1] // 64) * 8,)),
])
#: Entities that are unpacked at once.
AT_ONCE = 512
#: Types of a column, each wider than those before.
_WIDER = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _pack(found: tallies.Tally) -> list[pa.Array]:
    k = len(found.rows)
    out = np.zeros(k, _ROW)
    for name in _ROW.names[:-2]:
        out[name] = getattr(found, name)
    hidden = np.packbits(np.ma.getmaskarray(found.latest).reshape(k, -1), 1)
    out["latest"], out["hidden"][:, : hidden.shape[1]] = found.latest.data, hidden
    # first bytes of all numbers, then second ones: most are 0. A twelfth of 20 kB is what joins, sorts and files hold of an entity
    planes = memoryview(np.ascontiguousarray(out.view(np.uint8).reshape(k, _ROW.itemsize // 8, 8).transpose(0, 2, 1)).reshape(-1))
    small = pa.Codec("zstd", compression_level=1)
    return [pa.array([small.compress(planes[at : at + _ROW.itemsize], asbytes=True) for at in range(0, k * _ROW.itemsize, _ROW.itemsize)], pa.binary())]


def _unpack(column: pa.Array) -> tallies.Tally:
    k, small = len(column), pa.Codec("zstd", compression_level=1)
    planes = np.empty((k, 8, _ROW.itemsize // 8), np.uint8)
    for i, value in enumerate(column):
        planes[i] = np.frombuffer(small.decompress(value.as_buffer(), _ROW.itemsize), np.uint8).reshape(8, -1)
    x = np.ascontiguousarray(planes.transpose(0, 2, 1)).reshape(k, _ROW.itemsize).view(_ROW)[:, 0]
    hidden = np.unpackbits(x["hidden"], 1, _CELLS[0] * _CELLS[1]).reshape(k, *_CELLS).astype(bool)
    return tallies.Tally(*(x[name].copy() for name in _ROW.names[:-2]), np.ma.MaskedArray(x["latest"].copy(), hidden))


def packed(history: DataFrame, dealt: bool = False, adjacent: bool = False) -> DataFrame:
    """(id, state) of each entity: its rows, how often each of ``COUNTED`` occurs, moments of each of ``MEASURED``, and its latest rows.

    Rows without an id are left out; nulls count in rows alone; codes that are not listed are not counted. ``dealt``,
    ``adjacent``: how rows lie, as :func:`tallies.by_entity` has it.
    """
    return tallies.by_entity(history, LAYOUT, _pack, PACKED, dealt, adjacent)


def _per_state(table: DataFrame, made: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                yield made(batch.slice(at, AT_ONCE))

    return table.mapInArrow(run, f"id {dict(table.dtypes)['id']}, {schema}")


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, state) of both."""

    def made(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, one, other = batch.column("id"), batch.column("state"), batch.column("state_b")
        left, right = (x.is_valid().to_numpy(zero_copy_only=False) for x in (one, other))
        both = left & right
        at = np.flatnonzero(both)
        merged = _pack(_unpack(one.take(pa.array(at))).merged(_unpack(other.take(pa.array(at)))))[0] if len(at) else one.slice(0, 0)
        alone = [x.filter(pa.array(there & ~both)) for x, there in ((one, left), (other, right))]
        of = [ids.filter(pa.array(there)) for there in (both, left & ~both, right & ~both)]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(of), pa.concat_arrays([merged, *alone])], ["id", "state"])

    return _per_state(_both(a, b), made, PACKED)


def _nested(states: DataFrame, kinds: list[str]) -> DataFrame:
    """(id, rows, n, m, tail) of packed states, for SQL; ``tail``: the latest rows, the latest first, rows of one ``rn`` by their other columns."""
    tail = "struct<" + ", ".join(f"{c}: {k}" for c, k in zip(("rn", *OTHERS), kinds, strict=True)) + ">"
    types = [to_arrow_type(f.dataType) for f in StructType.fromDDL(f"tail {tail}")["tail"].dataType.fields]

    def made(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = _unpack(batch.column("state"))
        return pa.RecordBatch.from_arrays([batch.column("id"), *tallies.totals_of(found), _tail_of(found, types)], ["id", "rows", "n", "m", "tail"])

    return _per_state(states, made, f"{tallies.TOTALS}, tail array<{tail}>")


def _tail_of(found: tallies.Tally, types: list[pa.DataType]) -> pa.Array:
    order, latest = tallies.settled(found.order, found.latest)
    there = order != tallies.ABSENT
    rn, rows, hidden = order[there], latest.data[there], np.ma.getmaskarray(latest)[there]
    columns = [pa.array(rn, mask=rn == tallies.UNKNOWN), *(pa.array(rows[:, j], mask=hidden[:, j]) for j in range(len(OTHERS)))]
    whole = pa.StructArray.from_arrays([x.cast(t) for x, t in zip(columns, types, strict=True)], ["rn", *OTHERS])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(there.sum(1))).astype(np.int32)), whole)


def _some(found: tallies.Tally, counted: list[tuple[str, int]], measured: list[str], recent: list[str]) -> tallies.Tally:
    """The part of a tally of ``LAYOUT`` that a family is made of."""
    n, m = [COUNTED[x] for x in counted], [MEASURED[c] for c in measured]
    latest = found.latest[:, :, [OTHERS.index(c) for c in recent]]
    return tallies.Tally(found.rows, found.counts[:, n], *(getattr(found, x)[:, m] for x in ("number", "sums", "squares", "highest", "at", "last")), found.order, latest)


def _codes_of(buckets: dict[str, Iterable[int]], crosses: Iterable[str]) -> list[tuple[str, int]]:
    return [*((c, v) for c, codes in buckets.items() for v in codes), *((x, v) for x in crosses for v in _codes(x))]


def _extra_of(found: tallies.Tally, digits: int | None) -> list[pa.Array]:
    return features._extra_of(_some(found, _codes_of(vocab.EXTRA_BUCKETS, vocab.EXTRA_CROSSES), features.MEASURES, vocab.RECENT_COLUMNS), digits)


def _distribution_of(found: tallies.Tally, digits: int | None) -> list[pa.Array]:
    return features._distribution_of(_some(found, _codes_of(vocab.DIST_BUCKETS, vocab.DIST_CROSSES), [], list(vocab.DIST_BUCKETS)), digits)


#: Families of a thousand columns are made of whole batches: names of the features, and their values from tallies.
_WIDE = {"extra": (features._extra_names, _extra_of), "dist": (features._distribution_names, _distribution_of)}


def _wide_family(states: DataFrame, name: str, digits: int | None) -> DataFrame:
    names, values = _WIDE[name]
    made = lambda batch: pa.RecordBatch.from_arrays([batch.column("id"), *values(_unpack(batch.column("state")), digits)], ["id", "f"])
    return features._named(_per_state(states, made, "f array<double>"), names())


_MOMENTS = """(x, y) -> named_struct('n', x.n + y.n,
    's', CASE WHEN x.n = 0 THEN y.s WHEN y.n = 0 THEN x.s ELSE x.s + y.s END,
    'm2', CASE WHEN x.n = 0 THEN y.m2 WHEN y.n = 0 THEN x.m2 ELSE x.m2 + y.m2 + pow(x.s / x.n - y.s / y.n, 2) * x.n * y.n / (x.n + y.n) END,
    'hi', greatest(x.hi, y.hi), 'at', greatest(x.at, y.at), 'last', CASE WHEN y.at IS NULL OR x.at >= y.at THEN x.last ELSE y.last END)"""


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either state; columns of ``b`` end in ``_b``."""
    named = b.select("id", *(F.col(c).alias(f"{c}_b") for c in b.columns if c != "id"))
    return a.join(named.hint("merge"), "id", "full")


def _of_both(column: str, merged: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN {column}_b WHEN {column}_b IS NULL THEN {column} ELSE {merged} END AS {column}"


def merge_totals(a: DataFrame, b: DataFrame) -> DataFrame:
    return _both(a, b).selectExpr("id", _of_both("rows", "rows + rows_b"), _of_both("n", "zip_with(n, n_b, (x, y) -> x + y)"), _of_both("m", f"zip_with(m, m_b, {_MOMENTS})"))


def merge_tails(a: DataFrame, b: DataFrame, rows: int = vocab.SEQUENCE_ROWS) -> DataFrame:
    return _both(a, b).selectExpr("id", _of_both("tail", f"slice(sort_array(concat(tail, tail_b), false), 1, {rows})"))


# features as SQL over one state


def _stat(c: str, s: str) -> str:
    m = f"m[{MEASURED[c]}]"
    return {
        "mean": f"coalesce({m}.s / nullif({m}.n, 0), 0D)", "max": f"coalesce({m}.hi, 0D)", "sum": f"coalesce({m}.s, 0D)", "last": f"coalesce({m}.last, 0D)",
        "std": f"coalesce(sqrt({m}.m2 / nullif({m}.n - 1, 0)), 0D)",
    }[s]


def _stats(columns: Iterable[str], kinds: Iterable[str], prefix: str = "") -> dict[str, str]:
    return {f"{prefix}{c}_{s}": _stat(c, s) for c in columns for s in kinds}


def _count(x: str, v: int) -> str:
    return f"CAST(n[{COUNTED[x, v]}] AS DOUBLE)"


def _counts(buckets: dict[str, Iterable[int]], prefix: str, share: bool = False) -> dict[str, str]:
    return {f"{prefix}_{x}_{v}": _count(x, v) + (" / rows" if share else "") for x, codes in buckets.items() for v in codes}


def _crossed(crosses: Iterable[str], prefix: str, share: bool = False) -> dict[str, str]:
    return _counts({x: _codes(x) for x in crosses}, prefix, share)


def basic() -> dict[str, str]:
    payments = {f"paym_status_{v}_count": _stat(f"paym_{n}", "sum") for v, n in enumerate(("zero", "one", "two", "three", "four"))}
    payments |= {f"paym_recent_status_{v}_count": " + ".join(_count(c, v) for c in vocab.PAYMENTS[:6]) for v in range(5)}
    payments |= {"paym_nonzero_count": _stat("paym_nonzero", "sum"), "paym_mean_all": _stat("paym_mean", "mean"), "paym_max_all": _stat("paym_max", "max")}
    scaled = {"id_norm": f"CAST(CAST(id AS FLOAT) / CAST({vocab.ID_SCALE} AS FLOAT) AS FLOAT)"}
    return _stats(vocab.HISTORY, ("mean", "max", "std", "last")) | {"loan_count": "CAST(rows AS DOUBLE)"} | payments | _counts(vocab.BASIC_BUCKETS, "cnt") | scaled


def _recent(c: str, k: int, s: str) -> str:
    of = f"slice(tail.`{c}`, 1, {k})"
    found = {"mean": f"aggregate({of}, 0D, (a, x) -> a + coalesce(x, 0)) / nullif(size(array_compact({of})), 0)", "max": f"array_max({of})", "min": f"array_min({of})"}[s]
    return f"coalesce(CAST({found} AS DOUBLE), 0D)"


def extra() -> dict[str, str]:
    out = _counts(vocab.EXTRA_BUCKETS, "xcnt") | _counts(vocab.EXTRA_BUCKETS, "xprop", True) | _stats(features.MEASURES, ("mean", "max", "std", "sum", "last"), "x")
    out |= _crossed(vocab.EXTRA_CROSSES, "xcnt") | {"xloan_count_check": "CAST(rows AS DOUBLE)"}
    return out | {f"xrecent{k}_{c}_{s}": _recent(c, k, s) for k in vocab.RECENT_ROWS for c in vocab.RECENT_COLUMNS for s in ("mean", "max", "min")}


def sequence() -> dict[str, str]:
    clipped = lambda x: f"least(greatest({x}, 0), 255)"
    cell = lambda p, c: clipped(f"coalesce(CAST(get(tail, {p}).`{c}` AS INT), 255)")
    out = {f"seq{p}_{c}": f"CAST({cell(p, c)} AS SHORT)" for p in range(vocab.SEQUENCE_ROWS) for c in vocab.HISTORY}
    return out | {f"seq_delta0_1_{n}": f"CAST({clipped(f'{cell(0, c)} - {cell(1, c)} + 128')} AS SHORT)" for n, c in vocab.DELTAS.items()}


def distribution() -> dict[str, str]:
    out = _counts(vocab.DIST_BUCKETS, "d_cnt") | _counts(vocab.DIST_BUCKETS, "dprop", True)
    out |= {f"dlast_{c}_{v}": f"CASE WHEN get(tail, 0).`{c}` = {v} THEN 1D ELSE 0D END" for c, codes in vocab.DIST_BUCKETS.items() for v in codes}
    for k in vocab.DIST_RECENT_ROWS:
        for c in vocab.DIST_RECENT:
            near = f"slice(tail.`{c}`, 1, {k})"
            out |= {f"dr{k}prop_{c}_{v}": f"(size({near}) - size(array_remove({near}, {v}))) / size({near})" for v in vocab.DIST_BUCKETS[c]}
    return out | _crossed(vocab.DIST_CROSSES, "dcross") | _crossed(vocab.DIST_CROSSES, "dcrossprop", True)


#: Family -> feature -> SQL over a row of the state.
FAMILIES: dict[str, Callable[[], dict[str, str]]] = {"basic": basic, "extra": extra, "seq": sequence, "dist": distribution}


def family_scores(labelled: DataFrame, wanted: dict[str, str], usual: dict[str, float] | None = None, population: bool = True) -> DataFrame:
    """(feature, score) as :func:`scoring.effect_sizes` gives for the wide table, which is never made.

    ``labelled``: states with ``flag``; ``wanted``: SQL of each feature; ``usual``: the value that most entities have, where that is
    not 0. An entity's features are one array, of which only the unusual values are exploded and added up in each task; usual
    values enter by their number. Scores do not change when a feature is shifted.
    """
    names, usual = list(wanted), usual or {}
    values = ", ".join(f"CAST({sql} AS DOUBLE)" + (f" - {usual[f]}D" if usual.get(f) else "") for f, sql in wanted.items())
    # the label goes through the generator: beside one of nested columns, the optimizer loses other columns
    tall = labelled.selectExpr(f"inline(filter(transform(array({values}), (x, k) -> named_struct('k', k, 'flag', flag, 'x', x)), r -> r.x <> 0))")
    parts = tall.groupBy("k").agg(
        F.count(F.lit(1)).alias("some"), F.avg("x").alias("mean"), F.var_pop("x").alias("variance"),
        F.sum(F.when(F.col("flag") == 1, F.col("x"))).alias("s1"), F.sum(F.when(F.col("flag") == 0, F.col("x"))).alias("s0"),
    )
    sizes = labelled.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("flag") == 1).alias("n1"), F.count_if(F.col("flag") == 0).alias("n0"))
    every = labelled.sparkSession.createDataFrame(list(enumerate(names)), "k int, feature string")
    # the features of a family: a few thousand names, and one row of sizes
    joined = every.join(F.broadcast(parts), "k", "left").crossJoin(F.broadcast(sizes))
    part = F.col("some") / F.col("all")
    variance = F.coalesce(F.col("variance") * part + F.col("mean") * F.col("mean") * part * (1 - part), F.lit(0.0))
    apart = F.abs(F.try_divide(F.coalesce("s1", F.lit(0.0)), F.col("n1")) - F.try_divide(F.coalesce("s0", F.lit(0.0)), F.col("n0")))
    spread = F.sqrt(F.greatest(variance, F.lit(scoring.FLOOR))) if population else F.sqrt(F.try_divide(variance * F.col("all"), F.col("all") - 1))
    return joined.select("feature", scalar.safe_number(F.try_divide(apart, spread)).alias("score"))


#: The value of a position that an entity has no row for.
ABSENT = 255.0


class FeatureState:
    """States of all batches so far, below ``folder`` (shared by driver and executors).

    A manifest names the tables of the newest version and its batches. It is written last: a broken merge leaves the version before
    it as it was, and a batch that is in the state already is not added again.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        """``buckets``: of a new state (None: the session's shuffle partitions, so that its batches are shuffled once)."""
        self.spark, self.folder = spark, folder.rstrip("/")
        self._at = f"{self.folder}/manifest"
        held = json.loads(spark.read.text(self._at).first().value) if tables._exists(spark, self._at) else {}  # one line
        self.buckets: int = held.get("buckets") or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.batches: list[str] = held.get("batches", [])
        self._version: str | None = held.get("version")
        self._kinds: list[str] = held.get("kinds", [])
        self._packed = colocated.read(spark, f"{self._version}/packed", self.buckets) if self._version else None
        self._nested: DataFrame | None = None

    @property
    def _tables(self) -> list[DataFrame]:
        """Totals, and latest rows."""
        return [self.rows().select("id", "rows", "n", "m"), self.rows().select("id", "tail")]

    def add(self, batch: str, history: DataFrame, dealt: bool = False, adjacent: bool = False) -> bool:
        """Merge a batch of history into the state; False if a batch of that name is in it already. ``dealt``: each task of ``history`` holds
        the ids of one bucket of the state; ``adjacent``: and an id's rows side by side, by rising rn."""
        if batch in self.batches:
            return False
        new = f"{self.folder}/{uuid.uuid4().hex}"
        version = f"{new}-batch"
        own = colocated.write(packed(history, dealt, adjacent), f"{version}/packed", self.buckets, dealt)
        if self._packed is not None:
            version = new
            own = colocated.write(merge(self._packed, own), f"{version}/packed", self.buckets, dealt=True)
        kinds = [dict(history.dtypes)[c] for c in ("rn", *OTHERS)]
        if self._kinds:
            kinds = [max(x, y, key=_WIDER.index) if x != y else x for x, y in zip(self._kinds, kinds, strict=True)]
        before, said = self._version, {"buckets": self.buckets, "batches": [*self.batches, batch], "version": version, "kinds": kinds}
        tables.write_report(self.spark, said, self._at)
        self._packed, self._nested, self._version, self.batches, self._kinds = own, None, version, said["batches"], kinds
        for old in {before, f"{new}-batch"} - {None, version}:
            remove(self.spark, old)
        return True

    def _states(self) -> DataFrame:
        if self._packed is None:
            raise ValueError("the state is empty: add a batch first")
        return self._packed

    def rows(self) -> DataFrame:
        """(id, rows, n, m, tail), bucketed by id. SQL over states reads this table, which is written when it is first asked for."""
        if self._nested is None:
            lying = self._states().repartition(self.buckets, "id")
            self._nested = colocated.write(_nested(lying, self._kinds), f"{self._version}/nested-{uuid.uuid4().hex}", self.buckets, dealt=True)
        return self._nested

    def family(self, name: str, columns: Iterable[str] | None = None, digits: int | None = None) -> DataFrame:
        """id and the features of a family, or only ``columns`` of it; ``digits``: round to so many."""
        if columns is None and name in _WIDE:
            return _wide_family(self._states(), name, digits)
        made = FAMILIES[name]()
        found = self.rows().selectExpr("id", *(f"{made[c]} AS `{c}`" for c in (made if columns is None else columns)))
        return found if digits is None else found.selectExpr(*(f"round(`{c}`, {digits}) AS `{c}`" if t == "double" else f"`{c}`" for c, t in found.dtypes))

    def scores(self, name: str, target: DataFrame, population: bool = True) -> DataFrame:
        """(feature, score) of a family; running it fails on an entity without a label."""
        made = FAMILIES[name]()
        usual = {c: ABSENT for c in made if not c.startswith("seq_delta")} if name == "seq" else {}
        return family_scores(scoring.attach_target(self.rows(), target), made, usual, population)
