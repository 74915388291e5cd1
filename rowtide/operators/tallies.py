"""Counts, moments and latest rows of entities, added up over whole Arrow batches.

Hundreds of counts as expressions cost a row more than a hundred microseconds; here a batch's rows are sorted by entity and counted
column by column. A task holds one entity back between batches, so its memory hangs on the layout alone, however many rows an
entity has. Rows that do not lie by id are added up where they lie, and only the tallies are shuffled and merged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Event order of a row without one, and of a place without a row.
UNKNOWN, ABSENT = np.iinfo(np.int64).min + 1, np.iinfo(np.int64).min
TOTALS = "rows long, n array<long>, m array<struct<n: long, s: double, m2: double, hi: double, at: long, last: double>>"
PARTIAL = TOTALS + ", rns array<long>, latest array<double>"
#: Values of a column, 0 for null, and which are not null (None: all).
Numbers = tuple[np.ndarray, np.ndarray | None]
_MOMENTS = ("n", "s", "m2", "hi", "at", "last")


@dataclass(frozen=True)
class Layout:
    """What is counted (column -> codes, ascending), which columns have moments, and columns of how many latest rows are kept.

    ``derive`` makes further columns, ``derived``, of a batch's columns; ``needs``: columns that it reads.
    """

    counted: dict[str, list[int]]
    measured: list[str]
    recent: list[str]
    rows: int = 0
    needs: tuple[str, ...] = ()
    derived: tuple[str, ...] = ()
    derive: Callable[[dict[str, Numbers]], dict[str, Numbers]] | None = None

    @property
    def columns(self) -> list[str]:
        """What is read of a row, beside id and rn."""
        return [c for c in dict.fromkeys([*self.counted, *self.measured, *self.recent, *self.needs]) if c not in self.derived]


@dataclass
class Tally:
    """The tallies of k entities. ``number`` to ``last`` are moments, k by columns; ``order`` and ``latest``: the latest rows first."""

    rows: np.ndarray
    counts: np.ndarray
    number: np.ndarray
    sums: np.ndarray
    squares: np.ndarray
    highest: np.ndarray
    at: np.ndarray
    last: np.ndarray
    order: np.ndarray
    latest: np.ma.MaskedArray

    def __getitem__(self, which) -> Tally:
        return Tally(*(getattr(self, f.name)[which] for f in fields(self)))

    def put(self, which: np.ndarray, other: Tally) -> None:
        for f in fields(self):
            getattr(self, f.name)[which] = getattr(other, f.name)

    def then(self, other: Tally) -> Tally:
        join = lambda a, b: (np.ma if isinstance(a, np.ma.MaskedArray) else np).concatenate((a, b))
        return Tally(*(join(getattr(self, f.name), getattr(other, f.name)) for f in fields(self)))

    def merged(self, other: Tally) -> Tally:
        """Tallies of both, entity by entity."""
        n = self.number + other.number
        with np.errstate(divide="ignore", invalid="ignore"):
            apart = np.where((self.number > 0) & (other.number > 0), self.sums / self.number - other.sums / other.number, 0.0)
            squares = self.squares + other.squares + np.where(n > 0, apart * apart * self.number * other.number / n, 0.0)
        order = np.concatenate((self.order, other.order), 1)
        first = np.argsort(~order, 1, kind="stable")
        both = np.ma.concatenate((self.latest, other.latest), 1)
        order, both = settled(np.take_along_axis(order, first, 1), np.ma.MaskedArray(np.take_along_axis(both.data, first[:, :, None], 1), np.take_along_axis(np.ma.getmaskarray(both), first[:, :, None], 1)))
        kept = self.order.shape[1]
        return Tally(
            self.rows + other.rows, self.counts + other.counts, n, self.sums + other.sums, squares, np.maximum(self.highest, other.highest),
            np.maximum(self.at, other.at), np.where(other.at > self.at, other.last, self.last), order[:, :kept], both[:, :kept],
        )


def settled(order: np.ndarray, latest: np.ma.MaskedArray) -> tuple[np.ndarray, np.ma.MaskedArray]:
    """Latest rows, the latest first, with rows of one ``rn`` in falling order of their other columns, nulls last."""
    tied = (order[:, 1:] == order[:, :-1]) & (order[:, 1:] != ABSENT)
    for k in np.flatnonzero(tied.any(1)):
        filled = latest[k].filled(-np.inf)
        by = np.lexsort((*filled.T[::-1], order[k]))[::-1]
        order[k], latest[k] = order[k, by], latest[k, by]
    return order, latest


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """``x`` rounded as Spark's ``round`` does: halves of the decimals that it is written with go away from zero."""
    scaled = x * 10.0**digits
    whole = np.rint(scaled)
    with np.errstate(invalid="ignore"):
        far = (np.abs(scaled) >= 2.0**52) & (x != np.rint(x))
        doubtful = (np.abs(np.abs(scaled - whole) - 0.5) <= 1e-6 + np.abs(scaled) * 2.0**-50) & (x != np.rint(x)) | far
        out = np.where(np.isfinite(scaled) & (np.abs(scaled) < 2.0**52), whole / 10.0**digits, x) + 0.0
    if doubtful.any():
        few, back = np.unique(x[doubtful], return_inverse=True)
        step, exact = Decimal(1).scaleb(-digits), Context(prec=400)
        out[doubtful] = np.array([float(Decimal(repr(float(v))).quantize(step, ROUND_HALF_UP, exact)) for v in few])[back]
    return out


def _numbers(column: pa.Array) -> Numbers:
    if not column.null_count:
        return column.to_numpy(zero_copy_only=False), None
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def _counted(x: np.ndarray, there: np.ndarray | None, entity: np.ndarray, k: int, codes: list[int]) -> np.ndarray:
    """(k, codes): rows of each entity with each code."""
    low, high = codes[0], codes[-1]
    place = np.full(high - low + 2, len(codes), np.int64)
    place[np.array(codes) - low] = np.arange(len(codes))
    ok = (x >= low) & (x <= high)
    if there is not None:
        ok &= there
    at = np.where(ok, x, low).astype(np.int64)
    if x.dtype.kind == "f":
        ok &= at == x
    width = len(codes) + 1
    return np.bincount(entity * width + np.where(ok, place[at - low], len(codes)), minlength=k * width).reshape(k, width)[:, :-1]


def tally(batch: pa.RecordBatch, layout: Layout) -> tuple[pa.Array, Tally]:
    """The entities of a batch (id, rn and the layout's columns), in the order in which they first stand there."""
    coded = batch.column("id").dictionary_encode()
    entity, rn = coded.indices.to_numpy().astype(np.int64), batch.column("rn").fill_null(UNKNOWN).to_numpy()
    step = np.diff(entity)
    if not ((step > 0) | ((step == 0) & (np.diff(rn.astype(np.float64)) >= 0))).all():
        by = np.lexsort((rn, entity))
        batch, entity, rn = batch.take(pa.array(by)), entity[by], rn[by]
    k = len(coded.dictionary)
    starts = np.flatnonzero(np.concatenate(([True], entity[1:] != entity[:-1])))
    sizes = np.diff(np.append(starts, len(entity)))
    held = {c: _numbers(batch.column(c)) for c in layout.columns}
    if layout.derive:
        held |= layout.derive(held)
    counts = [_counted(*held[c], entity, k, codes) for c, codes in layout.counted.items()]
    shape = (k, len(layout.measured))
    number, at = np.empty(shape, np.int64), np.empty(shape, np.int64)
    sums, squares, highest, last = (np.empty(shape) for _ in range(4))
    ordered = np.where(rn == UNKNOWN, -1, np.arange(len(rn)))
    for j, c in enumerate(layout.measured):
        x, there = held[c]
        x = x.astype(np.float64)
        number[:, j] = sizes if there is None else np.add.reduceat(there, starts, dtype=np.int64)
        # one after another, as an aggregation adds them up
        sums[:, j] = np.bincount(entity, x, k)
        off = x - (sums[:, j] / np.maximum(number[:, j], 1))[entity]
        squares[:, j] = np.add.reduceat(off * off if there is None else np.where(there, off * off, 0.0), starts)
        highest[:, j] = np.maximum.reduceat(x if there is None else np.where(there, x, -np.inf), starts)
        latest = np.maximum.reduceat(ordered if there is None else np.where(there, ordered, -1), starts)
        at[:, j], last[:, j] = np.where(latest >= 0, rn[latest], UNKNOWN), x[latest]
    order, rows = np.full((k, layout.rows), ABSENT), np.zeros((k, layout.rows, len(layout.recent)))
    hidden = np.ones(rows.shape, bool)
    if layout.rows:
        back = np.repeat(starts + sizes, sizes) - 1 - np.arange(len(entity))
        near = np.flatnonzero(back < layout.rows)
        order[entity[near], back[near]] = rn[near]
        for j, c in enumerate(layout.recent):
            x, there = held[c]
            rows[entity[near], back[near], j] = x[near]
            hidden[entity[near], back[near], j] = False if there is None else ~there[near]
    counted = np.concatenate(counts, 1) if counts else np.zeros((k, 0), np.int64)
    return coded.dictionary, Tally(sizes, counted, number, sums, squares, highest, at, last, order, np.ma.MaskedArray(rows, hidden))


def folded(ids: pa.Array, found: Tally) -> tuple[pa.Array, Tally]:
    """Entities that stand side by side several times are merged."""
    entity = ids.dictionary_encode().indices.to_numpy()
    new = np.concatenate(([True], entity[1:] != entity[:-1]))
    if new.all():
        return ids, found
    starts, run = np.flatnonzero(new), np.cumsum(new) - 1
    rank = np.arange(len(run)) - starts[run]
    out = found[starts]
    for r in range(1, int(rank.max()) + 1):
        here = np.flatnonzero(rank == r)
        out.put(run[here], out[run[here]].merged(found[here]))
    return ids.take(pa.array(starts)), out


def _lists(values: pa.Array, k: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.linspace(0, len(values), k + 1).astype(np.int32)), values)


def totals_of(found: Tally) -> list[pa.Array]:
    """The columns of ``TOTALS``."""
    k, none = len(found.rows), found.number.ravel() == 0
    late = (found.at <= UNKNOWN).ravel()
    cells = [pa.array(found.number.ravel()), *(pa.array(x.ravel(), mask=none) for x in (found.sums, found.squares, found.highest)), *(pa.array(x.ravel(), mask=late) for x in (found.at, found.last))]
    return [pa.array(found.rows, pa.int64()), _lists(pa.array(found.counts.ravel(), pa.int64()), k), _lists(pa.StructArray.from_arrays(cells, list(_MOMENTS)), k)]


def _partial_of(found: Tally) -> list[pa.Array]:
    latest = pa.array(found.latest.data.ravel(), mask=np.ma.getmaskarray(found.latest).ravel())
    return [*totals_of(found), _lists(pa.array(found.order.ravel()), len(found.rows)), _lists(latest, len(found.rows))]


def read_totals(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Of the columns of ``TOTALS`` what a tally has but for its latest rows."""
    k, m = batch.num_rows, batch.column("m").flatten()
    cell = lambda c, fill: m.field(c).fill_null(fill).to_numpy(zero_copy_only=False).reshape(k, -1)
    counts = batch.column("n").flatten().to_numpy(zero_copy_only=False).reshape(k, -1)
    return [batch.column("rows").to_numpy(), counts, *(cell(c, fill) for c, fill in zip(_MOMENTS, (0, 0.0, 0.0, -np.inf, UNKNOWN, 0.0), strict=True))]


def _read(batch: pa.RecordBatch, layout: Layout) -> tuple[pa.Array, Tally]:
    k = batch.num_rows
    latest = batch.column("latest").flatten()
    shape = (k, layout.rows, len(layout.recent))
    kept = np.ma.MaskedArray(latest.fill_null(0).to_numpy(zero_copy_only=False).reshape(shape).copy(), ~latest.is_valid().to_numpy(zero_copy_only=False).reshape(shape))
    order = batch.column("rns").flatten().to_numpy(zero_copy_only=False).reshape(k, layout.rows)
    return batch.column("id"), Tally(*read_totals(batch), order, kept)


def _whole(read: Callable[[pa.RecordBatch], tuple[pa.Array, Tally]], made: Callable[[Tally], list[pa.Array]], names: list[str]):
    """A function of batches sorted by id: each entity once, its last batch awaited."""

    def batch_of(ids: pa.Array, found: Tally) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, *made(found)], ["id", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new, found = read(batch)
            ids, held = (new, found) if held is None else (pa.concat_arrays([ids, new]), held.then(found))
            ids, held = folded(ids, held)
            if len(ids) > 1:
                yield batch_of(ids[:-1], held[:-1])
                ids, held = ids[-1:], held[-1:]
        if held is not None:
            yield batch_of(ids, held)

    return run


def by_entity(rows: DataFrame, layout: Layout, made: Callable[[Tally], list[pa.Array]] = totals_of, schema: str = TOTALS, dealt: bool = False, adjacent: bool = False) -> DataFrame:
    """id and what ``made`` gives of an entity's tally, as ``schema``. ``rows``: id, rn and the layout's columns, numbers or null; rows
    without an id are left out. ``dealt``: all rows of an id are in one task; otherwise tallies of each task are merged by id.
    ``adjacent``: in each task the rows of an id stand side by side, by rising rn."""
    kinds = dict(rows.dtypes)
    as_is = ("tinyint", "smallint", "int", "float", "double")
    # Spark does not compile operators with a lambda into a stage's one loop. There, dozens of computed columns make a method longer
    # than the JVM compiles, and cost a row 20 us instead of 1; apart, they are compiled as many small methods.
    order = "element_at(transform(array(CAST(rn AS BIGINT)), x -> x), 1) AS rn"
    used = rows.where("id is not null").selectExpr("id", order, *(f"`{c}`" if kinds[c] in as_is else f"CAST(`{c}` AS DOUBLE) AS `{c}`" for c in layout.columns if c != "rn"))
    used, id_type = used if adjacent else used.sortWithinPartitions("id", "rn"), kinds["id"]
    names = lambda s: StructType.fromDDL(s).names
    count = lambda batch: tally(batch, layout)
    if dealt:
        return used.mapInArrow(_whole(count, made, names(schema)), f"id {id_type}, {schema}")
    parts = used.mapInArrow(_whole(count, _partial_of, names(PARTIAL)), f"id {id_type}, {PARTIAL}").repartition("id").sortWithinPartitions("id")
    return parts.mapInArrow(_whole(lambda batch: _read(batch, layout), made, names(schema)), f"id {id_type}, {schema}")
