"""Removal of byte strings that an earlier document holds too: suffix array by bucket-pointer refinement, sharded by anchors.

Every ``LENGTH``-byte window owns an anchor: the leftmost of its ``GRAM``-byte strings with the least hash. Equal windows have
equal anchors at equal offsets, so windows are compared among those of one anchor only, in whichever task the anchor's hash
falls. A stretch of consecutive windows with one anchor is a context, shipped once for each block of documents.

1. Blocks send their distinct anchors, as 32 bits within a cell of the hash range; cells answer which occur in other blocks.
2. Blocks send the distinct contexts of the anchors that recur, with the least document of each. A cell builds the suffix
   array of its distinct contexts by bucket-pointer refinement (see ``suffix_array``). Windows that are equal stand next to each
   other in it, which is decided on their bytes; the cell answers, as one bit for each window, whether a smaller document has
   the window.
3. Blocks mark the windows and remove the bytes that they cover.

Hashes only decide where contexts meet. Contexts of one hash are compared byte by byte before they count as one.

Texts are shuffled once; what goes back and forth is about a third of a byte for each byte of text and the contexts. A hot
passage or group of copies is one context for each block, whatever the number of its documents. Messages between a block and a
cell are one row each; there are never more than anchors.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtide.llm.common import byte_view, mix64, span_hashes

LENGTH, GRAM = 50, 16
WINDOWS = LENGTH - GRAM + 1
#: Window starts handled at once; positions within fit in POSITION bits, the rest of a key is hash.
SEGMENT, POSITION = 1 << 20, np.uint64((1 << 21) - 1)
#: Text of a block and anchors of a cell, about. Small inputs are cut finer, into ``LEAST_BLOCKS``.
BLOCK_BYTES, CELL_ANCHORS, LEAST_BLOCKS, LEAST_BLOCK_BYTES = 8 << 20, 500_000, 48, 1 << 18
#: Bytes of the first buckets' common prefix; suffixes of the buckets that are refined together.
PREFIX, TOGETHER = 8, 1 << 17
NO_ID = np.iinfo(np.int64).max
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9)]


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as a number."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", np.ascontiguousarray(data).data, strides=(1,)) if len(data) > 7 else np.zeros(0, "<u8")


def gram_hash(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    h = low * _K[0]
    h ^= h >> np.uint64(29)
    h += high * _K[1]
    h *= _K[2]
    h ^= h >> np.uint64(32)
    return h


class Runs:
    """The contexts of a block: first and last window start, anchor hash, and (if asked for) a hash of the context."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, contexts: bool):
        bad = np.zeros(len(data) + 1, np.int8)
        some = offsets[1:] > offsets[:-1]
        np.add.at(bad, np.maximum(offsets[1:] - (LENGTH - 1), offsets[:-1])[some], 1)
        np.add.at(bad, offsets[1:][some], -1)
        ok = np.cumsum(bad[:-1], dtype=np.int8) == 0
        parts = [self._segment(data, ok, s, contexts) for s in range(0, max(0, len(data) - LENGTH + 1), SEGMENT)]
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        self.first, self.last, self.anchor, self.context = (np.concatenate(x) for x in zip(empty, *parts, strict=True))
        self.row = np.searchsorted(offsets, self.first, "right") - 1

    def confirm(self, data: np.ndarray, order: np.ndarray, new: np.ndarray) -> None:
        """Check on bytes that contexts are equal where ``new`` says so of neighbours in ``order``. An answer names a context by its
        hash, so two contexts of one hash in a block cannot be told apart: that is an error (one in 2**64 pairs)."""
        again = np.flatnonzero(~new)
        a, b = order[again], order[again - 1]
        sizes = self.last - self.first + LENGTH
        if (sizes[a] != sizes[b]).any() or not equal_spans(data, self.first[a], data, self.first[b], sizes[a]).all():
            raise RuntimeError("two contexts share a hash")

    @staticmethod
    def _segment(data: np.ndarray, ok: np.ndarray, s: int, contexts: bool) -> tuple[np.ndarray, ...]:
        part = np.ascontiguousarray(data[s : s + SEGMENT + LENGTH - 1])
        words = words_at(part)
        grams = len(part) - GRAM + 1
        h = gram_hash(words[:grams], words[8 : 8 + grams])
        low, span = (h & ~POSITION) | np.arange(grams, dtype=np.uint64), 1
        while 2 * span <= WINDOWS:
            low, span = np.minimum(low[:-span], low[span:]), 2 * span
        rest = WINDOWS - span
        own = (np.minimum(low[: len(low) - rest], low[rest:]) & POSITION).astype(np.int64)
        good = ok[s : s + len(own)]
        same = np.zeros(len(own) + 1, bool)
        same[1:-1] = (own[1:] == own[:-1]) & good[1:] & good[:-1]
        first, last = np.flatnonzero(good & ~same[:-1]), np.flatnonzero(good & ~same[1:])
        anchor = mix64(h[own[first]])
        keys = mix64(span_hashes(part, first, last + LENGTH) * _K[0] + anchor) if contexts else np.zeros(len(first), np.uint64)
        return first + s, last + s, anchor, keys


def _text(block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = byte_view(block.column("text"))
    return data, offsets, block.column("doc_id").fill_null(NO_ID).to_numpy()


def _cells(sorted_keys: np.ndarray, bits: int, width: int) -> Iterator[tuple[int, int, int]]:
    """(cell, from, to) of the cells that hold some of the keys of ``width`` bits."""
    cell = (sorted_keys >> np.uint64(width - bits)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else []
    return zip(cell[starts].tolist() if len(cell) else [], list(starts), [*list(starts[1:]), len(cell)] if len(cell) else [], strict=True)


def send_anchors(bits: int):
    """Step 1, block: distinct anchors, cut to 32 bits within each cell."""

    def send(block: pa.Table) -> pa.Table:
        data, offsets, _ = _text(block)
        keys = np.unique(Runs(data, offsets, False).anchor >> np.uint64(32 - bits))
        cells = list(_cells(keys, bits, 32 + bits))
        n = block.column("block")[0].as_py()
        return pa.table({"block": pa.array([n] * len(cells), pa.int64()), "cell": pa.array([c for c, _, _ in cells], pa.int64()), "raw": pa.array([keys[a:b].astype("<u4").tobytes() for _, a, b in cells], pa.binary())})

    return send


def answer_anchors(cell: pa.Table) -> pa.Table:
    """Step 1, cell: for each anchor of each block a bit, whether another block has it."""
    lists = [np.frombuffer(x.as_py(), "<u4") for x in cell.column("raw")]
    all_ = np.sort(np.concatenate(lists))
    again = np.unique(all_[1:][all_[1:] == all_[:-1]])
    if len(again):
        bits = [again[np.minimum(np.searchsorted(again, x), len(again) - 1)] == x for x in lists]
    else:
        bits = [np.zeros(len(x), bool) for x in lists]
    return pa.table({"block": cell.column("block"), "cell": cell.column("cell"), "raw": pa.array([np.packbits(x).tobytes() for x in bits], pa.binary())})


def send_contexts(bits: int):
    """Step 2, block: distinct contexts of the anchors that recur here or elsewhere, each with its least document."""

    def send(block: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {"block": [], "cell": [], "shape": [], "text": [], "docs": []}
        if block.num_rows:
            data, offsets, ids = _text(block)
            runs = Runs(data, offsets, True)
            doc = ids[runs.row]
            cut = runs.anchor >> np.uint64(32 - bits)
            keys = np.unique(cut)
            elsewhere = np.zeros(len(keys), bool)
            known = dict(zip(answers.column("cell").to_pylist(), answers.column("raw"), strict=True))
            for cell, a, b in _cells(keys, bits, 32 + bits):
                elsewhere[a:b] = np.unpackbits(np.frombuffer(known[cell].as_py(), np.uint8))[: b - a]
            order = np.argsort(cut, kind="stable")
            starts = np.searchsorted(cut[order], keys)
            here = np.minimum.reduceat(doc[order], starts) != np.maximum.reduceat(doc[order], starts) if len(keys) else elsewhere
            chosen = np.flatnonzero((elsewhere | here)[np.searchsorted(keys, cut)])
            order = chosen[np.lexsort((doc[chosen], runs.context[chosen], runs.anchor[chosen]))]
            new = np.ones(len(order), bool)
            new[1:] = (runs.context[order[1:]] != runs.context[order[:-1]]) | (runs.anchor[order[1:]] != runs.anchor[order[:-1]])
            runs.confirm(data, order, new)
            best = order[new]  # the least document of each context comes first
            at, size = runs.first[best], runs.last[best] - runs.first[best] + LENGTH
            ends = np.cumsum(size)
            for cell, a, b in _cells(runs.anchor[best], bits, 64):
                lo = ends[a] - size[a]
                index = np.repeat(at[a:b] - (ends[a:b] - size[a:b] - lo), size[a:b]) + np.arange(ends[b - 1] - lo)
                for key, value in zip(out, (block.column("block")[0].as_py(), cell, size[a:b].astype(np.uint8).tobytes(), data[index].tobytes(), doc[best[a:b]].astype("<i8").tobytes()), strict=True):
                    out[key].append(value)
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True)})

    return send


def suffix_array(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Positions of ``text`` in the order of their next ``LENGTH`` bytes; ``left``: bytes to the end of each one's context.

    Bucket-pointer refinement. Suffixes are dealt to buckets by ``PREFIX`` bytes (zeros beyond a context's end); a suffix's bucket
    pointer is its bucket's place in the array, so pointers are in the order of the suffixes as far as that is known. Buckets
    are taken from left to right. A bucket whose suffixes agree on ``depth`` bytes is sorted on the pointers of the suffixes
    ``depth`` bytes later and falls into buckets of those with one pointer, which agree on as many bytes more as that
    pointer's bucket does. The new pointers hold from then on, for the refinement of these buckets, which follows at once, and
    for all buckets to come: the further to the right, the more bytes a pointer stands for. A bucket is final when it has
    one suffix or agrees on ``LENGTH`` bytes.
    """
    n = len(text)
    first = words_at(np.concatenate((text, np.zeros(8, np.uint8))))[:n].byteswap()
    short = np.flatnonzero(left < PREFIX)
    shift = (8 * (PREFIX - left[short])).astype(np.uint64)
    first[short] = first[short] >> shift << shift
    order = np.argsort(first, kind="stable").astype(np.int32)
    first = first[order]
    edge = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1]))) if n else np.zeros(0, np.int64)
    del first
    sizes = np.diff(np.append(edge, n))
    pointer, depth = np.empty(n, np.int32), np.full(n, PREFIX, np.int16)
    pointer[order] = np.repeat(edge, sizes)
    open_ = np.flatnonzero(np.repeat(sizes > 1, sizes))
    at = 0
    while at < len(open_):
        to = min(at + TOGETHER, len(open_))
        while to < len(open_) and pointer[order[open_[to]]] == pointer[order[open_[to - 1]]]:
            to = int(np.searchsorted(open_, pointer[order[open_[to]]] + sizes[np.searchsorted(edge, pointer[order[open_[to]]])]))
        place = open_[at:to]
        at = to
        while len(place):
            suffix = order[place]
            later = np.minimum(depth[suffix], LENGTH - PREFIX)
            there = later < left[suffix]
            target = np.where(there, suffix + later, 0)
            key = pointer[suffix].astype(np.int64) << 32 | np.where(there, pointer[target] + 1, 0)
            deep = later + np.where(there, depth[target], LENGTH)
            by = np.argsort(key, kind="stable")
            suffix, key = suffix[by], key[by]
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            sizes_of = np.diff(np.append(starts, len(key)))
            order[place] = suffix
            pointer[suffix] = np.repeat(place[starts], sizes_of)
            depth[suffix] = deep[by]
            place = place[np.repeat(sizes_of > 1, sizes_of) & (deep[by] < LENGTH)]
    return order


def equal_windows(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the ``LENGTH`` bytes from ``a`` are those from ``b``."""
    words = words_at(text)
    same = np.ones(len(a), bool)
    for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        same[same] = words[a[same] + k] == words[b[same] + k]
    return same


def equal_spans(a_text: np.ndarray, a: np.ndarray, b_text: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the bytes from ``a`` are those from ``b``, over ``sizes`` (at least one each)."""
    out = np.ones(len(a), bool)
    for s in range(0, len(a), 1 << 14):
        n = sizes[s : s + (1 << 14)]
        to = np.cumsum(n)
        within = np.arange(to[-1]) - np.repeat(to - n, n)
        same = a_text[np.repeat(a[s : s + (1 << 14)], n) + within] == b_text[np.repeat(b[s : s + (1 << 14)], n) + within]
        out[s : s + (1 << 14)] = np.logical_and.reduceat(same, to - n)
    return out


def answer_contexts(cell: pa.Table) -> pa.Table:
    """Step 2, cell: the context keys of each block some of whose windows a smaller document has, with a bit for each window."""
    sizes_of = [np.frombuffer(x.as_py(), np.uint8).astype(np.int64) for x in cell.column("shape")]
    size = np.concatenate(sizes_of)
    text = np.frombuffer(b"".join(x.as_py() for x in cell.column("text")), np.uint8)
    doc = np.concatenate([np.frombuffer(x.as_py(), "<i8") for x in cell.column("docs")])
    sender = np.repeat(np.arange(cell.num_rows), [len(x) for x in sizes_of])
    ends = np.cumsum(size)
    starts = ends - size
    # the anchor and the key of each context, as the block has them
    anchor, key = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + SEGMENT, "right")))
        part = text[starts[at] : ends[to - 1]]
        s, e = starts[at:to] - starts[at], ends[at:to] - starts[at]
        runs = _owned(part, s, e)
        anchor[at:to] = runs
        key[at:to] = mix64(span_hashes(part, s, e) * _K[0] + runs)
        at = to
    order = np.lexsort((doc, key, anchor))
    new = np.ones(len(order), bool)
    new[1:] = (key[order[1:]] != key[order[:-1]]) | (anchor[order[1:]] != anchor[order[:-1]]) | (size[order[1:]] != size[order[:-1]])
    again = np.flatnonzero(~new)
    new[again] = ~equal_spans(text, starts[order[again]], text, starts[order[again - 1]], size[order[again]])
    one = order[new]  # a context of each kind, of the least document
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    least = np.full((len(one), WINDOWS), doc[one][:, None])
    again = anchor[one]
    several = np.zeros(len(one), bool)
    several[1:] |= again[1:] == again[:-1]
    several[:-1] |= again[1:] == again[:-1]
    if several.any():
        of = np.flatnonzero(several)
        s, n = starts[one[of]], size[one[of]]
        to = np.cumsum(n)
        own = text[np.repeat(s - (to - n), n) + np.arange(to[-1])]
        end = np.repeat(to, n)
        sorted_ = suffix_array(own, (end - np.arange(len(own))).astype(np.int32))
        whole = sorted_[end[sorted_] - sorted_ >= LENGTH].astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], ~equal_windows(own, whole[1:], whole[:-1]))))
        which = np.searchsorted(to, whole, "right")
        offset, d = whole - (to - n)[which], doc[one[of]][which]
        low = np.repeat(np.minimum.reduceat(d, first), np.diff(np.append(first, len(d))))
        least[of[which], offset] = low
    mask = ((least[kind] < doc[:, None]).astype(np.uint64) << np.arange(WINDOWS, dtype=np.uint64)).sum(1, dtype=np.uint64)
    hit = np.flatnonzero(mask & ((np.uint64(1) << (size - LENGTH + 1).astype(np.uint64)) - np.uint64(1)))
    cuts = np.searchsorted(sender[hit], np.arange(cell.num_rows + 1))
    keys = [key[hit[a:b]].astype("<u8").tobytes() for a, b in itertools.pairwise(cuts)]
    masks = [mask[hit[a:b]].astype("<u8").tobytes() for a, b in itertools.pairwise(cuts)]
    return pa.table({"block": cell.column("block"), "keys": pa.array(keys, pa.binary()), "masks": pa.array(masks, pa.binary())})


def _owned(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The anchor hash of each context: the least gram, by the bits that blocks compare, of its first window."""
    words = words_at(text)
    grams = starts[:, None] + np.arange(WINDOWS)
    h = gram_hash(words[grams], words[grams + 8])
    best = (h & ~POSITION).argmin(1)
    return mix64(h[np.arange(len(starts)), best])


def removed_bytes(data: np.ndarray, runs: Runs, doc: np.ndarray, keys: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """True for the bytes that windows of smaller documents cover; ``keys`` and ``masks``: the cells' answers."""
    order = np.lexsort((doc, runs.context, runs.anchor))
    new = np.ones(len(order), bool)
    new[1:] = (runs.context[order[1:]] != runs.context[order[:-1]]) | (runs.anchor[order[1:]] != runs.anchor[order[:-1]])
    runs.confirm(data, order, new)
    least = np.empty(len(order), np.int64)
    least[order] = doc[order[new]][np.cumsum(new) - 1] if len(order) else doc[:0]
    starts = np.zeros(len(data) + 1, np.int32)
    later = doc > least  # an earlier document of this block has the whole context
    np.add.at(starts, runs.first[later], 1)
    np.add.at(starts, runs.last[later] + 1, -1)
    begun = np.cumsum(starts[:-1], dtype=np.int32) > 0
    if len(keys):
        by = np.argsort(keys)
        keys, masks = keys[by], masks[by]
        of = np.flatnonzero(~later)
        at = np.minimum(np.searchsorted(keys, runs.context[of]), len(keys) - 1)
        found = keys[at] == runs.context[of]
        of, mask = of[found], masks[at[found]]
        run, offset = np.nonzero(mask[:, None] >> np.arange(WINDOWS, dtype=np.uint64) & np.uint64(1))
        place = runs.first[of[run]] + offset
        begun[place[place <= runs.last[of[run]]]] = True
    out = np.zeros(len(data), bool)
    for s in range(0, len(data), SEGMENT):
        lo = max(0, s - LENGTH)
        n = np.concatenate(([0], np.cumsum(begun[lo : s + SEGMENT], dtype=np.int32)))
        i = np.arange(s, min(len(data), s + SEGMENT)) - lo
        out[s : s + SEGMENT] = n[i + 1] > n[np.maximum(i + 1 - LENGTH, 0)]
    return out


def remove(block: pa.Table, answers: pa.Table, text: bool) -> pa.Table:
    """Step 3, block: what is left of each document, as digest columns, and its text as bytes if asked for."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if text else [])]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.binary()] if text else [])]
    out: list[list] = [[] for _ in names]
    if block.num_rows:
        data, offsets, ids = _text(block)
        runs = Runs(data, offsets, True)
        keys, masks = (np.frombuffer(b"".join(x.as_py() for x in answers.column(c)), "<u8") for c in ("keys", "masks"))
        gone = removed_bytes(data, runs, ids[runs.row], keys, masks)
        bounds = np.append(0, np.cumsum(gone, dtype=np.int64))
        edges = gone.copy()
        edges[1:] &= ~gone[:-1]
        edges[offsets[:-1][offsets[:-1] < len(data)]] = gone[offsets[:-1][offsets[:-1] < len(data)]]
        spans = np.append(0, np.cumsum(edges, dtype=np.int64))
        for k, (a, b) in enumerate(itertools.pairwise(offsets.tolist())):
            kept = data[a:b][~gone[a:b]].tobytes()
            row = [block.column("doc_id")[k].as_py(), b - a, int(bounds[b] - bounds[a]), int(spans[b] - spans[a]), hashlib.sha256(kept).hexdigest(), kept]
            for column, value in zip(out, row, strict=False):
                column.append(value)
    return pa.table({n: pa.array(v, t) for n, v, t in zip(names, out, kinds, strict=True)})


def remove_repeats(docs: DataFrame, text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the bytes left, if ``text``) of every row of ``docs``.

    A byte goes if a 50-byte string that covers it also starts in a document with a smaller id; strings are judged on the
    input. Null texts are empty. Null ids are larger than all others; documents of one id do not take bytes from each other,
    and each row is treated on its own. An empty table gives an empty result.
    """
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    blocks = max(1, math.ceil(total / BLOCK_BYTES), min(LEAST_BLOCKS, math.ceil(total / LEAST_BLOCK_BYTES)))
    bits = max(3, min(28, math.ceil(math.log2(max(1, 2 * total / (WINDOWS + 1) / CELL_ANCHORS)))))
    # rows of one id, or without one, are spread by their texts
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))
    texts = docs.select(block.alias("block"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    anchors = texts.groupBy("block").applyInArrow(send_anchors(bits), "block long, cell long, raw binary")
    shared = anchors.groupBy("cell").applyInArrow(answer_anchors, "block long, cell long, raw binary")
    contexts = texts.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(send_contexts(bits), "block long, cell long, shape binary, text binary, docs binary")
    answers = contexts.groupBy("cell").applyInArrow(answer_contexts, "block long, keys binary, masks binary")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * text
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda block, found: remove(block, found, text), schema)
