"""Exact substring removal with suffix arrays built by bucket-pointer refinement.

Every byte that lies in a string of ``length`` bytes which also starts somewhere else, in any document or the same one, is removed.

Sorting all suffixes of a corpus is not needed to know this. Each window of ``length`` bytes picks an anchor, the leftmost least hash
among its ``gram``-byte grams, so equal windows pick equal anchors at equal offsets; neighbouring windows with the same anchor form a
run. The anchors are the initial buckets, of ``gram``-byte prefixes, and are what Spark shuffles by:

1. equal runs of a bucket are one run with a count (partial aggregation: thousands of copies cost one row a task). A bucket with one
   distinct run needs no refinement: its windows occur as often as the run;
2. a bucket with several distinct runs goes, with their bytes, to one task. There the suffix array of the bytes is built by
   bucket-pointer refinement: buckets of 8-byte prefixes first; then bucket after bucket is sorted on the bucket pointers of its
   suffixes' later offsets, at the depth the bucket is known to agree to. A bucket's new pointers and depths are written at once, so its
   own sub-buckets, refined next, and all later buckets already sort on them. Suffixes alone in their bucket, and buckets that agree
   to a whole window, are done. Windows that are equal lie side by side in this order;
3. a bucket of more than ``HOT`` distinct runs (a passage that very many documents share) is cut, before any bytes are sent, into buckets of
   FINE offsets each. What all windows of such a bucket cover is one symbol there, equal contents are one with a count, and again a task refines
   it; where even that has more than ``HOT`` distinct contents, single windows are counted by partial aggregation. So no task gets more
   than HOT runs of one bucket, whatever the corpus holds;
4. windows that occur twice or more are repeated. Their spans are joined to the texts and cut out.

Defined results: a null text counts as empty; texts shorter than ``length`` are kept whole; repeated rows are documents like any others,
so their long texts are repeated; an empty table gives an empty result; extra columns are left behind.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import discard, in_pieces, materialise, ship

LENGTH, GRAM = 400, 160
#: Which documents a join is for is told to its map side in bits by hash, eight a document, up to this many (8 MB); beyond, the join takes all texts.
MOST_SLOTS = 1 << 26
#: Distinct runs of one bucket that a task refines together; of a bucket with more, so many windows' offsets make a bucket of its own.
HOT, FINE = 2048, 16
_PIECE = 1 << 19
#: Suffixes whose buckets are refined with one call of the array functions.
_STRETCH = 1 << 16
_RNG = np.random.default_rng(10)
_BYTES = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


# -- anchors ---------------------------------------------------------------------------------------------------------


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def window_anchors(data: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For each start of a window, the position of its anchor. ``data``: fewer than 2^24 bytes."""
    n = len(data)
    powers = _BYTES[data] * _powers(n, _BASE)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(powers, dtype=np.uint64)])
    h = (sums[gram:] - sums[:-gram]) * _powers(n - gram + 1, _BASE_INVERSE)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    # the hash's upper 40 bits, then the position: the least is the leftmost least
    key = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
    wide, width = length - gram + 1, 1
    while 2 * width <= wide:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < wide:
        key = np.minimum(key[: len(key) - (wide - width)], key[wide - width :])
    return (key & np.uint64((1 << 24) - 1)).astype(np.int64)


def runs(raws: list[bytes], length: int, gram: int) -> Iterator[tuple[int, int, int, int]]:
    """(which text, first window, last window, anchor) for texts that are, together, of bounded size; a longer one is cut with overlap."""
    group: list[tuple[int, int, bytes]] = []
    size = 0
    for which, raw in enumerate(raws):
        for start in range(0, max(len(raw) - length + 1, 0), _PIECE):
            part = raw[start : start + _PIECE + length - 1]
            if size and size + len(part) > 2 * _PIECE:
                yield from _runs(group, length, gram)
                group, size = [], 0
            group.append((which, start, part))
            size += len(part)
    if group:
        yield from _runs(group, length, gram)


def _runs(group: list[tuple[int, int, bytes]], length: int, gram: int) -> Iterator[tuple[int, int, int, int]]:
    data = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
    anchors = window_anchors(data, length, gram)
    begin = 0
    for which, start, part in group:
        own = anchors[begin : begin + len(part) - length + 1]
        edges = np.flatnonzero(np.diff(own)) + 1
        firsts = np.concatenate([[0], edges])
        lasts = np.concatenate([edges - 1, [len(own) - 1]])
        shift = start - begin
        for lo, hi, p in zip((firsts + start).tolist(), (lasts + start).tolist(), (own[firsts] + shift).tolist(), strict=True):
            yield which, lo, hi, p
        begin += len(part)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


RUNS = "key long, doc_id long, lo long, anchor long, before long, after long, print long"


def _find_runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """One row a run: ``anchor`` is the hash of the anchor's gram, ``before``/``after`` the run's extent, ``print`` the hash of all its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in in_pieces(batches, "text", _PIECE):
            keys, ids = piece.column("key").to_pylist(), piece.column("doc_id").to_pylist()
            raws = [(t or "").encode("utf-8", "surrogatepass") for t in piece.column("text").to_pylist()]
            out: list[tuple] = []
            for which, lo, hi, p in runs(raws, length, gram):
                raw = raws[which]
                out.append((keys[which], ids[which], lo, _signed(xxh64_intdigest(raw[p : p + gram], 1)), p - lo, hi - p, _signed(xxh64_intdigest(raw[lo : hi + length], 2))))
                if len(out) >= 20_000:
                    yield _longs(out, RUNS)
                    out = []
            if out:
                yield _longs(out, RUNS)

    return docs.mapInArrow(run, RUNS)


def _longs(rows: list[tuple], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[x.split()[0] for x in schema.split(", ")])


# -- bucket-pointer refinement ---------------------------------------------------------------------------------------


def _ends(sorted_keys: np.ndarray) -> np.ndarray:
    """For each element of a sorted array, the place of the last equal one."""
    return _spread(np.append(sorted_keys[1:] != sorted_keys[:-1], True))


def _spread(last: np.ndarray) -> np.ndarray:
    """For each place, the next flagged one, itself included."""
    at = np.flatnonzero(last)
    return np.repeat(at, np.diff(at, prepend=-1))


def _together(sorted_pointers: np.ndarray) -> np.ndarray:
    """Which elements share their bucket with a neighbour."""
    same = sorted_pointers[1:] == sorted_pointers[:-1]
    return np.append(same, False) | np.insert(same, 0, False)


def suffix_order(left: np.ndarray, eight: np.ndarray, enough: int, stretch: int = _STRETCH) -> np.ndarray:
    """The bucket pointer of each position: places in an order of the suffixes in which equal prefixes of ``enough`` bytes stand side by side.

    ``left``: bytes to the end of the position's own string; ``eight``: the next 8 bytes as a number, zeros after the string's end. Positions
    with fewer than 8 bytes left, and the ends of strings, are buckets of their own.
    """
    n = len(left)
    short = left < 8
    order = np.concatenate([np.flatnonzero(short), np.flatnonzero(~short)]).astype(np.int32)
    order = order[np.argsort(eight[order], kind="stable")]
    last = np.append(eight[order[1:]] != eight[order[:-1]], True) | short[order]
    pointer = np.empty(n + 1, np.int32)  # place n stands for the end of the last string
    pointer[order] = _spread(last)
    pointer[n] = n
    depth = np.full(n + 1, 8, np.int32)
    order = order[_together(pointer[order])].astype(np.int32)
    at = 0
    while at < len(order):
        stop = min(at + stretch, len(order))
        if stop < len(order):  # whole buckets only
            stop = at + int(np.searchsorted(pointer[order[at:]], pointer[order[stop - 1]], side="right"))
        active = order[at:stop]
        at = stop
        while len(active):
            d = depth[active]
            target = active + d
            over = d >= left[active]  # the string ends here; no other suffix goes on like it
            mine, next_ = pointer[active].astype(np.int64), np.where(over, n + 1 + active, pointer[target]).astype(np.int64)
            deeper = d + np.where(over, 0, depth[target])
            by = np.argsort((mine << 32) | next_)
            active, mine, next_, deeper = active[by], mine[by], next_[by], deeper[by]
            of_bucket = _ends(mine)
            of_part = _ends((mine << 32) | next_)
            pointer[active] = mine - (of_bucket - of_part)
            depth[active] = deeper
            active = active[_together(of_part) & (deeper < enough)]
    return pointer[:n]


def repeated_windows(spans: list[bytes], length: int = LENGTH, times: list[int] | None = None) -> list[np.ndarray]:
    """For each span, which of its windows of ``length`` bytes (8 at least) occur more than once; ``times``: how often each span counts."""
    sizes = np.array([len(s) for s in spans])
    ends = np.cumsum(sizes)
    n = int(ends[-1])
    left = np.repeat(ends, sizes).astype(np.int32) - np.arange(n, dtype=np.int32)
    padded = np.frombuffer(b"".join(spans) + bytes(8), np.uint8)
    eight = np.zeros(n, np.uint64)
    for k in range(8):
        eight = (eight << np.uint64(8)) | np.where(left > k, padded[k : k + n], np.uint8(0))
    pointer = suffix_order(left, eight, length)
    windows = np.flatnonzero(left >= length).astype(np.int32)
    order = windows[np.argsort(pointer[windows], kind="stable")]
    equal = np.arange(1, len(order))  # places whose window equals the one before
    for k in [*range(0, length - 8, 8), length - 8]:
        equal = equal[eight[order[equal] + k] == eight[order[equal - 1] + k]]
    first = np.ones(len(order), bool)
    first[equal] = False
    group = np.cumsum(first) - 1
    weight = np.ones(len(order)) if times is None else np.repeat(np.array(times, float), sizes)[order]
    hit = np.zeros(n, bool)
    hit[order] = (np.bincount(group, weight) > 1)[group]
    starts = ends - sizes
    return [hit[a : a + max(m - length + 1, 0)] for a, m in zip(starts.tolist(), sizes.tolist(), strict=True)]


# -- the operator ----------------------------------------------------------------------------------------------------


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with equal keys have equal ids and texts, hence equal results."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.select(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("key"), "doc_id", "text")


def _slots(rows: DataFrame) -> np.ndarray:
    """Flags by slot of the key's hash, eight slots a row at least; all set where that were more than MOST_SLOTS. Made as bits on the executors."""
    rows = rows.select("key").distinct()
    n = 1 << max(10, (8 * rows.count()).bit_length())
    if n > MOST_SLOTS:
        return np.ones(1, bool)
    width = min(n, 1 << 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            for part in np.unique(slot // width).tolist():
                held.setdefault(part, np.zeros(width, bool))[slot[slot // width == part] % width] = True
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array([np.packbits(x).tobytes() for x in held.values()], pa.binary())], names=["part", "bits"])

    slots = rows.select(F.col("key").bitwiseAND(F.lit(n - 1)).alias("slot"))
    out = np.zeros(n, bool)
    for r in slots.repartition(F.shiftright("slot", 16)).mapInArrow(run, "part long, bits binary").collect():  # n bits in all
        out[r["part"] * width : (r["part"] + 1) * width] |= np.unpackbits(np.frombuffer(r["bits"], np.uint8)).astype(bool)
    return out


def _in_slots(docs: DataFrame, slots: np.ndarray, inside: bool) -> DataFrame:
    if len(slots) == 1:
        return docs.where(F.lit(inside))
    bits = np.packbits(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(bits).astype(bool)
        for batch in batches:
            hit = flags[batch.column("key").to_numpy() & (len(flags) - 1)]
            yield batch.filter(pa.array(hit == inside))

    return docs.mapInArrow(run, docs.schema)


_KIND = ("anchor", "before", "after", "print")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(key, doc_id, start, stop): byte spans, overlapping ones too, whose windows occur elsewhere. ``docs`` from ``_keyed``."""
    found = materialise(_find_runs(docs, length, gram), "runs")
    kinds = materialise(found.groupBy(*_KIND).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "doc_id", "lo")).alias("first")), "kinds")
    several = found.join(kinds.where("n > 1").select(*_KIND), list(_KIND), "left_semi")
    sure = several.select("key", "doc_id", F.col("lo").alias("start"), (F.col("lo") + F.col("before") + F.col("after") + length).alias("stop"))
    # buckets of several runs, one that occurs once among them; the others are there to be compared with
    shared = materialise(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("runs"), F.min("n").alias("least")).where("runs > 1 AND least = 1").select("anchor", "runs"), "shared-anchors")
    open_ = materialise(kinds.join(shared, "anchor").select(*_KIND, "n", "runs", "first.*"), "open-runs")
    discard(shared)
    slots = _slots(open_)
    out = sure.union(_refined_buckets(_with_texts(docs, open_.where(F.col("runs") <= hot), slots), length))
    if not open_.where(F.col("runs") > hot).isEmpty():
        out = out.union(_refined_hot(_with_texts(docs, open_.where(F.col("runs") > hot), slots), length, gram, hot))
    return out


def _with_texts(docs: DataFrame, wanted: DataFrame, slots: np.ndarray) -> DataFrame:
    """(key, doc_id, text, runs) of the documents that hold the runs of ``wanted``. A document's list is bounded by its own text."""
    wanted = wanted.groupBy("key", "doc_id").agg(F.collect_list(F.struct(*_KIND, "n", "lo")).alias("runs"))
    texts = _in_slots(docs, slots, True).dropDuplicates(["key", "doc_id"])
    return texts.join(wanted, texts["key"].eqNullSafe(wanted["key"]) & texts["doc_id"].eqNullSafe(wanted["doc_id"])).select(texts["key"], texts["doc_id"], "text", "runs")


def _run_bytes(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple]:
    """(key, doc_id, run, its bytes)."""
    for piece in in_pieces(batches, "text", _PIECE):
        for key, doc, text, own in zip(*(piece.column(c).to_pylist() for c in ("key", "doc_id", "text", "runs")), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            for r in own:
                yield key, doc, r, raw[r["lo"] : r["lo"] + r["before"] + r["after"] + length]


def _hit_ranges(hit: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last of each stretch of set flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))).tolist()
    return zip(edge[::2], (x - 1 for x in edge[1::2]), strict=True)


_SPAN = "key long, doc_id long, start long, stop long"
_RUN = ("anchor", "key", "doc_id", "lo", "n", "bytes")


def _refined_buckets(held: DataFrame, length: int) -> DataFrame:
    """Spans of the runs that occur once, anchor by anchor; many small buckets are refined in one go."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for key, doc, r, raw in _run_bytes(batches, length):
            rows.append((r["anchor"], key, doc, r["lo"], r["n"], raw))
            if len(rows) == 2_000:
                yield _table(rows, _RUN)
                rows = []
        if rows:
            yield _table(rows, _RUN)

    def refined(rows: list[tuple]) -> pa.RecordBatch:
        hits = repeated_windows([r[5] for r in rows], length, [r[4] for r in rows])
        # a run that occurs more often is known whole
        out = [(r[1], r[2], r[3] + a, r[3] + b + length) for r, h in zip(rows, hits, strict=True) if r[4] == 1 for a, b in _hit_ranges(h)]
        return _longs(out, _SPAN) if out else _longs([(0, 0, 0, 0)], _SPAN).slice(1)

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in _RUN), strict=True):
                if size > _PIECE and row[0] != rows[-1][0]:  # whole anchors only
                    yield refined(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[5])
        if rows:
            yield refined(rows)

    return held.mapInArrow(cut, "anchor long, key long, doc_id long, lo long, n long, bytes binary").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(refine, _SPAN)


def _table(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if isinstance(c[0], bytes) else pa.int64()) for c in zip(*rows, strict=True)], names=list(names))


# -- buckets of very many runs ---------------------------------------------------------------------------------------


def _symbol(n: int) -> bytes:
    """Eight bytes for a core: 0xFF, which no UTF-8 text has, then seven that are not 0xFF."""
    out = [255]
    for _ in range(7):
        n, digit = divmod(n, 255)
        out.append(digit)
    return bytes(out)


def _halves(*parts: bytes) -> tuple[int, int]:
    """128 bits of the parts."""
    from xxhash import xxh3_128_digest

    return struct.unpack("<qq", xxh3_128_digest(b"".join(len(p).to_bytes(4, "little") + p for p in parts)))


_CELL = ("core1", "core2", "same1", "same2", "first", "left", "right", "key", "doc_id", "start", "n")


def cells(anchor: int, before: int, raw: bytes, length: int, gram: int, fine: int = FINE) -> Iterator[tuple]:
    """(core, content, first, left, right, start) of a run's windows in groups of ``fine`` offsets to the anchor, by absolute multiples of ``fine``.

    The core is what all ``fine`` offsets cover; ``left`` and ``right`` are the bytes of this run's windows around it; ``first``
    is the first of them within the group, and ``start`` that window's place in the run.
    """
    low = length - gram - before  # windows of the anchor are numbered 0 .. length - gram, from the one that starts first
    high = low + len(raw) - length
    for cell in range(low // fine, high // fine + 1):
        a, b = max(low, cell * fine), min(high, cell * fine + fine - 1)
        begin, stop = cell * fine + fine - 1 - low, cell * fine + length - low
        core = _halves(struct.pack("<qq", anchor, cell), raw[begin:stop])
        left, right = raw[a - low : begin], raw[stop : b - low + length]
        first = a - cell * fine
        yield (*core, *_halves(bytes([first]), left, right), first, left, right, a - low)


def _refined_hot(held: DataFrame, length: int, gram: int, hot: int) -> DataFrame:
    """As ``_refined_buckets``, for anchors of any number of runs."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for key, doc, r, raw in _run_bytes(batches, length):
            for *cell, start in cells(r["anchor"], r["before"], raw, length, gram):
                rows.append((*cell, key, doc, r["lo"] + start, r["n"]))
            if len(rows) > 4_000:
                yield _table(rows, _CELL)
                rows = []
        if rows:
            yield _table(rows, _CELL)

    core, content = ["core1", "core2"], ["core1", "core2", "same1", "same2"]
    all_ = materialise(held.mapInArrow(cut, ", ".join(f"{c} {'binary' if c in ('left', 'right') else 'long'}" for c in _CELL)), "cells")
    distinct = materialise(all_.groupBy(*content).agg(F.sum("n").alias("n"), F.first("first").alias("first"), F.first("left").alias("left"), F.first("right").alias("right")), "cell-contents")
    # buckets of too many contents for one task, few if any
    too_many = materialise(distinct.groupBy(*core).agg(F.count(F.lit(1)).alias("contents")).where(F.col("contents") > hot).select(*core), "hot-cells")
    few = distinct.join(too_many, core, "left_anti").repartition(*core).sortWithinPartitions(*core)
    names = (*content, "n", "first", "left", "right")
    hit = ", ".join(f"{c} long" for c in (*content, "a", "b"))  # windows a .. b of the content are repeated

    def refined(rows: list[tuple]) -> pa.RecordBatch:
        number: dict[tuple, int] = {}
        strings = [r[6] + _symbol(number.setdefault(r[:2], len(number))) + r[7] for r in rows]
        hits = repeated_windows(strings, FINE - 1 + 8, [r[4] for r in rows])
        out = [(*r[:4], a, b) for r, h in zip(rows, hits, strict=True) for a, b in _hit_ranges(h)]
        return _longs(out, hit) if out else _longs([(0,) * 6], hit).slice(1)

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if len(rows) > 10_000 and row[:2] != rows[-1][:2]:  # whole buckets only
                    yield refined(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield refined(rows)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for c1, c2, s1, s2, n, first, left, right in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                for a in range(FINE - first - len(left) - 1, len(right) - first + 1):
                    rows.append((c1, c2, s1, s2, a, *_halves(bytes([first + a]), left[a:], right[: first + a]), n))
                if len(rows) > 20_000:
                    yield _longs(rows, ", ".join(f"{c} long" for c in single))
                    rows = []
            if rows:
                yield _longs(rows, ", ".join(f"{c} long" for c in single))

    single = (*content, "a", "w1", "w2", "n")
    window = [*core, "w1", "w2"]
    many = materialise(distinct.join(too_many, core, "left_semi").select(*names).mapInArrow(windows, ", ".join(f"{c} long" for c in single)), "cell-windows")
    twice = materialise(many.groupBy(*window).agg(F.sum("n").alias("all")).where(F.col("all") > 1).select(*window), "cell-repeats")
    hits = materialise(few.select(*names).mapInArrow(refine, hit).union(many.join(twice, window, "left_semi").select(*content, "a", F.col("a").alias("b"))), "cell-hits")
    spans = all_.where("n = 1").select(*content, "key", "doc_id", "start").join(hits, content)
    return spans.select("key", "doc_id", (F.col("start") + F.col("a")).alias("start"), (F.col("start") + F.col("b") + length).alias("stop"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", texts: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with ``texts`` also ``kept``, the remaining bytes.

    Documents without a repeated window are finished where they are read; the others meet their spans in a join.
    """
    rows = _keyed(docs, id_col, text_col)
    spans = materialise(repeated_spans(rows, length, gram, hot).distinct(), "spans")
    listed = spans.groupBy("key", "doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    slots = _slots(spans)
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    clean = _in_slots(rows, slots, False).select("doc_id", "text", none.alias("spans"))
    other = _in_slots(rows, slots, True)
    joined = other.join(listed, other["key"].eqNullSafe(listed["key"]) & other["doc_id"].eqNullSafe(listed["doc_id"]), "left").select(other["doc_id"], "text", F.coalesce("spans", none).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in in_pieces(batches, "text", _PIECE):
            out = [[], [], [], [], [], []]
            for doc, text, own in zip(*(piece.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                kept, n_spans, at = [], 0, 0
                stop = -1
                for s in sorted((s["start"], s["stop"]) for s in own or ()):
                    if s[0] > stop:
                        n_spans += 1
                        kept.append(raw[at : s[0]])
                    stop = max(stop, s[1])
                    at = stop
                kept.append(raw[at:])
                rest = b"".join(kept)
                for column, value in zip(out, (doc, len(raw), len(raw) - len(rest), n_spans, hashlib.sha256(rest).hexdigest(), rest), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            width = len(names) if texts else len(names) - 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out[:width], kinds, strict=False)], names=names[:width])

    return clean.union(joined).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts)
