"""Best-fit packing of tokenised documents into sequences of at most ``capacity`` tokens, by linear grouping.

A document is its token ids and an end id. Only documents longer than a sequence are cut, into pieces of full length; their first
piece may be shorter. All pieces are then packed:

1. Pieces longer than a share of the capacity (see SHARES) are ordered by length and split into ``groups`` groups of equal cardinality; each
   piece counts as long as the longest of its group. Full pieces are sequences of their own.
2. The few rounded lengths make a cutting-stock problem: configurations (how many of each length a sequence takes) come from column
   generation, a knapsack a step, and each is used as often as the linear program says, rounded down.
3. Actual pieces take the places of their group's rounded ones, which leaves each sequence its real room.
4. The large pieces that rounding down left over and then the small ones go, longest first, where they fit best; sequences are opened when nothing fits.

All of this needs only how many pieces each length has, at most ``capacity`` numbers: the driver plans on runs of equal sequences and
equal lengths, in time and memory bounded by ``capacity`` and ``groups`` and not by the rows. A plan row says where the pieces of one length
and a range of numbers go. Executors tokenise, number the pieces of each length (a count a task and length, then a running sum over
tasks) and look their place up in the plan.

Tokenising: a run of white space belongs to what follows it, so pretokens never reach across the start of such a run; nor across a place where
letters of Latin and other characters of ASCII meet, apostrophes aside. Texts are cut at these places. A worker keeps the ids of the cuts it has
seen, the library encodes the rest: a run of Latin letters, with a space before it or none, is one pretoken, so its bytes go to the library's model itself. The library's
own threads are off, as Spark deals out the work: on short lists they took twice the CPU time.

Defined results: a null text counts as empty, an empty one is its end id alone; null and repeated ids are rows like any other; equal
rows get a place each; an empty table gives an empty result; extra columns are left behind. A string of a special token inside a text is
what the library makes of it by default, that token.
"""

from __future__ import annotations

import os
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ids_and_texts, in_pieces, materialise

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
CAPACITY, END = 1024, 2
#: Lengths above one of these shares of the capacity are grouped, into GROUPS groups; the share that gives the fewest sequences stays.
SHARES, GROUPS = (1 / 2, 2 / 5, 1 / 3), 64
#: Cuts whose ids a worker keeps, and the longest of them.
CACHE, LONGEST = 300_000, 40

_LETTER, _OTHER = "A-Za-zÀ-ÖØ-öø-ſ", r"!-&(-@\[-`{-~"  # letters of Latin; ASCII without letters, apostrophe and white space
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PLAIN = re.compile(rf" ?[{_LETTER}]+").fullmatch
_PARTS = re.compile(rf"[{_SPACE}]*+(?:[{_LETTER}]++(?=[{_SPACE}{_OTHER}]|\Z)|[{_OTHER}]++(?=[{_SPACE}{_LETTER}]|\Z)|[^{_SPACE}]++)|[{_SPACE}]++").findall


class Encoder:
    """Texts to ids (little-endian unsigned 32-bit), as the library encodes the whole text."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        # the characters by which a byte-level model goes; other tokenizers get no parts of their own
        self.byte_chars = _byte_chars() if isinstance(self.model.pre_tokenizer, pre_tokenizers.ByteLevel) and self.model.normalizer is None else None
        self.special = [x.content for x in self.model.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _told(self, parts: list[str]) -> dict[str, bytes]:
        plain = [x for x in parts if _PLAIN(x)] if self.byte_chars else []
        word, chars = self.model.model.tokenize, self.byte_chars
        told = {x: np.array([t.id for t in word(x.encode().decode("latin-1").translate(chars))], "<u4").tobytes() for x in plain}
        rest = [x for x in parts if x not in told]
        told.update(zip(rest, self._encode(rest), strict=True))
        return told

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(x in text for x in self.special):
            return self._encode([text])[0]
        parts = _PARTS(text)
        ids = list(map(self.known.get, parts))
        if None in ids:
            new = list({x for x, i in zip(parts, ids, strict=True) if i is None})
            told = self._told(new)
            if len(self.known) < CACHE:
                self.known.update((x, i) for x, i in told.items() if len(x) <= LONGEST)
            ids = [told[x] if i is None else i for x, i in zip(parts, ids, strict=True)]
        return b"".join(ids)


def _byte_chars() -> dict[int, str]:
    """The character that stands for each byte: printable ones for themselves, the others from U+0100 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(own)))}


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One a worker, with what it has seen."""
    return Encoder(path)


_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, k long"


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents; ``k`` numbers those of a length within the task ``part``. With ``with_ids`` their ids too."""
    schema = _PIECES + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode, seen, stop = TaskContext.get().partitionId(), encoder(tokenizer), [0] * (capacity + 1), np.array([end], "<u4").tobytes()
        for batch in in_pieces(batches, "text"):
            rows, parts = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = encode(text) + stop
                n = len(data) // 4
                bounds = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for p, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    rows.append((doc_id, p, a, b - a, crc32(data[4 * a : 4 * b]), part, seen[b - a]))
                    seen[b - a] += 1
                    if with_ids:
                        parts.append(np.frombuffer(data, "<i4", b - a, 4 * a))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
            if with_ids:
                columns.append(pa.array(parts, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    return ids_and_texts(docs).mapInArrow(run, schema)


# -- the plan --------------------------------------------------------------------------------------------------------


def configurations(sizes: list[int], demands: list[int], capacity: int) -> list[tuple[np.ndarray, float]]:
    """(how many of each size, how often): a basic solution of the cutting-stock linear program, by column generation."""
    g = len(sizes)
    size, need = np.array(sizes), np.array(demands, float)
    basis = np.diag(capacity // size).astype(float)
    x = need / np.diag(basis)
    for _ in range(60 * g):
        price = np.linalg.solve(basis.T, np.ones(g))
        column = _knapsack(size, price, capacity)
        if column @ price <= 1 + 1e-9:
            break
        way = np.linalg.solve(basis, column)
        ratio = np.where(way > 1e-9, x / np.where(way > 1e-9, way, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x = np.maximum(x - step * way, 0)
        basis[:, out], x[out] = column, step
    return [(basis[:, j].astype(int), float(x[j])) for j in range(g)]


def _knapsack(size: np.ndarray, price: np.ndarray, capacity: int) -> np.ndarray:
    """The dearest multiset of sizes that a sequence takes."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    least = int(size.min())
    for room in range(least, capacity + 1):
        fits = size <= room
        value = np.where(fits, best[np.where(fits, room - size, 0)] + price, -np.inf)
        j = int(value.argmax())
        if value[j] > best[room - 1] + 1e-12:
            best[room], took[room] = value[j], j
        else:
            best[room] = best[room - 1]
    out, room = np.zeros(len(size)), capacity
    while room >= least:
        if took[room] < 0:
            room -= 1
        else:
            out[took[room]] += 1
            room -= int(size[took[room]])
    return out


@dataclass
class _Bins:
    """Sequences ``first`` to ``first + n - 1``, all filled up to the same place."""

    first: int
    n: int
    used: int


class _Plan:
    """Rows (length, low, high, each, sequence, offset): pieces of that length numbered low to high - 1 go, ``each`` to a sequence, to
    sequences from ``sequence`` on, from ``offset`` on."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.sequences, self.rows = capacity, 0, []
        self.room: list[deque[_Bins]] = [deque() for _ in range(capacity + 1)]

    def open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def put(self, length: int, low: int, bins: _Bins, each: int) -> None:
        """Fill all of ``bins`` and keep them for what comes."""
        self.rows.append((length, low, low + bins.n * each, each, bins.first, bins.used))
        used = bins.used + each * length
        self.room[self.capacity - used].append(_Bins(bins.first, bins.n, used))

    def best_fit(self, length: int, low: int, count: int) -> None:
        """Pieces of one length, each where the least room is left: that fills a sequence before the next is touched."""
        room = length
        while count:
            while room <= self.capacity and not self.room[room]:
                room += 1
            if room > self.capacity:
                each = min(self.capacity // length, count)
                bins = _Bins(self.open(count // each), count // each, 0)
            else:
                bins, each = self.room[room].popleft(), min(room // length, count)
                n = min(bins.n, count // each)
                if n < bins.n:
                    self.room[room].appendleft(_Bins(bins.first + n, bins.n - n, bins.used))
                bins = _Bins(bins.first, n, bins.used)
            self.put(length, low, bins, each)
            low, count = low + bins.n * each, count - bins.n * each


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[np.ndarray, int]:
    """The plan's rows and its number of sequences, for so many pieces of each length."""
    return min((_grouped(counts, capacity, int(capacity * share), groups) for share in SHARES), key=lambda x: x[1])


def _grouped(counts: dict[int, int], capacity: int, large: int, groups: int) -> tuple[np.ndarray, int]:
    to = _Plan(capacity)
    if counts.get(capacity):
        to.rows.append((capacity, 0, counts[capacity], 1, to.open(counts[capacity]), 0))
    lengths = sorted((x for x in counts if x < capacity and counts[x]), reverse=True)
    grouped = [x for x in lengths if x > large]
    given = dict.fromkeys(lengths, 0)
    total = sum(counts[x] for x in grouped)
    if total:
        # runs of each group: (length, pieces); groups of one rounded length are one
        cuts = [total * k // groups for k in range(1, groups + 1)]
        members: dict[int, list[list[int]]] = {}
        at, top = 0, grouped[0]
        for x in grouped:
            left = counts[x]
            while left:
                while cuts[0] <= at:
                    cuts.pop(0)
                    top = x
                n = min(left, cuts[0] - at)
                members.setdefault(top, []).append([x, n])
                at, left = at + n, left - n
        sizes = list(members)
        for config, often in configurations(sizes, [sum(n for _, n in members[s]) for s in sizes], capacity):
            n = int(often + 1e-6)
            slots = [s for s, a in zip(sizes, config.tolist(), strict=True) for _ in range(a)]
            n = min([n, *(sum(m for _, m in members[s]) // slots.count(s) for s in set(slots))])
            if n <= 0:
                continue
            first, taken = to.open(n), []
            for s in slots:  # each place of the configuration takes the next pieces of its group, in order
                runs, need = [], n
                while need:
                    run = members[s][0]
                    m = min(need, run[1])
                    runs.append((run[0], given[run[0]], n - need, n - need + m))
                    given[run[0]] += m
                    run[1] -= m
                    need -= m
                    if not run[1]:
                        members[s].pop(0)
                taken.append(runs)
            bounds = sorted({x for runs in taken for r in runs for x in r[2:]})
            for a, b in zip(bounds, bounds[1:], strict=False):
                used = 0
                for runs in taken:
                    length, low, lo, _ = next(r for r in runs if r[2] <= a < r[3])
                    to.rows.append((length, low + a - lo, low + b - lo, 1, first + a, used))
                    used += length
                to.room[capacity - used].append(_Bins(first + a, b - a, used))
    for x in lengths:
        to.best_fit(x, given[x], counts[x] - given[x])
    return np.array(sorted(to.rows), np.int64).reshape(-1, 6), to.sequences


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end: int = END, groups: int = GROUPS, with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence and its place there; columns of ``pieces`` but ``part`` and ``k``, then sequence_id and offset."""
    cut = materialise(pieces(docs, tokenizer, capacity, end, with_ids), "pieces")
    each = materialise(cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(each.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "piece-starts")
    rows, _ = plan(counts, capacity, groups)
    names = [x for x in cut.columns if x not in ("part", "k")]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in cut.select(*names).schema), "sequence_id long, offset long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (rows[:, 0] << 44) + rows[:, 1]
        for batch in batches:
            length, number = batch.column("length").to_numpy().astype(np.int64), batch.column("number").to_numpy()
            row = rows[np.searchsorted(keys, (length << 44) + number, "right") - 1] if batch.num_rows else rows[:0]
            nth, within = np.divmod(number - row[:, 1], row[:, 3]) if batch.num_rows else (number, number)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(row[:, 4] + nth), pa.array(row[:, 5] + within * length)], names=[*names, "sequence_id", "offset"])

    return cut.join(starts, ["length", "part"]).select(*names, (F.col("k") + F.col("before")).alias("number")).mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves; ``packed`` was made ``with_ids``. One row gathers a sequence, bounded by the capacity."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(inside, lambda x: x["ids"])).alias("ids"))
