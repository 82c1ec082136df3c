"""SentencePiece (merge type) encoding with seeded merge dropout, and lossless decoding.

The agenda holds the candidate merges of a unit, best score first, leftmost first among equals. With dropout, a candidate that comes
up is skipped where a keyed hash of (seed, document id, place of the unit in the text, position, piece) falls below the rate; a
skipped pair stays apart unless one of its sides grows. Without dropout the pieces are those of the library. Each occurrence of a
word draws for itself, and every run gives the same pieces. A worker keeps, for units that it has met more than once, the pieces without dropout and the candidates that
come up on the way to them: an occurrence that skips none of these has these pieces, any other, and the first of a unit, is cut with its own draws.

No piece holds a space behind another character, or a line end, so texts are cut in front of runs of spaces and around line ends into
units that are encoded on their own. The model is an existing file, never trained here. Its path must be readable where the code runs.

Decoding gives back the exact text: characters outside the vocabulary go by their bytes, and so does U+2581, with which the
library would confuse a space.

Defined results: a null text gives null pieces and decodes to null; an empty text has no pieces; repeated rows each get a row
(equal ids give equal pieces); a null id counts as the text "None"; an empty table gives an empty result; extra columns are left behind.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import ids_and_texts, map_texts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
RATE, SEED = 0.1, 2
#: Units kept in a worker; those longer than LONGEST are cut anew each time. Occurrences that draw at once.
CACHE, LONGEST, AT_ONCE = 150_000, 40, 100_000

_UNITS = re.compile("\n|▁| *[^ \n▁]+| +").findall
_MASK = (1 << 64) - 1
_LAST = 1 << 30
_A, _B, _C = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9


class Codec:
    """The vocabulary of a model file; a space stands for the model's U+2581."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.vocab_size()
        self.bytes = [0] * 256
        self.rank: dict[str, int] = {}
        self.place: dict[str, int] = {}  # in the order of scores
        scores = {x: k for k, x in enumerate(sorted({-sp.get_score(i) for i in range(n)}))}
        self.raw: list[bytes] = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[value] = i
                self.raw.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(b"")
            else:
                own = piece.replace("▁", " ")
                self.rank[own], self.place[own] = i, scores[-sp.get_score(i)]
                self.raw.append(own.encode())
        if any(re.search("[^ ] |\n", p) for p in self.rank):
            raise ValueError("the model has pieces across words or lines; units can't be encoded on their own")
        self.cuts: list[tuple[bytes, bytes]] = []  # pieces, draws
        self.known: dict[str, int] = {}
        self.met: set[str] = set()  # once, and not kept yet

        self._build_pairs()

    def _build_pairs(self) -> None:
        """A hash table (left symbol, right symbol) -> place and id of the piece they make; symbols are pieces, or characters without one."""
        inside = {c for p in self.rank for c in p if c not in self.rank}
        self.loose = {c: len(self.raw) + k for k, c in enumerate(sorted(inside))}
        number = self.rank | self.loose
        self.other = len(self.raw) + len(inside)  # any character of no piece
        self.chars = np.full(0x110000, self.other, np.int32)
        for c, k in number.items():
            if len(c) == 1:
                self.chars[ord(c)] = k
        pairs = [(number[p[:k]] << 32 | number[p[k:]], self.place[p], i) for p, i in self.rank.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        self.bits = max(len(pairs), 1).bit_length() + 2
        self.keys, self.places, self.ids = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _LAST, np.int32), np.full(1 << self.bits, -1, np.int32)
        for key, place, i in pairs:
            slot = (key * _A & _MASK) >> (64 - self.bits)
            while self.keys[slot] != -1:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.keys[slot], self.places[slot], self.ids[slot] = key, place, i

    def _merge(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and id of the piece that each pair makes; _LAST and -1 without one."""
        key = left.astype(np.int64) << 32 | right
        slot = ((key.view(np.uint64) * np.uint64(_A)) >> np.uint64(64 - self.bits)).astype(np.int64)
        have = self.keys[slot]
        open_ = np.flatnonzero((have != key) & (have != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            have = self.keys[slot[open_]]
            open_ = open_[(have != key[open_]) & (have != -1)]
        return self.places[slot], self.ids[slot]

    def _base(self, unit: str, key: int) -> int:
        return xxh64_intdigest(unit.encode("utf-8", "surrogatepass"), key)

    def unit(self, unit: str, rate: float = 0.0, key: int = 0) -> list[int]:
        """The pieces of one unit."""
        if unit == "▁":
            return [self.bytes[b] for b in unit.encode()]
        limit = int(rate * (1 << 64))
        return self._named(s for s in self._long(unit, limit, self._base(unit, key) if limit else 0) if s)

    def _named(self, symbols) -> list[int]:
        out: list[int] = []
        for s in symbols:
            i = self.rank.get(s)
            if i is not None:
                out.append(i)
            else:
                out.extend(self.bytes[b] for b in s.encode("utf-8", "surrogatepass"))
        return out

    def units(self, units: list[str], rate: float = 0.0, key: int = 0) -> dict[str, bytes]:
        """The pieces of many units, packed: their agendas advance together, one candidate a unit and round."""
        out: dict[str, bytes] = {}
        short = []
        for u in units:
            if len(u) > LONGEST or u == "▁":
                out[u] = _packed(self.unit(u, rate, key))
            else:
                short.append(u)
        limit = int(rate * (1 << 64))
        for width, part in _by_width(short):
            bases = np.array([self._base(u, key) for u in part], np.uint64) if limit else None
            out.update(zip(part, self._together(part, width, limit, bases), strict=True))
        return out

    def _together(self, units: list[str], width: int, limit: int, base: np.ndarray | None, trace: list | None = None) -> list[bytes]:
        """``base`` has one number a unit if there is a limit; ``trace`` takes (unit, draw) of the candidates that come up."""
        n = len(units)
        size = np.fromiter(map(len, units), np.int16, n)
        columns = np.arange(width, dtype=np.int16)  # of one type with what it is compared with, or numpy converts whole arrays in each round
        symbols = np.full((n, width), self.other, np.int32)
        symbols[columns < size[:, None]] = self.chars[np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)]
        agenda = np.full((n, width), _LAST, np.int32)
        agenda[:, :-1] = self._merge(symbols[:, :-1].ravel(), symbols[:, 1:].ravel())[0].reshape(n, width - 1)
        agenda[columns + 1 >= size[:, None]] = _LAST
        held = symbols << 8 | columns  # a symbol and where it begins, below LONGEST: moved together
        done, done_size = np.empty_like(held), np.empty_like(size)
        base = np.zeros(n, np.uint64) if base is None else base
        who, last = np.arange(n), np.int32(_LAST)
        while len(who):
            m = np.arange(len(who))
            k = agenda.argmin(axis=1)
            best = agenda[m, k]
            over = best == _LAST
            if 4 * over.sum() >= len(who):  # put aside what is finished
                done[who[over]], done_size[who[over]] = held[over], size[over]
                held, agenda, size, base, who = (x[~over] for x in (held, agenda, size, base, who))
                continue
            merge = ~over
            at = (held[m, k] & 255).astype(np.uint64)
            if trace is not None:
                draw = at * np.uint64(_A) ^ best.astype(np.uint64) * np.uint64(_B)
                trace.append((who[merge], draw[merge]))
            if limit:
                h = (base ^ at * np.uint64(_A) ^ best.astype(np.uint64) * np.uint64(_B)) * np.uint64(_C)
                merge &= h >= np.uint64(min(limit, _MASK))
            agenda[m, k] = last  # skipped, unless merged below
            # the columns behind a merged pair move up by one
            behind = columns >= np.where(merge, k, width).astype(np.int16)[:, None]
            agenda[:, :-1] = np.where(behind[:, :-1], agenda[:, 1:], agenda[:, :-1])
            rows, k = m[merge], k[merge]
            new = self._merge(held[rows, k] >> 8, held[rows, k + 1] >> 8)[1]
            behind[rows, k] = False
            held[:, :-1] = np.where(behind[:, :-1], held[:, 1:], held[:, :-1])
            held[rows, k] = new << 8 | at[merge].astype(np.int32)
            size[rows] -= 1
            has = k > 0
            agenda[rows[has], k[has] - 1] = self._merge(held[rows[has], k[has] - 1] >> 8, new[has])[0]
            has = k + 1 < size[rows]
            agenda[rows[has], k[has]] = self._merge(new[has], held[rows[has], k[has] + 1] >> 8)[0]
            agenda[rows[~has], k[~has]] = _LAST
        symbols, at, size = done >> 8, done & 255, done_size
        plain = (np.where(columns < size[:, None], symbols, 0) < len(self.raw)).all(axis=1).tolist()
        raw, row = symbols.astype(np.int32).tobytes(), 4 * width
        out = [raw[j : j + 4 * m] for j, m in zip(range(0, n * row, row), size.tolist(), strict=True)]
        for j in [j for j, ok in enumerate(plain) if not ok]:
            places = [*at[j, : size[j]].tolist(), len(units[j])]
            out[j] = _packed(self._named(units[j][x:y] for x, y in zip(places, places[1:], strict=False)))
        return out

    def _long(self, unit: str, limit: int, base: int) -> list[str]:
        """The same with a heap, for units of any length."""
        rank, symbols = self.place, list(unit)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(rank[p], k, len(p)) for k, p in enumerate(map("".join, zip(symbols, symbols[1:], strict=False))) if p in rank]
        heapify(agenda)
        while agenda:
            best, k, length = heappop(agenda)
            left = symbols[k]
            if not left or (j := after[k]) >= n or len(left) + len(symbols[j]) != length:
                continue  # one of its sides has changed
            if limit and ((base ^ k * _A ^ best * _B) * _C & _MASK) < limit:
                continue  # skipped
            symbols[k] = left = left + symbols[j]
            symbols[j] = ""
            after[k] = nxt = after[j]
            if nxt < n:
                before[nxt] = k
                if (pair := left + symbols[nxt]) in rank:
                    heappush(agenda, (rank[pair], k, len(pair)))
            if (p := before[k]) >= 0 and (pair := symbols[p] + left) in rank:
                heappush(agenda, (rank[pair], p, len(pair)))
        return symbols

    def _cut(self, units: list[str]) -> None:
        """Keeps, per unit, its pieces without dropout and the draws of the candidates that come up on the way."""
        for u in [u for u in units if u == "▁"]:
            self.cuts.append((_packed(self.unit(u)), b""))
            self.known[u] = len(self.cuts) - 1
        for width, part in _by_width([u for u in units if u != "▁"]):
            trace: list[tuple[np.ndarray, np.ndarray]] = []
            pieces = self._together(part, width, 0, None, trace)
            who, draw = (np.concatenate([t[i] for t in trace]) if trace else np.empty(0, np.uint64) for i in (0, 1))
            raw, ends = draw[np.argsort(who, kind="stable")].tobytes(), (8 * np.cumsum(np.bincount(who.astype(np.int64), minlength=len(part)))).tolist()
            self.known.update(zip(part, range(len(self.cuts), len(self.cuts) + len(part)), strict=True))
            self.cuts += [(ids, raw[y:z]) for ids, y, z in zip(pieces, [0, *ends], ends, strict=False)]

    def occurrences(self, units: list[str], bases: np.ndarray, rate: float) -> list[bytes]:
        """The pieces of each occurrence of a unit, packed; each one draws by its own base."""
        limit, known, cuts = int(rate * (1 << 64)), self.known, self.cuts
        if len(cuts) > CACHE:
            known.clear()
            cuts.clear()
        if len(self.met) > CACHE:
            self.met.clear()
        often = [(u, n) for u, n in Counter(units).items() if u not in known and len(u) <= LONGEST]
        once = {u for u, n in often if n == 1 and u not in self.met and u != "▁"} if limit else set()
        self._cut([u for u, _ in often if u not in once])
        self.met |= once
        self.met.difference_update(u for u, _ in often if u not in once)
        get = known.get
        cut = np.fromiter(map(get, units, repeat(-1)), np.int64, len(units))
        out = [cuts[k][0] if k >= 0 else b"" for k in cut.tolist()]
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        skips = np.flatnonzero((cut < 0) & (sizes <= LONGEST))
        for n in np.flatnonzero((cut < 0) & (sizes > LONGEST)).tolist():
            out[n] = _packed(self._named(s for s in self._long(units[n], limit, int(bases[n])) if s))
        if not limit:
            return out
        some, which = np.unique(cut, return_inverse=True)
        raw = [cuts[k][1] if k >= 0 else b"" for k in some.tolist()]
        each = np.array([len(r) // 8 for r in raw], np.int64)
        draws, left = np.frombuffer(b"".join(raw), np.uint64), each[which]
        who = np.repeat(np.arange(len(units)), left)
        step = np.arange(len(who)) - np.repeat(np.cumsum(left) - left - (np.cumsum(each) - each)[which], left)
        skipped = np.zeros(len(units), bool)
        skipped[who[((bases[who] ^ draws[step]) * np.uint64(_C)) < np.uint64(min(limit, _MASK))]] = True
        skips = np.r_[skips, np.flatnonzero(skipped)]
        for width, part in _by_width(skips.tolist(), sizes[skips]):
            for n, ids in zip(part, self._together([units[n] for n in part], width, limit, bases[part]), strict=True):
                out[n] = ids
        return out

    def encode(self, text: str, rate: float = 0.0, seed: int = SEED, variant: int = 0) -> list[int]:
        return np.frombuffer(self.encode_many([text], rate, seed, [variant])[0], np.int32).tolist()

    def encode_many(self, texts: list[str | None], rate: float, seed: int, keys: list[int]) -> list[bytes | None]:
        """The pieces of many texts, each packed as 32-bit numbers; each one's key, beside the seed, is given."""
        out: list[list[bytes]] = [[] for _ in texts]
        units: list[str] = []
        bases: list[np.ndarray] = []
        owners: list[tuple[int, int]] = []

        def flush() -> None:
            done, at = self.occurrences(units, np.concatenate(bases), rate), 0
            for owner, n in owners:
                out[owner].append(b"".join(done[at : at + n]))
                at += n
            units.clear()
            bases.clear()
            owners.clear()

        for k, t in enumerate(texts):
            own = _UNITS(" " + t) if t else []
            base = _bases(xxh64_intdigest(str(keys[k]), seed), len(own))
            for x in range(0, len(own), AT_ONCE):
                part = own[x : x + AT_ONCE]
                units += part
                bases.append(base[x : x + AT_ONCE])
                owners.append((k, len(part)))
                if len(units) >= AT_ONCE:
                    flush()
        if units:
            flush()
        return [None if t is None else b"".join(x) for t, x in zip(texts, out, strict=True)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


def _by_width(items: list, sizes: np.ndarray | None = None) -> Iterator[tuple[int, list]]:
    """Width and items of about one length, in blocks."""
    sizes = np.fromiter(map(len, items), np.int64, len(items)) if sizes is None else sizes
    half = (sizes + 1) // 2
    order = np.argsort(half, kind="stable")
    ends = np.cumsum(np.bincount(half)).tolist()
    for k, (start, end) in enumerate(zip([0, *ends], ends, strict=False)):
        for x in range(start, end, 20_000):
            yield 2 * k, [items[n] for n in order[x : min(x + 20_000, end)].tolist()]


def _bases(key: int, n: int) -> np.ndarray:
    """The base of each unit of a text, by its place."""
    z = np.uint64(key) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_A)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(_C)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(_B)
    return z ^ (z >> np.uint64(31))


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()


_OPEN: dict[tuple, Codec] = {}


def codec(model: str = MODEL, rate: float = RATE, seed: int = SEED) -> Codec:
    """One codec, with its cache, per worker process and setting."""
    if (model, rate, seed) not in _OPEN:
        _OPEN.clear()
        _OPEN[model, rate, seed] = Codec(model)
    return _OPEN[model, rate, seed]


def encode(docs: DataFrame, model: str = MODEL, rate: float = RATE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) and lossless (the ids decode to the text), for every row."""

    def make():
        c = codec(model, rate, seed)

        def work(ids: list, texts: list) -> dict:
            found = c.encode_many(texts, rate, seed, ids)
            same = [t is None or c.decode(np.frombuffer(f, np.int32).tolist()) == t for f, t in zip(found, texts, strict=True)]
            offsets = np.concatenate([[0], np.cumsum([len(f or ()) // 4 for f in found])]).astype(np.int32)
            flat = np.frombuffer(b"".join(f for f in found if f), np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array([f is None for f in found]))
            return {"doc_id": pa.array(ids, pa.int64()), "ids": lists, "lossless": same}

        return work

    return map_texts(ids_and_texts(docs, id_col, text_col), make, "doc_id long, ids array<int>, lossless boolean")


def decode(rows: DataFrame, model: str = MODEL, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """doc_id and text from doc_id and ids."""

    def run(batches):
        c = codec(model, rate, seed)
        for batch in batches:
            texts = [None if x is None else c.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
