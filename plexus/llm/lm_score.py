"""Language-model scoring with a probabilistic suffix tree over words.

Tokens: a document's words after lower-casing A-Z, then one end. Counting covers every training document, by shuffles that combine
on the map side. A token is scored by the longest retained suffix of what stands before it: a context is retained if the next symbol's
distribution diverges from that after its suffix by ``divergence`` bits or more (or if a longer context that ends in it is retained), and its
distribution is smoothed with its suffix's, weighted by the number of different symbols seen after it (Witten-Bell).

The tree has two parts, and each context is in one of them:

* contexts of *common* words, those of at least ``p_symbol`` of all tokens: each of them alone, and up to ``depth`` of them together where the context makes up
  ``p_context`` of all tokens. They are few (1 / p_symbol, and 1 / p_context a depth, at most) and are sent to the workers, with pairs of at
  least ``p_entry`` of all tokens; rarer pairs lend their mass to the suffix's distribution. All other words are one class there, whose members
  share its probability in proportion to their smoothed counts;
* contexts that end in a *rare* word, from two occurrences on. Their number grows with the corpus, so they stay where Spark shuffles them:
  every occurrence of a rare word goes, packed with the others of its task, with what follows it, to the bucket of the word's hash. There
  the counts of the whole corpus for that word meet, its context is made and tested, and what follows is scored on the spot, on top of what
  the common contexts say; the word's own count is known there too. Rare words that follow are symbols of their own; where one was seen in the
  context, its count comes from a join. A rare word has less than ``p_symbol`` of all tokens, so no bucket is bound to one frequent word.

Every distribution sums to one. Counts of all words, common or rare, are exact. What the common contexts say is rounded to 1/2048 of a log10
on its way to a bucket.

Defined results: a null text counts as empty (its only token is the end); which rows teach is the caller's expression, null counts as no;
repeated rows each count and each get a row; with nothing to learn from every token has probability 1; an empty table gives an empty
result; extra columns are left behind.
"""

from __future__ import annotations

import math
import struct
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import in_pieces, materialise, ship

P_SYMBOL, P_CONTEXT, P_ENTRY = 5e-6, 1e-4, 1e-6
DEPTH, DIVERGENCE = 3, 0.02
#: Occurrences from which a context of the shuffled part is considered; tokens a bucket (about a quarter of them rare words).
LEAST, BUCKET = 2, 4_000_000

#: Places in the alphabet: 0 is never used, words follow LAST.
START, END, OTHER, LAST = 1, 2, 3, 3
_HELD = 400_000


def word_hash(word: bytes) -> int:
    """Signed 64-bit key of a word; the end has that of a space, which no word has."""
    h = xxh64_intdigest(word, 4)
    return h - (1 << 64) if h >> 63 else h


END_HASH = word_hash(b" ")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Level(NamedTuple):
    """Retained contexts of one length: sorted codes, divisors, weights of the suffix; and their entries, sorted by place * size + symbol."""

    codes: np.ndarray
    total: np.ndarray
    weight: np.ndarray
    pairs: np.ndarray
    seen: np.ndarray


class Tree(NamedTuple):
    places: dict[bytes, int]
    counts: np.ndarray
    tokens: int
    distinct: int
    other: float
    levels: list[Level]

    @property
    def whole(self) -> int:
        """What smoothed counts are divided by."""
        return self.tokens + self.distinct + 1

    @property
    def size(self) -> int:
        return len(self.counts)

    def root(self) -> np.ndarray:
        """Log10 probability of each symbol without context."""
        p = (self.counts + 1.0) / self.whole
        p[OTHER] = self.other
        return p


# -- counting --------------------------------------------------------------------------------------------------------


def _count_words(rows: DataFrame, p_symbol: float = P_SYMBOL) -> DataFrame:
    """(word, n, text): counts of all tokens, the end among them. ``text`` is there for every word of at least ``p_symbol`` of all tokens:
    such a word reaches that share in one of the batches that are counted apart, and only there its text is sent along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for piece in in_pieces(batches, "text"):
            texts = piece.column("text").to_pylist()
            for t in texts:
                held.update(words_of(t))
            held[b" "] += len(texts)
            if len(held) > _HELD:
                yield _counted(held, p_symbol)
                held.clear()
        if held:
            yield _counted(held, p_symbol)

    return rows.mapInArrow(run, "word long, n long, text binary").groupBy("word").agg(F.sum("n").alias("n"), F.max("text").alias("text"))


def _counted(held: Counter, p_symbol: float) -> pa.RecordBatch:
    least = p_symbol * held.total()
    texts = [w if n >= least else None for w, n in held.items()]
    return pa.RecordBatch.from_arrays([pa.array([word_hash(w) for w in held], pa.int64()), pa.array(list(held.values()), pa.int64()), pa.array(texts, pa.binary())], names=["word", "n", "text"])


def _symbols(texts: list[str | None], places: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of [start, words, end] per text, and the first position of each text and the end. ``places`` holds the common words."""
    get, flat, starts = places.get, [], [0]
    for t in texts:
        flat.append(START)
        flat += [get(w, OTHER) for w in words_of(t)]
        flat.append(END)
        starts.append(len(flat))
    return np.array(flat, dtype=np.int64), np.array(starts)


class _Rare:
    """Keys of the words that are not common; remembers them within a task."""

    def __init__(self, places: dict[bytes, int]) -> None:
        self.places, self.known = places, {}

    def keys(self, texts: list[str | None]) -> np.ndarray:
        if len(self.known) > _HELD:
            self.known.clear()
        places, get, new = self.places, self.known.get, self._new
        return np.array([get(w) or new(w) for t in texts for w in words_of(t) if w not in places], dtype=np.int64)

    def _new(self, word: bytes) -> int:
        h = self.known[word] = word_hash(word)
        return h


def _find(codes: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Place of each x in the sorted codes, or -1."""
    if not len(codes):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(codes, x), len(codes) - 1)
    return np.where(codes[at] == x, at, -1)


def _contexts(symbols: np.ndarray, depth: int, size: int) -> np.ndarray:
    """The code of the ``depth`` symbols before each position, or -1 where they don't lie in one text."""
    out = np.full(len(symbols), -1, np.int64)
    if len(symbols) <= depth:
        return out
    code = np.zeros(len(symbols) - depth, np.int64)
    bad = symbols[depth:] == START
    for k in range(depth):
        part = symbols[k : k + len(code)]
        code = code * size + part
        bad |= part == END
    out[depth:] = np.where(bad, -1, code)
    return out


def _count_pairs(rows: DataFrame, places: dict[bytes, int], codes: np.ndarray, depth: int, size: int) -> DataFrame:
    """(pair, n): how often a symbol follows a context; pair = place of the context * size + symbol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, waiting = [], [], 0
        for piece in in_pieces(batches, "text"):
            symbols = _symbols(piece.column("text").to_pylist(), places)[0]
            at = _find(codes, _contexts(symbols, depth, size))
            some = at >= 0
            k, n = np.unique(at[some] * size + symbols[some], return_counts=True)
            keys, counts, waiting = [*keys, k], [*counts, n], waiting + len(k)
            if waiting > 2_000_000:
                k, n = _merged(keys, counts)
                if len(k) > 1_000_000:
                    yield _pairs(k, n)
                    k, n = k[:0], n[:0]
                keys, counts, waiting = [k], [n], len(k)
        if keys:
            yield _pairs(*_merged(keys, counts))

    return rows.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _merged(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    k, where = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(where, np.concatenate(counts), len(k)).astype(np.int64)


def _pairs(k: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["pair", "n"])


def fit(training: DataFrame, vocabulary: DataFrame, p_symbol: float = P_SYMBOL, p_context: float = P_CONTEXT, p_entry: float = P_ENTRY, depth: int = DEPTH, divergence: float = DIVERGENCE) -> Tree | None:
    """``vocabulary``: (word, n) of the training rows, from ``_count_words``."""
    whole = vocabulary.agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("distinct")).first()
    tokens, distinct = whole["tokens"], whole["distinct"]
    if not tokens:
        return None
    common = vocabulary.where((F.col("n") >= max(2, p_symbol * tokens)) & (F.col("word") != END_HASH)).orderBy(F.desc("n"), "word").collect()  # 1 / p_symbol rows at most
    places = {bytes(r["text"]): LAST + 1 + k for k, r in enumerate(common)}
    ends = vocabulary.where(F.col("word") == END_HASH).first()["n"]
    counts = np.array([0, 0, ends, 0, *(r["n"] for r in common)], dtype=np.int64)
    size = len(counts)
    counts[OTHER] = tokens - counts.sum()
    n_rare = distinct - len(common) - 1
    other = (counts[OTHER] + n_rare + 1.0) / (tokens + distinct + 1.0)
    # contexts of length one: common symbols, the rest as one, and the start of a text
    before = counts.copy()
    before[START], before[END] = ends, 0
    codes = np.flatnonzero(before > 0).astype(np.int64)
    found: list[tuple] = []
    for d in range(1, depth + 1):
        if not len(codes):
            break
        least = max(2, p_entry * tokens)
        counted = (
            _count_pairs(training, places, codes, d, size)
            .withColumn("at", (F.col("pair") / size).cast("long"))
            .groupBy("at")
            .agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.collect_list(F.when(F.col("n") >= least, F.struct("pair", "n"))).alias("kept"))
            .toArrow()  # 1 / p_context rows with 1 / p_entry pairs at most
            .sort_by("at")
        )
        at = counted.column("at").to_numpy()
        total, kinds = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
        total[at], kinds[at] = counted.column("total").to_numpy(), counted.column("kinds").to_numpy()
        kept = counted.column("kept").combine_chunks().flatten()
        pair, n = kept.field("pair").to_numpy(), kept.field("n").to_numpy()
        order = np.argsort(pair)
        pair, n = pair[order], n[order]
        found.append((codes, total, kinds, pair, n))
        grown = (n >= p_context * tokens) & (pair % size != END)
        codes = np.sort(codes[pair[grown] // size] * size + pair[grown] % size)
    return Tree(places, counts, int(tokens), int(distinct), other, _retained(found, counts, size, divergence))


def _retained(found: list[tuple], counts: np.ndarray, size: int, divergence: float) -> list[Level]:
    """The divergence test, from the longest contexts to the shortest; a context that ends a retained one stays."""
    keep: list[np.ndarray] = [np.zeros(len(f[0]), bool) for f in found]
    for d in range(len(found) - 1, -1, -1):
        codes, total, _, pairs, seen = found[d]
        at, symbol = pairs // size, pairs % size
        p = seen / np.maximum(total[at], 1)
        if d:
            up_codes, up_total, _, up_pairs, up_seen = found[d - 1]
            up = _find(up_codes, codes % size**d)
            where = _find(up_pairs, up[at] * size + symbol)
            q = np.where((where >= 0) & (up[at] >= 0), up_seen[where] / np.maximum(up_total[up[at]], 1), 0)
        else:
            up = None
            q = counts[symbol] / counts.sum()
        q = np.where(q > 0, q, p)
        n = len(codes)
        bits = np.bincount(at, p * np.log2(p / q), n)
        rest_p, rest_q = np.maximum(1 - np.bincount(at, p, n), 0), np.maximum(1 - np.bincount(at, q, n), 1e-12)
        bits += np.where(rest_p > 0, rest_p * np.log2(np.maximum(rest_p, 1e-12) / rest_q), 0)
        keep[d] |= bits >= divergence
        if d and up is not None:
            mine = up[keep[d]]
            keep[d - 1][mine[mine >= 0]] = True
    levels = []
    for (codes, total, kinds, pairs, seen), kept in zip(found, keep, strict=True):
        at = pairs // size
        stored = np.bincount(at, seen, len(codes))
        new = np.cumsum(kept) - 1
        mine = kept[at]
        levels.append(Level(codes[kept], (total + kinds)[kept].astype(float), (kinds + total - stored)[kept].astype(float), new[at[mine]] * size + pairs[mine] % size, seen[mine].astype(float)))
    return levels


# -- scoring ---------------------------------------------------------------------------------------------------------


def symbol_scores(tree: Tree, symbols: np.ndarray) -> np.ndarray:
    """Probability of each symbol by the longest retained suffix of what stands before it."""
    p = tree.root()[symbols]
    alive = np.flatnonzero(symbols != START)
    for d, level in enumerate(tree.levels, 1):
        at = _find(level.codes, _contexts(symbols, d, tree.size)[alive])
        alive, at = alive[at >= 0], at[at >= 0]
        where = _find(level.pairs, at * tree.size + symbols[alive])
        seen = np.where(where >= 0, level.seen[where] if len(level.seen) else 0.0, 0.0)
        w = level.weight[at]
        p[alive] = (seen + w * p[alive]) / level.total[at]
    return p


# kind 0: a document; kind 1: the rare words of a piece of the input that belong to one bucket, with what follows them, packed
SCORED = "kind int, rid long, doc_id long, n_tokens long, n_common long, base_common double, model_part double, bucket long, n long, positions binary"
_NAMES = [x.split()[0] for x in SCORED.split(", ")]
_STEPS = 2048.0  # of a log10


def _packed(columns: list[np.ndarray]) -> bytes:
    """Columns of one length, byte planes apart so that they compress."""
    planes = b"".join(c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns)
    return pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int, kinds: list[str]) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    raw = np.frombuffer(pa.decompress(data, n * sum(sizes), codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


def _packed_positions(columns: list[np.ndarray]) -> bytes:
    """Occurrences that are sorted by word, in the order of unsigned numbers: each word once, as its distance to the one before, with its count."""
    word, *rest = columns
    word = word.view(np.uint64)
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    head = _packed([np.diff(word[first], prepend=np.uint64(0)), np.diff(np.append(first, len(word))).astype("<u4")])
    return struct.pack("<ii", len(first), len(head)) + head + _packed(rest)


def _unpacked_positions(data: bytes, n: int) -> list[np.ndarray]:
    words, size = struct.unpack_from("<ii", data)
    gaps, times = _unpacked(data[8 : 8 + size], words, ["<u8", "<u4"])
    return [np.repeat(np.cumsum(gaps, dtype=np.uint64).view(np.int64), times), *_unpacked(data[8 + size :], n, _POSITION)]


#: Of an occurrence, beside the word: what follows, the document's place in the piece (twice, plus one if it teaches), what the common contexts say of what follows.
_POSITION = ["<i8", "<u4", "<i2"]


def _score_symbols(rows: DataFrame, tree: Tree, buckets: int) -> DataFrame:
    """SCORED: one row a document, with what common contexts give, and the occurrences of rare words for their buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = _Rare(tree.places)
        rid = TaskContext.get().partitionId() << 36
        base = np.log10((tree.counts + 1.0) / tree.whole)
        base[[START, OTHER]] = 0.0
        shared = math.log10(tree.other)
        for piece in in_pieces(batches, "text"):
            texts = piece.column("text").to_pylist()
            symbols, starts = _symbols(texts, tree.places)
            n = piece.num_rows
            score = np.log10(symbol_scores(tree, symbols))
            is_rare = symbols == OTHER
            score[is_rare] -= shared  # a rare word's own share of the class comes with its count
            score[symbols == START] = 0.0
            known = (symbols != START) & ~is_rare
            owner = np.repeat(np.arange(n), np.diff(starts))
            exact = symbols.copy()
            exact[is_rare] = rare.keys(texts)
            at = np.flatnonzero(is_rare)
            teaches = piece.column("learn").to_numpy(zero_copy_only=False).astype(np.int64)
            doc = 2 * owner[at] + teaches[owner[at]]
            columns = [exact[at], exact[at + 1], doc.astype(np.uint32), np.round(score[at + 1] * _STEPS).clip(-32768, 32767).astype(np.int16)]
            score[at + 1] = 0.0
            total = lambda x: np.add.reduceat(x, starts[:-1]) if n else np.empty(0)  # noqa: B023, E731
            yield _scored(
                n,
                kind=pa.array(np.zeros(n, np.int32)),
                rid=pa.array(rid + np.arange(n), pa.int64()),
                doc_id=piece.column("doc_id"),
                n_tokens=pa.array(np.diff(starts) - 1, pa.int64()),
                n_common=pa.array(total(known.astype(np.int64)), pa.int64()),
                base_common=pa.array(total(base[symbols]), pa.float64()),
                model_part=pa.array(total(score), pa.float64()),
            )
            word = columns[0]
            bucket = ((word.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets
            order = np.lexsort((word.view(np.uint64), bucket))
            bucket, columns = bucket[order], [c[order] for c in columns]
            edges = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist() + [len(bucket)]
            packed = [_packed_positions([c[a:b] for c in columns]) for a, b in zip(edges, edges[1:], strict=False)]
            yield _scored(
                len(packed),
                kind=pa.array(np.ones(len(packed), np.int32)),
                rid=pa.array(np.full(len(packed), rid), pa.int64()),
                bucket=pa.array(bucket[edges[:-1]], pa.int64()),
                n=pa.array(np.diff(edges), pa.int64()),
                positions=pa.array(packed, pa.binary()),
            )
            rid += n

    return rows.mapInArrow(run, SCORED)


_KINDS = {"kind": pa.int32(), "base_common": pa.float64(), "model_part": pa.float64(), "positions": pa.binary()}


def _scored(many: int, /, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(many, _KINDS.get(c, pa.int64())) for c in _NAMES], names=_NAMES)


# -- contexts of rare words ------------------------------------------------------------------------------------------


def rare_contexts(word: np.ndarray, after: np.ndarray, learn: np.ndarray, said: np.ndarray, typical: float, n_symbols: int, divergence: float = DIVERGENCE, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, a, b) of each occurrence of a rare word: the word's count in training rows, and the probability of what follows it, a + b for a common
    symbol, a + b * q for a rare word of smoothed count share q.

    Occurrences are sorted by word and what follows; all of each word are there. ``said``: log10 probability by the common contexts, without
    q for rare words. ``typical``: a likely q, for the divergence test only.
    """
    first = np.append(True, word[1:] != word[:-1])
    pair_first = first | np.append(True, after[1:] != after[:-1])
    group, pair = np.cumsum(first) - 1, np.cumsum(pair_first) - 1
    n = np.bincount(group, learn, group[-1] + 1)
    seen = np.bincount(pair, learn, pair[-1] + 1)
    of = group[pair_first]  # each pair's context
    kinds = np.bincount(of, seen > 0, len(n))
    some = seen > 0
    q = np.bincount(pair, learn * said, len(seen))[some] / seen[some]
    head = after[pair_first][some]
    q = 10.0**q * np.where((head >= 0) & (head < n_symbols), 1.0, typical)
    p = seen[some] / n[of[some]]
    bits = np.bincount(of[some], p * np.log2(p / np.maximum(q, 1e-300)), len(n))
    kept = (n >= least) & (bits >= divergence)
    whole = np.maximum(n + kinds, 1)
    a = np.where(kept[group], seen[pair] / whole[group], 0.0)
    b = np.where(kept[group], (kinds / whole)[group], 1.0) * 10.0**said
    return n[group], a, b


PARTS = "rid long, n long, sums binary, word long, a float, b float"
_SUMS = ["<u4", "<u2", "<f8", "<f4"]  # the document's place, rare words that training knows, their log10 q, what follows them


def _score_buckets(scored: DataFrame, tree: Tree, divergence: float) -> DataFrame:
    """PARTS: per bucket and piece the sums of its documents, packed; and a row for each rare word that was seen after the rare word before it."""
    n_rare = max(tree.distinct - (tree.size - LAST - 1) - 1, 0)
    typical = tree.other / (n_rare + 1)
    size, divisor = tree.size, float(tree.whole)
    names = [x.split()[0] for x in PARTS.split(", ")]

    def parts(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        pieces = [_unpacked_positions(data, n) for _, _, n, data in rows]
        word, after, doc, said = (np.concatenate(c) for c in zip(*pieces, strict=True))
        rid = np.repeat(np.array([r[1] for r in rows], np.int64), [r[2] for r in rows])
        place = (doc >> 1).astype(np.int64)
        order = np.lexsort((place, rid, after, word))
        word, after, rid, place = word[order], after[order], rid[order], place[order]
        n, a, b = rare_contexts(word, after, (doc[order] & 1).astype(float), said[order] / _STEPS, typical, size, divergence)
        rare = (after < 0) | (after >= size)
        seen = rare & (a > 0)
        log = np.log10(np.where(rare, b, a + b))
        log[seen] = 0.0
        by = np.lexsort((place, rid))
        rid_, place_ = rid[by], place[by]
        first = np.flatnonzero(np.append(True, (rid_[1:] != rid_[:-1]) | (place_[1:] != place_[:-1])))
        add = lambda x: np.add.reduceat(x[by], first)
        # a document's occurrences in one bucket may be more than 65 535: then they are told in several entries
        known = add((n > 0).astype(np.int64))
        q, log = add(np.log10((n + 1.0) / divisor)), add(log)
        rid_, place_ = rid_[first], place_[first]
        columns = [place_.astype("<u4"), np.minimum(known, 65_535).astype("<u2"), q.astype("<f8"), log.astype("<f4")]
        edges = np.flatnonzero(np.diff(rid_, prepend=-1)).tolist() + [len(rid_)]
        told = [(rid_[x], y - x, _packed([c[x:y] for c in columns])) for x, y in zip(edges, edges[1:], strict=False)]
        over = known - 65_535
        while (over > 0).any():
            for k in np.flatnonzero(over > 0).tolist():
                told.append((rid_[k], 1, _packed([place_[k : k + 1].astype("<u4"), np.minimum(over[k : k + 1], 65_535).astype("<u2"), np.zeros(1), np.zeros(1, "<f4")])))
            over = over - 65_535
        m, k = len(told), int(seen.sum())
        none = lambda k, kind: pa.nulls(k, kind)
        yield pa.RecordBatch.from_arrays([pa.array([int(t[0]) for t in told], pa.int64()), pa.array([int(t[1]) for t in told], pa.int64()), pa.array([t[2] for t in told], pa.binary()), none(m, pa.int64()), none(m, pa.float32()), none(m, pa.float32())], names=names)
        yield pa.RecordBatch.from_arrays([pa.array(rid[seen] + place[seen]), none(k, pa.int64()), none(k, pa.binary()), pa.array(after[seen]), pa.array(a[seen].astype(np.float32)), pa.array(b[seen].astype(np.float32))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "rid", "n", "positions")), strict=True):
                if rows and row[0] != rows[-1][0]:
                    yield from parts(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield from parts(rows)

    packed = scored.where("kind = 1").select("bucket", "rid", "n", "positions")
    return packed.repartition("bucket").sortWithinPartitions("bucket", "rid").mapInArrow(run, PARTS)


def _document_sums(parts: DataFrame) -> DataFrame:
    """(rid, known, rare_score, after_rare): the sums over all buckets of each document."""
    shape = "rid long, known long, rare_score double, after_rare double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = -1, np.zeros((3, 0))

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(at + np.arange(sums.shape[1]), pa.int64()), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], names=[x.split()[0] for x in shape.split(", ")])

        for batch in batches:
            for rid, n, data in zip(*(batch.column(c).to_pylist() for c in ("rid", "n", "sums")), strict=True):
                place, *columns = _unpacked(data, n, _SUMS)
                if rid != at:
                    if at >= 0:
                        yield done()
                    at, sums = rid, np.zeros((3, 0))
                more = int(place[-1]) + 1 - sums.shape[1]
                if more > 0:
                    sums = np.concatenate([sums, np.zeros((3, more))], axis=1)
                sums[:, place] += np.array(columns)
        if at >= 0:
            yield done()

    # a piece of the input is some megabytes of text, so its sums are few
    return parts.where("sums IS NOT NULL").select("rid", "n", "sums").repartition("rid").sortWithinPartitions("rid", "n").mapInArrow(run, shape)


def score(docs: DataFrame, learn: Column, **limits) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``; ``learn``, over its columns, says which rows to learn from.

    base_score: each token by its smoothed count alone. score: log10 probability under the tree.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    training = rows.where("learn").select("doc_id", "text")
    vocabulary = materialise(_count_words(training, limits.get("p_symbol", P_SYMBOL)), "vocabulary")
    tree = fit(training, vocabulary, **limits)
    if tree is None:
        spaces = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long") + 1
        return rows.select("doc_id", spaces.alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0).cast("long").alias("train_tokens"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"))
    # written once and read from there, so that the rows' numbers are the same for all who read them
    scored = materialise(_score_symbols(rows, tree, 1 + tree.tokens // BUCKET), "scored")
    parts = materialise(_score_buckets(scored, tree, limits.get("divergence", DIVERGENCE)), "scored-buckets")
    q = (F.coalesce("n", F.lit(0)) + 1.0) / F.lit(float(tree.whole))
    seen = (
        parts.where("word IS NOT NULL").select("rid", "word", "a", "b")
        .join(vocabulary.select("word", "n"), "word", "left")
        .groupBy("rid")
        .agg(F.sum(F.log10(F.col("a").cast("double") + F.col("b").cast("double") * q) - F.log10(q)).alias("seen_score"))
    )
    done = scored.where("kind = 0").select("rid", "doc_id", "n_tokens", "n_common", "base_common", "model_part")
    zero = F.lit(0.0)
    extra = F.coalesce("rare_score", zero)
    return done.join(_document_sums(parts), "rid", "left").join(seen, "rid", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_common") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(tree.tokens).cast("long").alias("train_tokens"),
        (F.col("base_common") + extra).alias("base_score"),
        (F.col("model_part") + extra + F.coalesce("after_rare", zero) + F.coalesce("seen_score", zero)).alias("score"),
    )
