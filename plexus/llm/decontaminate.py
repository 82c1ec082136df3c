"""Benchmark decontamination: size-partitioned MinHash containment search.

An item is found in a document if at least ``threshold`` of the item's distinct word shingles (five words) occur in it, however
long the document is. Each item keeps a bottom-k MinHash sketch, the SPARE * k smallest hashes of its shingles. Items are partitioned by
their number of shingles into classes (doubling widths), and k = floor((1 - threshold) * u) + 1 for a class of at most u
shingles: a document that holds the threshold misses fewer than k of the item's shingles, so it holds one of any k of them at
least, and the search loses nothing. The k are chosen from a sketch of SPARE * k: those that the fewest items have, so that a passage that
many items begin with does not make each document with it a candidate of all of them. Documents with too few shingles for a class's smallest item are not matched against that
class. Every candidate is then verified by exact shingle containment on the words themselves.

Words: letters and digits after lower-casing; all else parts words. An item of fewer than five words has one shingle, its whole
sequence; it is looked for as such in documents (runs of that many words).

Defined results: null and wordless texts, of items or documents, match nothing; repeated rows of documents each get their hits,
repeated items count once; an empty table on either side gives no hits; extra columns are left behind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import ids_and_texts, in_pieces, materialise

SHINGLE = 5
THRESHOLD = 0.8
#: So many items, about, are verified with one reading of a document; with more candidates it is read again for the rest.
TOGETHER = 64
#: Sketches have so many times the hashes that a search needs, to choose the rarest from.
SPARE = 4
#: Sketches of more hashes than this (8 bytes each) are joined by a shuffle instead of being sent to every worker.
SENT = 1 << 20

_SPLIT = re.compile(r"[^\W_]+").findall
_MUL = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return _SPLIT(text.lower()) if text else []


def _word_hash(word: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 7)


def shingle_hashes(words: list[str], size: int, known: dict[str, int]) -> np.ndarray:
    """A hash per run of ``size`` words, in order; ``known`` keeps the words' hashes of a task between texts."""
    if len(words) < size or not size:
        return np.empty(0, np.uint64)
    get = known.get
    h = np.array([get(w) or known.setdefault(w, _word_hash(w)) for w in words], dtype=np.uint64)
    n = len(h) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out ^ h[k : k + n]) * _MUL
        out ^= out >> np.uint64(29)
    return out


def least_hits(n: int, threshold: float) -> int:
    """The fewest shingles of n that reach the threshold."""
    k = int(threshold * n)
    return next(x for x in range(max(k - 1, 0), n + 1) if x >= threshold * n - 1e-9)


def size_class(n: int) -> tuple[int, int]:
    """The class of an item of n shingles: its smallest and largest size."""
    low = 1 << (n.bit_length() - 1)
    return low, 2 * low - 1


def sketch(text: str, threshold: float, known: dict[str, int]) -> tuple[int, int, int, list[int]] | None:
    """(shingle size, distinct shingles, k, bottom hashes) of an item."""
    words = words_of(text)
    if not words:
        return None
    size = min(SHINGLE, len(words))
    h = np.unique(shingle_hashes(words, size, known))
    low, high = size_class(len(h))
    k = min(len(h), high - least_hits(high, threshold) + 1)
    return size, len(h), k, h[: SPARE * k].view(np.int64).tolist()


def sketches(items: DataFrame, threshold: float = THRESHOLD, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, size, n, low (smallest size of its class), k, text (a hash of it), hash: a row per sketch hash."""
    fields = ("item_id", "size", "n", "low", "k", "text", "hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for piece in in_pieces(batches, "text"):
            rows = []
            for i, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist(), strict=True):
                if s := sketch(text, threshold, known):
                    of_text = _word_hash(text) >> 1
                    rows += [(i, s[0], s[1], size_class(s[1])[0], s[2], of_text, h) for h in s[3]]
            yield pa.RecordBatch.from_pylist([dict(zip(fields, r, strict=True)) for r in rows], schema=pa.schema([(c, pa.int64()) for c in fields]))

    return ids_and_texts(items.distinct(), id_col, text_col).distinct().mapInArrow(run, ", ".join(f"{c} long" for c in fields))


def _rarest(found: DataFrame) -> DataFrame:
    """The k hashes of each item that the fewest items have."""
    found = materialise(found, "wide-sketches")
    items = found.groupBy("size", "hash").agg(F.count(F.lit(1)).alias("items"))
    # a partition is one item's sketch
    order = Window.partitionBy("item_id", "size", "n", "text").orderBy("items", "hash")
    ranked = found.join(items, ["size", "hash"]).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= F.col("k")).select("item_id", "size", "n", "low", "hash")


def _probe(docs: DataFrame, sizes: list[int], classes: dict[int, int], wanted: np.ndarray | None) -> DataFrame:
    """(row, hash, size, shingles): the documents' distinct shingle hashes, only those in ``wanted`` if it is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for piece in in_pieces(batches, "text"):
            out: list[list] = [[], [], [], []]
            for i, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist(), strict=True):
                words = words_of(text)
                if len(known) > 500_000:
                    known.clear()
                for size in sizes:
                    h = shingle_hashes(words, size, known)
                    n = len(h)
                    if n < classes[size]:
                        continue
                    if wanted is not None:
                        at = np.searchsorted(wanted, h)
                        h = h[wanted[np.minimum(at, len(wanted) - 1)] == h]
                    h = np.unique(h)
                    out[0] += [i] * len(h)
                    out[1].append(h.view(np.int64))
                    out[2] += [size] * len(h)
                    out[3] += [n] * len(h)
            hashes = np.concatenate(out[1]) if out[1] else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(hashes), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], names=["doc_id", "hash", "size", "shingles"])

    return docs.mapInArrow(run, "doc_id long, hash long, size long, shingles long")


def _verify(pairs: DataFrame, threshold: float) -> DataFrame:
    """Exact containment, on words, of (doc_id, text, items: array of (item_id, item_text))."""

    def grams(words: list[str], size: int) -> set:
        return set(zip(*(words[k:] for k in range(size)), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in in_pieces(batches, "text", 1 << 20):
            rows = []
            for doc, text, items in zip(*(piece.column(c).to_pylist() for c in ("doc_id", "text", "items")), strict=True):
                words, have = words_of(text), {}
                for item in items:
                    own = words_of(item["item_text"])
                    size = min(SHINGLE, len(own))
                    if size not in have:
                        have[size] = grams(words, size)
                    need = grams(own, size)
                    hits = len(need & have[size])
                    if hits >= least_hits(len(need), threshold):
                        rows.append({"doc_id": doc, "item_id": item["item_id"], "n_item": len(need), "n_shared": hits})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(c, pa.int64()) for c in ("doc_id", "item_id", "n_item", "n_shared")]))

    return pairs.mapInArrow(run, "doc_id long, item_id long, n_item long, n_shared long")


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, sent: int = SENT) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared): every item that a document contains. doc_id must tell documents apart."""
    rows = ids_and_texts(docs)
    index = materialise(_rarest(sketches(items, threshold)), "sketches")
    partitions = index.groupBy("size", "low").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("hashes")).collect()  # at most 5 x 63 rows
    sizes = sorted({r["size"] for r in partitions})
    classes = {s: min(least_hits(r["least"], threshold) for r in partitions if r["size"] == s) for s in sizes}
    wanted = None
    if 0 < sum(r["hashes"] for r in partitions) <= sent:
        wanted = np.unique(np.array([r["hash"] for r in index.select("hash").distinct().collect()], np.int64).view(np.uint64))
    probes = _probe(rows, sizes, classes, wanted)
    found = (
        probes.join(index, ["hash", "size"])
        .where(F.col("shingles") >= F.ceil(F.col("low") * F.lit(threshold) - F.lit(1e-9)))
        .select("doc_id", "item_id")
        .distinct()
    )
    texts = ids_and_texts(items, "item_id").select(F.col("doc_id").alias("item_id"), F.col("text").alias("item_text")).distinct()
    # Candidates are dealt by the item's hash into as many lists a document as keep each of bounded size.
    found = materialise(found, "candidates")
    lists = found.groupBy("doc_id").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("lists"))
    dealt = found.join(lists, "doc_id").withColumn("list", F.pmod(F.xxhash64("item_id"), "lists"))
    listed = materialise(dealt.join(texts, "item_id").groupBy("doc_id", "list").agg(F.collect_list(F.struct("item_id", "item_text")).alias("items")).drop("list"), "candidate-lists")
    return _verify(rows.join(listed, "doc_id"), threshold).distinct()
