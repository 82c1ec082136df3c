"""SimHash near-duplicate detection with pigeonring filtering.

Fingerprints: words after lower-casing A-Z, 4-word shingles with repeats, XXH64 with seed 42, a bit is 1 where over half of
the hashes have it.

Search: the 64 bits are cut into a ring of m = d + 1 segments. By the pigeonring principle, two fingerprints within d bits
have a segment i from which every chain of l consecutive segments differs in at most floor(l * d / m) bits. The chain of
length one is an equal segment; that of length two leaves at most one bit in the next segment, so one half of that is equal
too. These two make the bucket key; inside a bucket, longer chains prune a pair before its full Hamming distance is taken.
Only distinct fingerprints enter, and a bucket sends out a spanning forest of its links (never all pairs), which keeps every
connection and therefore every class.

Fingerprints are the nodes and ids come in at the end, so a text links others whatever its id is.

Defined results: a null or wordless text has fingerprint zero and is linked like any other; a row without an id links like any other
and gets the class of its text, null only where the whole class has no id; repeated rows each get a row; an empty table gives an empty result; extra columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ids_and_texts, map_texts, materialise
from .components import components

BITS, SHINGLE, SEED = 64, 4, 42


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxh64_intdigest(joined, SEED)
    lengths = [len(w) + 1 for w in words]
    starts = [0, *accumulate(lengths)]
    ends = [x - 1 for x in starts[size:]]
    hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=False)], dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _printer():
    def work(ids: list, texts: list) -> dict:
        prints = np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)
        return {"doc_id": pa.array(ids, pa.int64()), "fp": pa.array(prints, pa.int64())}

    return work


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the fingerprint as a signed long."""
    return map_texts(ids_and_texts(docs, id_col, text_col), _printer, "doc_id long, fp long")


# -- the ring --------------------------------------------------------------------------------------------------------


def ring(d: int) -> list[tuple[int, int]]:
    """(first bit, width) of each of d + 1 segments."""
    cuts = [round(k * BITS / (d + 1)) for k in range(d + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _mask(first: int, width: int) -> np.uint64:
    return np.uint64(((1 << width) - 1) << first)


def bucket_keys(fps: np.ndarray, d: int) -> np.ndarray:
    """One row per fingerprint, 2 * (d + 1) keys each: segment i with the lower or upper half of segment i + 1."""
    segments = ring(d)
    out = np.empty((len(fps), 2 * len(segments)), np.int64)
    for i, (first, width) in enumerate(segments):
        after, wide = segments[(i + 1) % len(segments)]
        low = wide // 2
        for half, (a, w) in enumerate(((after, low), (after + low, wide - low))):
            own = (fps & _mask(first, width)) >> np.uint64(first)
            part = (fps & _mask(a, w)) >> np.uint64(a)
            out[:, 2 * i + half] = ((np.uint64(2 * i + half) << np.uint64(56)) | (own << np.uint64(28)) | part).view(np.int64)
    return out


def chain_filter(x: np.ndarray, y: np.ndarray, start: int, d: int) -> np.ndarray:
    """Positions of the pairs whose chains from segment ``start`` keep within their budgets for every length; the last is the full check."""
    segments = ring(d)
    m = len(segments)
    alive, diff, spent = np.arange(len(x)), x ^ y, np.zeros(len(x), np.int64)
    for length in range(1, m + 1):
        first, width = segments[(start + length - 1) % m]
        spent = spent + np.bitwise_count(diff & _mask(first, width))
        ok = spent <= length * d // m
        alive, diff, spent = alive[ok], diff[ok], spent[ok]
    return alive


def forest(key: np.ndarray, fp: np.ndarray, rep: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, per bucket, of the links among rows that are sorted by key; as pairs of ``rep``."""
    n = len(key)
    root = np.arange(n)
    out_a, out_b = [], []
    starts = (key >> 56) // 2
    left = np.flatnonzero(key[1:] == key[:-1]) if n > 1 else np.empty(0, np.int64)
    step = 1
    while len(left):
        for start in np.unique(starts[left]):
            some = left[starts[left] == start]
            for k in range(0, len(some), 1 << 20):
                part = some[k : k + (1 << 20)]
                part = part[root[part] != root[part + step]]
                hit = part[chain_filter(fp[part], fp[part + step], int(start), d)]
                for a in hit.tolist():
                    b = a + step
                    ra, rb = _find(root, a), _find(root, b)
                    if ra != rb:
                        root[max(ra, rb)] = min(ra, rb)
                        out_a.append(rep[a])
                        out_b.append(rep[b])
                while (up := root[root] != root).any():
                    root[up] = root[root[up]]
        step += 1
        left = left[left + step < n]
        left = left[key[left] == key[left + step]]
    return np.array(out_a, np.int64), np.array(out_b, np.int64)


def _find(root: np.ndarray, a: int) -> int:
    while root[a] != a:
        a = root[a]
    return int(a)


def links(nodes: DataFrame, d: int = 4) -> DataFrame:
    """(a, b): links between distinct fingerprints, ``fp`` of ``nodes``, within d bits; enough of them to keep every class whole."""
    width = 2 * (d + 1)
    kept = T.StructType([T.StructField(c, T.LongType()) for c in ("key", "fp")])
    pair = T.StructType([T.StructField(c, T.LongType()) for c in ("a", "b")])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            keys = bucket_keys(fp.view(np.uint64), d).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(fp, width))], names=["key", "fp"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 2
        for batch in batches:
            now = [np.concatenate([h, batch.column(c).to_numpy(zero_copy_only=False)]) for h, c in zip(held, ("key", "fp"), strict=True)]
            cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            held = [x[cut:] for x in now]  # the last bucket may go on in the next batch
            if cut:
                yield _links([x[:cut] for x in now], d)
        if len(held[0]):
            yield _links(held, d)

    return nodes.select("fp").mapInArrow(keyed, kept).repartition("key").sortWithinPartitions("key").mapInArrow(compared, pair).distinct()


def _links(rows: list[np.ndarray], d: int) -> pa.RecordBatch:
    key, fp = rows
    a, b = forest(key, np.ascontiguousarray(fp).view(np.uint64), fp, d)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def near_duplicates(docs: DataFrame, d: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that is reachable over links of at most d bits."""
    prints = materialise(fingerprints(docs, id_col, text_col), "simhash")
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    found = components(links(nodes, d))
    of = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = of.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(of.join(ids, "component").select("fp", "component_id"), "fp")
