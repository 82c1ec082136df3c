"""Vector compression by product codes: each of ``PARTS`` equal parts of a vector becomes the number of its nearest codebook entry.

Components are whole numbers, floor(256 * x), so every distance, sum and mean is exact. Codebooks start as the parts of the
``ENTRIES`` vectors of smallest id. A round reads all vectors as an RDD of blocks, one NumPy column a dimension: distances to all entries
accumulate dimension by dimension, ``np.add.at`` adds the parts to tensors of sums and counts, and ``treeAggregate`` merges the tensors
over a reduction tree. What a task sends on, and what the driver gets, is one pair of tensors, of ENTRIES times the dimension numbers. The
codebooks are sent to all tasks; they have that size too. Blocks are made from the table in each pass, nothing of them is kept.

Defined results: rows whose vector is null or holds a null or non-finite component are left out. The dimension is that of the smallest
id whose vector can be cut into PARTS equal parts of one component or more; vectors of another length are returned with null code and error.
Null ids come last in the order of ids, equal ids go by their vectors. With fewer than ENTRIES rows the codebooks are as small as that.
Null labels are one label. Components beyond 2^24 are counted in Python's whole numbers, so nothing overflows; an error beyond
2^63 - 1 counts as that. Repeated rows are rows; an empty table gives an empty result; extra columns are left behind.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from math import floor, inf

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows of a block; components up to WIDE stay in 64 bits.
BLOCK, WIDE = 2048, 1 << 24
_MOST = (1 << 63) - 1


def whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), as int64 or, where that is too narrow, as Python's whole numbers."""
    if not values.size or np.abs(values).max() < WIDE / SCALE:
        return np.floor(values * SCALE).astype(np.int64)
    return np.array([int(x) * SCALE if abs(x) >= 2**53 else floor(x * SCALE) for x in values.ravel().tolist()], object).reshape(values.shape)


def _columns(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, [dimension, row]) of each block of a batch."""
    vectors = batch.column("vector")
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    values = flat.reshape(-1, dim)
    for k in range(0, len(values), BLOCK):
        yield k, whole(np.ascontiguousarray(values[k : k + BLOCK].T))


def nearest(block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """([part, row] of the nearest entry, the least one among equals; [row] of the squared distances' sum). ``books``: [part, entry, position]."""
    parts, entries, width = books.shape
    rows = block.shape[1]
    codes, errors = np.empty((parts, rows), np.int64), 0
    kind = object if block.dtype == object or books.dtype == object else np.int64
    for p in range(parts):
        far = np.zeros((rows, entries), kind)
        for d in range(width):
            away = block[p * width + d].astype(kind)[:, None] - books[p, :, d].astype(kind)[None, :]
            far += away * away
        codes[p] = far.argmin(axis=1)
        errors = errors + far[np.arange(rows), codes[p]]
    return codes, errors


def _gather(books: np.ndarray):
    """Adds a block to (sums [part, entry, position], counts [part, entry])."""
    parts, entries, width = books.shape

    def add(now: tuple | None, raw: tuple[int, bytes]) -> tuple:
        wide, data = raw
        block = pickle.loads(data) if wide else np.frombuffer(data, np.int64).reshape(parts * width, -1)
        sums, counts = now or (np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64))
        if wide and sums.dtype != object:
            sums = sums.astype(object)
        codes, _ = nearest(block, books)
        for p in range(parts):
            np.add.at(counts[p], codes[p], 1)
            for d in range(width):
                np.add.at(sums[p, :, d], codes[p], block[p * width + d])
        return sums, counts

    return add


def _merge(x: tuple | None, y: tuple | None) -> tuple | None:
    return (x[0] + y[0], x[1] + y[1]) if x and y else x or y


def refine(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over all ``vectors`` (column ``vector``, all of the codebooks' dimension)."""
    dim = books.shape[0] * books.shape[2]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, block in _columns(batch, dim):
                wide = block.dtype == object
                yield pa.RecordBatch.from_arrays([pa.array([int(wide)]), pa.array([pickle.dumps(block) if wide else block.tobytes()])], names=["wide", "data"])

    blocks = vectors.select("vector").mapInArrow(cut, "wide long, data binary").rdd.map(lambda r: (r[0], bytes(r[1])))
    depth = 2 if blocks.getNumPartitions() < 1000 else 3
    found = blocks.treeAggregate(None, _gather(books), _merge, depth)
    if not found:
        return books
    sums, counts = found
    return np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)


def encode(df: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code and error of rows with a ``vector`` of the codebooks' dimension."""
    dim = books.shape[0] * books.shape[2]
    digits = np.array([f"{k:02x}" for k in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, block in _columns(batch, dim):
                codes, errors = nearest(block, books)
                told = pa.array(["".join(x) for x in digits[codes.T].tolist()], pa.string())
                part = batch.slice(k, block.shape[1])
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), told, pa.array([min(int(e), _MOST) for e in errors.tolist()], pa.int64())], names=["vec_id", "label", "code", "error"])

    label = df.schema["label"].dataType.simpleString()
    return df.select("vec_id", "label", "vector").mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def _finite(x: Column) -> Column:
    return x.isNotNull() & (F.abs(x) < inf)


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error of every kept row; the codebooks [part, entry, position])."""
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).alias("label"))
    rows = rows.where(F.col("vector").isNotNull() & F.forall("vector", _finite))
    order = (F.col("vec_id").asc_nulls_last(), F.col("vector"))
    able = (F.size("vector") > 0) & (F.size("vector") % parts == 0)
    first = rows.where(able).orderBy(*order).select(F.size("vector").alias("n")).first()
    if first is None:
        return rows.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    own = F.size("vector") == first["n"]
    seeds = rows.where(own).orderBy(*order).limit(entries).select("vector").collect()
    books = whole(np.array([r["vector"] for r in seeds], float)).reshape(len(seeds), parts, -1).transpose(1, 0, 2)
    for _ in range(rounds):
        books = refine(rows.where(own), books)
    other = rows.where(~own).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return encode(rows.where(own), books).unionByName(other), books


def decode(code: str, books: np.ndarray) -> np.ndarray:
    """The vector that a code stands for."""
    return np.concatenate([books[p, int(code[2 * p : 2 * p + 2], 16)] for p in range(len(books))]) / SCALE


def codebooks_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """``label_error``: the errors of all rows of equal label. Both sides of the join are written tables, so that a label of very many rows can be split."""
    coded = materialise(coded, "vector-codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_MOST).cast("decimal(38,0)")).cast("long")
    sums = materialise(coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error")), "label-errors")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")
