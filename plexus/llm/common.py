"""Small helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The one definition of a word: a run of anything but a space or U+0009 to U+000D.
#: ``bytes.split()`` on UTF-8 splits at exactly these characters.
WORD = r"[^\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once a session, so that they need no installation of their own."""
    sc = spark.sparkContext
    if getattr(sc, "_plexus_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="plexus-")) / "plexus.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))  # the driver serves it to the executors
    sc._plexus_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workspace(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``); one of our own only where it is unset and all workers are this machine's."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is not set: on a cluster, intermediate tables need a folder that all executors share")
    return folder or "/tmp/plexus-shared"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, survives lost executors.

    The table goes with ``discard``, or else when the driver's JVM ends.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place, files = _files(spark, path)
    files.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialise`` wrote, once nothing reads it any more."""
    path = getattr(df, "written_to", None)
    if path:
        place, files = _files(df.sparkSession, path)
        files.delete(place, True)


def tidy(spark: SparkSession) -> None:
    """A collection of the driver's garbage, as Spark's own periodic one: shuffle files of finished steps go, and its heap does not grow over many small jobs.

    What Python and Arrow have freed goes back to the system too; else it counts beside the JVM's as long as the driver runs.
    """
    gc.collect()  # first what Python still holds of the JVM
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another libc than glibc
        ctypes.CDLL(None).malloc_trim(0)
    spark.sparkContext._jvm.System.gc()


def _files(spark: SparkSession, path: str) -> tuple:
    """The path and its file system, as Hadoop knows them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def ids_and_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator reads, under fixed names; whatever else the input carries stays behind."""
    ship(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def in_pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of text each, so that a worker's memory follows one slice and not a batch."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, size = 0, 0
        for k, n in enumerate(lengths):
            if size and size + n > most:
                yield batch.slice(start, k - start)
                start, size = k, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)


def map_texts(df: DataFrame, make: Callable[[], Callable[[list, list], dict]], schema: str) -> DataFrame:
    """Rows of (doc_id, text) through a function of lists: ``make()`` runs once a task and returns (ids, texts) -> columns."""
    fields = [x.split()[0] for x in re.sub(r"<[^>]*>", "", schema).split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for piece in in_pieces(batches, "text"):
            out = work(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (out[f] for f in fields)], names=fields)

    return df.mapInArrow(run, schema)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)
