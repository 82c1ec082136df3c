"""Intermediate tables in the cluster's shared folder, so that iterative plans keep a short lineage and survive lost executors."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Bytes of a table after which the driver collects its garbage: Spark keeps a finished step's shuffle files until then.
LARGE = 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only where it is unset and all workers are this machine's."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is not set: on a cluster, intermediate tables need a folder that all executors share")
    return folder or "/tmp/plexus-shared"


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once a session, so that they need no installation of their own."""
    sc = spark.sparkContext
    if getattr(sc, "_plexus_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="plexus-")) / "plexus.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))  # the driver serves it to the executors
    sc._plexus_shipped = True


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written to the shared folder as Parquet and read back; the files go when the driver's JVM ends."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    files.deleteOnExit(place)
    if files.getContentSummary(place).getLength() > LARGE:
        gc.collect()  # first what Python still holds of the JVM
        df.sparkSession._jvm.System.gc()
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``written`` wrote, once nothing reads it any more, and let the driver collect its garbage: shuffle files of finished steps go with it."""
    for df in tables:
        path = getattr(df, "written_to", None)
        if path:
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
    if tables:
        gc.collect()  # first what Python still holds of the JVM
        tables[0].sparkSession._jvm.System.gc()
