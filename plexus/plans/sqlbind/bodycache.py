"""What bodies were found to say, kept between runs.

A folder holds generations of one Parquet table, FACTS with the ``key`` of each body: a hash of the body and of the settings that binding reads. With
them go each body's footprint (fact ``touch``: every name that was looked up for it, found or not) and the catalog's names with a hash of what
they stood for (fact ``name``). Names that differ between then and now are joined with the footprints, which gives the bodies to be bound again; a
table that no body asked for rebinds none. A generation counts once its job has committed; the newest one is read, and older ones go when a
newer one is there. A cache that is missing, or of another shape, is no error: everything is bound again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Raised whenever binding may say something else of the same body.
VERSION = 2


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _generations(spark: SparkSession, folder: str) -> list[str]:
    """Committed generations, the newest first."""
    path, files = _files(spark, folder)
    if not files.exists(path):
        return []
    done = lambda s: files.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
    found = [(s.getModificationTime(), s.getPath().toString()) for s in files.listStatus(path) if s.isDirectory() and done(s)]
    return [p for _, p in sorted(found, reverse=True)]


def read(spark: SparkSession, folder: str, shape: str) -> DataFrame:
    """The newest generation, empty if there is none of this shape."""
    empty = spark.createDataFrame([], shape)
    for path in _generations(spark, folder)[:1]:
        found = spark.read.parquet(path)
        if sorted(found.dtypes) == sorted(empty.dtypes):
            return found.select(*empty.columns)
    return empty


def publish(facts: DataFrame, folder: str) -> DataFrame:
    """``facts`` as the newest generation, read back."""
    spark = facts.sparkSession
    before = _generations(spark, folder)
    path = f"{folder.rstrip('/')}/facts-{uuid.uuid4().hex}"
    facts.write.parquet(path)
    for old in before:
        place, files = _files(spark, old)
        files.delete(place, True)
    return spark.read.parquet(path)


def keyed(work: DataFrame, settings: str) -> DataFrame:
    """``work`` with ``key``: the body and all else that binding reads but the catalog's names, which are compared by footprint."""
    told = f"{VERSION}|{settings}"
    return work.withColumn("key", F.sha2(F.to_json(F.struct(F.lit(told).alias("settings"), "owner", "kind", "schema", "language", "table_id", "body")), 256))
