"""The graph as JSON: read versions 1 and 2, write version 2.

Large graphs are written by executors, as sorted parts that become one file; what a reader does not know is counted, not kept.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EDGE_KINDS, SCHEMAS, VERTEX_KINDS, kind_order
from ..plans.bundle import GraphBundle
from ..workspace import shared_folder

FORMAT = "plexus-graph"
_SHAPE = """version int, vertices array<struct<id:string,kind:string,name:string,schema:string>>,
edges array<struct<from:string,to:string,kind:string,evidence:array<struct<layer:string,detail:string>>,origins:array<struct<bodyHash:string,role:string,line:int,col:int>>>>,
usage array<struct<id:string,since:string,reads:bigint,writes:bigint,scans:bigint,totalMs:double,selfMs:double>>,
analysis array<struct<id:string,state:string,scope:string,bodyHash:string,diagnostics:array<struct<code:string,message:string,line:int,col:int,candidates:array<string>>>>>,
schemaMetadata struct<catalogComplete:boolean,columns:array<struct<tableId:string,columnId:string,name:string,dataType:string,nullable:boolean,hasDefault:boolean,ordinal:int,pkPosition:int>>,
indexes:array<struct<indexId:string,tableId:string,name:string,isUnique:boolean,columns:array<string>,complete:boolean,filtered:boolean>>,
foreignKeys:array<struct<fkId:string,tableId:string,name:string,columns:array<string>,targetTableId:string,targetColumns:array<string>,complete:boolean>>>, limitations array<string>"""


def read(spark: SparkSession, path: str) -> GraphBundle:
    """A graph file. Unknown kinds of vertices and edges are dropped and counted in the limitations."""
    one = spark.read.schema(_SHAPE).json(path, multiLine=True)
    version = one.select("version").first()["version"]
    if version not in (1, 2):
        raise ValueError(f"unsupported graph version: {version}")
    parts = lambda c: one.select(F.explode(c).alias("x")).select("x.*")
    v, e = parts("vertices"), parts("edges").withColumnsRenamed({"from": "src", "to": "dst"})
    bad_v, bad_e = v.where(~F.col("kind").isin(*VERTEX_KINDS)).count(), e.where(~F.col("kind").isin(*EDGE_KINDS)).count()
    e = e.where(F.col("kind").isin(*EDGE_KINDS))
    key = ["src", "dst", "kind"]
    analysis = parts("analysis")
    meta = lambda name: one.select(F.explode(f"schemaMetadata.{name}").alias("x")).select("x.*")
    tables = {
        "vertices": v.where(F.col("kind").isin(*VERTEX_KINDS)),
        "edges": e.select(*key).distinct(),
        "evidence": e.select(*key, F.explode("evidence").alias("x")).select(*key, "x.layer", "x.detail"),
        "origins": e.select(*key, F.explode("origins").alias("x")).select(*key, F.col("x.bodyHash").alias("body_hash"), "x.role", "x.line", "x.col"),
        "usage": parts("usage").withColumnsRenamed({"totalMs": "total_ms", "selfMs": "self_ms"}),
        "analysis": analysis.select("id", "state", "scope", F.col("bodyHash").alias("body_hash")),
        "diagnostics": analysis.select("id", F.explode("diagnostics").alias("x")).select("id", "x.*"),
        "columns": meta("columns").toDF(*[c.split()[0] for c in SCHEMAS["columns"].split(", ")]),
        "indexes": meta("indexes").toDF(*[c.split()[0] for c in SCHEMAS["indexes"].split(", ")]),
        "fks": meta("foreignKeys").toDF(*[c.split()[0] for c in SCHEMAS["fks"].split(", ")]),
        "limitations": one.select(F.explode("limitations").alias("note")),
    }
    complete = bool(one.select("schemaMetadata.catalogComplete").first()[0])
    return GraphBundle(spark, tables, complete).noted([f"vertices of unknown kinds: {bad_v}"] * bool(bad_v) + [f"edges of unknown kinds: {bad_e}"] * bool(bad_e))


def _objects(df: DataFrame, order: list) -> DataFrame:
    """(j): JSON texts in order. Absent values are left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("j"), *[c.alias(f"__{k}") for k, c in enumerate(order)]).orderBy(*[f"__{k}" for k in range(len(order))]).select("j")


def _pieces(bundle: GraphBundle) -> Iterator[str | DataFrame]:
    """The file's text in order: literal pieces, and tables of texts that stand there one after the other with commas between."""
    key = ["src", "dst", "kind"]
    proof = bundle.evidence.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("layer", "detail"))).alias("evidence"))
    origins = bundle.origins.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct(F.col("body_hash").alias("bodyHash"), "role", "line", "col"))).alias("origins"))
    edges = bundle.edges.select(*key).distinct().join(proof, key, "left").join(origins, key, "left").select(F.col("src").alias("from"), F.col("dst").alias("to"), "kind", "evidence", "origins")
    notes = bundle.diagnostics.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("code", "message", "line", "col", "candidates"))).alias("diagnostics"))
    analysis = bundle.analysis.join(notes, "id", "left").select("id", "state", "scope", F.col("body_hash").alias("bodyHash"), "diagnostics")
    camel = lambda df: df.toDF(*["".join(p if k == 0 else p.capitalize() for k, p in enumerate(c.split("_"))) for c in df.columns])
    sections = [
        ("vertices", bundle.vertices.select("id", "kind", "name", "schema").distinct(), [F.col("id")]),
        ("edges", edges, [F.col("from"), F.col("to"), kind_order(F.col("kind"))]),
        ("usage", camel(bundle.usage), [F.col("id")]),
        ("analysis", analysis, [F.col("id")]),
    ]
    yield f'{{"format":"{FORMAT}","version":2'
    for name, df, order in sections:
        yield f',"{name}":['
        yield _objects(df, order)
        yield "]"
    yield ',"schemaMetadata":{"catalogComplete":' + ("true" if bundle.complete else "false")
    for name, df, order in (("columns", camel(bundle.columns), "columnId"), ("indexes", camel(bundle.indexes), "indexId"), ("foreignKeys", camel(bundle.fks), "fkId")):
        yield f',"{name}":['
        yield _objects(df, [F.col(order)])
        yield "]"
    notes_ = [r["note"] for r in bundle.limitations.distinct().orderBy("note").toLocalIterator()]
    yield f'}},"limitations":{json.dumps(notes_, ensure_ascii=False)}}}\n'


def chunks(bundle: GraphBundle) -> Iterator[str]:
    """The file's text, piece by piece, for a stream; equal graphs give equal bytes."""
    for piece in _pieces(bundle):
        if isinstance(piece, str):
            yield piece
        else:
            for k, row in enumerate(piece.toLocalIterator()):
                yield ("," if k else "") + row["j"]


def write(bundle: GraphBundle, path: str) -> None:
    """Publish at ``path`` in one step; an existing file is replaced only by a whole one.

    Executors sort and write each table's texts as parts in the shared folder, with commas for line ends; the file is put together from the
    parts' bytes by the file system's copy. A path without a scheme is a local one.
    """
    spark = bundle.spark
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    target = hadoop.fs.Path(path if re.match(r"\w+:/", path) else f"file://{Path(path).absolute()}")
    beside = hadoop.fs.Path(target.getParent(), target.getName() + ".tmp")
    files = target.getFileSystem(conf)
    folder = f"{shared_folder(spark)}/graph-json-{uuid.uuid4().hex}"
    out = files.create(beside, True)
    try:
        for n, piece in enumerate(_pieces(bundle)):
            if isinstance(piece, str):
                out.write(bytearray(piece.encode()))
                continue
            piece.write.option("lineSep", ",").text(f"{folder}/{n}")
            place = hadoop.fs.Path(f"{folder}/{n}")
            shared = place.getFileSystem(conf)
            parts = sorted((s for s in shared.listStatus(place) if s.getPath().getName().startswith("part-") and s.getLen()), key=lambda s: s.getPath().getName())
            for k, part in enumerate(parts):
                source = shared.open(part.getPath())
                spark._jvm.org.apache.commons.io.IOUtils.copyLarge(source, out, 0, part.getLen() - int(k + 1 == len(parts)))  # without the last comma
                source.close()
    finally:
        out.close()
        place = hadoop.fs.Path(folder)
        place.getFileSystem(conf).delete(place, True)
    if target.toUri().getScheme() == "file":
        made = Path(beside.toUri().getPath())
        made.replace(target.toUri().getPath())
        made.with_name(f".{made.name}.crc").unlink(missing_ok=True)  # the local file system's checksum
    else:
        over = spark.sparkContext._gateway.new_array(hadoop.fs.Options.Rename, 1)
        over[0] = hadoop.fs.Options.Rename.OVERWRITE
        hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(beside, target, over)


def publish(path: str, pieces: Iterator[str]) -> None:
    target = Path(path)
    beside = target.with_name(target.name + ".tmp")
    with beside.open("w", encoding="utf-8") as out:
        for p in pieces:
            out.write(p)
    beside.replace(target)
