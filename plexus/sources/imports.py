"""Imports of external SQL: dbt manifests, query logs, directories of SQL files. They add ``query`` routines and never make up usage."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timestamps import valid_rfc3339
from .document import Document, DocumentError


@dataclass(frozen=True)
class Limits:
    """Of one import, in bytes and rows."""

    input: int = 64 << 20
    rows: int = 100_000
    sql: int = 8 << 20
    total: int = 64 << 20


def with_queries(doc: Document, rows: DataFrame) -> Document:
    """``doc`` with query routines from (schema, name, body, source)."""
    schemas = rows.select("schema").distinct()
    none = lambda n: F.lit(None).cast("string").alias(n)
    routines = rows.select("schema", "name", F.lit("query").alias("kind"), F.lit("sql").alias("language"), "body", none("signature"), none("member_of"), "source")
    return replace(doc, tables={**doc.tables, "routines": doc.routines.unionByName(routines), "schemas": doc.schemas.unionByName(schemas).distinct()})


def _within(rows: DataFrame, limits: Limits) -> None:
    n, largest, total = rows.agg(F.count(F.lit(1)), F.max(F.octet_length("body")), F.sum(F.octet_length("body"))).first()
    for what, have, most in (("rows", n, limits.rows), ("bytes in one statement", largest or 0, limits.sql), ("bytes of SQL", total or 0, limits.total)):
        if have > most:
            raise DocumentError(f"too much to import: {have} {what}, at most {most}")


def sql_directory(spark: SparkSession, doc: Document, path: str, schema: str, limits: Limits = Limits()) -> Document:
    """Every .sql file below ``path`` as a query named by its relative path in hex."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.sql").text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    base = path.rstrip("/")
    relative = F.element_at(F.split("file", F.lit(base.split("://")[-1].lstrip("/") + "/")), -1)
    rows = files.select(F.lit(schema).alias("schema"), F.concat(F.lit("query_"), F.lower(F.hex(F.encode(relative, "utf-8")))).alias("name"), F.col("value").alias("body"), relative.alias("source"))
    _within(rows, limits)
    return with_queries(doc, rows)


def dbt_manifest(spark: SparkSession, doc: Document, path: str, schema_filter: list[str] | None = None, limits: Limits = Limits()) -> Document:
    """The compiled SQL of a manifest's models. A model without compiled SQL, or outside the filter, becomes a limitation."""
    text = spark.read.text(path, wholetext=True)
    node = "struct<resource_type:string,schema:string,name:string,alias:string,compiled_code:string,compiled_sql:string,original_file_path:string>"
    nodes = text.select(F.explode(F.map_entries(F.from_json(F.get_json_object("value", "$.nodes"), f"map<string,{node}>"))).alias("n")).select("n.key", "n.value.*")
    models = nodes.where("resource_type = 'model'").withColumn("body", F.coalesce("compiled_code", "compiled_sql"))
    inside = F.lit(True) if schema_filter is None else F.col("schema").isin(*schema_filter)
    rows = models.where(inside & F.col("body").isNotNull()).select("schema", F.concat(F.lit("query_"), F.lower(F.hex(F.encode("key", "utf-8")))).alias("name"), "body", F.col("original_file_path").alias("source"))
    _within(rows, limits)
    out = models.where(~inside).count()
    bare = models.where(inside & F.col("body").isNull()).count()
    if not models.where(inside).limit(1).count():
        raise DocumentError("the manifest has no model in scope")
    return with_queries(doc, rows).noted(*[f"dbt models outside the schema filter: {out}"] * bool(out), *[f"dbt models without compiled SQL: {bare}"] * bool(bare))


def query_log(spark: SparkSession, doc: Document, path: str, limits: Limits = Limits()) -> Document:
    """A JSON-lines log: a header with the observed window, then rows (at, schema, sql). One row outside the window fails the import.

    Equal statements become one query; how often they ran is not turned into usage.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    head = lines.where(F.get_json_object("value", "$.type") == "query-log").limit(2).collect()
    if len(head) != 1:
        raise DocumentError("a query log has one header")
    header = json.loads(head[0]["value"])
    window = header.get("window") or {}
    start, end = window.get("start"), window.get("end")
    if not (valid_rfc3339(start) and valid_rfc3339(end)) or start > end:
        raise DocumentError("the log's window is not two RFC 3339 times in UTC, in order")
    rows = lines.where(F.coalesce(F.get_json_object("value", "$.type"), F.lit("")) != "query-log").select(F.from_json("value", "at string, schema string, sql string").alias("r")).select("r.*")
    at = F.try_to_timestamp("at")
    bad = rows.where(F.col("sql").isNull() | F.col("schema").isNull() | ~F.coalesce(F.col("at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z$"), F.lit(False)) | at.isNull() | (at < F.lit(start).cast("timestamp")) | (at > F.lit(end).cast("timestamp"))).count()
    if bad:
        raise DocumentError(f"rows that are malformed or outside the window: {bad}")
    queries = rows.select("schema", F.concat(F.lit("query_"), F.sha2("sql", 256)).alias("name"), F.col("sql").alias("body"), F.lit(None).cast("string").alias("source")).distinct()
    _within(queries, limits)
    return with_queries(doc, queries).noted(f"queries come from a log of {start} to {end}; what ran outside it is not known")


# -- facts for other tools -------------------------------------------------------------------------------------------

MAX_FIELDS, MAX_UNITS = 512, 1024


def relation_facts(doc: Document, source_id: str) -> DataFrame:
    """(fact_id, id, kind, name, contract, truncated): one declaration per table, view and column.

    A relation's contract lists its columns and types: at most MAX_FIELDS, and none longer than MAX_UNITS UTF-16 units.
    """
    units = lambda c: F.octet_length(F.encode(c, "UTF-16BE")) / 2
    field = F.concat_ws(":", "name", "data_type", F.when(F.col("nullable"), "null").otherwise("not null"))
    columns = doc.columns.withColumn("field", field).withColumn("fits", units(F.col("field")) <= MAX_UNITS)
    per = columns.groupBy("schema", "object").agg(F.array_sort(F.collect_list(F.when(F.col("fits"), F.struct("ordinal", "field")))).alias("fields"), F.count(F.lit(1)).alias("n"))
    own = lambda *c: F.sha2(F.concat_ws("\0", F.lit(source_id), *c), 256).alias("fact_id")
    relations = doc.objects.where("kind IN ('table', 'view', 'materialized-view')").withColumnRenamed("name", "object").join(per, ["schema", "object"], "left")
    kept = F.slice(F.coalesce("fields", F.array().cast("array<struct<ordinal:int,field:string>>")), 1, MAX_FIELDS)
    a = relations.select(own("schema", "object"), F.concat_ws(".", "schema", "object").alias("id"), "kind", F.col("object").alias("name"), F.array_join(F.transform(kept, lambda x: x["field"]), ", ").alias("contract"), (F.coalesce("n", F.lit(0)) > F.size(kept)).alias("truncated"))
    b = columns.select(own("schema", "object", "name"), F.concat_ws(".", "schema", "object", "name").alias("id"), F.lit("column").alias("kind"), "name", F.when(F.col("fits"), F.col("field")).alias("contract"), (~F.col("fits")).alias("truncated"))
    return a.unionByName(b)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
