"""Catalog documents: JSON and NDJSON, versions 1 and 2, read into flat DataFrames and written back.

Version and features are checked on the driver from the header alone; schemas, objects and routines are exploded on the executors.
Unknown optional fields and repeated identities become limitations, unknown required features are errors.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ..workspace import written

FEATURES = ("catalog-dependencies-v1", "external-queries-v1", "package-members-v1", "usage-v1")

USAGE = "struct<since:string,reads:bigint,writes:bigint,scans:bigint,total_ms:double,self_ms:double>"
COLUMN = "struct<name:string,data_type:string,nullable:boolean,default:string,ordinal:int,pk_position:int>"
CONSTRAINT = "struct<name:string,kind:string,columns:array<string>,referenced:struct<schema:string,table:string,columns:array<string>>>"
INDEX = f"struct<name:string,unique:boolean,columns:array<string>,usage:{USAGE},definition_complete:boolean,predicate:string,has_predicate:boolean>"
TRIGGER = "struct<name:string,body:string>"
OBJECT = f"struct<name:string,kind:string,columns:array<{COLUMN}>,constraints:array<{CONSTRAINT}>,indexes:array<{INDEX}>,triggers:array<{TRIGGER}>,body:string,usage:{USAGE}>"
ROUTINE = f"struct<name:string,kind:string,language:string,body:string,signature:string,usage:{USAGE},member_of:string,source:string>"
REF = "struct<schema:string,name:string,kind:string,member:string,signature:string,database:string>"
DEPENDENCY = f"struct<source:{REF},target:{REF},catalog:string,dependency_type:string>"
CONTEXT = "struct<source_id:string,database:string,schema_filter:array<string>,catalog_complete:boolean,lower_case_table_names:int,collation:string>"
DOCUMENT = (
    f"version int, dialect string, reader string, producer struct<name:string>, required_features array<string>, context {CONTEXT}, "
    f"schemas array<struct<name:string,objects:array<{OBJECT}>,routines:array<{ROUTINE}>>>, limitations array<string>, dependencies array<{DEPENDENCY}>"
)

TABLES = {
    "schemas": "schema string",
    "objects": "schema string, name string, kind string, body string, n_columns int",
    "columns": "schema string, object string, name string, data_type string, nullable boolean, default string, ordinal int, pk_position int",
    "constraints": "schema string, object string, name string, kind string, columns array<string>, ref_schema string, ref_table string, ref_columns array<string>",
    "indexes": "schema string, object string, name string, unique boolean, columns array<string>, definition_complete boolean, predicate string, has_predicate boolean",
    "triggers": "schema string, object string, name string, body string",
    "routines": "schema string, name string, kind string, language string, body string, signature string, member_of string, source string",
    "usage": "schema string, object string, member string, signature string, since string, reads long, writes long, scans long, total_ms double, self_ms double",
    "dependencies": f"source string, target string, catalog string, dependency_type string, src {REF}, dst {REF}",
}


class DocumentError(ValueError):
    """The document is not one that this reader understands."""


@dataclass(frozen=True)
class Document:
    """A catalog snapshot: flat tables (see TABLES), the header and what could not be seen."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    header: dict = field(default_factory=dict)
    limitations: tuple[str, ...] = ()

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("__") or name not in TABLES:
            raise AttributeError(name)
        found = self.tables.get(name)
        return self.spark.createDataFrame([], T._parse_datatype_string(TABLES[name])) if found is None else found

    @property
    def complete(self) -> bool:
        return bool(self.header.get("catalog_complete"))

    def saved(self) -> Document:
        """The document with its tables computed once, in the shared folder."""
        return replace(self, tables={n: written(df, f"document-{n}") for n, df in self.tables.items()})

    def noted(self, *notes: str) -> Document:
        return replace(self, limitations=tuple(dict.fromkeys((*self.limitations, *notes))))


# -- checks of the header --------------------------------------------------------------------------------------------


def check_header(raw: dict, used: set[str] | None = None) -> None:
    """Version, producer and features; ``used``: features that the records need."""
    version = raw.get("version")
    if isinstance(version, bool) or not isinstance(version, int) or version not in (1, 2):
        raise DocumentError(f"unsupported document version: {version!r}")
    if version == 1:
        if used and "external-queries-v1" in used:
            raise DocumentError("external query records need document version 2")
        return
    if "reader" in raw:
        raise DocumentError("a version 2 document names its producer, not its reader")
    producer = raw.get("producer")
    if not isinstance(producer, dict) or not str(producer.get("name") or "").strip():
        raise DocumentError("a version 2 document needs a producer name")
    declared = raw.get("required_features")
    if not isinstance(declared, list):
        raise DocumentError("a version 2 document declares its required features")
    unknown = sorted(set(declared) - set(FEATURES))
    if unknown:
        raise DocumentError(f"unknown required features: {', '.join(map(str, unknown))}")
    missing = sorted((used or set()) - set(declared))
    if missing:
        raise DocumentError(f"features used but not declared: {', '.join(missing)}")


def _names(kind: T.DataType, at: str = "") -> set[str]:
    if isinstance(kind, T.ArrayType):
        return _names(kind.elementType, at + "[]")
    if isinstance(kind, T.StructType):
        return {x for f in kind.fields for x in {f"{at}.{f.name}".lstrip(".")} | _names(f.dataType, f"{at}.{f.name}".lstrip("."))}
    return set()


@cache
def _known() -> set[str]:
    return _names(T._parse_datatype_string(DOCUMENT))


def unknown_paths(value: object, at: str = "") -> set[str]:
    """Paths of fields that the format does not have, such as ``schemas[].objects[].owner``."""
    out: set[str] = set()
    if isinstance(value, dict):
        for k, v in value.items():
            path = f"{at}.{k}".lstrip(".")
            out |= unknown_paths(v, path) if path in _known() else {path}
    elif isinstance(value, list):
        for v in value:
            out |= unknown_paths(v, at + "[]")
    return out


# -- reading ---------------------------------------------------------------------------------------------------------


def _header(raw: dict) -> dict:
    context = raw.get("context") or {}
    dialect = {"postgresql": "postgres", "mariadb": "mysql", "mssql": "sqlserver"}.get(raw.get("dialect"), raw.get("dialect"))
    return {"version": raw["version"], "dialect": dialect, "reader": raw.get("reader") or (raw.get("producer") or {}).get("name"), **context}


def read_json(spark: SparkSession, path: str) -> Document:
    """A JSON document. The header is read once more as text, to see fields that the fixed schema would drop."""
    text = spark.read.text(path, wholetext=True).first()["value"]
    return from_value(spark, json.loads(text))


def from_value(spark: SparkSession, raw: dict) -> Document:
    """A document from parsed JSON."""
    if not isinstance(raw, dict):
        raise DocumentError("a document is an object")
    check_header(raw, _used(raw))
    notes = [f"ignored unknown field: {p}" for p in sorted(unknown_paths(raw))]
    schemas = [s for s in raw.get("schemas") or [] if s is not None]

    def records(rows: list[tuple], shape: str, name: str) -> DataFrame:
        """A row a record, so that the executors share the parsing."""
        return spark.createDataFrame(rows, "schema string, value string").select("schema", F.from_json("value", shape).alias(name)).where(F.col(name).isNotNull())

    inside = lambda part: [(s.get("name"), json.dumps(x)) for s in schemas for x in s.get(part) or []]
    return _flatten(
        spark,
        spark.createDataFrame([(s.get("name"),) for s in schemas], "schema string").distinct(),
        records(inside("objects"), OBJECT, "o"),
        records(inside("routines"), ROUTINE, "r"),
        records([(None, json.dumps(x)) for x in raw.get("dependencies") or []], DEPENDENCY, "d").select("d"),
        _header(raw),
        [*(raw.get("limitations") or []), *notes],
    )


def _used(raw: dict) -> set[str]:
    used = set()
    for s in raw.get("schemas") or []:
        for o in s.get("objects") or []:
            if o.get("usage") or any(i.get("usage") for i in o.get("indexes") or []):
                used.add("usage-v1")
        for r in s.get("routines") or []:
            used |= {f for f, hit in (("usage-v1", r.get("usage")), ("package-members-v1", r.get("member_of")), ("external-queries-v1", r.get("kind") == "query")) if hit}
    if raw.get("dependencies"):
        used.add("catalog-dependencies-v1")
    return used


def read_ndjson(spark: SparkSession, path: str) -> Document:
    """Header, schema, object, routine and dependency records, and a limitations trailer (mandatory in version 2).

    A record without a schema of its own belongs to the last schema record before it; the order of lines is that of files by name, of
    their blocks and, within a block, of the scan.
    """
    block = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", block.alias("block"), F.monotonically_increasing_id().alias("n")).withColumn("at", F.struct("block", "n"))
    first = lines.orderBy("at").first()
    head = json.loads(first["value"]) if first else {}
    if head.pop("type", None) != "document":
        raise DocumentError("the first NDJSON record must be the document header")
    if "schemas" in head or "dependencies" in head:
        raise DocumentError("an NDJSON header holds no records")
    typed = lines.withColumn("type", F.get_json_object("value", "$.type"))
    kinds = {r["type"] for r in typed.select("type").distinct().collect()}  # a handful, or an error
    if kinds - {"document", "schema", "object", "routine", "dependency", "limitations"}:
        raise DocumentError(f"unsupported NDJSON record types: {sorted(map(str, kinds - {'document', 'schema', 'object', 'routine', 'dependency', 'limitations'}))}")
    if head.get("version") == 2 and "limitations" not in kinds:
        raise DocumentError("a version 2 stream ends with its limitations; this one is cut off")
    typed = typed.withColumn("own", F.coalesce(F.get_json_object("value", "$.schema"), F.when(F.col("type") == "schema", F.get_json_object("value", "$.name"))))
    data = typed.where(F.col("type").isin("schema", "object", "routine"))
    if not data.where("own IS NULL").isEmpty():
        data = _carried(data)
    trailer = typed.where("type = 'limitations'").select(F.explode(F.from_json(F.get_json_object("value", "$.data"), "array<string>")).alias("x")).collect()
    used = {"external-queries-v1"} if not data.where("type = 'routine' AND get_json_object(value, '$.data.kind') = 'query'").isEmpty() else set()
    check_header(head, used)
    body = lambda kind, shape: F.from_json(F.get_json_object("value", "$.data"), shape)
    return _flatten(
        spark,
        data.where("type = 'schema'").select(F.col("own").alias("schema")).distinct(),
        data.where("type = 'object'").select(F.col("own").alias("schema"), body("object", OBJECT).alias("o")),
        data.where("type = 'routine'").select(F.col("own").alias("schema"), body("routine", ROUTINE).alias("r")),
        typed.where("type = 'dependency'").select(body("dependency", DEPENDENCY).alias("d")),
        _header(head),
        [*(head.get("limitations") or []), *(r["x"] for r in trailer)],
    )


def _carried(data: DataFrame) -> DataFrame:
    """``own`` of each record, or else the last one before it: within its block by a window of that block; the blocks' last ones go from block to block."""
    lasts = data.groupBy("block").agg(F.max_by("own", F.when(F.col("own").isNotNull(), F.col("n"))).alias("last")).orderBy("block").collect()  # a row a block
    rows, now = [], None
    for r in lasts:
        rows.append((tuple(r["block"]), now))
        now = now if r["last"] is None else r["last"]
    before = data.sparkSession.createDataFrame(rows, "block struct<f:string,b:bigint>, before string")
    within = Window.partitionBy("block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return data.join(F.broadcast(before), "block", "left").withColumn("own", F.coalesce(F.last("own", ignorenulls=True).over(within), "before")).drop("before")


def _ref(c: str) -> Column:
    return F.concat_ws(".", f"{c}.database", f"{c}.schema", F.concat(F.col(f"{c}.name"), F.coalesce(F.concat(F.lit("("), F.col(f"{c}.signature"), F.lit(")")), F.lit(""))), f"{c}.member")


def _flatten(spark: SparkSession, schemas: DataFrame, objects: DataFrame, routines: DataFrame, dependencies: DataFrame, header: dict, notes: list[str]) -> Document:
    # parsed once: everything below reads these
    objects, routines, dependencies = written(objects, "objects"), written(routines, "routines"), written(dependencies, "dependencies")
    o = objects.select("schema", "o.*")
    parts = lambda column: o.select("schema", F.col("name").alias("object"), F.explode(column).alias("x"))
    use = [F.col(f"usage.{c}").alias(c) for c in ("since", "reads", "writes", "scans", "total_ms", "self_ms")]
    null = lambda n: F.lit(None).cast("string").alias(n)
    usage = (
        o.where("usage IS NOT NULL").select("schema", F.col("name").alias("object"), null("member"), null("signature"), *use)
        .unionByName(parts("indexes").select("schema", "object", "x.*").where("usage IS NOT NULL").select("schema", "object", F.col("name").alias("member"), null("signature"), *use))
        .unionByName(routines.select("schema", "r.*").where("usage IS NOT NULL").select("schema", F.col("name").alias("object"), F.col("member_of").alias("member"), F.coalesce("signature", F.lit("")).alias("signature"), *use))
    )
    tables = {
        "schemas": schemas,
        "objects": o.select("schema", "name", "kind", "body", F.size(F.coalesce("columns", F.array())).alias("n_columns")),
        "columns": parts("columns").select("schema", "object", "x.*"),
        "constraints": parts("constraints").select("schema", "object", "x.name", "x.kind", "x.columns", F.col("x.referenced.schema").alias("ref_schema"), F.col("x.referenced.table").alias("ref_table"), F.col("x.referenced.columns").alias("ref_columns")),
        "indexes": parts("indexes").select("schema", "object", "x.name", "x.unique", "x.columns", "x.definition_complete", "x.predicate", "x.has_predicate"),
        "triggers": parts("triggers").select("schema", "object", "x.name", "x.body"),
        "routines": routines.select("schema", "r.name", "r.kind", "r.language", "r.body", "r.signature", "r.member_of", "r.source"),
        "usage": usage,
        "dependencies": dependencies.select(_ref("d.source").alias("source"), _ref("d.target").alias("target"), "d.catalog", "d.dependency_type", F.col("d.source").alias("src"), F.col("d.target").alias("dst")),
    }
    doc = Document(spark, tables, header, tuple(dict.fromkeys(notes)))
    return doc.noted(*duplicate_notes(doc))


def duplicate_notes(doc: Document) -> list[str]:
    """Counts of repeated identities, which building a graph may merge."""
    keys = {"object": ("objects", ["schema", "name"]), "routine": ("routines", ["schema", "name", "signature", "member_of"]), "column": ("columns", ["schema", "object", "name"]), "index": ("indexes", ["schema", "object", "name"]), "constraint": ("constraints", ["schema", "object", "name"]), "trigger": ("triggers", ["schema", "object", "name"])}
    repeated = [getattr(doc, table).groupBy(*key).count().where("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("label"), "n") for label, (table, key) in keys.items()]
    found = {r["label"]: r["n"] for r in reduce(DataFrame.unionAll, repeated).collect()}  # one job for all of them
    return [f"repeated {label} records: {found[label]}" for label in keys if found[label]]


# -- collection context ----------------------------------------------------------------------------------------------


def annotate(doc: Document, source_id: str, schema_filter: list[str] | None = None) -> Document:
    """The document under a source id, narrowed to some schemas; a schema that was asked for and is missing makes it incomplete."""
    header = {**doc.header, "source_id": source_id}
    if schema_filter is None:
        return replace(doc, header=header)
    have = {r["schema"] for r in doc.schemas.where(F.col("schema").isin(*schema_filter)).collect()}
    missing = sorted(set(schema_filter) - have)
    tables = {n: (df.where(F.col("schema").isin(*schema_filter)) if "schema" in df.columns else df.where(F.col("src.schema").isin(*schema_filter))) for n, df in doc.tables.items()}
    header |= {"schema_filter": sorted(schema_filter), "catalog_complete": bool(header.get("catalog_complete")) and not missing}
    return replace(doc, tables=tables, header=header).noted(*(f"requested schema was not collected: {m}" for m in missing))


# -- writing ---------------------------------------------------------------------------------------------------------


def _records(doc: Document) -> tuple[DataFrame, DataFrame]:
    """(schema, o) and (schema, r): objects and routines as nested records, optional fields left out when absent."""
    key = ["schema", "object"]
    gather = lambda df, name, *c: df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*c))).alias(name))
    use = F.when(F.col("reads").isNotNull(), F.struct("since", "reads", "writes", "scans", "total_ms", "self_ms"))
    usage = doc.usage.select("schema", "object", "member", "signature", use.alias("usage"))
    of_object = usage.where("member IS NULL AND signature IS NULL").select("schema", "object", "usage")
    of_index = usage.where("member IS NOT NULL AND signature IS NULL").select("schema", "object", F.col("member").alias("name"), "usage")
    columns = gather(doc.columns, "columns", "ordinal", "name", "data_type", "nullable", "default", "pk_position")
    referenced = F.when(F.col("ref_table").isNotNull(), F.struct(F.col("ref_schema").alias("schema"), F.col("ref_table").alias("table"), F.col("ref_columns").alias("columns")))
    constraints = gather(doc.constraints.withColumn("referenced", referenced), "constraints", "name", "kind", "columns", "referenced")
    indexes = gather(doc.indexes.join(of_index, ["schema", "object", "name"], "left"), "indexes", "name", "unique", "columns", "definition_complete", "predicate", "has_predicate", "usage")
    triggers = gather(doc.triggers, "triggers", "name", "body")
    o = doc.objects.withColumnRenamed("name", "object")
    for df in (columns, constraints, indexes, triggers, of_object):
        o = o.join(df, key, "left")
    lists = [F.coalesce(c, F.array()).alias(c) for c in ("columns", "constraints", "indexes", "triggers")]
    objects = o.select("schema", F.struct(F.col("object").alias("name"), "kind", *lists, "body", "usage").alias("o"))
    of_routine = usage.where("signature IS NOT NULL").select("schema", F.col("object").alias("name"), F.col("member").alias("m"), F.col("signature").alias("s"), "usage")
    r = doc.routines.withColumns({"m": F.col("member_of"), "s": F.coalesce("signature", F.lit(""))})
    r = r.join(of_routine, (r["schema"] == of_routine["schema"]) & (r["name"] == of_routine["name"]) & r["m"].eqNullSafe(of_routine["m"]) & (r["s"] == of_routine["s"]), "left").select(r["schema"], F.struct(r["name"], "kind", "language", "body", "signature", "usage", "member_of", "source").alias("r"))
    return objects, r


def _top(doc: Document, version: int) -> dict:
    head: dict = {"version": version, "dialect": doc.header.get("dialect")}
    if version == 1:
        if not doc.routines.where("kind = 'query'").isEmpty():
            raise DocumentError("external query records need document version 2")
        head["reader"] = doc.header.get("reader")
    else:
        head["producer"] = {"name": doc.header.get("reader") or "plexus"}
        needed = {"usage-v1": not doc.usage.isEmpty(), "package-members-v1": not doc.routines.where("member_of IS NOT NULL").isEmpty(), "catalog-dependencies-v1": not doc.dependencies.isEmpty(), "external-queries-v1": not doc.routines.where("kind = 'query'").isEmpty()}
        head["required_features"] = sorted(f for f, hit in needed.items() if hit)
    context = {k: doc.header[k] for k in ("source_id", "database", "schema_filter", "catalog_complete", "lower_case_table_names", "collation") if doc.header.get(k) is not None}
    return head | ({"context": context} if context else {})


def ndjson_lines(doc: Document, version: int = 2) -> DataFrame:
    """(n, value): the records of a stream in their order; write them as text ordered by n."""
    spark = doc.spark
    objects, routines = _records(doc)
    line = lambda kind, schema, name, value, place: value.select(F.struct(F.lit(place).alias("a"), schema.alias("b"), name.alias("c")).alias("n"), kind.alias("value"))
    put = lambda kind, data: F.to_json(F.struct(F.lit(kind).alias("type"), F.col("schema"), F.col(data).alias("data")))
    none = F.lit("")
    head = spark.createDataFrame([(json.dumps({"type": "document", **_top(doc, version)}, sort_keys=True),)], "value string")
    tail = spark.createDataFrame([(json.dumps({"type": "limitations", "data": list(doc.limitations)}),)], "value string")
    frames = [
        line(F.col("value"), none, none, head, 0),
        line(F.to_json(F.struct(F.lit("schema").alias("type"), F.col("schema").alias("name"))), F.col("schema"), none, doc.schemas, 1),
        line(put("object", "o"), F.col("schema"), F.concat(F.lit("1"), F.col("o.name")), objects, 1),
        line(put("routine", "r"), F.col("schema"), F.concat(F.lit("2"), F.col("r.name"), F.coalesce(F.col("r.signature"), none)), routines, 1),
        line(F.to_json(F.struct(F.lit("dependency").alias("type"), F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "catalog", "dependency_type").alias("data"))), F.col("source"), F.col("target"), doc.dependencies, 2),
        line(F.col("value"), none, none, tail, 3),
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def to_value(doc: Document, version: int = 2) -> dict:
    """The document as parsed JSON. For documents of a size that a single JSON text may have; large ones are streamed as NDJSON."""
    out = {**_top(doc, version), "schemas": [], "limitations": list(doc.limitations)}
    rows = ndjson_lines(doc, version).orderBy("n").select("value").toLocalIterator()
    by_name: dict[str, dict] = {}
    for r in rows:
        x = json.loads(r["value"])
        if x["type"] == "schema":
            by_name[x["name"]] = {"name": x["name"], "objects": [], "routines": []}
            out["schemas"].append(by_name[x["name"]])
        elif x["type"] in ("object", "routine"):
            by_name[x["schema"]][x["type"] + "s"].append(x["data"])
        elif x["type"] == "dependency":
            out.setdefault("dependencies", []).append(x["data"])
    return out
