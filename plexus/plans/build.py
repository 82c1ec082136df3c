"""From a catalog document to a graph: vertices, structural edges, foreign keys, metadata, usage and catalog dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import CONSUMER_KINDS, escape
from ..sources.document import Document
from ..workspace import written
from .bundle import GraphBundle, union_all

#: In the order in which members of an object are met; the first to take a name keeps it. Fixed values.
MEMBERS = ("column", "constraint", "index", "trigger")


def object_id(schema: str | Column, name: str | Column) -> Column:
    col = lambda x: F.col(x) if isinstance(x, str) else x
    return F.concat(escape(col(schema)), F.lit("."), escape(col(name)))


def routine_id(r: Column | None = None) -> Column:
    """schema[.package].name(signature); no parentheses without a signature."""
    name = F.concat(escape(F.col("name")), F.coalesce(F.concat(F.lit("("), escape(F.col("signature")), F.lit(")")), F.lit("")))
    return F.concat(escape(F.col("schema")), F.lit("."), name)


def _members(doc: Document) -> DataFrame:
    """(schema, object, name, kind, base, id): members with their ids; a name that another kind took gets @kind."""
    rows = union_all([getattr(doc, t).select("schema", "object", "name", F.lit(1 << i).alias("seq")) for i, t in enumerate(("columns", "constraints", "indexes", "triggers"))]).where("name IS NOT NULL AND name <> ''")
    # a name's kinds are bits of one number, so that names are dealt out and met once
    named = rows.groupBy("schema", "object", "name").agg(F.bit_or("seq").alias("kinds"))
    places = F.array_compact(F.array(*(F.when(F.col("kinds").bitwiseAND(F.lit(1 << i)) != 0, i) for i in range(len(MEMBERS)))))
    rows = named.select("schema", "object", "name", F.array_min(places).alias("first"), F.explode(places).alias("seq"))
    base = F.concat(object_id("schema", "object"), F.lit("."), escape(F.col("name")))
    rows = rows.withColumns({"kind": F.element_at(F.array(*map(F.lit, MEMBERS)), F.col("seq") + 1), "base": base})
    return rows.select("schema", "object", "name", "kind", "seq", "base", "first", F.when(F.col("seq") == F.col("first"), F.col("base")).otherwise(F.concat("base", F.lit("@"), "kind")).alias("id"))


def build(doc: Document) -> GraphBundle:
    """The structural graph. Names that don't resolve to exactly one vertex give a limitation and no edge."""
    spark = doc.spark
    notes: list[DataFrame] = []
    members = written(_members(doc), "members")
    notes.append(members.where("seq > first").select(F.concat(F.lit("member id collision: "), "base", F.lit(" is taken by another kind; the "), "kind", F.lit(" is "), "id").alias("note")))
    vertex = lambda df, id_, kind, name: df.select(id_.alias("id"), kind.alias("kind"), name.alias("name"), F.col("schema"))
    edge = lambda df, src, dst, kind, detail: df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), detail.alias("detail"))

    routines = doc.routines.distinct()
    packages = routines.where("kind = 'package'").select("schema", F.col("name").alias("member_of"), F.lit(True).alias("packaged")).distinct()
    routines = routines.join(packages, ["schema", "member_of"], "left")
    plain = routine_id()
    inside = F.concat(escape(F.col("schema")), F.lit("."), escape(F.col("member_of")), F.lit("."), escape(F.col("name")), F.coalesce(F.concat(F.lit("("), escape(F.col("signature")), F.lit(")")), F.lit("")))
    routines = written(routines.withColumn("id", F.when(F.col("packaged"), inside).otherwise(plain)), "routines")
    notes.append(routines.where("member_of IS NOT NULL AND packaged IS NULL").select(F.concat(F.lit("package of a routine was not collected: "), "schema", F.lit("."), "member_of", F.lit("."), "name").alias("note")))
    # an object and a routine may share an id: the object keeps it
    object_ids = doc.objects.select(object_id("schema", "name").alias("id"), F.lit(True).alias("taken")).distinct()
    routines = routines.join(object_ids, "id", "left").withColumn("id", F.when(F.col("taken"), F.concat("id", F.lit("@"), "kind")).otherwise(F.col("id"))).drop("taken")

    schema_names = doc.schemas.select("schema").distinct()
    vertices = union_all(
        [
            vertex(schema_names, escape(F.col("schema")), F.lit("schema"), F.col("schema")),
            vertex(doc.objects, object_id("schema", "name"), F.col("kind"), F.col("name")),
            vertex(members, F.col("id"), F.col("kind"), F.col("name")),
            vertex(routines, F.col("id"), F.col("kind"), F.col("name")),
        ]
    )
    vertices = written(vertices.groupBy("id").agg(F.min_by(F.struct("kind", "name", "schema"), F.col("kind")).alias("v")).select("id", "v.kind", "v.name", "v.schema"), "vertices")

    holder = F.when(F.col("packaged"), F.concat(escape(F.col("schema")), F.lit("."), escape(F.col("member_of")))).otherwise(escape(F.col("schema")))
    edges = [
        edge(doc.objects, escape(F.col("schema")), object_id("schema", "name"), "contains", F.lit("catalog")),
        edge(members, object_id("schema", "object"), F.col("id"), "contains", F.lit("catalog")),
        edge(routines, holder, F.col("id"), "contains", F.lit("catalog")),
        edge(members.where("kind = 'trigger'"), F.col("id"), object_id("schema", "object"), "fires", F.concat(F.lit("trigger "), "name", F.lit(" on "), "object")),
    ]
    fk = _foreign_keys(doc, members, vertices)
    edges += [fk["object"], fk["column"]]
    notes.append(fk["notes"])
    depends, open_ = _catalog_dependencies(doc, vertices)
    edges.append(depends)
    notes.append(open_)
    found = written(union_all(edges).distinct(), "edges")

    usage_id = F.when(F.col("signature").isNotNull(), F.concat(escape(F.col("schema")), F.lit("."), escape(F.col("object")), F.when(F.col("signature") != "", F.concat(F.lit("("), escape(F.col("signature")), F.lit(")"))).otherwise(F.lit(""))))
    usage_id = usage_id.when(F.col("member").isNotNull(), F.concat(object_id("schema", "object"), F.lit("."), escape(F.col("member")))).otherwise(object_id("schema", "object"))
    usage = doc.usage.withColumn("id", usage_id)
    renamed = members.where("kind = 'index'").select(F.col("base").alias("id"), F.col("id").alias("real"))
    usage = usage.join(renamed, "id", "left").withColumn("id", F.coalesce("real", "id")).groupBy("id").agg(*(F.first(c).alias(c) for c in ("since", "reads", "writes", "scans", "total_ms", "self_ms")))

    column_ids = members.where("kind = 'column'")
    columns = doc.columns.join(column_ids.select("schema", "object", "name", "id"), ["schema", "object", "name"]).select(
        object_id("schema", "object").alias("table_id"), F.col("id").alias("column_id"), "name", "data_type", "nullable", F.col("default").isNotNull().alias("has_default"), "ordinal", "pk_position"
    )
    said = spark.createDataFrame([(n,) for n in doc.limitations] or [("",)], "note string").where("note <> ''")
    return GraphBundle(
        spark,
        {
            "vertices": vertices,
            "edges": found.select("src", "dst", "kind").distinct(),
            "evidence": found.select("src", "dst", "kind", F.lit("catalog").alias("layer"), "detail"),
            "usage": usage,
            "columns": columns,
            "indexes": _indexes(doc, members),
            "fks": fk["meta"],
            "limitations": union_all([said, *notes]).distinct(),
        },
        doc.complete,
    )


def _resolved(doc: Document, rows: DataFrame, column_ids: DataFrame, keys: list[str], names: str, owner: tuple[str, str]) -> DataFrame:
    """``rows`` (with a unique key) with ``ids``: the ids of the named columns in order, those that exist."""
    c = column_ids.select(F.col("schema").alias("cs"), F.col("object").alias("co"), F.col("name").alias("cn"), F.col("id").alias("cid"))
    each = rows.select(*keys, F.col(owner[0]).alias("cs"), F.col(owner[1]).alias("co"), F.posexplode(names).alias("pos", "cn")).join(c, ["cs", "co", "cn"])
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "cid"))), lambda x: x["cid"]).alias("ids"))


def _indexes(doc: Document, members: DataFrame) -> DataFrame:
    key = ["schema", "object", "name"]
    ids = _resolved(doc, doc.indexes.select(*key, "columns"), members.where("kind = 'column'"), key, "columns", ("schema", "object"))
    named = members.where("kind = 'index'").select(*key, "id")
    whole = F.coalesce("definition_complete", F.lit(False)) & (F.size(F.coalesce("ids", F.array().cast("array<string>"))) == F.size("columns"))
    filtered = F.coalesce("has_predicate", F.when(F.col("predicate").isNotNull(), F.lit(True)), F.when(F.col("definition_complete"), F.lit(False)))
    return doc.indexes.join(ids, key, "left").join(named, key).select(
        F.col("id").alias("index_id"), object_id("schema", "object").alias("table_id"), "name", F.coalesce("unique", F.lit(False)).alias("is_unique"), F.coalesce("ids", F.array().cast("array<string>")).alias("columns"), whole.alias("complete"), filtered.alias("filtered")
    )


def _foreign_keys(doc: Document, members: DataFrame, vertices: DataFrame) -> dict[str, DataFrame]:
    key = ["schema", "object", "name"]
    fks = doc.constraints.where("ref_table IS NOT NULL").withColumn("ts", F.coalesce("ref_schema", "schema")).withColumns({"src": object_id("schema", "object"), "dst": object_id("ts", "ref_table")})
    known = vertices.select(F.col("id").alias("dst"))
    met = written(fks.join(known, "dst", "left_semi"), "foreign-keys")
    notes = fks.join(known, "dst", "left_anti").select(F.concat(F.lit("foreign key "), F.concat_ws(".", *key), F.lit(": the referenced table was not collected: "), "dst").alias("note"))
    detail = F.concat(F.lit("fk "), "name", F.lit(": "), "src", F.lit("("), F.array_join("columns", ","), F.lit(") -> "), "dst", F.lit("("), F.array_join(F.coalesce("ref_columns", F.array().cast("array<string>")), ","), F.lit(")"))
    out = {"object": met.select("src", "dst", F.lit("references").alias("kind"), detail.alias("detail")), "notes": notes}
    columns = members.where("kind = 'column'")
    pairs = met.select("schema", "object", "name", "ts", "ref_table", F.explode(F.arrays_zip(F.col("columns").alias("l"), F.col("ref_columns").alias("r"))).alias("p")).where("p.l IS NOT NULL AND p.r IS NOT NULL AND p.r <> ''")
    a = columns.select("schema", "object", F.col("name").alias("l"), F.col("id").alias("a"))
    b = columns.select(F.col("schema").alias("ts"), F.col("object").alias("ref_table"), F.col("name").alias("r"), F.col("id").alias("b"))
    out["column"] = (
        pairs.select("schema", "object", "name", "ts", "ref_table", F.col("p.l").alias("l"), F.col("p.r").alias("r")).join(a, ["schema", "object", "l"]).join(b, ["ts", "ref_table", "r"]).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("references").alias("kind"), F.concat(F.lit("fk "), "name", F.lit(": "), "l", F.lit(" -> "), "r").alias("detail"))
    )
    own = _resolved(doc, met.select(*key, "columns"), columns, key, "columns", ("schema", "object"))
    pk = doc.columns.where("pk_position > 0").groupBy("schema", "object").agg(F.transform(F.array_sort(F.collect_list(F.struct("pk_position", "name"))), lambda x: x["name"]).alias("pk")).select(F.col("schema").alias("ts"), F.col("object").alias("ref_table"), "pk")
    named = F.filter(F.coalesce("ref_columns", F.array().cast("array<string>")), lambda x: x != "")
    targets = met.join(pk, ["ts", "ref_table"], "left").withColumn("names", F.when(F.size(named) > 0, named).otherwise(F.col("pk")))
    far = _resolved(doc, targets.where("names IS NOT NULL").select(*key, "ts", "ref_table", "names"), columns, key, "names", ("ts", "ref_table")).withColumnRenamed("ids", "far")
    fk_ids = members.where("kind = 'constraint'").select(*key, "id")
    none = F.array().cast("array<string>")
    size = lambda c: F.size(F.coalesce(c, none))
    whole = F.lit(doc.complete) & (size("ids") == F.size("columns")) & (size("far") == F.size("columns")) & (F.size("columns") > 0)
    out["meta"] = targets.join(own, key, "left").join(far, key, "left").join(fk_ids, key, "left").select(
        F.coalesce("id", F.concat("src", F.lit("."), escape(F.col("name")))).alias("fk_id"), F.col("src").alias("table_id"), "name", F.coalesce("ids", none).alias("columns"), F.col("dst").alias("target_table_id"), F.coalesce("far", none).alias("target_columns"), whole.alias("complete")
    )
    return out


def _catalog_dependencies(doc: Document, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """depends-on edges of references that name one vertex each, in this database; the rest as limitations."""
    own = doc.header.get("database")
    deps = doc.dependencies.select("src", "dst", "catalog", "dependency_type").withColumn("n", F.monotonically_increasing_id())
    local = lambda c: F.col(f"{c}.database").isNull() | (F.col(f"{c}.database") == F.lit(own))
    deps = written(deps.withColumn("local", F.coalesce(local("src") & local("dst"), F.lit(False))), "dependencies")
    v = vertices.select(F.col("id").alias("vid"), F.col("kind").alias("vkind"), F.regexp_replace("id", r"@[a-z-]+$", "").alias("bare"))
    sides = []
    for c in ("src", "dst"):
        ref = deps.where("local").select("n", F.col(f"{c}.schema").alias("schema"), F.col(f"{c}.name").alias("name"), F.col(f"{c}.kind").alias("k"), F.col(f"{c}.member").alias("member"), F.col(f"{c}.signature").alias("signature"))
        want = F.concat(object_id("schema", "name"), F.coalesce(F.concat(F.lit("("), escape(F.col("signature")), F.lit(")")), F.lit("")), F.coalesce(F.concat(F.lit("."), escape(F.col("member"))), F.lit("")))
        routine = F.col("k").isin(*CONSUMER_KINDS) & F.col("signature").isNull() & F.col("member").isNull()
        hit = ref.withColumns({"want": want, "loose": F.coalesce(routine, F.lit(False))}).join(v, (F.col("bare") == F.col("want")) & (F.col("k").isNull() | F.col("member").isNotNull() | (F.col("vkind") == F.col("k"))))
        sides.append(hit.groupBy("n").agg(F.countDistinct("vid").alias(f"{c}_n"), F.min("vid").alias(f"{c}_id")))
    told = deps.join(sides[0], "n", "left").join(sides[1], "n", "left")
    good = told.where("src_n = 1 AND dst_n = 1")
    edges = good.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), F.lit("depends-on").alias("kind"), F.concat_ws(" ", "catalog", "dependency_type").alias("detail"))
    bad = told.where("NOT coalesce(src_n = 1 AND dst_n = 1, false)")
    why = F.when(~F.col("local"), "another database").otherwise("not one vertex")
    notes = bad.select(F.concat(F.lit("catalog dependency not resolved ("), why, F.lit("): "), F.concat_ws(".", "src.schema", "src.name"), F.lit(" -> "), F.concat_ws(".", "dst.database", "dst.schema", "dst.name")).alias("note"))
    return edges, notes


# -- guesses ---------------------------------------------------------------------------------------------------------


def inferred_keys(bundle: GraphBundle) -> tuple[DataFrame, DataFrame]:
    """(edges, ambiguous): ``inferred`` edges from a table with an undeclared ``<stem>_id`` column to the one table of its schema named
    after the stem (itself, with s or es, or y as ies) that has an ``id`` column; several such tables are counted, not chosen from."""
    tables = bundle.vertices.where("kind = 'table'").select("id", "name", "schema")
    columns = bundle.columns.select("table_id", "column_id", F.lower("name").alias("column"))
    declared = bundle.fks.select(F.explode("columns").alias("column_id"))
    stems = (
        columns.where("column LIKE '%\\_id' AND length(column) > 3")
        .join(declared, "column_id", "left_anti")
        .join(tables.select(F.col("id").alias("table_id"), "schema"), "table_id")
        .withColumn("stem", F.expr("substring(column, 1, length(column) - 3)"))
    )
    names = F.array_distinct(F.array_compact(F.array(F.col("stem"), F.concat("stem", F.lit("s")), F.concat("stem", F.lit("es")), F.when(F.col("stem").endswith("y"), F.expr("concat(substring(stem, 1, length(stem) - 1), 'ies')")))))
    with_id = columns.where("column = 'id'").select("table_id").distinct()
    targets = tables.join(with_id, tables["id"] == with_id["table_id"], "left_semi").select(F.col("id").alias("dst"), F.lower("name").alias("wanted"), "schema")
    hits = stems.withColumn("wanted", F.explode(names)).join(targets, ["schema", "wanted"]).groupBy("table_id", "column_id").agg(F.countDistinct("dst").alias("n"), F.min("dst").alias("dst"))
    edges = hits.where("n = 1").select(F.col("table_id").alias("src"), "dst", F.lit("inferred").alias("kind")).distinct()
    return edges, hits.where("n > 1").select("column_id", "n")
