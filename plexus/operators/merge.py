"""Merging graphs of several sources under namespaces, and edges between databases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import SCHEMAS
from ..plans.build import object_id
from ..plans.bundle import GraphBundle, union_all

SEPARATOR = "::"
#: Columns that hold ids, by table.
IDS = {
    "vertices": ("id",), "edges": ("src", "dst"), "evidence": ("src", "dst"), "origins": ("src", "dst"), "usage": ("id",), "analysis": ("id",), "diagnostics": ("id",),
    "columns": ("table_id", "column_id"), "indexes": ("index_id", "table_id"), "fks": ("fk_id", "table_id", "target_table_id"), "limitations": (),
}
ID_LISTS = {"diagnostics": ("candidates",), "indexes": ("columns",), "fks": ("columns", "target_columns")}
OWNER_ROLE = "dml-owner:"


def split_namespace(id_: str) -> tuple[str | None, str]:
    """(namespace or None, the id within it)."""
    head, mark, rest = id_.partition(SEPARATOR)
    return (head, rest) if mark else (None, id_)


def namespaced(bundle: GraphBundle, label: str) -> GraphBundle:
    """Every id under ``label``; roles that name an owner follow, notes say where they come from."""
    put = lambda c: F.concat(F.lit(label + SEPARATOR), c)
    out = {}
    for name in SCHEMAS:
        df = getattr(bundle, name)
        changed = {c: put(F.col(c)) for c in IDS[name]} | {c: F.transform(c, put) for c in ID_LISTS.get(name, ())}
        if name == "origins":
            changed["role"] = F.when(F.col("role").startswith(OWNER_ROLE), F.concat(F.lit(OWNER_ROLE + label + SEPARATOR), F.expr(f"substring(role, {len(OWNER_ROLE) + 1})"))).otherwise(F.col("role"))
        if name == "vertices":
            changed["schema"] = put(F.col("schema"))
        if name == "limitations":
            changed["note"] = F.concat(F.lit(f"{label}: "), "note")
        out[name] = df.withColumns(changed) if changed else df
    return GraphBundle(bundle.spark, out, bundle.complete)


def merge_graphs(inputs: list[tuple[str, GraphBundle]]) -> GraphBundle:
    """One graph of all; labels must differ, and the metadata is complete only if each one's is."""
    labels = [label for label, _ in inputs]
    if len(set(labels)) != len(labels):
        raise ValueError("labels must differ")
    if any(not x or SEPARATOR in x for x in labels):
        raise ValueError("a label must not be empty nor hold the separator")
    spaces = [namespaced(b, label) for label, b in sorted(inputs, key=lambda x: x[0])]
    return GraphBundle(inputs[0][1].spark, {n: union_all([getattr(s, n) for s in spaces]) for n in SCHEMAS}, all(b.complete for _, b in inputs))


def foreign_facts(label: str, doc) -> DataFrame:
    """(source, database, schema, name) of the catalog references of a Document that lead into another database; ``source`` is the merged id."""
    own = F.lit(doc.header.get("database"))
    away = doc.dependencies.where(F.col("dst.database").isNotNull() & ~F.col("dst.database").eqNullSafe(own))
    return away.select(F.concat(F.lit(label + SEPARATOR), object_id("src.schema", "src.name")).alias("source"), "dst.database", "dst.schema", "dst.name").distinct()


def with_references(merged: GraphBundle, documents: list) -> GraphBundle:
    """``merged`` with the edges between its databases that the catalogs of ``documents``, (label, Document), know of."""
    if not documents:
        return merged
    facts = union_all([foreign_facts(label, doc) for label, doc in documents])
    databases = merged.spark.createDataFrame([(label, doc.header.get("database")) for label, doc in documents], "label string, database string")
    edges, notes = cross_database_edges(merged, facts, databases)
    proof = edges.select("src", "dst", "kind", F.lit("catalog").alias("layer"), F.lit("reference to another database").alias("detail"))
    return merged.with_tables(edges=union_all([merged.edges, edges]).distinct(), evidence=union_all([merged.evidence, proof]), limitations=union_all([merged.limitations, notes]).distinct())


def cross_database_edges(merged: GraphBundle, facts: DataFrame, databases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, limitations) from catalog facts (source id, database, schema, name[, kind]) whose target is one vertex of one merged source.

    ``databases``: (label, database). A fact that meets no source, several, no vertex or several vertices gives a note and no edge.
    """
    facts = facts.withColumn("__fact", F.monotonically_increasing_id())
    sources = facts.join(databases, "database", "left")
    v = merged.vertices.select(F.col("id").alias("dst"), F.col("name").alias("vname"), F.col("schema").alias("vschema"))
    hits = sources.join(v, (F.concat(F.col("label"), F.lit(SEPARATOR), F.col("schema")) == F.col("vschema")) & (F.col("name") == F.col("vname")), "left")
    counted = hits.groupBy("__fact", "source", "database", "schema", "name").agg(F.countDistinct("dst").alias("n"), F.min("dst").alias("dst"))
    edges = counted.where("n = 1").select(F.col("source").alias("src"), "dst", F.lit("depends-on").alias("kind")).distinct()
    notes = counted.where("n <> 1").select(F.concat(F.lit("cross-database reference not resolved: "), F.concat_ws(".", "database", "schema", "name"), F.lit(" ("), F.col("n").cast("string"), F.lit(" matches)")).alias("note")).distinct()
    return edges, notes
