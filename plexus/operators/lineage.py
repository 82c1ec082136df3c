"""Lineage jobs: what each view, routine or query reads and writes, and which column comes from which."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import parent_of
from ..plans.bundle import GraphBundle

OWNER = "dml-owner:"
LABEL = "::"
# Fixed values of the OpenLineage specification.
EVENT_SCHEMA = "https://openlineage.io/spec/2-0-2/OpenLineage.json#/$defs/RunEvent"
FACET_SCHEMA = "https://openlineage.io/spec/facets/1-2-0/ColumnLineageDatasetFacet.json#/$defs/ColumnLineageDatasetFacet"
JOBS = ("view", "materialized-view", "function", "procedure", "package", "trigger", "query")


def _owner(role):
    """The job id inside ``dml-owner:<id>:<role>``; ids have no bare colon."""
    return F.when(role.startswith(OWNER), F.regexp_extract(role, r"(?s)^dml-owner:((?:[^:]|::)*):[^:]*$", 1))


def direct(bundle: GraphBundle) -> DataFrame:
    """(job, output_column, input_column). An edge belongs to the jobs its origins name, and to the output's own object where an origin names none."""
    edges = bundle.edges.where("kind = 'derives-from'").select("src", "dst").distinct()
    origins = bundle.origins.where("kind = 'derives-from'").select("src", "dst", "role")
    told = edges.join(origins, ["src", "dst"], "left").select("src", "dst", F.coalesce(_owner(F.col("role")), parent_of(F.col("src"))).alias("job"))
    return told.where("job IS NOT NULL").select("job", F.col("src").alias("output_column"), F.col("dst").alias("input_column")).distinct()


def _dataset(bundle: GraphBundle, edges: DataFrame) -> DataFrame:
    """``dataset``: the target itself, or its parent if it is a column."""
    kinds = bundle.vertices.select(F.col("id").alias("dst"), F.col("kind").alias("target_kind"))
    return edges.join(kinds, "dst").withColumn("dataset", F.when(F.col("target_kind") == "column", parent_of(F.col("dst"))).otherwise(F.col("dst")))


def _reads(bundle: GraphBundle) -> DataFrame:
    jobs = bundle.vertices.where(F.col("kind").isin(*JOBS)).select(F.col("id").alias("src"))
    return _dataset(bundle, bundle.edges.where("kind = 'reads'").select("src", "dst").distinct().join(jobs, "src", "left_semi"))


def indirect(bundle: GraphBundle) -> DataFrame:
    """(job, input_column, kind): columns that a job reads to join (JOIN) or to choose rows (FILTER)."""
    use = F.element_at(F.split("role", ":"), -1)
    roles = bundle.origins.where("kind = 'reads'").select("src", "dst", F.when(use == "join", "JOIN").when(use == "predicate", "FILTER").alias("use")).where("use IS NOT NULL")
    return _reads(bundle).where("target_kind = 'column'").join(roles, ["src", "dst"]).select(F.col("src").alias("job"), F.col("dst").alias("input_column"), F.col("use").alias("kind")).distinct()


def jobs(bundle: GraphBundle) -> DataFrame:
    """(job, kind, inputs, outputs, n_direct, n_indirect): dataset ids in order, joined by "|". Jobs without outputs are left out."""
    inputs = _reads(bundle).select(F.col("src").alias("job"), "dataset")
    told = direct(bundle)
    from_columns = told.select("job", parent_of(F.col("input_column")).alias("dataset"))
    written = _dataset(bundle, bundle.edges.where("kind = 'writes'").select("src", "dst").distinct()).select(F.col("src").alias("job"), "dataset")
    views = bundle.vertices.where(F.col("kind").isin("view", "materialized-view")).select(F.col("id").alias("job"), F.col("id").alias("dataset"))
    outputs = written.union(views).union(told.select("job", parent_of(F.col("output_column")).alias("dataset")))
    listed = lambda df, name: df.where("dataset IS NOT NULL").groupBy("job").agg(F.array_join(F.array_sort(F.collect_set("dataset")), "|").alias(name))
    count = lambda df, name: df.groupBy("job").agg(F.count(F.lit(1)).alias(name))
    kinds = bundle.vertices.where(F.col("kind").isin(*JOBS)).select(F.col("id").alias("job"), "kind")
    return (
        kinds.join(listed(outputs, "outputs"), "job")
        .join(listed(inputs.union(from_columns), "inputs"), "job", "left")
        .join(count(told, "n_direct"), "job", "left")
        .join(count(indirect(bundle), "n_indirect"), "job", "left")
        .select("job", "kind", F.coalesce("inputs", F.lit("")).alias("inputs"), "outputs", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_direct", "n_indirect")))
    )


@dataclass(frozen=True)
class Naming:
    """What datasets are called outside: a namespace, and ``database.schema.name``.

    In a merged graph the database is that of the dataset's source, by default its label, and a source may have a namespace of its own; so tables of
    one name in two sources stay two datasets. Jobs keep their ids, which differ by source as they are. Made and checked by ``naming``.
    """

    namespace: str
    database: str | None = None
    merged: bool = False
    namespaces: Mapping[str, str] = field(default_factory=dict)
    databases: Mapping[str, str] = field(default_factory=dict)


def naming(bundle: GraphBundle, namespace: str, database: str | None = None, namespaces: Mapping[str, str] | None = None, databases: Mapping[str, str] | None = None) -> Naming:
    """A Naming for ``bundle``, which is merged if it has vertices and each has a label. A name for a source that is not there, an empty one, a name by source
    for a graph that is not merged, or one database for all of a merged graph is an error: a typing error must not lead to another dataset."""
    by_source = {"namespace": dict(namespaces or {}), "database": dict(databases or {})}
    n = bundle.vertices.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("id").contains(LABEL)).alias("labelled")).first()
    merged = n["all"] > 0 and n["all"] == n["labelled"]
    asked = sorted({x for names in by_source.values() for x in names})
    if asked and not merged:
        raise ValueError("names by source are for merged graphs; this one has no sources")
    if merged and database is not None:
        raise ValueError("a merged graph has a database name a source, not one for all")
    label = F.substring_index("id", LABEL, 1)
    there = {r["label"] for r in bundle.vertices.select(label.alias("label")).where(F.col("label").isin(asked)).distinct().collect()} if asked else set()
    for what, names in by_source.items():
        if unknown := sorted(set(names) - there):
            raise ValueError(f"no source of the merged graph: {', '.join(unknown)}")
        if blank := sorted(x for x, name in names.items() if not name.strip()):
            raise ValueError(f"the {what} of a source must not be empty: {', '.join(blank)}")
    return Naming(namespace, database, merged, by_source["namespace"], by_source["database"])


def _by_source(names: Mapping[str, str], source: Column, otherwise: Column) -> Column:
    found = otherwise
    for label, name in names.items():
        found = F.when(source == label, F.lit(name)).otherwise(found)
    return found


def identities(bundle: GraphBundle, told: Naming) -> DataFrame:
    """(dataset, source, namespace, name) of every vertex but columns; source is null where the graph is not merged."""
    objects = bundle.vertices.where("kind <> 'column'")
    if not told.merged:
        name = F.concat_ws(".", F.lit(told.database), "schema", "name")
        return objects.select(F.col("id").alias("dataset"), F.lit(None).cast("string").alias("source"), F.lit(told.namespace).alias("namespace"), name.alias("name"))
    source = F.substring_index("id", LABEL, 1)
    prefix = F.concat(source, F.lit(LABEL))
    schema = F.when(F.startswith("schema", prefix), F.expr("schema").substr(F.length(prefix) + 1, F.length("schema"))).otherwise(F.col("schema"))
    name = F.concat_ws(".", _by_source(told.databases, source, source), schema, "name")
    return objects.select(F.col("id").alias("dataset"), source.alias("source"), _by_source(told.namespaces, source, F.lit(told.namespace)).alias("namespace"), name.alias("name"))


def _referenced(bundle: GraphBundle) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(jobs, direct, indirect of views, (dataset) of all that events name). Only views carry indirect dependencies: the row set of a routine's effect is
    not one query's."""
    base, told = jobs(bundle), direct(bundle)
    views = bundle.vertices.where(F.col("kind").isin("view", "materialized-view")).select(F.col("id").alias("job"))
    aside = indirect(bundle).join(views, "job", "left_semi")
    sets = [base.select(F.explode(F.split(c, r"\|")).alias("dataset")) for c in ("inputs", "outputs")]
    sets += [df.join(base.select("job"), "job", "left_semi").select(parent_of(F.col("input_column")).alias("dataset")) for df in (told, aside)]
    return base, told, aside, sets[0].union(sets[1]).union(sets[2]).union(sets[3]).where("dataset <> ''").distinct()


def identity_collisions(bundle: GraphBundle, names: str | Naming) -> DataFrame:
    """(namespace, name, ids, across_sources): different datasets that events would call the same. Across sources other names by source part them; within one
    source the cause is a dot inside a schema's or an object's name, which no choice of names mends."""
    told = names if isinstance(names, Naming) else naming(bundle, names)
    used = identities(bundle, told).join(_referenced(bundle)[3], "dataset", "left_semi")
    found = used.groupBy("namespace", "name").agg(F.array_join(F.array_sort(F.collect_set("dataset")), "|").alias("ids"), F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"))
    return found.where("n > 1").select("namespace", "name", "ids", (F.col("sources") > 1).alias("across_sources"))


def openlineage(bundle: GraphBundle, names: str | Naming, event_time: str, producer: str = "plexus") -> DataFrame:
    """(job, event): one run event a job as JSON. The run id is a version 8 UUID made of the event's content, so equal graphs give equal events.

    ``names``: a namespace, or a Naming. Jobs are in the common namespace; a dataset without a vertex is called by its id. Columns of a dataset without
    a vertex are left out.
    """
    naming_ = names if isinstance(names, Naming) else naming(bundle, names)
    base, told, aside, _ = _referenced(bundle)
    named = identities(bundle, naming_).select("dataset", F.struct("namespace", "name").alias("as"))
    place = F.coalesce("as", F.struct(F.lit(naming_.namespace).alias("namespace"), F.col("dataset").alias("name")))
    last = lambda c: F.element_at(F.split(c, r"\."), -1)
    part = ("as.namespace", "as.name", last("input_column").alias("field"))
    with_place = lambda df: df.withColumn("dataset", parent_of(F.col("input_column"))).join(named, "dataset")
    direct_ = F.array(F.struct(F.lit("DIRECT").alias("type"))).alias("transformations")
    fields = with_place(told).groupBy("job", "output_column").agg(F.array_sort(F.collect_set(F.struct(*part, direct_))).alias("inputFields"))
    per_output = fields.groupBy("job", parent_of(F.col("output_column")).alias("dataset")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(last("output_column"), F.struct("inputFields"))))).alias("fields"))
    uses = with_place(aside).groupBy("job", *part).agg(F.array_sort(F.collect_set(F.struct(F.lit("INDIRECT").alias("type"), F.col("kind").alias("subtype")))).alias("transformations"))
    extra = uses.groupBy("job").agg(F.array_sort(F.collect_list(F.struct("namespace", "name", "field", "transformations"))).alias("columns"))
    split = lambda c: base.select("job", F.explode(F.filter(F.split(c, r"\|"), lambda x: x != "")).alias("dataset")).join(named, "dataset", "left").withColumn("as", place)
    outs = split("outputs").join(per_output, ["job", "dataset"], "left").join(extra, "job", "left")
    facet = F.struct(F.lit(producer).alias("_producer"), F.lit(FACET_SCHEMA).alias("_schemaURL"), F.coalesce("fields", F.create_map().cast(dict(per_output.dtypes)["fields"])).alias("fields"), F.col("columns").alias("dataset"))
    known = F.col("fields").isNotNull() | F.col("columns").isNotNull()
    output = F.when(known, F.to_json(F.struct("as.namespace", "as.name", F.struct(facet.alias("columnLineage")).alias("facets")))).otherwise(F.to_json("as"))
    # a map can't be sorted, its text can
    outs = outs.groupBy("job").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("as", output.alias("told")))), lambda x: x["told"]), ",").alias("outputs_"))
    ins = split("inputs").groupBy("job").agg(F.array_sort(F.collect_set("as")).alias("inputs_"))
    start = F.to_json(
        F.struct(
            F.lit("COMPLETE").alias("eventType"),
            F.lit(event_time).alias("eventTime"),
            F.lit(producer).alias("producer"),
            F.lit(EVENT_SCHEMA).alias("schemaURL"),
            F.struct(F.lit(naming_.namespace).alias("namespace"), F.col("job").alias("name")).alias("job"),
            F.coalesce("inputs_", F.array().cast("array<struct<namespace:string,name:string>>")).alias("inputs"),
        )
    )
    body = base.join(outs, "job").join(ins, "job", "left").select("job", F.concat(F.lit("{"), start.substr(F.lit(2), F.length(start) - 2), F.lit(',"outputs":['), "outputs_", F.lit("]}")).alias("body"))
    h = F.sha2("body", 256)
    run = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("8"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))
    return body.select("job", F.concat(F.lit('{"run":{"runId":"'), run, F.lit('"},'), F.expr("substring(body, 2)")).alias("event"))
