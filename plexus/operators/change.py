"""Comparing graphs and catalog documents, typed changes, review and policy."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.bundle import GraphBundle, union_all
from ..workspace import written
from .traverse import impact_many

#: Change kinds, fixed wire values; those that need no review.
KINDS = (
    "schema-added", "schema-removed", "object-added", "object-removed", "object-kind-changed", "required-column-added", "column-added", "column-removed",
    "column-type-changed", "column-nullability-changed", "column-default-changed", "column-position-or-key-changed", "constraints-changed", "indexes-changed",
    "index-added", "unique-index-added", "triggers-changed", "definition-changed", "catalog-dependencies-changed",
)
HARMLESS = ("schema-added", "object-added", "column-added", "index-added")
SEVERITIES = ("low", "medium", "high", "critical")


def diff_graph(old: GraphBundle, new: GraphBundle) -> DataFrame:
    """(part, change, id, src, dst, kind, old_kind): vertices and edges added, removed or of another kind. Usage and evidence don't count."""
    v0, v1 = (b.vertices.select("id", F.col("kind").alias(k)) for b, k in ((old, "k0"), (new, "k1")))
    none = lambda c: F.lit(None).cast("string").alias(c)
    change = F.when(F.col("k0").isNull(), "added").when(F.col("k1").isNull(), "removed").otherwise("changed")
    vertices = v0.join(v1, "id", "full_outer").where(~F.col("k0").eqNullSafe(F.col("k1"))).select(F.lit("vertex").alias("part"), change.alias("change"), "id", none("src"), none("dst"), F.coalesce("k1", "k0").alias("kind"), F.when(F.col("k1").isNotNull(), F.col("k0")).alias("old_kind"))
    key = ["src", "dst", "kind"]
    e0, e1 = (b.edges.select(*key).distinct() for b in (old, new))
    side = lambda df, what: df.select(F.lit("edge").alias("part"), F.lit(what).alias("change"), none("id"), "src", "dst", "kind", none("old_kind"))
    return union_all([vertices, side(e1.join(e0, key, "left_anti"), "added"), side(e0.join(e1, key, "left_anti"), "removed")])


# -- documents -------------------------------------------------------------------------------------------------------


def _differs(*columns: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | ~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}"))
    return out


def _both(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Full outer join on ``key``, null meeting null; other columns get o_ and n_, and ``has_o``, ``has_n`` say which side has the row."""
    side = lambda df, p: df.select(*(F.col(c).alias(f"{p}_{c}") for c in df.columns), F.lit(True).alias(f"has_{p}"))
    met = F.lit(True)
    for c in key:
        met = met & F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}"))
    both = side(old, "o").join(side(new, "n"), met, "full_outer")
    return both.withColumns({"has_o": F.coalesce("has_o", F.lit(False)), "has_n": F.coalesce("has_n", F.lit(False)), **{c: F.when(F.col("has_n"), F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")) for c in key}})


def _parts(old, new) -> DataFrame:
    """(id, part, change, detail, object_id, before, after): what ``diff_documents`` says, the object it belongs to and both sides' values as JSON."""
    out = []

    def add(part: str, table: str, key: list[str], values: list[str], id_: Column, owner: Column | None = None, shape=lambda df: df) -> None:
        pair = _both(*(shape(getattr(d, table)).select(*key, *values).distinct() for d in (old, new)), key)
        change = F.when(~F.col("has_o"), "added").when(~F.col("has_n"), "removed").when(_differs(*values), "changed")
        detail = F.concat_ws(",", *(F.when(F.col("has_o") & F.col("has_n") & _differs(v), F.lit(v)) for v in values)) if values else F.lit("")
        side = lambda p: F.when(F.col(f"has_{p}"), F.to_json(F.struct(*(F.col(f"{p}_{c}").alias(c) for c in (*key, *values))), {"ignoreNullFields": "false"}))
        row = (id_.alias("id"), F.lit(part).alias("part"), change.alias("change"), detail.alias("detail"), (id_ if owner is None else owner).alias("object_id"), side("o").alias("before"), side("n").alias("after"))
        out.append(pair.select(*row).where("change IS NOT NULL"))

    dotted = lambda *c: F.concat_ws(".", *c)
    object_ = dotted("schema", "object")
    # a constraint without a name is known by its columns and what they point at
    shown = lambda c: F.concat(F.lit("["), F.concat_ws(",", c), F.lit("]"))
    target = F.concat(F.lit("->"), dotted("ref_schema", "ref_table"), shown("ref_columns"))
    unnamed = F.when(F.col("name").isNull(), F.concat("kind", shown("columns"), F.when(F.col("ref_table").isNotNull(), target).otherwise("")))
    add("schema", "schemas", ["schema"], [], F.col("schema"))
    add("object", "objects", ["schema", "name"], ["kind"], dotted("schema", "name"))
    add("definition", "objects", ["schema", "name"], ["body"], dotted("schema", "name"))
    add("routine", "routines", ["schema", "name", "signature"], ["kind", "language", "body"], F.concat(dotted("schema", "name"), F.lit("("), F.coalesce("signature", F.lit("")), F.lit(")")))
    add("column", "columns", ["schema", "object", "name"], ["data_type", "nullable", "default", "ordinal", "pk_position"], dotted("schema", "object", "name"), object_)
    add("constraint", "constraints", ["schema", "object", "name", "unnamed"], ["kind", "columns", "ref_schema", "ref_table", "ref_columns"], F.concat(object_, F.lit("."), F.coalesce("name", "unnamed")), object_, lambda df: df.withColumn("unnamed", unnamed))
    add("index", "indexes", ["schema", "object", "name"], ["unique", "columns", "predicate"], dotted("schema", "object", "name"), object_)
    add("trigger", "triggers", ["schema", "object", "name"], ["body"], dotted("schema", "object", "name"), object_)
    add("dependency", "dependencies", ["source", "target", "catalog", "dependency_type"], [], F.concat_ws("->", "source", "target"))
    # a body that comes or goes with its object is the object's change
    return union_all(out).where("NOT (part = 'definition' AND change <> 'changed')")


def diff_documents(old, new) -> DataFrame:
    """(id, part, change, detail): schemas, objects, routines, columns, constraints, indexes, triggers, bodies and dependencies. ``old``, ``new``: Documents.

    Usage never counts. Names and signatures that are null are equal to null ones.
    """
    return _parts(old, new).select("id", "part", "change", "detail").distinct()


def changes(old, new) -> DataFrame:
    """(id, kind, object_id, needs_review, evidence): the typed changes between two documents. Parts of an object that came or went are its own change.

    ``evidence``: JSON of each difference behind the change, with the values before and after, sorted.
    """
    d = _parts(old, new)
    split_new = new.columns.select(F.concat_ws(".", "schema", "object", "name").alias("id"), "nullable", "default").distinct()
    whole = d.where("part = 'object' AND change IN ('added', 'removed')").select("object_id", F.lit(True).alias("whole")).distinct()
    parts = d.join(whole, "object_id", "left").where("part IN ('object', 'schema') OR whole IS NULL").join(split_new, "id", "left")
    uniq = new.indexes.select(F.concat_ws(".", "schema", "object", "name").alias("id"), F.col("unique").alias("is_unique")).distinct()
    parts = parts.join(uniq, "id", "left")
    is_, was = (lambda p: F.col("part") == p), (lambda c: F.col("change") == c)
    has = lambda v: F.array_contains(F.split("detail", ","), v)
    one = lambda cond, name: F.when(cond, F.lit(name))
    kinds = F.array_compact(
        F.array(
            one(is_("schema") & was("added"), "schema-added"),
            one(is_("schema") & was("removed"), "schema-removed"),
            one(F.col("part").isin("object", "routine") & was("added"), "object-added"),
            one(F.col("part").isin("object", "routine") & was("removed"), "object-removed"),
            one(F.col("part").isin("object", "routine") & was("changed") & has("kind"), "object-kind-changed"),
            one(is_("column") & was("added") & ~F.coalesce("nullable", F.lit(True)) & F.col("default").isNull(), "required-column-added"),
            one(is_("column") & was("added") & ~(~F.coalesce("nullable", F.lit(True)) & F.col("default").isNull()), "column-added"),
            one(is_("column") & was("removed"), "column-removed"),
            one(is_("column") & was("changed") & has("data_type"), "column-type-changed"),
            one(is_("column") & was("changed") & has("nullable"), "column-nullability-changed"),
            one(is_("column") & was("changed") & has("default"), "column-default-changed"),
            one(is_("column") & was("changed") & (has("ordinal") | has("pk_position")), "column-position-or-key-changed"),
            one(is_("constraint"), "constraints-changed"),
            one(is_("index") & was("added") & F.col("is_unique"), "unique-index-added"),
            one(is_("index") & was("added") & ~F.coalesce("is_unique", F.lit(False)), "index-added"),
            one(is_("index") & ~was("added"), "indexes-changed"),
            one(is_("trigger"), "triggers-changed"),
            one((is_("definition") | is_("routine")) & was("changed") & (has("body") | has("language")), "definition-changed"),
            one(is_("dependency"), "catalog-dependencies-changed"),
        )
    )
    # constraint, trigger and remaining index changes are reported once an object
    lumped = F.col("kind").isin("constraints-changed", "indexes-changed", "triggers-changed")
    told = F.to_json(F.struct("id", "part", "change", "detail", "before", "after"), {"ignoreNullFields": "false"})
    out = parts.select("id", "object_id", told.alias("told"), F.explode(kinds).alias("kind")).select(F.when(lumped, F.col("object_id")).otherwise(F.col("id")).alias("id"), "kind", "object_id", "told")
    out = out.groupBy("id", "kind", "object_id").agg(F.array_sort(F.collect_set("told")).alias("evidence"))  # the differences of one object
    return out.select("id", "kind", "object_id", (~F.col("kind").isin(*HARMLESS)).alias("needs_review"), "evidence")


def comparison_notes(old: dict, new: dict) -> list[str]:
    """Why two documents may not compare: differences in dialect, reader, source, database, filter or completeness."""
    notes = []
    for key, name in (("dialect", "dialect"), ("reader", "reader"), ("source_id", "source"), ("database", "database"), ("schema_filter", "schema filter"), ("catalog_complete", "catalog completeness")):
        a, b = old.get(key), new.get(key)
        if a != b:
            notes.append(f"{name} differs: {a!r} and {b!r}")
    return notes


def review(before: GraphBundle, after: GraphBundle, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes, impacted): changes that need review with where they were looked up, and (change_id, id, distance) of their dependents.

    A change is followed in the graph before it if its object stood there, else in the graph after; all changes of a graph share one search.
    """
    before, after = before.saved("edges"), after.saved("edges")
    ids = before.vertices.select(F.col("id").alias("object_id"), F.lit(True).alias("stood"))
    there = after.vertices.select(F.col("id").alias("object_id"), F.lit(True).alias("stands"))
    named = found.where("needs_review").withColumn("change_id", F.concat_ws("#", "kind", "id"))
    placed = named.drop("evidence").join(ids, "object_id", "left").join(there, "object_id", "left").withColumn("coverage", F.when(F.col("stood"), "before").when(F.col("stands"), "after").otherwise("not-in-graph"))
    placed = written(placed, "placed-changes")  # read once a side and once by the caller
    seeds = lambda side: placed.where(F.col("coverage") == side).select("change_id", F.col("object_id").alias("id"))
    hit = impact_many(before, seeds("before"), "change_id").unionByName(impact_many(after, seeds("after"), "change_id"))
    return placed.select("change_id", "id", "kind", "object_id", "coverage"), hit


# -- policy ----------------------------------------------------------------------------------------------------------


def fingerprint(change: dict, old_source: str, new_source: str) -> str:
    """SHA-256 of the canonical JSON of a change (id, kind, evidence) and of the sources that were compared."""
    payload = {"change": change, "sources": [old_source, new_source], "version": 1}
    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def with_fingerprints(found: DataFrame, old_source: str, new_source: str) -> DataFrame:
    """``found`` with ``fingerprint``, made of the same canonical JSON on the executors: another type, default or body before or after is another change."""
    sources = json.dumps([old_source, new_source], separators=(",", ":"), ensure_ascii=False)
    body = F.concat(F.lit('{"change":'), F.to_json(F.struct("evidence", "id", "kind")), F.lit(f',"sources":{sources},"version":1}}'))
    return found.withColumn("fingerprint", F.sha2(body, 256))


@dataclass(frozen=True)
class Policy:
    """``severity``: by change kind; default high for what needs review, else low. ``waivers``: fingerprint -> (reason, until or None)."""

    threshold: str = "critical"
    severity: dict[str, str] = field(default_factory=dict)
    waivers: dict[str, tuple[str, str | None]] = field(default_factory=dict)
    baseline: frozenset[str] | None = None
    as_of: str | None = None

    def __post_init__(self) -> None:
        unknown = sorted(set(self.severity) - set(KINDS))
        if unknown or self.threshold not in SEVERITIES or set(self.severity.values()) - set(SEVERITIES):
            raise ValueError(f"unknown change kind or severity: {unknown or self.threshold}")


def evaluate(found: DataFrame, policy: Policy, waivers: DataFrame | None = None, baseline: DataFrame | None = None) -> DataFrame:
    """``found`` (with fingerprint) and severity, state (new, existing or no-baseline), waived, fails.

    The policy's own waivers and baseline are small. Large ones come as tables beside it: ``waivers`` (fingerprint, reason, until as a date's text) and
    ``baseline`` (fingerprint, as an earlier report has it). A waiver without a reason, past its day or, with a day, under a policy without ``as_of`` doesn't count.
    """
    spark = found.sparkSession
    order = F.array(*map(F.lit, SEVERITIES))
    severity = F.when(F.col("needs_review"), "high").otherwise("low")
    for kind, s in policy.severity.items():
        severity = F.when(F.col("kind") == kind, s).otherwise(severity)
    valid = [(f, True) for f, (reason, until) in policy.waivers.items() if reason.strip() and (until is None or (policy.as_of is not None and policy.as_of <= until))]
    waived = spark.createDataFrame(valid, "fingerprint string, waived boolean")
    if waivers is not None:
        in_time = F.col("until").isNull() | F.coalesce(F.lit(policy.as_of) <= F.col("until"), F.lit(False))
        waived = waived.unionByName(waivers.where((F.trim("reason") != "") & in_time).select("fingerprint", F.lit(True).alias("waived"))).distinct()
    known = spark.createDataFrame([(f, True) for f in policy.baseline or ()], "fingerprint string, known boolean")
    if baseline is not None:
        known = known.unionByName(baseline.select("fingerprint", F.lit(True).alias("known"))).distinct()
    out = found.withColumn("severity", severity).join(waived, "fingerprint", "left").join(known, "fingerprint", "left").withColumn("waived", F.coalesce("waived", F.lit(False)))
    state = F.lit("no-baseline") if policy.baseline is None and baseline is None else F.when(F.col("known"), "existing").otherwise("new")
    out = out.withColumn("state", state).drop("known")
    return out.withColumn("fails", ~F.col("waived") & (F.col("state") != "existing") & (F.array_position(order, F.col("severity")) >= F.array_position(order, F.lit(policy.threshold))))
