"""Rules, search, unused objects, statistics, diagnostics and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import globindex
from ..model import STATES, glob_match, is_dependency
from ..plans.bundle import GraphBundle
from .structure import project


# -- architecture rules ----------------------------------------------------------------------------------------------


def rules(bundle: GraphBundle, rule_set: list[tuple[str, str, str, list[str] | None]], level: str | None = None) -> DataFrame:
    """(rule, src, dst, kind): edges that a rule (name, from glob, to glob, kinds or None) forbids.

    A rule is found by the longer key of its two globs (see ``globindex``), so edges meet rules by equality and regexes run on what is
    left. Rules are sent along, those without any literal piece as an array that each edge tries.
    """
    graph = project(bundle, level) if level else bundle
    spark = bundle.spark
    edges = graph.edges.where(is_dependency(F.col("kind"))).select("src", "dst", "kind").distinct()
    indexed, loose = [], []
    for name, a, b, kinds in rule_set:
        found = [(k[1], side, k) for side, g in (("src", a), ("dst", b)) if (k := globindex.key_of(g))]
        if found:
            _, side, key = max(found)
            indexed.append((f"{side}|{globindex.told(key)}", name, a, b, kinds, (side, key[0], key[1])))
        else:
            loose.append((name, a, b, kinds))
    shape = "rule string, from_glob string, to_glob string, kinds array<string>"
    hit = lambda r: glob_match(r("from_glob"), F.col("src")) & glob_match(r("to_glob"), F.col("dst")) & (r("kinds").isNull() | F.array_contains(r("kinds"), F.col("kind")))
    out = edges.select(F.lit("").alias("rule"), "src", "dst", "kind").limit(0)
    if indexed:
        table = F.broadcast(spark.createDataFrame([x[:5] for x in indexed], f"key string, {shape}"))
        has = F.concat(*(globindex.tagged(f"{side}|", globindex.keys(F.col(side), {(k, n) for *_, (s, k, n) in indexed if s == side})) for side in ("src", "dst")))
        out = edges.withColumn("key", F.explode(has)).join(table, "key").where(hit(F.col)).select("rule", "src", "dst", "kind")
    if loose:
        struct = lambda r: F.struct(F.lit(r[0]).alias("rule"), F.lit(r[1]).alias("from_glob"), F.lit(r[2]).alias("to_glob"), (F.array(*map(F.lit, r[3])) if r[3] is not None else F.lit(None).cast("array<string>")).alias("kinds"))
        tried = F.filter(F.array(*map(struct, loose)), lambda r: hit(lambda c: r[c]))
        out = out.unionByName(edges.withColumn("r", F.explode(tried)).select(F.col("r.rule").alias("rule"), "src", "dst", "kind"))
    return out


def unmatched_patterns(bundle: GraphBundle, rule_set: list[tuple[str, str, str, list[str] | None]], level: str | None = None) -> list[str]:
    """Notes on globs that match no vertex: such a rule checks nothing."""
    graph = project(bundle, level) if level else bundle
    patterns = sorted({(name, g) for name, a, b, _ in rule_set for g in (a, b)})
    globs = sorted({g for _, g in patterns})
    keyed = [(globindex.told(k), g, k[:2]) for g in globs if (k := globindex.key_of(g))]
    ids = graph.vertices.select("id").distinct()
    met: set[str] = set()
    if keyed:
        table = F.broadcast(bundle.spark.createDataFrame([x[:2] for x in keyed], "key string, pattern string"))
        found = ids.withColumn("key", F.explode(globindex.keys(F.col("id"), {x[2] for x in keyed}))).join(table, "key").where(glob_match(F.col("pattern"), F.col("id")))
        met |= {r["pattern"] for r in found.select("pattern").distinct().collect()}  # as many as the rules have
    met |= {g for g in globs if not globindex.key_of(g) and not ids.where(glob_match(F.lit(g), F.col("id"))).isEmpty()}
    return [f"rule {name}: no vertex matches {g}" for name, g in patterns if g not in met]


# -- search ----------------------------------------------------------------------------------------------------------


def search(bundle: GraphBundle, text: str, kinds: list[str] | None = None, max_results: int = 100, counts: bool = False) -> DataFrame:
    """(id, kind, name, total[, dependents, dependencies]): ids or names with ``text`` in any case; a glob over the whole if it has * or ?."""
    v = bundle.vertices
    low = text.lower()
    if "*" in text or "?" in text:
        hit = glob_match(F.lit(low), F.lower("id")) | glob_match(F.lit(low), F.lower("name"))
    else:
        hit = F.lower("id").contains(low) | F.lower("name").contains(low)
    found = v.where(hit) if kinds is None else v.where(hit & F.col("kind").isin(*kinds))
    found = found.select("id", "kind", "name").distinct()
    total = found.agg(F.count(F.lit(1)).alias("total"))
    kept = found.orderBy("id").limit(max_results).join(F.broadcast(total), F.col("total") >= 0)
    if not counts:
        return kept
    arcs = bundle.arcs(registered=False).where("src <> dst")
    ins = arcs.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("dependents"))
    outs = arcs.groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("dependencies"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return kept.join(ins, "id", "left").join(outs, "id", "left").select("id", "kind", "name", "total", zero("dependents"), zero("dependencies"))


# -- unused ----------------------------------------------------------------------------------------------------------


def unused(bundle: GraphBundle) -> DataFrame:
    """(id, kind, reads, scans, since, facts): tables and indexes that usage says nobody reads.

    A table also needs no (or an uncollected) scan, and no index with reads. Without usage nothing is a candidate: see ``unobserved``.
    ``facts`` lists, in order and joined by "|", what speaks for or against a removal.
    """
    seen = bundle.vertices.where(F.col("kind").isin("table", "index")).select("id", "kind").join(bundle.usage, "id")
    owner = bundle.indexes.select(F.col("index_id").alias("id"), "table_id")
    read_tables = bundle.usage.where("reads > 0").join(owner, "id").select(F.col("table_id").alias("id")).distinct()
    idle = seen.where("reads = 0 AND (kind = 'index' OR coalesce(scans, 0) = 0)").join(read_tables.withColumn("read", F.lit(True)), "id", "left").where("kind = 'index' OR read IS NULL").drop("read")
    idx = bundle.indexes.select(F.col("index_id").alias("id"), F.col("table_id").alias("t"), "is_unique", "columns", "complete", F.coalesce("filtered", F.lit(True)).alias("filtered"), F.col("name").alias("index_name"))
    keys = bundle.fks.select(F.col("table_id").alias("t"), F.col("columns").alias("fk_columns"))
    covers = idx.where("complete AND NOT filtered").join(keys, "t").where("slice(columns, 1, size(fk_columns)) = fk_columns").select("id").distinct().withColumn("covers", F.lit(True))
    backs = bundle.vertices.where("kind = 'constraint'").select(F.col("name").alias("index_name"), F.regexp_extract("id", r"(?s)^(.*)\.[^.]*$", 1).alias("t")).distinct().withColumn("backs", F.lit(True))
    blind = idx.select(F.col("id").alias("i"), F.col("t").alias("id")).join(bundle.usage.select(F.col("id").alias("i")), "i", "left_anti").select("id").distinct().withColumn("blind", F.lit(True))
    bodies = bundle.arcs(registered=False).where("src <> dst").groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("users"))
    told = idle.join(idx.select("id", "t", "is_unique", "index_name", F.lit(True).alias("known")), "id", "left").join(covers, "id", "left").join(backs, ["t", "index_name"], "left").join(blind, "id", "left").join(bodies, "id", "left")
    fact = lambda cond, name: F.when(cond, F.lit(name))
    index, table = F.col("kind") == "index", F.col("kind") == "table"
    facts = F.array_compact(
        F.array(
            fact(F.col("is_unique"), "enforcesUniqueness"),
            fact(F.col("backs"), "backsConstraint"),
            fact(F.col("covers"), "coversForeignKeys"),
            fact(index & F.col("known").isNull(), "metadataUnavailable"),
            fact(table & (F.col("users") > 0), "bodyDependents"),
            fact(table & F.col("blind"), "indexWithoutUsage"),
            fact(table & F.col("scans").isNull(), "scanCountUnavailable"),
            fact(F.col("since").isNull(), "windowUnknown"),
        )
    )
    return told.select("id", "kind", "reads", "scans", "since", F.array_join(facts, "|").alias("facts"))


def unobserved(bundle: GraphBundle) -> DataFrame:
    """(kind, n): tables and indexes without usage; missing is not zero."""
    return bundle.vertices.where(F.col("kind").isin("table", "index")).join(bundle.usage.select("id"), "id", "left_anti").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# -- reports ---------------------------------------------------------------------------------------------------------


def stats(bundle: GraphBundle) -> DataFrame:
    """(id, kind, since, reads, writes, scans, total_ms, self_ms) of every vertex with usage."""
    return bundle.vertices.select("id", "kind").join(bundle.usage, "id").select("id", "kind", "since", "reads", "writes", "scans", "total_ms", "self_ms")


def stats_totals(bundle: GraphBundle) -> DataFrame:
    """One row: observed, vertices."""
    return bundle.vertices.select("id").join(bundle.usage.select("id", F.lit(1).alias("u")), "id", "left").agg(F.count("u").alias("observed"), F.count(F.lit(1)).alias("vertices"))


def summary(bundle: GraphBundle) -> DataFrame:
    """(part, kind, n): vertices and edges by kind."""
    v = bundle.vertices.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit("vertex").alias("part"), "kind", "n")
    e = bundle.edges.select("src", "dst", "kind").distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("part"), "kind", "n")
    return v.unionByName(e)


def diagnostics(bundle: GraphBundle, subject: str | None = None) -> DataFrame:
    """(id, state, scope, code, message, candidates) in order of id; ``subject`` narrows it."""
    a = bundle.analysis if subject is None else bundle.analysis.where(F.col("id") == subject)
    return a.select("id", "state", "scope").join(bundle.diagnostics.select("id", "code", "message", F.array_join("candidates", "|").alias("candidates")), "id", "left")


def diagnostics_summary(bundle: GraphBundle) -> DataFrame:
    """(state, n) for each of the states, zeros included; no rows at all where no analysis is available."""
    states = bundle.spark.createDataFrame([(s,) for s in STATES], "state string")
    n = bundle.analysis.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    any_ = bundle.analysis.limit(1).select(F.lit(True).alias("available"))
    return states.join(n, "state", "left").join(F.broadcast(any_), F.col("available")).select("state", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
