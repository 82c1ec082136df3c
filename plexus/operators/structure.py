"""Projection to a level, strongly connected components, cycles, dead objects and retention."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import CONSUMER_KINDS, glob_match, is_dependency, level_of, parent_of
from ..plans.bundle import GraphBundle, union_all
from ..workspace import written
from . import blocks
from .traverse import closure

#: Up to so many arcs a component search runs on the driver; beyond, and always with ``limit=0``, on the executors.
LOCAL_ARCS = 500_000
#: Up to so many vertices that contain others are sent along.
FEW = 50_000


# -- projection ------------------------------------------------------------------------------------------------------


def ancestors(bundle: GraphBundle, level: str) -> DataFrame:
    """(id, ancestor): each vertex's ancestor at ``level`` (schema, object or member). None where there is none or no single one.

    The parent is the only source of a contains edge; without any, the id up to its last dot if that is a vertex. Levels are three deep,
    so three rounds suffice.
    """
    rank = {"schema": 0, "object": 1, "member": 2}[level]
    depth = F.when(level_of(F.col("kind")) == "schema", 0).when(level_of(F.col("kind")) == "object", 1).otherwise(2)
    v = bundle.vertices.select("id", depth.alias("d"))
    below = v.where(F.col("d") > rank)
    held = bundle.edges.where("kind = 'contains'")
    # of what contains something there are few beside what is contained, or else little of it in each
    holders = written(held.select(F.col("src").alias("id")).distinct().join(v, "id"), "holders")
    holders = F.broadcast(holders) if holders.count() <= FEW else holders
    held = held.join(holders.select(F.col("id").alias("src"), F.col("d").alias("pd")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"), F.max("src").alias("other"), F.min("pd").alias("pd"))
    own = written(below.join(held, "id", "left"), "parents")
    single = own.where("parent = other AND parent <> id").select("id", "parent", "pd")
    named = own.where("parent IS NULL").select("id", parent_of(F.col("id")).alias("parent")).where("parent IS NOT NULL AND parent <> id").join(v.select(F.col("id").alias("parent"), F.col("d").alias("pd")), "parent").select("id", "parent", "pd")
    parents = written(single.unionByName(named), "parents")
    done = [v.where(F.col("d") == rank).select("id", F.col("id").alias("ancestor")), parents.where(F.col("pd") == rank).select("id", F.col("parent").alias("ancestor"))]
    now = parents.where(F.col("pd") > rank).select("id", F.col("parent").alias("at"))
    for _ in range(2):
        up = now.join(parents.select(F.col("id").alias("at"), "parent", "pd"), "at")
        done.append(up.where(F.col("pd") == rank).select("id", F.col("parent").alias("ancestor")))
        now = up.where(F.col("pd") > rank).select("id", F.col("parent").alias("at"))
    return union_all(done)


def project(bundle: GraphBundle, level: str) -> GraphBundle:
    """The graph of the ancestors at ``level``: edges that collapse go, edges of a vertex to itself stay, usage is summed (``since`` is the least)."""
    up = written(ancestors(bundle, level), "ancestors")
    a, b = up.select(F.col("id").alias("src"), F.col("ancestor").alias("a")), up.select(F.col("id").alias("dst"), F.col("ancestor").alias("b"))
    ends = bundle.edges.select("src", "dst", "kind").join(b, "dst").select("src", "kind", "b", (F.col("src") == F.col("dst")).alias("loop"))
    # the rows that one vertex contains are as many as its members: their ancestor is one before the other end is looked up
    ends = ends.where("kind <> 'contains'").unionByName(ends.where("kind = 'contains'").distinct())
    moved = ends.join(a, "src").where((F.col("a") != F.col("b")) | F.col("loop"))
    usage = (
        bundle.usage.join(up, "id")
        .groupBy("ancestor")
        .agg(F.min("since").alias("since"), *(F.sum(c).alias(c) for c in ("reads", "writes", "scans", "total_ms", "self_ms")))
        .withColumnRenamed("ancestor", "id")
    )
    keep = up.select(F.col("ancestor").alias("id")).distinct()
    shift = lambda df: df.join(a, "src").join(b, "dst").where(~((F.col("a") == F.col("b")) & (F.col("src") != F.col("dst")))).drop("src", "dst").withColumnsRenamed({"a": "src", "b": "dst"})
    own = lambda df: df.join(up, "id").drop("id").withColumnRenamed("ancestor", "id")
    return bundle.with_tables(
        vertices=bundle.vertices.join(keep, "id", "left_semi"),
        edges=moved.select(F.col("a").alias("src"), F.col("b").alias("dst"), "kind").distinct(),
        evidence=shift(bundle.evidence),
        origins=shift(bundle.origins).distinct(),
        usage=usage,
        analysis=own(bundle.analysis),
        diagnostics=own(bundle.diagnostics),
    )


# -- strongly connected components -----------------------------------------------------------------------------------


def strongly_connected(bundle: GraphBundle, limit: int = LOCAL_ARCS) -> DataFrame:
    """(id, component): the least id of each vertex's strongly connected component over dependency edges, unknown ends included."""
    arcs = written(bundle.arcs(registered=False).select("src", "dst").distinct(), "arcs")
    ids = bundle.vertices.select("id").union(arcs.select("src")).union(arcs.select("dst")).distinct()
    if limit and arcs.count() <= limit:
        found = _tarjan([(r["src"], r["dst"]) for r in arcs.collect()])
        rows = bundle.spark.createDataFrame(found or [("", "")], "id string, component string")
        return ids.join(rows, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    return ids.join(blocks.coloured(arcs), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _tarjan(arcs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Iterative, for bounded graphs."""
    out: dict[str, list[str]] = {}
    for a, b in arcs:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    on: set[str] = set()
    stack: list[str] = []
    found: list[tuple[str, str]] = []
    for start in out:
        if start in index:
            continue
        work = [(start, iter(out[start]))]
        index[start] = low[start] = len(index)
        stack.append(start)
        on.add(start)
        while work:
            at, rest = work[-1]
            for to in rest:
                if to not in index:
                    index[to] = low[to] = len(index)
                    stack.append(to)
                    on.add(to)
                    work.append((to, iter(out[to])))
                    break
                if to in on:
                    low[at] = min(low[at], index[to])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[at])
                if low[at] == index[at]:
                    members = []
                    while True:
                        x = stack.pop()
                        on.discard(x)
                        members.append(x)
                        if x == at:
                            break
                    name = min(members, key=str.encode)
                    found += [(m, name) for m in members]
    return found


def cycles(bundle: GraphBundle, level: str = "object", limit: int = LOCAL_ARCS) -> DataFrame:
    """(cycle_id, members, size, self_loop) after projection: components of several vertices, and vertices that depend on themselves."""
    graph = project(bundle, level) if level != "member" else bundle
    scc = strongly_connected(graph, limit)
    loops = graph.arcs(registered=False).where("src = dst").select(F.col("src").alias("id")).distinct().withColumn("loop", F.lit(True))
    return (
        scc.join(loops, "id", "left")
        .groupBy("component")
        .agg(F.count(F.lit(1)).alias("size"), F.array_join(F.array_sort(F.collect_list("id")), "|").alias("members"), F.max(F.coalesce("loop", F.lit(False))).alias("looped"))
        .where("size > 1 OR looped")
        .select(F.col("component").alias("cycle_id"), "members", "size", ((F.col("size") == 1) & F.col("looped")).alias("self_loop"))
    )


# -- dead objects ----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Retention:
    """``roots``: (glob, reason) kept with all they depend on. ``suppressions``: (glob, reason, until or None) with ISO dates."""

    roots: tuple[tuple[str, str], ...] = ()
    suppressions: tuple[tuple[str, str, str | None], ...] = ()
    as_of: str | None = None


def retained(bundle: GraphBundle, policy: Retention) -> DataFrame:
    """(id, reason): explicit roots and what they depend on, reasons in order, joined by "; "."""
    spark = bundle.spark
    if not policy.roots:
        return spark.createDataFrame([], "id string, reason string")
    globs = F.broadcast(spark.createDataFrame(list(policy.roots), "pattern string, why string"))  # as many rows as the policy has
    v = bundle.vertices.select("id")
    roots = v.join(globs, glob_match(F.col("pattern"), F.col("id"))).select("id", F.concat_ws(": ", F.lit("explicit-root"), "why").alias("reason"))
    roots = written(roots, "roots")
    below = closure(bundle, roots.select("id").distinct()).where("distance > 0").select("id", F.lit("root-dependency").alias("reason"))
    return roots.unionByName(below).groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("reason"))


def suppressed(bundle: GraphBundle, policy: Retention) -> DataFrame:
    """(id, suppression_reason). A suppression needs a reason that is not blank; one with an end needs an ``as_of`` up to it."""
    spark = bundle.spark
    valid = [(g, r) for g, r, until in policy.suppressions if r.strip() and (until is None or (policy.as_of is not None and policy.as_of <= until))]
    if not valid:
        return spark.createDataFrame([], "id string, suppression_reason string")
    globs = F.broadcast(spark.createDataFrame(valid, "pattern string, why string"))
    return bundle.vertices.select("id").join(globs, glob_match(F.col("pattern"), F.col("id"))).groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("why")), "; ").alias("suppression_reason"))


def policy_notes(bundle: GraphBundle, policy: Retention) -> list[str]:
    """What of the policy has no effect."""
    notes = []
    for kind, patterns in (("root", [g for g, _ in policy.roots]), ("suppression", [s[0] for s in policy.suppressions])):
        for g in patterns:
            if bundle.vertices.where(glob_match(F.lit(g), F.col("id"))).isEmpty():
                notes.append(f"retention {kind} matches nothing: {g}")
    for g, reason, until in policy.suppressions:
        if not reason.strip():
            notes.append(f"suppression without a reason is not applied: {g}")
        elif until is not None and policy.as_of is None:
            notes.append(f"suppression with an end needs a date to compare with: {g}")
        elif until is not None and policy.as_of is not None and policy.as_of > until:
            notes.append(f"suppression has ended: {g}")
    return notes


def dead(bundle: GraphBundle, policy: Retention = Retention()) -> DataFrame:
    """(id, kind, reason, reads, writes, suppression_reason): consumers that nothing alive in the database depends on.

    Counters of live dependents (distinct, unknown ones count, cycles keep each other alive) fall as dependents go; then whatever a live
    caller's ambiguous call may mean is taken back, with its dependencies.
    """
    arcs = written(bundle.arcs(registered=False).select("src", "dst").distinct(), "arcs")
    kept = retained(bundle, policy).select("id")
    able = written(bundle.vertices.where(F.col("kind").isin(*CONSUMER_KINDS)).select("id", "kind").join(kept, "id", "left_anti"), "consumers")
    steps = arcs.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    own = arcs.where("src = dst").select(F.col("src").alias("id"))
    depended = arcs.select(F.col("dst").alias("id"), F.lit(True).alias("depended")).distinct()
    gone = blocks.peeled(steps, able.select("id").join(own, "id", "left_anti"))
    gone = written(gone.join(depended, "id", "left").select("id", F.when(F.col("depended"), "allDependentsDead").otherwise("noDependents").alias("reason")), "dead")
    calls = bundle.diagnostics.select(F.col("id").alias("src"), F.explode("candidates").alias("dst")).where("src <> dst").distinct()
    calls = written(calls, "possible-calls")
    if not calls.isEmpty():
        live = calls.select(F.col("src").alias("id")).distinct().join(gone.select("id"), "id", "left_anti")
        into_gone = arcs.union(calls).join(gone.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("a"), F.col("dst").alias("b"))
        saved = blocks.distances(into_gone, live, blocks.FAR).where("distance > 0").select("id")
        called = calls.select(F.col("dst").alias("id")).distinct().withColumn("called", F.lit(True))
        gone = gone.join(saved, "id", "left_anti").join(called, "id", "left").select("id", F.when(F.col("called") & (F.col("reason") == "noDependents"), "allDependentsDead").otherwise(F.col("reason")).alias("reason"))
    return gone.join(able, "id").join(bundle.usage.select("id", "reads", "writes"), "id", "left").join(suppressed(bundle, policy), "id", "left").select("id", "kind", "reason", "reads", "writes", "suppression_reason")
