"""Projection, components, dead objects, rules, search, unused."""

from __future__ import annotations

import random

import pytest
from test_traverse import graph

from plexus.operators import checks, structure
from plexus.operators.structure import Retention


@pytest.mark.parametrize("limit", [0, 1000])
def test_components(spark, limit):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("g", "g"), ("x", "y"), ("y", "z"), ("ghost1", "ghost1")]
    got = {r.id: r.component for r in structure.strongly_connected(graph(spark, edges), limit).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f", "g": "g", "x": "x", "y": "y", "z": "z", "ghost1": "ghost1"}


def test_long_chain_and_cycle_need_no_recursion():
    n = 30_000
    chain = [(f"v{k}", f"v{k + 1}") for k in range(n)]
    assert len({c for _, c in structure._tarjan(chain)}) == n + 1
    assert len({c for _, c in structure._tarjan([*chain, (f"v{n}", "v0")])}) == 1


def test_cycles_at_object_level(spark):
    edges = [("s.a.x", "s.b.y", "references"), ("s.b", "s.a", "references"), ("s.c", "s.c", "references"), ("s.a", "s.a.x", "contains"), ("s.b", "s.b.y", "contains"), ("s.a.x", "s.a", "reads")]
    kinds = {"s.a.x": "column", "s.b.y": "column"}
    rows = {r.cycle_id: (r.members, r.self_loop) for r in structure.cycles(graph(spark, edges, kinds=kinds)).collect()}
    assert rows == {"s.a": ("s.a|s.b", False), "s.c": ("s.c", True)}


def test_projection_drops_what_collapses_and_sums_usage(spark):
    edges = [("t", "t.a", "contains"), ("u", "u.b", "contains"), ("t.a", "u.b", "references"), ("t.a", "t.a", "references"), ("t", "t.a", "reads"), ("t", "two.m", "contains"), ("u", "two.m", "contains"), ("two.m", "u", "reads")]
    g = graph(spark, edges, kinds={"t.a": "column", "u.b": "column", "two.m": "column"})
    g = g.with_tables(usage=spark.createDataFrame([("t", "2024", 1, 2, None, None, None), ("t.a", "2023", 10, 0, 5, None, None)], "id string, since string, reads long, writes long, scans long, total_ms double, self_ms double"))
    p = structure.project(g, "object")
    assert {tuple(r) for r in p.edges.collect()} == {("t", "u", "references"), ("t", "t", "references")}
    assert tuple(p.usage.first()) == ("t", "2023", 11, 2, 5, None, None)
    assert {r.id for r in p.vertices.collect()} == {"t", "u"}


def _dead(spark, edges, policy=Retention(), diagnostics=None, **kinds):
    g = graph(spark, edges, extra=kinds, kinds=kinds)
    if diagnostics:
        g = g.with_tables(diagnostics=spark.createDataFrame([(o, "SG_CALL_AMBIGUOUS", "m", 1, 1, c) for o, c in diagnostics], "id string, code string, message string, line int, col int, candidates array<string>"))
    return {r.id: r.reason for r in structure.dead(g, policy).collect()}


def test_dead_peels_chains_and_keeps_cycles(spark):
    v = "view"
    assert _dead(spark, [("v3", "v2"), ("v2", "v1"), ("v1", "t")], v1=v, v2=v, v3=v) == {"v3": "noDependents", "v2": "allDependentsDead", "v1": "allDependentsDead"}
    assert _dead(spark, [("v1", "v2"), ("v2", "v1"), ("v3", "v1"), ("v4", "v4")], v1=v, v2=v, v3=v, v4=v) == {"v3": "noDependents"}
    assert _dead(spark, [("trg", "v1"), ("v1", "f", "calls"), ("v2", "f", "calls")], v1=v, v2=v, f="function", trg="trigger") == {"v2": "noDependents"}
    assert _dead(spark, [("ghost", "v1")], v1=v) == {}


def test_dead_respects_roots_and_ambiguous_calls(spark):
    v, f = "view", "function"
    edges = [("v1", "v2"), ("v2", "t")]
    assert _dead(spark, edges, Retention(roots=(("v1", "report"),)), v1=v, v2=v) == {}
    live = [("trg", "caller", "calls"), ("o1", "h", "calls")]
    assert _dead(spark, live, diagnostics=[("caller", ["o1", "o2"])], caller=f, o1=f, o2=f, h=f, trg="trigger") == {}
    assert _dead(spark, [("o1", "h", "calls")], diagnostics=[("caller", ["o1", "o2"])], caller=f, o1=f, o2=f, h=f) == {"caller": "noDependents", "o1": "allDependentsDead", "o2": "allDependentsDead", "h": "allDependentsDead"}


def test_suppressions_need_a_reason_and_a_date(spark):
    g = graph(spark, [], extra=["v1", "v2", "v3", "v4"], kinds=dict.fromkeys(["v1", "v2", "v3", "v4"], "view"))
    policy = Retention(suppressions=(("v1", "kept for audits", None), ("v2", "  ", None), ("v3", "soon", "2024-06-01"), ("v4", "late", "2023-01-01")), as_of="2024-01-01")
    rows = {r.id: r.suppression_reason for r in structure.dead(g, policy).collect()}
    assert rows == {"v1": "kept for audits", "v2": None, "v3": "soon", "v4": None}
    assert structure.dead(g, Retention(suppressions=(("v3", "soon", "2024-06-01"),))).where("suppression_reason IS NOT NULL").count() == 0
    assert len(structure.policy_notes(g, policy)) == 2


def test_rules_cross_dots_and_say_what_matches_nothing(spark):
    g = graph(spark, [("app.v", "core.t"), ("app.v", "core.t", "writes"), ("core.t", "app.v"), ("x.core.t", "app.v")])
    rules = [("a", "app.*", "core.?", None), ("b", "*.t", "app.v", ["reads"]), ("c", "nope*", "*", None)]
    assert sorted(tuple(r) for r in checks.rules(g, rules).collect()) == [("a", "app.v", "core.t", "reads"), ("a", "app.v", "core.t", "writes"), ("b", "core.t", "app.v", "reads"), ("b", "x.core.t", "app.v", "reads")]
    assert checks.unmatched_patterns(g, rules) == ["rule c: no vertex matches nope*"]
    assert checks.rules(g, []).count() == 0


@pytest.mark.parametrize(("pattern", "text", "hit"), [("*", "", True), ("a?c", "abc", True), ("a?c", "a😀c", True), ("a.c", "abc", False), ("*.t", "x\ny.t", True), ("[a]", "a", False), ("A*", "abc", False), ("(x|y)+$", "(x|y)+$", True), ("", "a", False), ("**b", "aab", True)])
def test_globs(spark, pattern, text, hit):
    from pyspark.sql import functions as F

    from plexus.functions import sqlfunctions
    from plexus.model import glob_match

    row = spark.createDataFrame([(pattern, text)], "p string, t string")
    assert row.select(glob_match(F.col("p"), F.col("t"))).first()[0] is hit
    sqlfunctions.register(spark)
    assert row.selectExpr("plexus_glob(p, t)").first()[0] is hit
    assert spark.sql("SELECT plexus_parent('a.b.c'), plexus_parent('a')").first()[:] == ("a.b", None)


def test_search_counts_before_the_cut(spark):
    g = graph(spark, [("s.Orders", "s.t"), ("s.x", "s.Orders"), ("s.x", "s.Orders", "writes"), ("s.Orders", "s.Orders")])
    row = checks.search(g, "orders", counts=True).first()
    assert (row.id, row.total, row.dependents, row.dependencies) == ("s.Orders", 1, 1, 1)
    assert [(r.id, r.total) for r in checks.search(g, "S.*", max_results=2).collect()] == [("s.Orders", 3), ("s.t", 3)]
    assert checks.search(g, "order?").first().id == "s.Orders"
    assert checks.search(g, "orders", kinds=["view"]).count() == 0


def test_unused_facts(spark):
    kinds = {"t": "table", "t.i": "index", "t.u": "constraint", "w": "table", "w.j": "index", "z": "table"}
    g = graph(spark, [("v", "t")], extra=kinds, kinds={**kinds, "v": "view"})
    g = g.with_tables(
        usage=spark.createDataFrame([("t", "2024", 0, 5, 0, None, None), ("t.i", None, 0, 0, None, None, None), ("w", "2024", 0, 0, None, None, None), ("w.j", "2024", 3, 0, None, None, None)], "id string, since string, reads long, writes long, scans long, total_ms double, self_ms double"),
        indexes=spark.createDataFrame([("t.i", "t", "u", True, ["t.a", "t.b"], True, False), ("w.j", "w", "j", False, ["w.a"], True, False)], "index_id string, table_id string, name string, is_unique boolean, columns array<string>, complete boolean, filtered boolean"),
        fks=spark.createDataFrame([("t.f", "t", "f", ["t.a"], "w", ["w.a"], True)], "fk_id string, table_id string, name string, columns array<string>, target_table_id string, target_columns array<string>, complete boolean"),
    )
    rows = {r.id: r.facts for r in checks.unused(g).collect()}
    assert rows == {"t": "bodyDependents", "t.i": "enforcesUniqueness|backsConstraint|coversForeignKeys|windowUnknown"}
    assert {r.kind: r.n for r in checks.unobserved(g).collect()} == {"table": 1}
    assert tuple(checks.stats_totals(g).first()) == (4, 7)


GLOBS = ["*", "?*", "a*", "*b", "*ab*", "a?b", "abc", "", "*.x?", "a*c*", "??", "*abc*x", "a.b*", "b*.?c", "*a*b*c*"]


def test_rules_by_index_equal_every_glob_on_every_edge(spark):
    import re

    rng = random.Random(5)
    ids = sorted({"".join(rng.choice("abc.x") for _ in range(rng.randint(1, 7))) for _ in range(60)})
    edges = sorted({(rng.choice(ids), rng.choice(ids), rng.choice(["reads", "calls"])) for _ in range(150)})
    g = graph(spark, edges, ids)
    wanted = [(f"r{k}", rng.choice(GLOBS), rng.choice(GLOBS), rng.choice([None, ["reads"], []])) for k in range(80)]
    fits = lambda glob, x: re.fullmatch("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob), x, re.S)
    want = {(n, s, d, k) for n, a, b, kinds in wanted for s, d, k in edges if fits(a, s) and fits(b, d) and (kinds is None or k in kinds)}
    found = checks.rules(g, wanted)
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()
    every = {r.id for r in g.vertices.collect()}
    assert checks.unmatched_patterns(g, wanted) == [f"rule {n}: no vertex matches {x}" for n, x in sorted({(n, x) for n, a, b, _ in wanted for x in (a, b)}) if not any(fits(x, v) for v in every)]
    assert checks.rules(g, []).count() == 0
