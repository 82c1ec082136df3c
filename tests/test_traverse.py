"""Traversals on small graphs: distances, tie-breaks, budgets, several roots, paths."""

from __future__ import annotations

import random
from collections import deque

import pytest

from plexus.operators import traverse
from plexus.plans.bundle import GraphBundle, normalised


def graph(spark, edges, extra=(), kinds=None):
    ids = {x for a, b, *_ in edges for x in (a, b)} | set(extra)
    rows = [(i, (kinds or {}).get(i, "table"), i.rsplit(".", 1)[-1], "s") for i in sorted(ids) if not i.startswith("ghost")]
    return GraphBundle(
        spark,
        {
            "vertices": spark.createDataFrame(rows, "id string, kind string, name string, schema string"),
            "edges": spark.createDataFrame([(a, b, k[0] if k else "reads") for a, b, *k in edges], "src string, dst string, kind string"),
        },
    ).saved()


DIAMOND = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("a", "b", "calls"), ("e", "a"), ("a", "x", "contains"), ("b", "ghost"), ("c", "b")]


@pytest.mark.parametrize("local", [0, 1000])
def test_reach_has_least_via_and_all_kinds(spark, monkeypatch, local):
    monkeypatch.setattr(traverse, "LOCAL_ARCS", local)
    g = graph(spark, DIAMOND)
    rows = {r.id: (r.distance, r.edges, r.via) for r in traverse.reach(g, "a", incoming=False).collect()}
    assert rows == {"b": (1, "reads|calls", "a"), "c": (1, "reads", "a"), "d": (2, "reads", "b"), "e": (3, "reads", "d")}
    near = {r.id: (r.distance, r.edges) for r in traverse.reach(g, "a", incoming=False, depth=1).collect()}
    assert near == {"b": (1, "reads|calls"), "c": (1, "reads")}
    assert {r.id for r in traverse.impact(g, "d").collect()} == {"a", "b", "c", "e"}
    assert traverse.reach(g, "nobody", True).count() == 0


def test_query_reports_self_edges_apart(spark):
    g = graph(spark, [("a", "a", "references"), ("a", "b"), ("c", "a")])
    rows = {(r.direction, r.id): r.edges for r in traverse.query(g, "a").collect()}
    assert rows == {("dependents", "c"): "reads", ("dependencies", "b"): "reads", ("self", "a"): "references"}


def test_names_are_never_guessed(spark):
    g = graph(spark, [("s.t", "q.t"), ("s.u", "s.t")])
    assert [tuple(r) for r in traverse.resolve(g, "s.t").collect()] == [("s.t", "exact")]
    assert sorted(tuple(r) for r in traverse.resolve(g, "t").collect()) == [("q.t", "candidate"), ("s.t", "candidate")]
    assert [tuple(r) for r in traverse.resolve(g, "u").collect()] == [("s.u", "unique-name")]
    assert traverse.resolve(g, "z").count() == 0


def test_walk_agrees_with_reach_and_keeps_budgets(spark):
    g = graph(spark, DIAMOND)
    report = traverse.walk(g, "a", incoming=False)
    assert report == traverse.walk(g, "a", incoming=False, local=False)
    assert [r[0] for r in report.rows] == ["b", "c", "d", "e"] and report.complete and report.visited == 5
    assert report.examined == 9  # ghosts and arcs to the root count
    assert {(r[0], r[2], r[3], r[4]) for r in report.rows} == {tuple(r[c] for c in ("id", "distance", "edges", "via")) for r in traverse.reach(g, "a", False).collect()}
    cut = traverse.walk(g, "a", incoming=False, budget=traverse.Budget(max_visited=3))
    assert [r[0] for r in cut.rows] == ["b", "c"] and cut.reasons == {"visited-limit"} and not cut.complete
    cut = traverse.walk(g, "a", incoming=False, budget=traverse.Budget(max_edges=2))
    assert [r[0] for r in cut.rows] == ["b"] and cut.examined == 2 and cut.reasons == {"edge-limit"}
    cut = traverse.walk(g, "a", incoming=False, max_results=1)
    assert cut.reasons == {"result-limit"} and cut.complete and cut.truncated
    assert traverse.walk(g, "zz", False).reasons == {"root-not-found"}
    assert traverse.walk(g, "a", False, budget=traverse.Budget(max_visited=0)).reasons == {"visited-limit"}
    assert "cancelled" not in traverse.walk(g, "a", False, cancel=lambda: False).reasons


def _far(edges, root, reverse):
    near = {}
    for a, b, *_ in edges:
        near.setdefault(b if reverse else a, set()).add(a if reverse else b)
    out, queue = {root: 0}, deque([root])
    while queue:
        x = queue.popleft()
        for y in near.get(x, ()):
            if y not in out:
                out[y] = out[x] + 1
                queue.append(y)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    ids = [f"v{k:02d}" for k in range(25)]
    edges = sorted({(rng.choice(ids), rng.choice(ids)) for _ in range(45)})
    g = graph(spark, edges, ids)
    for reverse in (True, False):
        want = _far(edges, "v00", reverse)
        assert {r.id: r.distance for r in traverse.reach(g, "v00", reverse).collect()} == {k: d for k, d in want.items() if d}
        for depth in (1, 3, traverse.UNLIMITED):
            assert traverse.walk(g, "v00", reverse, depth) == traverse.walk(g, "v00", reverse, depth, local=False)
        roots = ["v01", "v02", "v03"]
        far = {r: _far(edges, r, reverse) for r in roots}
        rows = {r[0]: (r[2], r[5]) for r in traverse.walk_roots(g, roots, reverse).rows}
        expect = {}
        for v in ids:
            mine = [(d[v], k) for k, (r, d) in enumerate(far.items()) if v in d and r != v]
            if mine:
                expect[v] = (min(mine)[0], sorted(k for _, k in mine))
        assert rows == expect
    many = spark.createDataFrame([("one", "v01"), ("two", "v02")], "key string, id string")
    got = {(r.key, r.id): r.distance for r in traverse.impact_many(g, many, "key").collect()}
    assert got == {(k, v): d for k, r in (("one", "v01"), ("two", "v02")) for v, d in _far(edges, r, True).items() if d}


def test_paths_are_all_the_shortest(spark):
    g = graph(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("a", "b", "calls"), ("d", "e"), ("a", "z"), ("z", "y"), ("y", "d")])
    report = traverse.paths(g, "a", "d")
    assert [(p, k) for _, p, k in report.rows] == [(["a", "b", "d"], ["reads|calls", "reads"]), (["a", "c", "d"], ["reads", "reads"])]
    assert [p for _, p, _ in traverse.paths(g, "a", "d", max_paths=1).rows] == [["a", "b", "d"]]
    assert traverse.paths(g, "a", "d", max_paths=1).reasons == {"path-limit"}
    assert traverse.paths(g, "a", "a").rows == [(0, ["a"], [])]
    assert traverse.paths(g, "d", "a").rows == [] and traverse.paths(g, "d", "a").complete
    assert traverse.paths(g, "a", "e", depth=2).reasons == {"depth-limit"}
    assert traverse.paths(g, "a", "q").reasons == {"root-not-found"}


@pytest.mark.parametrize("seed", range(2))
def test_searches_on_executors_equal_those_in_memory(spark, seed):
    rng = random.Random(10 + seed)
    ids = [f"v{k:02d}" for k in range(30)]
    edges = sorted({(rng.choice(ids), rng.choice(ids), rng.choice(["reads", "calls"])) for _ in range(80)})
    g = graph(spark, edges, ids).saved()
    wide = [*ids, *ids, "v05", "v06", "v07", "v05", "v08", "nowhere"]  # more than a word of bits, with repeats
    for roots, depth, incoming in ((["v01", "v02", "zz", "v01"], traverse.UNLIMITED, True), (wide, 2, False)):
        report = traverse.walk_roots(g, roots, incoming, depth, max_results=1000)
        got = [tuple(r) for r in traverse.reach_roots(g, roots, incoming, depth).orderBy("depth", "id").collect()]
        assert got == report.rows
    assert traverse.reach_roots(g, ["zz"], True).count() == traverse.reach_roots(g, [], True).count() == 0
    for to in ids[1:6]:
        for most in (1000, 2):
            report = traverse.paths(g, "v00", to, max_paths=most)
            rows = sorted(traverse.all_paths(g, "v00", to, max_paths=most).collect())
            assert [(r.path_no, r.path, r.kinds) for r in rows] == report.rows
            assert all(r.truncated == ("path-limit" in report.reasons) for r in rows)
            assert most < 1000 or all(r.paths_found == len(rows) for r in rows)
    assert traverse.all_paths(g, "v00", "v00").first().path == ["v00"] and traverse.all_paths(g, "v00", "zz").count() == 0


def test_explain_lists_every_kind_with_its_evidence(spark):
    g = graph(spark, DIAMOND).with_tables(evidence=spark.createDataFrame([("a", "b", "reads", "catalog", "y"), ("a", "b", "reads", "catalog", "y"), ("a", "b", "reads", "body-parse", "x")], "src string, dst string, kind string, layer string, detail string"))
    rows = {(r.src, r.dst, r.kind): (r.evidence, r.total_edges) for r in traverse.explain(g, "a").collect()}
    assert len(rows) == 5 and rows["a", "b", "reads"] == ("body-parse:x; catalog:y; catalog:y", 5) and ("a", "x", "contains") in rows
    assert traverse.explain(g, "a", 2).count() == 2


def test_bundle_keeps_invariants_and_comes_back(spark, tmp_path):
    g = graph(spark, [("a", "b")])
    g = g.with_tables(
        edges=g.edges.union(g.edges),
        origins=spark.createDataFrame([("a", "b", "reads", "h", "r", 1, 1), ("q", "b", "reads", "h", "r", 1, 1)], "src string, dst string, kind string, body_hash string, role string, line int, col int"),
        analysis=spark.createDataFrame([("a", "partial", "object", "h"), ("nobody", "complete", "object", "h")], "id string, state string, scope string, body_hash string"),
        diagnostics=spark.createDataFrame([("a", "SG_CALL_AMBIGUOUS", "m", 1, 1, ["b", "ghost"])], "id string, code string, message string, line int, col int, candidates array<string>"),
    )
    n = normalised(g)
    assert n.edges.count() == 1 and n.origins.count() == 1 and n.analysis.count() == 1
    assert n.diagnostics.first().candidates == ["b"]
    assert {r.note for r in n.limitations.collect()} == {"origins without their edge: 1", "analysis records without their vertex: 1"}
    n.write(f"{tmp_path}/g")
    back = GraphBundle.read(spark, f"{tmp_path}/g")
    assert back.edges.collect() == n.edges.collect() and back.complete is False
