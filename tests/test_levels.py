"""Searches over many arcs and few levels: by a join a level, without numbering the graph, with the rows of a plain search."""

from __future__ import annotations

import random

import pytest

from plexus.operators import blocks, traverse
from plexus.plans import rowgraph
from plexus.plans.bundle import GraphBundle

KINDS = ("references", "reads", "contains", "calls")


def _graph(spark, seed):
    r = random.Random(seed)
    names = [f"v{k:02d}" for k in range(40)]
    edges = sorted({(r.choice([*names, "ghost"]), r.choice([*names, "ghost"]), r.choice(KINDS)) for _ in range(110)})
    vertices = [(v, "view", v, "s") for v in names]
    return GraphBundle(spark, {"vertices": spark.createDataFrame(vertices, "id string, kind string, name string, schema string"), "edges": spark.createDataFrame(edges, "src string, dst string, kind string")}), names, edges


def _reached(names, edges, root, incoming, depth):
    """id -> (distance, kinds, via), level by level."""
    arcs = [(d, s, k) if incoming else (s, d, k) for s, d, k in edges if k != "contains" and s in names and d in names and s != d]
    far, level = {root: 0}, 0
    while level < depth and (new := {b for a, b, _ in arcs if far.get(a) == level and b not in far}):
        level += 1
        far.update(dict.fromkeys(new, level))
    told = {}
    for a, b, k in arcs:
        if far.get(a, depth) < depth and b in far:
            told.setdefault(b, []).append((a, k))
    return {v: (d, "|".join(k for k in traverse.ORDER if k in {x for _, x in told[v]}), min(a for a, _ in told[v] if far[a] == d - 1)) for v, d in far.items() if d}


@pytest.fixture
def many(monkeypatch):
    """Every graph has many arcs, and blocks are not for them."""

    def no(*_, **__):
        raise AssertionError("the graph was numbered")

    monkeypatch.setattr(traverse, "LOCAL_ARCS", 3)
    monkeypatch.setattr(blocks, "distances", no)
    monkeypatch.setattr(traverse, "LEVELS", 40, raising=False)


@pytest.mark.parametrize("small", [0, 50_000])
def test_reach_and_query(spark, many, monkeypatch, small):
    monkeypatch.setattr(traverse, "SMALL", small, raising=False)
    g, names, edges = _graph(spark, 5)
    for incoming, depth in ((True, 99), (False, 2)):
        got = {r.id: (r.distance, r.edges, r.via) for r in traverse.reach(g, "v03", incoming, depth).collect()}
        want = _reached(names, edges, "v03", incoming, depth)
        assert got == want and len(want) > 3
    sides = {(r.direction, r.id) for r in traverse.query(g, "v03", 2).collect()} - {("self", "v03")}
    assert sides == {(s, v) for s, i in (("dependents", True), ("dependencies", False)) for v in _reached(names, edges, "v03", i, 2)}
    assert traverse.reach(g, "nobody", True).count() == 0


def test_many_subjects(spark, many):
    g, names, edges = _graph(spark, 6)
    seeds = spark.createDataFrame([("x", "v01"), ("y", "v02"), ("z", "ghost")], "key string, id string")
    got = {(r.key, r.id): r.distance for r in traverse.impact_many(g, seeds, "key").collect()}
    assert got == {(k, v): t[0] for k, s in (("x", "v01"), ("y", "v02")) for v, t in _reached(names, edges, s, True, 99).items()}


def test_very_many_subjects_share_each_level(spark, monkeypatch):
    """By blocks, each of them would get the arcs of its block; also beyond the levels that a search of one subject takes."""

    def no(*_, **__):
        raise AssertionError("the graph was numbered")

    monkeypatch.setattr(blocks, "distances", no)
    g = GraphBundle(spark, {"vertices": spark.range(20).selectExpr("concat('v', id) AS id", "'view' AS kind", "'v' AS name", "'s' AS schema"), "edges": spark.range(11).selectExpr("concat('v', id) AS src", "concat('v', id + 1) AS dst", "'reads' AS kind")}).saved()
    seeds = spark.range(traverse.SEARCHES + 5 if hasattr(traverse, "SEARCHES") else 1005).selectExpr("concat('k', id) AS key", "concat('v', id % 20) AS id")
    got = {(r.key, r.id): r.distance for r in traverse.impact_many(g, seeds, "key").collect()}
    assert got == {(f"k{k}", f"v{v}"): k % 20 - v for k in range(1005) for v in range(k % 20) if k % 20 <= 11}


def test_paths_share_a_search(spark, many):
    g, names, edges = _graph(spark, 7)
    want = _reached(names, edges, "v00", False, 99)
    found = traverse.searched(g, "v00")
    for to in sorted(want)[::5]:
        paths = [r.path for r in traverse.all_paths(g, "v00", to, found=found).collect()]
        assert paths and all(len(p) == want[to][0] + 1 and p[0] == "v00" and p[-1] == to for p in paths)


def test_a_deep_search_turns_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(traverse, "LOCAL_ARCS", 3)
    monkeypatch.setattr(traverse, "LEVELS", 2)
    g, names, edges = _graph(spark, 5)
    assert {r.id: (r.distance, r.edges, r.via) for r in traverse.reach(g, "v03", True, local=0).collect()} == _reached(names, edges, "v03", True, 99)


def test_row_graph_is_saved_without_what_contains_what(spark, tmp_path):
    rows = [(1, 1, 5, 7), (1, 1, 5, 7), (1, 1, 6, 7), (2, None, 5, 7), (None, 2, 5, 7)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(5,), (6,)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    names = ("part", "lineitem")
    plain, saved = rowgraph.row_graph(spark, str(tmp_path), names), rowgraph.row_graph(spark, str(tmp_path), names, saved=True)
    edges = sorted(map(tuple, saved.edges.collect()))
    assert edges == sorted(map(tuple, plain.edges.collect())) == sorted(set(edges))
    assert [e for e in edges if e[2] == "references"] == [("lineitem.1-1", "part.5", "references"), ("lineitem.1-1", "part.6", "references"), ("lineitem.2", "part.5", "references")]
    assert {r.id for r in saved.vertices.collect()} == {"part", "lineitem", "part.5", "part.6", "lineitem.1-1", "lineitem.2"}


def test_large_tables_let_finished_shuffles_go(spark, monkeypatch, tmp_path):
    """Shuffle files of a step that has ended stay until the driver collects its garbage; a large table asks for that."""
    from plexus import workspace

    monkeypatch.setattr(workspace, "LARGE", 0, raising=False)
    seen = []
    monkeypatch.setattr(workspace.gc, "collect", lambda *_: seen.append(1)) if hasattr(workspace, "gc") else None
    workspace.written(spark.range(10), "rows")
    assert seen
