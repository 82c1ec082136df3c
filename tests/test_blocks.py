"""Searches over blocks of vertices against plain search in memory, with blocks of a few vertices, and the number of their jobs."""

from __future__ import annotations

import random
import uuid

import numpy as np
import pytest

from plexus.operators import blocks, structure, traverse
from plexus.plans.bundle import GraphBundle


def _bfs(arcs, seeds, depth):
    out, far, frontier = {}, dict.fromkeys(seeds, 0), list(seeds)
    for a, b in arcs:
        out.setdefault(a, []).append(b)
    level = 0
    while frontier and level < depth:
        level += 1
        frontier = [b for b in dict.fromkeys(b for a in frontier for b in out.get(a, ())) if b not in far]
        far.update(dict.fromkeys(frontier, level))
    return far


def _graph(seed, n=120, shape="random"):
    r = random.Random(seed)
    names = [f"v{k:04d}" for k in range(n)]
    order = names[:]
    r.shuffle(order)
    if shape == "chain":
        arcs = list(zip(order, order[1:]))
    elif shape == "tree":
        arcs = [(order[r.randrange(max(0, k - 4), k)], order[k]) for k in range(1, n)]
    elif shape == "cycles":
        arcs = [(order[k], order[k // 12 * 12 + (k + 1) % 12]) for k in range(n) if k // 12 * 12 + (k + 1) % 12 < n] + [(order[0], order[50])]
    else:
        arcs = [(r.choice(names), r.choice(names)) for _ in range(int(n * (1 + seed % 3)))]
    return names, order, arcs


def _df(spark, arcs):
    return spark.createDataFrame(arcs, "a string, b string")


@pytest.mark.parametrize("shape", ["random", "chain", "tree", "cycles"])
@pytest.mark.parametrize("width, dense", [(1 << 15, 1 << 18), (40, 12)])
def test_distances(spark, shape, width, dense):
    names, order, arcs = _graph(len(shape), shape=shape)
    for depth, seeds in ((1 << 31, [order[0]]), (5, [order[3], order[70]])):
        got = blocks.distances(_df(spark, arcs), spark.createDataFrame([(s,) for s in seeds], "id string"), depth, (), width, dense)
        assert {r.id: r.distance for r in got.collect()} == _bfs(arcs, seeds, depth)


def test_distances_with_keys_and_awkward_rows(spark):
    names, order, arcs = _graph(2)
    seeds = [("x", order[0]), ("x", order[1]), ("y", order[0]), ("z", "nowhere"), ("z", "nowhere")]
    df = _df(spark, [*arcs, (None, order[0]), (order[1], None)])
    for width in (1 << 15, 40):
        got = blocks.distances(df, spark.createDataFrame(seeds, "key string, id string"), 9, ("key",), width)
        want = {(k, i): d for k in "xyz" for i, d in _bfs(arcs, [i for key, i in seeds if key == k], 9).items()}
        assert {(r.key, r.id): r.distance for r in got.collect()} == want
    assert blocks.distances(df.limit(0), spark.createDataFrame([], "id string"), 9).count() == 0


def _fall(arcs, able):
    ins = {v: {a for a, b in arcs if b == v and a != v} for v in able}
    gone = set()
    while True:
        fresh = {v for v in able if v not in gone and ins[v] <= gone}
        if not fresh:
            return gone
        gone |= fresh


@pytest.mark.parametrize("shape", ["random", "chain", "tree", "cycles"])
@pytest.mark.parametrize("width", [1 << 15, 40])
def test_peeling(spark, shape, width):
    names, order, arcs = _graph(3, shape=shape)
    arcs = list(dict.fromkeys(arcs))
    able = [v for k, v in enumerate(order) if k != 17 and k % 29]
    able += [order[0]] * (order[0] not in able)
    got = blocks.peeled(_df(spark, arcs), spark.createDataFrame([(v,) for v in able], "id string"), width)
    assert {r.id for r in got.collect()} == _fall(arcs, set(able))


@pytest.mark.parametrize("shape, seed", [("random", 0), ("random", 1), ("chain", 2), ("cycles", 3)])
def test_components(spark, shape, seed):
    names, order, arcs = _graph(seed, 60, shape)
    want = {v: c for v, c in structure._tarjan(arcs) if v != c or sum(x == c for _, x in structure._tarjan(arcs)) > 1}
    arcs = list(dict.fromkeys(arcs))
    for width in (1 << 15, 20):
        got = blocks.coloured(spark.createDataFrame(arcs, "src string, dst string"), width)
        assert {r.id: r.component for r in got.collect()} == want


class _Jobs:
    """The Spark jobs that start inside."""

    def __init__(self, spark):
        self.sc = spark.sparkContext

    def __enter__(self):
        self.group = uuid.uuid4().hex
        self.sc.setJobGroup(self.group, "test")
        return self

    def __exit__(self, *_):
        self.n = len(self.sc.statusTracker().getJobIdsForGroup(self.group))
        self.sc.setLocalProperty("spark.jobGroup.id", None)


def _chain(spark, n, shuffled):
    places = np.random.default_rng(4).permutation(n) if shuffled else np.arange(n)
    ids = [f"v{k:05d}" for k in places.tolist()]
    edges = [(a, b, "reads") for a, b in zip(ids, ids[1:])]
    vertices = [(i, "view", i, "s") for i in ids]
    g = GraphBundle(spark, {"vertices": spark.createDataFrame(vertices, "id string, kind string, name string, schema string"), "edges": spark.createDataFrame(edges, "src string, dst string, kind string")}).saved()
    return g, ids


@pytest.mark.parametrize("shuffled", [False, True])
def test_a_long_chain_takes_few_jobs(spark, shuffled):
    g, ids = _chain(spark, 30_000, shuffled)
    arcs, seeds = traverse.oriented(g.arcs(), False), g.vertices.where(f"id = '{ids[0]}'").select("id")
    with _Jobs(spark) as jobs:
        far = {r.id: r.distance for r in traverse.distances(arcs, seeds, local=0).collect()}
    assert far == {i: k for k, i in enumerate(ids)} and jobs.n <= 40, jobs.n
    assert far == {r.id: r.distance for r in traverse.distances(arcs, seeds).collect()}


def test_a_chain_through_many_blocks_takes_a_round_a_digit(spark):
    g, ids = _chain(spark, 4_000, True)
    arcs, seeds = traverse.oriented(g.arcs(), False), g.vertices.where(f"id = '{ids[0]}'").select("id")
    with _Jobs(spark) as jobs:
        far = {r.id: r.distance for r in blocks.distances(arcs, seeds, 1 << 31, (), 100).collect()}
    assert far == {i: k for k, i in enumerate(ids)} and jobs.n <= 120, jobs.n


def test_dead_objects_of_a_chain_take_few_jobs(spark):
    g, ids = _chain(spark, 5_000, True)
    with _Jobs(spark) as jobs:
        found = {r.id: r.reason for r in structure.dead(g).collect()}
    assert found == {i: "allDependentsDead" if k else "noDependents" for k, i in enumerate(ids)} and jobs.n <= 60, jobs.n


def test_components_of_a_long_cycle(spark):
    n = 5_000
    edges = [(f"v{k:05d}", f"v{(k + 1) % n:05d}") for k in range(n)]
    with _Jobs(spark) as jobs:
        assert {r.component for r in blocks.coloured(spark.createDataFrame(edges, "src string, dst string")).collect()} == {"v00000"}
    assert jobs.n <= 80, jobs.n
