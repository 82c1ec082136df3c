"""Traversals over dependency edges.

Two engines with the same results. ``reach`` is unlimited and stays on the executors: over many arcs it goes level by level for LEVELS levels, a join
with the arcs each; what has not ended by then, or has few arcs, see ``blocks``. The budgeted walks keep their state on
the driver, which the budget bounds, and only fetch the frontier's arcs, at most as many as the budget still allows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import EDGE_KINDS, joined_kinds, kind_order
from ..plans.bundle import GraphBundle, union_all
from ..workspace import discard, written
from . import blocks
from .localgraph import local_graph

UNLIMITED = 1 << 31
#: Up to so many arcs, a search over one adjacency is done where it is small: on the driver. Beyond, and always with 0, on the executors.
LOCAL_ARCS = 300_000
#: Beyond so many arcs, a search first goes level by level, as long as it has no more than so many levels.
LEVELS = 8
#: More searches at once than this share each level's join too, for so many levels: by blocks, each would get the arcs of its block again.
SEARCHES, DEEPEST = 1000, 256
#: A level of up to so many rows is sent to the vertices instead of shuffling them.
SMALL = 50_000
ORDER = {k: i for i, k in enumerate(EDGE_KINDS)}


@dataclass(frozen=True)
class Budget:
    max_visited: int = 100_000
    max_edges: int = 1_000_000


@dataclass
class Report:
    """A traversal's rows and what is known about its completeness."""

    rows: list
    visited: int = 0
    examined: int = 0
    reasons: set = field(default_factory=set)
    found: bool = True

    @property
    def complete(self) -> bool:
        return not self.reasons - {"result-limit"}

    @property
    def truncated(self) -> bool:
        return bool(self.reasons)


# -- names -----------------------------------------------------------------------------------------------------------


def resolve(bundle: GraphBundle, name: str) -> DataFrame:
    """(id, status): the vertex with that id, else the only one with that name; several are ``candidate`` rows, never a guess."""
    v = bundle.vertices
    exact = v.where(F.col("id") == name).select("id", F.lit("exact").alias("status"))
    named = v.where(F.col("name") == name).select("id").distinct()
    n = named.agg(F.count(F.lit(1)).alias("n"))
    by_name = named.join(F.broadcast(n), F.col("n") > 0).select("id", F.when(F.col("n") == 1, "unique-name").otherwise("candidate").alias("status"))
    # an exact hit hides names
    hit = exact.agg(F.count(F.lit(1)).alias("hits"))
    return exact.unionByName(by_name.join(F.broadcast(hit), F.col("hits") == 0).select("id", "status"))


# -- unlimited, distributed ------------------------------------------------------------------------------------------


def oriented(arcs: DataFrame, incoming: bool) -> DataFrame:
    """(a, b, kind): from the expanded end to the next one."""
    a, b = ("dst", "src") if incoming else ("src", "dst")
    return arcs.select(F.col(a).alias("a"), F.col(b).alias("b"), "kind")


def distances(arcs: DataFrame, seeds: DataFrame, depth: int = UNLIMITED, keys: tuple[str, ...] = (), local: int | None = None, vertices: DataFrame | None = None) -> DataFrame:
    """(keys..., id, distance) of everything reached from ``seeds`` (keys..., id); seeds have distance 0.

    ``keys`` carry independent searches through one loop. ``arcs`` are oriented; with ``vertices`` (id) only those are reached, else all ends. The
    number of arcs decides where the search runs (see LOCAL_ARCS and LEVELS); the result is the same.
    """
    on = [*keys, "id"]
    local = LOCAL_ARCS if local is None else local
    sown_many = bool(keys) and seeds.limit(SEARCHES + 1).count() > SEARCHES
    if sown_many or _many(arcs):
        found = _levels(arcs, vertices, seeds, depth, keys, most=DEEPEST if sown_many else LEVELS)
        if found is not None:
            return found[0]
    real = arcs
    if vertices is not None:
        real = arcs.join(vertices.select(F.col("id").alias("a")), "a", "left_semi").join(vertices.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")
    if local:
        few = real.select("a", "b").where("a <> b").limit(local + 1).toArrow()
        sown = seeds.select(*on).distinct().limit(local + 1).toArrow()
        if few.num_rows <= local and sown.num_rows <= (local if not keys else SEARCHES):
            return _local_distances(few, sown, depth, seeds, on)
    return blocks.distances(real, seeds, depth, keys)


def _many(arcs: DataFrame) -> bool:
    return arcs.select("a").limit(LOCAL_ARCS + 1).count() > LOCAL_ARCS


def _mask(kind: Column) -> Column:
    mask = F.lit(0)
    for k, i in ORDER.items():
        mask = F.when(kind == k, 1 << i).otherwise(mask)
    return mask


def _named(mask: str) -> Column:
    return F.concat_ws("|", *(F.when(F.col(mask).bitwiseAND(F.lit(1 << i)) != 0, k) for k, i in ORDER.items()))


def _hashed(df: DataFrame) -> DataFrame:
    """With a hash before the id in the key of a join: ids begin alike, so sorting by them alone compares them to their ends."""
    return df.withColumn("h", F.xxhash64("a"))


def _levels(arcs: DataFrame, vertices: DataFrame | None, seeds: DataFrame, depth: int, keys: tuple[str, ...] = (), told: bool = False, most: int | None = None) -> tuple[DataFrame, DataFrame | None] | None:
    """A search by one join with ``arcs`` (a, b, and kind if ``told``) a level; None if it has not ended after ``most`` levels (LEVELS by default).

    Returns (keys..., id, distance) and, if ``told``, (keys..., id, level, via, mask): for each level the least expanded vertex that leads to an id, and the kinds of
    all such arcs. A vertex is expanded once, so all of them hold every arc once.
    """
    on = [*keys, "id"]
    most = LEVELS if most is None else most
    front = written(seeds.select(*on).distinct().withColumn("distance", F.lit(0)), "level")
    layers, met = [front], []
    for level in range(min(depth, most)):
        near = front.select(*keys, F.col("id").alias("a"))
        step = _hashed(near).join(_hashed(arcs.where("a <> b")), ["h", "a"])
        if told:
            step = step.groupBy(*keys, F.col("b").alias("id")).agg(F.min("a").alias("via"), F.bit_or(_mask(F.col("kind"))).alias("mask")).withColumn("level", F.lit(level))
        else:
            step = step.select(*keys, F.col("b").alias("id")).distinct()
        step = written(step, "step")
        fresh = step.select(*on)
        if vertices is not None and step.count() <= SMALL:
            fresh = vertices.select("id").join(F.broadcast(fresh), "id").select(*on).distinct()  # no more than SMALL rows
        elif vertices is not None:
            fresh = fresh.join(vertices.select("id"), "id", "left_semi")
        fresh = fresh.join(union_all(layers).select(*on), on, "left_anti")
        front = written(fresh.select(*on, F.lit(level + 1).alias("distance")), "level")
        if len(layers) > LEVELS:  # keep the plan short
            layers = [written(union_all(layers), "levels")]
        layers.append(front)
        if told:
            met.append(step)
            discard(near)
        else:
            discard(step)
        if front.isEmpty():
            break
    else:
        if depth > most:
            discard(*layers, *met)
            return None
    none = "id string, level int, via string, mask int"
    return union_all(layers), (union_all(met) if met else seeds.sparkSession.createDataFrame([], none)) if told else None


def _local_distances(arcs: pa.Table, seeds: pa.Table, depth: int, shape: DataFrame, on: list[str]) -> DataFrame:
    """Breadth-first search over numbered ids; one row of positions per frontier."""
    both = pa.chunked_array(arcs.column("a").chunks + arcs.column("b").chunks + seeds.column("id").chunks, pa.string())
    coded = both.combine_chunks().dictionary_encode()
    names, code = coded.dictionary, coded.indices.to_numpy()
    n = arcs.num_rows
    order = np.argsort(code[:n], kind="stable")
    to, first = code[n : 2 * n][order], np.searchsorted(code[:n][order], np.arange(len(names) + 1))
    parts = []
    keys = list(zip(*(seeds.column(k).to_pylist() for k in on[:-1]), strict=True)) or [()] * seeds.num_rows
    groups: dict[tuple, list[int]] = {}
    for key, at in zip(keys, code[2 * n :].tolist(), strict=True):
        groups.setdefault(key, []).append(at)
    for key, starts in groups.items():
        far = np.full(len(names), -1, np.int32)
        frontier, level = np.unique(starts), 0
        far[frontier] = 0
        while len(frontier) and level < depth:
            level += 1
            sizes = first[frontier + 1] - first[frontier]
            spots = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first[frontier], sizes)
            found = np.unique(to[spots])
            frontier = found[far[found] < 0]
            far[frontier] = level
        hit = np.flatnonzero(far >= 0)
        parts.append(pa.table({**{k: pa.array([v] * len(hit), seeds.schema.field(k).type) for k, v in zip(on[:-1], key, strict=True)}, "id": names.take(pa.array(hit)), "distance": pa.array(far[hit])}))
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in shape.select(*on).schema), "distance int"])
    spark = shape.sparkSession
    return spark.createDataFrame(pa.concat_tables(parts), schema) if parts else spark.createDataFrame([], schema)


def reach(bundle: GraphBundle, root: str, incoming: bool, depth: int = UNLIMITED, local: int | None = None) -> DataFrame:
    """(id, kind, distance, edges, via): neighbours of ``root``.

    ``edges``: kinds of all arcs seen from any expanded vertex; ``via``: the least parent one step nearer.
    """
    seeds = bundle.vertices.where(F.col("id") == root).select("id")
    every = oriented(bundle.arcs(registered=False), incoming)
    found = _levels(every, bundle.vertices, seeds, depth, told=True) if _many(every) else None
    if found is not None:
        layers, met = found
        told = met.groupBy("id").agg(F.min_by("via", "level").alias("via"), F.bit_or("mask").alias("mask"))
        return layers.where("distance > 0").join(told, "id").join(bundle.vertices.select("id", "kind"), "id").select("id", "kind", "distance", _named("mask").alias("edges"), "via")
    arcs = oriented(bundle.arcs(), incoming)
    near = distances(arcs, seeds, depth, local=local)
    expanded = near.where(F.col("distance") < min(depth, UNLIMITED)).select(F.col("id").alias("a"), F.col("distance").alias("da"))
    told = (
        arcs.join(expanded, "a")
        .join(near.where("distance > 0").select(F.col("id").alias("b"), "distance"), "b")
        .where("a <> b")
        .groupBy(F.col("b").alias("id"), "distance")
        .agg(joined_kinds(F.collect_set("kind")).alias("edges"), F.min(F.when(F.col("da") == F.col("distance") - 1, F.col("a"))).alias("via"))
    )
    return told.join(bundle.vertices.select("id", "kind"), "id").select("id", "kind", "distance", "edges", "via")


def impact(bundle: GraphBundle, subject: str, local: int | None = None) -> DataFrame:
    """Everything that depends on the subject, however far. ``local`` as in ``distances``."""
    return reach(bundle, subject, True, local=local)


def query(bundle: GraphBundle, subject: str, depth: int = 1, local: int | None = None) -> DataFrame:
    """Both neighbourhoods, with a ``direction`` column; the subject's edges to itself are rows of direction ``self``."""
    sides = [reach(bundle, subject, inward, depth, local).withColumn("direction", F.lit(d)) for d, inward in (("dependents", True), ("dependencies", False))]
    own = bundle.arcs().where((F.col("src") == subject) & (F.col("dst") == subject)).groupBy(F.col("src").alias("id")).agg(joined_kinds(F.collect_set("kind")).alias("edges"))
    own = own.join(bundle.vertices.select("id", "kind"), "id").select("id", "kind", F.lit(0).alias("distance"), "edges", F.lit(None).cast("string").alias("via"), F.lit("self").alias("direction"))
    return sides[0].unionByName(sides[1]).unionByName(own)


def closure(bundle: GraphBundle, seeds: DataFrame, incoming: bool = False) -> DataFrame:
    """(id, distance) of the seeds' transitive dependencies (or dependents), seeds included."""
    known = seeds.join(bundle.vertices.select("id"), "id", "left_semi")
    return distances(oriented(bundle.arcs(registered=False), incoming), known, vertices=bundle.vertices)


def impact_many(bundle: GraphBundle, seeds: DataFrame, key: str, local: int | None = None) -> DataFrame:
    """(key, id, distance) for many subjects in one search; ``seeds`` has (key, id)."""
    known = seeds.join(bundle.vertices.select("id"), "id", "left_semi")
    return distances(oriented(bundle.arcs(registered=False), True), known, keys=(key,), local=local, vertices=bundle.vertices).where("distance > 0")


def reach_roots(bundle: GraphBundle, roots: list[str], incoming: bool, depth: int = UNLIMITED, most_roots: int = 64) -> DataFrame:
    """``walk_roots`` without a budget, on executors: (id, kind, depth, edges, via, roots, roots_truncated).

    All roots are searched at once: a vertex carries a bit a root, levels merge bits by ``bit_or``, and only bits that a vertex has not
    had before travel on. A level is a written table; the driver sees whether it is empty.
    """
    spark = bundle.spark
    distinct = sorted(set(roots), key=str.encode)
    words = [f"w{k}" for k in range(-(-len(distinct) // 64) or 1)]
    bits = lambda k: tuple((1 << k % 64) - (1 << 64) * (k % 64 == 63) if k // 64 == w else 0 for w in range(len(words)))
    begun = spark.createDataFrame([(r, *bits(k)) for k, r in enumerate(distinct)], ", ".join(["id string", *(f"{w} long" for w in words)]))
    arcs = oriented(bundle.arcs(), incoming).where("a <> b")
    steps = written(arcs.groupBy("a", "b").agg(F.bit_or(_mask(F.col("kind"))).alias("mask")), "steps")
    first = begun.join(bundle.vertices.select("id"), "id", "left_semi").select("id", F.lit(0).alias("level"), F.lit(None).cast("string").alias("via"), *words)
    layers = [written(first, "roots")]
    level = 0
    while level < depth:
        level += 1
        seen = union_all(layers).groupBy("id").agg(*(F.bit_or(w).alias(f"s{w}") for w in words))
        told = layers[-1].where(F.col("level") == level - 1).select("id", *words).join(steps.select("a", "b"), F.col("id") == F.col("a")).select(F.col("b").alias("id"), F.col("a").alias("via"), *words).join(seen, "id", "left")
        new = told.select("id", "via", *(F.col(w).bitwiseAND(F.bitwise_not(F.coalesce(f"s{w}", F.lit(0).cast("long")))).alias(w) for w in words)).where(" OR ".join(f"{w} <> 0" for w in words))
        fresh = written(new.groupBy("id").agg(F.lit(level).alias("level"), F.min("via").alias("via"), *(F.bit_or(w).alias(w) for w in words)).select("id", "level", "via", *words), "level")
        if fresh.isEmpty():
            break
        if len(layers) > 8:  # keep the plan short
            layers = [written(union_all(layers), "levels")]
        layers.append(fresh)
    every = union_all(layers)
    found = every.where("level > 0").groupBy("id").agg(F.min("level").alias("depth"), F.min_by("via", "level").alias("via"), *(F.bit_or(w).alias(w) for w in words))
    expanded = every.groupBy(F.col("id").alias("a")).agg(F.min("level").alias("at")).where(F.col("at") < min(depth, UNLIMITED)).select("a")
    edges = steps.join(expanded, "a").groupBy(F.col("b").alias("id")).agg(F.bit_or("mask").alias("mask")).select("id", _named("mask").alias("edges"))
    places = [(k, distinct.index(r)) for k, r in enumerate(roots)]
    own = F.array_compact(F.array(*(F.when(F.shiftrightunsigned(words[d // 64], d % 64).bitwiseAND(F.lit(1)) == 1, F.lit(k)) for k, d in places)))
    return (
        found.join(edges, "id").join(bundle.vertices.select("id", "kind"), "id")
        .select("id", "kind", "depth", "edges", "via", own.alias("all"))
        .select("id", "kind", "depth", "edges", "via", F.slice("all", 1, most_roots).alias("roots"), (F.size("all") > most_roots).alias("roots_truncated"))
    )


def searched(bundle: GraphBundle, a: str, incoming: bool = False, depth: int = 32) -> tuple[DataFrame, DataFrame]:
    """What ``a`` reaches, (id, distance), and the arcs between it that lead one step further, (a, b, kinds, da): what all paths from ``a`` share, whatever they lead to."""
    arcs = oriented(bundle.arcs(registered=False), incoming).where("a <> b")
    near = distances(arcs, bundle.vertices.where(F.col("id") == a).select("id").distinct(), depth, local=0, vertices=bundle.vertices)
    onward = arcs.join(near.select(F.col("id").alias("a"), F.col("distance").alias("da")), "a").join(near.select(F.col("id").alias("b"), F.col("distance").alias("db")), "b").where(F.col("db") == F.col("da") + 1)
    return near, written(onward.groupBy("a", "b", "da").agg(joined_kinds(F.collect_set("kind")).alias("kinds")), "onward")


def all_paths(bundle: GraphBundle, a: str, b: str, incoming: bool = False, max_paths: int = 32, depth: int = 32, found: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``paths`` without a budget, on executors: (path_no, path, kinds, paths_found, truncated).

    Distances from ``a``, then the arcs that lead one step further (``found``, if ``searched`` has brought them already), then from ``b`` back over these: what both
    reach is the graph of all shortest paths. Their number is added up along it, level by level, and the first ``max_paths`` of them, read backwards, are listed
    from ``b`` on: each beginning can be completed, so no level keeps more than that.
    """
    spark = bundle.spark
    schema = "path_no int, path array<string>, kinds array<string>, paths_found decimal(38,0), truncated boolean"
    near, onward = found or searched(bundle, a, incoming, depth)
    far = near.where(F.col("id") == b).first()
    if far is None:
        return spark.createDataFrame([], schema)
    if a == b:
        return spark.createDataFrame([(0, [a], [], 1, False)], schema.replace("decimal(38,0)", "int")).withColumn("paths_found", F.col("paths_found").cast("decimal(38,0)"))
    last = far["distance"]
    onward = onward.where(F.col("da") < last)
    seed, turned = spark.createDataFrame([(b,)], "id string"), onward.select(F.col("b").alias("a"), F.col("a").alias("b"))
    back = _levels(turned, None, seed, last)[0] if last <= LEVELS else blocks.distances(turned, seed, last)
    dag = written(onward.join(back.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b", "kinds", "da"), "path-arcs")
    ways = spark.createDataFrame([(a,)], "id string").select("id", F.lit(1).cast("decimal(38,0)").alias("ways"))
    listed = spark.createDataFrame([([b], [])], "back array<string>, kinds array<string>")
    for k in range(last):
        ways = ways.join(dag.where(F.col("da") == k), F.col("id") == F.col("a")).groupBy(F.col("b").alias("id")).agg(F.sum("ways").cast("decimal(38,0)").alias("ways"))
        step = dag.where(F.col("da") == last - 1 - k).select("a", "b", F.col("kinds").alias("kind"))
        listed = listed.join(step, F.element_at("back", -1) == F.col("b")).select(F.concat("back", F.array("a")).alias("back"), F.concat(F.array("kind"), "kinds").alias("kinds")).orderBy("back").limit(max_paths)
        if k % 4 == 3:  # keep the plans short
            ways, listed = written(ways, "ways"), written(listed, "listed")
    kept = written(listed.select(F.reverse("back").alias("path"), "kinds"), "paths")  # at most max_paths rows, so one task may number them
    total = ways.select(F.col("ways").alias("paths_found"))
    return kept.select((F.row_number().over(Window.orderBy("path")) - 1).alias("path_no"), "path", "kinds").join(F.broadcast(total), F.col("paths_found") > 0).withColumn("truncated", F.col("paths_found") > max_paths)


# -- budgeted --------------------------------------------------------------------------------------------------------


def fetcher(bundle: GraphBundle, incoming: bool) -> Callable[[list[str], int], dict[str, list[tuple]]]:
    """A function that brings the arcs of a frontier, in its order, up to a number: expanded id -> [(src, dst, kind, registered)]."""
    spark = bundle.spark
    near, far = ("dst", "src") if incoming else ("src", "dst")
    arcs = bundle.arcs(registered=False).withColumn("ord", kind_order(F.col("kind")))
    known = bundle.vertices.select(F.col("id").alias("far")).withColumn("registered", F.lit(True))

    def fetch(frontier: list[str], limit: int) -> dict[str, list[tuple]]:
        rows = spark.createDataFrame([(x, k) for k, x in enumerate(frontier)], f"{near} string, place long")
        found = (
            arcs.join(F.broadcast(rows), near)  # no more rows than the budget of vertices
            .orderBy("place", "src", "dst", "ord")
            .limit(limit)
            .withColumn("far", F.col(far))
            .join(known, "far", "left")
            .select("place", "src", "dst", "kind", "ord", F.coalesce("registered", F.lit(False)).alias("registered"))
            .collect()
        )
        out: dict[str, list[tuple]] = {}
        for r in sorted(found, key=lambda r: (r["place"], r["src"].encode(), r["dst"].encode(), r["ord"])):
            out.setdefault(frontier[r["place"]], []).append((r["src"], r["dst"], r["kind"], r["registered"]))
        return out

    return fetch


class _Expansion:
    """Breadth-first expansion of seeds under a budget; calls ``see(parent, next, kind, distance)`` for each counted arc to a vertex."""

    def __init__(self, fetch: Callable, budget: Budget, depth: int, incoming: bool, cancel: Callable[[], bool] | None) -> None:
        self.fetch, self.budget, self.depth, self.incoming, self.cancel = fetch, budget, depth, incoming, cancel
        self.distance: dict[str, int] = {}
        self.reasons: set[str] = set()
        self.examined = 0

    def run(self, seeds: Iterable[str], see: Callable[[str, str, str, int], None], stop: Callable[[int], bool] = lambda level: False) -> None:
        level = list(seeds)
        self.distance = dict.fromkeys(level, 0)
        now = 0
        while level and now < self.depth and not stop(now):
            if self.cancel and self.cancel():
                self.reasons.add("cancelled")
                return
            left = self.budget.max_edges - self.examined
            if left <= 0:
                self.reasons.add("edge-limit")
                return
            arcs = self.fetch(level, left + 1)
            after: list[str] = []
            for at in level:
                if self.examined >= self.budget.max_edges:
                    self.reasons.add("edge-limit")
                    return
                for src, dst, kind, registered in arcs.get(at, ()):
                    if self.examined >= self.budget.max_edges:
                        self.reasons.add("edge-limit")
                        return
                    self.examined += 1
                    to = src if self.incoming else dst
                    if not registered:
                        continue
                    if to not in self.distance:
                        if len(self.distance) >= self.budget.max_visited:
                            self.reasons.add("visited-limit")
                            return
                        self.distance[to] = now + 1
                        after.append(to)
                    see(at, to, kind, now)
            level, now = after, now + 1


def _kinds_of(bundle: GraphBundle, ids: list[str]) -> dict[str, str]:
    if not ids:
        return {}
    rows = bundle.spark.createDataFrame([(i,) for i in ids], "id string")
    return {r["id"]: r["kind"] for r in bundle.vertices.join(F.broadcast(rows), "id").select("id", "kind").collect()}


def walk(bundle: GraphBundle, root: str, incoming: bool, depth: int = UNLIMITED, max_results: int = 1024, budget: Budget = Budget(), cancel: Callable[[], bool] | None = None, local: bool = True) -> Report:
    """Budgeted neighbourhood. Rows: (id, kind, distance, edges, via), by id, cut to ``max_results``.

    Reasons: cancelled, root-not-found, visited-limit, edge-limit, result-limit. ``examined`` counts every dependency arc of an
    expanded vertex, those to the root and to unknown ids too; ``visited`` counts the root. A small graph is searched in arrays that the
    bundle keeps, unless a budget is met; the result is the same.
    """
    here = local_graph(bundle) if local else None
    if here is not None:
        if root not in here.number or here.number[root] not in here.kind:
            return Report([], reasons={"root-not-found"}, found=False)
        if budget.max_visited and not (cancel and cancel()):
            done = here.walk(root, incoming, depth, budget.max_visited, budget.max_edges)
            if done is not None:
                return Report(done[0][:max_results], done[1], done[2], {"result-limit"} if len(done[0]) > max_results else set())
    elif not _kinds_of(bundle, [root]):
        return Report([], reasons={"root-not-found"}, found=False)
    if budget.max_visited == 0:
        return Report([], reasons={"visited-limit"})
    told: dict[str, tuple[set, list]] = {}
    search = _Expansion(fetcher(bundle, incoming), budget, depth, incoming, cancel)

    def see(parent: str, to: str, kind: str, distance: int) -> None:
        if to != root:
            kinds, parents = told.setdefault(to, (set(), []))
            kinds.add(kind)
            if distance + 1 == search.distance[to]:
                parents.append(parent)

    search.run([root], see)
    kinds = _kinds_of(bundle, list(told))
    rows = [(i, kinds[i], search.distance[i], "|".join(sorted(k, key=ORDER.get)), min(p, key=str.encode)) for i, (k, p) in told.items()]
    rows.sort(key=lambda r: r[0].encode())
    if len(rows) > max_results:
        search.reasons.add("result-limit")
    return Report(rows[:max_results], len(search.distance), search.examined, search.reasons)


def walk_roots(bundle: GraphBundle, roots: list[str], incoming: bool, depth: int = UNLIMITED, max_results: int = 1024, budget: Budget = Budget(), cancel: Callable[[], bool] | None = None, most_roots: int = 64) -> Report:
    """What is reached from one of several roots, other than itself. Rows: (id, kind, depth, edges, via, roots, roots_truncated).

    ``roots`` are places in the given list, ``most_roots`` of them at most; depth and via come from the nearest other root. By depth, id.
    """
    known = _kinds_of(bundle, roots)
    reasons: set[str] = set()
    if any(r not in known for r in roots):
        reasons.add("root-not-found")
    seeds = sorted({r for r in roots if r in known}, key=str.encode)
    if not seeds:
        return Report([], reasons=reasons, found=False)
    if budget.max_visited < len(seeds):
        seeds = seeds[: budget.max_visited]
        reasons.add("visited-limit")
    arcs: dict[str, dict[str, None]] = {}
    kinds: dict[str, set] = {}
    search = _Expansion(fetcher(bundle, incoming), budget, depth, incoming, cancel)

    def see(parent: str, to: str, kind: str, distance: int) -> None:
        if parent == to:
            return
        kinds.setdefault(to, set()).add(kind)
        arcs.setdefault(parent, {})[to] = None

    search.run(seeds, see)
    # per vertex, the two nearest (distance, root) with different roots would do; every root's own search over the kept arcs gives all
    places = {s: [k for k, r in enumerate(roots) if r == s] for s in seeds}
    best: dict[str, tuple[int, str]] = {}
    members: dict[str, set[int]] = {}
    for s in seeds:
        far, queue = {s: 0}, deque([s])
        while queue:
            at = queue.popleft()
            if far[at] >= depth:
                continue
            for to in arcs.get(at, ()):
                if to not in far:
                    far[to] = far[at] + 1
                    queue.append(to)
                if to != s and far[to] == far[at] + 1:
                    now = best.get(to)
                    if now is None or (far[to], at.encode()) < (now[0], now[1].encode()):
                        best[to] = (far[to], at)
        for to in far:
            if to != s:
                members.setdefault(to, set()).update(places[s])
    names = _kinds_of(bundle, list(best))
    rows = []
    for i, (d, via) in best.items():
        own = sorted(members[i])
        rows.append((i, names[i], d, "|".join(sorted(kinds[i], key=ORDER.get)), via, own[:most_roots], len(own) > most_roots))
    rows.sort(key=lambda r: (r[2], r[0].encode()))
    reasons |= search.reasons
    if len(rows) > max_results:
        reasons.add("result-limit")
    return Report(rows[:max_results], len(search.distance), search.examined, reasons)


def paths(bundle: GraphBundle, a: str, b: str, incoming: bool = False, max_paths: int = 32, depth: int = 32, budget: Budget = Budget(), cancel: Callable[[], bool] | None = None) -> Report:
    """All shortest paths from a to b. Rows: (path_no, path: [id], kinds: [kinds of each step]).

    Of more than ``max_paths`` paths those stay that come first when read backwards; the kept ones are in forward order.
    """
    known = _kinds_of(bundle, [a, b])
    if a not in known or b not in known:
        return Report([], reasons={"root-not-found"}, found=False)
    if a == b:
        return Report([(0, [a], [])], visited=1)
    parents: dict[str, dict[str, set]] = {}
    search = _Expansion(fetcher(bundle, incoming), budget, depth, incoming, cancel)

    def see(parent: str, to: str, kind: str, distance: int) -> None:
        if search.distance[to] == distance + 1:
            parents.setdefault(to, {}).setdefault(parent, set()).add(kind)

    search.run([a], see, stop=lambda level: search.distance.get(b, UNLIMITED) <= level)
    if b not in search.distance:
        if not search.reasons and any(d >= depth for d in search.distance.values()):
            search.reasons.add("depth-limit")
        return Report([], len(search.distance), search.examined, search.reasons)
    kept: list[list[str]] = []
    stack = [[b]]
    while stack:  # least predecessor first
        path = stack.pop()
        if path[-1] == a:
            if len(kept) == max_paths:
                search.reasons.add("path-limit")
                break
            kept.append(path[::-1])
            continue
        stack += [[*path, p] for p in sorted(parents[path[-1]], key=str.encode, reverse=True)]
    kept.sort(key=lambda p: [x.encode() for x in p])
    rows = [(k, p, ["|".join(sorted(parents[y][x], key=ORDER.get)) for x, y in zip(p, p[1:], strict=False)]) for k, p in enumerate(kept)]
    return Report(rows, len(search.distance), search.examined, search.reasons)


def explain(bundle: GraphBundle, subject: str, max_edges: int = 1024) -> DataFrame:
    """Edges of any kind at the subject with their evidence and origins; ``total_edges`` is the number before the cut."""
    at = bundle.edges.where((F.col("src") == subject) | (F.col("dst") == subject)).select("src", "dst", "kind").distinct()
    key = ["src", "dst", "kind"]
    total = at.agg(F.count(F.lit(1)).alias("total_edges"))
    proof = bundle.evidence.join(at, key, "left_semi").groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "layer", "detail"))), "; ").alias("evidence"))
    roles = bundle.origins.join(at, key, "left_semi").groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set("role")), "; ").alias("roles"))
    kept = at.orderBy("src", "dst", kind_order(F.col("kind"))).limit(max_edges)
    return kept.join(proof, key, "left").join(roles, key, "left").join(F.broadcast(total), F.col("total_edges") >= 0).select(*key, "evidence", "roles", "total_edges")
