"""Searches on executors that need no job a level: arcs between numbered vertices, contracted, then followed block by block.

Vertices are numbered in the order of their ids; a block is WIDTH consecutive numbers. A superstep gives each block the messages for its
vertices and follows its inner arcs until nothing changes there; only what changed then travels along the arcs that leave a block, by a join. So
the number of jobs goes with how often a path changes its block, not with its length. Blocks with more than DENSE inner arcs are not followed
inside; all their arcs take the join. No task gets more than one block's arcs and values, and nothing but counts and one number a partition
comes to the driver.

Where there are several blocks, chains are contracted first: a vertex with a single predecessor is as far as that one and a step more, and gone
where that one is gone. Pointers to the predecessor are doubled by joins until they point at a vertex that has none or several: as many
rounds as the longest chain's length has binary digits. What keeps pointing at chains is a cycle that nothing enters. Searches then run over the
vertices that are left, with arcs as long as the chains they stand for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import ship, written

WIDTH, DENSE = 1 << 15, 1 << 18
#: Rows of a partition when ids are numbered.
_ROWS = 1_000_000
FAR = 1 << 40


def numbered(ids: DataFrame) -> tuple[DataFrame, int]:
    """(id, n): the place of each id in their binary order, and how many there are. ``ids`` are distinct and not null."""
    spark = ids.sparkSession
    kept = written(ids.select("id"), "ids")
    parts = max(1, -(-kept.count() // _ROWS))
    ordered = written(kept.repartitionByRange(parts, "id").sortWithinPartitions("id").withColumn("m", F.monotonically_increasing_id()), "ordered-ids")
    part = F.shiftright("m", 33)
    sizes = sorted((r["part"], r["n"]) for r in ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row a partition
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    if len(starts) < 2:
        return ordered.select("id", F.col("m").bitwiseAND(F.lit((1 << 33) - 1)).alias("n")), total
    begin = F.broadcast(spark.createDataFrame(starts, "part long, start long"))  # a row a partition
    return ordered.join(begin, part == F.col("part")).select("id", (F.col("start") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).alias("n")), total


def _block(n: Column | str, width: int) -> Column:
    return F.floor((F.col(n) if isinstance(n, str) else n) / width)


class Blocks:
    """Arcs (a, b, w, m): from number a to number b, w steps long, standing for m arcs. At most one row a pair."""

    def __init__(self, arcs: DataFrame, width: int, dense: int = DENSE) -> None:
        ship(arcs.sparkSession)
        self.width = width
        same = _block("a", width) == _block("b", width)
        few = arcs.where(same).groupBy(_block("a", width).alias("few")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= dense).select("few")
        sorted_out = written(arcs.join(few, same & (_block("a", width) == F.col("few")), "left").select("a", "b", "w", "m", F.col("few").isNotNull().alias("inner")), "sorted-arcs")
        self.across = sorted_out.where("NOT inner").select("a", "b", "w", "m")
        inside = sorted_out.where("inner").groupBy(_block("a", width).alias("block"))
        self.inside = written(inside.agg(F.collect_list(F.struct("a", "b", "w", "m")).alias("arcs")), "inner-arcs")  # at most ``dense`` arcs
        self.one = self.across.isEmpty()

    def run(self, start: DataFrame, keys: tuple[str, ...], message: Column, merge: Callable[[str], Column], local: Callable[[list, list], list]) -> DataFrame:
        """``start`` (keys..., n, v, t): values, and whether they are news (t = 1) or were known (0). News travel along the arcs: the value
        ``message`` of (v, w, m), merged. ``local`` takes the values of a block, [(n, v, t)], with messages as t = 2, and its
        arcs, and returns the values after it. Returns (keys..., n, v), what is known in the end."""
        on = [*keys, "n"]
        width = self.width
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in start.select(*on, "v", "t").schema)

        def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    values, arcs = batch.column("values")[k].values, batch.column("arcs")[k].values
                    rows = list(zip(*(values.field(c).to_pylist() for c in ("n", "v", "t")), strict=True))
                    steps = list(zip(*(arcs.field(c).to_pylist() for c in ("a", "b", "w", "m")), strict=True)) if arcs is not None else []
                    out = local(rows, steps)
                    columns = [pa.array(x, pa.int64()) for x in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 3
                    own = [pa.array([batch.column(c)[k].as_py()] * len(out), batch.column(c).type) for c in keys]
                    yield pa.RecordBatch.from_arrays([*own, *columns], names=[*on, "v", "t"])

        now = start.select(*on, "v", "t")
        while True:
            packed = now.groupBy(*keys, _block("n", width).alias("block")).agg(F.collect_list(F.struct("n", "v", "t")).alias("values"))
            known = written(packed.join(self.inside, "block", "left").select(*keys, "values", "arcs").mapInArrow(follow, schema), "values")
            news = known.where("t = 1")
            if self.one or news.isEmpty():
                return known.select(*on, "v")
            sent = news.join(self.across, news["n"] == self.across["a"]).select(*keys, F.col("b").alias("n"), message.alias("v")).groupBy(*on).agg(merge("v").alias("v"))
            now = known.select(*on, "v", F.lit(0).cast("long").alias("t")).unionByName(sent.select(*on, "v", F.lit(2).cast("long").alias("t")))


def _nearer(limit: int) -> Callable[[list, list], list]:
    """The least value of each vertex, from news and messages along a block's arcs."""

    def local(rows: list, arcs: list) -> list:
        value: dict[int, int] = {}
        heap = []
        before: dict[int, int] = {}
        for n, v, t in rows:
            if t == 0:
                before[n] = v
            if v < value.get(n, FAR):
                value[n] = v
        heap = [(v, n) for n, v in value.items() if v < before.get(n, FAR)]
        if heap and arcs:
            out: dict[int, list] = {}
            for a, b, w, _ in arcs:
                out.setdefault(a, []).append((b, w))
            heapify(heap)
            while heap:
                v, n = heappop(heap)
                if v > value[n]:
                    continue
                for b, w in out.get(n, ()):
                    if v + w <= limit and v + w < value.get(b, FAR):
                        value[b] = v + w
                        heappush(heap, (v + w, b))
        return [(n, v, int(v < before.get(n, FAR))) for n, v in value.items() if v <= limit]

    return local


def least(blocks: Blocks, start: DataFrame, keys: tuple[str, ...] = (), limit: int = FAR) -> DataFrame:
    """(keys..., n, v): the least of start value plus steps over all ways that lead to n, up to ``limit``. ``start``: (keys..., n, v)."""
    begin = start.select(*keys, "n", F.col("v").cast("long").alias("v"), F.lit(2).cast("long").alias("t"))
    return blocks.run(begin, keys, F.least(F.col("v") + F.col("w"), F.lit(FAR)), F.min, _nearer(limit))


def _peeled(rows: list, arcs: list) -> list:
    """Counters of a block after its messages (numbers to take off): what falls to zero takes one off all that follow it. Values below 0 are gone."""
    left = {n: v for n, v, t in rows if t < 2}
    taken: dict[int, int] = {}
    for n, v, t in rows:
        if t == 2:
            taken[n] = taken.get(n, 0) + v
    for n, v in taken.items():
        if left.get(n, -1) > 0:
            left[n] -= v
    queue = [n for n, v in left.items() if v == 0]
    fresh = set(queue)
    if queue:
        out: dict[int, list] = {}
        for a, b, _, m in arcs:
            out.setdefault(a, []).append((b, m))
        while queue:
            n = queue.pop()
            left[n] = -1
            for b, m in out.get(n, ()):
                if left.get(b, -1) > 0:
                    left[b] -= m
                    if left[b] == 0:
                        queue.append(b)
                        fresh.add(b)
    return [(n, v, int(n in fresh)) for n, v in left.items()]


def peel(blocks: Blocks, counters: DataFrame) -> DataFrame:
    """(n) of what goes: all with counter 0, then all whose counter falls to 0 as its predecessors go. ``counters`` (n, v) has what may go, v
    being the number of arcs into n."""
    done = blocks.run(counters.select("n", F.col("v").cast("long").alias("v"), F.lit(1).cast("long").alias("t")), (), F.col("m"), F.sum, _peeled)
    return done.where("v < 0").select("n")


def contracted(arcs: DataFrame, stays: DataFrame | None, deepest: int = FAR) -> tuple[DataFrame, DataFrame]:
    """Chains: (n, up, off) for each vertex with one predecessor, up being the nearest one before it that has several, none, or is in ``stays``
    (n); and the arcs (a, b, w, m) between the others. Vertices of cycles that nothing enters are in neither, nor what is beyond ``deepest`` steps."""
    single = arcs.groupBy(F.col("b").alias("n")).agg(F.count(F.lit(1)).alias("k"), F.min("a").alias("up"), F.min("w").alias("off")).where("k = 1 AND up <> n")
    if stays is not None:
        single = single.join(stays.select("n").distinct(), "n", "left_anti")
    single = written(single.select("n", "up", "off"), "singles")
    ups = single.select(F.col("n").alias("up"), F.lit(True).alias("open"))
    now = written(single.join(ups, "up", "left").select("n", "up", "off", F.coalesce("open", F.lit(False)).alias("open")), "pointers")
    n, length = single.count(), 1
    while length < n:
        further = now.where("open").join(now.select(F.col("n").alias("up"), F.col("up").alias("up2"), F.col("off").alias("off2"), F.col("open").alias("open2")), "up")
        moved = further.select("n", F.col("up2").alias("up"), (F.col("off") + F.col("off2")).alias("off"), F.col("open2").alias("open")).where(F.col("off") <= deepest)
        if now.where("open").isEmpty():
            break
        now, length = written(now.where("NOT open").unionByName(moved), "pointers"), 2 * length
    chains = now.where("NOT open").select("n", "up", "off")
    left = arcs.join(single.select(F.col("n").alias("b")), "b", "left_anti")
    loose = single.select(F.col("n").alias("a")).join(chains.select(F.col("n").alias("a")), "a", "left_anti")  # on cycles, or too deep
    moved = left.join(loose, "a", "left_anti").join(chains.select(F.col("n").alias("a"), "up", "off"), "a", "left")
    core = moved.select(F.coalesce("up", "a").alias("a"), "b", (F.col("w") + F.coalesce("off", F.lit(0))).alias("w"), "m").groupBy("a", "b").agg(F.min("w").alias("w"), F.sum("m").alias("m"))
    return chains, written(core, "core-arcs")


def with_numbers(arcs: DataFrame, numbers: DataFrame) -> DataFrame:
    """(a, b) of string ids as numbers, one row a pair, with w and m of 1; written."""
    ends = arcs.join(numbers.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(numbers.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    return written(ends.select(F.col("na").alias("a"), F.col("nb").alias("b")).distinct().select("a", "b", F.lit(1).cast("long").alias("w"), F.lit(1).cast("long").alias("m")), "numbered-arcs")


def distances(arcs: DataFrame, seeds: DataFrame, depth: int, keys: tuple[str, ...] = (), width: int = WIDTH, dense: int = DENSE) -> DataFrame:
    """(keys..., id, distance) of all that ``seeds`` (keys..., id) reach over ``arcs`` (a, b) in at most ``depth`` steps."""
    steps = arcs.select("a", "b").where("a <> b")
    seeds = seeds.select(*keys, "id").distinct()
    numbers, n = numbered(steps.select(F.col("a").alias("id")).union(steps.select("b")).union(seeds.select("id")).where("id IS NOT NULL").distinct())
    pairs = with_numbers(steps, numbers)
    begin = written(seeds.join(numbers, "id").select(*keys, "n", F.lit(0).cast("long").alias("v")), "seeds")
    if n <= width:
        found = least(Blocks(pairs, width, dense), begin, keys, depth)
    else:
        chains, core = contracted(pairs, begin, depth)
        near = least(Blocks(core, width, dense), begin, keys, depth)
        along = chains.join(near.withColumnRenamed("n", "up"), "up").select(*keys, "n", (F.col("v") + F.col("off")).alias("v")).where(F.col("v") <= depth)
        found = near.unionByName(along)
    return written(found.join(numbers, "n").select(*keys, "id", F.col("v").cast("int").alias("distance")), "distances")


def peeled(arcs: DataFrame, able: DataFrame, width: int = WIDTH, dense: int = DENSE) -> DataFrame:
    """(id) of what goes when all of ``able`` (id) without an arc in goes, then all whose arcs in (from others) have gone. ``arcs``: (a, b)."""
    steps = arcs.select("a", "b").where("a <> b").join(able.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")
    numbers, n = numbered(steps.select(F.col("a").alias("id")).union(able.select("id")).where("id IS NOT NULL").distinct())
    pairs = with_numbers(steps, numbers)
    may = written(able.select("id").distinct().join(numbers, "id").select("n"), "able")
    counts = pairs.groupBy(F.col("b").alias("n")).agg(F.count(F.lit(1)).alias("v"))
    counters = written(may.join(counts, "n", "left").select("n", F.coalesce("v", F.lit(0)).alias("v")), "counters")
    if n <= width:
        return peel(Blocks(pairs, width, dense), counters).join(numbers, "n").select("id")
    chains, core = contracted(pairs, None)
    # chains hang on their first vertex: they are no counters of their own
    held = counters.join(pairs.groupBy(F.col("b").alias("n")).agg(F.count(F.lit(1)).alias("k")).where("k = 1").select("n"), "n", "left_anti")
    gone = peel(Blocks(core, width, dense), held)
    gone = gone.union(chains.join(gone.withColumnRenamed("n", "up"), "up").select("n"))
    return written(gone.join(numbers, "n").select("id"), "gone")


def coloured(arcs: DataFrame, width: int = WIDTH, dense: int = DENSE) -> DataFrame:
    """(id, component): the least id of each strongly connected component of several vertices; ``arcs``: (src, dst), distinct.

    Trim what has no arc in, or none out, by counters; colour the rest by the least number that reaches it; what reaches that number within its colour
    is a component. Again with what is left: each round settles the component of every colour's own number.
    """
    spark = arcs.sparkSession
    steps = arcs.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a <> b")
    numbers, _ = numbered(steps.select(F.col("a").alias("id")).union(steps.select("b")).where("id IS NOT NULL").distinct())
    left = with_numbers(steps, numbers)
    done: DataFrame | None = None
    while not left.isEmpty():
        before = left.count()
        for turned in (False, True):
            side = left if not turned else left.select(F.col("b").alias("a"), F.col("a").alias("b"), "w", "m")
            ends = side.select(F.col("a").alias("n")).union(side.select("b")).distinct()
            counts = ends.join(side.groupBy(F.col("b").alias("n")).agg(F.count(F.lit(1)).alias("v")), "n", "left").select("n", F.coalesce("v", F.lit(0)).alias("v"))
            counts = written(counts, "counters")
            if not counts.where("v = 0").isEmpty():
                gone = peel(Blocks(side, width, dense), counts)
                left = written(left.join(gone.withColumnRenamed("n", "a"), "a", "left_anti").join(gone.withColumnRenamed("n", "b"), "b", "left_anti").select("a", "b", "w", "m"), "left")
        if left.count() < before:
            continue  # one side's trimming may open the other
        colour = least(Blocks(left.withColumn("w", F.lit(0).cast("long")), width, dense), left.select(F.col("a").alias("n"), F.col("a").alias("v")).distinct())
        inside = left.join(colour.select(F.col("n").alias("a"), F.col("v").alias("c")), "a").join(colour.select(F.col("n").alias("b"), F.col("v").alias("d")), "b").where("c = d")
        inside = written(inside.select(F.col("b").alias("a"), F.col("a").alias("b"), "w", "m"), "inside")
        back = least(Blocks(inside, width, dense), colour.where("n = v").select("n", F.lit(0).alias("v"))).select("n")
        found = written(colour.join(back, "n").select("n", F.col("v").alias("c")), "components")
        done = found if done is None else done.union(found)
        gone = found.select("n")
        left = written(left.join(gone.withColumnRenamed("n", "a"), "a", "left_anti").join(gone.withColumnRenamed("n", "b"), "b", "left_anti").select("a", "b", "w", "m"), "left")
    if done is None:
        return spark.createDataFrame([], "id string, component string")
    return done.join(numbers, "n").join(numbers.select(F.col("id").alias("component"), F.col("n").alias("c")), "c").select("id", "component")
