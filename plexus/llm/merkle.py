"""A Merkle manifest of a table: a leaf a row, a tree a group, and a tree over the groups' roots; every row gets its proof.

Leaves ascend by id within their group. A node is the hash of up to ``FANOUT`` consecutive nodes below it; the last one of a level may have
fewer, even one. What remains is the group's subroot, and the subroots, in the order of groups, make the root in the same way.

The leaves are range-sorted by (group, id) into partitions of some ``ROWS_A_TASK`` rows, as one RDD. Its partitions say how many rows their first
and last group have there; from these few numbers a partition the driver knows at which place of its group each partition begins. With its place
a partition builds all nodes of aligned subtrees that lie wholly in it. The ragged nodes at its boundaries, at most FANOUT - 1 on either
side of a level, are shuffled by their coordinate (tree, level, place) and finished level by level, in written tables; so are the subroots. A
partition then gets the families (the children of one node, together) on its boundaries' ways to the root, and puts the proofs together.

Defined results: a null field is ``-``; null groups come first, null ids first within their group; equal ids go by their leaves, equal rows each
have a place and a proof of their own; a group of one row has its leaf as subroot, one group's subroot is the root; no siblings give the hash of the
empty string; an empty table gives an empty result; extra columns are left behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship

FANOUT = 8
ROWS_A_TASK = 50_000
#: The tree over the subroots; groups are numbered from 0.
TOP = -1
_DIGEST = 64


def H(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` if null, else the number of bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def parents(size: int) -> int:
    return -(-size // FANOUT)


class Piece:
    """The rows that a partition has of a group: leaves from place ``start`` on, of ``size`` in the group. ``levels[l]`` are the nodes that it
    can make alone: (first place, digests)."""

    def __init__(self, tree: int, start: int, size: int, leaves: list[str]) -> None:
        self.tree, self.levels, self.sizes = tree, [(start, leaves)], [size]
        while self.sizes[-1] > 1:
            (a, own), size = self.levels[-1], self.sizes[-1]
            b = a + len(own)
            low, high = -(-a // FANOUT), parents(b) if b == size else b // FANOUT
            made = [H("".join(own[j * FANOUT - a : (j + 1) * FANOUT - a])) for j in range(low, high)]
            self.levels.append((low, made))
            self.sizes.append(parents(size))

    def has(self, level: int, place: int) -> bool:
        first, own = self.levels[level]
        return first <= place < first + len(own)

    def children(self, level: int, place: int) -> str:
        """The nodes below a node that is made here."""
        a, own = self.levels[level - 1]
        return "".join(own[max(0, place * FANOUT - a) : (place + 1) * FANOUT - a])

    def ragged(self) -> Iterator[tuple[int, int, str]]:
        """(level, place, digest) of the nodes whose parent is not made here; of a whole tree, its root."""
        for level, (a, own) in enumerate(self.levels):
            last = level + 1 == len(self.levels)
            for k, digest in enumerate(own):
                if last or not self.has(level + 1, (a + k) // FANOUT):
                    yield level, a + k, digest

    def foreign(self) -> Iterator[tuple[int, int]]:
        """(level, place) of the families that the rows' ways pass and that are not made here."""
        places: set[int] = set()
        for level, (a, own) in enumerate(self.levels[:-1]):
            places = {p // FANOUT for p in places} | {(a + k) // FANOUT for k in range(len(own)) if not self.has(level + 1, (a + k) // FANOUT)}
            yield from ((level + 1, p) for p in sorted(places))


def _tag(group: str | None) -> bytes:
    return b"" if group is None else hashlib.sha256(group.encode("utf-8", "surrogatepass")).digest()


def _extent(k: int, rows: Iterator) -> Iterator[tuple]:
    """(partition, first group's tag and rows, last group's tag and rows, number of groups)."""
    counts = [(tag, sum(1 for _ in own)) for tag, own in groupby(rows, key=lambda r: _tag(r[0]))]
    if counts:
        yield k, *counts[0], *counts[-1], len(counts)


def _places(extents: list[tuple]) -> tuple[dict[int, tuple], int, int]:
    """(partition: number of its first group, place of its first row there, sizes of its first and last group), the number of groups, and
    the size of the largest group that spans partitions."""
    begun, sizes, number, last, so_far = [], {}, -1, None, 0
    for k, first, n, final, m, groups in extents:
        if first != last:
            number, so_far = number + 1, 0
        begun.append((k, number, so_far, number + groups - 1))
        sizes[number] = so_far + n
        if groups > 1:
            number, so_far = number + groups - 1, m
            sizes[number] = m
        else:
            so_far += n
        last = final
    return {k: (first, place, sizes[first], sizes[end]) for k, first, place, end in begun}, number + 1, max(sizes.values(), default=0)


def _pieces(rows: list, place: tuple) -> Iterator[tuple[Piece, list]]:
    """The partition's groups with their rows (group, id, leaf, changed leaf)."""
    number, start, first_size, last_size = place
    groups = [list(own) for _, own in groupby(rows, key=lambda r: _tag(r[0]))]
    for k, own in enumerate(groups):
        size = first_size if k == 0 else last_size if k == len(groups) - 1 else len(own)
        yield Piece(number + k, start if k == 0 else 0, size, [r[2] for r in own]), own


def _built(places: dict[int, tuple], groups: int):
    """Per partition: its ragged nodes (partition, tree, level, place, size of the level, digest) and, without a digest, the families it needs."""

    def run(k: int, rows: Iterator) -> Iterator[tuple]:
        if k not in places:
            return
        tops: set[int] = set()
        for piece, _ in _pieces(list(rows), places[k]):
            for level, place, digest in piece.ragged():
                if piece.sizes[level] == 1:
                    yield k, TOP, 0, piece.tree, groups, digest
                else:
                    yield k, piece.tree, level, place, piece.sizes[level], digest
            for level, place in piece.foreign():
                yield k, piece.tree, level, place, 0, None
            tops.add(piece.tree)
        level, size = 0, groups
        while size > 1:
            level, size, tops = level + 1, parents(size), {p // FANOUT for p in tops}
            for p in tops:
                yield k, TOP, level, p, 0, None

    return run


_NODES = "part int, tree long, level int, place long, size long, digest string"


def _families(nodes: DataFrame) -> DataFrame:
    """(tree, level, place, size, children) of the nodes' parents; each has at most FANOUT of them."""
    inside = F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"])
    parent = F.floor(F.col("place") / FANOUT).alias("up")
    found = nodes.groupBy("tree", "level", parent, "size").agg(F.concat_ws("", inside).alias("children"))
    return found.select("tree", (F.col("level") + 1).cast("int").alias("level"), F.col("up").alias("place"), F.ceil(F.col("size") / FANOUT).alias("size"), "children")


def _finish(nodes: DataFrame, largest: int, groups: int) -> tuple[DataFrame | None, str]:
    """The families above the ragged nodes, level by level, first of the groups' trees, then of the tree over them; and the root."""
    columns = ("tree", "level", "place", "size", "digest")
    above: list[DataFrame] = []
    tops = nodes.where(F.col("tree") == TOP).select(*columns)
    for trees, size in ((F.col("tree") != TOP, largest), (None, groups)):
        own = tops if trees is None else nodes.where(trees).select(*columns)
        now, level = own.where("level = 0"), 0
        while size > 1:
            made = materialise(_families(now.where("size > 1")), "families")
            above.append(made)
            level, size = level + 1, parents(size)
            up = made.select("tree", "level", "place", "size", F.sha2(F.col("children").cast("binary"), 256).alias("digest"))
            if trees is not None:  # the roots of groups go into the tree over them
                tops = tops.unionByName(up.where("size = 1").select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("place"), F.lit(groups).cast("long").alias("size"), "digest"))
            now = up.where("size > 1").unionByName(own.where(F.col("level") == level)) if trees is not None else up
    root = now.first()["digest"]
    out = above[0] if above else None
    for x in above[1:]:
        out = out.unionByName(x)
    return out, root


def _proofs(places: dict[int, tuple], groups: int, root: str, full: bool):
    """(rows, families) of a partition to (id, leaf, subroot, root, proof, folded root, verified)."""

    def run(k: int, both: Iterator[tuple[list, list]]) -> Iterator[tuple]:
        for rows, sent in both:
            if not rows:
                continue
            families = {(tree, level, place): children for tree, level, place, children in sent}
            heights = {TOP: 0}
            size = groups
            while size > 1:
                heights[TOP], size = heights[TOP] + 1, parents(size)
            for piece, own in _pieces(rows, places[k]):
                height = len(piece.levels) - 1
                top, at = [], piece.tree
                for level in range(1, heights[TOP] + 1):
                    top.append((families[TOP, level, at // FANOUT], at % FANOUT))
                    at //= FANOUT

                def family(level: int, place: int, piece: Piece = piece) -> str:
                    return piece.children(level, place) if piece.has(level, place) else families[piece.tree, level, place]

                subroot = own[0][2] if not height else piece.levels[height][1][0] if piece.has(height, 0) else H(families[piece.tree, height, 0])
                ways: dict[int, tuple[list, str]] = {}  # of a leaf's parent: the families above it, and what they add to a proof
                start = piece.levels[0][0]
                for j, (_, key, digest, changed) in enumerate(own):
                    place, steps, rest = start + j, [], ""
                    if height:
                        up = place // FANOUT
                        if up not in ways:
                            steps, at = [], up
                            for level in range(2, height + 1):
                                steps.append((family(level, at // FANOUT), at % FANOUT))
                                at //= FANOUT
                            steps += top
                            ways = {up: (family(1, up), steps, "".join(_without(c, i) for c, i in steps))}
                        children, steps, rest = ways[up]
                        steps = [(children, place % FANOUT), *steps]
                        proof = _without(children, place % FANOUT) + rest
                    else:
                        steps, proof = top, "".join(_without(c, i) for c, i in top)
                    folded = changed or digest
                    for c, i in steps:
                        folded = H(c[: i * _DIGEST] + folded + c[(i + 1) * _DIGEST :])
                    row = (key, digest, subroot, root, H(proof), folded, folded == root)
                    yield (*row, proof) if full else row

    return run


def _without(children: str, place: int) -> str:
    return children[: place * _DIGEST] + children[(place + 1) * _DIGEST :]


_ROWS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(leaves: DataFrame, rows_a_task: int = ROWS_A_TASK, full: bool = False) -> DataFrame:
    """The proofs of ``leaves`` (group, id, leaf, changed: the leaf to be checked in its place, or null for itself); with ``full`` also ``proof``,
    the siblings' digests from the leaf's level to the root's, each level from left to right, without a separator."""
    spark = leaves.sparkSession
    ship(spark)
    schema = _ROWS + ", proof string" * full
    kept = materialise(leaves.select(F.col("group").cast("string"), F.col("id").cast("long"), "leaf", "changed").withColumn("nth", F.monotonically_increasing_id()), "leaves")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-kept.count() // rows_a_task))
    order = ("group", "id", "leaf", "nth")
    ordered = kept.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("nth").rdd.map(tuple)
    places, groups, largest = _places(sorted(ordered.mapPartitionsWithIndex(_extent).collect()))
    if not groups:
        return spark.createDataFrame([], schema)
    built = materialise(spark.createDataFrame(ordered.mapPartitionsWithIndex(_built(places, groups)), _NODES, verifySchema=False), "nodes")
    families, root = _finish(built.where("digest IS NOT NULL"), largest, groups)
    n = ordered.getNumPartitions()
    if families is None:
        sent = spark.sparkContext.parallelize([], 1)
    else:
        sent = built.where("digest IS NULL").select("part", "tree", "level", "place").join(families, ["tree", "level", "place"]).select("part", "tree", "level", "place", "children").rdd.map(lambda r: (r[0], tuple(r[1:])))
    sent = sent.partitionBy(n, lambda k: k).mapPartitions(lambda rows: [[x for _, x in rows]])
    done = ordered.mapPartitions(lambda rows: [list(rows)]).zip(sent).mapPartitionsWithIndex(_proofs(places, groups, root, full))
    return spark.createDataFrame(done, schema, verifySchema=False)


def document_leaves(docs: DataFrame) -> DataFrame:
    """The leaves of ``documents``; a third of the rows, by the crc32 of the id, come with the leaf of a text whose A to Z are lower-cased."""
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0) & F.col("text").isNotNull()
    changed = F.when(hit, leaf(*map(F.col, columns[:-1]), low))
    return docs.select(F.col("lang").alias("group"), F.col("doc_id").alias("id"), leaf(*map(F.col, columns)).alias("leaf"), changed.alias("changed"))
