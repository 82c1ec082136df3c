"""GraphBundle: a graph snapshot as a small set of DataFrames, with one method per command."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import SCHEMAS, is_dependency, kind_order
from ..workspace import written


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(SCHEMAS[name]))


@dataclass(frozen=True)
class GraphBundle:
    """Tables by name (see model.SCHEMAS); a table that is not given is empty. ``complete``: the catalog was read whole."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    complete: bool = False

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("__") or name not in SCHEMAS:
            raise AttributeError(name)
        found = self.tables.get(name)
        return empty(self.spark, name) if found is None else found

    def with_tables(self, **tables: DataFrame) -> GraphBundle:
        return replace(self, tables={**self.tables, **tables})

    def arcs(self, registered: bool = True) -> DataFrame:
        """Dependency edges (src, dst, kind); with ``registered`` only those whose ends are vertices."""
        found = self.edges.where(is_dependency(F.col("kind"))).select("src", "dst", "kind")
        if not registered:
            return found
        ids = self.vertices.select("id")
        return found.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "kind")

    def noted(self, notes: Iterable[str]) -> GraphBundle:
        rows = [(n,) for n in notes]
        if not rows:
            return self
        return self.with_tables(limitations=self.limitations.unionByName(self.spark.createDataFrame(rows, SCHEMAS["limitations"])))

    def saved(self, *names: str) -> GraphBundle:
        """The bundle with its tables (or the named ones) computed once, in the shared folder."""
        return self.with_tables(**{n: written(self.tables[n], n) for n in names or self.tables if n in self.tables})

    def write(self, path: str) -> None:
        """Every table as Parquet under ``path``, which must not exist yet."""
        for name in SCHEMAS:
            getattr(self, name).write.mode("errorifexists").parquet(f"{path}/{name}")
        self.spark.createDataFrame([(self.complete,)], "complete boolean").write.mode("errorifexists").parquet(f"{path}/_header")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> GraphBundle:
        complete = spark.read.parquet(f"{path}/_header").first()["complete"]
        return cls(spark, {n: spark.read.parquet(f"{path}/{n}") for n in SCHEMAS}, complete)


def normalised(bundle: GraphBundle) -> GraphBundle:
    """The invariants of a graph: one vertex an id (the least kind in discovery order is not known here, so the first by
    kind order of the input's ``seq`` column if it has one), one edge a (src, dst, kind), analysis and origins only where
    their vertex or edge exists; what is dropped becomes a limitation."""
    v = bundle.vertices
    order = "seq" if "seq" in v.columns else "kind"
    first = v.groupBy("id").agg(F.min_by(F.struct("kind", "name", "schema"), F.col(order)).alias("f")).select("id", "f.kind", "f.name", "f.schema")
    edges = bundle.edges.select("src", "dst", "kind").distinct()
    lost = bundle.origins.join(edges, ["src", "dst", "kind"], "left_anti").count()
    origins = bundle.origins.join(edges, ["src", "dst", "kind"], "left_semi").select(*[c.split()[0] for c in SCHEMAS["origins"].split(", ")]).distinct()
    gone = bundle.analysis.join(first, "id", "left_anti").count()
    analysis = bundle.analysis.join(first, "id", "left_semi")
    ids = first.select(F.col("id").alias("c"))
    d = bundle.diagnostics.join(first, "id", "left_semi").withColumn("__n", F.monotonically_increasing_id())
    cand = d.select("__n", F.explode("candidates").alias("c")).join(ids, "c", "left_semi").groupBy("__n").agg(F.array_sort(F.collect_set("c")).alias("kept"))
    diagnostics = d.join(cand, "__n", "left").withColumn("candidates", F.coalesce("kept", F.array().cast("array<string>"))).drop("__n", "kept")
    notes = [f"origins without their edge: {lost}"] * bool(lost) + [f"analysis records without their vertex: {gone}"] * bool(gone)
    return bundle.with_tables(vertices=first, edges=edges, origins=origins, analysis=analysis, diagnostics=diagnostics).noted(notes)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def ordered_edges(edges: DataFrame) -> DataFrame:
    return edges.orderBy("src", "dst", kind_order(F.col("kind")))
