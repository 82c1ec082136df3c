"""Graphs over rows of ordinary tables: vertices are rows, edges come from key columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import written
from .bundle import GraphBundle, union_all


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Key columns of each table and, per foreign key, (target table, columns). Fixed values of the star schema.
KEYS = {
    "region": (("r_regionkey",), ()),
    "nation": (("n_nationkey",), (("region", ("n_regionkey",)),)),
    "customer": (("c_custkey",), (("nation", ("c_nationkey",)),)),
    "supplier": (("s_suppkey",), (("nation", ("s_nationkey",)),)),
    "part": (("p_partkey",), ()),
    "orders": (("o_orderkey",), (("customer", ("o_custkey",)),)),
    "lineitem": (("l_orderkey", "l_linenumber"), (("orders", ("l_orderkey",)), ("part", ("l_partkey",)), ("supplier", ("l_suppkey",)))),
}


def _id(table_name: str, columns: tuple[str, ...]):
    return F.concat(F.lit(f"{table_name}."), F.concat_ws("-", *(F.col(c).cast("string") for c in columns)))


def _once(rows: DataFrame, *keys: tuple[str, ...]) -> DataFrame:
    """The distinct values of the keys, as they are before ids are made of them: numbers are shuffled, not texts. Parts of a key without a value go last, as an id leaves them out."""
    shown = []
    for key in keys:
        whole = F.array_compact(F.array(*(F.col(c).cast("long") for c in key)))
        integral = all(dict(rows.dtypes)[c] in ("tinyint", "smallint", "int", "bigint") for c in key)
        shown += [F.get(whole, F.lit(k)).alias(c) for k, c in enumerate(key)] if integral and len(key) > 1 else [F.col(c) for c in key]
    return rows.select(*shown).distinct()


def row_graph(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = tuple(KEYS), saved: bool = False) -> GraphBundle:
    """Rows of the named tables with ``references`` edges along foreign keys between them, and each row contained in its table.

    ``saved``: vertices and references are computed once; what contains a row is read off the vertices and takes no space of its own.
    """
    vertices, edges = [], []
    for name in names:
        keys, fks = KEYS[name]
        rows = table(spark, sf_dir, name)
        own = _id(name, keys)
        vertices.append(_once(rows, keys).select(own.alias("id"), F.lit("column").alias("kind"), F.concat_ws("-", *(F.col(c).cast("string") for c in keys)).alias("name"), F.lit(name).alias("schema")))
        for target, columns in fks:
            if target in names:
                further = tuple(c for c in columns if c not in keys)
                edges.append(_once(rows, keys, further).select(own.alias("src"), _id(target, columns).alias("dst"), F.lit("references").alias("kind")))
        vertices.append(spark.createDataFrame([(name, "table", name, name)], "id string, kind string, name string, schema string"))
    keep = written if saved else lambda df, _: df
    known, references = keep(union_all(vertices), "vertices"), keep(union_all(edges), "references") if edges else None
    holds = known.where("kind = 'column'").select(F.col("schema").alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("kind"))
    return GraphBundle(spark, {"vertices": known, "edges": holds if references is None else references.unionByName(holds)})


def trade_pairs(spark: SparkSession, sf_dir: str, upto: str | None = None) -> DataFrame:
    """(src, dst, n): customer nation to supplier nation through order lines; with ``upto`` only orders up to that date."""
    orders = table(spark, sf_dir, "orders")
    if upto:
        orders = orders.where(F.col("o_orderdate") <= F.lit(upto).cast("date"))
    nation = lambda t, key: table(spark, sf_dir, t).select(F.col(f"{t[0]}_{key}").alias(key), F.col(f"{t[0]}_nationkey").alias(f"{t[0]}n"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    return (
        lines.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(nation("customer", "custkey"), F.col("o_custkey") == F.col("custkey"))
        .join(nation("supplier", "suppkey"), F.col("l_suppkey") == F.col("suppkey"))
        .groupBy("cn", "sn")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.concat(F.lit("nation."), F.col("cn").cast("string")).alias("src"), F.concat(F.lit("nation."), F.col("sn").cast("string")).alias("dst"), "n")
    )


def trade_graph(spark: SparkSession, sf_dir: str, modulus: int = 17, rest: int = 0, upto: str | None = None) -> GraphBundle:
    """A cyclic graph of nations: pairs whose number of order lines leaves ``rest`` modulo ``modulus``."""
    pairs = trade_pairs(spark, sf_dir, upto).where(F.col("n") % modulus == rest)
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation."), F.col("n_nationkey").cast("string")).alias("id"), F.lit("view").alias("kind"), F.trim("n_name").alias("name"), F.lit("nation").alias("schema"))
    return GraphBundle(spark, {"vertices": nations, "edges": pairs.select("src", "dst", F.lit("reads").alias("kind"))})


def order_graph(spark: SparkSession, sf_dir: str, date: str) -> GraphBundle:
    """Orders as they stood at a date: an order is there from its own date to a year after its last line went out, a ``table`` once all its lines have gone
    out and a ``view`` before (or without lines). It reads its customer, and writes the suppliers whose lines have gone out."""
    day = F.lit(date).cast("date")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("placed"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_shipdate").cast("date").alias("gone"))
    last = lines.groupBy("l_orderkey").agg(F.max("gone").alias("last"))
    there = orders.join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left").where((F.col("placed") <= day) & (F.col("last").isNull() | (F.add_months("last", 12) >= day)))
    there = there.select("o_orderkey", "o_custkey", F.when(F.col("last") <= day, "table").otherwise("view").alias("kind"))
    order = _id("orders", ("o_orderkey",))
    own = there.select(order.alias("id"), "kind", F.col("o_orderkey").cast("string").alias("name"), F.lit("orders").alias("schema"))
    reads = there.select(order.alias("src"), _id("customer", ("o_custkey",)).alias("dst"), F.lit("reads").alias("kind"))
    sent = lines.where(F.col("gone") <= day).select("l_orderkey", "l_suppkey").distinct().join(there.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    writes = sent.select(_id("orders", ("l_orderkey",)).alias("src"), _id("supplier", ("l_suppkey",)).alias("dst"), F.lit("writes").alias("kind"))
    ends = [row_graph(spark, sf_dir, (name,)).vertices for name in ("customer", "supplier")]
    return GraphBundle(spark, {"vertices": union_all([own, *ends]), "edges": union_all([reads, writes]).distinct()})
