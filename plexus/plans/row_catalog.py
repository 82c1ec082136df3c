"""Catalog documents made from the rows of the star tables, of any size: what a query says about them can be told in SQL over the same rows.

Regions are schemas, nations their tables, customers columns, suppliers foreign keys from their nation to nation 0 of their region (of
low balance: without a name), parts routines of nation 0's schema (of small size: without a signature). Two states of each are told
apart by the rows' own balances and sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.document import REF, Document
from .bundle import union_all
from .rowgraph import table


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("nk"), F.col("r_name").alias("schema"), F.col("n_name").alias("object"))


def row_document(spark: SparkSession, sf_dir: str, later: bool = False, database: str = "rows") -> Document:
    """The document of the rows; ``later``: after some have come, gone and changed."""
    nations = places(spark, sf_dir)
    none = lambda t="string": F.lit(None).cast(t)
    customer = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("nk"))
    columns = customer.where("c_acctbal >= 0" if later else "c_acctbal <= 9000").select(
        "schema", "object", F.format_string("c%d", "c_custkey").alias("name"),
        (F.when(F.col("c_mktsegment") == "BUILDING", "text").otherwise(F.lower("c_mktsegment")) if later else F.lower("c_mktsegment")).alias("data_type"),
        (F.col("c_acctbal") > (2000 if later else 1000)).alias("nullable"), none().alias("default"), F.col("c_custkey").cast("int").alias("ordinal"), F.lit(0).alias("pk_position"),
    )
    supplier = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("nk"))
    keys = supplier.where("s_acctbal >= 0" if later else "s_acctbal <= 9000").select(
        "schema", "object", F.when(F.col("s_acctbal") > 3000, F.format_string("f%d", "s_suppkey")).alias("name"), F.lit("foreign-key").alias("kind"),
        F.array(F.format_string("k%d", "s_suppkey")).alias("columns"), F.col("schema").alias("ref_schema"), F.lit("ALGERIA").alias("ref_table"), F.array(F.lit("id")).alias("ref_columns"),
    )
    home = nations.where("nk = 0").select("schema")
    routines = table(spark, sf_dir, "part").crossJoin(F.broadcast(home)).where("p_size >= 3" if later else "p_size <= 48").select(  # one row
        "schema", F.format_string("p%d", "p_partkey").alias("name"), F.lit("function").alias("kind"), F.lit("sql").alias("language"),
        F.when(F.col("p_size") >= 10, F.lit("select 2")).otherwise("select 1").alias("body") if later else F.lit("select 1").alias("body"),
        F.when(F.col("p_size") > 25, F.lit("int")).alias("signature"), none().alias("member_of"), none().alias("source"),
    )
    pairs = (
        table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b"), F.when(F.col("o_orderpriority") == "1-URGENT", "archive").alias("database")).distinct()
    )
    a, b = nations.select(F.col("nk").alias("a"), F.col("schema").alias("sa"), F.col("object").alias("oa")), nations.select(F.col("nk").alias("b"), F.col("schema").alias("sb"), F.col("object").alias("ob"))
    end = lambda s, o, db: F.struct(F.col(s).alias("schema"), F.col(o).alias("name"), none().alias("kind"), none().alias("member"), none().alias("signature"), db.alias("database")).cast(REF)
    dependencies = pairs.where("a <> b").join(a, "a").join(b, "b").select(
        F.concat_ws(".", "sa", "oa").alias("source"), F.concat_ws(".", "database", "sb", "ob").alias("target"), F.lit("trade").alias("catalog"), F.lit("sells").alias("dependency_type"), end("sa", "oa", none()).alias("src"), end("sb", "ob", F.col("database")).alias("dst")
    )
    tables = {
        "schemas": nations.select("schema").distinct(),
        "objects": nations.select("schema", F.col("object").alias("name"), F.lit("table").alias("kind"), none().alias("body"), F.lit(0).alias("n_columns")),
        "columns": columns, "constraints": keys, "routines": routines, "dependencies": dependencies,
    }
    header = {"version": 2, "dialect": "postgres", "producer": "rows", "source_id": "later" if later else "earlier", "database": database, "catalog_complete": True}
    return Document(spark, tables, header)


def package_document(spark: SparkSession, sf_dir: str) -> Document:
    """Brands as packages of nation 0's schema, with parts as their members."""
    none = lambda t="string": F.lit(None).cast(t)
    home = places(spark, sf_dir).where("nk = 0").select("schema")
    parts = table(spark, sf_dir, "part").crossJoin(F.broadcast(home)).withColumn("brand", F.regexp_replace("p_brand", "#", "_"))  # one row
    shape = lambda name, kind, owner: (F.col("schema"), name.alias("name"), F.lit(kind).alias("kind"), F.lit("plsql").alias("language"), none().alias("body"), none().alias("signature"), owner.alias("member_of"), none().alias("source"))
    brands = parts.select("schema", "brand").distinct().select(*shape(F.col("brand"), "package", none()))
    members = parts.select(*shape(F.format_string("p%d", "p_partkey"), "procedure", F.col("brand")))
    header = {"version": 2, "dialect": "oracle", "producer": "rows", "source_id": "packages", "database": "rows", "catalog_complete": True}
    return Document(spark, {"schemas": home, "routines": brands.unionByName(members)}, header)


def order_document(spark: SparkSession, sf_dir: str, later: bool = False) -> Document:
    """Nations as schemas, each with a table ``hub``, a table per customer (``c`` and its key) and a table per order (``o`` and its key).

    Customers refer to their hub, orders to their customer (those of low priority undeclared), and lines are columns of orders. Keys, types
    and indexes come and go by the rows' balances, segments, states and priorities, so that lint has all its cases. ``later``: open orders
    have a note, orders in progress are gone, and types, defaults, indexes and constraints have changed.
    """
    none = lambda t="string": F.lit(None).cast(t)
    names = lambda *c: F.array(*c).cast("array<string>")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nk"), F.col("n_name").alias("schema"), F.col("n_regionkey").alias("rk"))
    customer = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("nk")).withColumn("object", F.format_string("c%d", "c_custkey"))
    orders = table(spark, sf_dir, "orders").join(customer.select("c_custkey", "schema", F.col("object").alias("customer")), F.col("o_custkey") == F.col("c_custkey")).withColumn("object", F.format_string("o%d", "o_orderkey"))
    if later:
        orders = orders.where("o_orderstatus <> 'P'")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("quantity"), F.max(F.col("l_returnflag") == "R").alias("returned"))
    lines = lines.join(orders.select("schema", "object", "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))

    column = lambda df, name, kind, nullable, default, ordinal, key: df.select("schema", "object", name.alias("name"), kind.alias("data_type"), nullable.alias("nullable"), default.alias("default"), F.lit(ordinal).alias("ordinal") if isinstance(ordinal, int) else ordinal.alias("ordinal"), key.cast("int").alias("pk_position"))
    hub = nation.withColumn("object", F.lit("hub"))
    segment = lambda s, then, other: F.when(F.col("c_mktsegment") == s, then).otherwise(other)
    whole = F.lit("bigint") if later else F.lit("integer")
    own_type = segment("BUILDING", "bigserial", segment("MACHINERY", whole, segment("FURNITURE", none(), F.lit("bigint"))))
    no, yes, zero = F.lit(False), F.lit(True), F.lit(0)
    columns = [
        column(hub, F.lit("id"), F.when((F.col("rk") == 0) & F.lit(later), "integer").otherwise("bigint"), no, none(), 1, F.lit(1)),
        column(customer, F.lit("id"), own_type, no, none(), 1, F.col("c_acctbal") >= 0),
        column(customer, F.lit("hub_id"), F.lit("BIGINT "), yes, none(), 2, zero),
        column(orders, F.lit("id"), F.lit("bigint"), no, none(), 1, F.col("o_orderstatus") != "P"),
        column(orders, F.concat("customer", F.lit("_id")), F.lit("bigint"), yes, none(), 2, zero),
    ]
    line = F.format_string("l%d", "l_linenumber")
    place = (F.col("l_linenumber") + 2).cast("int")
    if later:
        columns.append(column(lines.where("quantity <= 45"), line, F.lit("numeric"), F.col("l_linenumber") != 2, F.when((F.col("l_linenumber") == 1) & F.col("returned"), "0"), place, zero))
        columns.append(column(orders.where("o_orderstatus = 'O'"), F.lit("note"), F.lit("text"), F.col("o_orderpriority") != "1-URGENT", none(), 100, zero))
        views = customer.where("c_acctbal > 9000").withColumn("object", F.format_string("v%d", "c_custkey"))
        columns.append(column(views, F.lit("id"), F.lit("bigint"), no, none(), 1, F.lit(1)))
    else:
        columns.append(column(lines, line, F.lit("numeric"), yes, none(), place, zero))

    key = lambda df, name, own, to, far: df.select("schema", "object", F.lit(name).alias("name"), F.lit("foreign-key").alias("kind"), names(own).alias("columns"), F.col("schema").alias("ref_schema"), to.alias("ref_table"), far.alias("ref_columns"))
    declared = orders.where("o_orderpriority <> '5-LOW'")
    if later:
        declared = declared.where("NOT (o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'O')")
    named = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), names(F.lit("id"))).otherwise(names())
    constraints = [key(customer, "to_hub", F.lit("hub_id"), F.lit("hub"), names(F.lit("id"))), key(declared, "to_customer", F.concat("customer", F.lit("_id")), F.col("customer"), named)]

    index = lambda df, name, own, unique=no, complete=yes, filtered=no: df.select("schema", "object", F.lit(name).alias("name"), unique.alias("unique"), names(own).alias("columns"), complete.alias("definition_complete"), none().alias("predicate"), filtered.alias("has_predicate"))
    done, by = orders.where("o_orderstatus = 'F'"), F.concat("customer", F.lit("_id"))
    indexes = [
        index(customer, "by_hub", F.lit("hub_id"), complete=F.col("c_acctbal") < 9000, filtered=F.col("c_mktsegment") == "HOUSEHOLD"),
        index(done.where("o_orderpriority <> '1-URGENT'") if later else done, "by_customer", by),
        index(done.where("o_orderpriority = '3-MEDIUM'"), "by_customer_again", by),
        index(done.where("o_orderpriority = '4-NOT SPECIFIED'"), "to_customer", by),
    ]
    if later:
        indexes.append(index(orders.where("o_orderstatus = 'O' AND o_orderpriority IN ('2-HIGH', '3-MEDIUM')"), "fresh", F.lit("id"), unique=F.col("o_orderpriority") == "2-HIGH"))

    objects = [hub, customer, orders, *([views] if later else [])]
    tables = {
        "schemas": nation.select("schema").distinct(),
        "objects": union_all([x.select("schema", F.col("object").alias("name"), F.lit("table").alias("kind"), none().alias("body"), F.lit(0).alias("n_columns")) for x in objects]),
        "columns": union_all(columns), "constraints": union_all(constraints), "indexes": union_all(indexes),
    }
    header = {"version": 2, "dialect": "postgres", "producer": "rows", "source_id": "later" if later else "earlier", "database": "orders", "catalog_complete": True}
    return Document(spark, tables, header)
