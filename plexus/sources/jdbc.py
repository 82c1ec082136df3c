"""Catalogs of database servers over Spark's JDBC source: each part is one query whose rows become a document's table.

The SQL below reads catalogs only. Usage counters that the server does not keep are left out and said to be, never reported as zero.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import ship, written
from . import oracle_packages
from .document import Document

Reader = Callable[[str], DataFrame]

_INFO = {
    "objects": "SELECT table_schema AS schema_name, table_name AS name, CASE table_type WHEN 'VIEW' THEN 'view' ELSE 'table' END AS kind FROM information_schema.tables WHERE table_schema {filter}",
    "columns": "SELECT table_schema AS schema_name, table_name AS object, column_name AS name, data_type, is_nullable, column_default AS dflt, ordinal_position AS ordinal FROM information_schema.columns WHERE table_schema {filter}",
    "keys": "SELECT k.table_schema AS schema_name, k.table_name AS object, k.column_name AS name, k.ordinal_position AS pk_position FROM information_schema.table_constraints c JOIN information_schema.key_column_usage k ON k.constraint_schema = c.constraint_schema AND k.constraint_name = c.constraint_name AND k.table_name = c.table_name WHERE c.constraint_type = 'PRIMARY KEY' AND k.table_schema {filter}",
    "bodies": "SELECT table_schema AS schema_name, table_name AS name, view_definition AS body FROM information_schema.views WHERE table_schema {filter}",
}

POSTGRES = {
    **_INFO,
    # information_schema knows neither materialized views nor sequences
    "objects": "SELECT n.nspname AS schema_name, c.relname AS name, CASE c.relkind WHEN 'v' THEN 'view' WHEN 'm' THEN 'materialized-view' WHEN 'S' THEN 'sequence' ELSE 'table' END AS kind FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace WHERE c.relkind IN ('r', 'p', 'f', 'v', 'm', 'S') AND n.nspname {filter}",
    "columns": "SELECT n.nspname AS schema_name, c.relname AS object, a.attname AS name, format_type(a.atttypid, a.atttypmod) AS data_type, CASE WHEN a.attnotnull THEN 'NO' ELSE 'YES' END AS is_nullable, pg_get_expr(d.adbin, d.adrelid) AS dflt, a.attnum AS ordinal FROM pg_attribute a JOIN pg_class c ON c.oid = a.attrelid JOIN pg_namespace n ON n.oid = c.relnamespace LEFT JOIN pg_attrdef d ON d.adrelid = a.attrelid AND d.adnum = a.attnum WHERE a.attnum > 0 AND NOT a.attisdropped AND c.relkind IN ('r', 'p', 'f', 'v', 'm') AND n.nspname {filter}",
    "bodies": "SELECT n.nspname AS schema_name, c.relname AS name, pg_get_viewdef(c.oid) AS body FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace WHERE c.relkind IN ('v', 'm') AND n.nspname {filter}",
    "constraints": "SELECT n.nspname AS schema_name, t.relname AS object, c.conname AS name, a.attname AS own, k.ord AS pos, rn.nspname AS ref_schema, r.relname AS ref_table, ra.attname AS far FROM pg_constraint c JOIN pg_class t ON t.oid = c.conrelid JOIN pg_namespace n ON n.oid = t.relnamespace JOIN pg_class r ON r.oid = c.confrelid JOIN pg_namespace rn ON rn.oid = r.relnamespace CROSS JOIN LATERAL unnest(c.conkey, c.confkey) WITH ORDINALITY AS k(a, b, ord) JOIN pg_attribute a ON a.attrelid = c.conrelid AND a.attnum = k.a JOIN pg_attribute ra ON ra.attrelid = c.confrelid AND ra.attnum = k.b WHERE c.contype = 'f' AND n.nspname {filter}",
    "indexes": "SELECT n.nspname AS schema_name, t.relname AS object, i.relname AS name, x.indisunique AS uniq, pg_get_expr(x.indpred, x.indrelid) AS predicate, k.ord AS pos, a.attname AS own FROM pg_index x JOIN pg_class i ON i.oid = x.indexrelid JOIN pg_class t ON t.oid = x.indrelid JOIN pg_namespace n ON n.oid = t.relnamespace CROSS JOIN LATERAL unnest(x.indkey::int[]) WITH ORDINALITY AS k(a, ord) LEFT JOIN pg_attribute a ON a.attrelid = x.indrelid AND a.attnum = k.a AND k.a > 0 WHERE k.ord <= x.indnkeyatts AND n.nspname {filter}",
    "triggers": "SELECT n.nspname AS schema_name, t.relname AS object, g.tgname AS name, pg_get_triggerdef(g.oid) AS body FROM pg_trigger g JOIN pg_class t ON t.oid = g.tgrelid JOIN pg_namespace n ON n.oid = t.relnamespace WHERE NOT g.tgisinternal AND n.nspname {filter}",
    "routines": "SELECT n.nspname AS schema_name, p.proname AS name, CASE p.prokind WHEN 'p' THEN 'procedure' ELSE 'function' END AS kind, l.lanname AS language, CASE WHEN p.prokind IN ('a', 'w') THEN NULL ELSE pg_get_functiondef(p.oid) END AS body, pg_get_function_identity_arguments(p.oid) AS signature FROM pg_proc p JOIN pg_namespace n ON n.oid = p.pronamespace JOIN pg_language l ON l.oid = p.prolang WHERE n.nspname {filter}",
    "usage": "SELECT schemaname AS schema_name, relname AS object, NULL AS member, seq_tup_read + coalesce(idx_tup_fetch, 0) AS reads, n_tup_ins + n_tup_upd + n_tup_del AS writes, seq_scan + coalesce(idx_scan, 0) AS scans FROM pg_stat_user_tables WHERE schemaname {filter} UNION ALL SELECT schemaname, relname, indexrelname, idx_tup_read, 0, idx_scan FROM pg_stat_user_indexes WHERE schemaname {filter}",
    "tracked": "SELECT current_setting('track_counts') AS value",
    "dependencies": "SELECT DISTINCT dn.nspname AS s_schema, d.relname AS s_name, rn.nspname AS t_schema, r.relname AS t_name, 'pg_depend' AS catalog, p.deptype::text AS dependency_type FROM pg_depend p JOIN pg_rewrite w ON w.oid = p.objid AND p.classid = 'pg_rewrite'::regclass JOIN pg_class d ON d.oid = w.ev_class JOIN pg_namespace dn ON dn.oid = d.relnamespace JOIN pg_class r ON r.oid = p.refobjid AND p.refclassid = 'pg_class'::regclass JOIN pg_namespace rn ON rn.oid = r.relnamespace WHERE d.oid <> r.oid AND dn.nspname {filter}",
}
MYSQL = {
    **_INFO,
    "constraints": "SELECT table_schema AS schema_name, table_name AS object, constraint_name AS name, column_name AS own, ordinal_position AS pos, referenced_table_schema AS ref_schema, referenced_table_name AS ref_table, referenced_column_name AS far FROM information_schema.key_column_usage WHERE referenced_table_name IS NOT NULL AND table_schema {filter}",
    "indexes": "SELECT table_schema AS schema_name, table_name AS object, index_name AS name, non_unique = 0 AS uniq, NULL AS predicate, seq_in_index AS pos, column_name AS own FROM information_schema.statistics WHERE table_schema {filter}",
    "triggers": "SELECT trigger_schema AS schema_name, event_object_table AS object, trigger_name AS name, action_statement AS body FROM information_schema.triggers WHERE trigger_schema {filter}",
    "routines": "SELECT routine_schema AS schema_name, routine_name AS name, lower(routine_type) AS kind, 'sql' AS language, routine_definition AS body, NULL AS signature FROM information_schema.routines WHERE routine_schema {filter}",
    "usage": "SELECT table_schema AS schema_name, table_name AS object, NULL AS member, rows_fetched AS `reads`, rows_inserted + rows_updated + rows_deleted AS writes, NULL AS scans FROM sys.schema_table_statistics WHERE table_schema {filter} UNION ALL SELECT object_schema, object_name, index_name, 0, 0, NULL FROM sys.schema_unused_indexes WHERE object_schema {filter}",
}
SQLSERVER = {
    **_INFO,
    "objects": "SELECT s.name AS schema_name, o.name, CASE o.type WHEN 'V' THEN 'view' WHEN 'SO' THEN 'sequence' WHEN 'SN' THEN 'synonym' ELSE 'table' END AS kind FROM sys.objects o JOIN sys.schemas s ON s.schema_id = o.schema_id WHERE o.type IN ('U', 'V', 'SO', 'SN') AND o.is_ms_shipped = 0 AND s.name {filter}",
    "bodies": "SELECT s.name AS schema_name, o.name, m.definition AS body FROM sys.sql_modules m JOIN sys.objects o ON o.object_id = m.object_id JOIN sys.schemas s ON s.schema_id = o.schema_id WHERE o.type = 'V' AND s.name {filter}",
    "constraints": "SELECT s.name AS schema_name, t.name AS object, f.name, pc.name AS own, k.constraint_column_id AS pos, rs.name AS ref_schema, rt.name AS ref_table, rc.name AS far FROM sys.foreign_keys f JOIN sys.foreign_key_columns k ON k.constraint_object_id = f.object_id JOIN sys.tables t ON t.object_id = f.parent_object_id JOIN sys.schemas s ON s.schema_id = t.schema_id JOIN sys.tables rt ON rt.object_id = f.referenced_object_id JOIN sys.schemas rs ON rs.schema_id = rt.schema_id JOIN sys.columns pc ON pc.object_id = k.parent_object_id AND pc.column_id = k.parent_column_id JOIN sys.columns rc ON rc.object_id = k.referenced_object_id AND rc.column_id = k.referenced_column_id WHERE s.name {filter}",
    "indexes": "SELECT s.name AS schema_name, t.name AS object, i.name, i.is_unique AS uniq, i.filter_definition AS predicate, k.key_ordinal AS pos, c.name AS own FROM sys.indexes i JOIN sys.index_columns k ON k.object_id = i.object_id AND k.index_id = i.index_id AND k.is_included_column = 0 JOIN sys.objects t ON t.object_id = i.object_id AND t.type IN ('U', 'V') JOIN sys.schemas s ON s.schema_id = t.schema_id JOIN sys.columns c ON c.object_id = k.object_id AND c.column_id = k.column_id WHERE i.name IS NOT NULL AND i.is_hypothetical = 0 AND s.name {filter}",
    "triggers": "SELECT s.name AS schema_name, t.name AS object, g.name, m.definition AS body FROM sys.triggers g JOIN sys.objects t ON t.object_id = g.parent_id JOIN sys.schemas s ON s.schema_id = t.schema_id LEFT JOIN sys.sql_modules m ON m.object_id = g.object_id WHERE g.is_ms_shipped = 0 AND s.name {filter}",
    "routines": "SELECT s.name AS schema_name, o.name, CASE o.type WHEN 'P' THEN 'procedure' ELSE 'function' END AS kind, 'tsql' AS language, m.definition AS body, NULL AS signature FROM sys.objects o JOIN sys.schemas s ON s.schema_id = o.schema_id LEFT JOIN sys.sql_modules m ON m.object_id = o.object_id WHERE o.type IN ('P', 'FN', 'IF', 'TF') AND o.is_ms_shipped = 0 AND s.name {filter}",
    "usage": "SELECT s.name AS schema_name, t.name AS object, i.name AS member, u.user_seeks + u.user_scans + u.user_lookups AS reads, u.user_updates AS writes, u.user_scans AS scans FROM sys.dm_db_index_usage_stats u JOIN sys.objects t ON t.object_id = u.object_id JOIN sys.schemas s ON s.schema_id = t.schema_id JOIN sys.indexes i ON i.object_id = u.object_id AND i.index_id = u.index_id WHERE u.database_id = DB_ID() AND i.name IS NOT NULL AND s.name {filter}",
    "dependencies": "SELECT s.name AS s_schema, o.name AS s_name, d.referenced_schema_name AS t_schema, d.referenced_entity_name AS t_name, d.referenced_database_name AS t_database, 'sys.sql_expression_dependencies' AS catalog, 'reference' AS dependency_type FROM sys.sql_expression_dependencies d JOIN sys.objects o ON o.object_id = d.referencing_id JOIN sys.schemas s ON s.schema_id = o.schema_id WHERE s.name {filter}",
}
ORACLE = {
    # a materialized view is listed as a table too, under the same name
    "objects": "SELECT o.owner AS schema_name, o.object_name AS name, replace(lower(o.object_type), ' ', '-') AS kind FROM all_objects o WHERE o.object_type IN ('TABLE', 'VIEW', 'MATERIALIZED VIEW', 'SEQUENCE', 'SYNONYM') AND NOT (o.object_type = 'TABLE' AND EXISTS (SELECT 1 FROM all_mviews m WHERE m.owner = o.owner AND m.mview_name = o.object_name)) AND o.owner {filter}",
    "columns": "SELECT owner AS schema_name, table_name AS object, column_name AS name, data_type, nullable AS is_nullable, data_default AS dflt, column_id AS ordinal FROM all_tab_columns WHERE owner {filter}",
    "keys": "SELECT k.owner AS schema_name, k.table_name AS object, k.column_name AS name, k.position AS pk_position FROM all_constraints c JOIN all_cons_columns k ON k.owner = c.owner AND k.constraint_name = c.constraint_name WHERE c.constraint_type = 'P' AND c.owner {filter}",
    "bodies": "SELECT owner AS schema_name, view_name AS name, text AS body FROM all_views WHERE owner {filter}",
    "mview_bodies": "SELECT owner AS schema_name, mview_name AS name, query AS body FROM all_mviews WHERE owner {filter}",
    "constraints": "SELECT c.owner AS schema_name, c.table_name AS object, c.constraint_name AS name, k.column_name AS own, k.position AS pos, r.owner AS ref_schema, r.table_name AS ref_table, rk.column_name AS far FROM all_constraints c JOIN all_cons_columns k ON k.owner = c.owner AND k.constraint_name = c.constraint_name JOIN all_constraints r ON r.owner = c.r_owner AND r.constraint_name = c.r_constraint_name JOIN all_cons_columns rk ON rk.owner = r.owner AND rk.constraint_name = r.constraint_name AND rk.position = k.position WHERE c.constraint_type = 'R' AND c.owner {filter}",
    "indexes": "SELECT i.table_owner AS schema_name, i.table_name AS object, i.index_name AS name, CASE i.uniqueness WHEN 'UNIQUE' THEN 1 ELSE 0 END AS uniq, NULL AS predicate, k.column_position AS pos, CASE WHEN i.index_type LIKE 'FUNCTION-BASED%' THEN NULL ELSE k.column_name END AS own FROM all_indexes i JOIN all_ind_columns k ON k.index_owner = i.owner AND k.index_name = i.index_name WHERE i.table_owner {filter}",
    "triggers": "SELECT table_owner AS schema_name, table_name AS object, trigger_name AS name, trigger_body AS body FROM all_triggers WHERE base_object_type IN ('TABLE', 'VIEW') AND table_owner {filter}",
    "source_lines": "SELECT owner AS schema_name, name, type, line, text FROM all_source WHERE type IN ('PROCEDURE', 'FUNCTION', 'PACKAGE BODY') AND owner {filter}",
    "dependencies": "SELECT owner AS s_schema, name AS s_name, referenced_owner AS t_schema, referenced_name AS t_name, referenced_link_name AS t_database, 'ALL_DEPENDENCIES' AS catalog, dependency_type FROM all_dependencies WHERE owner {filter}",
}
SERVERS = {"postgres": POSTGRES, "mysql": MYSQL, "sqlserver": SQLSERVER, "oracle": ORACLE}
#: Notes of unclear package members that are shown one by one.
MOST_NOTES = 1000
SCHEMES = {"postgres": "postgres", "postgresql": "postgres", "mysql": "mysql", "mariadb": "mysql", "sqlserver": "sqlserver", "oracle": "oracle", "sqlite": "sqlite"}


def scheme_of(url: str) -> str:
    """The kind of source that a URL names; foreign schemes are refused."""
    scheme = re.match(r"(?:jdbc:)?([a-z]+):", url)
    if not scheme or scheme[1] not in SCHEMES:
        raise ValueError(f"no reader for this URL: {redacted(url)}")
    return SCHEMES[scheme[1]]


def redacted(text: str) -> str:
    """Connection text without its secrets."""
    text = re.sub(r"(://)[^/@\s]+@", r"\1***@", text)
    return re.sub(r"(?i)((?:password|pwd|passwd|token|secret)\s*=\s*)[^&;\s]+", r"\1***", text)


def jdbc_reader(spark: SparkSession, url: str, **options: str) -> Reader:
    """One query, pushed to the server. The driver class and its jar are the cluster's."""
    return lambda query: spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load()


def transport_note(url: str) -> list[str]:
    """A remote connection that does not ask for encryption is said to be one."""
    host = re.search(r"//([^/:?;]+)", url)
    local = host is None or host[1] in ("localhost", "127.0.0.1", "[::1]")
    safe = re.search(r"(?i)sslmode=(require|verify-ca|verify-full)|usessl=true|encrypt=true", url)
    return [] if local or safe else [f"connection-not-encrypted: {host[1]}"]


def read(spark: SparkSession, dialect: str, reader: Reader, schemas: list[str], usage: bool = False, dependencies: bool = False, source_id: str | None = None, notes: tuple[str, ...] = ()) -> Document:
    """A document from a server's catalog. ``reader`` runs one query."""
    queries = SERVERS[dialect]
    where = "IN (" + ", ".join("'" + s.replace("'", "''") + "'" for s in schemas) + ")"
    said = list(notes)

    def rows(part: str) -> DataFrame | None:
        if part not in queries:
            said.append(f"{dialect}: {part} are not collected")
            return None
        return reader(queries[part].format(filter=where))

    def oracle_routines() -> DataFrame:
        """Lines of source put together; a package's body is cut into its members, and those that are not clear are noted."""
        lines = rows("source_lines").withColumn("line", F.col("line").cast("long"))
        whole = lines.groupBy("schema_name", "name", "type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "").alias("body"))  # lines of one unit
        none = F.lit(None).cast("string")
        kind = F.when(F.col("type") == "PACKAGE BODY", "package").otherwise(F.lower("type"))
        units = whole.select("schema_name", "name", kind.alias("kind"), F.lit("plsql").alias("language"), F.when(F.col("type") != "PACKAGE BODY", F.concat(F.lit("CREATE "), "body")).alias("body"), none.alias("signature"), none.alias("member_of"))

        def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                found = []
                for r in frame.itertuples():
                    members, notes = oracle_packages.members(r.body)
                    found += [(r.schema_name, m.name, m.kind, "plsql", f"CREATE {m.body}", m.signature, r.name, None) for m in members]
                    found += [(r.schema_name, None, None, None, None, None, r.name, f"package {r.schema_name}.{r.name}: {n}") for n in notes]
                yield pd.DataFrame(found, columns=["schema_name", "name", "kind", "language", "body", "signature", "member_of", "note"], dtype=object)

        ship(spark)
        inner = whole.where("type = 'PACKAGE BODY'").select("schema_name", "name", "body").mapInPandas(cut, "schema_name string, name string, kind string, language string, body string, signature string, member_of string, note string")
        inner = written(inner, "package-members")
        unclear = inner.where("note IS NOT NULL").select("note")
        n = unclear.count()
        said.extend(r["note"] for r in unclear.orderBy("note").limit(MOST_NOTES).collect())
        if n > MOST_NOTES:
            said.append(f"package members that are not clear, in all: {n}")
        if n:
            said.append("package members are not collected whole")  # so the catalog is not complete
        return units.unionByName(inner.where("note IS NULL").drop("note"))

    tables: dict[str, DataFrame] = {"schemas": spark.createDataFrame([(s,) for s in schemas], "schema string")}
    objects, columns, keys, bodies = rows("objects"), rows("columns"), rows("keys"), rows("bodies")
    if "mview_bodies" in queries:
        bodies = bodies.unionByName(rows("mview_bodies"))
    n = columns.groupBy("schema_name", F.col("object").alias("name")).agg(F.count(F.lit(1)).cast("int").alias("n_columns"))
    with_body = objects.join(bodies, ["schema_name", "name"], "left") if bodies is not None else objects.withColumn("body", F.lit(None).cast("string"))
    tables["objects"] = with_body.join(n, ["schema_name", "name"], "left").select(F.col("schema_name").alias("schema"), "name", "kind", "body", F.coalesce("n_columns", F.lit(0)).alias("n_columns"))
    pk = keys.select("schema_name", "object", "name", F.col("pk_position").cast("int")) if keys is not None else None
    c = columns.join(pk, ["schema_name", "object", "name"], "left") if pk is not None else columns.withColumn("pk_position", F.lit(None).cast("int"))
    tables["columns"] = c.select(F.col("schema_name").alias("schema"), "object", "name", "data_type", F.upper("is_nullable").isin("YES", "Y").alias("nullable"), F.col("dflt").cast("string").alias("default"), F.col("ordinal").cast("int").alias("ordinal"), F.coalesce("pk_position", F.lit(0)).alias("pk_position"))
    if (k := rows("constraints")) is not None:
        g = k.groupBy("schema_name", "object", "name", "ref_schema", "ref_table").agg(F.array_sort(F.collect_list(F.struct("pos", "own", "far"))).alias("k"))
        tables["constraints"] = g.select(F.col("schema_name").alias("schema"), "object", "name", F.lit("foreign-key").alias("kind"), F.transform("k", lambda x: x["own"]).alias("columns"), "ref_schema", "ref_table", F.transform("k", lambda x: x["far"]).alias("ref_columns"))
    if (i := rows("indexes")) is not None:
        g = i.groupBy("schema_name", "object", "name", F.col("uniq").cast("boolean").alias("uniq"), F.col("predicate").cast("string").alias("predicate")).agg(F.array_sort(F.collect_list(F.struct("pos", "own"))).alias("k"))
        own = F.transform("k", lambda x: x["own"])
        tables["indexes"] = g.select(F.col("schema_name").alias("schema"), "object", "name", F.col("uniq").alias("unique"), F.filter(own, lambda x: x.isNotNull()).alias("columns"), F.forall(own, lambda x: x.isNotNull()).alias("definition_complete"), "predicate", F.col("predicate").isNotNull().alias("has_predicate"))
    if (t := rows("triggers")) is not None:
        tables["triggers"] = t.select(F.col("schema_name").alias("schema"), "object", "name", "body")
    if (r := oracle_routines() if "source_lines" in queries else rows("routines")) is not None:
        none = F.lit(None).cast("string")
        member = F.col("member_of") if "member_of" in r.columns else none
        tables["routines"] = r.select(F.col("schema_name").alias("schema"), "name", "kind", "language", "body", F.col("signature").cast("string").alias("signature"), member.alias("member_of"), none.alias("source"))
    if usage:
        off = "tracked" in queries and reader(queries["tracked"]).first()["value"] != "on"
        u = None if off else rows("usage")
        if off:
            said.append("the server does not count usage; none is reported")
        if u is not None:
            null = lambda t: F.lit(None).cast(t)
            tables["usage"] = u.select(F.col("schema_name").alias("schema"), "object", F.col("member").cast("string").alias("member"), null("string").alias("signature"), null("string").alias("since"), *(F.col(x).cast("long").alias(x) for x in ("reads", "writes", "scans")), null("double").alias("total_ms"), null("double").alias("self_ms"))
    if dependencies and (d := rows("dependencies")) is not None:
        null = F.lit(None).cast("string")
        base = F.col("t_database") if "t_database" in d.columns else null
        ref = lambda s, n, db: F.struct(s.alias("schema"), n.alias("name"), null.alias("kind"), null.alias("member"), null.alias("signature"), db.alias("database"))
        tables["dependencies"] = d.select(F.concat_ws(".", "s_schema", "s_name").alias("source"), F.concat_ws(".", base, F.col("t_schema"), F.col("t_name")).alias("target"), "catalog", "dependency_type", ref(F.col("s_schema"), F.col("s_name"), null).alias("src"), ref(F.col("t_schema"), F.col("t_name"), base).alias("dst"))
    header = {"version": 2, "dialect": dialect, "reader": "jdbc", "source_id": source_id, "schema_filter": sorted(schemas), "catalog_complete": not [x for x in said if "not collected" in x]}
    return Document(spark, tables, header, tuple(said))
