"""Bodies over the star catalog with what they must read, derive and be called: (name, output columns, SQL, reads, lineage, state).

Reads name tables, or table.column; lineage maps an output to its source columns. Written by hand. Fixed values.
"""

from __future__ import annotations

from . import star_catalog

VIEWS: list[tuple[str, list[str], str, str, dict[str, str], str]] = [
    ("plain", ["k", "n"], "SELECT n_nationkey, n_name FROM nation", "nation nation.n_nationkey nation.n_name", {"k": "nation.n_nationkey", "n": "nation.n_name"}, "complete"),
    ("filtered", ["n"], "SELECT n_name AS n FROM nation WHERE n_regionkey > 1", "nation nation.n_name nation.n_regionkey", {"n": "nation.n_name"}, "complete"),
    ("joined", ["c", "n"], "SELECT c.c_name, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey", "customer nation customer.c_name nation.n_name customer.c_nationkey nation.n_nationkey", {"c": "customer.c_name", "n": "nation.n_name"}, "complete"),
    ("starred", ["a", "b"], "SELECT * FROM region", "region region.r_regionkey region.r_name", {"a": "region.r_regionkey", "b": "region.r_name"}, "complete"),
    ("expression", ["x"], "SELECT upper(c_name) || ' of ' || n_name FROM customer, nation WHERE c_nationkey = n_nationkey", "customer nation customer.c_name nation.n_name customer.c_nationkey nation.n_nationkey", {"x": "customer.c_name nation.n_name"}, "complete"),
    ("with_cte", ["k", "n"], "WITH o AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) SELECT k, n FROM o", "orders orders.o_custkey", {"k": "orders.o_custkey"}, "complete"),
    ("cte_renamed", ["z"], "WITH o(a, b) AS (SELECT o_orderkey, o_custkey FROM orders) SELECT a + b AS z FROM o", "orders orders.o_orderkey orders.o_custkey", {"z": "orders.o_orderkey orders.o_custkey"}, "complete"),
    ("derived", ["d"], "SELECT q.d FROM (SELECT o_orderdate AS d FROM orders) AS q", "orders orders.o_orderdate", {"d": "orders.o_orderdate"}, "complete"),
    ("unioned", ["k"], "SELECT s_suppkey FROM supplier UNION ALL SELECT c_custkey FROM customer", "supplier customer supplier.s_suppkey customer.c_custkey", {"k": "supplier.s_suppkey customer.c_custkey"}, "complete"),
    ("except_", ["k"], "SELECT s_suppkey FROM supplier EXCEPT SELECT c_custkey FROM customer", "supplier customer supplier.s_suppkey customer.c_custkey", {"k": "supplier.s_suppkey"}, "complete"),
    ("intersected", ["k"], "SELECT s_suppkey FROM supplier INTERSECT SELECT c_custkey FROM customer", "supplier customer supplier.s_suppkey customer.c_custkey", {"k": "supplier.s_suppkey customer.c_custkey"}, "complete"),
    ("windowed", ["r"], "SELECT rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) FROM orders", "orders orders.o_custkey orders.o_orderdate", {"r": "orders.o_custkey orders.o_orderdate"}, "complete"),
    ("named_window", ["r"], "SELECT sum(o_orderkey) OVER (w ORDER BY o_orderdate) FROM orders WINDOW w AS (PARTITION BY o_custkey)", "orders orders.o_orderkey orders.o_custkey orders.o_orderdate", {"r": "orders.o_orderkey orders.o_custkey orders.o_orderdate"}, "complete"),
    ("scalar", ["n", "m"], "SELECT n_name, (SELECT max(c_name) FROM customer WHERE c_nationkey = n_nationkey) FROM nation", "nation customer nation.n_name customer.c_name customer.c_nationkey nation.n_nationkey", {"n": "nation.n_name", "m": "customer.c_name"}, "complete"),
    ("existing", ["n"], "SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey)", "nation supplier nation.n_name supplier.s_nationkey nation.n_nationkey", {"n": "nation.n_name"}, "complete"),
    ("inside", ["n"], "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)", "nation supplier nation.n_name nation.n_nationkey supplier.s_nationkey", {"n": "nation.n_name"}, "complete"),
    ("cases", ["x"], "SELECT CASE WHEN o_orderdate IS NULL THEN o_orderkey ELSE o_custkey END FROM orders", "orders orders.o_orderdate orders.o_orderkey orders.o_custkey", {"x": "orders.o_orderdate orders.o_orderkey orders.o_custkey"}, "complete"),
    ("grouped", ["n", "c"], "SELECT c_nationkey AS n, count(DISTINCT c_name) AS c FROM customer GROUP BY n HAVING count(*) > 1 ORDER BY c DESC", "customer customer.c_nationkey customer.c_name", {"n": "customer.c_nationkey", "c": "customer.c_name"}, "complete"),
    ("cast_", ["x", "y"], "SELECT CAST(o_orderkey AS numeric(10, 2)), o_orderdate::text FROM orders LIMIT 5", "orders orders.o_orderkey orders.o_orderdate", {"x": "orders.o_orderkey", "y": "orders.o_orderdate"}, "complete"),
    ("left_joined", ["k"], "SELECT l.l_orderkey FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey AND o.o_custkey > 0", "lineitem orders lineitem.l_orderkey orders.o_orderkey orders.o_custkey", {"k": "lineitem.l_orderkey"}, "complete"),
    ("nested_join", ["n"], "SELECT n_name FROM (nation JOIN region ON n_regionkey = r_regionkey) CROSS JOIN part", "nation region part nation.n_name nation.n_regionkey region.r_regionkey", {"n": "nation.n_name"}, "complete"),
    ("using_", ["id"], "SELECT id FROM users JOIN regions USING (id)", "users regions users.id regions.id", {"id": "users.id regions.id"}, "complete"),
    ("using_left", ["id"], "SELECT id FROM users LEFT JOIN regions USING (id)", "users regions users.id regions.id", {"id": "users.id"}, "complete"),
    ("natural_", ["id"], "SELECT id FROM users NATURAL JOIN regions", "users regions users.id regions.id", {"id": "users.id regions.id"}, "complete"),
    ("lateral_", ["n", "c"], "SELECT n.n_name, q.c FROM nation n CROSS JOIN LATERAL (SELECT c_name AS c FROM customer WHERE c_nationkey = n.n_nationkey) q", "nation customer nation.n_name customer.c_name customer.c_nationkey nation.n_nationkey", {"n": "nation.n_name", "c": "customer.c_name"}, "complete"),
    ("distinct_on", ["d"], "SELECT DISTINCT ON (o_custkey) o_orderdate FROM orders ORDER BY o_custkey", "orders orders.o_orderdate orders.o_custkey", {"d": "orders.o_orderdate"}, "complete"),
    ("valued", ["v"], "SELECT column1 FROM (VALUES (1), (2)) AS t", "", {}, "complete"),
    ("qualified", ["n"], "SELECT main.nation.n_name FROM main.nation", "nation nation.n_name", {"n": "nation.n_name"}, "complete"),
    ("missing_table", ["x"], "SELECT a FROM nowhere", "", {}, "partial"),
    ("ambiguous", ["x"], "SELECT id FROM users, regions", "users regions", {}, "partial"),
    ("missing_column", ["x"], "SELECT nothing FROM nation", "nation", {}, "partial"),
    ("too_wide", ["x"], "SELECT n_name, n_nationkey FROM nation", "nation nation.n_name nation.n_nationkey", {}, "partial"),
    ("broken", ["x"], "SELECT FROM WHERE (", "", {}, "unsupported"),
    ("other_base", ["x"], "SELECT n_name FROM elsewhere.main.nation", "", {}, "partial"),
]

# routines: (name, language, body, reads, writes, calls, derives, state)
ROUTINES: list[tuple[str, str, str, str, str, str, dict[str, str], str]] = [
    ("fill", "sql", "INSERT INTO users (id) SELECT c_custkey FROM customer WHERE c_nationkey > 1", "customer customer.c_custkey customer.c_nationkey", "users users.id", "", {"users.id": "customer.c_custkey"}, "complete"),
    ("set_names", "sql", "UPDATE nation SET n_name = r.r_name FROM region r WHERE n_regionkey = r.r_regionkey", "region region.r_name nation.n_regionkey region.r_regionkey", "nation nation.n_name", "", {"nation.n_name": "region.r_name"}, "complete"),
    ("merged", "sql", "MERGE INTO regions t USING users s ON t.id = s.id WHEN NOT MATCHED THEN INSERT (id) VALUES (s.id)", "users regions.id users.id", "regions regions.id", "", {"regions.id": "users.id"}, "complete"),
    ("purge", "sql", "DELETE FROM events WHERE user_id IN (SELECT id FROM users); TRUNCATE users", "users events.user_id users.id", "events users", "", {}, "complete"),
    ("bump", "sql", "UPDATE part SET p_name = p_name || '!'", "part.p_name", "part part.p_name", "", {}, "partial"),
    ("caller", "plpgsql", "BEGIN PERFORM fill(); IF (SELECT count(*) FROM part) > 0 THEN DELETE FROM events; END IF; END", "part", "events", "fill", {}, "partial"),
    ("dynamic", "plpgsql", "DECLARE q text := 'DELETE FROM ' || 'events'; BEGIN EXECUTE q; END", "", "events", "", {}, "complete"),
    ("unknown_dynamic", "plpgsql", "BEGIN EXECUTE 'DELETE FROM ' || quote_ident(t); END", "", "", "", {}, "partial"),
    ("foreign_tongue", "plpython3u", "return 1", "", "", "", {}, "partial"),
]


def document() -> dict:
    raw = star_catalog.document()
    schema = raw["schemas"][0]
    for name, columns, body, *_ in VIEWS:
        schema["objects"].append({"name": name, "kind": "view", "columns": [{"name": c, "data_type": "text", "nullable": True, "ordinal": i, "pk_position": 0} for i, c in enumerate(columns, 1)], "constraints": [], "indexes": [], "triggers": [], "body": body})
    schema["routines"] = [{"name": n, "kind": "function", "language": lang, "body": body} for n, lang, body, *_ in ROUTINES]
    return raw


def expected() -> dict[str, list[tuple]]:
    """reads, writes, calls, derives and states as rows."""
    m = lambda x: f"main.{x}"
    reads = [(m(v[0]), m(t)) for v in VIEWS for t in v[3].split()] + [(m(r[0]), m(t)) for r in ROUTINES for t in r[3].split()]
    writes = [(m(r[0]), m(t)) for r in ROUTINES for t in r[4].split()]
    calls = [(m(r[0]), m(t)) for r in ROUTINES for t in r[5].split()]
    derives = [(m(v[0]), m(f"{v[0]}.{o}"), m(t)) for v in VIEWS for o, s in v[4].items() for t in s.split()] + [(m(r[0]), m(o), m(t)) for r in ROUTINES for o, s in r[6].items() for t in s.split()]
    states = [(m(v[0]), v[5]) for v in VIEWS] + [(m(r[0]), r[7]) for r in ROUTINES]
    return {"reads": reads, "writes": writes, "calls": calls, "derives": derives, "states": states}
