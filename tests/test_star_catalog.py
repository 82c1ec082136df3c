"""The star catalog, a fixed document with flaws on purpose: lint, graph, inferred keys and differences against SQL over its own lists."""

from __future__ import annotations

import duckdb
import pytest

from plexus.operators import change, checks, lint
from plexus.plans import build as builder
from plexus.plans import star_catalog
from plexus.sources import document

_META = star_catalog.sql_tables()
_M = f"""WITH cols AS (SELECT * FROM {_META["cols"]}), fks AS (SELECT * FROM {_META["fks"]}), idx AS (SELECT * FROM {_META["idx"]}),
pk AS (SELECT table_id, list(column_id ORDER BY pk) AS pk FROM cols WHERE pk > 0 GROUP BY table_id),
typed AS (SELECT column_id, CASE lower(trim(data_type)) WHEN 'bigserial' THEN 'bigint' ELSE lower(trim(data_type)) END AS ty FROM cols)"""


@pytest.fixture(scope="module")
def star(spark):
    return builder.build(document.from_value(spark, star_catalog.document())).saved()


@pytest.fixture(scope="module")
def both(spark):
    return document.from_value(spark, star_catalog.document()), document.from_value(spark, star_catalog.changed_document())


CASES = {
    "lint_fk_prefix": (lambda star, both: lint.fk_index_prefix(star), f"""{_M}, j AS (
  SELECT f.fk_id, f.table_id, f.cols, coalesce(bool_or(i.whole AND NOT i.filtered AND i.cols[1:len(f.cols)] = f.cols), false) AS ok, coalesce(bool_or(NOT i.whole), false) AS open_
  FROM fks AS f LEFT JOIN idx AS i ON i.table_id = f.table_id GROUP BY f.fk_id, f.table_id, f.cols)
SELECT 'fk-index-prefix' AS rule, CASE WHEN open_ OR pk IS NULL THEN 'unverified' ELSE 'confirmed' END AS status, false AS advisory, fk_id AS subject, j.table_id, array_to_string(cols, '|') AS columns,
  CASE WHEN open_ OR pk IS NULL THEN 'inventory-incomplete' ELSE 'no-index-prefix' END AS code,
  CASE WHEN open_ OR pk IS NULL THEN 'index inventory is incomplete' ELSE 'no index begins with the foreign key''s columns' END AS message
FROM j LEFT JOIN pk ON pk.table_id = j.table_id WHERE NOT ok AND NOT coalesce(pk[1:len(cols)] = cols, false)"""),
    "lint_fk_types": (lambda star, both: lint.fk_type_mismatch(star), f"""{_M}, f AS (SELECT fk_id, fks.table_id, cols, CASE WHEN len(far) > 0 THEN far ELSE pk END AS far FROM fks LEFT JOIN pk ON pk.table_id = target_id),
p AS (SELECT fk_id, table_id, unnest(cols) AS a, unnest(far) AS b FROM f)
SELECT 'fk-type-mismatch' AS rule, 'confirmed' AS status, false AS advisory, fk_id AS subject, table_id, a || '|' || b AS columns, 'types-differ' AS code, x.ty || ' vs ' || y.ty AS message
FROM p JOIN typed AS x ON x.column_id = a JOIN typed AS y ON y.column_id = b WHERE x.ty <> y.ty"""),
    "lint_missing_pk": (lambda star, both: lint.missing_primary_key(star), f"""{_M} SELECT 'table-without-primary-key' AS rule, 'confirmed' AS status, true AS advisory, table_id AS subject, table_id, '' AS columns, 'no-primary-key' AS code, 'the table has no primary key' AS message
FROM (SELECT DISTINCT table_id FROM cols) WHERE table_id NOT IN (SELECT table_id FROM pk)"""),
    "lint_duplicate_index": (lambda star, both: lint.duplicate_index(star), f"""{_M} SELECT 'duplicate-index' AS rule, 'unverified' AS status, true AS advisory, b.index_id AS subject, b.table_id, array_to_string(b.cols, '|') AS columns, 'same-columns' AS code, 'same columns as ' || min(a.index_id) AS message
FROM idx AS a JOIN idx AS b ON a.table_id = b.table_id AND a.cols = b.cols AND a.uniq = b.uniq AND a.index_id < b.index_id WHERE a.whole AND b.whole AND NOT a.filtered AND NOT b.filtered GROUP BY b.index_id, b.table_id, b.cols"""),
    "document_graph": (lambda star, both: checks.summary(star), f"""{_M} SELECT 'vertex' AS part, 'column' AS kind, (SELECT count(*) FROM cols) + 1 AS n UNION ALL SELECT 'vertex', 'table', (SELECT count(DISTINCT table_id) FROM cols) UNION ALL SELECT 'vertex', 'view', 1 UNION ALL SELECT 'vertex', 'schema', 1
UNION ALL SELECT 'vertex', 'constraint', (SELECT count(*) FROM fks) UNION ALL SELECT 'vertex', 'index', (SELECT count(*) FROM idx)
UNION ALL SELECT 'edge', 'contains', (SELECT count(*) FROM cols) + 1 + (SELECT count(DISTINCT table_id) FROM cols) + 1 + (SELECT count(*) FROM fks) + (SELECT count(*) FROM idx)
UNION ALL SELECT 'edge', 'references', (SELECT count(*) FROM (SELECT DISTINCT table_id, target_id FROM fks)) + (SELECT count(*) FROM fks WHERE len(far) > 0)"""),
    "inferred_fk": (lambda star, both: builder.inferred_keys(star)[0], f"""{_M} SELECT table_id AS src, 'main.' || CASE name WHEN 'region_id' THEN 'regions' ELSE 'users' END AS dst, 'inferred' AS kind FROM cols WHERE name IN ('region_id', 'user_id')"""),
    "diff_documents": (lambda star, both: change.diff_documents(*both), """SELECT * FROM (VALUES
  ('main.part', 'object', 'removed', ''), ('main.part.p_partkey', 'column', 'removed', ''), ('main.part.p_name', 'column', 'removed', ''), ('main.part.part_name', 'index', 'removed', ''),
  ('main.archive', 'object', 'added', ''), ('main.archive.id', 'column', 'added', ''), ('main.nation.n_name', 'column', 'changed', 'data_type'), ('main.customer.region_id', 'column', 'removed', ''),
  ('main.orders.o_status', 'column', 'added', ''), ('main.orders.o_note', 'column', 'added', ''), ('main.supplier.s_name', 'column', 'changed', 'nullable'), ('main.region.region_name', 'index', 'added', ''),
  ('main.order_names', 'definition', 'changed', 'body'), ('main.lineitem.lineitem_supplier', 'constraint', 'removed', '')) AS t(id, part, change, detail)"""),
    "change_kinds": (lambda star, both: change.changes(*both).drop("evidence"), """SELECT * FROM (VALUES
  ('main.part', 'object-removed', 'main.part', true), ('main.archive', 'object-added', 'main.archive', false), ('main.nation.n_name', 'column-type-changed', 'main.nation', true),
  ('main.customer.region_id', 'column-removed', 'main.customer', true), ('main.orders.o_status', 'required-column-added', 'main.orders', true), ('main.orders.o_note', 'column-added', 'main.orders', false),
  ('main.supplier.s_name', 'column-nullability-changed', 'main.supplier', true), ('main.region.region_name', 'unique-index-added', 'main.region', true), ('main.order_names', 'definition-changed', 'main.order_names', true),
  ('main.lineitem', 'constraints-changed', 'main.lineitem', true)) AS t(id, kind, object_id, needs_review)"""),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_star_catalog_equals_its_sql(star, both, name):
    ask, sql = CASES[name]
    df = ask(star, both)
    columns = sorted(df.columns)
    cursor = duckdb.connect().execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(repr, (tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall())))
