"""Documents, building graphs, lint, changes, merges, sources and sinks."""

from __future__ import annotations

import copy
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from plexus.operators import change, lint, merge
from plexus.plans import star_catalog
from plexus.plans.build import build, inferred_keys
from plexus.plans.sqlbind.enrich import enrich
from plexus.sinks import graphjson, render
from plexus.sources import document, imports, jdbc, oracle_packages, sqlite

RAW = {
    "version": 2, "dialect": "postgresql", "producer": {"name": "t"}, "required_features": ["catalog-dependencies-v1", "package-members-v1", "usage-v1"],
    "context": {"source_id": "src", "database": "db", "catalog_complete": True}, "limitations": ["said before"],
    "schemas": [{"name": "s", "objects": [
        {"name": "t", "kind": "table", "columns": [{"name": "id", "data_type": "int", "nullable": False, "ordinal": 1, "pk_position": 1}, {"name": "a.b", "data_type": "text", "nullable": True, "ordinal": 2, "pk_position": 0}],
         "constraints": [{"name": "id", "kind": "unique", "columns": ["id"]}, {"name": "f", "kind": "foreign-key", "columns": ["id"], "referenced": {"table": "gone", "columns": ["x"]}}],
         "indexes": [{"name": "i", "unique": True, "columns": ["id"], "definition_complete": True, "usage": {"reads": 0, "writes": 0}}], "triggers": [{"name": "g", "body": "x"}], "usage": {"reads": 5, "writes": 1, "scans": 2, "since": "2024"}},
        {"name": "v", "kind": "view", "columns": [], "constraints": [], "indexes": [], "triggers": [], "body": "SELECT 1"}],
      "routines": [{"name": "p", "kind": "package"}, {"name": "m", "kind": "procedure", "member_of": "p", "signature": "int"}, {"name": "lost", "kind": "function", "member_of": "q"}, {"name": "f", "kind": "function", "signature": "a, b"}]}],
    "dependencies": [{"source": {"schema": "s", "name": "v"}, "target": {"schema": "s", "name": "t"}, "catalog": "c", "dependency_type": "n"}, {"source": {"schema": "s", "name": "v"}, "target": {"schema": "s", "name": "t", "database": "other"}, "catalog": "c", "dependency_type": "n"}, {"source": {"schema": "s", "name": "v"}, "target": {"schema": "s", "name": "none"}, "catalog": "c", "dependency_type": "n"}],
}


@pytest.fixture(scope="module")
def doc(spark):
    return document.from_value(spark, RAW)


@pytest.fixture(scope="module")
def built(doc):
    return build(doc).saved()


def test_header_rules():
    ok = {"version": 2, "producer": {"name": "x"}, "required_features": []}
    document.check_header(ok)
    for bad in ({"version": 3}, {"version": True}, {"version": 2.5}, {**ok, "reader": "x"}, {**ok, "producer": {"name": " "}}, {"version": 2, "producer": {"name": "x"}}, {**ok, "required_features": ["new-v9"]}):
        with pytest.raises(document.DocumentError):
            document.check_header(bad)
    with pytest.raises(document.DocumentError):
        document.check_header(ok, {"usage-v1"})


def test_unknown_fields_and_repeats_are_noted(spark):
    raw = copy.deepcopy(RAW)
    raw["schemas"][0]["objects"][0]["owner"] = "me"
    raw["schemas"][0]["objects"][0]["columns"].append(raw["schemas"][0]["objects"][0]["columns"][0])
    notes = document.from_value(spark, raw).limitations
    assert "ignored unknown field: schemas[].objects[].owner" in notes and "repeated column records: 1" in notes and "said before" in notes


def test_structure_of_the_graph(built):
    v = {r.id: r.kind for r in built.vertices.collect()}
    assert v == {"s": "schema", "s.t": "table", "s.v": "view", "s.t.id": "column", "s.t.a%2Eb": "column", "s.t.id@constraint": "constraint", "s.t.f": "constraint", "s.t.i": "index", "s.t.g": "trigger", "s.p": "package", "s.p.m(int)": "procedure", "s.lost": "function", "s.f(a, b)": "function"}
    e = {tuple(r) for r in built.edges.collect()}
    assert {("s", "s.t", "contains"), ("s.t", "s.t.id@constraint", "contains"), ("s.p", "s.p.m(int)", "contains"), ("s.t.g", "s.t", "fires"), ("s.v", "s.t", "depends-on")} <= e
    assert not [x for x in e if x[2] == "references"]
    notes = " ".join(r.note for r in built.limitations.collect())
    for part in ("said before", "member id collision: s.t.id", "referenced table was not collected: s.gone", "package of a routine was not collected: s.q.lost", "another database", "not one vertex"):
        assert part in notes
    usage = {r.id: (r.reads, r.scans, r.since) for r in built.usage.collect()}
    assert usage == {"s.t": (5, 2, "2024"), "s.t.i": (0, None, None)}


@pytest.mark.parametrize("version", [2])
def test_documents_come_back(spark, doc, tmp_path, version):
    value = document.to_value(doc, version)
    again = document.from_value(spark, value)
    path = f"{tmp_path}/d.ndjson"
    graphjson.publish(path, (r.value + "\n" for r in document.ndjson_lines(doc, version).orderBy("n").toLocalIterator()))
    streamed = document.read_ndjson(spark, path)
    for other in (again, streamed):
        assert other.header == doc.header and set(other.limitations) == set(doc.limitations)
        for t in document.TABLES:
            assert sorted(map(str, getattr(other, t).collect())) == sorted(map(str, getattr(doc, t).collect())), t
    with open(f"{tmp_path}/d.json", "w") as f:
        json.dump(value, f, indent=1)
    assert document.read_json(spark, f"{tmp_path}/d.json").header == doc.header


def test_a_cut_stream_is_refused(spark, tmp_path):
    head = {"type": "document", "version": 2, "dialect": "x", "producer": {"name": "t"}, "required_features": []}
    for lines in ([head], [{"type": "schema", "name": "s"}], [head, {"type": "what"}, {"type": "limitations", "data": []}]):
        (tmp_path / "x.ndjson").write_text("\n".join(map(json.dumps, lines)))
        with pytest.raises(document.DocumentError):
            document.read_ndjson(spark, f"{tmp_path}/x.ndjson")
    rows = [head, {"type": "schema", "name": "s"}, {"type": "object", "data": {"name": "t", "kind": "table", "columns": []}}, {"type": "schema", "name": "q"}, {"type": "object", "data": {"name": "u", "kind": "table"}}, {"type": "limitations", "data": ["n"]}]
    (tmp_path / "y.ndjson").write_text("\n".join(map(json.dumps, rows)))
    got = document.read_ndjson(spark, f"{tmp_path}/y.ndjson")
    assert {tuple(r)[:2] for r in got.objects.collect()} == {("s", "t"), ("q", "u")} and got.limitations == ("n",)


def test_annotate_narrows_and_says_what_is_missing(doc):
    got = document.annotate(doc, "here", ["s", "absent"])
    assert got.header["source_id"] == "here" and not got.complete and "requested schema was not collected: absent" in got.limitations


def test_graph_json_keeps_everything(spark, built, tmp_path):
    graphjson.write(built, f"{tmp_path}/g.json")
    first = (tmp_path / "g.json").read_bytes()
    assert first == "".join(graphjson.chunks(built)).encode()
    graphjson.write(built, f"file://{tmp_path}/g.json")
    assert [p.name for p in tmp_path.iterdir()] == ["g.json"]
    assert (tmp_path / "g.json").read_bytes() == first
    back = graphjson.read(spark, f"{tmp_path}/g.json")
    for t in ("vertices", "edges", "evidence", "usage", "columns", "indexes", "fks"):
        assert sorted(map(str, (tuple(r) for r in getattr(back, t).select(*getattr(built, t).columns).collect()))) == sorted(map(str, (tuple(r) for r in getattr(built, t).distinct().collect()))), t
    raw = json.loads(first)
    assert back.complete and "since" not in next(u for u in raw["usage"] if u["id"] == "s.t.i")
    raw["vertices"].append({"id": "z", "kind": "galaxy", "name": "z", "schema": "s"})
    raw["version"] = 1
    (tmp_path / "h.json").write_text(json.dumps(raw))
    assert "vertices of unknown kinds: 1" in {r.note for r in graphjson.read(spark, f"{tmp_path}/h.json").limitations.collect()}
    assert render.mermaid(built).startswith("flowchart LR\n  n0[") and '"s.t.g" -> "s.t" [label="fires"]' in render.dot(built) and "<script>" in render.page(built)


def test_lint_on_an_incomplete_catalog(spark):
    g = build(document.from_value(spark, star_catalog.document(complete=False))).saved()
    rows = lint.lint(g).collect()
    status = {(r.rule, r.subject): r.status for r in rows}
    assert status["fk-index-prefix", "main.customer.customer_nation"] == "unverified"
    assert status["table-without-primary-key", "main.events"] == "unverified"
    s = lint.lint_summary(g).first()
    assert s.complete is False and s.findings == len(rows)
    assert json.loads(render.sarif(lint.lint(g)))["version"] == "2.1.0"


def test_merge_keeps_namespaces_apart(spark, built):
    with pytest.raises(ValueError):
        merge.merge_graphs([("a", built), ("a", built)])
    m = merge.merge_graphs([("b", built), ("a", built)])
    assert m.vertices.count() == 2 * built.vertices.count() and m.complete
    assert merge.split_namespace("a::s.t") == ("a", "s.t") and merge.split_namespace("s.t") == (None, "s.t")
    facts = spark.createDataFrame([("a::s.v", "B", "s", "t"), ("a::s.v", "B", "s", "none"), ("a::s.v", "C", "s", "t")], "source string, database string, schema string, name string")
    edges, notes = merge.cross_database_edges(m, facts, spark.createDataFrame([("b", "B")], "label string, database string"))
    assert [tuple(r) for r in edges.collect()] == [("a::s.v", "b::s.t", "depends-on")] and notes.count() == 2


def test_policy_decides_with_waivers_and_baseline(spark):
    rows = [("a", "object-removed", "a", True, ["x"]), ("b", "column-added", "b", False, []), ("c", "column-type-changed", "c", True, ['{"é":1}'])]
    found = change.with_fingerprints(spark.createDataFrame(rows, "id string, kind string, object_id string, needs_review boolean, evidence array<string>"), "old", "new")
    f = {r.id: r.fingerprint for r in found.collect()}
    assert f["a"] == change.fingerprint({"id": "a", "kind": "object-removed", "evidence": ["x"]}, "old", "new")
    assert f["c"] == change.fingerprint({"id": "c", "kind": "column-type-changed", "evidence": ['{"é":1}']}, "old", "new")
    policy = change.Policy("high", {"column-type-changed": "critical"}, {f["c"]: ("known", "2024-06-01")}, as_of="2024-01-01")
    got = {r.id: (r.severity, r.state, r.waived, r.fails) for r in change.evaluate(found, policy).collect()}
    assert got == {"a": ("high", "no-baseline", False, True), "b": ("low", "no-baseline", False, False), "c": ("critical", "no-baseline", True, False)}
    late = change.Policy("high", {}, {f["c"]: ("known", "2024-06-01")}, frozenset([f["a"]]), "2024-07-01")
    got = {r.id: (r.state, r.fails) for r in change.evaluate(found, late).collect()}
    assert got == {"a": ("existing", False), "b": ("new", False), "c": ("new", True)}
    with pytest.raises(ValueError):
        change.Policy("high", {"no-such-change": "low"})
    assert change.comparison_notes({"dialect": "a"}, {"dialect": "b"}) == ["dialect differs: 'a' and 'b'"]


def _with(spark, type_, constraints=(), routines=()):
    column = {"name": "c", "data_type": type_, "nullable": True, "ordinal": 1}
    table = {"name": "t", "kind": "table", "columns": [column], "constraints": [{"kind": "foreign-key", "columns": [c], "referenced": {"schema": "main", "table": r, "columns": ["id"]}} for c, r in constraints]}
    return document.from_value(spark, {"version": 2, "producer": {"name": "test"}, "required_features": [], "dialect": "sqlite", "schemas": [{"name": "main", "objects": [table], "routines": [{"name": n, "kind": "function", "language": "sql", "body": "select 1"} for n in routines]}]})


def test_unnamed_parts_are_themselves_again(spark):
    one = _with(spark, "int", [("c", "u"), ("c", "v")], ["f"])
    assert change.diff_documents(one, one).count() == 0 and change.changes(one, one).count() == 0
    other = _with(spark, "int", [("c", "u"), ("c", "w")], ["f"])
    got = sorted((r.id, r.change) for r in change.diff_documents(one, other).collect())
    assert got == [("main.t.foreign-key[c]->main.v[id]", "removed"), ("main.t.foreign-key[c]->main.w[id]", "added")]
    assert [(r.id, r.kind, r.object_id, len(r.evidence)) for r in change.changes(one, other).collect()] == [("main.t", "constraints-changed", "main.t", 2)]


def test_another_type_is_another_fingerprint(spark):
    old = _with(spark, "int")
    prints = [change.with_fingerprints(change.changes(old, _with(spark, t)), "a", "b").first().fingerprint for t in ("bigint", "text", "bigint")]
    assert prints[0] == prints[2] != prints[1]


def test_sqlite_files(spark, tmp_path):
    path = f"{tmp_path}/x.db"
    db = sqlite3.connect(path)
    db.executescript("CREATE TABLE p(id INTEGER PRIMARY KEY, n TEXT); CREATE TABLE c(id INTEGER PRIMARY KEY, p_id INT REFERENCES p(id), q_id INT, e TEXT DEFAULT 'x'); CREATE INDEX i ON c(p_id) WHERE p_id > 1; CREATE VIEW v AS SELECT n FROM p; CREATE TRIGGER g AFTER INSERT ON c BEGIN UPDATE p SET n = new.e; END; CREATE TABLE qs(id INT);")
    db.close()
    doc = sqlite.read(spark, path)
    g = build(doc).saved()
    e = {tuple(r) for r in g.edges.collect()}
    assert {("main.c", "main.p", "references"), ("main.c.p_id", "main.p.id", "references"), ("main.c.g", "main.c", "fires")} <= e
    assert g.indexes.where("name = 'i'").first().filtered is True
    edges, ambiguous = inferred_keys(g)
    assert [tuple(r) for r in edges.collect()] == [("main.c", "main.qs", "inferred")] and ambiguous.count() == 0
    from plexus.plans.sqlbind.enrich import enrich

    e = {tuple(r) for r in enrich(doc, g).edges.collect()}
    assert {("main.v", "main.p.n", "reads"), ("main.v.n", "main.p.n", "derives-from"), ("main.c.g", "main.p", "writes"), ("main.p.n", "main.c.e", "derives-from")} <= e


def test_server_catalogs_by_query(spark):
    answers = {
        "'S') AND n.nspname": ([("public", "t", "table"), ("public", "v", "view"), ("public", "m", "materialized-view"), ("public", "s", "sequence")], "schema_name string, name string, kind string"),
        "pg_attrdef": ([("public", "t", "id", "int", "NO", None, 1), ("public", "v", "id", "int", "YES", None, 1)], "schema_name string, object string, name string, data_type string, is_nullable string, dflt string, ordinal long"),
        "table_constraints": ([("public", "t", "id", 1)], "schema_name string, object string, name string, pk_position long"),
        "pg_get_viewdef": ([("public", "v", "SELECT id FROM t"), ("public", "m", "SELECT id FROM v")], "schema_name string, name string, body string"),
        "pg_constraint": ([("public", "t", "f", "id", 1, "public", "t", "id")], "schema_name string, object string, name string, own string, pos long, ref_schema string, ref_table string, far string"),
        "pg_index x": ([("public", "t", "i", True, None, 1, "id")], "schema_name string, object string, name string, uniq boolean, predicate string, pos long, own string"),
        "pg_trigger": ([], "schema_name string, object string, name string, body string"),
        "pg_proc": ([], "schema_name string, name string, kind string, language string, body string, signature string"),
        "track_counts": ([("off",)], "value string"),
        "pg_depend": ([("public", "v", "public", "t", "pg_depend", "n")], "s_schema string, s_name string, t_schema string, t_name string, catalog string, dependency_type string"),
    }

    def reader(query):
        rows, schema = next(v for k, v in answers.items() if k in query)
        return spark.createDataFrame(rows, schema)

    doc = jdbc.read(spark, "postgres", reader, ["public"], usage=True, dependencies=True)
    g = build(doc)
    e = {tuple(r) for r in g.edges.collect()}
    assert {("public.t", "public.t", "references"), ("public.v", "public.t", "depends-on")} <= e and g.usage.count() == 0
    assert "the server does not count usage; none is reported" in doc.limitations
    assert {r.id: r.kind for r in g.vertices.collect()}["public.m"] == "materialized-view" and {r.id: r.kind for r in g.vertices.collect()}["public.s"] == "sequence"
    assert {("public.m", "public.v", "reads"), ("public.v", "public.t", "reads")} <= {tuple(r) for r in enrich(doc, g).edges.collect()}
    assert jdbc.redacted("x postgres://me:pw@h/d?password=q&x=1") == "x postgres://***@h/d?password=***&x=1"
    assert jdbc.transport_note("jdbc:postgresql://db.example/x") == ["connection-not-encrypted: db.example"] and not jdbc.transport_note("jdbc:postgresql://localhost/x")
    with pytest.raises(ValueError):
        jdbc.scheme_of("mongodb://x")


_OBJECTS = "schema_name string, name string, kind string"
_COLUMNS = "schema_name string, object string, name string, data_type string, is_nullable string, dflt string, ordinal long"
_KEYS = "schema_name string, object string, name string, own string, pos long, ref_schema string, ref_table string, far string"
_INDEXES = "schema_name string, object string, name string, uniq boolean, predicate string, pos long, own string"
_BODIES = "schema_name string, name string, body string"


def _catalog_of(spark, dialect, answers, schema):
    def reader(query):
        rows, shape = next(v for k, v in answers.items() if k in query)
        return spark.createDataFrame(rows, shape)

    doc = jdbc.read(spark, dialect, reader, [schema], dependencies=True)
    g = build(doc)
    return doc, g, enrich(doc, g)


def test_sql_server_catalog(spark):
    doc, g, rich = _catalog_of(spark, "sqlserver", {
        "FROM sys.objects o JOIN sys.schemas s ON s.schema_id = o.schema_id WHERE o.type IN ('U'": ([("dbo", "t", "table"), ("dbo", "u", "table"), ("dbo", "v", "view"), ("dbo", "q", "sequence")], _OBJECTS),
        "information_schema.columns": ([("dbo", "t", "id", "int", "NO", None, 1), ("dbo", "u", "t_id", "int", "YES", None, 1), ("dbo", "v", "id", "int", "YES", None, 1)], _COLUMNS),
        "information_schema.table_constraints": ([("dbo", "t", "id", 1)], "schema_name string, object string, name string, pk_position long"),
        "o.type = 'V'": ([("dbo", "v", "CREATE VIEW dbo.v AS SELECT id FROM dbo.t")], _BODIES),
        "sys.foreign_keys": ([("dbo", "u", "fk", "t_id", 1, "dbo", "t", "id")], _KEYS),
        "sys.index_columns": ([("dbo", "t", "pk", True, None, 1, "id")], _INDEXES),
        "sys.triggers": ([("dbo", "u", "g", "CREATE TRIGGER dbo.g ON dbo.u AFTER INSERT AS UPDATE dbo.t SET id = 1")], "schema_name string, object string, name string, body string"),
        "'tsql'": ([("dbo", "p", "procedure", "tsql", "CREATE PROCEDURE dbo.p AS SELECT id FROM dbo.v", None)], "schema_name string, name string, kind string, language string, body string, signature string"),
        "sys.sql_expression_dependencies": ([("dbo", "v", "dbo", "t", None, "c", "reference")], "s_schema string, s_name string, t_schema string, t_name string, t_database string, catalog string, dependency_type string"),
    }, "dbo")
    e = {tuple(r) for r in rich.edges.collect()}
    assert {("dbo.u", "dbo.t", "references"), ("dbo.u.t_id", "dbo.t.id", "references"), ("dbo.v", "dbo.t", "depends-on"), ("dbo.v", "dbo.t", "reads"), ("dbo.p", "dbo.v", "reads"), ("dbo.u.g", "dbo.u", "fires"), ("dbo.u.g", "dbo.t", "writes")} <= e
    assert doc.complete and {r.id: r.kind for r in g.vertices.collect()}["dbo.q"] == "sequence"


def test_oracle_catalog(spark):
    doc, g, rich = _catalog_of(spark, "oracle", {
        "FROM all_objects": ([("S", "T", "table"), ("S", "U", "table"), ("S", "V", "view"), ("S", "M", "materialized-view")], _OBJECTS),
        "all_tab_columns": ([("S", "T", "ID", "NUMBER", "N", None, 1), ("S", "U", "T_ID", "NUMBER", "Y", None, 1)], _COLUMNS),
        "c.constraint_type = 'P'": ([("S", "T", "ID", 1)], "schema_name string, object string, name string, pk_position long"),
        "FROM all_views": ([("S", "V", "SELECT ID FROM T")], _BODIES),
        "query AS body": ([("S", "M", "SELECT ID FROM V")], _BODIES),
        "c.constraint_type = 'R'": ([("S", "U", "FK", "T_ID", 1, "S", "T", "ID")], _KEYS),
        "all_ind_columns": ([("S", "T", "PK", True, None, 1, "ID")], _INDEXES),
        "all_triggers": ([], "schema_name string, object string, name string, body string"),
        "all_source": ([("S", "P", "PROCEDURE", 1, "PROCEDURE P AS\n"), ("S", "P", "PROCEDURE", 2, "BEGIN DELETE FROM T; END;"), ("S", "K", "PACKAGE BODY", 1, "PACKAGE BODY K AS\n"), ("S", "K", "PACKAGE BODY", 2, "PROCEDURE A IS BEGIN INSERT INTO U (T_ID) SELECT ID FROM T; END;\n"), ("S", "K", "PACKAGE BODY", 3, "END K;")], "schema_name string, name string, type string, line long, text string"),
        "all_dependencies": ([], "s_schema string, s_name string, t_schema string, t_name string, t_database string, catalog string, dependency_type string"),
    }, "S")
    e = {tuple(r) for r in rich.edges.collect()}
    assert {("S.U", "S.T", "references"), ("S.V", "S.T", "reads"), ("S.M", "S.V", "reads"), ("S.P", "S.T", "writes"), ("S.K", "S.K.A", "contains"), ("S.K.A", "S.U", "writes"), ("S.K.A", "S.T", "reads")} <= {(a.split("(")[0], b.split("(")[0], k) for a, b, k in e}
    assert doc.complete


def test_bodies_are_bound_once(spark, tmp_path):
    def edges(body, cache=f"{tmp_path}/cache", columns=("id",)):
        table = {"name": "t", "kind": "table", "columns": [{"name": c, "data_type": "int", "nullable": True, "ordinal": k} for k, c in enumerate(columns)]}
        views = [{"name": "v", "kind": "view", "columns": [], "body": body}, {"name": "w", "kind": "view", "columns": [], "body": "SELECT id FROM t"}]
        d = document.from_value(spark, {"version": 2, "producer": {"name": "test"}, "required_features": [], "dialect": "sqlite", "schemas": [{"name": "main", "objects": [table, *views], "routines": []}]})
        return {tuple(r) for r in enrich(d, build(d), cache).edges.where("kind <> 'contains'").collect()}

    first = edges("SELECT id FROM t")
    assert first == edges("SELECT id FROM t", None) == edges("SELECT id FROM t")
    # what the cache says is believed, for as long as body and catalog are the same
    (kept,) = (p for p in (tmp_path / "cache").iterdir())
    facts = spark.read.parquet(str(kept))
    facts.withColumn("kind", F.when(F.col("kind") == "reads", "writes").otherwise(F.col("kind"))).write.parquet(f"{tmp_path}/cache/facts-newer")
    assert edges("SELECT id FROM t") == {(a, b, "writes" if k == "reads" else k) for a, b, k in first}
    mixed = edges("SELECT count(*) FROM t")
    assert ("main.v", "main.t", "reads") in mixed and ("main.w", "main.t", "writes") in mixed
    assert edges("SELECT count(*) FROM t", columns=("id", "more")) == edges("SELECT count(*) FROM t", None, ("id", "more"))
    assert len(list((tmp_path / "cache").iterdir())) == 1


def test_only_bodies_that_a_change_touches_are_bound_again(spark, tmp_path):
    marker = []

    def edges(extra=(), more=(), cache=f"{tmp_path}/cache"):
        table = lambda name, columns: {"name": name, "kind": "table", "columns": [{"name": c, "data_type": "int", "nullable": True, "ordinal": k} for k, c in enumerate(columns)]}
        views = [{"name": n, "kind": "view", "columns": [], "body": b} for n, b in (("v", "SELECT id FROM t"), ("w", "SELECT id FROM u"), ("x", "SELECT k FROM later"))]
        objects = [table("t", ["id", *more]), table("u", ["id"]), *views, *(table(n, ["k"]) for n in extra)]
        d = document.from_value(spark, {"version": 2, "producer": {"name": "test"}, "required_features": [], "dialect": "sqlite", "schemas": [{"name": "main", "objects": objects, "routines": []}]})
        return {tuple(r) for r in enrich(d, build(d), cache).edges.where("kind <> 'contains'").collect()}

    def again(**k):
        """Which views are bound: those whose kept facts, which say writes for reads, are not believed."""
        (kept,) = (p for p in (tmp_path / "cache").iterdir())
        facts = spark.read.parquet(str(kept))
        facts.withColumn("kind", F.when(F.col("kind") == "reads", "writes").otherwise(F.col("kind"))).write.parquet(f"{tmp_path}/cache/facts-marked{len(marker)}")
        marker.append(1)
        return {a for a, b, kind in edges(**k) if kind == "reads"}

    first = edges()
    assert first == edges(cache=None) and not {x for x in first if x[0] == "main.x"}
    assert again() == set()
    assert again(extra=("unrelated",)) == set()  # a table that nobody asked for
    assert again(more=("other",)) == {"main.v"}  # a column of a table that is read
    assert again(extra=("later",), more=("other",)) == {"main.x"}  # a name that was missed before


def test_imports(spark, doc, tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "a.sql").write_text("SELECT id FROM t")
    got = imports.sql_directory(spark, doc, f"{tmp_path}/q", "s")
    assert [(r.name, r.source) for r in got.routines.where("kind = 'query'").collect()] == [("query_" + b"a.sql".hex(), "a.sql")]
    manifest = {"nodes": {"model.x": {"resource_type": "model", "schema": "s", "name": "x", "compiled_code": "SELECT 1"}, "model.y": {"resource_type": "model", "schema": "s", "name": "y"}, "test.z": {"resource_type": "test"}}}
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    got = imports.dbt_manifest(spark, doc, f"{tmp_path}/m.json")
    assert got.routines.where("kind = 'query'").count() == 1 and "dbt models without compiled SQL: 1" in got.limitations
    head = {"type": "query-log", "window": {"start": "2024-01-01T00:00:00Z", "end": "2024-01-02T00:00:00Z"}}
    rows = [{"at": "2024-01-01T10:00:00Z", "schema": "s", "sql": "SELECT 1"}, {"at": "2024-01-01T11:00:00Z", "schema": "s", "sql": "SELECT 1"}]
    (tmp_path / "l.jsonl").write_text("\n".join(map(json.dumps, [head, *rows])))
    got = imports.query_log(spark, doc, f"{tmp_path}/l.jsonl")
    assert got.routines.where("kind = 'query'").count() == 1 and got.usage.count() == doc.usage.count()
    for bad in ([head, {**rows[0], "at": "2024-01-03T00:00:00Z"}], [head, {**rows[0], "at": "yesterday"}], [head, head, rows[0]], [rows[0]]):
        (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, bad)))
        with pytest.raises(document.DocumentError):
            imports.query_log(spark, doc, f"{tmp_path}/b.jsonl")
    with pytest.raises(document.DocumentError):
        imports.sql_directory(spark, doc, f"{tmp_path}/q", "s", imports.Limits(sql=3))
    facts = {r.id: (r.kind, r.contract) for r in imports.relation_facts(doc, "src").collect()}
    assert facts["s.t"][1] == "id:int:not null, a.b:text:null" and facts["s.t.id"][0] == "column"


def test_defaults_and_missing_bodies(spark):
    from plexus.plans.sqlbind.enrich import enrich

    raw = {"version": 1, "dialect": "postgres", "reader": "t", "limitations": [], "schemas": [{"name": "s", "objects": [{"name": "t", "kind": "table", "columns": [{"name": "a", "data_type": "int", "nullable": True, "ordinal": 1, "pk_position": 0, "default": "f(now())"}, {"name": "b", "data_type": "int", "nullable": True, "ordinal": 2, "pk_position": 0, "default": "'open"}], "constraints": [], "indexes": [], "triggers": [{"name": "g"}]}, {"name": "v", "kind": "view", "columns": []}], "routines": [{"name": "f", "kind": "function", "language": "c"}]}]}
    doc = document.from_value(spark, raw)
    g = enrich(doc, build(doc))
    assert ("s.t.a", "s.f", "depends-on") in {tuple(r) for r in g.edges.collect()}
    assert {r.id for r in g.diagnostics.where("code = 'SG_BODY_UNAVAILABLE'").collect()} == {"s.v", "s.t.g", "s.f"} == {r.id for r in g.analysis.where("state = 'unsupported'").collect()}
    assert any("default of s.t.b was not read" in r.note for r in g.limitations.collect())


def test_package_bodies():
    found, notes = oracle_packages.members("PACKAGE BODY p IS PROCEDURE a(x IN NUMBER, y VARCHAR2 := 'q;') IS BEGIN IF x > 1 THEN DELETE FROM t; END IF; END a; FUNCTION b RETURN NUMBER; FUNCTION b RETURN NUMBER IS PROCEDURE c IS BEGIN NULL; END; BEGIN LOOP EXIT; END LOOP; RETURN CASE WHEN 1=1 THEN 2 END; END; PROCEDURE broken IS BEGIN NULL;")
    assert [(m.name, m.kind, m.signature) for m in found] == [("a", "procedure", "number,varchar2"), ("b", "function", "")]
    assert len(notes) == 1 and "broken" in notes[0]
