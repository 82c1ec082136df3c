"""Commands end to end on a small database, their exit codes, the server, and the streaming extension."""

from __future__ import annotations

import io
import json
import sqlite3
from pathlib import Path

import pytest

from plexus import cli, policyfiles, server
from plexus.operators import lineage
from plexus.plans.bundle import GraphBundle

SCRIPT = """
CREATE TABLE customers(id INTEGER PRIMARY KEY, name TEXT);
CREATE TABLE products(id INTEGER PRIMARY KEY);
CREATE TABLE orders(id INTEGER PRIMARY KEY, customer_id INT REFERENCES customers(id));
CREATE TABLE order_items(order_id INT REFERENCES orders(id), product_id INT REFERENCES products(id));
CREATE TABLE a(id INTEGER PRIMARY KEY, b_id INT REFERENCES b(id));
CREATE TABLE b(id INTEGER PRIMARY KEY, a_id INT REFERENCES a(id));
CREATE TABLE loop_self(id INTEGER PRIMARY KEY, up INT REFERENCES loop_self(id));
CREATE TABLE shipments(id INTEGER PRIMARY KEY, customer_id INT);
CREATE VIEW order_totals AS SELECT c.name, count(*) AS n FROM orders o JOIN customers c ON c.id = o.customer_id GROUP BY c.name;
CREATE TRIGGER trg_touch AFTER INSERT ON orders BEGIN UPDATE customers SET name = name WHERE id = NEW.customer_id; END;
"""


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("cli")
    db = sqlite3.connect(f"{at}/x.db")
    db.executescript(SCRIPT)
    db.close()
    assert cli.main(["scan", f"sqlite:{at}/x.db", "--output", f"{at}/g.json", "--infer", "--emit-document", f"{at}/d.json"]) == 0
    return at


def _out(capsys, *args: str) -> tuple[int, dict]:
    code = cli.main(list(args))
    text = capsys.readouterr().out
    return code, json.loads(text) if text.startswith("{") else text


def test_commands(graph, capsys):
    g = f"{graph}/g.json"
    code, out = _out(capsys, "cycles", g)
    assert code == 0 and [(r["members"], r["self_loop"]) for r in out["rows"]] == [("main.a|main.b", False), ("main.loop_self", True)]
    _, out = _out(capsys, "query", g, "orders")
    assert {"main.customers"} == {n["id"] for n in out["dependencies"]} and "main.order_items" in {n["id"] for n in out["dependents"]}
    _, out = _out(capsys, "impact", g, "main.customers")
    ids = {n["id"] for n in out["impacted"]}
    assert {"main.order_totals", "main.order_items"} <= ids and "main.shipments" not in ids and out["complete"]
    code, out = _out(capsys, "dead", g, "--strict")
    assert code == 1 and [r["id"] for r in out["rows"]] == ["main.order_totals"]
    code, out = _out(capsys, "impact", g, "id")
    assert code == 1 and out["found"] is False and len(out["candidates"]) > 3
    _, out = _out(capsys, "path", g, "main.order_items", "main.customers")
    assert [p["path"] for p in out["paths"]] == [["main.order_items", "main.orders", "main.customers"]]
    code, out = _out(capsys, "language-traversal", g, "main.orders", "main.nothing", "--dependents")
    assert code == 64 and "main.order_totals" in {r["id"] for r in out["reached"]}
    _, out = _out(capsys, "search", g, "order*", "--counts")
    assert out["total"] == 4
    _, out = _out(capsys, "lineage", g)
    assert {r["job"]: r["outputs"] for r in out["rows"]}["main.order_totals"] == "main.order_totals"
    code, out = _out(capsys, "lint", g, "--strict")
    assert code == 0 or out["summary"]["blocking"] > 0
    for command in ("unused", "stats", "diagnostics"):
        assert _out(capsys, command, g)[0] == 0
    _, out = _out(capsys, "explain", g, "main.shipments")
    assert ("main.shipments", "main.customers", "inferred") in {(r["src"], r["dst"], r["kind"]) for r in out["rows"]}
    assert "flowchart" in _out(capsys, "graph", g, "--format", "mermaid", "--level", "object")[1]
    Path(f"{graph}/rules.toml").write_text('[[rules]]\nname = "no items"\nfrom = "main.order_items"\nto = "main.o*"\n')
    code, out = _out(capsys, "rules", g, f"{graph}/rules.toml", "--level", "object", "--strict")
    assert code == 1 and [(r["src"], r["dst"]) for r in out["rows"]] == [("main.order_items", "main.orders")]
    assert cli.main(["openlineage", g, "--namespace", "n", "--event-time", "2024-01-01T00:00:00Z", "--output", f"{graph}/o.ndjson"]) == 0
    assert all(json.loads(x)["run"]["runId"] for x in Path(f"{graph}/o.ndjson").read_text().splitlines())


def _events(path: str) -> dict[str, dict]:
    return {e["job"]["name"]: e for e in map(json.loads, Path(path).read_text().splitlines())}


def test_datasets_of_merged_sources_keep_apart(spark, graph, capsys):
    g, m, o = f"{graph}/g.json", f"{graph}/m.json", f"{graph}/merged.ndjson"
    args = ("--namespace", "n", "--event-time", "2024-01-01T00:00:00Z", "--output", o)
    assert cli.main(["merge", f"shop={g}", f"web={g}", "--output", m]) == 0
    assert cli.main(["openlineage", g, "--database", "db", *args]) == 0
    alone = _events(o)["main.order_totals"]
    assert alone["outputs"][0]["name"] == "db.main.order_totals" and {x["name"] for x in alone["inputs"]} == {"db.main.orders", "db.main.customers"}
    assert cli.main(["openlineage", m, "--source-namespace", "web=w", "--source-database", "web=live", *args]) == 0
    found = _events(o)
    for job, namespace, database in (("shop::main.order_totals", "n", "shop"), ("web::main.order_totals", "w", "live")):
        e = found[job]
        assert e["job"]["namespace"] == "n"
        assert [(x["namespace"], x["name"]) for x in e["inputs"]] == [(namespace, f"{database}.main.customers"), (namespace, f"{database}.main.orders")]
        (output,) = e["outputs"]
        assert (output["namespace"], output["name"]) == (namespace, f"{database}.main.order_totals")
        told = output["facets"]["columnLineage"]
        assert {(f["namespace"], f["name"], f["field"]) for f in told["fields"]["name"]["inputFields"]} == {(namespace, f"{database}.main.customers", "name")}
        assert all(f["transformations"] == [{"type": "DIRECT"}] for f in told["fields"]["name"]["inputFields"]) and told["_schemaURL"]
        assert {(x["name"], x["field"], t["type"], t["subtype"]) for x in told["dataset"] for t in x["transformations"]} == {(f"{database}.main.customers", "id", "INDIRECT", "JOIN"), (f"{database}.main.orders", "customer_id", "INDIRECT", "JOIN")}
    shared = ["--source-database", "web=one", "--source-database", "shop=one"]
    for wrong, why in ((shared, "name the sources apart"), (["--source-database", "wbe=x"], "no source"), (["--source-database", "web= "], "must not be empty"), (["--source-namespace", "web"], "label=name"), (["--source-namespace", "web=a", "--source-namespace", "web=b"], "more than once"), (["--database", "d"], "a database name a source")):
        with pytest.raises(ValueError, match=why):
            cli.run(cli.parser().parse_args(["openlineage", m, *wrong, *args]), spark)
    with pytest.raises(ValueError, match="no sources"):
        cli.run(cli.parser().parse_args(["openlineage", g, "--source-database", "web=x", *args]), spark)
    # different namespaces part what one database name would join
    assert cli.main(["openlineage", m, *shared, "--source-namespace", "web=w", *args]) == 0


def test_dots_in_names_can_join_datasets_of_one_source(spark):
    vertices = [("a%2Eb.c", "table", "c", "a.b"), ("a.b%2Ec", "table", "b.c", "a"), ("a.d", "table", "d", "a"), ("a.v", "view", "v", "a")]
    reads = [("a.v", "a%2Eb.c", "reads"), ("a.v", "a.b%2Ec", "reads")]
    g = GraphBundle(spark, {"vertices": spark.createDataFrame(vertices, "id string, kind string, name string, schema string"), "edges": spark.createDataFrame(reads, "src string, dst string, kind string")})
    assert [tuple(r) for r in lineage.identity_collisions(g, "n").collect()] == [("n", "a.b.c", "a%2Eb.c|a.b%2Ec", False)]
    assert lineage.identity_collisions(g.with_tables(edges=g.edges.limit(1)), "n").count() == 0  # only what events name counts
    empty = GraphBundle(spark)
    assert lineage.openlineage(empty, "n", "t").count() == 0 and not lineage.naming(empty, "n").merged


def test_review_and_diff(graph, capsys):
    raw = json.loads(Path(f"{graph}/d.json").read_text())
    table = next(o for o in raw["schemas"][0]["objects"] if o["name"] == "customers")
    table["columns"].pop()
    Path(f"{graph}/e.json").write_text(json.dumps(raw))
    Path(f"{graph}/p.toml").write_text('version = 1\nfail_threshold = "high"\n')
    code, out = _out(capsys, "review", f"{graph}/d.json", f"{graph}/e.json", "--policy", f"{graph}/p.toml")
    assert code == 1 and [r["kind"] for r in out["rows"]] == ["column-removed"] and "main.orders" in {r["id"] for r in out["impacted"]["rows"]}
    fingerprint = out["rows"][0]["fingerprint"]
    Path(f"{graph}/p.toml").write_text(f'version = 1\nfail_threshold = "high"\n[[waivers]]\nfingerprint = "{fingerprint}"\nreason = "planned"\n')
    assert _out(capsys, "review", f"{graph}/d.json", f"{graph}/e.json", "--policy", f"{graph}/p.toml", "--format", "markdown")[0] == 0
    _, out = _out(capsys, "diff", f"{graph}/d.json", f"{graph}/e.json", "--documents")
    assert [(r["id"], r["change"]) for r in out["rows"]] == [("main.customers.name", "removed")]
    with pytest.raises(ValueError):
        Path(f"{graph}/bad.toml").write_text("version = 1\nwhat = 2\n")
        policyfiles.review(f"{graph}/bad.toml")


def test_server_answers_and_refuses(spark, graph):
    g = cli.load_graph(spark, f"{graph}/g.json")
    ask = [{"id": 1, "method": "initialize"}, {"id": 2, "method": "tools/list"}, {"method": "notifications/initialized"}, {"id": 3, "method": "tools/call", "params": {"name": "impact", "arguments": {"name": "main.customers"}}}, {"id": 4, "method": "tools/call", "params": {"name": "impact", "arguments": {"name": "id"}}}, {"id": 5, "method": "tools/call", "params": {"name": "query", "arguments": {"name": "main.orders", "depth": 65}}}, {"id": 6, "method": "nope"}, {"id": 7, "method": "tools/call", "params": {"name": "search", "arguments": {"text": "o", "zzz": 1}}}]
    out = io.StringIO()
    assert server.serve(g, io.StringIO("\n".join(map(json.dumps, ask)) + "\nnot json\n"), out) == 0
    replies = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [r["id"] for r in replies] == [1, 2, 3, 4, 5, 6, 7, None]
    assert len(replies[1]["result"]["tools"]) == 11
    assert "main.orders" in replies[2]["result"]["content"][0]["text"] and replies[3]["result"]["isError"]
    assert [r["error"]["code"] for r in replies[4:]] == [-32602, -32601, -32602, -32700]


def test_streamed_windows_equal_the_tables(spark, tmp_path):
    from datetime import datetime, timedelta

    from plexus.streaming import usage

    rows = [(k, k % 3, "purchase" if k % 4 == 0 else "view", datetime(2024, 1, 1) + timedelta(hours=5 * k), 1.0) for k in range(40)]
    table = spark.createDataFrame(rows, usage.EVENTS)
    table.repartition(4).write.parquet(f"{tmp_path}/e")
    stream = usage.usage_windows(usage.event_stream(spark, f"{tmp_path}/e", usage.EVENTS))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, usage.usage_windows(table).collect()))
    assert usage.usage_sessions(table, "6 hours").count() == 40
