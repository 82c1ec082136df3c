"""NDJSON documents by splits: the DataSource and the carried schemas; the server's concurrent and cancelled calls."""

from __future__ import annotations

import io
import json
import queue
import threading
import time

import pytest

from plexus import server
from plexus.operators import traverse
from plexus.plans.bundle import GraphBundle
from plexus.sources import datasource, document

HEAD = {"type": "document", "version": 2, "dialect": "postgres", "producer": {"name": "t"}, "required_features": []}


def _records(schemas=7, objects=40):
    """Objects without a schema of their own, so that each belongs to the schema record before it."""
    yield HEAD
    for s in range(schemas):
        yield {"type": "schema", "name": f"s{s}"}
        for k in range(objects * (s % 3)):
            columns = [{"name": f"c{j}", "data_type": "int", "nullable": bool(j), "ordinal": j + 1, "pk_position": int(not j), "default": "é\\n" if j else None} for j in range(3)]
            yield {"type": "object", "data": {"name": f"t{k}", "kind": "table", "columns": columns, "constraints": [{"name": "f", "kind": "foreign-key", "columns": ["c1"], "referenced": {"table": "t0", "columns": ["c0"]}}], "indexes": [{"name": "i", "unique": True, "columns": ["c1"], "definition_complete": True}], "triggers": [{"name": "g", "body": "x"}]}}
        yield {"type": "routine", "schema": "other" if s == 2 else None, "data": {"name": f"r{s}", "kind": "function", "language": "sql", "body": "select 1", "signature": ""}}
    yield {"type": "limitations", "data": []}


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    file = tmp_path_factory.mktemp("nd") / "d.ndjson"
    file.write_text("\n".join(json.dumps({k: v for k, v in r.items() if v is not None}, ensure_ascii=False) for r in _records()) + "\n", encoding="utf-8")
    return str(file)


def test_datasource_gives_the_documents_tables(spark, path):
    datasource.register(spark)
    doc = document.read_ndjson(spark, path)
    load = lambda table, split: spark.read.format(datasource.NAME).option("table", table).option("splitBytes", split).load(path)
    for split in (1 << 26, 4000, 333):
        for table in document.TABLES:
            if table in datasource.TABLES:
                df = load(table, split)
                assert split > 4000 or df.rdd.getNumPartitions() > 5
                assert sorted(map(str, df.collect())) == sorted(map(str, getattr(doc, table).collect())), (table, split)
    assert load("records", 500).count() == len(list(_records()))
    with pytest.raises(Exception, match="no such table"):
        load("nothing", 500).count()


def test_datasource_cuts_at_every_place(path):
    raw = open(path, "rb").read()[:3000]
    raw = raw[: raw.rfind(b"\n") + 1]
    for cut in range(0, len(raw), 7):
        file = io.BytesIO(raw)
        both = datasource.lines(file, 0, cut) if cut else []
        both = [x for x in both + datasource.lines(file, cut, len(raw)) if x]
        assert both == raw.split(b"\n")[:-1]
        before = [json.loads(x)["name"] for x in raw.split(b"\n") if x.startswith(b'{"type": "schema"') and raw.find(x) < cut]
        assert not cut or datasource.schema_before(file, cut) == (before[-1] if before else None)


def test_schemas_are_carried_across_blocks(spark, path):
    whole = document.read_ndjson(spark, path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2500")
    try:
        cut = document.read_ndjson(spark, path)
        assert spark.read.text(path).rdd.getNumPartitions() > 5
        for table in ("objects", "columns", "routines"):
            assert sorted(map(str, getattr(cut, table).collect())) == sorted(map(str, getattr(whole, table).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = {(f"s{s}", f"t{k}") for s in range(7) for k in range(40 * (s % 3))}
    assert {(r.schema, r.name) for r in whole.objects.collect()} == want
    assert {(r.schema, r.name) for r in whole.routines.collect()} == {("other" if s == 2 else f"s{s}", f"r{s}") for s in range(7)}


class _Lines(io.StringIO):
    """Hands each reply to a queue."""

    def __init__(self):
        super().__init__()
        self.replies: queue.Queue = queue.Queue()

    def write(self, text):
        self.replies.put(json.loads(text))
        return len(text)


def _graph(spark):
    edges = [("a", "b", "reads"), ("b", "c", "reads")]
    return GraphBundle(spark, {"vertices": spark.createDataFrame([(x, "view", x, "s") for x in "abc"], "id string, kind string, name string, schema string"), "edges": spark.createDataFrame(edges, "src string, dst string, kind string")}).saved()


def test_calls_run_at_once_and_can_be_cancelled(spark):
    g, out = _graph(spark), _Lines()
    started, go = threading.Event(), threading.Event()

    def slow(args):
        started.set()
        g.vertices.rdd.map(lambda r: __import__("time").sleep(120)).count()
        return {}

    def waits(args):
        assert go.wait(60)
        return {"ended": True}

    offered = {"slow": ({}, slow), "waits": ({}, waits), "far": ({}, lambda a: {"n": traverse.impact(g, "c", local=0).count()})}
    s = server.Server(g, out, False, offered)
    call = lambda id_, name: s.take(json.dumps({"id": id_, "method": "tools/call", "params": {"name": name}}))
    call(1, "slow")
    call(2, "waits")
    call(2, "waits")
    assert out.replies.get(timeout=60)["error"]["code"] == server.BUSY  # an id that is running
    call("3", "far")
    reply = out.replies.get(timeout=120)
    assert reply["id"] == "3" and json.loads(reply["result"]["content"][0]["text"]) == {"n": 2}  # while the others still run
    assert started.wait(60)
    time.sleep(1)
    began = time.time()
    s.take(json.dumps({"method": "notifications/cancelled", "params": {"requestId": 1}}))
    call(4, "far")
    assert out.replies.get(timeout=100)["id"] == 4
    go.set()
    assert out.replies.get(timeout=60)["id"] == 2
    s.pool.shutdown(wait=True)
    assert time.time() - began < 100 and out.replies.empty() and not s.calls  # the cancelled call says nothing


def test_a_cancelled_distributed_search_starts_no_further_jobs(spark):
    ids = [f"v{k:03d}" for k in range(60)]
    g = GraphBundle(spark, {"vertices": spark.createDataFrame([(x, "view", x, "s") for x in ids], "id string, kind string, name string, schema string"), "edges": spark.createDataFrame([(a, b, "reads") for a, b in zip(ids, ids[1:])], "src string, dst string, kind string")}).saved()
    out, begun = _Lines(), threading.Event()

    def search(args):
        begun.set()
        return {"n": traverse.reach_roots(g, [ids[0]], False).count()}  # sixty levels of jobs

    s = server.Server(g, out, False, {"search": ({}, search), "ping": ({}, lambda a: {})})
    s.take(json.dumps({"id": 1, "method": "tools/call", "params": {"name": "search"}}))
    assert begun.wait(60)
    time.sleep(1)
    s.take(json.dumps({"method": "notifications/cancelled", "params": {"requestId": 1}}))
    s.take(json.dumps({"id": 2, "method": "tools/call", "params": {"name": "ping"}}))
    assert out.replies.get(timeout=30)["id"] == 2
    began = time.time()
    s.pool.shutdown(wait=True)
    assert time.time() - began < 30 and out.replies.empty()


def test_too_many_calls_are_refused(spark, monkeypatch):
    monkeypatch.setattr(server, "OUTSTANDING", 2)
    go, out = threading.Event(), _Lines()
    s = server.Server(_graph(spark), out, False, {"waits": ({}, lambda a: {"x": go.wait(30)})})
    for k in range(3):
        s.take(json.dumps({"id": k, "method": "tools/call", "params": {"name": "waits"}}))
    assert out.replies.get(timeout=20) == {"jsonrpc": "2.0", "id": 2, "error": {"code": server.BUSY, "message": "too many calls are waiting"}}
    go.set()
    s.pool.shutdown(wait=True)
    assert {out.replies.get()["id"], out.replies.get()["id"]} == {0, 1}
