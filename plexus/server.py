"""A server over standard input and output: JSON-RPC lines, one preloaded graph, eleven tools. Limits keep any answer bounded.

Up to ``WORKERS`` tool calls run at once, each as a Spark job group of its own; further ones wait, up to ``OUTSTANDING`` calls in all, beyond which
a call is refused. A ``notifications/cancelled`` with the request's id ends that call: its jobs and those it would still start are
cancelled, searches on the driver see a flag between levels, and no reply is sent.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextvars import ContextVar
from typing import TextIO

from pyspark.sql import functions as F

from .operators import checks, lint, structure, traverse
from .plans.bundle import GraphBundle
from .sinks import render

MAX_DEPTH, MAX_RESULTS, MAX_PATHS, MAX_CANDIDATES = 64, 10_000, 1024, 64
WORKERS, OUTSTANDING = 16, 64
BUSY = -32000

#: The flag of the call that runs in this context.
_flag: ContextVar[threading.Event | None] = ContextVar("cancelled", default=None)


def cancelled() -> bool:
    flag = _flag.get()
    return flag is not None and flag.is_set()


def _clamp(args: dict, key: str, default: int, most: int) -> int:
    value = args.get(key, default)
    if isinstance(value, bool) or not isinstance(value, int) or not 0 <= value <= most:
        raise ValueError(f"{key} must be a whole number up to {most}")
    return value


def tools(g: GraphBundle) -> dict[str, tuple[dict[str, str], Callable[[dict], dict]]]:
    """name -> (arguments and their types, function)."""
    notes = [r["note"] for r in g.limitations.distinct().orderBy("note").collect()]

    def subject(args: dict) -> dict:
        rows = traverse.resolve(g, str(args["name"])).orderBy("id").limit(MAX_CANDIDATES).collect()
        if len(rows) != 1 or rows[0]["status"] == "candidate":
            raise LookupError(json.dumps([r["id"] for r in rows]))
        return {"id": rows[0]["id"]}

    most = lambda a, n=256: _clamp(a, "max", n, MAX_RESULTS)

    def query(a: dict) -> dict:
        s, depth = subject(a), _clamp(a, "depth", 1, MAX_DEPTH)
        own = g.arcs().where((F.col("src") == s["id"]) & (F.col("dst") == s["id"])).select("kind").distinct()
        self_edges = sorted(r["kind"] for r in own.collect())  # one row a kind at most
        return render.query_json(s, depth, *(traverse.walk(g, s["id"], side, depth, most(a), cancel=cancelled) for side in (True, False)), self_edges, notes)

    def impact(a: dict) -> dict:
        s = subject(a)
        return render.impact_json(s, traverse.walk(g, s["id"], True, max_results=most(a, 1024), cancel=cancelled), notes)

    def path(a: dict) -> dict:
        report = traverse.paths(g, str(a["start"]), str(a["end"]), max_paths=_clamp(a, "maxPaths", 32, MAX_PATHS), depth=_clamp(a, "depth", 32, MAX_DEPTH), cancel=cancelled)
        return {"paths": [p for _, p, _ in report.rows], "complete": report.complete, "truncationReasons": sorted(report.reasons)}

    def roots(a: dict) -> dict:
        names = [str(x) for x in a["roots"]]
        return render.traversal_json(names, traverse.walk_roots(g, names, bool(a.get("dependents")), _clamp(a, "depth", MAX_DEPTH, MAX_DEPTH), most(a, 1024), cancel=cancelled), notes)

    return {
        "search": ({"text": "string", "max": "integer"}, lambda a: render.rows_json(checks.search(g, str(a["text"]), max_results=most(a, 100)), ["id"], most(a, 100))),
        "query": ({"name": "string", "depth": "integer", "max": "integer"}, query),
        "impact": ({"name": "string", "max": "integer"}, impact),
        "path": ({"start": "string", "end": "string", "maxPaths": "integer", "depth": "integer"}, path),
        "explain": ({"name": "string", "max": "integer"}, lambda a: render.rows_json(traverse.explain(g, subject(a)["id"], most(a)), ["src", "dst", "kind"], most(a))),
        "traversal": ({"roots": "array", "dependents": "boolean", "depth": "integer", "max": "integer"}, roots),
        "cycles": ({"max": "integer"}, lambda a: render.rows_json(structure.cycles(g), ["cycle_id"], most(a))),
        "dead": ({"max": "integer"}, lambda a: render.rows_json(structure.dead(g), ["id"], most(a))),
        "unused": ({"max": "integer"}, lambda a: render.rows_json(checks.unused(g), ["id"], most(a))),
        "lint": ({"max": "integer"}, lambda a: render.rows_json(lint.lint(g), ["rule", "subject", "code"], most(a))),
        "diagnostics": ({"max": "integer"}, lambda a: render.rows_json(checks.diagnostics(g), ["id", "code"], most(a))),
    }


def answer(offered: dict, request: dict) -> dict | None:
    """The reply to one request; None for a notification."""
    method, params, id_ = request.get("method"), request.get("params") or {}, request.get("id")
    ok = lambda result: {"jsonrpc": "2.0", "id": id_, "result": result}
    bad = lambda code, message: {"jsonrpc": "2.0", "id": id_, "error": {"code": code, "message": message}}
    if id_ is None:
        return None
    if method == "initialize":
        return ok({"protocolVersion": "2024-11-05", "serverInfo": {"name": "plexus", "version": "0.1.0"}, "capabilities": {"tools": {}}})
    if method == "tools/list":
        return ok({"tools": [{"name": n, "inputSchema": {"type": "object", "properties": {k: {"type": t} for k, t in args.items()}, "additionalProperties": False}} for n, (args, _) in offered.items()]})
    if method == "tools/call":
        name, args = params.get("name"), params.get("arguments") or {}
        if name not in offered:
            return bad(-32602, f"no such tool: {name}")
        unknown = sorted(set(args) - set(offered[name][0]))
        if unknown:
            return bad(-32602, f"unknown arguments: {', '.join(unknown)}")
        try:
            return ok({"content": [{"type": "text", "text": json.dumps(offered[name][1](args), ensure_ascii=False, sort_keys=True)}]})
        except LookupError as e:
            return ok({"isError": True, "content": [{"type": "text", "text": json.dumps({"found": False, "candidates": json.loads(str(e)) if str(e).startswith("[") else []})}]})
        except ValueError as e:
            return bad(-32602, str(e))
    return bad(-32601, f"no such method: {method}")


class Server:
    """The calls that run, and where replies go. With ``ordered`` replies come in the order of their requests."""

    def __init__(self, g: GraphBundle, sink: TextIO, ordered: bool, offered: dict | None = None) -> None:
        self.context, self.sink, self.ordered = g.spark.sparkContext, sink, ordered
        self.offered = tools(g.saved()) if offered is None else offered
        self.lock = threading.Lock()
        self.calls: dict[object, tuple[threading.Event, str]] = {}
        self.asked = self.said = 0
        self.ready: dict[int, dict | None] = {}
        self.pool = ThreadPoolExecutor(WORKERS, "plexus-call")

    def reply(self, place: int, value: dict | None) -> None:
        """Write what can be written; without a value the place stays silent."""
        with self.lock:
            if self.ordered:
                self.ready[place] = value
                while self.said in self.ready:
                    self._write(self.ready.pop(self.said))
                    self.said += 1
            else:
                self._write(value)

    def _write(self, value: dict | None) -> None:
        if value is not None:
            self.sink.write(json.dumps(value, ensure_ascii=False) + "\n")
            self.sink.flush()

    def take(self, line: str) -> None:
        place, self.asked = self.asked, self.asked + 1
        try:
            request = json.loads(line)
        except json.JSONDecodeError:
            return self.reply(place, {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}})
        if request.get("method") == "notifications/cancelled":
            self.cancel((request.get("params") or {}).get("requestId"))
        if request.get("method") != "tools/call" or request.get("id") is None:
            return self.reply(place, answer(self.offered, request))
        key = json.dumps(request["id"])
        with self.lock:
            known = key in self.calls
            full = len(self.calls) >= OUTSTANDING
            if not known and not full:
                self.calls[key] = (threading.Event(), f"plexus-{uuid.uuid4().hex}")
        if known or full:
            return self.reply(place, {"jsonrpc": "2.0", "id": request["id"], "error": {"code": BUSY, "message": "a call with this id is running" if known else "too many calls are waiting"}})
        self.pool.submit(self.call, place, key, request)

    def call(self, place: int, key: str, request: dict) -> None:
        flag, group = self.calls[key]
        token = _flag.set(flag)
        value: dict | None = None
        try:
            if not flag.is_set():
                self.context.setJobGroup(group, request.get("params", {}).get("name", "call"), interruptOnCancel=True)
                value = answer(self.offered, request)
        except Exception as e:  # one call's failure is its own
            value = {"jsonrpc": "2.0", "id": request["id"], "error": {"code": -32603, "message": str(e).splitlines()[0][:300] if str(e) else type(e).__name__}}
        finally:
            self.context.setLocalProperty("spark.jobGroup.id", None)
            _flag.reset(token)
            with self.lock:
                self.calls.pop(key, None)
            self.reply(place, None if flag.is_set() else value)

    def cancel(self, id_: object) -> None:
        with self.lock:
            found = self.calls.get(json.dumps(id_))
        if found:
            found[0].set()
            self.context._jsc.sc().cancelJobGroupAndFutureJobs(found[1])


def serve(g: GraphBundle, source: TextIO, sink: TextIO, ordered: bool = True) -> int:
    server = Server(g, sink, ordered)
    for line in source:
        if line.strip():
            server.take(line)
    server.pool.shutdown(wait=True)
    return 0
