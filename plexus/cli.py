"""Commands: python -m plexus COMMAND. Exit codes: 0 fine, 1 a strict finding or a name not found, 2 an error, 64 an unresolved traversal root, 130 cancelled."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import policyfiles
from .operators import change, checks, lineage, lint, merge, structure, traverse
from .plans.build import build, inferred_keys
from .plans.bundle import GraphBundle, union_all
from .plans.sqlbind.enrich import enrich
from .sinks import graphjson, render
from .sources import document, imports, jdbc, sqlite
from .sources.document import Document

INF = 1 << 31


def session() -> SparkSession:
    spark = SparkSession.builder.appName("plexus").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def load_document(spark: SparkSession, source: str, schemas: list[str] | None = None, usage: bool = False, dependencies: bool = False) -> Document:
    if source.startswith("sqlite:"):
        doc = sqlite.read(spark, source.removeprefix("sqlite:").removeprefix("//"))
    elif "://" in source and not source.startswith(("file:", "hdfs:", "s3a:")):
        kind = jdbc.scheme_of(source)
        url = source if source.startswith("jdbc:") else "jdbc:" + source
        return jdbc.read(spark, kind, jdbc.jdbc_reader(spark, url), schemas or ["public"], usage, dependencies, notes=tuple(jdbc.transport_note(url)))
    elif source.endswith((".ndjson", ".jsonl")):
        doc = document.read_ndjson(spark, source)
    else:
        doc = document.read_json(spark, source)
    return document.annotate(doc, doc.header.get("source_id") or source, schemas) if schemas else doc


def load_graph(spark: SparkSession, path: str) -> GraphBundle:
    """A saved bundle (a folder) or a graph file."""
    if Path(path).is_dir():
        return GraphBundle.read(spark, path)
    return graphjson.read(spark, path).saved()


def graph_of(doc: Document, guesses: bool = False, cache: str | None = None) -> GraphBundle:
    out = enrich(doc, build(doc).saved(), cache).saved()
    if guesses:
        edges, ambiguous = inferred_keys(out)
        n = ambiguous.count()
        out = out.with_tables(edges=union_all([out.edges, edges])).noted([f"key guesses with several targets, not drawn: {n}"] * bool(n))
    return out


def _notes(g: GraphBundle) -> list[str]:
    return [r["note"] for r in g.limitations.distinct().orderBy("note").collect()]


def show(value: object) -> None:
    print(value if isinstance(value, str) else json.dumps(value, indent=1, ensure_ascii=False, sort_keys=True))


def _subject(g: GraphBundle, name: str) -> dict | None:
    """The vertex of a name; several or none are shown, none is chosen."""
    rows = traverse.resolve(g, name).orderBy("id").limit(64).collect()
    if len(rows) == 1 and rows[0]["status"] != "candidate":
        v = g.vertices.where(F.col("id") == rows[0]["id"]).first()
        return {"id": v["id"], "kind": v["kind"], "name": v["name"], "schema": v["schema"]}
    show({"found": False, "name": name, "candidates": [r["id"] for r in rows], "limitations": _notes(g)})
    return None


def _table(df: DataFrame, order: list[str], most: int, **more: object) -> dict:
    return render.rows_json(df, order, most) | more


def _by_source(values: list[str]) -> dict[str, str]:
    """``label=name`` options by label, each label once."""
    pairs = [x.partition("=") for x in values]
    if wrong := [x for x, (_, mark, _) in zip(values, pairs, strict=True) if not mark]:
        raise ValueError(f"label=name is wanted, not {', '.join(wrong)}")
    found = {label: name for label, _, name in pairs}
    if len(found) != len(pairs):
        raise ValueError("a source is named more than once")
    return found


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="plexus", description="Dependency graphs of database schemas on Spark.")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, *args: tuple, graph: bool = True) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        if graph:
            p.add_argument("graph")
        for flags, options in args:
            p.add_argument(*flags, **options)
        return p

    opt = lambda *flags, **o: (flags, o)
    most = lambda n: opt("--max", type=int, default=n)
    budget = (opt("--max-visited", type=int, default=100_000), opt("--max-edges", type=int, default=1_000_000))
    level = opt("--level", choices=("schema", "object", "column"), default="object")
    add("scan", opt("source"), opt("--output", required=True), opt("--schema", action="append"), opt("--usage", action="store_true"), opt("--catalog-dependencies", action="store_true"), opt("--infer", action="store_true"), opt("--body-cache", help="a folder that keeps what bodies say between scans"), opt("--sql-dir"), opt("--sql-schema", default="main"), opt("--emit-document"), opt("--document-version", type=int, default=2), graph=False)
    add("import", opt("document"), opt("input"), opt("--kind", choices=("dbt", "query-log", "sql-dir"), required=True), opt("--schema", action="append"), opt("--output", required=True), opt("--max-input", type=int, default=64 << 20), opt("--max-rows", type=int, default=100_000), opt("--max-sql", type=int, default=8 << 20), opt("--max-total", type=int, default=64 << 20), graph=False)
    add("merge", opt("inputs", nargs="+", help="label=graph"), opt("--document", action="append", default=[], help="label=document: its references to other databases become edges"), opt("--output", required=True), graph=False)
    add("facts", opt("document"), opt("--source-id", required=True), most(100_000), graph=False)
    by_source = [opt(f"--source-{c}", action="append", default=[], help=f"label=name: a {c} for one source of a merged graph") for c in ("namespace", "database")]
    add("openlineage", opt("--namespace", required=True), opt("--database"), *by_source, opt("--event-time", required=True), opt("--output", required=True))
    add("graph", opt("--format", choices=("mermaid", "dot", "html", "json", "summary"), default="summary"), opt("--level", choices=("schema", "object", "column")))
    add("search", opt("text"), opt("--kind", action="append"), opt("--counts", action="store_true"), most(100))
    add("query", opt("name"), opt("--depth", type=int, default=1), most(256), *budget)
    add("impact", opt("name"), most(1024), *budget)
    add("language-traversal", opt("roots", nargs="+"), opt("--depth", type=int, default=INF), opt("--dependents", action="store_true"), most(1024), *budget)
    add("cycles", level, most(1024))
    add("dead", opt("--policy"), opt("--as-of"), opt("--strict", action="store_true"), most(1024))
    add("unused", most(1024))
    add("stats", most(1024))
    add("diagnostics", opt("--subject"), most(1024))
    add("explain", opt("name"), most(1024))
    add("path", opt("start"), opt("end"), opt("--max-paths", type=int, default=32), opt("--depth", type=int, default=32), *budget)
    add("rules", opt("rules"), opt("--level", choices=("schema", "object", "column")), opt("--strict", action="store_true"), most(1024))
    add("lint", opt("--strict", action="store_true"), opt("--sarif", action="store_true"), most(256))
    add("lineage", most(1024))
    add("diff", opt("before"), opt("after"), opt("--documents", action="store_true"), most(1024), graph=False)
    add("review", opt("before"), opt("after"), opt("--policy"), opt("--baseline"), opt("--as-of"), opt("--format", choices=("json", "markdown", "sarif"), default="json"), opt("--require-complete", action="store_true"), opt("--max-changes", type=int, default=256), opt("--max-impacted", type=int, default=1024), graph=False)
    add("serve")
    return top


def run(a: argparse.Namespace, spark: SparkSession) -> int:
    if a.command in ("scan", "import", "merge", "facts", "diff", "review"):
        return globals()[f"_{a.command}"](a, spark)
    g = load_graph(spark, a.graph)
    level = "member" if getattr(a, "level", None) == "column" else getattr(a, "level", None)
    b = traverse.Budget(getattr(a, "max_visited", 100_000), getattr(a, "max_edges", 1_000_000))
    if a.command == "serve":
        from .server import serve

        return serve(g, sys.stdin, sys.stdout, ordered=False)
    if a.command == "graph":
        shown = structure.project(g, level) if level and level != "member" else g
        show({"mermaid": render.mermaid, "dot": render.dot, "html": render.page, "json": lambda x: "".join(graphjson.chunks(x)), "summary": lambda x: _table(checks.summary(x), ["part", "kind"], 100, limitations=_notes(x))}[a.format](shown))
    elif a.command == "search":
        show(_table(checks.search(g, a.text, a.kind, a.max, a.counts), ["id"], a.max))
    elif a.command in ("query", "impact"):
        subject = _subject(g, a.name)
        if subject is None:
            return 1
        if a.command == "impact":
            show(render.impact_json(subject, traverse.walk(g, subject["id"], True, max_results=a.max, budget=b), _notes(g)))
        else:
            sides = [traverse.walk(g, subject["id"], inward, a.depth, a.max, b) for inward in (True, False)]
            own = [r["kind"] for r in g.arcs().where((F.col("src") == subject["id"]) & (F.col("dst") == subject["id"])).select("kind").distinct().orderBy("kind").collect()]
            show(render.query_json(subject, a.depth, *sides, own, _notes(g)))
    elif a.command == "language-traversal":
        report = traverse.walk_roots(g, a.roots, a.dependents, a.depth, a.max, b)
        show(render.traversal_json(a.roots, report, _notes(g)))
        return 64 if "root-not-found" in report.reasons else 0
    elif a.command == "cycles":
        show(_table(structure.cycles(g, level), ["cycle_id"], a.max, level=a.level))
    elif a.command == "dead":
        policy = policyfiles.retention(a.policy, a.as_of) if a.policy else structure.Retention()
        found = structure.dead(g, policy)
        left = found.where("suppression_reason IS NULL").count()
        show(_table(found, ["id"], a.max, unsuppressed=left, limitations=[*_notes(g), *structure.policy_notes(g, policy), "queries of applications are not in the graph: a candidate has no dependents inside the database, which does not make it safe to drop"]))
        return int(a.strict and left > 0)
    elif a.command == "unused":
        show(_table(checks.unused(g), ["id"], a.max, unobserved={r["kind"]: r["n"] for r in checks.unobserved(g).collect()}))
    elif a.command == "stats":
        show(_table(checks.stats(g), ["id"], a.max, totals=checks.stats_totals(g).first().asDict()))
    elif a.command == "diagnostics":
        show(_table(checks.diagnostics(g, a.subject), ["id", "code"], a.max, states={r["state"]: r["n"] for r in checks.diagnostics_summary(g).collect()}))
    elif a.command == "explain":
        subject = _subject(g, a.name)
        if subject is None:
            return 1
        show(_table(traverse.explain(g, subject["id"], a.max), ["src", "dst", "kind"], a.max, subject=subject))
    elif a.command == "path":
        ends = [_subject(g, x) for x in (a.start, a.end)]
        if None in ends:
            return 1
        report = traverse.paths(g, ends[0]["id"], ends[1]["id"], max_paths=a.max_paths, depth=a.depth, budget=b)
        show({"paths": [{"path": p, "kinds": k} for _, p, k in report.rows], "complete": report.complete, "truncationReasons": sorted(report.reasons)})
    elif a.command == "rules":
        wanted = policyfiles.rules(a.rules)
        found = checks.rules(g, wanted, level if level != "member" else None)
        out = _table(found, ["rule", "src", "dst"], a.max, checked=len(wanted), limitations=checks.unmatched_patterns(g, wanted, level if level != "member" else None))
        show(out)
        return int(a.strict and out["total"] > 0)
    elif a.command == "lint":
        found = lint.lint(g)
        totals = lint.lint_summary(g, a.max).first().asDict()
        show(render.sarif(found) if a.sarif else _table(found, ["rule", "subject", "code", "message"], a.max, summary=totals))
        return int(a.strict and totals["blocking"] > 0)
    elif a.command == "lineage":
        show(_table(lineage.jobs(g), ["job"], a.max))
    elif a.command == "openlineage":
        told = lineage.naming(g, a.namespace, a.database, _by_source(a.source_namespace), _by_source(a.source_database))
        clashes = lineage.identity_collisions(g, told).orderBy(F.col("across_sources").desc(), "namespace", "name").limit(64).collect()
        list_ = lambda rows: "; ".join(f"{r['namespace']} {r['name']}: {r['ids'].replace('|', ', ')}" for r in rows)
        if across := [r for r in clashes if r["across_sources"]]:
            raise ValueError(f"datasets of different sources would have one name; name the sources apart: {list_(across)}")
        if clashes:
            print(f"note: datasets that have one name outside, as names with dots in them run together: {list_(clashes)}", file=sys.stderr)
        graphjson.publish(a.output, (r["event"] + "\n" for r in lineage.openlineage(g, told, a.event_time).orderBy("job").toLocalIterator()))
    return 0


def _scan(a: argparse.Namespace, spark: SparkSession) -> int:
    if a.emit_document and Path(a.emit_document) == Path(a.output):
        raise ValueError("the graph and the document need two files")
    doc = load_document(spark, a.source, a.schema, a.usage, a.catalog_dependencies)
    if a.sql_dir:
        doc = imports.sql_directory(spark, doc, a.sql_dir, a.sql_schema)
    if a.emit_document:
        graphjson.publish(a.emit_document, iter([json.dumps(document.to_value(doc, a.document_version), ensure_ascii=False) + "\n"]))
    _save(graph_of(doc, a.infer, a.body_cache), a.output)
    return 0


def _save(g: GraphBundle, output: str) -> None:
    """A .json file, or a folder of Parquet tables."""
    if output.endswith(".json"):
        graphjson.write(g, output)
    else:
        g.write(output)


def _import(a: argparse.Namespace, spark: SparkSession) -> int:
    doc, limits = load_document(spark, a.document), imports.Limits(a.max_input, a.max_rows, a.max_sql, a.max_total)
    if a.kind == "dbt":
        doc = imports.dbt_manifest(spark, doc, a.input, a.schema, limits)
    elif a.kind == "query-log":
        doc = imports.query_log(spark, doc, a.input, limits)
    else:
        doc = imports.sql_directory(spark, doc, a.input, (a.schema or ["main"])[0], limits)
    _save(graph_of(doc), a.output)
    return 0


def _merge(a: argparse.Namespace, spark: SparkSession) -> int:
    pairs = [x.split("=", 1) for x in a.inputs]
    merged = merge.merge_graphs([(label, load_graph(spark, path)) for label, path in pairs])
    documents = [(label, load_document(spark, path)) for label, path in (x.split("=", 1) for x in a.document)]
    _save(merge.with_references(merged, documents), a.output)
    return 0


def _facts(a: argparse.Namespace, spark: SparkSession) -> int:
    show(_table(imports.relation_facts(load_document(spark, a.document), a.source_id), ["id"], a.max))
    return 0


def _diff(a: argparse.Namespace, spark: SparkSession) -> int:
    if a.documents:
        show(_table(change.diff_documents(load_document(spark, a.before), load_document(spark, a.after)), ["id", "part", "change"], a.max))
    else:
        show(_table(change.diff_graph(load_graph(spark, a.before), load_graph(spark, a.after)), ["part", "change", "id", "src", "dst", "kind"], a.max))
    return 0


def _review(a: argparse.Namespace, spark: SparkSession) -> int:
    old, new = load_document(spark, a.before), load_document(spark, a.after)
    notes = change.comparison_notes(old.header, new.header)
    found = change.with_fingerprints(change.changes(old, new), *(str(d.header.get("source_id")) for d in (old, new)))
    policy = policyfiles.review(a.policy, a.baseline, a.as_of) if a.policy else change.Policy(as_of=a.as_of)
    judged = change.evaluate(found, policy)
    placed, hit = change.review(graph_of(old), graph_of(new), found)
    if a.format == "sarif":
        show(render.sarif(judged.select(F.col("kind").alias("rule"), F.lit("confirmed").alias("status"), F.col("id").alias("subject"), F.concat_ws(" ", "kind", "id").alias("message"), "severity")))
    elif a.format == "markdown":
        show(render.review_markdown(placed, hit, notes, a.max_changes, a.max_impacted))
    else:
        show(_table(judged, ["kind", "id"], a.max_changes, impacted=render.rows_json(hit, ["change_id", "distance", "id"], a.max_impacted), comparison=notes))
    if any(n.startswith("dialect") for n in notes) or (a.require_complete and (notes or not new.complete)):
        return 2
    return int(not judged.where("fails").isEmpty())


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    try:
        return run(a, session())
    except KeyboardInterrupt:
        return 130
    except (ValueError, OSError) as e:
        print(f"error: {jdbc.redacted(str(e))}", file=sys.stderr)
        return 2
