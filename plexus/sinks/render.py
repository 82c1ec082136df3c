"""Graphs and reports as Mermaid, DOT, SARIF, Markdown, HTML and report JSON. Texts for people and tools; the rows behind them stay DataFrames."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import kind_order
from ..operators.traverse import Report
from ..plans.bundle import GraphBundle

#: Drawings of more edges than this are cut, and say so.
MOST_DRAWN = 2000


def _edges(bundle: GraphBundle, most: int = MOST_DRAWN) -> tuple[list, bool]:
    rows = bundle.edges.where("kind <> 'contains'").select("src", "dst", "kind").distinct().orderBy("src", "dst", kind_order(F.col("kind"))).limit(most + 1).collect()
    return rows[:most], len(rows) > most


def mermaid(bundle: GraphBundle) -> str:
    """A flowchart; nodes are numbered in order of their ids."""
    rows, cut = _edges(bundle)
    number = {x: k for k, x in enumerate(sorted({r["src"] for r in rows} | {r["dst"] for r in rows}, key=str.encode))}
    clean = lambda x: x.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;").replace(">", "&gt;").replace("\n", " ")
    lines = ["flowchart LR", *(f'  n{k}["{clean(x)}"]' for x, k in number.items()), *(f"  n{number[r['src']]} -->|{r['kind']}| n{number[r['dst']]}" for r in rows)]
    return "\n".join(lines + ["  %% cut: more edges are in the graph"] * cut) + "\n"


def dot(bundle: GraphBundle) -> str:
    quoted = lambda x: '"' + x.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
    rows, cut = _edges(bundle)
    return "\n".join(["digraph schema {", *(f"  {quoted(r['src'])} -> {quoted(r['dst'])} [label={quoted(r['kind'])}];" for r in rows), *["  // cut: more edges are in the graph"] * cut, "}"]) + "\n"


def page(bundle: GraphBundle, title: str = "Schema graph") -> str:
    """One HTML file without any other resource: a table of edges and a search box."""
    rows, cut = _edges(bundle)
    data = json.dumps([[r["src"], r["kind"], r["dst"]] for r in rows]).replace("<", "\\u003c")
    note = "<p>More edges are in the graph than are shown.</p>" if cut else ""
    return (
        f"<!DOCTYPE html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{note}<input id=q placeholder=Search><table id=t></table>"
        f"<script>const E={data};const t=document.getElementById('t'),q=document.getElementById('q');function draw(){{t.textContent='';for(const e of E)if(e.join(' ').toLowerCase().includes(q.value.toLowerCase())){{const r=t.insertRow();for(const x of e)r.insertCell().textContent=x}}}}q.oninput=draw;draw()</script>\n"
    )


def sarif(findings: DataFrame, name: str = "plexus") -> str:
    """Findings (rule, status, subject, message[, severity]) as SARIF 2.1.0."""
    columns = set(findings.columns)
    rows = findings.orderBy("rule", "subject", "message").toLocalIterator()
    level = lambda r: {"critical": "error", "high": "error", "medium": "warning", "low": "note"}.get(r["severity"], "warning") if "severity" in columns else "error" if r["status"] == "confirmed" else "warning"
    results = [{"ruleId": r["rule"], "level": level(r), "message": {"text": r["message"]}, "locations": [{"logicalLocations": [{"fullyQualifiedName": r["subject"]}]}]} for r in rows]
    rules = sorted({r["ruleId"] for r in results})
    out = {"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": name, "rules": [{"id": r} for r in rules]}}, "results": results}]}
    return json.dumps(out, indent=1, ensure_ascii=False) + "\n"


def review_markdown(changes: DataFrame, impacted: DataFrame, notes: list[str], max_changes: int = 256, max_impacted: int = 1024) -> str:
    """A review as Markdown: each change with what depends on it, cut to the limits with the totals before the cut."""
    total = changes.count()
    near = impacted.withColumn("n", F.row_number().over(Window.partitionBy("change_id").orderBy("distance", "id"))).where(F.col("n") <= max_impacted)
    listed = near.groupBy("change_id").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    sizes = impacted.groupBy("change_id").agg(F.count(F.lit(1)).alias("total"))
    rows = changes.orderBy("kind", "id").limit(max_changes).join(listed, "change_id", "left").join(sizes, "change_id", "left").orderBy("kind", "id").collect()
    out = ["# Schema review", "", f"{total} change(s) to look at" + (f", {len(rows)} shown" if total > len(rows) else "") + ".", ""]
    for r in rows:
        out.append(f"## {r['kind']}: `{r['id']}`")
        out.append(f"Depends on it: {r['total'] or 0} object(s), looked up in the graph {r['coverage']}.")
        out += [f"- `{x}`" for x in r["ids"] or []] + [""]
    if notes:
        out += ["## What could not be compared", *(f"- {n}" for n in notes), ""]
    return "\n".join(out)


def _present(x: dict) -> dict:
    return {k: v for k, v in x.items() if v is not None}


def impact_json(subject: dict, report: Report, limitations: list[str]) -> dict:
    """The report of a budgeted impact search. Optional values that are absent are left out."""
    if not report.found:
        return {"found": False, "name": subject.get("id"), "candidates": [], "limitations": limitations}
    return {
        "format": "plexus-impact", "version": 1, "subject": subject, "impacted": [{"id": i, "kind": k, "distance": d, "edges": e.split("|"), "via": v} for i, k, d, e, v in report.rows],
        "visited": report.visited, "examinedEdges": report.examined, "complete": report.complete, "truncated": report.truncated, "truncationReasons": sorted(report.reasons), "limitations": limitations,
    }


def query_json(subject: dict, depth: int, dependents: Report, dependencies: Report, self_edges: list[str], limitations: list[str]) -> dict:
    side = lambda r: [{"id": i, "kind": k, "distance": d, "edges": e.split("|"), "via": v} for i, k, d, e, v in r.rows]
    told = lambda r: {"visited": r.visited, "examinedEdges": r.examined, "complete": r.complete, "truncationReasons": sorted(r.reasons)}
    return _present({
        "format": "plexus-query", "version": 1, "subject": subject, "depth": depth, "dependents": side(dependents), "dependencies": side(dependencies), "selfEdges": self_edges or None,
        "visited": dependents.visited + dependencies.visited, "examinedEdges": dependents.examined + dependencies.examined, "complete": dependents.complete and dependencies.complete,
        "truncated": dependents.truncated or dependencies.truncated, "truncationReasons": sorted(dependents.reasons | dependencies.reasons), "traversals": {"dependents": told(dependents), "dependencies": told(dependencies)}, "limitations": limitations,
    })


def traversal_json(roots: list[str], report: Report, limitations: list[str]) -> dict:
    """The multi-root report (language traversal, version 1)."""
    rows = [_present({"id": i, "kind": k, "depth": d, "edges": e.split("|"), "via": v, "roots": r, "rootsTruncated": cut or None}) for i, k, d, e, v, r, cut in report.rows]
    return {"format": "language-traversal", "version": 1, "roots": roots, "reached": rows, "complete": report.complete, "truncationReasons": sorted(report.reasons), "limitations": limitations}


def rows_json(df: DataFrame, order: list[str], most: int) -> dict:
    """Any report's rows, in order, cut to ``most`` with the total before the cut."""
    total = df.count()
    rows = [json.loads(r["j"]) for r in df.orderBy(*order).limit(most).select(F.to_json(F.struct(*df.columns)).alias("j")).collect()]
    return {"rows": rows, "total": total, "truncated": total > len(rows)}
