"""SQLite catalogs. PRAGMAs are no tables, so the driver reads the file's schema (never its rows) and hands it over as a document."""

from __future__ import annotations

import re
import sqlite3

from pyspark.sql import SparkSession

from .document import Document, from_value


def read(spark: SparkSession, path: str) -> Document:
    return from_value(spark, catalog(path))


def catalog(path: str) -> dict:
    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        schemas, notes = [], []
        for _, name, _file in db.execute("PRAGMA database_list").fetchall():
            if name != "temp":
                schemas.append(_schema(db, name, notes))
        return {"version": 2, "dialect": "sqlite", "producer": {"name": "native-sqlite"}, "required_features": [], "context": {"catalog_complete": not notes}, "schemas": schemas, "limitations": notes}
    finally:
        db.close()


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _schema(db: sqlite3.Connection, schema: str, notes: list[str]) -> dict:
    objects = []
    rows = db.execute(f"SELECT type, name, tbl_name, sql FROM {_quoted(schema)}.sqlite_master ORDER BY name").fetchall()
    triggers: dict[str, list[dict]] = {}
    for kind, name, table, sql in rows:
        if kind == "trigger":
            triggers.setdefault(table, []).append({"name": name, "body": sql})
    for kind, name, _, sql in rows:
        if kind not in ("table", "view") or name.startswith("sqlite_"):
            continue
        out = {"name": name, "kind": kind, "columns": _columns(db, schema, name, notes), "constraints": [], "indexes": [], "triggers": triggers.get(name, [])}
        if kind == "view":
            out["body"] = re.sub(r"(?is)^\s*create\s+(temp\w*\s+)?view\s+.*?\bas\b\s*", "", sql or "", count=1)
        else:
            out["constraints"] = _constraints(db, schema, name)
            out["indexes"] = _indexes(db, schema, name)
        objects.append(out)
    return {"name": schema, "objects": objects, "routines": []}


def _columns(db: sqlite3.Connection, schema: str, table: str, notes: list[str]) -> list[dict]:
    try:
        rows = db.execute(f"PRAGMA {_quoted(schema)}.table_xinfo({_quoted(table)})").fetchall()
    except sqlite3.Error as e:
        notes.append(f"columns of {schema}.{table} could not be read: {e}")
        return []
    return [{k: v for k, v in {"name": n, "data_type": t or "", "nullable": not required, "default": d, "ordinal": i + 1, "pk_position": pk}.items() if v is not None} for i, n, t, required, d, pk, hidden in rows if hidden != 1]


def _constraints(db: sqlite3.Connection, schema: str, table: str) -> list[dict]:
    found: dict[int, dict] = {}
    for id_, _, target, a, b, *_ in db.execute(f"PRAGMA {_quoted(schema)}.foreign_key_list({_quoted(table)})").fetchall():
        c = found.setdefault(id_, {"name": f"fk_{id_}", "kind": "foreign-key", "columns": [], "referenced": {"table": target, "columns": []}})
        c["columns"].append(a)
        c["referenced"]["columns"].append(b or "")
    return [found[k] for k in sorted(found)]


def _indexes(db: sqlite3.Connection, schema: str, table: str) -> list[dict]:
    out = []
    for _, name, unique, _, partial in db.execute(f"PRAGMA {_quoted(schema)}.index_list({_quoted(table)})").fetchall():
        columns = [r[2] for r in db.execute(f"PRAGMA {_quoted(schema)}.index_xinfo({_quoted(name)})").fetchall() if r[5]]
        out.append({"name": name, "unique": bool(unique), "columns": [c for c in columns if c], "definition_complete": all(columns), "has_predicate": bool(partial)})
    return sorted(out, key=lambda x: x["name"])
