"""Bodies of views, routines, triggers and queries to edges, origins, analysis and diagnostics. Each body is bound on an executor.

The catalog index (names and ids, no data) is sent to every task once, if it has no more than MOST_NAMES; a larger one is joined with the names that
the bodies look up, in rounds (see ``_in_rounds``), and no task gets more of it than its bodies ask for. With a cache folder only bodies that are new, or whose catalog
has changed, are bound; a catalog of more than MOST_NAMES is bound without it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...sources.document import Document
from ...workspace import ship, written
from ..build import object_id
from ..bundle import GraphBundle, union_all
from . import bodycache
from .binder import Binder, Column, Relation, Scope
from .catalog import Catalog
from .parser import Parser, parse
from .procedural import extract
from .tokens import SqlError, Token, statements, tokenize

#: Objects, columns and routines that a worker holds by name at most; some 100 bytes each.
MOST_NAMES = 2_000_000
FACTS = "owner string, fact string, src string, dst string, kind string, role string, line int, col int, code string, message string, candidates array<string>, state string, scope string, body_hash string"
TRANSITION = {"sqlserver": ("inserted", "deleted")}


def bind_body(catalog: Catalog, owner: str, kind: str, schema: str, body: str, language: str | None, outputs: list[tuple[str, str]], table: str | None) -> list[tuple]:
    """Rows of FACTS for one body. ``outputs``: the owner's columns (name, id) in order; ``table``: a trigger's table."""
    digest = hashlib.sha256(body.encode()).hexdigest()
    binder = Binder(catalog, schema)
    if kind == "default":
        return _default(binder, owner, body, digest)
    state, derives, dml = "complete", set(), kind not in ("view", "materialized-view")
    if table is not None:
        base = binder.base(table)
        for name in TRANSITION.get(catalog.dialect, ("new", "old")):
            binder.pseudo[catalog.name(name, False)] = Relation([Column(c.name, set(c.sources)) for c in base.columns], unknown=base.unknown)
    try:
        tokens = tokenize(body, catalog.dialect)
        if not dml:
            parts = statements(tokens)
            if len(parts) != 1:
                binder.note("SG_VIEW_STATEMENT", f"a view's body is one statement, not {len(parts)}")
            else:
                s = parse(parts[0], catalog.dialect)
                if s.kind not in ("query", "view"):
                    binder.note("SG_VIEW_STATEMENT", "a view's body is a query")
                else:
                    out = binder.query(s.query)
                    derives = _outputs(binder, out, outputs)
        else:
            _routine(binder, tokens, body, language, table)
            derives = binder.derives
    except (SqlError, RecursionError) as e:
        binder.note("SG_PARSE_ERROR", str(e)[:300])
        state = "unsupported"
    if state == "complete" and binder.notes:
        state = "partial"
    rows: list[tuple] = []

    def fact(what: str, src: str | None = None, dst: str | None = None, kind_: str | None = None, role: str | None = None, at: Token | None = None, code: str | None = None, message: str | None = None, candidates: tuple = (), line: int | None = None, col: int | None = None) -> None:
        rows.append((owner, what, src, dst, kind_, role, at.line if at else line, at.col if at else col, code, message, list(candidates), state, "object" if dml else "output", digest))

    mark = f"dml-owner:{owner}:" if dml else ""
    for (target, role), at in sorted(binder.reads.items(), key=lambda x: x[0]):
        fact("edge", owner, target, "reads", mark + role, at)
    for target in sorted(binder.writes):
        fact("edge", owner, target, "writes", f"{mark}target")
    for target in sorted(binder.calls):
        fact("edge", owner, target, "calls", "body-dependency")
    for a, b in sorted(derives):
        fact("edge", a, b, "derives-from", f"{mark}projection")
    for n in binder.notes:
        fact("note", code=n.code, message=n.message, candidates=n.candidates, line=n.line, col=n.col)
    fact("state")
    return rows


def _default(binder: Binder, owner: str, text: str, digest: str) -> list[tuple]:
    """A column default depends on the routines it calls. Its text may hold secrets, so a failure does not quote it."""
    try:
        e = Parser(tokenize(text, binder.catalog.dialect), binder.catalog.dialect).expr(comma=True)
        binder.visit(e, Scope(), "default")
    except SqlError:
        return [(owner, "limit", None, None, None, None, None, None, None, f"default of {owner} was not read; its dependencies are not known", [], None, None, digest)]
    return [(owner, "edge", owner, to, "depends-on", "default", None, None, None, None, [], None, None, digest) for to in sorted(binder.calls)]


def _row(owner: str, fact: str, message: str) -> tuple:
    return (owner, fact, None, None, None, None, None, None, None, message, [], None, None, None)


def _outputs(binder: Binder, out: Relation, outputs: list[tuple[str, str]]) -> set[tuple[str, str]]:
    if out.unknown or not outputs:
        return set()
    if len(out.columns) != len(outputs):
        binder.note("SG_OUTPUT_WIDTH", f"{len(out.columns)} columns in the query, {len(outputs)} in the catalog")
        return set()
    return {(own, x) for (_, own), c in zip(outputs, out.columns, strict=True) for x in c.sources if x != own}


def _routine(binder: Binder, tokens: list[Token], body: str, language: str | None, table: str | None) -> None:
    spoken = (language or "sql").lower()
    if spoken not in ("sql", "plpgsql", "plsql", "pl/sql", "tsql", "t-sql", "external"):
        binder.note("SG_BODY_UNSUPPORTED", f"language is not read: {language}")
        return
    if spoken in ("sql", "external"):
        try:
            for s in [parse(p, binder.catalog.dialect) for p in statements(tokens)]:
                binder.statement(s)
            return
        except SqlError:
            pass  # a procedural body, then
    found = extract(tokens, binder.catalog.dialect, body)
    binder.variables = found.variables | {"found", "sqlstate", "sqlerrm", "tg_op", "tg_table_name"}
    if found.path:
        known = [p for p in found.path if p in binder.catalog.schemas]
        binder.path = known or ["\0"]
    failed = 0
    changes = False
    for p in found.statements:
        try:
            s = parse(p, binder.catalog.dialect)
        except SqlError as e:
            failed += 1
            binder.note("SG_BODY_PARTIAL", f"a statement was not read: {e}", p[0])
            continue
        changes |= s.kind in ("insert", "update", "delete", "merge", "ctas")
        if found.control and s.kind in ("insert", "update", "merge", "ctas") and binder.local:
            binder.note("SG_DML_TEMP_STATE", "temporary tables under control flow are not followed", p[0])
            binder.local = {k: Relation(unknown=True) for k in binder.local}
        binder.statement(s)
    if found.control and changes:
        binder.note("SG_DML_CONTROL_FLOW", "changes stand under control flow")
    if found.unextracted:
        binder.note("SG_BODY_PARTIAL", f"pieces that were not read: {found.unextracted}" + (f", {found.dynamic} of them dynamic SQL" if found.dynamic else ""))


def enrich(doc: Document, bundle: GraphBundle, cache: str | None = None) -> GraphBundle:
    """``bundle``, built from ``doc``, with what the bodies say. ``cache``: a folder that keeps this between runs."""
    spark = bundle.spark
    header = doc.header
    none = lambda n, t="string": F.lit(None).cast(t).alias(n)
    views = doc.objects.where("kind IN ('view', 'materialized-view') AND body IS NOT NULL").select(object_id("schema", "name").alias("owner"), "kind", "schema", "body", none("language"), none("table_id"))
    member = bundle.vertices.where("kind = 'trigger'").select("id", F.col("name"), "schema")
    triggers = doc.triggers.where("body IS NOT NULL").select(object_id("schema", "object").alias("table_id"), "schema", "name", "body")
    fires = bundle.edges.where("kind = 'fires'").select(F.col("src").alias("id"), F.col("dst").alias("table_id"))
    triggers = triggers.join(fires.join(member, "id"), ["table_id", "schema", "name"]).select(F.col("id").alias("owner"), F.lit("trigger").alias("kind"), "schema", "body", none("language"), "table_id")
    routine_ids = bundle.vertices.where("kind IN ('function', 'procedure', 'query')").select(F.col("id").alias("owner"), "name", "schema", "kind")
    from ..build import routine_id

    packaged = F.concat(F.regexp_extract(routine_id(), r"^([^.]*)\.", 1), F.lit("."), F.col("member_of"), F.lit("."), F.regexp_extract(routine_id(), r"^[^.]*\.(.*)$", 1))
    bodies = doc.routines.where("body IS NOT NULL AND kind <> 'package'").withColumns({"o1": routine_id(), "o2": packaged})
    candidates = F.array_compact(F.array("o1", F.concat("o1", F.lit("@"), "kind"), "o2"))
    routines = bodies.withColumn("owner", F.explode(candidates)).join(routine_ids.select("owner"), "owner", "left_semi").select("owner", "kind", "schema", "body", "language", none("table_id")).dropDuplicates(["owner"])
    texts = doc.columns.where("default IS NOT NULL").select(object_id("schema", "object").alias("table_id"), "schema", "name", F.col("default").alias("body"))
    defaults = texts.join(bundle.columns.select("table_id", "name", F.col("column_id").alias("owner")), ["table_id", "name"]).select("owner", F.lit("default").alias("kind"), "schema", "body", none("language"), none("table_id"))
    work = written(union_all([views, triggers, routines, defaults]), "bodies")
    # what has no text is said to have none
    bodiless = union_all(
        [
            doc.objects.where("kind IN ('view', 'materialized-view') AND trim(coalesce(body, '')) = ''").select(object_id("schema", "name").alias("id")),
            doc.triggers.where("trim(coalesce(body, '')) = ''").select(object_id("schema", "object").alias("table_id"), "name").join(fires.join(member.drop("schema"), "id"), ["table_id", "name"]).select("id"),
            doc.routines.where("trim(coalesce(body, '')) = '' AND kind <> 'package'").select(routine_id().alias("id")).join(bundle.vertices.select("id"), "id", "left_semi"),
        ]
    ).distinct()

    # the names of the catalog go to every worker, so their number is checked first
    named = doc.objects.select(F.lit(1).alias("one")).unionAll(bundle.columns.select(F.lit(1))).unionAll(bundle.vertices.where("kind IN ('function', 'procedure', 'package')").select(F.lit(1))).count()
    dialect, database = header.get("dialect") or "", header.get("database")
    folds = dialect == "mysql" and header.get("lower_case_table_names") in (1, 2) or dialect == "sqlserver" and "_CI" in (header.get("collation") or "") and not (header.get("collation") or "").startswith(("Turkish", "Azeri"))
    members = bodies.select(F.col("o2").alias("id"), "member_of").where("id IS NOT NULL").dropDuplicates(["id"])
    if named > MOST_NAMES:
        told = _in_rounds(work, _facts(doc, bundle, members), dialect, database, folds)
    else:
        told = _with_all_names(doc, bundle, work, bodies, members, dialect, database, folds, cache)
    ids = bundle.vertices.select("id")
    edges = told.where("fact = 'edge'")
    real = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    ghosts = edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").select("owner", F.lit("SG_DML_GHOST_VERTEX").alias("code"), F.concat(F.lit("not a vertex: "), "dst").alias("message"), none("line", "int"), none("col", "int"), F.array().cast("array<string>").alias("candidates")).distinct()
    notes = told.where("fact = 'note'").select("owner", "code", "message", "line", "col", "candidates").unionByName(ghosts).withColumnRenamed("owner", "id")
    unsupported = told.where("fact = 'state' AND state = 'unsupported'").select(F.col("owner").alias("id"), F.lit(True).alias("lost"))
    notes = notes.join(unsupported, "id", "left").withColumn("code", F.when(F.col("lost") & (F.col("code") == "SG_BODY_PARTIAL"), "SG_BODY_UNSUPPORTED").otherwise(F.col("code"))).drop("lost")
    key = ["src", "dst", "kind"]
    return bundle.with_tables(
        edges=union_all([bundle.edges.select(*key), real.select(*key)]).distinct(),
        evidence=union_all([bundle.evidence, real.select(*key, F.lit("body-parse").alias("layer"), F.concat(F.lit("body of "), "owner").alias("detail")).distinct()]),
        origins=union_all([bundle.origins, real.select(*key, "body_hash", "role", "line", "col").distinct()]),
        limitations=union_all([bundle.limitations, told.where("fact = 'limit'").select(F.col("message").alias("note"))]),
        analysis=union_all([bundle.analysis, bodiless.select("id", F.lit("unsupported").alias("state"), F.lit("object").alias("scope"), none("body_hash")), told.where("fact = 'state'").select(F.col("owner").alias("id"), "state", "scope", "body_hash")]),
        diagnostics=union_all([bundle.diagnostics, bodiless.select("id", F.lit("SG_BODY_UNAVAILABLE").alias("code"), F.lit("the catalog gives no body").alias("message"), none("line", "int"), none("col", "int"), F.array().cast("array<string>").alias("candidates")), notes.select("id", "code", "message", "line", "col", "candidates")]),
    )


def _with_all_names(doc: Document, bundle: GraphBundle, work: DataFrame, bodies: DataFrame, members: DataFrame, dialect: str, database: str | None, folds: bool, cache: str | None) -> DataFrame:
    """FACTS of all bodies, each task with all names of the catalog."""
    objects = doc.objects.select("schema", "name", object_id("schema", "name").alias("id"), "kind").distinct().collect()
    columns = bundle.columns.select("table_id", "name", "column_id", "ordinal").orderBy("table_id", "ordinal").collect()
    calls = bundle.vertices.where("kind IN ('function', 'procedure', 'package')").select("schema", "name", "id").collect()
    inside = {r["owner"]: r["member_of"] for r in bodies.select(F.col("o2").alias("owner"), "member_of").where("owner IS NOT NULL").collect()}
    facts = [(r["schema"], r["name"], r["id"], r["kind"]) for r in objects], [(r["table_id"], r["name"], r["column_id"]) for r in columns], [(f"{r['schema']}.{inside[r['id']]}" if r["id"] in inside else r["schema"], r["name"], r["id"]) for r in calls]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        catalog = Catalog(dialect, database, folds)
        for schema, name, id_, kind in facts[0]:
            catalog.add_object(schema, name, id_, kind)
        outputs: dict[str, list[tuple[str, str]]] = {}
        for table, name, id_ in facts[1]:
            catalog.add_column(table, name, id_)
            outputs.setdefault(table, []).append((name, id_))
        for schema, name, id_ in facts[2]:
            catalog.add_routine(schema, name, id_)
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                catalog.touched.clear()
                rows += bind_body(catalog, r.owner, r.kind, r.schema, r.body, r.language, outputs.get(r.owner, []), r.table_id)
                if cache is not None:
                    rows += [_row(r.owner, "touch", x) for x in sorted(catalog.touched | {f"c|{r.owner}"})]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in FACTS.split(", ")])
            yield out.astype({"line": "Int64", "col": "Int64"})

    ship(bundle.spark)
    if cache is None:
        return written(work.repartition("owner").mapInPandas(run, FACTS), "facts")
    return _through_cache(cache, doc, bundle, work, members, run, f"{dialect}|{database}|{folds}")


def _facts(doc: Document, bundle: GraphBundle, members: DataFrame) -> DataFrame:
    """(key, part, a, b, c, d): what a catalog is made of, by the key under which a body looks it up (see ``catalog.name_key``)."""
    key = lambda part, *c: F.concat_ws("|", F.lit(part), *c).alias("key")
    row = lambda df, key, part, *c: df.select(key, F.lit(part).alias("part"), *(x.cast("string").alias(n) for x, n in zip(c, "abcd", strict=True)))
    none, col, low = F.lit(None), F.col, F.lower
    routines = bundle.vertices.where("kind IN ('function', 'procedure', 'package')").select("schema", "name", "id").join(members, "id", "left").withColumn("place", F.concat_ws(".", "schema", "member_of"))
    return union_all(
        [
            row(doc.objects, key("o", low("schema"), low("name")), "object", col("schema"), col("name"), object_id("schema", "name"), col("kind")).distinct(),
            row(doc.objects, key("s", col("schema")), "schema", col("schema"), none, none, none).distinct(),
            row(bundle.columns, key("c", col("table_id")), "column", col("table_id"), col("name"), col("column_id"), col("ordinal")),
            row(routines, key("r", low("place"), low("name")), "routine", col("place"), col("name"), col("id"), none),
        ]
    )


def _in_rounds(work: DataFrame, facts: DataFrame, dialect: str, database: str | None, folds: bool) -> DataFrame:
    """FACTS of all bodies without a whole catalog anywhere. A body is bound against the names it has been given, at first none; one that looks up others is bound
    again with them too, until it asks for nothing new: what it says then is what it says of the whole catalog. A row holds what one body asks for."""
    ship(work.sparkSession)
    columns = [c.split() for c in FACTS.split(", ")]
    types = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
    shape = pa.schema([(c, types[t]) for c, t in columns])

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], f.type) for n, f in enumerate(shape)], schema=shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for k in range(batch.num_rows):  # what one body was given is in Python at a time
                owner, kind, schema, body, language, table, have = (batch.column(c)[k].as_py() for c in ("owner", "kind", "schema", "body", "language", "table_id", "have"))
                catalog = Catalog(dialect, database, folds)
                outputs: list[tuple[str, str]] = []
                parts: dict[str, list] = {}
                for f in batch.column("found")[k].as_py():
                    parts.setdefault(f["part"], []).append(f)
                for f in parts.get("object", ()):
                    catalog.add_object(f["a"], f["b"], f["c"], f["d"])
                catalog.schemas.update(f["a"] for f in parts.get("schema", ()))
                for f in sorted(parts.get("column", ()), key=lambda f: (f["a"], -1 if f["d"] is None else int(f["d"]))):
                    catalog.add_column(f["a"], f["b"], f["c"])
                    if f["a"] == owner:
                        outputs.append((f["b"], f["c"]))
                for f in parts.get("routine", ()):
                    catalog.add_routine(f["a"], f["b"], f["c"])
                rows = bind_body(catalog, owner, kind, schema, body, language, outputs, table)
                asked = catalog.touched | ({f"c|{owner}"} if kind in ("view", "materialized-view") else set())
                if not asked <= set(have):
                    rows = [_row(owner, "touch", x) for x in sorted(asked.union(have))]
                held += rows
                if len(held) >= 10_000:
                    yield told(held)
                    held = []
        yield told(held)

    facts = written(facts, "catalog-facts")
    fact = F.struct("part", "a", "b", "c", "d")
    todo = work.withColumns({"have": F.array().cast("array<string>"), "found": F.array().cast("array<struct<part: string, a: string, b: string, c: string, d: string>>")})
    done: list[DataFrame] = []
    while True:
        bound = written(todo.repartition("owner").mapInArrow(run, FACTS), "facts")
        done.append(bound.where("fact <> 'touch'"))
        asked = bound.where("fact = 'touch'").select("owner", F.col("message").alias("key")).distinct()
        if asked.isEmpty():
            return union_all(done)
        given = asked.join(facts, "key", "left").groupBy("owner").agg(F.collect_set("key").alias("have"), F.collect_list(F.when(F.col("part").isNotNull(), fact)).alias("found"))
        todo = work.join(given, "owner")


def _names(doc: Document, bundle: GraphBundle, members: DataFrame) -> DataFrame:
    """(message, body_hash): everything that a body can look up, by the keys of ``catalog.name_key``, with a hash of what is found there."""
    key = lambda part, *c: F.concat(F.lit(f"{part}|"), F.concat_ws("|", *c))
    hash_ = lambda *c: F.xxhash64(F.to_json(F.struct(*c))).alias("h")
    low = F.lower
    routines = bundle.vertices.where("kind IN ('function', 'procedure', 'package')").select("schema", "name", "id").join(members, "id", "left").withColumn("place", F.concat_ws(".", "schema", "member_of"))
    every = union_all(
        [
            doc.objects.select(key("o", low("schema"), low("name")).alias("message"), hash_("schema", "name", "kind")),
            doc.objects.select(key("s", F.col("schema")).alias("message"), F.lit(1).cast("long").alias("h")).distinct(),
            bundle.columns.select(key("c", F.col("table_id")).alias("message"), hash_("name", "column_id", "ordinal")),
            routines.select(key("r", low("place"), low("name")).alias("message"), hash_("place", "name", "id")),
        ]
    )
    return every.groupBy("message").agg(F.concat_ws("|", F.count(F.lit(1)), F.sum(F.col("h").cast("decimal(38,0)"))).alias("body_hash"))


def _through_cache(folder: str, doc: Document, bundle: GraphBundle, work: DataFrame, members: DataFrame, run, settings: str) -> DataFrame:
    """FACTS of all bodies; one that the cache knows is bound again only if a name that it looked up, found or not, has changed since."""
    spark = bundle.spark
    work = written(bodycache.keyed(work, settings), "keyed-bodies")
    names = written(_names(doc, bundle, members), "names")
    known = bodycache.read(spark, folder, f"{FACTS}, key string")
    before = known.where("fact = 'name'").select("message", F.col("body_hash").alias("before"))
    changed = names.join(before, "message", "full").where(~F.col("body_hash").eqNullSafe(F.col("before"))).select("message")
    stale = known.where("fact = 'touch'").join(changed, "message", "left_semi").select("key").distinct()
    kept = written(known.where("fact <> 'name'").join(work.select("key"), "key", "left_semi").join(stale, "key", "left_anti"), "kept-facts")
    new = work.join(kept.select("key").distinct(), "key", "left_anti")
    bound = new.drop("key").repartition("owner").mapInPandas(run, FACTS)
    columns = [c.split()[0] for c in FACTS.split(", ")]
    shown = names.select(*(F.col(c) if c in ("message", "body_hash") else F.lit("name").alias(c) if c == "fact" else F.lit(None).cast(kind).alias(c) for c, kind in ((c, t) for c, t in (x.split() for x in FACTS.split(", ")))), F.lit("").alias("key"))
    # a body's facts bear its owner, and an owner has one body
    facts = union_all([kept.select(*columns, "key"), bound.join(new.select("owner", "key"), "owner").select(*columns, "key"), shown])
    return bodycache.publish(facts, folder).drop("key")
