"""The registered queries of the subpackage against their SQL, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

pytest.importorskip("plexus.llm")

from plexus.llm import decontaminate, queries
from plexus.llm.common import workspace

DATA = "/root/testdata/sf0.001"


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(r[k] for k in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(c[0] for c in want.description)
    assert _rows(got.columns, map(tuple, got.collect())) == _rows([c[0] for c in want.description], want.fetchall())


def test_short_items_and_many_candidates(spark):
    """Items of any number of words, one of them in every list of candidates, against the same SQL."""
    items = [(k, f"common start of item number x{k} y{k}") for k in range(150)] + [(200, "two words"), (201, "Lone"), (202, None), (203, "...")]
    docs = [(1, " ".join(t for _, t in items[:150])), (2, "here are Two, words!"), (3, "lone"), (4, None), (5, "common start of item number")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.execute("CREATE TABLE benchmark(item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    want = con.execute(queries.OP9_SQL)
    got = decontaminate.contained_items(d, i)
    assert _rows(got.columns, map(tuple, got.collect())) == _rows([c[0] for c in want.description], want.fetchall())


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        workspace(Session)
    Session.sparkContext.master = "local[4]"
    assert workspace(Session)


def test_items_that_share_a_passage_are_told_apart_by_what_is_rare(spark):
    """Sketches keep the rarest hashes: a document with the shared passage alone is no candidate, and no hit is lost."""
    passage = " ".join(f"w{k}" for k in range(12))
    items = spark.createDataFrame([(k, f"{passage} " + " ".join(f"own{k}x{j}" for j in range(12))) for k in range(60)], "item_id long, text string")
    index = decontaminate._rarest(decontaminate.sketches(items)).cache()
    held = index.groupBy("hash").count()
    assert held.where("count > 1").count() == 0 and index.select("item_id").distinct().count() == 60
    docs = spark.createDataFrame([(1, passage), (2, items.where("item_id = 7").first().text)], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contained_items(docs, items).collect()] == [(2, 7)]
