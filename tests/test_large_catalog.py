"""Bodies against a catalog of more names than are sent to a worker: bound in rounds, with the same facts."""

from __future__ import annotations

from plexus.plans import build as builder
from plexus.plans import view_corpus
from plexus.plans.sqlbind import enrich as enriching
from plexus.sources import document

TABLES = ("edges", "evidence", "origins", "analysis", "diagnostics", "limitations")


def test_a_catalog_beyond_the_bound_gives_the_same_facts(spark, monkeypatch):
    doc = document.from_value(spark, view_corpus.document())
    graph = builder.build(doc).saved()
    rows = lambda g: {t: sorted(map(repr, getattr(g, t).distinct().collect())) for t in TABLES}
    want = rows(enriching.enrich(doc, graph).saved(*TABLES))
    monkeypatch.setattr(enriching, "MOST_NAMES", 3)
    assert rows(enriching.enrich(doc, graph).saved(*TABLES)) == want and len(want["edges"]) > 100
