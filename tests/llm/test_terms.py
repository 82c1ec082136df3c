"""Terms of any look are scored by what they disclose."""

from __future__ import annotations

import pytest

pytest.importorskip("plexus.llm")

from plexus.llm import pii


def test_numbers_and_long_words_beside_an_identifier_are_found(spark):
    odd = ["4711-0815", "x" * 90, "1.5-b", "#77", "+9"]
    lines = [(i, f"{w} {' '.join(odd)} at jq@x.org it") for i, w in enumerate("alpha beta gamma delta".split())]
    lines += [(100 + i, f"at it line {i} of plain prose") for i in range(300)]
    docs = spark.createDataFrame(lines, "doc_id long, text string")
    terms = pii.disclosures(docs)
    assert {r.term for r in terms.collect()} == set(odd)
    clean = {r.doc_id: r.text for r in pii.sanitise(docs, terms).collect()}
    assert clean[0].split() == ["alpha", "at", "[EMAIL]", "it"]


def test_a_word_that_overlaps_an_identifier_is_no_term(spark):
    docs = spark.createDataFrame([(i, f"({i}) (jq@x.org), w{i}") for i in range(4)] + [(9 + i, f"prose {i}") for i in range(99)], "doc_id long, text string")
    assert pii.disclosures(docs).count() == 0
