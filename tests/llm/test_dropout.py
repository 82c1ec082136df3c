"""Merge dropout draws for each occurrence of a word."""

from __future__ import annotations

import numpy as np
import pytest

pytest.importorskip("plexus.llm")

from plexus.llm import sentencepiece_codec as codec


def test_equal_words_of_a_text_are_cut_by_their_own_draws():
    c = codec.Codec(codec.MODEL)
    units = [" international", " of", "x" * 60, "▁", " understanding", "é"] * 400
    units += [" " + "abcdefghijklmnopqrstuvwxyz"[k % 20 :] + "tionsing" * 2 for k in range(600)]
    bases = codec._bases(77, len(units))
    limit = int(0.1 * (1 << 64))
    got = c.occurrences(units, bases, 0.1)
    want = [codec._packed(c.unit(u) if u == "▁" else c._named(s for s in c._long(u, limit, int(b)) if s)) for u, b in zip(units, bases, strict=True)]
    assert got == want
    assert len(set(got[0:2400:6])) > 4  # within one text, and more than the four variants there were
    plain = codec._packed(c.unit(" of"))
    assert 0 < np.mean([g != plain for g in got[1:2400:6]]) < 0.5


def test_documents_differ_and_runs_agree():
    c = codec.Codec(codec.MODEL)
    text = "international understanding of words " * 20
    many = c.encode_many([text] * 50, 0.1, 2, list(range(50)))
    assert len(set(many)) == 50
    assert many == codec.Codec(codec.MODEL).encode_many([text] * 50, 0.1, 2, list(range(50)))


def test_a_unit_is_kept_from_its_second_meeting_on_with_the_same_pieces():
    """A word met once is cut with its own draws and not kept; kept or not, it has the same pieces."""
    own = codec.Codec(codec.MODEL)
    texts = ["unheardofness again again", "unheardofness once more"]
    first = own.encode_many(texts[:1], 0.3, 2, [7])
    assert " unheardofness" not in own.known and " again" in own.known
    second = own.encode_many(texts[1:], 0.3, 2, [8])
    assert " unheardofness" in own.known
    assert own.encode_many(texts, 0.3, 2, [7, 8]) == [*first, *second]
    assert [own.decode(np.frombuffer(x, np.int32).tolist()) for x in (*first, *second)] == texts


def test_units_cut_together_equal_units_cut_alone():
    """All widths at once, letters outside the vocabulary and outside the first plane included, with and without dropout."""
    rng, own = np.random.default_rng(5), codec.Codec(codec.MODEL)
    letters = list("etaoinshr dlu,.ÄßЖ中𝄞\ud800")
    units = sorted({" " + "".join(rng.choice(letters, n)).replace(" ", "") for n in range(1, codec.LONGEST) for _ in range(30)})
    for rate in (0.0, 0.1, 0.9):
        together = own.units(units, rate, 11)
        assert all(np.frombuffer(together[u], np.int32).tolist() == own.unit(u, rate, 11) for u in units)
