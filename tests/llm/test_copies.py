"""Near duplicates, repeated passages and the pipeline, against brute force."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("plexus.llm")

from plexus.llm import components, simhash, suffix_dedup


def _classes(ids: list[int], links: list[tuple[int, int]]) -> dict[int, int]:
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(0, 60)]
    star = [(1000, 1000 + k) for k in range(1, 50)]
    links = [*chain[::-1], *star, (7, 7), (3, 4)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == _classes([*range(61), *range(1000, 1050)], links)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprint_bits():
    import xxhash

    words = "A b C d e f".split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).lower(), 42) for k in range(3)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 3)
    assert simhash.fingerprint("A  b\nC d e\tf") == want
    assert simhash.fingerprint("One two") == xxhash.xxh64_intdigest("one two", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


@pytest.mark.parametrize("d", [2, 4])
def test_no_link_is_lost(d):
    rng = np.random.default_rng(d)
    fps = set()
    for x in rng.integers(0, 1 << 63, 150, dtype=np.uint64).tolist():
        fps.add(x)
        for _ in range(5):
            for b in rng.choice(64, rng.integers(1, d + 3), replace=False).tolist():
                x ^= 1 << b
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    width = 2 * (d + 1)
    keys = simhash.bucket_keys(fps, d).ravel()
    order = np.argsort(keys, kind="stable")
    a, b = simhash.forest(keys[order], np.repeat(fps, width)[order], np.repeat(np.arange(len(fps)), width)[order], d)
    near = np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= d)
    ids = list(range(len(fps)))
    assert _classes(ids, zip(a.tolist(), b.tolist(), strict=True)) == _classes(ids, near.tolist())


def test_near_duplicates_of_awkward_rows(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon " * 20
    rows = [(5, base), (3, base), (9, base + " phi"), (9, base + " phi"), (1, None), (2, ""), (None, base), (None, "quite alone in the world here"), (4, "something else entirely, of no kin")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS rep", "3 AS key")
    got = simhash.near_duplicates(docs, 4).collect()
    assert len(got) == len(rows)
    of = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert of[5] == of[3] == 3 and of[1] == of[2] == 1 and of[4] == 4
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == ["3", "None"]
    assert simhash.near_duplicates(docs.limit(0), 4).count() == 0


def test_rows_without_an_id_link_others(spark, monkeypatch):
    """Fingerprints 0, 15, 255: 0 and 255 meet only through the row without an id."""
    prints = spark.createDataFrame([(1, 0), (None, 15), (3, 255)], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: prints)
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(prints, 4).collect()} == {(1, 1), (None, 1), (3, 1)}


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(40):
        base = rng.choice(words, 300).tolist()
        for _ in range(4):
            rows.append((len(rows) * 3, " ".join(base)))
            base[int(rng.integers(0, 300))] = "changed"
    rows += [(1, "long " * 150_000), (4, "long " * 150_001), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fps = [simhash.fingerprint(t) for _, t in rows]
    near = [(rows[a][0], rows[b][0]) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4]
    got = {r.doc_id: (r.fp & ((1 << 64) - 1), r.component_id) for r in simhash.near_duplicates(docs, 4).collect()}
    of = _classes([i for i, _ in rows], near)
    assert got == {i: (fp, of[i]) for (i, _), fp in zip(rows, fps, strict=True)} and len(near) > 40


def _brute(spans, length):
    seen = Counter(s[i : i + length] for s in spans for i in range(len(s) - length + 1))
    return [[seen[s[i : i + length]] > 1 for i in range(len(s) - length + 1)] for s in spans]


@pytest.mark.parametrize("length", [8, 16, 17, 39, 64, 100])
@pytest.mark.parametrize("stretch", [5, 1 << 16])
def test_refined_buckets(length, stretch, monkeypatch):
    whole = suffix_dedup.suffix_order
    monkeypatch.setattr(suffix_dedup, "suffix_order", lambda left, eight, enough: whole(left, eight, enough, stretch))
    rng = np.random.default_rng(length)
    base = bytes(rng.integers(97, 99, 900, dtype=np.uint8))
    spans = []
    for _ in range(30):
        a = int(rng.integers(0, 500))
        x = bytearray(base[a : a + length + int(rng.integers(0, 200))])
        if rng.random() < 0.6:
            x[rng.integers(0, len(x))] = 120
        spans.append(bytes(x))
    spans += [b"ab" * length, b"a" * (length + 30)]
    assert [h.tolist() for h in suffix_dedup.repeated_windows(spans, length)] == _brute(spans, length)
    assert [h.tolist() for h in suffix_dedup.repeated_windows([*spans, *spans], length)] == [h.tolist() for _ in range(2) for h in suffix_dedup.repeated_windows(spans, length, [2] * len(spans))]


def _removed(rows, length):
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(x[s : s + length] for _, x in raws for s in range(len(x) - length + 1))
    want = []
    for i, x in raws:
        gone = np.zeros(len(x) + 2, np.int8)
        for s in range(len(x) - length + 1):
            if seen[x[s : s + length]] > 1:
                gone[s + 1 : s + 1 + length] = 1
        rest = bytes(b for b, g in zip(x, gone[1:], strict=False) if not g)
        want.append((i, len(x), len(x) - len(rest), int((np.diff(gone) == 1).sum()), hashlib.sha256(rest).hexdigest()))
    return sorted(want, key=str)


@pytest.mark.parametrize("hot", [1, 3, 512])
def test_removal_against_brute_force(spark, hot):
    length, gram = 40, 16
    rng = np.random.default_rng(3)
    letters = "abcdefgh é"
    some = lambda n: "".join(rng.choice(list(letters), n))
    passage = some(150)
    texts = [some(60) + passage[:a] + some(30) for a in (45, 90, 150, 150, 38, 39, 40, 41)] + ["ab" * 60, "x" * 39, "x" * 40, "x" * 41, None, "", some(300)]
    rows = [*enumerate(texts), (99, passage), (99, passage), (None, "only here " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS spans")
    got = sorted(map(tuple, suffix_dedup.remove_repeats(docs, length, gram, hot=hot).collect()), key=str)
    assert got == _removed(rows, length)
    kept = suffix_dedup.remove_repeats(docs, length, gram, texts=True, hot=hot).where("doc_id = 14").first().kept
    assert bytes(kept) == texts[14].encode()
    assert suffix_dedup.remove_repeats(docs.limit(0), length, gram).count() == 0


@pytest.mark.parametrize("hot", [4, 512])
def test_removal_at_the_production_length(spark, hot):
    """400 bytes, anchors of 160: passages just below, at and above the length, changed bytes, copies, and a text longer than a piece."""
    rng = np.random.default_rng(4)
    some = lambda n: "".join(rng.choice(list("abcdefgh éß"), n))
    passage, long_ = some(900), some(140_000) + some(1_200) * 2 + some(300_000)
    rows = [(k, some(int(rng.integers(0, 300))) + passage[:n] + some(int(rng.integers(0, 300)))) for k, n in enumerate([330, 345, 350, 355, 360, 380, 420, 500, 700, 900, 900])]
    rows += [(20 + k, passage[: 40 * k] + "Z" + passage[40 * k + 1 :]) for k in range(1, 20)]
    rows += [(50, long_), (51, some(100) + long_[200_000:201_000]), (52, passage), (53, passage), (None, passage), (54, None), (55, "ab" * 600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, suffix_dedup.remove_repeats(docs, hot=hot).collect()), key=str) == _removed(rows, 400)


def test_a_long_text_is_cut_with_overlap():
    piece = suffix_dedup._PIECE
    text = bytes(np.random.default_rng(0).integers(97, 123, 2 * piece + 999, dtype=np.uint8))
    runs = sorted((lo, hi, p) for _, lo, hi, p in suffix_dedup.runs([text], 400, 160))
    assert runs[0][0] == 0 and runs[-1][1] == len(text) - 400
    assert all(a[1] + 1 == b[0] for a, b in zip(runs, runs[1:], strict=False))
    assert all(lo <= p + 160 and p <= hi + 240 and lo <= p for lo, hi, p in runs)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(0)
    words = [f"{a}{b}" for a in "ba ce di fo gu ra le mi so tu".split() for b in "na re si to lu ma ke".split()]
    prose = lambda n: " ".join(rng.choice(words, n))
    item = prose(30)
    rows = [(i, prose(80)) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(5)]  # copies
    rows += [(300, prose(50) + " " + item + " " + prose(50)), (301, prose(60) + " write to me@example.org now")]
    rows += [(400 + i, "BUY!! NOW!! " * 30 + prose(5)) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(i, 1, 0) for i in range(0, 120, 2)] + [(400 + i, 0, 0) for i in range(0, 60, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, ids = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        if k < 4:
            assert now.columns == list(corpus_pipeline.COLUMNS)
        ids.append({r.doc_id for r in now.collect()})
    assert ids[0] == {i for i, _ in rows if i < 400}
    assert ids[1] == ids[0] - {200, 201, 202, 203, 204}
    assert ids[2] == ids[1] - {300} == ids[3] == ids[4]
    clean = corpus_pipeline.sanitise(spark, docs.where("doc_id = 301"), str(tmp_path)).first()
    assert "[EMAIL]" in clean.text and clean.n_chars == len(clean.text)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == ids[4]
    with_gaps = docs.limit(3).union(spark.createDataFrame([(None, None, None, None, None), (500, None, None, None, None), (500, None, None, None, None)], docs.schema))
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, with_gaps, str(tmp_path)).collect()
        stage(spark, docs.limit(0), str(tmp_path)).collect()
