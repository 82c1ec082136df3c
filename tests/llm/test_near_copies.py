"""Near copies of word shingles against brute force, and by row in the pipeline's stage."""

from __future__ import annotations

import numpy as np
import pytest

pytest.importorskip("plexus.llm")

from plexus.llm import near_copies

RNG = np.random.default_rng(3)


def _prose(n: int) -> list[str]:
    return [f"w{k}" for k in RNG.integers(0, 5000, n)]


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_edited_copies_leave_and_others_stay(spark, tmp_path):
    import corpus_pipeline

    rows, copies, others = [], set(), set()
    for k in range(40):
        base = _prose(200)
        rows.append((k, " ".join(base)))
        for at, (into, cuts) in enumerate(((copies, (20, 100, 180)), (others, range(5, 200, 12)))):
            edited = list(base)
            for c in cuts:
                edited[c] = "changed"
            similarity = near_copies.jaccard(near_copies.words_of(" ".join(base)), near_copies.words_of(" ".join(edited)))
            assert (similarity >= 0.8) == (at == 0)
            into.add(1000 * (at + 1) + k)
            rows.append((1000 * (at + 1) + k, " ".join(edited)))
    kept = {r.doc_id for r in corpus_pipeline.deduplicate(spark, _docs(spark, rows), str(tmp_path)).collect()}
    assert not kept & copies and kept == set(range(40)) | others


def test_a_large_group_is_one_class(spark, tmp_path):
    import corpus_pipeline

    base = _prose(300)
    rows = [(k, " ".join([*base, f"tail{k}"])) for k in range(100)]
    assert [r.doc_id for r in corpus_pipeline.deduplicate(spark, _docs(spark, rows), str(tmp_path)).collect()] == [0]


def test_unique_rows_without_or_with_equal_ids_stay(spark, tmp_path):
    import corpus_pipeline

    a, b, c, d, e = (" ".join(_prose(60)) for _ in range(5))
    item = " ".join(_prose(30))
    rows = [(None, a), (1, a), (None, b), (None, c), (7, d), (7, e), (7, e), (None, item + " " + b)]
    docs = _docs(spark, rows)
    kept = sorted((str(r.doc_id), r.text) for r in corpus_pipeline.deduplicate(spark, docs, str(tmp_path)).collect())
    assert kept == sorted([("1", a), ("None", b), ("None", c), ("7", d), ("7", e), ("None", item + " " + b)])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = sorted((str(r.doc_id), r.text) for r in corpus_pipeline.decontaminate_stage(spark, docs, str(tmp_path)).collect())
    assert kept == sorted((str(i), t) for i, t in rows[:-1])


def test_a_large_bucket_of_single_nodes_loses_no_pair(spark):
    """2000 nodes of one bucket, all of classes of their own, far copies of one text and some near copies of these: all pairs of 0.8 and few others."""
    base, rows, near = _prose(120), [], set()
    for k in range(1000):
        edited = list(base)
        for c in RNG.choice(120, 12, replace=False):
            edited[c] = f"x{k}-{c}"
        rows.append((2 * k, " ".join(edited)))
        edited[int(RNG.integers(0, 120))] = "other"
        rows.append((2 * k + 1, " ".join(edited)))
    near = {(2 * k, 2 * k + 1) for k in range(1000) if near_copies.jaccard(rows[2 * k][1].split(), rows[2 * k + 1][1].split()) >= 0.8}
    some = [(a, b) for a in range(0, 2000, 40) for b in range(a + 2, 2000) if near_copies.jaccard(rows[a][1].split(), rows[b][1].split()) >= 0.8]
    keyed = spark.createDataFrame([(1, k, 0, 2000) for k, _ in rows], "key long, rep long, fp long, n long")
    texts = spark.createDataFrame(rows, "row long, text string")
    none = spark.createDataFrame([], "node long, component long")
    got = {(r.a, r.b) for r in near_copies._across(near_copies._rest(keyed, none, texts), none).collect()}
    assert near | set(some) <= got and len(near) > 900 and len(got) < 20_000


def test_classes_of_one_bucket_equal_all_pairs(spark, monkeypatch):
    """All in one bucket whose anchors link little: several groups of near copies of copies, and lone far ones."""
    monkeypatch.setattr(near_copies, "bands_of", lambda h: [7])
    base, rows = _prose(150), []
    for g in range(12):
        first = list(base)
        for c in RNG.choice(150, 15, replace=False):
            first[c] = f"g{g}-{c}"
        for _ in range(1 + g):
            first[int(RNG.integers(0, 150))] = f"n{len(rows)}"
            rows.append((len(rows), len(rows), " ".join(first)))
    up = list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if near_copies.jaccard(rows[a][2].split(), rows[b][2].split()) >= 0.8:
                x, y = sorted((top(a), top(b)))
                up[y] = x
    got = {r.row: r.component for r in near_copies.classes(spark.createDataFrame(rows, "row long, doc_id long, text string")).collect()}
    assert got == {k: top(k) for k in range(len(rows))} and len(set(got.values())) >= 12


def test_the_search_is_by_simhash_and_finds_what_brute_force_finds():
    """Each bit is what most shingles of the set have; pairs of 0.8 and more share a block and are near, far ones hardly ever."""
    h = np.unique(RNG.integers(0, 1 << 64, 77, dtype=np.uint64))
    words = near_copies.signs(h)
    alone = np.array([near_copies.signs(h[k : k + 1]) for k in range(len(h))])
    bits = lambda w: np.unpackbits(np.ascontiguousarray(w).view(np.uint8).reshape(-1, 8 * len(words)), axis=1, bitorder="little")
    assert (bits(words)[0] == (2 * bits(alone).sum(axis=0, dtype=int) > len(h))).all()
    assert near_copies.bands_of(words)[1] == 1 << near_copies.WIDTH | (int(words[0]) >> near_copies.WIDTH & (1 << near_copies.WIDTH) - 1)
    found, near, far = 0, 0, 0
    for _ in range(150):
        base = _prose(200)
        edited = list(base)
        for c in RNG.choice(40, 2, replace=False):
            edited[5 * c + 2] = "changed"
        edited[60:60] = _prose(6)
        a, b, c = (near_copies.shingles(near_copies.words_of(" ".join(t))) for t in (base, edited, _prose(200)))
        if len(np.intersect1d(a, b)) < 0.8 * len(np.union1d(a, b)):
            continue
        near += 1
        keys = [np.array(near_copies.bands_of(near_copies.signs(x)), np.int64) for x in (a, b, c)]
        own = [near_copies.signs(x)[-near_copies.CHECK :] for x in (a, b, c)]
        key, rep = np.concatenate(keys), np.repeat(np.arange(3), near_copies.BLOCKS)
        order = np.argsort(key)
        pairs, members = near_copies.bucket_links(key[order], rep[order], np.array(own)[rep[order]])
        got = {tuple(sorted(p)) for p in np.concatenate(pairs, axis=1)[:2].T.tolist()}
        found, far = found + ((0, 1) in got), far + len(got - {(0, 1)})
        assert not members
    assert near > 100 and found == near and far == 0


def test_pairs_of_a_large_group_stay_few(spark, monkeypatch):
    """600 near copies: few pairs a node are verified, however the group falls into buckets, and all are one class."""
    verified, counts = near_copies._verified, []
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, *rest: (counts.append(pairs.count()), verified(pairs, *rest))[1])
    base, rows = _prose(200), []
    for k in range(600):
        edited = list(base)
        for c in RNG.choice(200, 2, replace=False):
            edited[c] = f"x{k}-{c}"
        rows.append((k, k, " ".join(edited)))
    got = {r.component for r in near_copies.classes(spark.createDataFrame(rows, "row long, doc_id long, text string")).collect()}
    assert len(got) == 1 and sum(counts) <= 10 * len(rows)


def test_parities_never_rule_out_a_similar_pair():
    """Sets of few and of very many shingles; of pairs a little below the similarity a good part is ruled out, of those that reach it none."""
    kept = {True: [], False: []}
    for n in [*RNG.integers(1, 400, 400).tolist(), 70_000, 90_000]:
        base = RNG.integers(0, 1 << 64, n, dtype=np.uint64)
        for share in (0.02, 0.1, 0.2, 0.3):
            x, y = (np.r_[base[int(n * cut) :], RNG.integers(0, 1 << 64, int(n * new), dtype=np.uint64)] for cut, new in ((0, 0), (share * RNG.random(), share * RNG.random())))
            similar = len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y))
            kept[similar].append(bool(near_copies.may_be_similar(*(near_copies.marks(z)[None] for z in (x, y)), 0.8)[0]))
    assert all(kept[True]) and len(kept[True]) > 800 and np.mean(kept[False]) < 0.7


def test_pairs_of_a_large_group_below_the_similarity_are_not_made(spark, monkeypatch):
    """400 edited copies of one text that are mostly unlike each other by a little: few pairs are verified, and the classes equal all pairs."""
    verified, counts = near_copies._verified, []
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, *rest: (counts.append(pairs.count()), verified(pairs, *rest))[1])
    base, rows = _prose(150), []
    for k in range(400):
        edited = list(base)
        for c in RNG.choice(150, 3 + k % 2, replace=False):
            edited[c] = f"x{k}-{c}"
        rows.append((k, k, " ".join(edited)))
    sets = [set(near_copies.shingles(near_copies.words_of(t)).tolist()) for _, _, t in rows]
    up = list(range(400))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(400):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    got = {r.row: r.component for r in near_copies.classes(spark.createDataFrame(rows, "row long, doc_id long, text string")).collect()}
    assert got == {k: top(k) for k in range(400)} and len(set(got.values())) > 10
    assert sum(counts) <= 8 * len(rows)


def test_stars_need_no_round(spark, monkeypatch):
    from plexus.llm import components

    monkeypatch.setattr(components, "_large_star", lambda edges: pytest.fail("a round over stars"))
    got = {r.node: r.component for r in components.components(spark.createDataFrame([(5, 1), (1, 7), (9, 8), (8, 8)], "a long, b long")).collect()}
    assert got == {1: 1, 5: 1, 7: 1, 8: 8, 9: 8}


def test_further_links_touch_only_their_classes(spark, monkeypatch):
    """Chains of 40 nodes each, then links between some of them and new nodes: the classes of all links, by rounds over the further links alone."""
    from plexus.llm import components

    first = [(100 * c + k, 100 * c + k + 1) for c in range(1, 9) for k in range(39)]
    further = [(139, 205), (220, 301), (301, 5), (5, 777), (420, 999), (999, 998), (510, 530)]
    frame = lambda x: spark.createDataFrame(x, "a long, b long")
    told = lambda df: sorted((r.node, r.component) for r in df.collect())
    found, want = components.components(frame(first)), told(components.components(frame(first + further)))
    large, rows = components._large_star, []
    monkeypatch.setattr(components, "_large_star", lambda edges: (rows.append(edges.count()), large(edges))[1])
    assert told(components.extended(found, frame(further))) == want
    assert max(rows) <= len(further)
    assert told(components.extended(frame([]).toDF("node", "component"), frame(first))) == told(components.components(frame(first)))


def test_tidy_gives_freed_memory_back(spark):
    import ctypes
    import re
    from pathlib import Path

    from plexus.llm import common

    if not hasattr(ctypes.CDLL(None), "malloc_trim"):
        pytest.skip("another libc")
    resident = lambda: int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024
    common.tidy(spark)
    held = [np.ones(50_000, np.uint8) for _ in range(2000)]  # 100 MB, none large enough for a mapping of its own
    full, last = resident(), held[-1]
    del held
    common.tidy(spark)
    assert full - resident() > 60 and last.all()
