"""Packing, the Merkle manifest and vector codes against brute force and on awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

pytest.importorskip("plexus.llm")

from plexus.llm import merkle, packing, queries, vector_codes

DATA = "/root/testdata/sf0.001"

# -- packing ---------------------------------------------------------------------------------------------------------


def _ids(texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.TOKENIZER)
    return [[*e.ids, 2] for e in model.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def _pieces(rows, capacity):
    for (doc_id, _), ids in zip(rows, _ids([t for _, t in rows]), strict=True):
        first = (len(ids) - 1) % capacity + 1
        for p, a in enumerate([0, *range(first, len(ids), capacity)]):
            part = ids[a : first if p == 0 else a + capacity]
            yield doc_id, p, a, len(part), crc32(np.array(part, "<u4").tobytes())


def _check(got, rows, capacity):
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter(_pieces(rows, capacity))
    inside = defaultdict(list)
    for r in got:
        inside[r.sequence_id].append((r.offset, r.length))
    for own in inside.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(inside), -(-sum(r.length for r in got) // capacity)


def test_packing_query_against_the_library(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    used, least = _check(queries.op11_packing(spark, DATA).collect(), rows, 1024)
    assert least <= used <= 1.02 * least + 1


def test_packing_of_awkward_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "a b"), (3, "x " * 700), (3, "x " * 700), (4, "it's  a\n\nline don't\tαβγ café'll <|endoftext|> end"), (5, "word " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS part", "2 AS k", "'y' AS length", "3 AS ids")
    _check(packing.pack(docs).collect(), rows, 1024)
    _check(packing.pack(docs, capacity=50, groups=3).collect(), rows, 50)
    assert packing.pack(docs.limit(0)).count() == 0
    packed = packing.pack(docs, capacity=300, with_ids=True)
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids


def test_encoder_is_the_library():
    r = random.Random(1)
    bits = ["a", "b", "é", "ſ", "ŉ", " ", "  ", "\n", "\n\n", "\t", "'s", "'t", "'re", "'", "1", "23", "²", "½", "α", "語", "\x1c", "\x85", "\xa0", " ", ".", "!?", "_", "<|endoftext|>", "Ⅷ", "́", "the", "😀", "\r\n"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(1, 14))) for _ in range(8000)]
    encode = packing.Encoder(packing.TOKENIZER)
    for _ in range(2):
        assert [[*np.frombuffer(encode(t), "<u4").tolist(), 2] for t in texts] == _ids(texts)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(8, 200))
    lengths = rng.integers(1, capacity + 1, int(rng.integers(0, 3000))) if seed % 2 else np.minimum(rng.geometric(3 / capacity, 2000), capacity)
    counts = Counter(lengths.tolist())
    rows, n = packing.plan(counts, capacity, 7)
    seen, used = Counter(), defaultdict(list)
    for length, low, high, each, sequence, offset in rows.tolist():
        for k in range(low, high):
            seen[length, k] += 1
            used[sequence + (k - low) // each].append((offset + (k - low) % each * length, length))
    assert seen == Counter({(x, k): 1 for x, m in counts.items() for k in range(m)}) and len(used) == n
    for own in used.values():
        ends = [o + m for o, m in sorted(own)]
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= capacity
    assert n <= 1.25 * -(-int(lengths.sum()) // capacity) + 8


def test_configurations_solve_the_program():
    sizes, demands = [60, 50, 40, 30], [10, 20, 30, 40]
    found = packing.configurations(sizes, demands, 100)
    assert np.allclose(sum(a * x for a, x in found), demands) and all(a @ np.array(sizes) <= 100 for a, _ in found)
    assert math.isclose(sum(x for _, x in found), 40)  # 4000 in all: 10 of 60 + 40, 10 of 50 + 50, 20 of 40 + 30 + 30


# -- Merkle manifest -------------------------------------------------------------------------------------------------


def _tree(digests):
    """(root, proof of each) by plain recursion on lists."""
    proofs, at, level = [""] * len(digests), list(range(len(digests))), digests
    while len(level) > 1:
        for k, p in enumerate(at):
            own = level[p // 8 * 8 : p // 8 * 8 + 8]
            proofs[k] += "".join(x for j, x in enumerate(own) if j != p % 8)
        level = [merkle.H("".join(level[k : k + 8])) for k in range(0, len(level), 8)]
        at = [p // 8 for p in at]
    return level[0], proofs


def _manifest(rows):
    """rows: (group, id, leaf); the expected (id, leaf, subroot, root, proof) of each."""
    groups = defaultdict(list)
    for g, i, x in rows:
        groups[g].append((i is not None, i or 0, x, i))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: _tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    root, tops = _tree([trees[g][0] for g in order])
    return [(i, x, trees[g][0], root, own + tops[k]) for k, g in enumerate(order) for (_, _, x, i), own in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1], strict=True)]


@pytest.mark.parametrize("sizes, a_task", [([1], 10), ([8, 1], 4), ([700, 3, 9, 64, 65], 50), ([1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 200], 3), ([600], 1000)])
def test_manifest_against_lists(spark, sizes, a_task):
    rows = [(None if g == 0 else f"g{g}", None if k == 1 else k // 2, merkle.H(f"{g}-{k}")) for g, n in enumerate(sizes) for k in range(n)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame([(*r, None) for r in rows], "group string, id long, leaf string, changed string")
    got = merkle.manifest(df, a_task, full=True).collect()
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in got) == Counter(_manifest(rows))
    assert all(r.verified and r.folded_root == r.root and r.proof_sha256 == merkle.H(r.proof) for r in got)


def test_manifest_finds_changes(spark):
    rows = [(f"g{k % 3}", k, merkle.H(str(k)), merkle.H("other") if k % 5 == 0 else merkle.H(str(k)) if k % 5 == 1 else None) for k in range(300)]
    got = merkle.manifest(spark.createDataFrame(rows, "group string, id long, leaf string, changed string"), 20).collect()
    assert {r.doc_id for r in got if not r.verified} == {k for k in range(300) if k % 5 == 0}


def test_leaves_of_awkward_rows(spark):
    rows = [(None, None, None, None, None), (1, "Zoë", "web", "de", 3), (1, "Zoë", "web", "de", 3), (5, "", "", "", 0), (5, None, "web", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").selectExpr("*", "1 AS leaf", "2 AS `group`", "3 AS changed")

    def leaf(i, text, source, lang, n):
        return merkle.H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))

    got = merkle.document_leaves(docs).collect()
    assert [r.leaf for r in got] == [leaf(*r) for r in rows]
    low = [leaf(r[0], r[1].lower(), *r[2:]) if r[0] is not None and r[1] is not None and crc32(str(r[0]).encode()) % 3 == 0 else None for r in rows]
    assert [r.changed for r in got] == low
    assert merkle.manifest(merkle.document_leaves(docs)).count() == 5
    assert merkle.manifest(merkle.document_leaves(docs.limit(0))).count() == 0


# -- vector codes ----------------------------------------------------------------------------------------------------


def _coded(rows, rounds=2):
    kept = sorted(((i is None, i or 0, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda x: x[:3])
    ints = [[math.floor(x * 256) for x in v] for _, _, v, _ in kept]
    w = len(ints[0]) // 16
    part = lambda v, p: v[p * w : (p + 1) * w]
    books = [[part(v, p) for v in ints[:64]] for p in range(16)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min((far(part(v, p), e), k) for k, e in enumerate(books[p])) for p in range(16)] for v in ints]
    for _ in range(rounds):
        codes = assign()
        for p in range(16):
            for k in range(len(books[p])):
                own = [part(v, p) for v, c in zip(ints, codes, strict=True) if c[p][1] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    codes = assign()
    text = ",".join(str(x) for b in books for e in b for x in e)
    rows = [(None if no else i, "".join(f"{k:02x}" for _, k in c), sum(d for d, _ in c), label) for (no, i, _, label), c in zip(kept, codes, strict=True)]
    return rows, hashlib.sha256(text.encode()).hexdigest()


def test_vector_codes_of_awkward_rows(spark):
    rng = np.random.default_rng(13)
    rows = [(k, rng.normal(0, 1, 32).round(2).tolist(), None if k % 3 else k % 2) for k in range(150)]
    rows += [(7, rows[7][1], 1), (None, rows[9][1], 1), (200, None, 1), (201, [None] * 32, 1), (202, [math.nan] * 32, 1), (203, [math.inf] * 32, 1), (204, [1e30] * 32, 5), (205, [-1e12] * 32, 6)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, code int, vector string").repartition(5)
    coded, books = vector_codes.compress(df)
    want, digest = _coded(rows)
    assert vector_codes.codebooks_sha256(books) == digest
    most = (1 << 63) - 1
    got = vector_codes.with_label_error(coded).collect()
    assert Counter((r.vec_id, r.code, r.error, r.label) for r in got) == Counter((i, c, min(e, most), x) for i, c, e, x in want)
    sums = Counter()
    for _, _, e, x in want:
        sums[x] += min(e, most)
    assert all(r.label_error == min(sums[r.label], most) for r in got)
    assert np.allclose(vector_codes.decode(got[0].code, books).shape, (32,))


def test_vectors_of_other_lengths(spark):
    rows = [(1, [], 1), (2, [1.0] * 5, 1), (3, [0.5] * 16, 1), (4, [0.25] * 16, 1), (5, [0.5] * 32, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    coded, books = vector_codes.compress(df)
    assert {r.vec_id: (r.code, r.error) for r in coded.collect()} == {1: (None, None), 2: (None, None), 3: ("00" * 16, 0), 4: ("01" * 16, 0), 5: (None, None)}
    assert books.shape == (16, 2, 1)
    for few in (df.limit(0), df.where("vec_id = 1")):
        coded, books = vector_codes.compress(few)
        assert vector_codes.with_label_error(coded).where("code IS NOT NULL").count() == 0 and vector_codes.codebooks_sha256(books) == hashlib.sha256(b"").hexdigest()


def test_words_go_to_the_model_itself_with_the_library_s_ids(monkeypatch):
    """A run of Latin letters takes neither the library's batches nor its threads, and has the same ids."""
    import os

    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    encode = packing.Encoder(packing.TOKENIZER)
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
    sent, library = [], encode._encode
    monkeypatch.setattr(encode, "_encode", lambda texts: (sent.extend(texts), library(texts))[1])
    words = "plain Straßenbahn çtreeau ſtätte Ÿpsilon ÀÖØöøÿ einüver x qzxqvjkw"
    odd = "it's  two\nlines 日本 naïve2x ×÷ é 12 don't stop ... (a)b"
    for text in (words, odd, words + odd, " " + words, odd + " " + words):
        assert encode(text) == library([text])[0]
    assert not set(sent) & {"plain", *(" " + w for w in words.split())} and sent
