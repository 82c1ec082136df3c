"""Operators that judge each text by itself, against plain re-computations and on awkward rows."""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("plexus.llm")

from plexus.llm import chat_format, decontaminate, language_id, lm_score, pii, quality_classifier, quality_rules, sentencepiece_codec
from plexus.llm.common import ids_and_texts
from pyspark.sql import functions as F

LONG = "wort und wort " * 6000
ROWS = [
    (1, "The cat sat on the mat. The cat sat on the mat. The cat sat on the mat.", "en"),
    (2, None, None),
    (3, "", "en"),
    (4, "  \n\t ", "de"),
    (5, LONG, "de"),
    (6, "mail a@b.co and +1 (555) 123-4567, 4111 1111 1111 1111 at 10.0.0.255 😀 é", "en"),
    (6, "mail a@b.co and +1 (555) 123-4567, 4111 1111 1111 1111 at 10.0.0.255 😀 é", "en"),
    (None, "no id here at all, only some words", "en"),
    (7, "12345 67890 !!! ---", None),
]
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    # names that the operators use inside must not get in the way
    return spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 AS key", "'x' AS spans", "2 AS fp", "'y' AS __pii_email", "3 AS rid")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_rules_match_a_plain_count(docs, empty):
    rows = quality_rules.apply_policy(quality_rules.ledger(docs), "v2").collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        text = next(t for i, t, _ in ROWS if i == r.doc_id) or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        assert r.n_words == len(words) and r.word_chars == sum(map(len, words))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text)
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        again = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)} if len(words) < 99 else set(range(len(words)))
        assert r.n_repeat_words == len(again)
    assert quality_rules.ledger(empty).count() == 0


def test_rule_ablations_follow_from_the_ledger(docs):
    rows = quality_rules.ledger(docs)
    bits = [r.fail_bits for r in rows.collect()]
    mask = quality_rules.mask_of("v1")
    for r in quality_rules.ablations(rows, "v1").collect():
        bit = 1 << next(x.bit for x in quality_rules.RULES if x.name == r.rule)
        assert r.n_failed == sum(b & bit > 0 for b in bits)
        assert r.n_failed_alone == sum(b & mask == bit for b in bits)
        assert r.n_kept_without == sum(b & mask & ~bit == 0 for b in bits)


PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1])) % 10 == 0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}
TRICKY = ["a@b.c_d@e.f x@y.zz", "1.2.3.4.5.6.7.8 999.1.1.1 0255.0.0.255", "4111 1111 1111 1111 é 4111-1111-1111-1112 😀 4111111111111111", "@@ a@b a@b.c. .@x.y", "x" * 3000 + "@a.b", "1" * 5000, "+1" * 50 + " +123456789012345678", "f%b@x-y.co.uk,me@a.b-c.d"]


def test_identifiers_match_the_plain_patterns(spark, docs, empty):
    extra = spark.createDataFrame([(100 + k, t) for k, t in enumerate(TRICKY)], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(extra)
    nothing = spark.createDataFrame([], "term string, disclosure double")
    for r in pii.report(both, nothing).join(both, "doc_id").collect():
        plain = [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in PLAIN.items() for m in re.finditer(p, r.text or "") if ok(m[0])]
        assert r.spans == ",".join(plain)
        assert r.base_sha256 == hashlib.sha256(",".join(plain).encode()).hexdigest()
    assert pii.report(empty, nothing).count() == 0 and pii.disclosures(empty).count() == 0


def _plain_disclosures(rows, support, reach):
    """The pairs above 0.7, counted without Spark."""
    lines = Counter(line for _, t in rows for line in (t or "").split("\n"))
    total = sum(lines.values())
    n_entity, n_term, both, seen, on = Counter(), Counter(), Counter(), Counter(), Counter()
    for line, n in lines.items():
        found = [(f"{k}:{v}", m.start(), m.end()) for k, (p, ok) in PLAIN.items() for m in re.finditer(p, line) if ok(m[0]) for v in ("*", m[0].lower() if k == "email" else m[0] if k == "ip" else re.sub("[^0-9]", "", m[0]))]
        words = [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", line)]
        n_term.update({w: n for w in {w for w, _, _ in words}})
        free = [w for w in words if all(w[2] <= s or e <= w[1] for _, s, e in found)]
        for entity in {f[0] for f in found}:
            n_entity[entity] += n
            on[entity] += 1
            for w in {w for w, a, b in free if any(f[0] == entity and b >= f[1] - reach and a <= f[2] + reach for f in found)}:
                both[entity, w] += n
                seen[entity, w] += 1
    out = {}
    for (entity, w), n in both.items():
        ic = math.log2(total / n_entity[entity])
        share = math.log2(n / n_term[w] * total / n_entity[entity]) / ic if ic > 0 else 0
        if seen[entity, w] >= support and on[entity] >= support and share >= 0.7:
            out[entity, w] = share
    return out


def test_disclosure_is_that_of_a_plain_count(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(60)] + ["Ann", "Bob", "desk"] * 3
    rows = []
    for i in range(400):
        line = rng.choices(words, k=12)
        if i % 4 == 0:
            line.insert(rng.randrange(12), rng.choice(["a@x.org", "b@x.org near Ann", "Bob 10.0.0.1", "+1 555 123 4567 desk desk"]))
        rows.append((i, " ".join(line) + ("\n" + " ".join(rng.choices(words, k=40)) if i % 3 else "")))
    rows += [(1000 + i, rows[0][1]) for i in range(30)] + [(2000, None), (2001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS entity")
    got = {(r.entity, r.term): r.disclosure for r in pii.disclosures(docs, support=2, reach=30).collect()}
    want = _plain_disclosures(rows, 2, 30)
    assert want and got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_terms_that_give_an_entity_away_are_treated(spark):
    lines = [(i, f"{w} ask Jonquil at jq@x.org about it {w}{i}") for i, w in enumerate("alpha beta gamma delta eps zeta".split())]
    lines += [(100 + i, f"ask at about it line {i} of plain prose") for i in range(300)]
    docs = spark.createDataFrame(lines, "doc_id long, text string")
    terms = pii.disclosures(docs)
    found = {(r.entity, r.term): r.disclosure for r in terms.collect()}
    assert set(found) == {("email:jq@x.org", "Jonquil"), ("email:*", "Jonquil")} and min(found.values()) > 0.9
    more = docs.union(spark.createDataFrame([(900, "Jonquil is a flower too"), (901, "ip 10.0.0.1 and Jonquil")], docs.schema))
    clean = {r.doc_id: r.text for r in pii.sanitise(more, terms).collect()}
    assert clean[0] == "alpha ask  at [EMAIL] about it alpha0"
    assert clean[100] == lines[6][1]
    # the term is treated where it stands with what it gives away, not elsewhere
    assert clean[900] == "Jonquil is a flower too" and clean[901] == "ip [IP] and Jonquil"
    assert pii.sanitise(docs, terms).columns == docs.columns
    row = pii.report(docs, terms).where("doc_id = 0").first()
    assert row.spans == "email:21:29,drop:10:17" and row.n_drop == 1
    # no Python below these plans
    assert "Python" not in pii.sanitise(docs, terms)._jdf.queryExecution().toString()


def test_secrets_are_found_beside_the_base_kinds(spark):
    docs = spark.createDataFrame([(1, 'api_key = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" ok'), (2, "x" * 60), (3, "1" * 60)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.report(docs, pii.disclosures(docs)).collect()}
    assert [rows[k].n_secret for k in (1, 2, 3)] == [1, 0, 0] and rows[1].spans == "secret:11:51"
    assert rows[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.sanitise(docs, pii.disclosures(docs)).where("doc_id = 1").first().text == 'api_key = "[SECRET]" ok'


def test_pieces_are_those_of_the_library_and_decode(spark, docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    c = sentencepiece_codec.Codec(sentencepiece_codec.MODEL)
    texts = [t for _, t, _ in ROWS if t is not None] + ["a  b", " a", "\n x", "日本語 テスト", "\x00\x01", "a" * 300, "\r\n"]
    for t in texts:
        assert c.encode(t) == sp.encode(t)
        for variant in range(3):
            ids = c.encode(t, 0.4, 1, variant)
            assert c.decode(ids) == t and ids == sentencepiece_codec.Codec(sentencepiece_codec.MODEL).encode(t, 0.4, 1, variant)
    assert c.decode(c.encode("▁a▁ b", 0.5)) == "▁a▁ b"
    assert len({tuple(c.encode("international understanding", 0.3, 2, v)) for v in range(8)}) > 1
    units = sorted({u for t in texts for u in sentencepiece_codec._UNITS(" " + t)})
    assert c.units(units, 0.3, 9) == {u: sentencepiece_codec._packed(c.unit(u, 0.3, 9)) for u in units}
    rows = sentencepiece_codec.encode(docs)
    assert all(r.lossless for r in rows.collect()) and [r.ids for r in rows.where("doc_id = 2").collect()] == [None]
    assert sorted(r.text or "" for r in sentencepiece_codec.decode(rows).collect()) == sorted(t or "" for _, t, _ in ROWS)
    assert sentencepiece_codec.encode(empty).count() == 0


def test_suffix_tree_counts_and_sums(spark, docs, empty):
    rows = {(r.doc_id): r for r in lm_score.score(docs, F.col("doc_id").isNotNull()).collect()}
    low = lambda t: (t or "").encode().lower().split() + [b" "]
    c = Counter(w for i, t, _ in ROWS if i is not None for w in low(t))
    n, v = sum(c.values()), len(c)
    for i, t, _ in ROWS:
        words, r = low(t), rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(c[w] > 0 for w in words), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)
        assert r.score <= 0
    assert lm_score.score(empty, F.lit(True)).count() == 0
    untaught = {r.doc_id: r for r in lm_score.score(docs, F.lit(False)).collect()}
    assert untaught[1].n_tokens == 19 and untaught[1].score == 0.0


def _plain_scores(texts, taught, tree, divergence):
    """Scores with the sent part's own say, and contexts of rare words counted one by one."""
    low = lambda t: [*(t or "").encode().lower().split(), b" "]
    counts = Counter(w for k, t in enumerate(texts) if taught(k) for w in low(t))
    place = lambda w: lm_score.END if w == b" " else tree.places.get(w, lm_score.OTHER)
    q = lambda w: (counts[w] + 1) / tree.whole
    is_rare = lambda w: place(w) == lm_score.OTHER
    typical = tree.other / (sum(map(is_rare, counts)) + 1)
    said, follow, logs = [], {}, {}
    for k, t in enumerate(texts):
        words = low(t)
        said.append(lm_score.symbol_scores(tree, np.array([lm_score.START, *map(place, words)]))[1:] / np.array([tree.other if is_rare(w) else 1.0 for w in words]))
        for i in range(1, len(words)):
            if is_rare(words[i - 1]) and taught(k):
                follow.setdefault(words[i - 1], Counter())[words[i]] += 1
                logs.setdefault((words[i - 1], words[i]), []).append(math.log10(said[-1][i]))
    kept = set()
    for c, seen in follow.items():
        guess = {w: 10 ** (sum(logs[c, w]) / len(logs[c, w])) * (typical if is_rare(w) else 1) for w in seen}
        if seen.total() >= 2 and sum(x / seen.total() * math.log2(x / seen.total() / guess[w]) for w, x in seen.items()) >= divergence:
            kept.add(c)
    out = []
    for k, t in enumerate(texts):
        words, total = low(t), 0.0
        for i, w in enumerate(words):
            p = said[k][i] * (q(w) if is_rare(w) else 1.0)
            if i and words[i - 1] in kept:
                seen = follow[words[i - 1]]
                p = (seen[w] + len(seen) * p) / (seen.total() + len(seen))
            total += math.log10(p)
        out.append(total)
    return out


def test_shuffled_contexts_against_a_plain_tree(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(25)]
    texts = [" ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(25)], k=rng.randrange(0, 40))) for _ in range(120)]
    odd = "quite rare words that stand here only twice in all of the texts"
    texts += [odd, odd, odd + " but once", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    taught = lambda k: k % 5 != 1
    limits = {"p_context": 0.01, "p_symbol": 0.03, "divergence": 0.05}
    learn = docs.where("doc_id % 5 <> 1")
    tree = lm_score.fit(learn, lm_score._count_words(learn, 0.03), **limits)
    got = {r.doc_id: r for r in lm_score.score(docs, F.col("doc_id") % 5 != 1, **limits).collect()}
    want = _plain_scores(texts, taught, tree, 0.05)
    assert all(abs(got[k].score - want[k]) <= 1e-3 * got[k].n_tokens for k in range(len(texts)))
    assert got[120].score > got[120].base_score + 5  # what stands twice is known by its contexts


def test_rare_contexts_are_distributions():
    word = np.array([5, 5, 5, 5, 9, 9], np.int64) * 10**9
    after = np.array([2, 7, 7, 10**12, 7, 8], np.int64)
    n, a, b = lm_score.rare_contexts(word, after, np.array([1.0, 1, 1, 1, 1, 0]), np.full(6, -2.0), 1e-9, 100)
    assert n.tolist() == [4, 4, 4, 4, 1, 1] and a[4:].tolist() == [0, 0] and np.allclose(b[4:], 0.01)  # once is not enough
    assert np.allclose(a[:4], [1 / 7, 2 / 7, 2 / 7, 1 / 7]) and np.allclose(b[:4], 3 / 7 * 0.01)  # seen 4/7, the suffix's distribution 3/7


def test_suffix_tree_is_a_distribution(spark):
    texts = ["a b a b a c", "a b a b a b", "c a b", "b b a c a"] * 30
    train = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tree = lm_score.fit(ids_and_texts(train), lm_score._count_words(ids_and_texts(train)))
    assert tree.levels and len(tree.levels[0].codes)
    for level, depth in zip(tree.levels, (1, 2, 3), strict=False):
        for code in level.codes:
            context = [int(code) // tree.size**k % tree.size for k in range(depth - 1, -1, -1)]
            lead = [] if context[0] == lm_score.START else [lm_score.START, lm_score.OTHER]
            p = sum(lm_score.symbol_scores(tree, np.array([*lead, *context, s, lm_score.END]))[len(lead) + depth] for s in range(lm_score.END, tree.size))
            assert math.isclose(p, 1.0, rel_tol=1e-9)


def test_language_is_learned_from_other_documents(spark, empty, monkeypatch):
    words = {"en": "the of and that with from house water", "de": "der und die nicht haus wasser über für", "fr": "le des une pour avec maison eau était"}
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(words[lang].split(), 30)), lang) for i, lang in enumerate(["en", "de", "fr"] * 60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    net = language_id.fit(docs.where(~held))
    got = {r.doc_id: r for r in language_id.predict(docs, net).collect()}
    test = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert sum(got[i].lang_pred == lang for i, _, lang in test) >= 0.95 * len(test)
    assert all(0 <= r.score <= 1 for r in got.values())
    odd = {r.doc_id: r.lang_pred for r in language_id.predict(spark.createDataFrame(ROWS, SCHEMA), net).collect()}
    assert odd[2] == odd[3] == odd[4] == odd[7] == "und" and odd[5] in words
    long_text = spark.createDataFrame([(1, "der und haus nicht " * 3000, None)], SCHEMA)
    assert language_id.predict(long_text, net).first().lang_pred == "de"
    assert len(language_id.label_positions(net, "der und")) == 7
    assert language_id.fit(empty) is None and {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}

    few = language_id.fit(docs.where("lang <> 'fr' OR doc_id < 20"), langs=2)  # of more labels than are learned the commonest
    assert few.langs == ["de", "en"]
    many = spark.createDataFrame([(i, f"text number {i}", f"x{i % 300}") for i in range(600)], SCHEMA)
    monkeypatch.setattr(language_id, "train", functools.partial(language_id.train, steps=3))
    net = language_id.fit(many)
    assert len(net.langs) == 300 and language_id.predict(many, net).where("score BETWEEN 0 AND 1").count() == 600


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    d = language_id.Direction(rng.standard_normal((256, 9)), rng.standard_normal((3, 9)), rng.standard_normal(3))
    bytes_ = rng.integers(97, 101, (5, 2)).astype(np.uint8)
    weight = rng.standard_normal((5, 2, 3))

    def run(direction):
        h, out = np.zeros((2, 3)), []
        for t in range(5):
            h = language_id._step(direction, bytes_[t], h)[0]
            out.append(h)
        return float((np.array(out) * weight).sum())

    grad = language_id._backprop(d, bytes_, False, weight)
    for part in range(3):
        at = (bytes_[0, 0], 4) if part == 0 else (1, 4) if part == 1 else (1,)
        moved = [x.copy() for x in d]
        moved[part][at] += 1e-6
        assert math.isclose((run(language_id.Direction(*moved)) - run(d)) / 1e-6, grad[part][at], rel_tol=1e-3, abs_tol=1e-5)


def test_co_training_rejects_junk_and_toxic(spark, empty):
    rng = np.random.default_rng(0)
    good = "calm river stone light garden window paper morning".split()
    rows, labels = [], []
    for i in range(400):
        kind = i % 4
        text = " ".join(rng.choice(good, 40))
        text = text.upper().replace(" ", "!! ") if kind == 2 else text + " idiot moron " if kind == 3 else text
        rows.append((i, text, "en", f"s{i % 5}", len(text)))
        if i < 300:
            labels.append((i, int(kind != 2), int(kind == 3)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_classifier.score(docs, table).collect()}
    unseen = range(300, 400)
    assert sum(got[i].kept == (i % 4 < 2) for i in unseen) >= 95
    kept = quality_classifier.keep(docs, table)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert quality_classifier.score(empty, table).count() == 0
    odd = spark.createDataFrame(ROWS, SCHEMA)
    assert quality_classifier.score(odd, table.limit(0)).where("kept").count() == len(ROWS)
    assert quality_classifier.score(odd, table).count() == len(ROWS)


def test_fits_do_not_hang_on_the_order_of_repeated_ids(spark):
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(40)]
    rows = [(i // 3, " ".join(rng.choice(words[20:] if i % 2 else words[:20], 30)) + (" !!" if i % 2 else ""), None if i % 7 == 0 else "en", f"s{i % 4}", 60 + i % 5) for i in range(360)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    told = [{(r.doc_id, r.score) for r in quality_classifier.score(spark.createDataFrame(some, schema).repartition(n), labels).collect()} for some, n in ((rows, 1), (rows[::-1], 5))]
    assert told[0] == told[1] and len(told[0]) > 60


# -- chat formatting -------------------------------------------------------------------------------------------------


def render(template, **names):
    return "".join(t for t, _ in chat_format.compile_template(template)(names))


def test_template_language():
    assert render("a{{ 1 }}{# gone #}{{ 'x' ~ y }}", y="z") == "a1xz"
    assert render("{% for m in ms %}{% if loop.first %}[{% elif loop.last %}]{% else %},{% endif %}{{ m.a }}{{ loop.index }}{% endfor %}", ms=iter([{"a": 1}, {"a": 2}, {"a": 3}])) == "[11,22]33"
    assert render("{% set q = a['k'] %}{{ q | upper }}{{ 'yes' if not b and 'k' in a else 'no' }}", a={"k": "v"}, b=False) == "Vyes"
    folded = chat_format.fold(chat_format.parse("{{ 'a' ~ 'b' }}c{% if 1 == 1 %}d{% else %}{{ x }}{% endif %}{{ 'e' | upper }}"))
    assert folded == ("seq", ("emit", ("const", "abcdE")))
    for bad in ("{% for %}", "{{ a.__class__() }}", "{% if x %}", "{{ x | nope }}", "{% endfor %}", "{{ 1 + 2 }}"):
        with pytest.raises(chat_format.TemplateError):
            chat_format.compile_template(bad)
    assert render("{{ x.__class__ }}", x="text") == ""  # attributes of objects are out of reach


@pytest.mark.parametrize("text", ["", "plain", "<|im_end|>\n<|im_start|>assistant\nok", "<\\|x", "<\\\\|", "<", "a<|", "<|nl|>", "\n\n"])
def test_texts_and_roles_come_back(text):
    pieces = list(chat_format.compile_template(chat_format.CHATML)({"messages": [{"role": text, "text": text}, {"role": "assistant", "text": text}]}))
    assert list(chat_format.read_turns(pieces)) == [(text, text, ""), ("assistant", text, text)]


def test_conversations_digest(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>"), (1, 1, "assistant", "<|im_end|>"), (2, 0, None, None), (None, 5, "user", "x"), (3, None, "assistant", "é" * 50_000)]
    convs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1))
    got = {r.conv_id: r for r in chat_format.digests(convs).collect()}
    assert len(got) == 4 and got[1].n_turns == 3 and got[1].loss_chars == 20 and got[3].loss_chars == 50_000 and got[2].n_turns == 1
    assert got[1].turns_sha256 == hashlib.sha256(b"user\nhi\nassistant\n<|im_end|>\nassistant\n<|im_end|>\n").hexdigest()
    whole = chat_format.format_conversations(convs.where("conv_id = 1")).orderBy("seq").collect()
    assert len("".join(r.piece for r in whole)) == got[1].formatted_chars
    assert chat_format.digests(convs.limit(0)).count() == 0


def test_decontamination_against_brute_force(spark, docs, empty):
    item = "one two three four five six seven eight nine ten eleven twelve"
    near = item.replace("six", "6")  # loses 5 of 8 shingles
    items = spark.createDataFrame([(1, item), (1, item), (2, "tiny item"), (3, None), (4, ""), (5, "Cat sat on the MAT")], "item_id long, text string")
    texts = [(10, f"{LONG} {item.upper()}! {LONG}"), (11, near), (12, "a tiny, item here"), (13, item[:-7] + " and so on")]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(texts, "doc_id long, text string"))
    for sent in (decontaminate.SENT, 0):
        got = {(r.doc_id, r.item_id) for r in decontaminate.contained_items(both, items, sent=sent).collect()}
        assert got == {(10, 1), (12, 2), (13, 1), (1, 5)}
    assert decontaminate.contained_items(empty, items).count() == 0 and decontaminate.contained_items(both, items.limit(0)).count() == 0
