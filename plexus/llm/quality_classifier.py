"""Quality classifier by co-training.

Two views of a document are kept apart: its text (hashed words and a few shares) and its metadata (source, language, stated
length). Each view has a logistic classifier, first fitted on labelled documents. Over several rounds each one labels the
unlabelled documents that it is most sure of, in the proportion of the classes, and hands them to the other, which is fitted again.
In each round every unlabelled document of the corpus is a candidate: the executors take both views' margins of all of them, and only the
EACH surest a view come to the driver.
Both are then calibrated on labelled documents that no fit has seen (Platt scaling), and added as log-odds against the prior, so a
view that knows nothing adds nothing. A good document has quality 1 and toxic 0.

The labelled documents are a bounded sample, chosen by hash of the id: at most ``labelled``. Every document is scored.

Defined results: a null text counts as empty, null metadata is a value of its own; a document with contradicting or repeated
labels is good only if all of them say so; of different rows of one labelled id the one with the least hash is fitted, and each of an unlabelled id is a candidate of its own; rows with a null id are scored and never used for fitting; without labels of both classes
every document gets the prior and is kept; extra columns are kept by ``keep`` and left behind by ``score``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, in_pieces, materialise, ship, tidy

LABELLED = 12000
ROUNDS, EACH = 2, 400
DIM, META_DIM = 1 << 16, 1 << 10
#: Words whose presence tells the classes apart: log-odds of at least TELLING, and SURE standard errors from nothing.
FEATURES, SURE, TELLING = 2000, 3.0, 1.5
SEED = 6
#: Bytes of a longer word that stand for its stem.
STEM = 6

_DROP = b".,;:!?\"'()"
_SYMBOLS = b"#*$%&|<>"
DENSE = 7


class View(NamedTuple):
    """A linear classifier on sparse presence features and dense values; a and b are its calibration."""

    words: np.ndarray
    dense: np.ndarray
    bias: float
    a: float = 1.0
    b: float = 0.0


class Model(NamedTuple):
    text: View
    meta: View
    prior: float


#: The columns that the views read.
CONTENT = ("text", "source", "lang", "n_chars")


def text_features(text: str | None) -> tuple[set[bytes], list[float]]:
    """Distinct lower-case words and stems, and shares: capitals, symbols, exclamations, repeats, repeated lines, length, word length."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(None, _DROP).lower().split()
    distinct = set(words)
    stems = {b"^" + w[:STEM] for w in distinct if len(w) > STEM}
    n = max(len(words), 1)
    shouted = sum(map(bytes.isupper, raw.split()))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    return distinct | stems, [
        shouted / n,
        min(symbols / n, 2.0),
        min(raw.count(b"!") / n, 2.0),
        max(0.0, 1 - len(distinct) / n - 0.1 * math.log10(n)),
        1 - len(set(lines)) / max(len(lines), 1),
        math.log10(n) - 2,
        min(len(raw) / n, 40) / 10 - 0.6,
    ]


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> list[int]:
    """Hashed indicators of source, language, length class and their pairs."""
    size = "none" if n_chars is None else str(max(n_chars, 0).bit_length())
    keys = (f"s:{source}", f"l:{lang}", f"n:{size}", f"ln:{lang}:{size}")
    return [crc32(k.encode("utf-8", "surrogatepass")) % META_DIM for k in keys]


def _word_ids(words: set[bytes]) -> list[int]:
    return sorted({crc32(w) % DIM for w in words})


# -- fitting (numpy, on the driver, on the bounded sample) -----------------------------------------------------------


class _Rows(NamedTuple):
    """Sparse presence rows and dense values."""

    ids: np.ndarray
    ptr: np.ndarray
    dense: np.ndarray

    def take(self, at: np.ndarray) -> _Rows:
        lengths = np.diff(self.ptr)[at]
        ptr = np.concatenate([[0], np.cumsum(lengths)])
        spots = np.arange(ptr[-1]) - np.repeat(ptr[:-1], lengths) + np.repeat(self.ptr[:-1][at], lengths)
        return _Rows(self.ids[spots], ptr, self.dense[at])

    def margin(self, v: View) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(v.words[self.ids])])
        return sums[self.ptr[1:]] - sums[self.ptr[:-1]] + self.dense @ v.dense + v.bias


def _rows(lists: pa.ChunkedArray, dense: pa.ChunkedArray | None, width: int) -> _Rows:
    """From columns of lists, without a Python object per feature."""
    lists = lists.combine_chunks()
    ptr = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
    values = np.empty((len(lists), 0)) if dense is None else dense.combine_chunks().flatten().to_numpy().reshape(len(lists), width)
    return _Rows(lists.flatten().to_numpy(), ptr, values)


def _telling(rows: _Rows, y: np.ndarray, dim: int) -> np.ndarray:
    """A mask over the FEATURES features, at most, whose presence tells the classes apart best."""
    of = np.repeat(y, np.diff(rows.ptr))
    good, bad = np.bincount(rows.ids, of, dim), np.bincount(rows.ids, 1 - of, dim)
    n1, n0 = y.sum() + 1, (1 - y).sum() + 1
    odds = np.log((good + 0.5) / (n1 - good + 0.5)) - np.log((bad + 0.5) / (n0 - bad + 0.5))
    z = np.abs(odds) / np.sqrt(1 / (good + 0.5) + 1 / (bad + 0.5))
    z[(good + bad < 3) | (np.abs(odds) < TELLING)] = 0
    kept = z >= SURE
    if kept.sum() > FEATURES:
        kept &= z >= np.partition(z, -FEATURES)[-FEATURES]
    return kept


def fit_view(rows: _Rows, y: np.ndarray, dim: int, steps: int = 250, ridge: float = 2e-4) -> View:
    """Logistic regression by Adam on all rows, classes weighted alike."""
    mask = _telling(rows, y, dim)
    inside = np.concatenate([[0], np.cumsum(mask[rows.ids])])
    rows = _Rows(rows.ids[mask[rows.ids]], inside[rows.ptr], rows.dense)  # the others keep weight zero
    counts = np.diff(rows.ptr)
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    params = np.zeros(dim + rows.dense.shape[1] + 1)
    m, s = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, steps + 1):
        v = View(params[:dim], params[dim:-1], params[-1])
        error = weight * (1 / (1 + np.exp(-np.clip(rows.margin(v), -30, 30))) - y)
        grad = np.concatenate([np.bincount(rows.ids, np.repeat(error, counts), dim), rows.dense.T @ error, [error.sum()]])
        grad[:-1] += ridge * params[:-1]
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad * grad
        params = params - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-9)
    return View(params[:dim], params[dim:-1], float(params[-1]))


def calibrate(view: View, rows: _Rows, y: np.ndarray) -> View:
    """Platt scaling by Newton steps; the slope never turns negative."""
    x = rows.margin(view)
    x = np.clip(x, -30, 30)
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - target) * x).sum(), (p - target).sum()])
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    if not (np.isfinite(a) and np.isfinite(b)) or a <= 0:
        mean = min(max(float(target.mean()), 1e-3), 1 - 1e-3)
        a, b = 0.0, math.log(mean / (1 - mean))
    return view._replace(a=float(a), b=float(b))


#: (text view, metadata view, number of bad and of good ones wanted) -> (view that is sure, label, both views' rows) of unlabelled documents not given before.
Ask = Callable[[View, View, int, int], list[tuple[str, int, _Rows, _Rows]]]


def co_train(text: _Rows, meta: _Rows, y: np.ndarray, ask: Ask) -> Model | None:
    """``y`` is 1 for good. A third of the labelled rows is set aside for calibration."""
    n = len(y)
    held = np.arange(n) % 3 == 2
    fit = np.flatnonzero(~held)
    if n < 6 or len(set(y[fit].tolist())) < 2 or len(set(y[held].tolist())) < 2:
        return None
    none = np.array([], np.int64)
    taught = {"text": (text.take(none), []), "meta": (meta.take(none), [])}
    share = float(y.mean())
    views: dict[str, View] = {}
    for r in range(ROUNDS + 1):
        for name, rows, dim in (("text", text, DIM), ("meta", meta, META_DIM)):
            more, said = taught[name]
            views[name] = fit_view(_join(rows.take(fit), more), np.concatenate([y[fit], np.array(said, float)]), dim)
        if r == ROUNDS:
            break
        for name, label, text_rows, meta_rows in ask(views["text"], views["meta"], round(EACH * (1 - share)), round(EACH * share)):
            other, given = ("meta", meta_rows) if name == "text" else ("text", text_rows)
            more, said = taught[other]
            taught[other] = _join(more, given), said + [label] * (len(given.ptr) - 1)
    out = np.flatnonzero(held)
    return Model(calibrate(views["text"], text.take(out), y[out]), calibrate(views["meta"], meta.take(out), y[out]), math.log((y.sum() + 1) / ((1 - y).sum() + 1)))


def _join(a: _Rows, b: _Rows) -> _Rows:
    return _Rows(np.concatenate([a.ids, b.ids]), np.concatenate([a.ptr, a.ptr[-1] + b.ptr[1:]]), np.concatenate([a.dense, b.dense]))


# -- the operator ----------------------------------------------------------------------------------------------------


def _features(docs: DataFrame) -> pa.Table:
    """Both views' features of a bounded table of documents, with its columns doc_id, key and good."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in in_pieces(batches, "text"):
            rows = piece.to_pydict()
            found = [text_features(t) for t in rows["text"]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows["doc_id"], pa.int64()),
                    pa.array(rows["key"], pa.int64()),
                    pa.array(rows["good"], pa.int32()),
                    pa.array([_word_ids(w) for w, _ in found], pa.list_(pa.int32())),
                    pa.array([d for _, d in found], pa.list_(pa.float64())),
                    pa.array([meta_features(*x) for x in zip(rows["source"], rows["lang"], rows["n_chars"], strict=True)], pa.list_(pa.int32())),
                ],
                names=["doc_id", "key", "good", "words", "dense", "meta"],
            )

    return docs.mapInArrow(run, "doc_id long, key long, good int, words array<int>, dense array<double>, meta array<int>").toArrow().sort_by([("doc_id", "ascending"), ("key", "ascending")])


def _told(labels: DataFrame) -> DataFrame:
    """(doc_id, good) of the labelled documents."""
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)).alias("good")
    )


def _key() -> Column:
    """What tells rows of one id apart: a hash of all that the views read, nulls included."""
    return F.xxhash64(*CONTENT, *(F.col(c).isNull() for c in CONTENT))


def _sample(docs: DataFrame, labels: DataFrame, labelled: int) -> pa.Table:
    """Features of the labelled sample: at most ``labelled`` rows, chosen by hash of the id."""
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").distinct()
    chosen = ids.join(_told(labels), "doc_id").orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(labelled)
    told = docs.join(F.broadcast(chosen), "doc_id").withColumn("key", _key())
    return _features(told.groupBy("doc_id").agg(F.min(F.struct("key", *CONTENT, "good")).alias("row")).select("doc_id", "row.*"))  # labelled rows at most


def _views_of(t: pa.Table) -> tuple[_Rows, _Rows]:
    return _rows(t.column("words"), t.column("dense"), DENSE), _rows(t.column("meta"), None, 0)


def _margins(docs: DataFrame, text: View, meta: View) -> DataFrame:
    """(doc_id, key, text, meta): both views' margins of every document with an id."""
    one = _margin_of(text, meta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = one()
        for piece in in_pieces(batches, "text"):
            rows = piece.to_pydict()
            found = np.array([of(*x) for x in zip(rows["text"], rows["source"], rows["lang"], rows["n_chars"], strict=True)]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("key"), pa.array(found[:, 0]), pa.array(found[:, 1])], names=["doc_id", "key", "m_text", "m_meta"])

    return docs.where("doc_id IS NOT NULL").mapInArrow(run, "doc_id long, key long, m_text double, m_meta double")


def _asker(docs: DataFrame, labels: DataFrame) -> Ask:
    docs = docs.withColumn("key", _key())
    given: list[tuple[int, int]] = []

    def ask(text: View, meta: View, bad: int, good: int) -> list[tuple[str, int, _Rows, _Rows]]:
        spark = docs.sparkSession
        before = F.broadcast(spark.createDataFrame(given, "doc_id long, key long"))  # what earlier rounds gave: at most 2 * EACH rows each
        free = _margins(docs, text, meta).join(_told(labels), "doc_id", "left_anti").join(before, ["doc_id", "key"], "left_anti").dropDuplicates(["doc_id", "key"])
        free = materialise(free, "margins")
        picked = []
        for name in ("text", "meta"):
            for label, n in ((0, bad), (1, good)):
                margin = F.col(f"m_{name}") if label else -F.col(f"m_{name}")
                best = free.where(margin > 1.0).orderBy(margin.desc(), "doc_id", "key").limit(n)  # confident only
                picked.append(best.select("doc_id", "key", F.lit(name).alias("view"), F.lit(label).alias("good")))
        rows = [tuple(r) for p in picked for r in p.collect()]  # 2 * EACH at most
        discard(free)
        out = []
        chosen = spark.createDataFrame(rows, "doc_id long, key long, view string, good int")
        found = docs.join(F.broadcast(chosen.select("doc_id", "key").distinct()), ["doc_id", "key"]).dropDuplicates(["doc_id", "key"])
        t = _features(found.withColumn("good", F.lit(None).cast("int")))
        place = {x: k for k, x in enumerate(zip(t.column("doc_id").to_pylist(), t.column("key").to_pylist(), strict=True))}
        for name in ("text", "meta"):
            for label in (0, 1):
                ids = sorted({(r[0], r[1]) for r in rows if r[2] == name and r[3] == label})
                if ids:
                    both = _views_of(t.take([place[i] for i in ids]))
                    out.append((name, label, *both))
        given.extend({(r[0], r[1]) for r in rows})
        return out

    return ask


def _columns(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    have = set(docs.columns)
    col = lambda c, kind: (F.col(c) if c in have else F.lit(None)).cast(kind).alias(c)
    return docs.select(col("doc_id", "long"), col("text", "string"), col("source", "string"), col("lang", "string"), col("n_chars", "long"))


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model | None:
    docs = _columns(docs)
    model = _fitted(docs, labels, labelled)
    tidy(docs.sparkSession)  # the features of the sample
    return model


def _fitted(docs: DataFrame, labels: DataFrame, labelled: int) -> Model | None:
    t = _sample(docs, labels, labelled)
    order = np.argsort([crc32(str(i).encode()) for i in t.column("doc_id").to_pylist()], kind="stable")  # in no order of ids
    text, meta = _views_of(t)
    good = np.array(t.column("good").to_pylist(), float)
    return co_train(text.take(order), meta.take(order), good[order], _asker(docs, labels))


def _margin_of(text: View, meta: View):
    """A function that makes, once a task, (text, source, lang, n_chars) -> both views' margins."""

    def make():
        known: dict[bytes, float] = {}
        weights, dense, of_meta = text.words, text.dense.tolist(), meta.words.tolist()

        def of(word: bytes) -> float:
            if len(known) > 400_000:
                known.clear()
            known[word] = w = float(weights[crc32(word) % DIM])
            return w

        def margin(raw: str | None, source: str | None, lang: str | None, n: int | None) -> tuple[float, float]:
            words, shares = text_features(raw)
            get, ids = known.get, {}
            for word in words:
                w = get(word)
                if w is None:
                    w = of(word)
                if w:
                    ids[crc32(word) % DIM] = w
            x = sum(ids[i] for i in sorted(ids)) + sum(a * b for a, b in zip(dense, shares, strict=True)) + text.bias
            return x, sum(of_meta[i] for i in meta_features(source, lang, n)) + meta.bias

        return margin

    return make


def _scorer(model: Model | None):
    """(text, source, lang, n_chars) -> (p_text, p_meta, score)."""
    if model is None:
        return lambda text, source, lang, n: (0.5, 0.5, 0.5)
    margin = _margin_of(model.text, model.meta)()
    squash = lambda z: 1 / (1 + math.exp(-min(max(z, -30), 30)))

    def score(*document) -> tuple[float, float, float]:
        x, y = margin(*document)
        x = model.text.a * min(max(x, -30), 30) + model.text.b
        y = model.meta.a * min(max(y, -30), 30) + model.meta.b
        return squash(x), squash(y), squash(x + y - model.prior)

    return score


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, labelled: int = LABELLED) -> DataFrame:
    """doc_id, p_text, p_meta, score (probability of a good document) and kept, for every row."""
    model = fit(docs, labels, labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _scorer(model)
        for piece in in_pieces(batches, "text"):
            rows = piece.to_pydict()
            found = np.array([one(*x) for x in zip(rows["text"], rows["source"], rows["lang"], rows["n_chars"], strict=True)]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(rows["doc_id"], pa.int64()), *(pa.array(found[:, k]) for k in range(3)), pa.array(found[:, 2] >= threshold)], names=["doc_id", "p_text", "p_meta", "score", "kept"])

    return _columns(docs).mapInArrow(run, "doc_id long, p_text double, p_meta double, score double, kept boolean")


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, labelled: int = LABELLED) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches the threshold; no shuffle of the texts."""
    model = fit(docs, labels, labelled)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _scorer(model)
        for piece in in_pieces(batches, "text"):
            cols = [piece.column(c).to_pylist() if c in names else [None] * piece.num_rows for c in ("text", "source", "lang", "n_chars")]
            yield piece.filter(pa.array([one(*x)[2] >= threshold for x in zip(*cols, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
