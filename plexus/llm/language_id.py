"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads windows of a text's UTF-8 bytes in both directions, gives every position a distribution over languages, and a
document's probabilities are the mean over its letters. A window is read with MARGIN bytes before and after it, so that a position
near a cut still sees both sides. It is trained in numpy by backpropagation through time on windows from
a bounded sample of labelled documents, and applied to every byte of every text.

The sample: at most ``per_lang`` documents a language (hash of the id decides) with up to WINDOWS windows each, spread over the
whole text; with many languages the share of each shrinks so that all of them together stay within SAMPLE documents. Of more than LANGS different labels the LANGS with the
most documents are learned (ties: the smaller label), and texts of the others get the nearest of those.

Defined results: ``und`` with score 0 where a text is null, empty or has no letter, or where nothing could be learned; rows
without a language teach nothing; repeated rows each get a row; an empty table gives an empty result; extra columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_texts, in_pieces, map_texts

HIDDEN, WINDOW, MARGIN = 8, 96, 12
PER_LANG, WINDOWS, SAMPLE, LANGS = 800, 6, 40_000, 1024
STEPS, BATCH = 260, 192
#: With more languages than this a step of training sees some of them only.
MANY = 256
SEED = 5

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


class Direction(NamedTuple):
    """x: what each byte adds to the gates (reset, update, candidate); u: recurrent weights; b: of the candidate's recurrent part."""

    x: np.ndarray
    u: np.ndarray
    b: np.ndarray


class Network(NamedTuple):
    langs: list[str]
    forward: Direction
    backward: Direction
    out: np.ndarray
    bias: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def _step(d: Direction, byte: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    n = h.shape[1]
    gates, own = d.x[byte], h @ d.u
    ru = _sigmoid(gates[:, : 2 * n] + own[:, : 2 * n])
    r, z = ru[:, :n], ru[:, n:]
    inner = own[:, 2 * n :] + d.b
    c = np.tanh(gates[:, 2 * n :] + r * inner)
    return c + z * (h - c), r, z, c, inner


def _run(d: Direction, bytes_: np.ndarray, reverse: bool) -> np.ndarray:
    """Hidden states, (position, row, unit); ``bytes_`` is (position, row)."""
    length, rows = bytes_.shape
    out = np.empty((length, rows, d.u.shape[0]), np.float32)
    h = np.zeros((rows, d.u.shape[0]), np.float32)
    for t in range(length - 1, -1, -1) if reverse else range(length):
        h = out[t] = _step(d, bytes_[t], h)[0]
    return out


def position_probabilities(net: Network, bytes_: np.ndarray) -> np.ndarray:
    """(position, row, language) from bytes (position, row)."""
    n = net.forward.u.shape[0]
    logits = _run(net.forward, bytes_, False) @ net.out[:n]
    logits += _run(net.backward, bytes_, True) @ net.out[n:]
    logits += net.bias
    logits -= logits.max(axis=2, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=2, keepdims=True)
    return logits


# -- training --------------------------------------------------------------------------------------------------------


def _backprop(d: Direction, bytes_: np.ndarray, reverse: bool, grad_h: np.ndarray) -> Direction:
    """Gradients of one direction from those of its hidden states."""
    length, rows = bytes_.shape
    n = d.u.shape[0]
    order = list(range(length - 1, -1, -1)) if reverse else list(range(length))
    h, kept = np.zeros((rows, n), np.float32), []
    for t in order:
        new, r, z, c, inner = _step(d, bytes_[t], h)
        kept.append((h, r, z, c, inner))
        h = new
    gx, gu, gb = np.zeros_like(d.x), np.zeros_like(d.u), np.zeros_like(d.b)
    carry = np.zeros((rows, n), np.float32)
    for t, (before, r, z, c, inner) in zip(reversed(order), reversed(kept), strict=True):
        g = grad_h[t] + carry
        dz = g * (before - c) * z * (1 - z)
        dc = g * (1 - z) * (1 - c * c)
        dr = dc * inner * r * (1 - r)
        own = np.concatenate([dr, dz, dc * r], axis=1)
        np.add.at(gx, bytes_[t], np.concatenate([dr, dz, dc], axis=1))
        gu += before.T @ own
        gb += own[:, 2 * n :].sum(axis=0)
        carry = g * z + own @ d.u.T
    return Direction(gx, gu, gb)


def train(windows: np.ndarray, y: np.ndarray, langs: list[str], steps: int = STEPS) -> Network:
    """``windows``: (row, position) bytes; ``y``: the language of each row."""
    rng = np.random.default_rng(SEED)
    n, k = HIDDEN, len(langs)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    make = lambda: [draw(256, 3 * n, scale=0.3), draw(n, 3 * n, scale=0.3), np.zeros(n, np.float32)]
    params = [*make(), *make(), draw(2 * n, k, scale=0.3), np.zeros(k, np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    by_lang = [np.flatnonzero(y == j) for j in range(k)]
    for step in range(1, steps + 1):
        some = by_lang if k <= MANY else [by_lang[j] for j in rng.choice(k, BATCH // 8, replace=False)]
        pick = np.concatenate([rng.choice(rows, max(BATCH // k, 8)) for rows in some])
        bytes_, want = np.ascontiguousarray(windows[pick].T), y[pick]
        fwd, bwd = Direction(*params[:3]), Direction(*params[3:6])
        net = Network(langs, fwd, bwd, params[6], params[7])
        error = position_probabilities(net, bytes_)
        error[:, np.arange(len(want)), want] -= 1
        error *= _LETTER[bytes_][:, :, None] / np.float32(max(_LETTER[bytes_].sum(), 1))
        hf, hb = _run(fwd, bytes_, False), _run(bwd, bytes_, True)
        flat = error.reshape(-1, k)
        grads = [
            *_backprop(fwd, bytes_, False, error @ params[6][:n].T),
            *_backprop(bwd, bytes_, True, error @ params[6][n:].T),
            np.concatenate([hf.reshape(-1, n).T @ flat, hb.reshape(-1, n).T @ flat]),
            flat.sum(axis=0),
        ]
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, m, s in zip(params, grads, first, second, strict=True):
            g *= min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= np.float32(rate) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return Network(langs, Direction(*params[:3]), Direction(*params[3:6]), params[6], params[7])


def _windows(text: str) -> list[bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    starts = np.unique(np.linspace(0, max(len(raw) - WINDOW, 0), WINDOWS).astype(int))
    return [_with_margins(raw, a) for a in starts]


def _with_margins(raw: bytes, at: int) -> bytes:
    """The window at ``at`` and MARGIN bytes on both sides; zeros stand for what lies outside the text."""
    before = raw[max(at - MARGIN, 0) : at].rjust(MARGIN, b"\0")
    return before + raw[at : at + WINDOW + MARGIN].ljust(WINDOW + MARGIN, b"\0")


def fit(docs: DataFrame, per_lang: int = PER_LANG, langs: int = LANGS) -> Network | None:
    """``docs``: doc_id, text, lang of the documents to learn from."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    counts = docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(langs).collect()
    if not counts:
        return None
    per_lang = max(1, min(per_lang, SAMPLE // len(counts)))
    # the share that gives per_lang documents of each language; the limit below only holds against an unlucky hash
    share = F.broadcast(docs.sparkSession.createDataFrame([(r["lang"], min(1.0, per_lang / r["count"])) for r in counts], "lang string, share double"))
    luck = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in in_pieces(batches, "text"):
            rows = [(i, l, w) for i, l, t in zip(*(piece.column(c).to_pylist() for c in ("doc_id", "lang", "text")), strict=True) for w in _windows(t)]
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "lang", "w"), r, strict=True)) for r in rows], schema=pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("w", pa.binary())]))

    chosen = docs.join(share, "lang").where(luck < F.col("share")).select("doc_id", "lang", "text").mapInArrow(cut, "doc_id long, lang string, w binary")
    t = chosen.limit(2 * per_lang * WINDOWS * len(counts)).toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending"), ("w", "ascending")])
    names = sorted(set(t.column("lang").to_pylist()))
    if not names:
        return None
    at = {x: k for k, x in enumerate(names)}
    y = np.array([at[x] for x in t.column("lang").to_pylist()])
    windows = np.frombuffer(b"".join(t.column("w").to_pylist()), np.uint8).reshape(-1, WINDOW + 2 * MARGIN)
    return train(windows, y, names)


# -- the operator ----------------------------------------------------------------------------------------------------


def pooled(net: Network, texts: list[str | None], cells: int = 16_384) -> np.ndarray:
    """(text, language): mean probability over the letters of each whole text; zeros where it has none."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    count = [-(-len(x) // WINDOW) for x in raw]
    bytes_ = _slices(raw, count)
    owner = np.repeat(np.arange(len(texts)), count)
    sums, letters = np.zeros((len(texts), len(net.langs))), np.zeros(len(texts))
    rows = max(cells // len(net.langs), 64 if len(net.langs) <= MANY else 1)  # windows at once
    for k in range(0, len(bytes_), rows):
        part = np.ascontiguousarray(bytes_[k : k + rows].T)
        mask = _LETTER[part[MARGIN:-MARGIN]]
        p = np.einsum("twl,tw->wl", position_probabilities(net, part)[MARGIN:-MARGIN], mask.astype(np.float32))
        np.add.at(sums, owner[k : k + rows], p)
        np.add.at(letters, owner[k : k + rows], mask.sum(axis=0))
    return sums / np.maximum(letters, 1)[:, None]


def _slices(raw: list[bytes], count: list[int]) -> np.ndarray:
    """(window, byte with margins) of all texts in turn; ``count``: windows of each."""
    padded = b"".join(bytes(MARGIN) + x.ljust(c * WINDOW + MARGIN, b"\0") for x, c in zip(raw, count, strict=True))
    data = np.frombuffer(padded, np.uint8)
    own = np.array(count, dtype=np.int64)
    begin = np.cumsum(own * WINDOW + 2 * MARGIN) - (own * WINDOW + 2 * MARGIN)
    starts = np.repeat(begin, own) + WINDOW * (np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own))
    return np.lib.stride_tricks.sliding_window_view(data, WINDOW + 2 * MARGIN)[starts] if len(starts) else np.empty((0, WINDOW + 2 * MARGIN), np.uint8)


def label_positions(net: Network, text: str) -> list[str]:
    """The language of every byte of the text."""
    raw = text.encode("utf-8", "surrogatepass")
    bytes_ = np.ascontiguousarray(_slices([raw], [-(-len(raw) // WINDOW)]).T)
    best = position_probabilities(net, bytes_)[MARGIN:-MARGIN].argmax(axis=2).T.ravel()[: len(raw)]
    return [net.langs[k] for k in best]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred and score of every row; only the text is read."""

    def make():
        def work(ids: list, texts: list) -> dict:
            if net is None:
                return {"doc_id": pa.array(ids, pa.int64()), "lang_pred": ["und"] * len(ids), "score": [0.0] * len(ids)}
            p = pooled(net, texts)
            best = p.argmax(axis=1)
            known = [has_letter(t) for t in texts]
            return {
                "doc_id": pa.array(ids, pa.int64()),
                "lang_pred": [net.langs[b] if ok else "und" for b, ok in zip(best, known, strict=True)],
                "score": [float(min(max(x, 0.0), 1.0)) if ok else 0.0 for x, ok in zip(p.max(axis=1, initial=0.0), known, strict=True)],
            }

        return work

    return map_texts(ids_and_texts(docs), make, "doc_id long, lang_pred string, score double")
