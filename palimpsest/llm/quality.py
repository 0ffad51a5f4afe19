"""Text quality by a factorisation machine.

Features: each distinct word (hashed; log-frequency, normalised over the text), structure statistics in
bins (shares of upper case, digits, marks and spaces, lengths, share of distinct words and lines) and
numeric metadata in bins. The score is logistic in

    w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)**2 - sum v_if**2 x_i**2),

which takes time linear in a text's features. Training (AdaGrad in numpy) is on the driver over at most
TRAIN_DOCS labelled texts; the table of weights, with WORDS rows and one for each bin, is the broadcast's bound.

Cases: null and empty texts have only the bins of an empty text; null metadata have a bin of their own; with labels
of one kind or none the score is the smoothed share of label 1; null ids are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import sample
from .session import prepare
from .words import SPACE, Texts, U, span_hashes, texts

TRAIN_DOCS, EPOCHS, BATCH = 10000, 8, 64
WORDS, FACTORS = 1 << 17, 8
BINS, STATS, META = 16, 11, 1
SIZE = WORDS + BINS * (STATS + META)
WEIGHT = 0.5

KINDS = np.zeros((5, 256), np.int64)
KINDS[0, 65:91] = 1
KINDS[1, 48:58] = 1
KINDS[2, [c for c in range(33, 127) if not chr(c).isalnum()]] = 1
KINDS[3] = SPACE
KINDS[4, 128:] = 1


def sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between each two edges."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[edges[1:]] - total[edges[:-1]]


def distinct(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, value, count) of the distinct values of each text."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return doc[first], h[first], np.diff(np.append(first, len(h)))


def features(chunk: Texts, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, x) in order of the texts. ``meta``: one number (or nan) for each text."""
    n = len(chunk.ids)
    _, starts, ends, at = chunk.words()
    h = span_hashes(chunk.data, starts, ends)  # with their case
    doc, word, count = distinct(h >> U(64 - 17), at)
    x = np.log1p(count)
    x /= np.sqrt(np.bincount(doc, x * x, n))[doc]
    size = np.maximum(np.diff(chunk.offsets), 1)
    stats = [sums(k[chunk.data], chunk.offsets) / size for k in KINDS]
    words = np.diff(at)
    breaks = np.flatnonzero(chunk.data == 10)
    edge = np.unique(np.concatenate([chunk.offsets[:-1], breaks + 1]))
    edge = edge[edge < len(chunk.data)]
    stop = np.append(edge[1:], len(chunk.data))
    lines_at = np.searchsorted(edge, chunk.offsets)
    line_doc, _, _ = distinct(span_hashes(chunk.data, edge, stop), lines_at)
    lines = np.diff(lines_at)
    stats += [np.log2(size) / 20, np.log2(words + 1) / 18, sums(ends - starts, at) / np.maximum(words, 1) / 16]
    stats += [np.bincount(doc, minlength=n) / np.maximum(words, 1), np.bincount(line_doc, minlength=n) / np.maximum(lines, 1)]
    stats += [np.log2(words / np.maximum(lines, 1) + 1) / 12]
    fixed = np.stack([np.clip(spread(np.asarray(s, float)) * BINS, 0, BINS - 1).astype(np.int64) for s in stats], axis=1)
    bins = np.where(np.isnan(meta), 0, 1 + np.clip(np.log2(np.nan_to_num(np.abs(meta)) + 1), 0, BINS - 2).astype(np.int64))
    fixed = np.concatenate([fixed, bins[:, None]], axis=1) + WORDS + BINS * np.arange(STATS + META)
    doc = np.concatenate([doc, np.repeat(np.arange(n), STATS + META)])
    order = np.argsort(doc, kind="stable")
    return doc[order], np.concatenate([word.astype(np.int64), fixed.ravel()])[order], np.concatenate([x, np.full(fixed.size, WEIGHT)])[order]


def spread(share: np.ndarray) -> np.ndarray:
    """Shares near 0 matter most, so bins follow the root."""
    return np.sqrt(np.clip(share, 0, 1))


class Model(NamedTuple):
    w0: float
    w: np.ndarray
    v: np.ndarray

    def logits(self, doc: np.ndarray, feature: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        vx = self.v[feature] * x[:, None]
        at = np.searchsorted(doc, np.arange(n))
        whole, squares = (np.add.reduceat(a, at, axis=0) for a in (vx, vx * vx))
        return self.w0 + np.bincount(doc, self.w[feature] * x, n) + 0.5 * (whole**2 - squares).sum(axis=1)


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> Model:
    """``rows``: (feature, x) of each text."""
    rng = np.random.default_rng(seed)
    w, v = np.zeros(SIZE), rng.normal(0, 0.05, (SIZE, FACTORS))
    grown_w, grown_v = np.full(SIZE, 1e-2), np.full(SIZE, 1e-2)
    w0 = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), BATCH):
            take = order[lo : lo + BATCH]
            sizes = [len(rows[i][0]) for i in take]
            doc = np.repeat(np.arange(len(take)), sizes)
            used, place = np.unique(np.concatenate([rows[i][0] for i in take]), return_inverse=True)
            x = np.concatenate([rows[i][1] for i in take])
            vx = v[used][place] * x[:, None]
            whole = np.add.reduceat(vx, np.cumsum([0, *sizes[:-1]]), axis=0)
            squares = np.add.reduceat(vx * vx, np.cumsum([0, *sizes[:-1]]), axis=0)
            z = w0 + np.bincount(doc, w[used][place] * x, len(take)) + 0.5 * (whole**2 - squares).sum(axis=1)
            err = (1 / (1 + np.exp(-z)) - y[take]) / len(take) * 8
            pull = err[doc] * x
            g = np.bincount(place, pull, len(used)) + 1e-4 * w[used]
            each = pull[:, None] * (whole[doc] - vx)
            gv = np.stack([np.bincount(place, each[:, f], len(used)) for f in range(FACTORS)], axis=1) + 1e-4 * v[used]
            grown_w[used] += g * g
            grown_v[used] += (gv * gv).mean(axis=1)
            w[used] -= 0.15 * g / np.sqrt(grown_w[used])
            v[used] -= 0.05 * gv / np.sqrt(grown_v[used])[:, None]
            w0 -= 0.02 * err.sum()
    return Model(w0, w.astype(np.float32), v.astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", train_fold: Column | None = None, most: int = TRAIN_DOCS) -> Model:
    """Train on rows of ``docs`` (doc_id, text, meta) that ``labels`` (doc_id, label) marks."""
    prepare(docs.sparkSession)
    got, counts = sample(docs.select("doc_id", "text", "meta"), labels, label, F.lit(True) if train_fold is None else train_fold, most, False)
    if not counts.get(0) or not counts.get(1):
        share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
        return Model(float(np.log(share / (1 - share))), np.zeros(SIZE, np.float32), np.zeros((SIZE, FACTORS), np.float32))
    y, meta = got.column("y").to_numpy().astype(float), got.column("meta").to_numpy(zero_copy_only=False).astype(float)
    rows, at = [], 0
    for chunk in texts(got.select(["doc_id", "text"]).to_batches()):
        n = len(chunk.ids)
        doc, feature, x = features(chunk, meta[at : at + n])
        cut = np.searchsorted(doc, np.arange(n + 1))
        rows += [(feature[a:b].astype(np.int32), x[a:b].astype(np.float32)) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        at += n
    return train(rows, y)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row of ``docs`` (doc_id, text, meta)."""
    prepare(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(tuple(model))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*held.value)
        for batch in batches:
            meta, at = batch.column("meta").cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False), 0
            for chunk in texts(iter([batch])):
                n = len(chunk.ids)
                z = own.logits(*features(chunk, meta[at : at + n]), n)
                yield pa.record_batch([pa.array(chunk.ids, mask=~chunk.valid), pa.array(np.round(1 / (1 + np.exp(-np.clip(z, -50, 50))), 6))], schema=schema)
                at += n

    return docs.select("doc_id", "text", F.col("meta").cast("double").alias("meta")).mapInArrow(score, "doc_id long, score double")
