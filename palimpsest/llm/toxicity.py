"""Toxicity by a convolutional text classifier in numpy.

A word is the sum of hashed embeddings of itself and its first four and six bytes. Filters of widths 1, 2
and 3 run over the words, each is max-pooled over the whole text, and a logistic layer gives the score.
Training (Adam for the filters, AdaGrad for embeddings) goes over all labelled texts in EPOCHS rounds: every task trains a copy of the model on its
own texts, and ``RDD.treeAggregate`` averages the copies, an embedding by how much each copy learnt of it. The driver sees one model a round, whose size is
fixed. Both labels weigh as much in training; the bias is then set to the labels' share in all labelled
rows. A sixth of the labelled texts, by a hash of their ids, is kept out of training to calibrate for each language the score from which a text is
rejected. The language is never an input of the score. To score, embeddings and filters are multiplied
into one table of BUCKETS rows, which is the broadcast's bound.

Cases: null and empty texts get the score of a text without words; with labels of one kind or none
the score is the smoothed share of label 1 for all texts; null ids are kept. Other columns are
kept by ``with_toxicity``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import discard, keep, parts_for, prefilter, prepare
from .words import Texts, U, span_hashes, texts

EPOCHS, BATCH = 6, 32
#: Bytes of labelled text that make a part of their table, that a copy of the model is trained on in a round, and whose words a task holds.
PART_BYTES, COPY_BYTES, HELD_BYTES = 16 << 20, 64 << 20, 2 << 20
#: Scores from which a text may be rejected.
GRID = np.round(np.arange(0.05, 0.96, 0.05), 2)
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 12, 8, (1, 2, 3)
PADS = max(WIDTHS)
#: Words whose table rows are summed at once.
AT_ONCE = 1 << 16


def tokens(chunk: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Three buckets for each word, and at which word each text begins (with the end)."""
    data, starts, ends, at = chunk.letters()
    out = np.empty((len(starts), 3), np.int64)
    for j, most in enumerate((None, 4, 6)):
        to = ends if most is None else np.minimum(ends, starts + most)
        out[:, j] = ((span_hashes(data, starts, to) + U(j * 0x1E3779B97F4A7C15)) >> U(13)) % U(BUCKETS)
    return out, at


class Model(NamedTuple):
    """``table``: for each bucket, its product with every row of every filter; the last row is a pad."""

    table: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: float
    thresholds: dict[str, float]

    def scores(self, chunk: Texts) -> np.ndarray:
        words, at = tokens(chunk)
        pooled = np.full((len(at) - 1, len(self.bias)), -np.inf, np.float32)
        sizes, lo = np.diff(at), 0
        while lo < len(sizes):
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + AT_ONCE, side="right")) - 1)
            first, end = int(at[lo]), int(at[hi])
            while end - first > AT_ONCE:  # one long text, in steps that overlap by the widest filter less one
                self._pool(words[first : first + AT_ONCE], np.array([0, AT_ONCE]), pooled[lo:hi], cut=True)
                first += AT_ONCE - PADS + 1
            self._pool(words[first:end], np.maximum(at[lo : hi + 1] - first, 0), pooled[lo:hi])
            lo = hi
        hidden = np.maximum(pooled + self.bias, 0)
        return 1 / (1 + np.exp(-(hidden @ self.out + self.shift).astype(np.float64)))

    def _pool(self, words: np.ndarray, at: np.ndarray, pooled: np.ndarray, cut: bool = False) -> None:
        """Raise ``pooled`` to the filters' tops; with ``cut`` the text goes on, so no window reaches its end's pads."""
        spots, starts = padded(words, at)
        rows = self.table[spots[:, 0]]
        rows += self.table[spots[:, 1]]
        rows += self.table[spots[:, 2]]
        col, f = 0, 0
        for w in WIDTHS:
            n = len(rows) - w + 1
            conv = rows[:n, col : col + FILTERS].copy()
            for j in range(1, w):
                conv += rows[j : j + n, col + j * FILTERS : col + (j + 1) * FILTERS]
            mask_pads(conv, spots)
            if cut:
                conv[len(words) - PADS + 1 :] = -np.inf
            np.maximum(pooled[:, f : f + FILTERS], np.maximum.reduceat(conv, starts, axis=0), out=pooled[:, f : f + FILTERS])
            col, f = col + w * FILTERS, f + FILTERS


def padded(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with PADS pads after each text, and each text's first place."""
    sizes = np.diff(at)
    starts = at[:-1] + PADS * np.arange(len(sizes))
    spots = np.full((len(words) + PADS * len(sizes), 3), BUCKETS, np.int64)
    spots[np.arange(len(words)) + PADS * np.repeat(np.arange(len(sizes)), sizes)] = words
    return spots, starts


def mask_pads(conv: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """Windows that begin at a pad other than the first after a text don't count: they'd reach the next text."""
    pad = spots[: len(conv), 0] == BUCKETS
    later = pad.copy()
    later[1:] &= pad[:-1]
    later[:1] = False
    conv[later] = -np.inf
    return conv


class State(NamedTuple):
    """A model in training: embeddings, what AdaGrad has summed for each, filters with bias and output layer, Adam's moments, and steps made."""

    emb: np.ndarray
    grown: np.ndarray
    params: list[np.ndarray]
    first: list[np.ndarray]
    second: list[np.ndarray]
    step: int


def begin(seed: int = 1) -> State:
    rng = np.random.default_rng(seed)
    emb = np.zeros((BUCKETS + 1, DIM), np.float32)
    emb[:BUCKETS] = rng.normal(0, 0.3, (BUCKETS, DIM))
    params = [rng.normal(0, 0.4, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    params += [np.zeros(FILTERS * len(WIDTHS), np.float32), rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), np.zeros(1, np.float32)]
    return State(emb, np.full((BUCKETS + 1, 1), 1e-3, np.float32), params, [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0)


def trained(state: State, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, rate: float, seed: int) -> State:
    """The state after one pass over texts' word buckets with their labels and weights; the arrays are changed in place."""
    (emb, grown, params, first, second, step), rng = state, np.random.default_rng(seed)
    if docs:
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), BATCH):
            rows = order[lo : lo + BATCH]
            at = np.cumsum([0, *[len(docs[i]) for i in rows]])
            spots, starts = padded(np.concatenate([docs[i] for i in rows]), at)
            x = emb[spots[:, 0]] + emb[spots[:, 1]] + emb[spots[:, 2]]
            tops, wheres = [], []
            for w, filters in zip(WIDTHS, params, strict=False):
                n = len(x) - w + 1
                conv = sum(x[j : j + n] @ filters[j * DIM : (j + 1) * DIM] for j in range(w))
                mask_pads(conv, spots)
                where = np.array([s + conv[s : s + k + 1].argmax(axis=0) for s, k in zip(starts, np.diff(at), strict=True)])
                wheres.append(where)
                tops.append(np.take_along_axis(conv, where, axis=0))
            top = np.concatenate(tops, axis=1) + params[3]
            hidden = np.maximum(top, 0)
            p = 1 / (1 + np.exp(-(hidden @ params[4] + params[5][0])))
            err = (weight[rows] * (p - y[rows]) / len(rows)).astype(np.float32)
            back = np.outer(err, params[4]) * (top > 0)
            grads = [np.zeros_like(q) for q in params]
            grads[3], grads[4], grads[5] = back.sum(axis=0), hidden.T @ err + 1e-4 * params[4], err.sum(keepdims=True)
            touched, pulls = [], []
            for k, (w, where) in enumerate(zip(WIDTHS, wheres, strict=True)):
                g = back[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(w):
                    seen = x[where + j]  # (texts, filters, DIM)
                    grads[k][j * DIM : (j + 1) * DIM] = np.einsum("df,dfe->ef", g, seen)
                    pull = (g[:, :, None] * params[k][j * DIM : (j + 1) * DIM].T[None]).reshape(-1, DIM)
                    for c in range(3):
                        touched.append(spots[(where + j).ravel(), c])
                        pulls.append(pull)
            touched, pulls = np.concatenate(touched), np.concatenate(pulls)
            used, place = np.unique(touched, return_inverse=True)
            total = np.zeros((len(used), DIM), np.float32)
            np.add.at(total, place, pulls)
            total[used == BUCKETS] = 0
            grown[used] += (total**2).mean(axis=1, keepdims=True)
            emb[used] -= 0.1 * total / np.sqrt(grown[used])
            step += 1
            for q, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return State(emb, grown, params, first, second, step)


def _learner(state: State, weights: tuple[float, float], rate: float, seed: int):
    """Trains a copy of the state on a task's rows (text, y); gives what it learnt: sums over one copy, to be added up."""
    held = [state.emb, state.grown, state.params, state.first, state.second, state.step]

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emb, grown, *rest = held
        own = State(emb.copy(), grown.copy(), *[[x.copy() for x in part] for part in rest[:3]], rest[3])
        docs, marks, size, many = [], [], 0, 0

        def go() -> None:
            nonlocal own, docs, marks, size
            y = np.array(marks, np.float32)
            own = trained(own, docs, y, np.where(y == 1, weights[1], weights[0]).astype(np.float32), rate, seed + many)
            docs, marks, size = [], [], 0

        for batch in batches:
            said, at = batch.column("y").to_numpy(), 0
            two = pa.record_batch([pa.array(np.zeros(batch.num_rows, np.int64)), batch.column("text")], names=["i", "text"])
            for chunk in texts(iter([two])):
                words, edges = tokens(chunk)
                words = words.astype(np.uint16)
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    docs.append(words[a:b])
                    marks.append(said[at])
                    at, many, size = at + 1, many + 1, size + 6 * int(b - a)
                    if size > HELD_BYTES:
                        go()
        go()
        if many:
            learnt = own.grown - grown
            small = np.concatenate([x.ravel() for part in (own.params, own.first, own.second) for x in part]).astype(np.float64) * many
            out = [learnt, (own.emb - emb) * learnt, learnt * learnt, small, np.array([many, many * own.step], np.float64)]
            yield pa.record_batch([pa.array([x.tobytes()], pa.binary()) for x in out], names=list(LEARNT))

    return learn


#: What a task gives of its copy: by embedding the weight, the weighted change and AdaGrad's weighted growth; other numbers times the task's texts; texts.
LEARNT = {"weight": np.float32, "change": np.float32, "growth": np.float32, "small": np.float64, "texts": np.float64}


def _added(total: list[np.ndarray] | None, row) -> list[np.ndarray]:
    return _merged(total, [np.frombuffer(row[name], kind) for name, kind in LEARNT.items()])


def _merged(a: list[np.ndarray] | None, b: list[np.ndarray] | None) -> list[np.ndarray] | None:
    return b if a is None else a if b is None else [x + y for x, y in zip(a, b, strict=True)]


def _averaged(state: State, total: list[np.ndarray]) -> State:
    weight, change, growth, small, (many, steps) = total
    sure = np.maximum(weight, 1e-12)[:, None]
    means, at, parts = small / many, 0, []
    for part in (state.params, state.first, state.second):
        parts.append([])
        for x in part:
            parts[-1].append(means[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
    return State(state.emb + change.reshape(state.emb.shape) / sure, state.grown + growth[:, None] / sure, *parts, max(1, round(steps / many)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", train_fold: Column | None = None, lang_col: str | None = "lang", rounds: int = EPOCHS) -> Model:
    """Train on all rows of ``docs`` (doc_id, text, perhaps a language) that ``labels`` (doc_id, label) marks with 0 or 1; an id with several labels counts as its largest."""
    prepare(docs.sparkSession)
    use = labels.filter(F.col(label).isin(0, 1) & (F.lit(True) if train_fold is None else train_fold)).filter("doc_id is not null").groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    use = keep(use)
    counts = {r["y"]: r["n"] for r in use.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    ones, zeros = counts.get(1, 0), counts.get(0, 0)
    width = FILTERS * len(WIDTHS)
    odds = float(np.log((ones + 1) / (zeros + 1)))
    plain = Model(np.zeros((BUCKETS + 1, FILTERS * sum(WIDTHS)), np.float32), np.zeros(width, np.float32), np.zeros(width, np.float32), odds, {"": 0.5})
    if not ones or not zeros:
        discard(use)
        return plain
    own = docs.select("doc_id", "text", (F.col(lang_col) if lang_col else F.lit("")).cast("string").alias("lang"))
    found = prefilter(own, "doc_id", use.select("doc_id")).join(use, "doc_id")
    held = (F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(6)) == 0).alias("held")
    size = found.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0)).alias("n")).first()["n"]
    rows = keep(found.select("doc_id", "text", "lang", "y", held).repartition(parts_for(size, PART_BYTES), F.xxhash64("doc_id", F.lit(7))))
    seen = {(r["held"], r["y"]): r["n"] for r in rows.groupBy("held", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    apart = all(seen.get((False, y), 0) for y in (0, 1))  # else all of the few texts are trained on
    many = [seen.get((False, y), 0) + (0 if apart else seen.get((True, y), 0)) for y in (0, 1)]
    if not sum(many):
        discard(use, rows)
        return plain
    marked = (rows.filter("not held") if apart else rows).select("text", "y").coalesce(parts_for(size, COPY_BYTES))
    weights = tuple(sum(many) / 2 / max(n, 1) for n in many)
    state = begin()
    for r in range(rounds):
        learnt = marked.mapInArrow(_learner(state, weights, 0.01 * (1 - 0.8 * r / rounds), 1000 * r), ", ".join(f"{name} binary" for name in LEARNT))
        state = _averaged(state, learnt.rdd.treeAggregate(None, _added, _merged))
    _, _, (*filters, bias, out, shift), *_ = state
    table = np.concatenate([state.emb @ f[j * DIM : (j + 1) * DIM] for f, w in zip(filters, WIDTHS, strict=True) for j in range(w)], axis=1)
    share = 0.0 if all(many) else float(np.log(max(many[1], 1) / max(many[0], 1)))
    model = Model(table, bias, out, float(shift[0]) + odds - share, {"": 0.5})
    model.thresholds.update(calibrated(with_toxicity((rows.filter("held") if apart else rows).select("text", "lang", "y"), model)))
    discard(use, rows)
    return model


def calibrated(scored: DataFrame, least: int = 20) -> dict[str, float]:
    """For each language with at least ``least`` texts of each label in ``scored`` (lang, y, score), the score with fewest errors, nearest 0.5 of equals."""
    one, wrong = F.col("y") == 1, lambda t: F.count(F.when((F.col("score") >= float(t)) != (F.col("y") == 1), 1))
    by = scored.filter("lang is not null").groupBy("lang").agg(F.count(F.when(one, 1)).alias("ones"), F.count(F.when(~one, 1)).alias("zeros"), F.array(*[wrong(t) for t in GRID]).alias("wrong"))
    rows = by.filter(F.least("ones", "zeros") >= least).collect()  # one row for each language
    return {r["lang"]: float(GRID[np.lexsort((np.abs(GRID - 0.5), np.array(r["wrong"])))[0]]) for r in rows}


def with_toxicity(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str | None = None, score_col: str = "score", reject_col: str | None = None) -> DataFrame:
    """``docs`` with all its columns and the score; ``reject_col`` says whether the score reaches its language's threshold.

    Columns of these two names that ``docs`` has already are replaced.
    """
    prepare(docs.sparkSession)
    docs = docs.drop(score_col, *([reject_col] if reject_col else []))
    held = docs.sparkSession.sparkContext.broadcast(tuple(model))
    place = docs.columns.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*held.value)
        for batch in batches:
            two = pa.record_batch([pa.array(np.zeros(batch.num_rows, np.int64)), batch.column(place)], names=["i", "text"])
            scores = [own.scores(chunk) for chunk in texts(iter([two]))]
            yield pa.record_batch([*batch.columns, pa.array(np.round(np.concatenate(scores), 6) if scores else np.zeros(0))], names=[*batch.schema.names, score_col])

    out = docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))
    if reject_col is None:
        return out
    limits = F.create_map(*[F.lit(x) for pair in model.thresholds.items() for x in pair])
    limit = F.coalesce(F.try_element_at(limits, F.col(lang_col)) if lang_col else F.lit(None), F.lit(model.thresholds[""]))
    return out.withColumn(reject_col, F.col(score_col) >= limit)
