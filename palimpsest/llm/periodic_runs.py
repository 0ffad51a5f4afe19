"""Runs of words that repeat with a period, by a harmonic grid of longest common extensions.

A run of period p and at least ``times`` * p words covers ``times`` neighbouring multiples of p. So for each period p, the places
jp and (j + 1)p are compared: their longest common extension forwards and the one backwards give the longest
stretch of period p around them. All periods together have n / 1 + n / 2 + ... such pairs, n log n and not n**2. Extensions come from a suffix
array, the common prefixes of its neighbours and a table of their range minima; the extensions backwards from the same of the
reversed words. Pairs whose words differ, or that don't have enough equal neighbours on the grid, have no run through them and are not asked for; a text without
any other needs no suffix array.

A stretch that has several periods of a ``times``-th of its length at most has their greatest common divisor as a period, and is then found with the
same ends at its smallest one; that one counts.

A document is worked on whole, in one task, with some 300 bytes a word; documents never meet, so nothing is shuffled.

Cases: null and empty texts have no words, no runs and an empty collapsed text. Equal words are equal bytes, also in upper and lower case. Rows that
repeat an id, or have none, each have their result. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .session import pick, prepare
from .words import Texts, release, texts

#: Pairs of the grid that are looked at at once, and words whose suffixes are sorted together (a longer text is sorted alone).
GRID, TOGETHER = 1 << 20, 1 << 17
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Extensions:
    """Longest common extensions of any two places of a sequence whose last member stands nowhere else."""

    def __init__(self, s: np.ndarray) -> None:
        n = len(s)
        ranks, step = [np.unique(s, return_inverse=True)[1].astype(np.int32)], 1
        while ranks[-1].max() < n - 1:  # ranks[k]: by the first 2**k members
            key = ranks[-1].astype(np.int64) * (n + 1)
            key[: n - step] += ranks[-1][step:] + 1
            order = np.argsort(key)
            key = key[order]
            rank = np.zeros(n, np.int32)
            rank[order[1:]] = np.cumsum(key[1:] != key[:-1])
            ranks.append(rank)
            step *= 2
        self.rank = ranks[-1]
        suffixes = np.empty(n, np.int64)
        suffixes[self.rank] = np.arange(n)
        a, b = suffixes[:-1].copy(), suffixes[1:].copy()
        for k in range(len(ranks) - 2, -1, -1):
            step = (ranks[k][a] == ranks[k][b]).astype(np.int64) << k
            a += step
            b += step
        common = (a - suffixes[:-1]).astype(np.int32)  # of neighbours in the suffix array
        levels = max(1, int(n - 1).bit_length())
        self.least = np.zeros((levels, max(1, n - 1)), np.int32)  # least[k, i]: the minimum of 2**k of them from i on
        self.least[0, : n - 1] = common
        for k in range(1, levels):
            to = n - (1 << k)
            self.least[k, :to] = np.minimum(self.least[k - 1, :to], self.least[k - 1, 1 << (k - 1) : (1 << (k - 1)) + to])

    def between(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many members from ``x`` and from ``y`` on are the same, for x and y that differ."""
        p, q = self.rank[x].astype(np.int64), self.rank[y].astype(np.int64)
        lo, hi = np.minimum(p, q), np.maximum(p, q)
        k = np.frexp(hi - lo)[1] - 1
        return np.minimum(self.least[k, lo], self.least[k, hi - (1 << k.astype(np.int64))]).astype(np.int64)


def anchors(w: np.ndarray, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places jp and periods p of the grid over the words ``w`` that a run may go through, in slices of the periods."""
    n = len(w)
    lo = 1
    while lo <= n // times:
        hi, room = lo, 0
        while hi <= n // times and (hi == lo or room + (n - 1) // hi <= GRID):  # slices hold GRID pairs at most, or one period's
            step = max(1, min(n // times + 1 - hi, (GRID - room) // max(1, (n - 1) // hi)))
            room += step * ((n - 1) // hi)
            hi += step
        p = np.arange(lo, hi)
        many = (n - 1) // p
        period = np.repeat(p, many)
        x = (np.arange(len(period)) - np.repeat(np.cumsum(many) - many, many)) * period
        same = w[x] == w[x + period]
        ok = same[: len(same) - times + 2].copy()
        for k in range(1, times - 1):
            ok &= same[k : len(same) - times + 2 + k]
        at = np.flatnonzero(ok)
        at = at[period[at] == period[at + times - 2]]
        if len(at):
            yield x[at], period[at]
        lo = hi


def runs_of(words: list[np.ndarray], least: int, times: int) -> list[np.ndarray]:
    """For each sequence of word numbers its runs: start, length and period, by start and period."""
    out = [np.zeros((0, 3), np.int64)] * len(words)
    held: list[int] = []
    for i, w in enumerate(words):
        if len(w) >= least and any(True for _ in anchors(w, times)):
            held.append(i)
        if held and (i == len(words) - 1 or sum(len(words[k]) for k in held) >= TOGETHER):
            _runs(words, held, least, times, out)
            held = []
    return out


def _runs(words: list[np.ndarray], held: list[int], least: int, times: int, out: list[np.ndarray]) -> None:
    """The runs of the sequences ``held``, whose suffixes are sorted together: each has members of its own, and one that stands nowhere else around it."""
    total = sum(len(words[i]) + 1 for i in held) + 1
    s = np.arange(total) + total  # separators
    begins, at = [], 1
    for i in held:
        begins.append(at)
        s[at : at + len(words[i])] = words[i] + at - 1  # numbers of words are below their count
        at += len(words[i]) + 1
    forwards, backwards = Extensions(s), Extensions(s[::-1])
    for i, begin in zip(held, begins, strict=True):
        found = [np.zeros((0, 3), np.int64)]
        for x, p in anchors(words[i], times):
            x = x + begin
            after = forwards.between(x, x + p)
            before = backwards.between(total - x, total - x - p)
            length = before + p + after
            ok = length >= np.maximum(least, times * p)
            found.append(np.unique(np.stack([x - before - begin, length, p], axis=1)[ok], axis=0))
        rows = np.unique(np.concatenate(found), axis=0)
        first = np.ones(len(rows), bool)
        first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)  # of one stretch, the smallest period
        rows = rows[first]
        out[i] = rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _numbers(words: list[bytes]) -> np.ndarray:
    """Equal words have equal numbers below their count."""
    seen: dict[bytes, int] = {}
    return np.fromiter(map(seen.setdefault, words, count()), np.int64, len(words))


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words no run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


def _rows(chunk: Texts, least: int, times: int) -> pa.RecordBatch:
    raw = chunk.data.tobytes()
    words = [raw[lo:hi].split() for lo, hi in zip(chunk.offsets[:-1], chunk.offsets[1:], strict=True)]
    found = runs_of([_numbers(w) for w in words], least, times)
    collapsed = [b" ".join(compress(w, kept_words(len(w), r).tolist()) if len(r) else w) for w, r in zip(words, found, strict=True)]
    flat = np.concatenate([np.zeros((0, 3), np.int64), *found])
    offsets = np.cumsum([0] + [len(r) for r in found])
    runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(RUN)))
    return pa.record_batch([pa.array(chunk.ids, mask=~chunk.valid), pa.array([len(w) for w in words], pa.int64()), runs, pa.array(collapsed, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, runs (start, length, period: by start, then period) and the collapsed text.

    A run has ``least`` words and ``times`` periods at least (two or more) and no neighbour extends it; the collapsed text lacks what
    a run repeats after its first period.
    """
    if times < 2:
        raise ValueError("a run has two periods at least")
    prepare(docs.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in texts(batches):
            yield _rows(chunk, least, times)
        release()

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(find, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
