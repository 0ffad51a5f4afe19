"""Line dedup by a deletion-neighbourhood join.

A line is its words, A-Z lower-cased; blank lines never go. Two lines are near when their words are within one edit (a
word replaced, added or left out) and the longer has at least LEAST words; equal lines always are. A line goes
when an earlier line, in order of (doc_id, hash of the text, line number), is near it, whether or not that one
stays; so the result doesn't depend on an order of work.

Each line's neighbourhood is every variant with one word left out. Lines with an equal variant at the same position
differ in that word alone; a variant that equals a whole line lacks one word of it. Variants become hashed keys, equal keys
join, and each key needs only its earliest line, so a key's work is linear however hot it is. The matches
are then verified by the edit distance of the lines' words.

Only lines that can have a partner send variants: one edit leaves the first or the second half of the shorter
line whole, so first the halves (four keys a line) are joined. A bit table of the lines that share one, of
FILTER_BITS bits, goes to all tasks, which then read those lines' words, once for variants and verification.

Cases: null, empty and blank texts have no lines, and their documents no dropped ones; identical rows are kept or dropped alike and each has its row in the result; null ids come first; an empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import discard, keep, pick, prepare, text_bytes
from .shared_keys import shared_keys
from .words import BASE, INVERSE, Texts, U, mix, powers, span_hashes, texts

LEAST, FILTER_BITS = 8, 1 << 26


class Lines:
    """The lines of a chunk that have words: each one's text, number, words and hash."""

    def __init__(self, chunk: Texts) -> None:
        data, starts, ends, at = chunk.words()
        self.h = span_hashes(data, starts, ends)
        text = np.repeat(np.arange(len(at) - 1), np.diff(at))
        breaks = np.cumsum(chunk.data == 10)
        number = breaks[starts] if len(starts) else np.zeros(0, np.int64)
        new = np.ones(len(starts), bool)
        new[1:] = (text[1:] != text[:-1]) | (number[1:] != number[:-1])
        self.first = np.flatnonzero(new)
        self.size = np.diff(np.append(self.first, len(starts)))
        self.text = text[self.first]
        before = np.concatenate([[0], breaks])[chunk.offsets[:-1]] if len(breaks) else np.zeros(len(at) - 1, np.int64)
        self.number = number[self.first] - before[self.text]
        n = len(starts) + 2
        self.up, self.down = powers(BASE, n), powers(INVERSE, n)
        self.total = np.concatenate([[U(0)], np.cumsum(self.h * self.up[: len(self.h)])]).astype(U)
        self.id = mix(self.part(self.first, self.first + self.size) + self.size.astype(U) * U(INVERSE))
        self.spans = starts, ends

    def part(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hash of the words from ``lo`` to ``hi``."""
        return (self.total[hi] - self.total[lo]) * self.down[lo]

    def variants(self, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word of the lines ``use``: the line, the position, the hash of the line without it."""
        size, first = self.size[use], self.first[use]
        line = np.repeat(np.arange(len(use)), size)
        place = np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size)
        word = first[line] + place
        lo, hi = first[line], (first + size)[line]
        left = self.part(lo, word)
        return line, place, left + self.part(word + 1, hi) * self.up[place]

    def halves(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Four keys of each line, and whether it has them: its halves as the shorter of two lines, and as the longer by a word."""
        first, size, out = self.first, self.size, []
        for c in (size, size - 1):
            half = c // 2
            out.append(mix(self.part(first, first + half) + c.astype(U) * U(BASE)))
            out.append(mix(self.part(first + size - (c - half), first + size) + c.astype(U) * U(INVERSE)))
        return [(k, size >= LEAST - 1) for k in out]


def _new(ids: np.ndarray) -> np.ndarray:
    """One place for each distinct id."""
    return np.sort(np.unique(ids, return_index=True)[1])


def _half_keys(batch: pa.RecordBatch):
    """Owners and keys from rows (id, k0, k1, k2, k3)."""
    ids = batch.column("id").to_numpy()
    keys, place = [], []
    for c in ("k0", "k1", "k2", "k3"):
        there = np.flatnonzero(~np.asarray(batch.column(c).is_null()))
        keys.append(batch.column(c).fill_null(0).to_numpy()[there].view(U))
        place.append(there)
    keys = np.concatenate(keys)
    return ids, np.zeros(len(ids), np.int64), keys, np.concatenate(place), np.zeros(len(keys), np.int64)


def _slots(ids: np.ndarray, bits: int) -> np.ndarray:
    return ((ids.astype(U) >> U(7)) % U(bits)).astype(np.int64)


def _neighbourhood(chunk: Texts):
    """Keys of lines (id, words): for replaced words (by position; note 0), for left-out words (note 2), and of the whole line (note 1)."""
    lines = Lines(chunk)
    use = np.arange(len(lines.first))
    long = use[lines.size >= LEAST]
    line, place, variant = lines.variants(long)
    size = lines.size[long][line].astype(U)
    swap = mix(variant + (place.astype(U) * U(64) + U(3)) * U(BASE) + size * U(INVERSE))
    lack = mix(variant + (size - U(1)) * U(INVERSE))
    whole = mix(lines.part(lines.first, lines.first + lines.size) + lines.size.astype(U) * U(INVERSE))
    keys = np.concatenate([swap, lack, whole])
    places = np.concatenate([long[line], long[line], use])
    notes = np.concatenate([np.zeros(len(swap), np.int64), np.full(len(lack), 2), np.ones(len(whole), np.int64)])
    return lines.id.view(np.int64), np.zeros(len(use), np.int64), keys, places, notes


LINE = pa.schema([(c, pa.int64()) for c in ("doc_id", "row", "line", "id", "k0", "k1", "k2", "k3")])


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, row, line, id, k0..k3) of all lines with words; row is a hash of the text, k0..k3 are the halves' keys. A text without such lines has one row with nulls."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in texts(batches):
            lines = Lines(chunk)
            row = _rows(chunk).view(np.int64)
            yield pa.record_batch([pa.array(chunk.ids[lines.text], mask=~chunk.valid[lines.text]), pa.array(row[lines.text]), pa.array(lines.number), pa.array(lines.id.view(np.int64)), *[pa.array(k.view(np.int64), mask=~there) for k, there in lines.halves()]], schema=LINE)
            bare = np.setdiff1d(np.arange(len(chunk.ids)), lines.text)
            if len(bare):
                yield pa.record_batch([pa.array(chunk.ids[bare], mask=~chunk.valid[bare]), pa.array(row[bare]), *[pa.nulls(len(bare), pa.int64()) for _ in LINE.names[2:]]], schema=LINE)

    return docs.mapInArrow(split, ", ".join(f"{c} long" for c in LINE.names))


def _rows(chunk: Texts) -> np.ndarray:
    """A hash of each whole text."""
    out = np.zeros(len(chunk.ids), U)
    some = np.diff(chunk.offsets) > 0
    out[some] = span_hashes(chunk.data, chunk.offsets[:-1][some], chunk.offsets[1:][some])
    return out


def _texts_of(docs: DataFrame, wanted: DataFrame, bits: int) -> DataFrame:
    """(id, words) of the lines in ``wanted`` (id), once each."""
    table = docs.sparkSession.sparkContext.broadcast(_table(wanted, bits))
    schema = pa.schema([("id", pa.int64()), ("words", pa.string())])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in texts(batches):
            lines = Lines(chunk)
            use = _new(lines.id)
            slot = _slots(lines.id[use], bits)
            use = use[(table.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1) == 1]
            starts, ends = lines.spans
            raw = chunk.words()[0].tobytes()
            got = [b" ".join(raw[starts[first] : ends[first + size - 1]].split()).decode("utf-8", "replace") for first, size in zip(lines.first[use].tolist(), lines.size[use].tolist(), strict=True)]
            yield pa.record_batch([pa.array(lines.id[use].view(np.int64)), pa.array(got, pa.string())], schema=schema)

    found = docs.mapInArrow(take, "id long, words string").join(wanted, "id", "left_semi")
    return found.groupBy("id").agg(F.min("words").alias("words"))


def _table(ids: DataFrame, bits: int) -> np.ndarray:
    """A bit for each slot of the ids, set by tasks' words of 64 bits: at most bits / 64 rows come back."""
    slot = F.expr(f"pmod(shiftrightunsigned(id, 7), {bits}L)")
    words = ids.select(slot.alias("slot")).groupBy(F.expr("cast(slot div 64 as int)").alias("place")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("word")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words.column("place").to_numpy()] = words.column("word").to_numpy()
    return table.view(np.uint8)


def near_words(a: list[str], b: list[str]) -> bool:
    """Whether one edit of a word at most makes ``a`` of ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of the rows (id, words, other) whose words are near."""
    for batch in batches:
        ids, words, other = (batch.column(c).to_pylist() for c in ("id", "words", "other"))
        yield pa.record_batch([pa.array([i for i, a, b in zip(ids, words, other, strict=True) if near_words(a.split(" "), b.split(" "))], pa.int64())], names=["id"])


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = FILTER_BITS) -> DataFrame:
    """For each line with words: doc_id, row, line, dropped; a text without such lines has one row with a null line."""
    prepare(docs.sparkSession)
    docs = pick(docs, doc_id=id_col, text=text_col)
    every = keep(lines_of(docs))
    lines = every.filter("line is not null")
    order = F.struct("doc_id", "row", "line")
    first = keep(lines.groupBy("id").agg(F.min(order).alias("first"), *[F.min(k).alias(k) for k in ("k0", "k1", "k2", "k3")]))
    halves = shared_keys(first.select("id", "k0", "k1", "k2", "k3"), _half_keys, 4 * first.count(), distinct=True, chunks=lambda batches: batches)
    shared = keep(halves.select(F.col("owner").alias("id")).distinct())
    words = keep(_texts_of(docs, shared, bits))
    found = shared_keys(words, _neighbourhood, 2 * text_bytes(words, "words") / 6, each=1 << 19)
    keys = keep(found.select("key", F.col("owner").alias("id"), F.col("note").alias("kind")).distinct().join(first.select("id", "first"), "id"))
    # Replaced words: all lines of a key are near, its earliest is enough. Left-out words: the whole line against the earliest longer one, each longer one against the whole.
    kind = lambda k: F.when(F.col("kind") == k, F.struct("first", "id"))
    least = keys.groupBy("key").agg(*[F.min(kind(k)).alias(f"of{k}") for k in (0, 1, 2)])
    other = F.when(F.col("kind") == 0, F.col("of0")).when(F.col("kind") == 1, F.col("of2")).otherwise(F.col("of1"))
    pairs = keys.join(least, "key").withColumn("other", other).filter(F.col("other.first") < F.col("first"))
    pairs = keep(pairs.groupBy("id").agg(F.min("other").getField("id").alias("earlier")))
    checked = pairs.join(words, "id").join(words.select(F.col("id").alias("earlier"), F.col("words").alias("other")), "earlier").select("id", "words", "other")
    near = keep(checked.mapInArrow(_verify, "id long").withColumn("near", F.lit(True)))
    discard(shared, keys, words, pairs)
    placed = lines.select("doc_id", "row", "line", "id").join(first.select("id", "first"), "id").join(near, "id", "left")
    bare = every.filter("line is null").select("doc_id", "row", "line", F.lit(False).alias("dropped"))
    return placed.select("doc_id", "row", "line", (F.coalesce("near", F.lit(False)) | (F.col("first") != order)).alias("dropped")).unionByName(bare)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = FILTER_BITS) -> DataFrame:
    """For each document, (doc_id, n_lines, n_dropped, dropped): its lines with words, and which of its lines (from 0) go."""
    lines = dropped_lines(docs, id_col, text_col, bits)
    gone = F.array_sort(F.collect_set(F.when(F.col("dropped"), F.col("line"))))
    found = lines.groupBy("doc_id", "row").agg(F.countDistinct("line").alias("n_lines"), F.count(F.lit(1)).alias("rows"), gone.alias("dropped"))
    same = F.expr("array_repeat(0, cast(rows div greatest(n_lines, 1) as int))")  # equal rows have the same lines
    return found.withColumn("copy", F.explode(same)).select("doc_id", "n_lines", F.size("dropped").cast("bigint").alias("n_dropped"), "dropped")
