"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes: each byte's random number is added to twice the last value, so after 16 bytes of 16-bit
arithmetic a byte is forgotten. A chunk ends where the hash is the greatest of the REACH places before and after it: chunks have more than REACH bytes, twice that on average, and an
end depends on the bytes around it alone, so an insertion shifts chunks and changes only those it touches. In periodic text greatest values come again and again;
of such ties the first in each REACH bytes from the first of all is taken. A chunk of LONGEST bytes is cut. Chunks are equal when their digests are (72 bits: a key
of 56 bits, 16 more, and the length).

Each occurrence of a chunk but the first has one partner: the one before it in its own text if there is one, else the earliest of all, in order of (doc_id, hash of
the text, place). Adjoining duplicates whose partners adjoin too are a run. A passage's ends lie inside chunks that differ, and pieces of it may have other
partners where they stand elsewhere too, so every run is extended to both sides byte by byte as far as the two texts agree: by CONTEXT bytes
first; the few that agree throughout go on with GROWTH times as many, until none does. Runs of the same two texts at the same
distance that meet are one. Only duplicates in a row of at least SEED bytes, with whatever partners, are looked at: a passage holds them in one row.
What then holds ``least`` words, and is not inside another such passage of its text, is reported.

Hot chunks cost their count: a text sends each of its chunks once, packets carry a task's repeats past the sort, minima combine before the shuffle,
and adaptive execution splits the join back.

Cases: null and empty texts have no chunks; identical rows are one row; null ids come first; a text shorter than a chunk
is one chunk. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .line_dedup import _rows
from .session import discard, keep, pick, prefilter, prepare, text_bytes, tidy
from .shared_keys import shared_keys
from .words import SPACE, Texts, U, mix, span_hashes, texts

REACH, LONGEST, LEAST = 16, 1024, 50
SEED, CONTEXT, GROWTH = 32, 160, 16
NONE = np.iinfo(np.int64).min
GEAR = (mix(np.arange(1, 257, dtype=U) * U(0xA24BAED4963EE407)) >> U(48)).astype(np.uint16)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, by doubling: of 1, 2, 4, 8, 16 bytes."""
    h = GEAR[data]
    for span in (1, 2, 4, 8):
        more = h.copy()
        more[span:] += h[:-span] << np.uint16(span)
        h = more
    return h


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all texts' chunks."""
    h = gear(data)
    most = h.copy()
    for span in (1, 2, 4, 8):  # the greatest of REACH places up to each
        most[span:] = np.maximum(most[span:], most[:-span])
    before, after = np.zeros_like(h), np.zeros_like(h)
    before[1:] = most[:-1]
    after[:-REACH] = most[REACH:]
    ends = np.flatnonzero((h >= before) & (h >= after)) + 1
    # Ties: ends at most REACH apart are of one periodic stretch.
    first = np.ones(len(ends), bool)
    first[1:] = np.diff(ends) > REACH
    begin = ends[first][np.cumsum(first) - 1] if len(ends) else ends
    step = (ends - begin) // REACH
    first[1:] |= step[1:] > step[:-1]
    ends = ends[first]
    own = offsets[1:][np.diff(offsets) > 0]
    ends = np.unique(np.concatenate([ends, own]))
    starts = np.concatenate([[0], ends[:-1]])
    more = (ends - starts - 1) // LONGEST
    if more.any():
        place = np.repeat(np.arange(len(ends)), more)
        step = np.arange(len(place)) - np.repeat(np.cumsum(more) - more, more) + 1
        ends = np.sort(np.concatenate([ends, starts[place] + step * LONGEST]))
        starts = np.concatenate([[0], ends[:-1]])
    return starts, ends


class Chunks:
    """The chunks of all texts of ``chunk``: hashes, places, and of each the place before it in its text with an equal chunk, else -1."""

    def __init__(self, chunk: Texts) -> None:
        starts, ends = chunks(chunk.data, chunk.offsets) if len(chunk.data) else (np.zeros(0, np.int64),) * 2
        self.h, self.text = span_hashes(chunk.data, starts, ends), np.searchsorted(chunk.offsets, starts, side="right") - 1
        self.start, self.size = starts - chunk.offsets[self.text], ends - starts
        order = np.lexsort((self.start, self.h, self.text))
        same = (self.h[order[1:]] == self.h[order[:-1]]) & (self.text[order[1:]] == self.text[order[:-1]])
        self.before = np.full(len(order), -1, np.int64)
        self.before[order[1:][same]] = self.start[order[:-1][same]]
        self.doc, self.row = np.where(chunk.valid, chunk.ids, NONE), _rows(chunk).view(np.int64)


def _expand(chunk: Texts):
    """Keys of each text's chunks, equal ones of a text once."""
    own = Chunks(chunk)
    use = own.before < 0
    h = own.h[use]
    check = mix(h ^ U(0x51ED270B0A1F5D27)) & U(0xFFFF)
    return own.doc, own.row, h, own.text[use], (own.start[use] << 28) | (own.size[use] << 16) | check.astype(np.int64)


LATER = pa.schema([(c, pa.int64()) for c in ("doc", "row", "start", "end", "kdoc", "krow", "kstart")])


def _own_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks that their own text has before."""
    for chunk in texts(batches):
        own = Chunks(chunk)
        use = own.before >= 0
        if use.any():
            doc, row, start = own.doc[own.text[use]], own.row[own.text[use]], own.start[use]
            yield pa.record_batch([pa.array(x) for x in (doc, row, start, start + own.size[use], doc, row, own.before[use])], schema=LATER)


SIDES = pa.schema([(c, pa.int64()) for c in ("doc", "row", "start", "end")] + [("left", pa.binary()), ("right", pa.binary()), ("begun", pa.int64()), ("ended", pa.int64())])
SIDES_DDL = "doc long, row long, start long, end long, left binary, right binary, begun long, ended long"


def begins(x: np.ndarray) -> np.ndarray:
    """Which bytes begin a word; the first does if it is no space."""
    dark = ~SPACE[x]
    out = dark.copy()
    out[1:] &= ~dark[:-1]
    return out


def _sides(reach: int):
    """For each place asked of a text: ``reach`` bytes before and after it and one more before each, and how many of the text's words begin before its start and its end."""

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked, at = batch.column("asked").to_pylist(), 0
            for chunk in texts(iter([batch.select(["doc", "text"])])):
                out, rows, edges = [], _rows(chunk).view(np.int64).tolist(), chunk.offsets.tolist()
                for i, doc in enumerate(chunk.ids.tolist()):
                    places = [p for p in asked[at + i] if p["row"] == rows[i]]
                    if not places:
                        continue
                    data = chunk.data[edges[i] : edges[i + 1]]
                    total, raw = np.concatenate([[0], np.cumsum(begins(data))]), data.tobytes()
                    for p in places:
                        a, b = p["start"], p["end"]
                        out.append((doc, rows[i], a, b, raw[max(0, a - reach - 1) : a], raw[b - 1 : b + reach], int(total[a]), int(total[b])))
                at += len(chunk.ids)
                if out:
                    yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), SIDES, strict=True)], schema=SIDES)

    return sides


def agree(a: bytes, b: bytes) -> int:
    """Length of the common start."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return int(differ[0]) if len(differ) else n


SPAN = pa.schema([(c, pa.int64()) for c in ("doc", "row", "kdoc", "krow", "far", "start", "end", "begun", "ended")] + [("open_left", pa.bool_()), ("open_right", pa.bool_())])
SPAN_DDL = ", ".join(f"{c} long" for c in SPAN.names[:9]) + ", open_left boolean, open_right boolean"


def _grow(reach: int):
    """Extends spans on their open sides; a side that agrees for all of ``reach`` stays open."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                left, right, start, end = r["left"], r["right"], r["start"], r["end"]
                back = agree(left[::-1][:reach], r["kept_left"][::-1][:reach]) if r["open_left"] else 0
                on = agree(right[1:], r["kept_right"][1:]) if r["open_right"] else 0
                first = begins(np.frombuffer(left, np.uint8))
                next_ = begins(np.frombuffer(right, np.uint8))
                begun = r["begun"] - int(first[len(left) - back :].sum())
                out.append((r["doc"], r["row"], r["kdoc"], r["krow"], r["far"], start - back, end + on, begun, r["ended"] + int(next_[1 : 1 + on].sum()), back == reach, on == reach))
            if out:
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), SPAN, strict=True)], schema=SPAN)

    return grow


def _meeting(spans: DataFrame) -> DataFrame:
    """Spans of the same two texts at the same distance that meet are one."""
    same = ["doc", "row", "kdoc", "krow", "far"]
    order = Window.partitionBy(*same).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    named = spans.withColumn("new", F.when(before >= F.col("start"), 0).otherwise(1)).withColumn("group", F.sum("new").over(order))
    lo = F.min(F.struct("start", "begun", "open_left")).alias("lo")
    hi = F.max(F.struct("end", "ended", "open_right")).alias("hi")
    return named.groupBy(*same, "group").agg(lo, hi).select(*same, "lo.start", "hi.end", "lo.begun", "hi.ended", "lo.open_left", "hi.open_right")


def _extended(docs: DataFrame, spans: DataFrame, reach: int) -> DataFrame:
    """The open ``spans`` after one more step; only texts that have an end of theirs are shuffled."""
    kept = spans.select(F.col("kdoc").alias("doc"), F.col("krow").alias("row"), (F.col("start") - F.col("far")).alias("start"), (F.col("end") - F.col("far")).alias("end"))
    asked = keep(spans.select("doc", "row", "start", "end").union(kept).distinct())
    places = asked.groupBy("doc").agg(F.collect_list(F.struct("row", "start", "end")).alias("asked"))
    named = docs.select(F.coalesce("doc_id", F.lit(NONE)).alias("doc"), "text")
    near = prefilter(named, "doc", asked.select("doc").distinct()).join(places, "doc").select("doc", "text", "asked")
    sides = keep(near.mapInArrow(_sides(reach), SIDES_DDL).dropDuplicates(["doc", "row", "start", "end"]))
    other = sides.select(F.col("doc").alias("kdoc"), F.col("row").alias("krow"), F.col("start").alias("kstart"), F.col("end").alias("kend"), F.col("left").alias("kept_left"), F.col("right").alias("kept_right"))
    both = spans.drop("begun", "ended").join(sides, ["doc", "row", "start", "end"])
    both = both.withColumn("kstart", F.col("start") - F.col("far")).withColumn("kend", F.col("end") - F.col("far")).join(other, ["kdoc", "krow", "kstart", "kend"])
    grown = keep(both.mapInArrow(_grow(reach), SPAN_DDL))
    discard(asked, sides)
    return grown


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(doc_id, start_byte, n_bytes, n_words, kept_doc_id): passages of at least ``least`` words that an earlier place has."""
    prepare(docs.sparkSession)
    docs = pick(docs, doc_id=id_col, text=text_col)
    found = shared_keys(docs, _expand, text_bytes(docs) / 30)
    held = keep(found.select("key", F.expr("note & 268435455").alias("tail"), F.col("owner").alias("doc"), F.col("remark").alias("row"), F.expr("shiftright(note, 28)").alias("start")))
    tidy(docs.sparkSession)
    first = held.groupBy("key", "tail").agg(F.min(F.struct("doc", "row", "start")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = held.join(first, ["key", "tail"]).filter(F.struct("doc", "row", "start") != F.col("first"))
    later = later.select("doc", "row", "start", (F.col("start") + F.expr("shiftright(tail, 16)")).alias("end"), F.col("first.doc").alias("kdoc"), F.col("first.row").alias("krow"), F.col("first.start").alias("kstart"))
    later = later.union(docs.mapInArrow(_own_repeats, ", ".join(f"{c} long" for c in LATER.names))).distinct()
    by = Window.partitionBy("doc", "row").orderBy("start")
    last = lambda c: F.lag(c).over(by)
    beside = last("end") == F.col("start")
    joined = beside & (last("kdoc") == F.col("kdoc")) & (last("krow") == F.col("krow")) & (F.col("start") - last("start") == F.col("kstart") - last("kstart"))
    placed = later.withColumn("new", F.when(joined, 0).otherwise(1)).withColumn("row_new", F.when(beside, 0).otherwise(1))
    placed = placed.withColumn("run", F.sum("new").over(by)).withColumn("in_row", F.sum("row_new").over(by))
    runs = placed.groupBy("doc", "row", "in_row", "run").agg(F.min(F.struct("start", "kdoc", "krow", "kstart")).alias("x"), F.max("end").alias("end"))
    bytes_ = F.sum(F.col("end") - F.col("x.start")).over(Window.partitionBy("doc", "row", "in_row"))
    runs = runs.withColumn("bytes", bytes_).filter(F.col("bytes") >= SEED)
    none, open_ = F.lit(None).cast("bigint"), F.lit(True)
    spans = keep(runs.select("doc", "row", "x.kdoc", "x.krow", (F.col("x.start") - F.col("x.kstart")).alias("far"), "x.start", "end", none.alias("begun"), none.alias("ended"), open_.alias("open_left"), open_.alias("open_right")))
    discard(held)
    reach, done = CONTEXT, None
    while True:
        grown = _extended(docs, spans, reach)
        every = keep(_meeting(grown if done is None else grown.unionByName(done)))
        discard(spans, grown, *([done] if done is not None else []))
        is_open = F.col("open_left") | F.col("open_right")
        if every.filter(is_open).isEmpty():
            break
        spans, done = keep(every.filter(is_open)), keep(every.filter(~is_open))
        discard(every)
        reach *= GROWTH
    out = every.filter(F.col("ended") - F.col("begun") >= least)
    upto = F.max("end").over(Window.partitionBy("doc", "row").orderBy("start", F.desc("end"), "kdoc", "krow", "far").rowsBetween(Window.unboundedPreceding, -1))
    out = out.withColumn("upto", upto).filter(F.coalesce(F.col("upto") < F.col("end"), F.lit(True)))
    known = lambda c: F.when(F.col(c) != NONE, F.col(c))
    return out.select(known("doc").alias("doc_id"), F.col("start").alias("start_byte"), (F.col("end") - F.col("start")).alias("n_bytes"), (F.col("ended") - F.col("begun")).alias("n_words"), known("kdoc").alias("kept_doc_id"))
