"""Benchmark decontamination: passages of texts within a word edit distance of a benchmark item.

Words are runs of letters and digits, lower-cased. An item of L words matches where some window of a text is within
floor(RATIO * L) edits of it. Windows begin at every word. A CGK walk reads the word it is at and then
stays or moves on by a random bit of that word and the step: two strings an edit apart soon walk in
step again, so edit distance becomes Hamming distance of what the walks read. Of each walk a few steps are
sampled; equal samples make a candidate (bit-sampling LSH), and WALKS independent walks bring the recall to its target.

The Hamming distance grows faster than the edits do, so one walk over a long item would need ever more repetitions.
An item is therefore walked from each of its ceil(L / PART) equal parts' first words. Of a window within the bound at least one part has at most
floor(RATIO * L) / ceil(L / PART) edits, which is one at most at the default ratio, so the recall of a
single edit in at most PART words holds for items of any length. Items that allow no edit are walked whole, every step is
sampled, and none is lost. A hit of a part that allows one edit is looked at word by word for it. Parts of like length form a class with its own steps. Before walking, a window must hold as many of
the class's words as its edits leave.

Hits of an item whose windows overlap are one candidate, verified by exact edit distance; it must first hold as many of the item's words
as the bound leaves, which loses nothing.

Items are the stated query set: in blocks they go to all tasks, one pass over the texts for each block. A block holds at most ITEMS items, and at most ITEM_BYTES
of their texts besides its last item. Texts are not shuffled.

Cases: null and empty texts and items match nothing; items under seven words at the default ratio match exactly only; repeated
items and rows each give their rows; null ids are kept. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import keep, parts_for, pick, prepare
from .words import Texts, U, mix, span_hashes, texts

RATIO, PART, WALKS, SAMPLES, ITEMS = 0.15, 13, 16, 3, 20_000
#: Bytes of items' texts in a block; prepared items take some 20 to 30 times as much in each worker.
ITEM_BYTES = 4 << 20
#: Steps of a walk for each word of its class's least part, of which SAMPLES are read.
REACH = 1.4
#: Classes hold parts whose lengths differ by less than this factor.
SPREAD = 1.4
VOCABULARY_BITS = 20
#: Hits expanded together, of one text or more.
HITS = 1 << 20


class Keys(NamedTuple):
    """One walk's keys of the parts, sorted; whose they are, where their parts stand in them and how long they are. Two tables tell by
    some bits of a key, and of what it is after all samples but one, whether any part has it."""

    sorted: np.ndarray
    items: np.ndarray
    offsets: np.ndarray
    sizes: np.ndarray
    table: np.ndarray
    early: np.ndarray


class Class(NamedTuple):
    """Parts of like length, and the steps sampled of each walk."""

    least: int
    edits: int
    samples: list[np.ndarray]
    keys: list[Keys]


class Items(NamedTuple):
    """``flat``: all items' words; ``first``: where each item's begin, with the end."""

    words: list[np.ndarray]
    flat: np.ndarray
    first: np.ndarray
    classes: list[Class]
    vocabulary: np.ndarray
    ratio: float


def odd(seed: int) -> U:
    """A walk's multiplier: a bijection of words, whose bits tell where the walk moves on."""
    return U((0x9E3779B97F4A7C15 * (2 * seed + 1)) & (2**64 - 1) | 1)


def table_of(keys: np.ndarray) -> np.ndarray:
    """By some bits of a key, whether there is one; 16 to 32 slots for each key."""
    out = np.zeros(1 << max(12, (16 * len(keys)).bit_length()), bool)
    out[slot(keys, out)] = True
    return out


def slot(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    return (keys >> U(65 - len(table).bit_length())).view(np.int64)


def walk(spread: np.ndarray, starts: np.ndarray, sampled: np.ndarray, early: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Walks over words times odd(): places in ``starts`` that are still walking at the end, their keys, and the keys before the last
    sample. Walks that no part shares before the last sample are given up by the table ``early``."""
    which, at, key, before = np.arange(len(starts)), starts.copy(), np.zeros(len(starts), U), np.zeros(len(starts), U)
    wanted, last = set(sampled.tolist()), int(sampled[-1])
    for j in range(last + 1):
        w = spread[at]
        if j in wanted:
            before = key
            key = mix(key + w)
            if early is not None and len(sampled) > 1 and j == sampled[-2]:
                on = np.flatnonzero(early[slot(key, early)])
                which, at, key, w = which[on], at[on], key[on], w[on]
        at += ((w >> U(63 - j % 48)) & U(1)).view(np.int64)
    return which, key, before


def padded(words: np.ndarray, sampled: np.ndarray) -> np.ndarray:
    """The words and as many zeros as a walk may read beyond them."""
    return np.concatenate([words, np.zeros(int(sampled[-1]) + 1, U)])


def parts(length: int, ratio: float) -> np.ndarray:
    """Where an item's parts begin, and its end."""
    n = -(-length // PART) if int(ratio * length) else 1
    return np.arange(n + 1) * length // n


def prepare_items(words: list[np.ndarray], ratio: float = RATIO, walks: int = WALKS, samples: int = SAMPLES) -> Items:
    """Classes of the items' parts, their walks' keys, and for each word (by its first bits) the classes that have it."""
    classes, vocabulary = [], np.zeros(1 << VOCABULARY_BITS, np.uint32)
    flat = np.concatenate([*words, np.zeros(0, U)])
    first = np.cumsum([0, *[len(w) for w in words]])
    item, offset, size, edits = [], [], [], []
    for i, w in enumerate(words):
        cuts = parts(len(w), ratio) if len(w) else np.zeros(1, np.int64)
        item += [i] * (len(cuts) - 1)
        offset += cuts[:-1].tolist()
        size += np.diff(cuts).tolist()
        edits += [int(ratio * len(w)) // (len(cuts) - 1)] * (len(cuts) - 1) if len(w) else []
        if len(w) and int(ratio * len(w)):
            edits[-len(cuts) + 1 :] = [max(1, edits[-1])] * (len(cuts) - 1)
    item, offset, size, edits = (np.array(x, np.int64) for x in (item, offset, size, edits))
    rng = np.random.default_rng(5)
    for none in (True, False):  # parts that allow no edit, one class for each length; the rest by like length
        rest = np.unique(size[(edits == 0) == none])
        while len(rest):
            least = int(rest[0])
            inside = rest[:1] if none else rest[rest < max(least * SPREAD, least + 1)]
            rest = rest[len(inside) :]
            chosen = np.flatnonzero(((edits == 0) == none) & (size >= least) & (size <= inside[-1]))
            sampled = [np.arange(least)] if none else [np.sort(rng.choice(int(REACH * least), min(samples, least), replace=False)) for _ in range(walks)]
            starts = first[item[chosen]] + offset[chosen]
            keys = []
            for seed, own in enumerate(sampled):
                _, k, before = walk(padded(flat, own) * odd(seed), starts, own)
                order = np.argsort(k, kind="stable")
                keys.append(Keys(k[order], item[chosen][order], offset[chosen][order], size[chosen][order], table_of(k), table_of(before)))
            if len(classes) < 31:
                spots = np.repeat(starts, size[chosen]) + np.arange(size[chosen].sum()) - np.repeat(np.cumsum(size[chosen]) - size[chosen], size[chosen])
                vocabulary[(flat[spots] >> U(64 - VOCABULARY_BITS)).astype(np.int64)] |= np.uint32(1 << len(classes))
            classes.append(Class(least, int(edits[chosen].max()), sampled, keys))
    return Items(words, flat, first, classes, vocabulary, ratio)


def nearest(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of the item to any window of the text; the earliest such window's first word and end."""
    n = len(text)
    place = np.arange(n + 1)
    row, origin = np.zeros(n + 1, np.int64), place.copy()
    for word in item:
        swap = row[:-1] + (text != word)
        drop = row + 1
        new, first = drop.copy(), origin.copy()
        better = (swap < new[1:]) | ((swap == new[1:]) & (origin[:-1] < first[1:]))
        new[1:][better], first[1:][better] = swap[better], origin[:-1][better]
        # Insertions: the least of new[j'] + j - j' for j' up to j.
        code = (new - place) * (2 * n + 2) + first
        code = np.minimum.accumulate(code)
        row, origin = code // (2 * n + 2) + place, code % (2 * n + 2)
    end = int(np.argmin(row))
    return int(row[end]), int(origin[end]), end


def one_edit(words: np.ndarray, at: np.ndarray, ends: np.ndarray, flat: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the words from each ``at`` (before ``ends``) begin with something at most an edit from the part of ``sizes`` words from ``first``.

    The equal words at the start and those at the end, for each shift of an edit, then make up the part but for a word.
    """
    top, n = len(words) - 1, np.zeros(len(at), np.int64)
    same = np.ones(len(at), bool)
    for j in range(int(sizes.max(initial=0))):
        same &= (j < sizes) & (at + j < ends) & (words[np.minimum(at + j, top)] == flat[np.minimum(first + j, len(flat) - 1)])
        n += same
    ok = n >= sizes - 1
    for shift in (-1, 0, 1):
        tail, same = np.zeros(len(at), np.int64), np.ones(len(at), bool)
        for j in range(1, int(sizes.max(initial=0)) + 1):
            spot = at + sizes - j + shift
            same &= (j <= sizes) & (spot >= at) & (spot < ends) & (words[np.clip(spot, 0, top)] == flat[np.maximum(first + sizes - j, 0)])
            tail += same
        ok |= n + tail >= sizes - (shift <= 0)
    return ok


def candidates(chunk_words: np.ndarray, at: np.ndarray, items: Items) -> Iterator[tuple[int, int, np.ndarray]]:
    """(text, item, words where the item would begin): those of a text and item whose windows overlap."""
    text_of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    end_of = at[1:][text_of]
    marks = items.vocabulary[(chunk_words >> U(64 - VOCABULARY_BITS)).astype(np.int64)]
    n = len(marks)
    found, total = [], np.zeros(len(at) - 1, np.int64)
    for c, own in enumerate(items.classes):
        known = ((marks >> np.uint32(c)) & np.uint32(1)).astype(np.int64) if c < 31 else np.ones(n, np.int64)
        sums = np.concatenate([[0], np.cumsum(known)])
        least = own.least - own.edits
        starts = np.flatnonzero((sums[np.minimum(np.arange(n) + own.least, n)] - sums[:-1] >= least) & (end_of - np.arange(n) >= least))
        for seed, (sampled, keys) in enumerate(zip(own.samples, own.keys, strict=True)):
            which, got, _ = walk(padded(chunk_words, sampled) * odd(seed), starts, sampled, keys.early)
            some = np.flatnonzero(keys.table[slot(got, keys.table)])
            which, got = which[some], got[some]
            begin = np.searchsorted(keys.sorted, got)
            count = np.searchsorted(keys.sorted, got, side="right") - begin
            hit = count > 0
            where = starts[which[hit]]
            found.append((keys, own.edits, where, begin[hit], count[hit]))
            total += np.bincount(text_of[where], count[hit], len(total)).astype(np.int64)
    lengths = np.array([len(w) for w in items.words])
    group = np.cumsum(total) // HITS
    for g in np.unique(group[total > 0]).tolist():
        hits = []
        for keys, edits, spots, first, times in found:
            inside = group[text_of[spots]] == g
            place, begin, count = spots[inside], first[inside], times[inside]
            which = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
            place = np.repeat(place, count)
            if edits == 1:
                near = one_edit(chunk_words, place, end_of[place], items.flat, items.first[keys.items[which]] + keys.offsets[which], keys.sizes[which])
                place, which = place[near], which[near]
            hits.append((text_of[place], keys.items[which], place - keys.offsets[which]))
        text, item, start = (np.concatenate(x) for x in zip(*hits, strict=True))
        order = np.lexsort((start, item, text))
        text, item, start = text[order], item[order], start[order]
        reach = lengths[item] + 2 * (items.ratio * lengths[item]).astype(np.int64)
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (np.diff(start) > reach[1:])
        cuts = [*np.flatnonzero(new).tolist(), len(text)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(text[a]), int(item[a]), np.unique(start[a:b])


def find(chunk_words: np.ndarray, at: np.ndarray, items: Items) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, first word, words, distance) of matches in a chunk."""
    if not len(chunk_words):
        return
    seen: dict[tuple[int, int], tuple[int, int, int]] = {}
    for text, place, starts in candidates(chunk_words, at, items):
        item, low, high = items.words[place], int(at[text]), int(at[text + 1])
        bound = int(items.ratio * len(item))
        best = seen.get((text, place))
        if best is not None and best[0] == 0:
            continue  # an earlier window is the item itself
        lo, hi = max(low, int(starts[0]) - bound), min(high, int(starts[-1]) + len(item) + bound)
        same = next((x for x in starts.tolist() if low <= x <= high - len(item) and np.array_equal(chunk_words[x : x + len(item)], item)), None)
        if same is not None:
            d, a, b = 0, same - lo, same - lo + len(item)
        elif np.isin(item, chunk_words[lo:hi]).sum() < len(item) - bound:
            continue  # each missing word is an edit
        else:
            d, a, b = nearest(item, chunk_words[lo:hi])
        if d <= bound:
            match = (d, lo + a - low, b - a)
            if best is None or match < best:
                seen[text, place] = match
    for (text, place), (d, a, n) in sorted(seen.items()):
        yield text, place, a, n, d


def hashed_words(chunk: Texts) -> tuple[np.ndarray, np.ndarray]:
    data, starts, ends, at = chunk.letters()
    return span_hashes(data, starts, ends), at


def item_blocks(items: DataFrame, block: int = ITEMS, block_bytes: int = ITEM_BYTES) -> list[DataFrame]:
    """``items`` in blocks of at most ``block`` rows and, besides the last one's, ``block_bytes`` of their texts.

    Rows are dealt to buckets by chance, so repeated ones don't meet; buckets that came out too large are cut.
    """
    least = -(-block_bytes // block)
    weight = F.greatest(F.coalesce(F.octet_length("text"), F.lit(0)), F.lit(least)).cast("bigint")
    total = items.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("n")).first()["n"]
    if total <= block_bytes:
        return [items]
    buckets = parts_for(total, 0.8 * block_bytes)
    dealt = items.withColumn("weight", weight).withColumn("row", F.monotonically_increasing_id()).withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    before = F.sum("weight").over(Window.partitionBy("bucket").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    cut = keep(dealt.withColumn("before", F.coalesce(before, F.lit(0))).select("item_id", "text", "bucket", F.expr(f"before div {block_bytes}").alias("cut")))
    return [cut.filter((F.col("bucket") == b) & (F.col("cut") == c)).select("item_id", "text") for b, c in cut.select("bucket", "cut").distinct().orderBy("bucket", "cut").collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", ratio: float = RATIO, block: int = ITEMS, block_bytes: int = ITEM_BYTES) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, distance): for each text and item that match, the nearest window (the first of equals)."""
    spark = docs.sparkSession
    prepare(spark)
    docs = pick(docs, doc_id=id_col, text=text_col)
    items = pick(benchmark, item_id=item_col, text=item_text)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("distance", pa.int64())])
    out = None
    for some in item_blocks(items, block, block_bytes):
        rows = some.orderBy("item_id", "text").toArrow()
        words = []
        for chunk in texts(rows.to_batches()):
            h, at = hashed_words(chunk)
            words += [h[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
        ids = rows.column("item_id")
        held = spark.sparkContext.broadcast(tuple(prepare_items(words, ratio)))
        names = ids.to_pylist()

        def match(batches: Iterator[pa.RecordBatch], held=held, names=names) -> Iterator[pa.RecordBatch]:
            own = Items(*held.value)
            for chunk in texts(batches):
                h, at = hashed_words(chunk)
                found = [(int(chunk.ids[t]) if chunk.valid[t] else None, names[i], a, n, d) for t, i, a, n, d in find(h, at, own)]
                if found:
                    yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], schema=schema)

        part = docs.mapInArrow(match, "doc_id long, item_id long, start_word long, n_words long, distance long")
        out = part if out is None else out.unionByName(part)
    return out
