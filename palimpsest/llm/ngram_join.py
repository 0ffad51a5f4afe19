"""N-gram Jaccard join by parity sketches.

A text's set holds its distinct runs of five words (hashed to 64 bits). Hash the set into m parts and XOR
the hashes in each part: such a sketch is linear, so the parts in which two sketches differ number at most
the symmetric difference of the sets. Sets with Jaccard similarity t and sizes below B differ in
at most d = 2 (B - 1) (1 - t) / (1 + t) members, so all but d parts agree (pigeonhole): of the first
d + 1 + s parts that each set has, in one order for all sets, at least s + 1 are the same. Those parts'
digests are the join keys. Bands of sizes end at B = RATIO ** k; a set sends keys for its own band and for each one
beyond it that holds sizes it may link with, up to its size / t. The order puts parts first that hold a
shingle which a sample of texts (SAMPLE texts; at most 2**18 shingles) does not show to be common. The
sample decides the order alone: any order gives the same links, this one gives few candidates.

Candidates pass a second sketch, one bit toggled for each member, whose Hamming distance is a lower
bound too, and then an exact count over the whole texts.

Hot keys. Members of a key are first compared with one leader, then (HUBS times) with the member that has the
most links so far; this is linear in the key's size. Components of those links are formed, and only members of different components are compared again, so a large
group of copies costs its size and not its square. A key that still has more such pairs than
CROSS times its members is set aside. Linked sets share s + 1 keys at least, so a link with all of
them set aside exists only between two sets that each have that many set aside; among these sets the
pairs are formed after all. No link is lost.

Cases: null or empty texts, and texts without words, have an empty set and no links; with one to four words
the sequence is the only member. Equal ids are one node: rows stay, links of any of its texts count. Rows
with a null id keep a null component. Other columns are ignored. Exact copies are found by two
64-bit hashes of the set and its size; links between different sets are exact up to collisions of
64-bit hashes of shingles. Components are what is returned: members that are known to be in one component are not
compared any more, so links are not counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .session import discard, keep, pick, prefilter, prepare, text_bytes, tidy
from .shared_keys import shared_keys
from .words import BASE, Texts, U, mix, runs, span_hashes, texts

RATIO = 1.5
#: Pairs between different components that a key may form for each of its members.
CROSS = 4
#: Rounds in which a key's members are compared with its best linked member.
HUBS = 1
#: Bits of the second sketch for each member, at most MOST_BITS in all.
BITS, MOST_BITS = 2, 1 << 16
#: Texts, about, that tell which shingles are common; how many of them must have it; slots of the table of common ones.
SAMPLE, OFTEN, COMMON_BITS, MOST_COMMON = 1 << 13, 3, 22, 1 << 18


def word_sets(chunk: Texts, n: int) -> Iterator[np.ndarray]:
    """Per text the sorted hashes of its distinct runs of ``n`` words."""
    data, starts, ends, at = chunk.words()
    h = span_hashes(data, starts, ends)
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        if hi - lo >= n:
            yield np.unique(runs(h[lo:hi], n))
        else:
            yield runs(h[lo:hi], int(hi - lo)) if hi > lo else np.zeros(0, U)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set."""
    n = U(len(s))
    with np.errstate(over="ignore"):
        a = mix(np.array([s.sum(dtype=U) + n * U(BASE)], U))
        b = mix(np.array([mix(s ^ U(BASE)).sum(dtype=U) ^ n], U))
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


def bands(size: int, t: float) -> list[tuple[int, int, int, int]]:
    """(band, differences d, slack s, parts m) for which a set of this size sends keys."""
    if size < 1:
        return []
    k = 1
    while RATIO**k <= size:
        k += 1
    out = []
    while not out or RATIO ** (k - 1) <= size / t + 1e-9:
        most = int(np.ceil(RATIO**k)) - 1
        d = int(np.floor(2 * most * (1 - t) / (1 + t) + 1e-9))
        out.append((k, d, 2 + d // 8, 2 * d + 6))
        k += 1
    return [x for x in out if x[1]]


def sketch_keys(s: np.ndarray, t: float, common: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Keys of a set, with a note: the band, and how many keys must be set aside before a link can be lost."""
    often = common[(s >> U(64 - COMMON_BITS)).astype(np.int64)]
    for band, d, slack, m in bands(len(s), t):
        with np.errstate(over="ignore"):
            part = ((mix(s + U(band * 0x9E3779B9)) >> U(32)) * U(m) >> U(32)).astype(np.int64)
            digest = np.zeros(m, U)
            np.bitwise_xor.at(digest, part, s)
            full, rare = np.zeros(m, bool), np.zeros(m, bool)
            full[part] = True
            rare[part[~often]] = True
            where = np.flatnonzero(full)
            keys = mix(mix(digest[where]) + where.astype(U) * U(0xD6E8FEB86659FD93) + U(band) * U(BASE))
            first = np.lexsort((keys, ~rare[where]))[: d + 1 + slack]
            spare = min(slack + 1, len(where) - d)
            keys = keys[first]
            if spare <= 0:  # all members may be in parts that differ: such sets of a band meet under one key
                keys, spare = np.append(keys, mix(np.array([band], U))), 0
        yield keys, band << 24 | spare


def parity(s: np.ndarray) -> np.ndarray:
    """The second sketch: each member toggles one bit."""
    bits = 64
    while bits < min(BITS * len(s), MOST_BITS):
        bits *= 2
    where = (s >> U(20)) & U(bits - 1)
    return np.packbits((np.bincount(where.astype(np.int64), minlength=bits) & 1).astype(np.uint8))


def fold(sketch: np.ndarray, size: int) -> np.ndarray:
    """A shorter sketch: bits are counted modulo the length, and parity is linear."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, size), axis=0)


def common_shingles(docs: DataFrame, n: int) -> np.ndarray:
    """A table of slots (the hash's first bits) of shingles that at least OFTEN texts of the sample have."""
    every = docs.count() // SAMPLE + 1
    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in texts(batches):
            for s in word_sets(chunk, n):
                yield pa.record_batch([pa.array(s.view(np.int64))], names=["shingle"])

    found = some.mapInArrow(slots, "shingle long").groupBy("shingle").count().filter(F.col("count") >= OFTEN).orderBy(F.desc("count"), "shingle").limit(MOST_COMMON)
    table = np.zeros(1 << COMMON_BITS, bool)
    got = found.select("shingle").toArrow().column(0).to_numpy().view(U)
    table[(got >> U(64 - COMMON_BITS)).astype(np.int64)] = True
    return table


def _expand(n: int, t: float, common: np.ndarray):
    seen: dict[int, None] = {}

    def expand(chunk: Texts):
        owners, notes, keys, place = [], [], [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for ok, s in zip(chunk.valid, word_sets(chunk, n), strict=True):
            if not ok or not len(s):
                continue
            fp = fingerprint(s)[0]
            if fp in seen:  # a copy sends the same keys
                continue
            if len(seen) < 1 << 18:
                seen[fp] = None
            for k, note in sketch_keys(s, t, common):
                keys.append(k)
                place.append(np.full(len(k), len(owners), np.int64))
                owners.append(fp)
                notes.append(note)
        keys = np.concatenate(keys)
        return np.array(owners, np.int64), np.array(notes, np.int64), keys, np.concatenate(place), np.zeros(len(keys), np.uint32)

    return expand


def _fresh(n: int, t: float, table):
    """A new record of sets already sent for each task. ``table``: the broadcast of common_shingles()."""

    def expand(chunk: Texts):
        if not hasattr(expand, "own"):
            expand.own = _expand(n, t, np.unpackbits(table.value).astype(bool))
        return expand.own(chunk)

    return expand


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, fp, fp2 and parity of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp", pa.int64()), ("fp2", pa.int64()), ("parity", pa.binary())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in texts(batches):
            rows = [(len(s), *fingerprint(s), parity(s).tobytes()) for s in word_sets(chunk, n)]
            size, fp, fp2, sketch = zip(*rows, strict=True)
            yield pa.record_batch([pa.array(chunk.ids, mask=~chunk.valid), *[pa.array(x, pa.int64()) for x in (size, fp, fp2)], pa.array(sketch, pa.binary())], schema=schema)

    return docs.mapInArrow(sign, "doc_id long, n_shingles long, fp long, fp2 long, parity binary")


def _sets_of(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, members) of the sets of ``nodes`` (node, doc_id)."""
    schema = pa.schema([("node", pa.int64()), ("members", pa.binary())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in texts(batches):
            yield pa.record_batch([pa.array(chunk.ids), pa.array([s.tobytes() for s in word_sets(chunk, n)], pa.binary())], schema=schema)

    near = prefilter(docs, "doc_id", nodes.select("doc_id"))
    return near.join(nodes, "doc_id").select("node", "text").mapInArrow(make, "node long, members binary")


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _near(num: int, den: int):
    """Keeps pairs whose sizes and parities allow a link."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, size_a, size_b = (batch.column(c).to_numpy() for c in ("a", "b", "size_a", "size_b"))
            ok = den * np.minimum(size_a, size_b) >= num * np.maximum(size_a, size_b)
            most = (size_a + size_b) * (den - num) // (den + num)
            for i in np.flatnonzero(ok):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint8) for c in ("parity_a", "parity_b"))
                short = min(len(x), len(y))
                ok[i] = int(np.bitwise_count(fold(x, short) ^ fold(y, short)).sum()) <= most[i]
            yield pa.record_batch([pa.array(a[ok]), pa.array(b[ok])], schema=PAIR)

    return near


def _verify(num: int, den: int):
    """Keeps pairs with den * intersection >= num * union."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            ok = np.zeros(len(a), bool)
            for i in range(len(a)):
                x = np.frombuffer(batch.column("members_a")[i].as_buffer(), U)
                if last != b[i]:
                    last, known = b[i], np.frombuffer(batch.column("members_b")[i].as_buffer(), U).copy()
                both = len(np.intersect1d(x, known, assume_unique=True))
                ok[i] = den * both >= num * (len(x) + len(known) - both)
            yield pa.record_batch([pa.array(a[ok]), pa.array(b[ok])], schema=PAIR)

    return verify


def _linked(pairs: DataFrame, docs: DataFrame, classes: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that link: first by sizes and parities, then by the sets of the rest."""

    def both(of: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
        for side in "ab":
            of = of.join(table.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
        return of

    near = keep(both(pairs, classes, "size", "parity").mapInArrow(_near(num, den), "a long, b long"))
    nodes = keep(near.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes, "node").select("node", "doc_id"))
    sets = keep(_sets_of(docs, nodes, n))
    links = keep(both(near, sets, "members").mapInArrow(_verify(num, den), "a long, b long"))
    discard(near, nodes, sets)
    return links


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 75, den: int = 100, cross: int = CROSS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id (the least id reached by links).

    Sets link when ``den`` * intersection >= ``num`` * union.
    """
    if not 0 < num <= den:
        raise ValueError("the similarity is above 0 and at most 1")
    prepare(docs.sparkSession)
    docs = pick(docs, doc_id=id_col, text=text_col)
    t = num / den
    signed = keep(signatures(docs, n))
    named = signed.filter("n_shingles > 0 and doc_id is not null")
    one = named.groupBy("fp").agg(F.min(F.struct("doc_id", F.col("n_shingles").alias("size"), "parity")).alias("one"))
    classes = keep(one.select(F.col("fp").alias("node"), "one.*"))
    table = docs.sparkSession.sparkContext.broadcast(np.packbits(common_shingles(docs, n)))
    keys = shared_keys(docs, _fresh(n, t, table), text_bytes(docs) / 11, distinct=True)
    keys = keep(keys.select("key", F.col("owner").alias("node"), F.col("remark").alias("note")).distinct())
    tidy(docs.sparkSession)

    leaders = keys.groupBy("key").agg(F.min("node").alias("b"))
    star = keys.join(leaders, "key").filter("node <> b").select(F.col("node").alias("a"), "b").distinct()
    links = _linked(star, docs, classes, n, num, den)
    for _ in range(HUBS):
        pairs, mixed = hub_pairs(keys.drop("part"), components(links), links)
        discard(keys)
        keys, links = mixed, keep(links.union(_linked(pairs, docs, classes, n, num, den)))
    cold, families = cross_pairs(keys.drop("part"), components(links), cross)
    rest = cold.union(family_pairs(families, classes, num, den)).distinct()
    found = links.union(_linked(rest, docs, classes, n, num, den))
    # An id with several texts joins their components.
    same = named.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter("a <> b").select("doc_id", "a")
    final = components(found.union(named.join(same, "doc_id").select("a", F.col("fp").alias("b")).distinct()))
    discard(keys)

    placed = classes.join(final, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = placed.join(least, "component").select(F.col("node").alias("fp"), "component_id")
    return signed.join(named, "fp", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def _placed(keys: DataFrame, parts: DataFrame) -> DataFrame:
    """(key, node, note, part): the members of the keys, and the component that each is in."""
    return keys.join(parts, "node", "left").select("key", "node", "note", F.coalesce("component", "node").alias("part"))


def hub_pairs(keys: DataFrame, parts: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each key's members against its member with the most links, where their components differ; and (key, node, note, part) of the keys whose members are in several components.

    Components only grow, so no other key can be of use any more.
    """
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    placed = _placed(keys, parts)
    mixed = placed.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo < hi").select("key")
    kept = keep(placed.join(mixed, "key"))
    some = kept.join(degree, "node", "left")
    hub = some.groupBy("key").agg(F.max(F.struct(F.coalesce("links", F.lit(0)).alias("links"), F.col("node").alias("b"), F.col("part").alias("part_b"))).alias("hub"))
    pairs = some.join(hub.select("key", "hub.b", "hub.part_b"), "key").filter("part <> part_b").select(F.col("node").alias("a"), "b").distinct()
    return keep(pairs), kept


def cross_pairs(keys: DataFrame, parts: DataFrame, cross: int, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of one key's members from different components; and what is left of the keys set aside: (family, node, part).

    Keys with the same largest component are one family: its members meet once, not once for each key.
    ``every``: a link may be lost by a single key set aside, whatever its notes say.
    """
    placed = _placed(keys, parts)
    counted = placed.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    sums = counted.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    several = sums.filter("parts > 1").select("key", ((F.col("n") * F.col("n") - F.col("squares")) / 2 > cross * F.col("n")).alias("hot"))
    some = keep(placed.join(several, "key"))
    cold = some.filter("not hot")
    left = cold.select("key", F.col("node").alias("a"), F.col("part").alias("part_a"))
    right = cold.select("key", F.col("node").alias("b"), F.col("part").alias("part_b"))
    pairs = left.join(right, "key").filter("part_a < part_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    hot = some.filter("hot")
    if not every:
        risky = hot.groupBy("node", "note").agg(F.count(F.lit(1)).alias("n")).filter("n >= note & 16777215").select("node", "note")
        hot = hot.join(risky, ["node", "note"], "left_semi")
    hot = hot.select("key", "node", "part")
    largest = hot.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max(F.struct("n", "part")).getField("part").alias("family"))
    out = keep(pairs), keep(hot.join(largest, "key").select("family", "node", "part").distinct())
    discard(some)
    return out


def _block_pairs(num: int, den: int):
    """Of a family's block, or two blocks, the pairs of different components whose sizes and parities allow a link."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        node, part, size = (table.column(c).to_numpy() for c in ("node", "part", "size"))
        block, (_, lo, hi) = table.column("block").to_numpy(), (k.as_py() for k in key)
        sketches = [np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("parity").combine_chunks()]
        lengths = np.array([len(x) for x in sketches])
        for m in np.unique(lengths):
            for k in np.unique(lengths[lengths <= m]):
                i, j = np.flatnonzero((lengths == m) & (block == lo)), np.flatnonzero((lengths == k) & (block == hi))
                swapped = m != k and lo != hi
                for i, j in [(i, j), *([(np.flatnonzero((lengths == m) & (block == hi)), np.flatnonzero((lengths == k) & (block == lo)))] if swapped else [])]:
                    if not len(i) or not len(j):
                        continue
                    y = np.stack([sketches[x] for x in j]).view(U if k >= 8 else np.uint8)
                    for x in i:
                        ok = (part[j] != part[x]) & (den * np.minimum(size[j], size[x]) >= num * np.maximum(size[j], size[x]))
                        far = np.bitwise_count(y[ok] ^ fold(sketches[x], k).view(y.dtype)).sum(axis=1)
                        good = j[ok][far <= (size[j[ok]] + size[x]) * (den - num) // (den + num)]
                        if len(good):
                            yield pa.record_batch([pa.array(np.minimum(node[x], node[good])), pa.array(np.maximum(node[x], node[good]))], schema=schema)

    return compare


def family_pairs(families: DataFrame, sets: DataFrame, num: int, den: int, block: int = 256) -> DataFrame:
    """Pairs (a, b) of the families' members that may link, compared block by block."""
    sizes = families.groupBy("family").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("family", F.expr(f"cast(n div {block} + 1 as int)").alias("blocks"))
    rows = families.join(sizes, "family").join(sets.select("node", "size", "parity"), "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = rows.select("family", "node", "part", "size", "parity", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("family", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "node", "part", "size", "parity", "block")
    return met.groupBy("family", "lo", "hi").applyInArrow(_block_pairs(num, den), "a long, b long").distinct()
