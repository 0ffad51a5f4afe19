"""Near copies by MinHash with sequential Bayesian verification.

A text's set holds its distinct runs of four words (64-bit hashes). HASHES minima under random multipliers sign the set; two
sets agree in a minimum with the probability of their Jaccard similarity. BANDS bands of ROWS minima are the keys
under which candidates meet: at a similarity of 0.8 a pair misses all of them with a probability of (1 - 0.8**5)**40, one in 8 million.

A candidate's signatures are compared BATCH minima at a time. After n of them with m matches the similarity has the posterior
Beta(m + 1, n - m + 1), from a flat prior; a pair goes as soon as the posterior puts a probability of less than MISS on a similarity
of the threshold or more. Signatures keep a byte of each minimum: bytes of different minima agree once in 256, which only makes a pair stay. Survivors
are confirmed on their full sets.

Hot keys. Copies are one class, whatever their number. Each set is compared with the leader of its largest key, so a group costs a pair for each member and not
one for each member and key; then, where a key's members are in different components, with its member that has the most links. Components form, and only members of different ones go on. A key that still has more than ``cross`` such pairs for each member is split
further: its members are keyed again by the shingles that are rarest among them, and the pairs of these keys are confirmed together with those of the other keys. A set's first size - ceil(t * size) + 1 shingles, in one order
for all sets, hold one that any linked set has among its own first ones, so nothing is lost there. What is hot even so, by a
shingle that is among the rarest of many sets without links, is compared in blocks, by the same bounds and then on the sets; only links leave a block. So a group that shares a passage costs its size; only sets that share
their rarest shingles and still don't link cost the square, some nanoseconds a pair, spread over tasks.

Cases: null and empty texts and those without words have an empty set and link with nothing; with one to three words the sequence is
the only member. Equal ids are one node: every row stays, links of any of its texts count. A row without an id links with nothing, its component is
null and it is kept. Other columns are ignored. Sets are told apart by a 64-bit hash and their size. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .ngram_join import PAIR, _sets_of, _verify, cross_pairs, fingerprint, hub_pairs, word_sets
from .session import discard, keep, pick, prepare
from .words import U, mix, release, texts

BANDS, ROWS, BATCH = 40, 5, 40
HASHES = BANDS * ROWS
#: Probability of a similarity at the threshold or above at which a pair is given up.
MISS = 1e-7
#: Share of the labels that may still move when components that only spare work are taken as they are.
FEW = 0.02
#: Shingles whose minima are taken at once; slots that count shingles of hot sets.
TOGETHER, SLOTS = 1 << 16, 1 << 18
#: Members of the sets in a block, of 8 bytes each.
MEMBERS = 1 << 20
MULTIPLIERS = np.random.default_rng(13).integers(0, 1 << 63, HASHES, np.int64).astype(U) * U(2) + U(1)

#: Which rows of two tables of signatures may be linked, given their sizes.
Bounds = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, HASHES): the least member under each multiplier; the sets are not empty."""
    out = np.empty((len(sets), HASHES), U)
    at = 0
    while at < len(sets):
        to, room = at + 1, len(sets[at])
        while to < len(sets) and room + len(sets[to]) <= TOGETHER:
            room += len(sets[to])
            to += 1
        flat = np.concatenate(sets[at:to])
        starts = np.cumsum([0] + [len(s) for s in sets[at : to - 1]])
        own = np.empty_like(flat)
        for k in range(HASHES):
            np.multiply(flat, MULTIPLIERS[k], out=own)
            out[at:to, k] = np.minimum.reduceat(own, starts)
        at = to
    return out


def band_keys(signed: np.ndarray) -> np.ndarray:
    """(sets, BANDS) hashes of a band's number and its minima."""
    with np.errstate(over="ignore"):
        keys = np.broadcast_to(np.arange(BANDS, dtype=U), (len(signed), BANDS)).copy()
        for r in range(ROWS):
            keys = mix(keys + mix(signed[:, r::ROWS] + U(r)))
    return keys


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, fp, signature (a byte of each minimum) and keys of every row; of an empty set the last two are null."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in texts(batches):
            sets = list(word_sets(chunk, n))
            size = np.array([len(s) for s in sets], np.int64)
            some = [s for s in sets if len(s)]
            least = minima(some)
            place = pa.array(np.cumsum(size > 0) - 1, mask=size == 0)
            raw = np.ascontiguousarray((least >> U(48)).astype(np.uint8))  # of a minimum the first bits are zeros where the set is large
            signed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(HASHES), len(some), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary()).take(place)
            keys = pa.FixedSizeListArray.from_arrays(pa.array(band_keys(least).view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64())).take(place)
            fps = pa.array([fingerprint(s)[0] for s in sets], pa.int64())
            yield pa.record_batch([pa.array(chunk.ids, mask=~chunk.valid), pa.array(size), fps, signed, keys], names=["doc_id", "n_shingles", "fp", "signature", "keys"])
        release()

    return docs.mapInArrow(sign, "doc_id long, n_shingles long, fp long, signature binary, keys array<bigint>")


def least_matches(t: float, miss: float = MISS) -> list[tuple[int, int]]:
    """(n, m): after n minima, the fewest matches with which the posterior probability of a similarity of t or more is ``miss`` or more."""
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        at, m = 0.0, -1
        while at < miss and m < n:  # that Beta(m + 1, n - m + 1) is t or more: at most m of n + 1 trials succeed
            m += 1
            at += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def bounds(num: int, den: int, miss: float = MISS) -> Bounds:
    """Compares rows of signatures (one of the sides may be a single row) batch by batch."""
    need = least_matches(num / den, miss)

    def hold(x: np.ndarray, y: np.ndarray, size_x: np.ndarray, size_y: np.ndarray) -> np.ndarray:
        alive = np.flatnonzero(den * np.minimum(size_x, size_y) >= num * np.maximum(size_x, size_y))
        matches, done = np.zeros(len(alive), np.int64), 0
        for n, m in need:
            if not len(alive):
                break
            own = x[alive, done:n] if len(x) > 1 else x[:, done:n]
            matches += (own == (y[alive, done:n] if len(y) > 1 else y[:, done:n])).sum(axis=1)
            on = matches >= m
            alive, matches, done = alive[on], matches[on], n
        return alive

    return hold


def _signed(column: pa.Array) -> np.ndarray:
    flat = column.cast(pa.binary(HASHES))
    return np.frombuffer(flat.buffers()[1], np.uint8)[flat.offset * HASHES : (flat.offset + len(flat)) * HASHES].reshape(-1, HASHES)


def _alike(num: int, den: int):
    """Keeps the pairs that no batch of their signatures rules out."""
    hold = bounds(num, den)

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                on = pa.array(hold(*[_signed(batch.column(f"signature_{c}")) for c in "ab"], *[batch.column(f"size_{c}").to_numpy() for c in "ab"]))
                yield pa.record_batch([batch.column(c).take(on) for c in "ab"], schema=PAIR)

    return alike


def _joined(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """b comes first: where many pairs share a leader they meet it as bare pairs, and what is attached is dealt out by a."""
    for side in "ba":
        pairs = pairs.join(table.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
    return pairs


def _confirmed(near: DataFrame, docs: DataFrame, classes: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets link."""
    near = keep(near)
    nodes = keep(near.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes, "node").select("node", "doc_id"))
    sets = keep(_chosen_sets(docs, nodes, classes, n))
    links = keep(_joined(near, sets, "members").mapInArrow(_verify(num, den), "a long, b long"))
    discard(near, nodes, sets)
    return links


def _chosen_sets(docs: DataFrame, nodes: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """(node, members); where rows share an id, the set whose hash the node is."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [fingerprint(np.frombuffer(x.as_buffer(), U))[0] == node for node, x in zip(batch.column("node").to_pylist(), batch.column("members"), strict=True)]
            yield batch.filter(pa.array(same, pa.bool_()))

    return _sets_of(docs, nodes, n).mapInArrow(own, "node long, members binary").dropDuplicates(["node"])


def rare_keys(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(key, node, note) of (node, members): the first shingles of each set, the rarest among all these sets first.

    What is rare goes by SLOTS counts, which tasks get whole; any order is right if it is the same for all sets.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for x in batch.column("members"):
                many += np.bincount((np.frombuffer(x.as_buffer(), U) % U(SLOTS)).astype(np.int64), minlength=SLOTS)
        yield pa.record_batch([pa.array(np.flatnonzero(many)), pa.array(many[many > 0])], names=["slot", "n"])

    counts = sets.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # SLOTS rows at most
    table = np.zeros(SLOTS, np.int64)
    table[counts.column("slot").to_numpy()] = counts.column("n").to_numpy()
    many = sets.sparkSession.sparkContext.broadcast(table)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, x in zip(batch.column("node").to_pylist(), batch.column("members"), strict=True):
                s = np.frombuffer(x.as_buffer(), U)
                order = np.lexsort((s, many.value[(s % U(SLOTS)).astype(np.int64)]))[: len(s) + num * len(s) // -den + 1]
                yield pa.record_batch([pa.array(s[order].view(np.int64)), pa.array(np.full(len(order), node))], names=["key", "node"])

    return sets.mapInArrow(first, "key long, node long").withColumn("note", F.lit(1).cast("bigint"))


def blocked(families: DataFrame, classes: DataFrame, sets: DataFrame, num: int, den: int, block: int = 1024, members: int = MEMBERS) -> DataFrame:
    """Links (a, b) between different components of one family, block against block: by signatures, then on the full sets (node, members).

    A block holds about ``block`` sets and ``members`` members. Only links come out; inside a pair of blocks, what is linked is not compared again.
    """
    own = families.join(classes.select("node", "size", "signature"), "node")
    many = F.greatest(F.count(F.lit(1)) / block, F.sum("size") / members)
    sizes = own.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.floor(many).cast("int").alias("more")).filter("n > 1").select("family", (F.col("more") + 1).alias("blocks"))
    rows = own.join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(sets, "node")
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("family", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "node", "part", "size", "signature", "members", "block")
    hold = bounds(num, den)

    def compare(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        node, part, size, own = (rows.column(c).to_numpy() for c in ("node", "part", "size", "block"))
        part = part.copy()
        signed = _signed(rows.column("signature").chunk(0))
        every = [np.frombuffer(x.as_buffer(), U) for x in rows.column("members")]
        there = np.flatnonzero(own == key[2].as_py())
        for i in np.flatnonzero(own == key[1].as_py()):
            j = there[part[there] != part[i]]
            j = j[hold(signed[i : i + 1], signed[j], size[i : i + 1], size[j])] if len(j) > 1 else j
            if len(j):
                flat = np.concatenate([every[x] for x in j])
                at = np.minimum(np.searchsorted(every[i], flat), len(every[i]) - 1)
                both = np.add.reduceat((every[i][at] == flat).astype(np.int64), np.cumsum([0, *size[j][:-1]]))
                j = j[den * both >= num * (size[i] + size[j] - both)]
            if len(j):
                part[np.isin(part, part[j])] = part[i]
                yield pa.record_batch([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], schema=PAIR)

    return met.groupBy("family", "lo", "hi").applyInArrow(compare, "a long, b long").distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, num: int = 80, den: int = 100, cross: int = 4) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id (the least id reached by links), kept (whether it has that id).

    Sets link when ``den`` * intersection >= ``num`` * union. The bands are made for similarities of 0.8 and above; below that the
    share of missed pairs grows (one in a thousand at 0.69, a tenth at 0.56).
    """
    if not 0 < num <= den:
        raise ValueError("the similarity is above 0 and at most 1")
    prepare(docs.sparkSession)
    docs = pick(docs, doc_id=id_col, text=text_col)
    signed = keep(signatures(docs, n))
    named = signed.filter("n_shingles > 0 and doc_id is not null")
    one = named.groupBy("fp").agg(F.min(F.struct("doc_id", F.col("n_shingles").alias("size"), "signature", "keys")).alias("one"))
    classes = keep(one.select(F.col("fp").alias("node"), "one.*"))
    every = classes.select(F.explode("keys").alias("key"), "node")
    leaders = every.groupBy("key").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    keys = keep(every.join(leaders, "key").select("key", "node", "b", "n", F.lit(1).cast("bigint").alias("note")))

    def linked(pairs: DataFrame) -> DataFrame:
        near = _joined(pairs, classes, "size", "signature").mapInArrow(_alike(num, den), "a long, b long")
        return _confirmed(near, docs, classes, n, num, den)

    # Until the last one, components only spare comparisons: labels that are a step behind do.
    nearest = keys.filter("node <> b").groupBy(F.col("node").alias("a")).agg(F.max(F.struct("n", "key", "b")).getField("b").alias("b"))
    links = linked(nearest)
    pairs, mixed = hub_pairs(keys.select("key", "node", "note"), components(links, FEW), links)
    discard(keys)
    links = links.union(linked(pairs))
    parts = components(links, FEW)
    pairs, families = cross_pairs(mixed.drop("part"), parts, cross, every=True)
    if families.isEmpty():
        links = links.union(linked(pairs))
    else:
        links = keep(links.union(_split(families, parts, pairs, docs, classes, linked, n, num, den, cross)))
    # An id with several texts joins their components.
    same = named.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter("a <> b").select("doc_id", "a")
    final = components(links.union(named.join(same, "doc_id").select("a", F.col("fp").alias("b")).distinct()))

    placed = classes.join(final, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    known = placed.join(least, "component").select(F.col("node").alias("fp"), "component_id")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = signed.join(known, "fp", "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _split(families: DataFrame, parts: DataFrame, pairs: DataFrame, docs: DataFrame, classes: DataFrame, linked: Callable[[DataFrame], DataFrame], n: int, num: int, den: int, cross: int) -> DataFrame:
    """Links among ``pairs`` and the members of hot keys: these by their rarest shingles, and in blocks where those are hot as well."""
    nodes = keep(families.select("node").distinct().join(classes, "node").select("node", "doc_id"))
    sets = keep(_chosen_sets(docs, nodes, classes, n))
    keys = rare_keys(sets, num, den)
    many = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    keys = keep(keys.join(many, "key"))
    cold, rest = cross_pairs(keys, parts, cross, every=True)
    links = keep(linked(pairs.union(cold).distinct()).union(blocked(rest, classes, sets, num, den)))
    discard(nodes, sets, keys)
    return links
