"""Language-model scores from a log-frequency Bloom filter.

Tokens are the words of a text, A-Z lower-cased, then one end; the end also stands before the first word. Texts are read once and
kept as blocks of token codes with the block's distinct words, so nothing later shuffles or hashes text.

fit() builds a model and saves it, kind by kind: words first, then pairs, up to runs of ``order`` tokens. A block sends its training texts' distinct words or n-grams to
ranges of their hashes, each with its count. A range's task sums the counts. Words keep exact ones. An n-gram seen c times
has level floor(log2 c) + 1 and goes into the range's part of the filter once for each level up to its own. Only the part's bits are saved, no n-gram and no count. No
n-gram is left out, those seen once have a level too: the filter grows with the n-grams while a part does not, a larger corpus has more ranges.

score() asks a saved model about any texts. Blocks send their distinct words and n-grams to the ranges, where a task probes the part: level after level until one is
absent, so it learns the count within a factor of 2. It answers with a byte for each, in their order; the answers meet the block again. scores() does both over one table's
blocks, each kind learnt, saved, then asked about, and its parts deleted before the next one.

    p1(w) = (c(w) + 1) / (N + V + 1)
    pk(w | h) = (q(h w) + PRIOR pk-1(w | h less its first)) / (C(h) + PRIOR)

with q the power of 2 that the probes give (at most the count; false positives are held to what shorter n-grams allow) and C(h) no less than the
history's count: a word's is exact, a longer one's is 2 q(h) - 1. A history never seen passes on the shorter one's value. So probabilities sum to at most 1.

A filter of all n-grams grows with the corpus and has no size bound, so it is not broadcast: the probes go to the parts. Where more text is scored than was
learnt from, a range's questions are split by block, and each split has its own copy of the part.
N-grams are known by SLIM bits within their range and travel as differences. Nothing of the filter comes to the driver.

Cases: null and empty texts are one end; rows with a null id are scored and not learnt from; rows with equal ids are
separate; an empty training set has N = V = 0 and an empty table gives no rows. Words are told apart by 64-bit hashes. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import discard, keep, pick, prepare, text_bytes, tidy
from .words import BASE, Texts, U, mix, release, span_hashes, texts

#: PRIOR is how many tokens a shorter n-gram's probability counts for; 32 gave held-out texts more likelihood than 1 to 16, and little less than 64.
ORDER, PRIOR, BITS_EACH, PROBES, LEVELS = 3, 32.0, 8, 5, 40
#: Bits by which an n-gram is known within its range, which has a bounded number of them: at most some in 10,000 share theirs with another, few beside the filter's false positives.
SLIM = 32
#: Tokens in a block; bytes of text for each range.
BLOCK_TOKENS, RANGE_BYTES = 1 << 20, 12 << 20
END = U(0x2545F4914F6CDD1D)

BLOCK = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("flags", pa.binary()), ("sizes", pa.binary()), ("words", pa.binary()), ("codes", pa.binary())])
BLOCK_DDL = "block long, ids binary, flags binary, sizes binary, words binary, codes binary"
SENT = pa.schema([("range", pa.int32()), ("salt", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
SENT_DDL = "range int, salt int, block long, n int, keys binary, counts binary"
#: A range's part of a model: of kind 0 its words and their counts, of other kinds the filter's bits. ``n`` is how many keys it was made of, ``tokens`` how often they occur.
PART = pa.schema([("range", pa.int32()), ("ranges", pa.int32()), ("n", pa.int64()), ("tokens", pa.int64()), ("words", pa.binary()), ("counts", pa.binary()), ("bits", pa.binary())])
PART_DDL = "range int, ranges int, n long, tokens long, words binary, counts binary, bits binary"
TOLD = pa.schema([("kind", pa.int32()), ("range", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("found", pa.binary())])
TOLD_DDL = "kind int, range int, block long, n int, found binary"
SCORED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def tokens(chunk: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's end included, and at which token each text begins."""
    data, starts, ends, at = chunk.words()
    return np.insert(span_hashes(data, starts, ends), at[1:], END), at + np.arange(len(at))


def packed(x: np.ndarray) -> bytes:
    """Numbers in planes of their bytes, each alike byte beside its like, compressed."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), "zstd", asbytes=True)


def unpacked(raw: pa.BinaryScalar, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(pa.decompress(raw.as_buffer(), size * n, "zstd"), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, n).T).view(kind).ravel()


def steps(x: np.ndarray) -> np.ndarray:
    """Differences of ascending numbers."""
    return np.diff(x, prepend=U(0))


class Tokens(NamedTuple):
    """A block: each text's id, whether it is valid, whether it is learnt from, its number of tokens; the distinct words in order, and each token's code."""

    ids: np.ndarray
    valid: np.ndarray
    learn: np.ndarray
    sizes: np.ndarray
    words: np.ndarray
    codes: np.ndarray

    def row(self, block: int) -> pa.RecordBatch:
        flags = self.valid.astype(np.uint8) + 2 * self.learn.astype(np.uint8)
        often = np.argsort(-np.bincount(self.codes, minlength=len(self.words)), kind="stable")  # frequent words first, so their codes are small
        rank = np.empty(len(often), np.uint32)
        rank[often] = np.arange(len(often))
        values = [packed(x) for x in (self.ids, flags, self.sizes.astype(np.uint32), self.words[often], rank[self.codes])]
        lengths = np.array([len(self.ids), len(self.words), len(self.codes)], "<i4").tobytes()
        values[1] = lengths + values[1]
        return pa.record_batch([[block], *[[x] for x in values]], schema=BLOCK)

    def grams(self, order: int) -> Iterator[np.ndarray]:
        """For lengths from 2 to ``order``, the key of the n-gram that ends at each token; before a text stand ends."""
        own = self.words[self.codes]
        first = np.cumsum(self.sizes) - self.sizes
        last, pad = own, END
        for _ in range(2, order + 1):
            before = np.empty_like(last)
            before[1:] = last[:-1]
            before[first] = pad
            last = mix(before * U(BASE) + own)
            yield last
            pad = mix(np.array([pad], U) * U(BASE) + END)[0]


def block_of(row: dict) -> Tokens:
    n, v, t = np.frombuffer(row["flags"].as_buffer()[:12], "<i4").tolist()
    flags = np.frombuffer(pa.decompress(row["flags"].as_buffer()[12:], n, "zstd"), np.uint8)
    words = unpacked(row["words"], v, U)
    order = np.argsort(words)
    place = np.empty(v, np.uint32)
    place[order] = np.arange(v)
    return Tokens(unpacked(row["ids"], n, np.int64), flags & 1 > 0, flags & 2 > 0, unpacked(row["sizes"], n, np.uint32).astype(np.int64), words[order], place[unpacked(row["codes"], t, np.uint32)])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Tokens]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column("block")[i].as_py(), block_of({c: batch.column(c)[i] for c in BLOCK.names[1:]})


def blocks(docs: DataFrame, size: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of about ``size`` tokens of (doc_id, text, learn); no text is cut."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, made, part = [], 0, 0, TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            ids, valid, learn, sizes, h = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            words, codes = np.unique(h, return_inverse=True)
            return Tokens(ids, valid, learn, sizes, words, codes).row(part << 32 | made)

        for batch in batches:
            ids, learn = batch.column("doc_id"), batch.column("learn").fill_null(False).to_numpy(zero_copy_only=False)
            valid, ids = ~np.asarray(ids.is_null()), ids.fill_null(0).to_numpy()
            for chunk in texts(iter([pa.record_batch([pa.array(np.arange(batch.num_rows)), batch.column("text")], names=["i", "text"])])):
                h, at = tokens(chunk)
                held.append((ids[chunk.ids], valid[chunk.ids], learn[chunk.ids] & valid[chunk.ids], np.diff(at), h))
                total += len(h)
                if total >= size:
                    yield flush()
                    total, made = 0, made + 1
        if held:
            yield flush()
        release()

    return docs.select("doc_id", "text", "learn").mapInArrow(cut, BLOCK_DDL)


def ranges(keys: np.ndarray, n: int) -> np.ndarray:
    """The range of each key, by its first bits; ``n`` is a power of 2."""
    return keys >> U(64 - (n.bit_length() - 1)) if n > 1 else np.zeros(len(keys), U)


def slots(keys: np.ndarray, n: int) -> np.ndarray:
    """Ranges and SLIM bits of n-grams, in one number."""
    return (ranges(keys, n) << U(SLIM)) | (mix(keys) >> U(64 - SLIM))


def _by_range(kind: int, sorted_keys: np.ndarray, n: int) -> Iterator[tuple[int, slice, bytes]]:
    """(range, place, packed keys) for each range that some of the keys (of words, or slots of n-grams) are in."""
    if not len(sorted_keys):
        return
    of = sorted_keys >> U(SLIM) if kind else ranges(sorted_keys, n)
    cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(sorted_keys)]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        own = sorted_keys[lo:hi]
        yield int(of[lo]), slice(lo, hi), packed(steps(own & U((1 << SLIM) - 1) if kind else own))


def learnt_keys(block: Tokens, kind: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of a block's training texts, in order, and how often each occurs: kind 0 are words, then n-grams by their length less 1."""
    learnt = np.repeat(block.learn, block.sizes)
    if kind == 0:
        many = np.bincount(block.codes[learnt], minlength=len(block.words))
        return block.words[many > 0], many[many > 0]
    *_, last = block.grams(kind + 1)
    return np.unique(slots(last[learnt], n), return_counts=True)


def asked_keys(block: Tokens, kind: int, n: int) -> np.ndarray:
    """The distinct keys of all texts of a block, in order."""
    if kind == 0:
        return block.words
    *_, last = block.grams(kind + 1)
    return np.unique(slots(last, n))


def _send(kind: int, n: int, learn: bool, salts: int = 1):
    """A block's packets, one for each range: keys with counts to learn from, or keys to ask about."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, block in _rows(batches):
            keys, counts = learnt_keys(block, kind, n) if learn else (asked_keys(block, kind, n), None)
            salt = int(mix(np.array([name], np.int64).view(U))[0] % U(salts))
            rows = [(r, salt, name, place.stop - place.start, raw, packed(counts[place].astype(np.uint32)) if learn else None) for r, place, raw in _by_range(kind, keys, n)]
            if rows:
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), SENT, strict=True)], schema=SENT)
        release()

    return send


def level(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(counts).astype(np.int64) + 1, LEVELS)


def spots(known: np.ndarray, q: int, size: int) -> Iterator[np.ndarray]:
    """The PROBES bits of each key and a level, in a part of ``size`` bits, by two hashes."""
    h = mix(known + U(q * BASE & (2**64 - 1)))
    spot, step = (h >> U(32)) % U(size), ((h & U(0xFFFFFFFF)) | U(1)) % U(size)
    for probe in range(PROBES):
        yield ((spot + U(probe) * step) % U(size)).view(np.int64)


def part_of(known: np.ndarray, levels: np.ndarray, bits_each: int = BITS_EACH) -> np.ndarray:
    """A part of the filter: each key once for each level up to its own."""
    size = max(8, -(-int(levels.sum()) * bits_each // 8) * 8)
    bits = np.zeros(size, bool)
    for q in range(1, int(levels.max(initial=0)) + 1):
        for spot in spots(known[levels >= q], q, size):
            bits[spot] = True
    return np.packbits(bits, bitorder="little")


def probed(bits: np.ndarray, known: np.ndarray) -> np.ndarray:
    """For each key the level that repeated probes give, 0 if it is absent."""
    out, alive = np.zeros(len(known), np.uint8), np.arange(len(known) if len(bits) else 0)
    for q in range(1, LEVELS + 1):
        if not len(alive):
            break
        there = np.ones(len(alive), bool)
        for spot in spots(known[alive], q, 8 * len(bits)):
            there &= (bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1
        alive = alive[there]
        out[alive] = q
    return out


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their counts' sums."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([np.ones(1, bool), keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order].astype(np.int64), first)


def _build(kind: int, n: int, bits_each: int):
    """A range's part of the model, from all packets sent to it."""

    def build(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for batch in batches:
            for size, raw, count in zip(batch.column("n").to_pylist(), batch.column("keys"), batch.column("counts"), strict=True):
                keys.append(np.cumsum(unpacked(raw, size, U), dtype=U))
                counts.append(unpacked(count, size, np.uint32))
        keys, counts = _summed(np.concatenate(keys), np.concatenate(counts))
        parts = [None, None, part_of(keys, level(counts), bits_each).tobytes()] if kind else [packed(steps(keys)), packed(counts), None]
        yield pa.record_batch([pa.array([x], f.type) for x, f in zip([key[0].as_py(), n, len(keys), int(counts.sum()), *parts], PART, strict=True)], schema=PART)
        release()

    return build


def _answer(kind: int):
    """A range's answers to all packets, from its part alone: counts of words, or levels of n-grams; 0 where the part is missing."""

    def answer(key: tuple, asked: pa.Table, parts: pa.Table) -> pa.Table:
        if parts.num_rows == 0:
            look = lambda keys: np.zeros(len(keys), np.uint8 if kind else np.int64)
        elif kind:
            bits = np.frombuffer(parts.column("bits")[0].as_buffer(), np.uint8)
            look = lambda keys: probed(bits, keys)
        else:
            size = parts.column("n")[0].as_py()
            words, counts = np.cumsum(unpacked(parts.column("words")[0], size, U), dtype=U), unpacked(parts.column("counts")[0], size, np.int64)

            def look(keys: np.ndarray) -> np.ndarray:
                at = np.minimum(np.searchsorted(words, keys), size - 1)
                return np.where(words[at] == keys, counts[at], 0)

        sizes = asked.column("n").to_pylist()
        found = [packed(look(np.cumsum(unpacked(raw, size, U), dtype=U))) for size, raw in zip(sizes, asked.column("keys"), strict=True)]
        release()
        return pa.table([pa.array([kind] * len(sizes), pa.int32()), pa.array([key[0].as_py()] * len(sizes), pa.int32()), asked.column("block"), asked.column("n"), pa.array(found, pa.binary())], schema=TOLD)

    return answer


def power(levels: np.ndarray) -> np.ndarray:
    """The least count of each level, 0 for level 0."""
    return np.where(levels > 0, 2.0 ** (levels.astype(np.float64) - 1), 0.0)


def _score(model_tokens: int, model_types: int, n: int, order: int, prior: float):
    def score(told: pa.Table, rows: pa.Table) -> pa.Table:
        answers = []
        for kind in range(order):
            own = told.filter(pc.equal(told.column("kind"), kind)).sort_by("range")
            answers.append(np.concatenate([unpacked(raw, size, np.int64 if kind == 0 else np.uint8) for size, raw in zip(own.column("n").to_pylist(), own.column("found"), strict=True)]))
        ((_, block),) = _rows(rows.combine_chunks().to_batches())
        first = np.cumsum(block.sizes) - block.sizes
        shifted = lambda x, start: np.insert(x[:-1], 0, start)
        c = answers[0][block.codes]
        end = int(answers[0][np.searchsorted(block.words, END)])
        base = (c + 1) / (model_tokens + model_types + 1)
        p, history, most = base, shifted(c, end), np.where(c > 0, level(np.maximum(c, 1)), 0)
        history[first] = end
        most = np.minimum(most, np.where(history > 0, level(np.maximum(history, 1)), 0))
        for kind, keys in enumerate(block.grams(order), 1):
            asked, place = np.unique(slots(keys, n), return_inverse=True)
            levels = np.minimum(answers[kind][place], most).astype(np.int64)
            longer = np.where(history > 0, (power(levels) + prior * p) / (history + prior), p)
            if kind > 1:  # before the k-th token of a text an n-gram of k tokens has one more end, and says no more
                for j in range(kind - 1):
                    at = (first + j)[block.sizes > j]
                    longer[at], levels[at] = p[at], last[at]  # noqa: F821
            p, last = longer, levels
            history = 2 * power(shifted(levels, 0)) - 1
            history[first] = 0
            most = np.minimum(levels, shifted(levels, 0))
        total = lambda x: np.add.reduceat(x, first)
        return pa.table([pa.array(block.ids, mask=~block.valid), pa.array(block.sizes), pa.array(total((c > 0).astype(np.int64))), pa.array(total(np.log10(base))), pa.array(total(np.log10(p)))], schema=SCORED)

    return score


class Model(NamedTuple):
    """A saved model: where its parts are, how many ranges it has, the longest n-gram's tokens; V and N of its training texts."""

    path: str
    ranges: int
    order: int
    types: int
    tokens: int


def _learnt(table: DataFrame, kind: int, n: int, bits_each: int) -> DataFrame:
    """The parts of one kind."""
    return table.mapInArrow(_send(kind, n, True), SENT_DDL).groupBy("range").applyInArrow(_build(kind, n, bits_each), PART_DDL)


def _told(table: DataFrame, parts: DataFrame, kind: int, n: int, salts: int = 1) -> DataFrame:
    """What the parts of one kind answer to the blocks."""
    asked = table.mapInArrow(_send(kind, n, False, salts), SENT_DDL)
    copies = parts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return asked.groupBy("range", "salt").cogroup(copies.groupBy("range", "salt")).applyInArrow(_answer(kind), TOLD_DDL)


def _sums(parts: DataFrame) -> tuple[int, int]:
    """V and N, of the parts of kind 0."""
    got = parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "tokens")]).first()
    return got["n"], got["tokens"]


def _ranges_for(docs: DataFrame, range_bytes: int) -> int:
    size, n = text_bytes(docs), 1
    while n * range_bytes < size:
        n *= 2
    return n


def _scored(table: DataFrame, told: list[DataFrame], n: int, types: int, tokens: int, prior: float) -> DataFrame:
    answers = told[0]
    for more in told[1:]:
        answers = answers.unionByName(more)
    score = _score(tokens, types, n, len(told), prior)
    out = keep(answers.groupBy("block").cogroup(table.groupBy("block")).applyInArrow(score, "doc_id long, n_tokens long, n_known long, base_score double, score double"))
    discard(table, *told)
    return out.select("doc_id", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


def fit(docs: DataFrame, out: str, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, bits_each: int = BITS_EACH, block_tokens: int = BLOCK_TOKENS, range_bytes: int = RANGE_BYTES) -> Model:
    """Learn from the rows of ``docs`` with an id (those that ``learn`` picks by doc_id) and save the model's parts in the new folder ``out``."""
    prepare(docs.sparkSession)
    docs = pick(docs, doc_id=id_col, text=text_col)
    table = keep(blocks(docs.withColumn("learn", F.lit(True) if learn is None else learn), block_tokens))
    n = _ranges_for(docs, range_bytes)
    for kind in range(order):
        _learnt(table, kind, n, bits_each).write.option("compression", "zstd").parquet(f"{out}/kind={kind}")
        tidy(docs.sparkSession)
    discard(table)
    return load(docs.sparkSession, out)


def parts(spark: SparkSession, path: str) -> DataFrame:
    """All parts of a saved model."""
    return spark.read.schema(f"{PART_DDL}, kind int").parquet(path)


def load(spark: SparkSession, path: str) -> Model:
    """A model that fit() saved."""
    saved = parts(spark, path)
    most = saved.agg(F.max("ranges").alias("ranges"), F.max("kind").alias("kind")).first()
    return Model(path, most["ranges"] or 1, (most["kind"] or 0) + 1, *_sums(saved.filter("kind = 0")))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", prior: float = PRIOR, block_tokens: int = BLOCK_TOKENS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """For each row: doc_id, n_tokens, n_known, train_tokens, base_score, score by a saved model."""
    prepare(docs.sparkSession)
    docs = pick(docs, doc_id=id_col, text=text_col)
    table = keep(blocks(docs.withColumn("learn", F.lit(False)), block_tokens))
    salts = -(-_ranges_for(docs, range_bytes) // model.ranges)
    saved = parts(docs.sparkSession, model.path)
    told = [keep(_told(table, saved.filter(F.col("kind") == kind), kind, model.ranges, salts)) for kind in range(model.order)]
    return _scored(table, told, model.ranges, model.types, model.tokens, prior)


def scores(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, prior: float = PRIOR, bits_each: int = BITS_EACH, block_tokens: int = BLOCK_TOKENS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """For each row: doc_id, n_tokens, n_known, train_tokens, base_score, score. ``learn``: which rows (by doc_id) are learnt from."""
    prepare(docs.sparkSession)
    docs = pick(docs, doc_id=id_col, text=text_col)
    table = keep(blocks(docs.withColumn("learn", learn), block_tokens))
    n, told, types, tokens = _ranges_for(docs, range_bytes), [], 0, 0
    for kind in range(order):
        own = keep(_learnt(table, kind, n, bits_each))
        tidy(docs.sparkSession)
        if kind == 0:
            types, tokens = _sums(own)
        told.append(keep(_told(table, own, kind, n)))
        discard(own)
    return _scored(table, told, n, types, tokens, prior)
