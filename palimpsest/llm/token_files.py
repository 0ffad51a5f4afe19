"""Token ids in files of bit or byte planes.

A file holds whole documents in order. Its ids are cut into blocks of BLOCK ids; a block is transposed into
planes (plane p holds bit p, or byte p, of every id), planes above the largest id's are left out, and each plane is
compressed with zstandard by itself. Layout, little-endian:

    b"PLNE" | version u32 | width in bits of a plane u32 | documents u64 | ids u64 | blocks u32
    chunk index: for each block its first byte u64 (from the data's start), ids u32, planes u32
    for each block and plane: compressed length u32
    documents: zstandard of (doc_id i64, valid u8, ids u64) for each, as columns
    data

Files are rows (shard, file, documents, ids, blob) of a Parquet table, written by Spark's own writer: that
reaches any store Spark can, commits tasks atomically and survives lost executors. Shards are ranges of
doc_id, files follow in order within their shard, so a document's place needs only the files' counts.

Cases: a null text is empty (only the end id); null ids come first, rows with equal ids stay together, ordered by
their text's hash; an empty table gives no files. Other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .session import parts_for, passing, pick, prepare, shared_dir, text_bytes
from .words import SPACE, Texts, kept, span_hashes, texts

BLOCK, FILE_IDS, SHARD_BYTES = 1 << 16, 1 << 20, 24 << 20
MAGIC, VERSION, HEAD = b"PLNE", 1, struct.Struct("<4sIIQQI")
#: Slots in which a worker remembers pieces' ids (12 bytes each), ids it remembers, unseen pieces that are encoded together, and bytes of text in a piece of a batch.
SLOTS, REMEMBERED, TOGETHER, CHUNK = 1 << 21, 3 << 20, 1 << 12, 1 << 19
#: ASCII bytes beside which a space is no cut, and first bytes of Unicode's other spaces.
BLANK, LEAD = SPACE.copy(), np.zeros(256, bool)
BLANK[28:32] = True
LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def planes(ids: np.ndarray, width: int) -> list[bytes]:
    """The planes of a block that aren't all zero above the largest id."""
    bits = max(1, int(ids.max(initial=0)).bit_length())
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if width == 8:
        return [raw[:, p].tobytes() for p in range(-(-bits // 8))]
    spread = np.unpackbits(raw, axis=1, bitorder="little").T
    return [np.packbits(spread[p]).tobytes() for p in range(bits)]


def join_planes(parts: list[bytes], n: int, width: int) -> np.ndarray:
    raw = np.zeros((n, 4), np.uint8)
    if width == 8:
        for p, part in enumerate(parts):
            raw[:, p] = np.frombuffer(part, np.uint8)
    else:
        spread = np.zeros((32, n), np.uint8)
        for p, part in enumerate(parts):
            spread[p] = np.unpackbits(np.frombuffer(part, np.uint8), count=n)
        raw = np.packbits(np.ascontiguousarray(spread.T), axis=1, bitorder="little")
    return raw.view("<u4").ravel()


def write_file(doc_ids: np.ndarray, valid: np.ndarray, counts: np.ndarray, ids: np.ndarray, width: int = 8, level: int = 3) -> bytes:
    press = zstandard.ZstdCompressor(level=level)
    index, lengths, data, at = [], [], [], 0
    for lo in range(0, len(ids), BLOCK):
        block = ids[lo : lo + BLOCK]
        packed = [press.compress(p) for p in planes(block, width)]
        index.append(struct.pack("<QII", at, len(block), len(packed)))
        lengths.append(np.array([len(p) for p in packed], "<u4").tobytes())
        data += packed
        at += sum(map(len, packed))
    docs = press.compress(doc_ids.astype("<i8").tobytes() + valid.astype("u1").tobytes() + counts.astype("<u8").tobytes())
    head = HEAD.pack(MAGIC, VERSION, width, len(doc_ids), len(ids), len(index))
    return b"".join([head, *index, *lengths, struct.pack("<I", len(docs)), docs, *data])


class TokenFile:
    """A file's documents, and its ids block by block through the chunk index."""

    def __init__(self, raw: bytes) -> None:
        magic, version, self.width, n_docs, self.n_ids, n_blocks = HEAD.unpack_from(raw)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a file of planes, or of another version")
        at = HEAD.size
        self.index = [struct.unpack_from("<QII", raw, at + 16 * i) for i in range(n_blocks)]
        at += 16 * n_blocks
        self.lengths = []
        for _, _, n in self.index:
            self.lengths.append(np.frombuffer(raw, "<u4", n, at))
            at += 4 * n
        (size,) = struct.unpack_from("<I", raw, at)
        docs = zstandard.ZstdDecompressor().decompress(raw[at + 4 : at + 4 + size])
        self.doc_ids = np.frombuffer(docs, "<i8", n_docs)
        self.valid = np.frombuffer(docs, "u1", n_docs, 8 * n_docs).astype(bool)
        self.counts = np.frombuffer(docs, "<u8", n_docs, 9 * n_docs).astype(np.int64)
        self.data, self.raw = at + 4 + size, raw

    def block(self, i: int) -> np.ndarray:
        first, n, _ = self.index[i]
        expand, at, parts = zstandard.ZstdDecompressor(), self.data + first, []
        for size in self.lengths[i]:
            parts.append(expand.decompress(self.raw[at : at + int(size)]))
            at += int(size)
        return join_planes(parts, n, self.width)

    def ids(self) -> np.ndarray:
        return np.concatenate([self.block(i) for i in range(len(self.index))]) if self.index else np.zeros(0, "<u4")


class Encoder:
    """Texts to ids, remembering the ids of pieces of texts.

    A text is cut before each single space between other characters: byte-level vocabularies begin a token there in
    any case. Pieces are looked up by a 64-bit hash and their length; unseen ones are encoded together as
    one text, whose ids are dealt back by the tokens' lengths. They are kept, each in the slot its hash names, the first
    piece of a slot for good, until there are REMEMBERED ids. A text that holds the string of one of the tokenizer's added tokens is
    encoded as a whole, since such a token may be anywhere in it.
    """

    def __init__(self, path: str, end: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keys, self.known = np.zeros(SLOTS, np.uint64), np.full(SLOTS, -1, np.int32)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.size = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.size[i] = len(token)  # a byte-level token has one character for each byte
        self.pool, self.first, self.count = np.array([end], "<u4"), np.zeros(1, np.int64), np.ones(1, np.int64)

    def _plain(self, pieces: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _encode(self, pieces: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(pieces)
        together = not any(SPACE[b] for x in self.added for b in x)  # else pieces side by side might make an added token
        inner = [i for i, p in enumerate(pieces) if together and p[0] == " " and not p[-1].isspace()]
        for at in range(0, len(inner), TOGETHER):
            some = inner[at : at + TOGETHER]
            (ids,) = self._plain(["".join([pieces[i] for i in some])])
            cuts = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum([len(pieces[i].encode()) for i in some])) + 1
            for i, a, b in zip(some, [0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
                out[i] = ids[a:b]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self._plain([pieces[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def __call__(self, chunk: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, each text's ended by the end id; and how many each text has."""
        raw = chunk.data.tobytes() if self.added else b""
        if any(x in raw for x in self.added):
            return self._with_added(chunk, raw)
        return self._pieces(chunk)

    def _with_added(self, chunk: Texts, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The same where some texts hold an added token's string: these by themselves, the others in runs between them."""
        edges, out, lo = chunk.offsets.tolist(), [], 0
        whole = [i for i in range(len(edges) - 1) if any(x in raw[edges[i] : edges[i + 1]] for x in self.added)]
        for i in [*whole, len(edges) - 1]:
            if lo < i:
                out.append(self._pieces(Texts(chunk.ids[lo:i], chunk.valid[lo:i], chunk.data[edges[lo] : edges[i]], chunk.offsets[lo : i + 1] - edges[lo])))
            if i < len(edges) - 1:
                ids = np.append(self._plain([raw[edges[i] : edges[i + 1]].decode()])[0], self.pool[:1])
                out.append((ids, np.array([len(ids)])))
            lo = i + 1
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _pieces(self, chunk: Texts) -> tuple[np.ndarray, np.ndarray]:
        data, edges = chunk.data, chunk.offsets
        starts = pieces(data, edges)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        h = span_hashes(data, starts, ends)
        slot = (h >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        place = np.where(self.keys[slot] == h, self.known[slot], -1).astype(np.int64)
        lost = np.flatnonzero(place < 0)
        pool, first, count = self.pool, self.first, self.count
        if len(lost):
            new, where, back = np.unique(h[lost], return_index=True, return_inverse=True)
            raw = data.tobytes()
            found = self._encode([raw[starts[i] : ends[i]].decode() for i in lost[where].tolist()])
            sizes = np.array([len(x) for x in found], np.int64)
            place[lost] = len(first) + back
            first = np.concatenate([first, len(pool) + np.cumsum(sizes) - sizes])
            count, pool = np.concatenate([count, sizes]), np.concatenate([pool, *found])
            if len(self.pool) < REMEMBERED:
                at = slot[lost[where]]
                free = self.known[at] < 0
                self.keys[at[free]], self.known[at[free]] = new[free], (len(self.first) + np.arange(len(new)))[free]
                self.pool, self.first, self.count = pool, first, count
        stops = np.searchsorted(starts, edges[1:])
        place = np.insert(place, stops, 0)
        each = count[place]
        done = np.cumsum(each)
        ids = pool[np.repeat(first[place] - (done - each), each) + np.arange(int(done[-1]) if len(done) else 0)]
        upto = done[stops + np.arange(len(stops))]
        return ids, np.diff(upto, prepend=0)


def pieces(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where pieces begin. Where a neighbour may be one of Unicode's other spaces, there is no cut."""
    dark = ~BLANK[data]
    cut = data == 32
    cut[:-1] &= dark[1:] & ~LEAD[data[1:]]
    cut[-1:] = False
    cut[1:] &= dark[:-1]
    cut[2:] &= data[:-2] != 0xC2
    cut[3:] &= ~LEAD[data[:-3]] | (data[:-3] == 0xC2)
    own = edges[:-1][np.diff(edges) > 0]
    cut[own] = True
    return np.flatnonzero(cut)


def encoder(path: str, end: int) -> Encoder:
    return kept(("encoder", path, end), lambda: Encoder(path, end))


def _writer(path: str, end: int, width: int):
    schema = pa.schema([("shard", pa.int32()), ("file", pa.int32()), ("documents", pa.int64()), ("ids", pa.int64()), ("blob", pa.binary())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, file = encoder(path, end), TaskContext.get().partitionId(), 0
        held, n = [], 0

        def done() -> pa.RecordBatch:
            keys, valid, counts, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            return pa.record_batch([[shard], [file], [len(keys)], [len(ids)], [write_file(keys, valid, counts, ids, width)]], schema=schema)

        for chunk in texts(batches, CHUNK):
            ids, counts = encode(chunk)
            encoder(path, end)  # still in use
            held.append((chunk.ids, chunk.valid, counts, ids))
            n += len(ids)
            if n >= FILE_IDS:
                yield done()
                held, n, file = [], 0, file + 1
        if held:
            yield done()

    return write


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end: int = 0, width: int = 8, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, add ``end``, and write the files to the table ``out``."""
    prepare(docs.sparkSession)
    docs = pick(docs, doc_id=id_col, text=text_col)
    shards = parts_for(text_bytes(docs), SHARD_BYTES)
    order = ["doc_id", "text_hash", "row"]  # rows that share an id, or have none, may be in several shards; equal rows too, they have equal tokens
    rows = docs.withColumn("text_hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")
    dealt.mapInArrow(_writer(tokenizer, end, width), "shard int, file int, documents long, ids long, blob binary").write.mode("overwrite").parquet(out)


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """From the files, for each document: doc_id, start, n_tokens, ids_crc32."""
    schema = pa.schema([("shard", pa.int32()), ("file", pa.int32()), ("doc_id", pa.int64()), ("within", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, file, blob in zip(*(batch.column(c) for c in ("shard", "file", "blob")), strict=True):
                found = TokenFile(blob.as_py())
                ids, ends = memoryview(found.ids().tobytes()), np.cumsum(found.counts)
                crc = [zlib.crc32(ids[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), found.counts.tolist(), strict=True)]
                n = len(crc)
                yield pa.record_batch([pa.array([shard.as_py()] * n, pa.int32()), pa.array([file.as_py()] * n, pa.int32()), pa.array(found.doc_ids, mask=~found.valid), pa.array(ends - found.counts), pa.array(found.counts), pa.array(crc, pa.int64())], schema=schema)

    files = spark.read.parquet(out)
    before = Window.orderBy("shard", "file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("shard", "file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("first"))
    docs = files.select("shard", "file", "blob").mapInArrow(read, "shard int, file int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["shard", "file"]).select("doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def tokens_round_trip(docs: DataFrame, tokenizer: str, out: str | None = None, **options) -> DataFrame:
    """write_tokens, then read_tokens; by default in a new folder of the shared storage, which goes when the driver's JVM ends."""
    spark = docs.sparkSession
    own = out or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, own, tokenizer, **options)
    if out is None:
        passing(spark, own)
    return read_tokens(spark, own)
