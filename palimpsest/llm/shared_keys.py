"""Which of very many hashed keys occur more than once: a filter before any join on them.

Pigeonhole parts, deletion variants and chunk digests come to about one key a word, and nearly all of
them occur once. Tasks send their keys packed, by range of the hash, and each range is sorted
once; only keys with two owners or more become rows. A key that occurs many times in one task goes to
its range once, with a mark, and its other rows bypass it: a range holds a key at most once for each
packet, however hot the key is. Rows that bypass need no range, so they are dealt evenly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .words import Texts, release, texts

#: Keys in a packet, and in a range.
PACKET, RANGE = 1 << 19, 5 << 18
OUT = pa.schema([("key", pa.int64()), ("owner", pa.int64()), ("remark", pa.int64()), ("note", pa.int64())])
PACK = pa.schema([("bucket", pa.int32()), ("packed", pa.binary())])

#: Gives for a chunk of texts: owners (int64), a remark (int64) on each owner; then per key its hash, the owner's index, and a note (int64).
Expand = Callable[[Texts], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplanes(raw: memoryview, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw[: n * size], np.uint8).reshape(size, n).T).view(kind).ravel()


def _pack(keys, place, notes, marks, owners, remarks) -> bytes:
    """Keys keep 56 bits and are stored in planes, so what neighbours have in common compresses."""
    used, place = np.unique(place, return_inverse=True)
    plain = not notes.any()
    head = np.array([len(keys), len(used), plain], np.int64).tobytes()
    key7 = np.ascontiguousarray(keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :7].T).tobytes()
    return b"".join([head, key7, _planes(place.astype(np.uint32)), b"" if plain else _planes(notes), np.packbits(marks).tobytes(), _planes(owners[used]), _planes(remarks[used])])


def _unpack(raw: memoryview):
    """Keys, each key's place among the owners, notes, marks, owners, remarks."""
    n, used, plain = (int(x) for x in np.frombuffer(raw[:24], np.int64))
    at = 24
    key = np.zeros((n, 8), np.uint8)
    key[:, :7] = np.frombuffer(raw[at : at + 7 * n], np.uint8).reshape(7, n).T
    at += 7 * n
    place = _unplanes(raw[at:], n, np.uint32)
    at += 4 * n
    notes = np.zeros(1, np.int64) if plain else _unplanes(raw[at:], n, np.int64)
    at += 0 if plain else 8 * n
    marks = np.unpackbits(np.frombuffer(raw[at : at + (n + 7) // 8], np.uint8), count=n).astype(bool)
    at += (n + 7) // 8
    owners = _unplanes(raw[at:], used, np.int64)
    return key.view(">u8").ravel().astype(np.uint64), place, np.broadcast_to(notes, n) if plain else notes, marks, owners, _unplanes(raw[at + 8 * used :], used, np.int64)


def _rows(keys, owners, remarks, notes) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x) for x in (keys.view(np.int64), owners, remarks, notes.astype(np.int64))], schema=OUT)


def _several(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: whether each starts a group, and whether its group has more than one."""
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    alone = first.copy()
    alone[:-1] &= first[1:]
    return first, ~alone


def _sorted(keys: np.ndarray, owners: np.ndarray, distinct: bool) -> np.ndarray:
    """Order of the rows by key; with ``distinct``, only one row of each key and owner."""
    order = np.argsort(keys)
    if not distinct:
        return order
    several = _several(keys[order])[1]
    some = order[several]
    some = some[np.lexsort((owners[some], keys[some]))]
    new = np.ones(len(some), bool)
    new[1:] = (keys[some[1:]] != keys[some[:-1]]) | (owners[some[1:]] != owners[some[:-1]])
    order = np.concatenate([order[~several], some[new]])
    return order[np.argsort(keys[order], kind="stable")]


def _sender(expand: Expand, bits: int, packet: int, distinct: bool, chunks=texts):
    def flush(held, sent) -> Iterator[pa.RecordBatch]:
        owners, remarks = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        shift = np.cumsum([0] + [len(h[0]) for h in held])
        keys = np.concatenate([h[2] for h in held]) & ~np.uint64(255)
        place = np.concatenate([(h[3] + s).astype(np.uint32) for h, s in zip(held, shift, strict=False)])
        notes = np.concatenate([h[4] for h in held]).astype(np.int64, copy=False)
        held.clear()
        order = _sorted(keys, owners[place], distinct)
        keys, place, notes = keys[order], place[order], notes[order]
        del order
        first, several = _several(keys)
        rest = np.flatnonzero(~first)
        # Rows that bypass the ranges travel in packets with a negative bucket, any will do.
        for at in range(0, len(rest), max(1, packet >> 3)):
            r = rest[at : at + max(1, packet >> 3)]
            sent[0] += 1
            yield one(-1 - (TaskContext.get().partitionId() * 0x9E3779B1 + sent[0] * 0x85EBCA6B) % (1 << 20), _pack(keys[r], place[r], notes[r], np.ones(len(r), bool), owners, remarks))
        keys, place, notes, marks = keys[first], place[first], notes[first], several[first]
        cuts = np.searchsorted(keys, (np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(1, np.uint64))
        for b, (lo, hi) in enumerate(zip(cuts, [*cuts[1:], len(keys)], strict=True)):
            if lo < hi:
                yield one(b, _pack(keys[lo:hi], place[lo:hi], notes[lo:hi], marks[lo:hi], owners, remarks))

    def one(bucket: int, packed: bytes) -> pa.RecordBatch:
        return pa.record_batch([pa.array([bucket], pa.int32()), pa.array([packed], pa.binary())], schema=PACK)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, sent = [], 0, [0]
        for chunk in chunks(batches):
            made = expand(chunk)
            if len(made[2]):
                held.append(made)
                n += len(made[2])
            if n >= packet:
                yield from flush(held, sent)
                n = 0
        if held:
            yield from flush(held, sent)
        release()

    return send


def _receiver(distinct: bool):
    def receive(key: tuple, packets: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key[0].as_py() < 0:
            for batch in packets:
                for raw in batch.column("packed"):
                    keys, place, notes, _, owners, remarks = _unpack(memoryview(raw.as_buffer()))
                    yield _rows(keys, owners[place], remarks[place], notes)
            return
        held, shift = [], 0
        for batch in packets:
            for raw in batch.column("packed"):
                keys, place, notes, marks, owners, remarks = _unpack(memoryview(raw.as_buffer()))
                held.append((keys, place + np.uint32(shift), notes, marks, owners, remarks))
                shift += len(owners)
        plain = all(h[2].strides == (0,) for h in held)
        columns = [list(x) for x in zip(*held, strict=True)]
        held.clear()
        keys, place, marks, owners, remarks = (np.concatenate(columns[i]) for i in (0, 1, 3, 4, 5))
        notes = np.broadcast_to(np.int64(0), len(keys)) if plain else np.concatenate(columns[2])
        columns.clear()
        hot = np.unique(keys[marks])
        order = _sorted(keys, owners[place], distinct)
        keys = keys[order]
        out = np.flatnonzero(_several(keys)[1] | np.isin(keys, hot))
        keys, order = keys[out], order[out]
        place, notes = place[order], notes[order]
        for at in range(0, len(out), 1 << 17):
            o = slice(at, at + (1 << 17))
            yield _rows(keys[o], owners[place[o]], remarks[place[o]], notes[o])
        del keys, place, marks, owners, remarks, notes, order, out
        release()

    return receive


def shared_keys(docs: DataFrame, expand: Expand, n_keys: float, distinct: bool = False, packet: int = PACKET, each: int = RANGE, chunks=texts) -> DataFrame:
    """Rows (key, owner, remark, note) of every key that at least two of ``expand``'s rows have.

    With ``distinct``, of every key that at least two owners have; of a key and owner, one row or a few come.
    ``docs`` has an id and a text, unless ``chunks`` takes batches otherwise; ``n_keys`` is how many keys to expect, which only sets the number of ranges.
    """
    bits = 0
    while each << bits < n_keys:
        bits += 1
    packets = docs.mapInArrow(_sender(expand, bits, packet, distinct, chunks), "bucket int, packed binary")
    return packets.groupBy("bucket").applyInArrow(_receiver(distinct), "key long, owner long, remark long, note long")

