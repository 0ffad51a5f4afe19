"""Vector codes: product quantisation with codebooks of whole numbers.

Components become whole numbers, floor(scale * x), and vectors are cut into equal consecutive parts. Tasks lay their rows
out as blocks, dimension by dimension, of about VALUES components; the blocks are written once and every round reads them
again, so a lost executor costs its own blocks only. In a round each block finds every part's nearest codebook entry, the
distances to all entries adding up dimension by dimension; np.add.at sums the parts of each entry into int64 tensors of
(parts, entries, width), which RDD.treeAggregate merges through a tree of tasks. The driver sees one such tensor a
round, whose size follows from the parameters alone, as that of the codebooks does which tasks are sent.

Cases: rows whose vector is null, or holds a null, NaN or infinite component, are dropped. Vectors shorter than the longest, empty ones too,
and lengths that ``parts`` does not divide, are filled up with zeros at the end. The first entries are those rows with the smallest ids (a null
id comes last, equal ids go by their vectors); with fewer rows than ``entries`` a codebook has an entry for each row. Equal
distances go to the lower entry; an entry without parts stays as it is. Repeated rows each have their code. An empty table gives
none. Other columns are ignored. Whole components beyond 2**28 have no defined distances.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .session import keep, pick, prepare
from .words import release

#: Components in a block.
VALUES = 1 << 17


def sound(vectors: DataFrame) -> DataFrame:
    """Rows whose ``embedding`` is there and has finite components only."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(F.col("embedding").isNotNull() & ~bad)


def whole(column: pa.Array, scale: float) -> np.ndarray:
    """floor(scale * x) with a row for each dimension; shorter vectors end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((int(sizes.max(initial=0)), len(column)), np.int64)
    row = np.repeat(np.arange(len(column)), sizes)
    out[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), row] = np.floor(scale * flat).astype(np.int64)
    return out


def blocks(vectors: DataFrame, scale: float) -> DataFrame:
    """(ids, labels, dims, columns) of (vec_id, embedding, label): some rows each, their components dimension by dimension."""
    label = vectors.schema["label"].dataType

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch.column("embedding").flatten()) + batch.num_rows
            if n >= VALUES:
                yield block(held)
                held, n = [], 0
        if held:
            yield block(held)
        release()

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        one = lambda c: pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows.column(c).combine_chunks())
        columns = whole(rows.column("embedding").combine_chunks(), scale)
        return pa.record_batch([one("vec_id"), one("label"), pa.array([len(columns)], pa.int32()), pa.array([columns.tobytes()], pa.binary())], names=["ids", "labels", "dims", "columns"])

    return vectors.mapInArrow(lay, f"ids array<bigint>, labels array<{label.simpleString()}>, dims int, columns binary")


def _columns(dims: int, raw: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((width, n), np.int64)
    out[:dims] = np.frombuffer(raw, np.int64).reshape(dims, n)
    return out


def nearest(columns: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each part of each vector the nearest entry and its squared distance. ``books``: (parts, entries, width)."""
    parts, entries, width = books.shape
    index, least = np.zeros((parts, columns.shape[1]), np.int64), np.zeros((parts, columns.shape[1]), np.int64)
    for p in range(parts):
        far = np.zeros((entries, columns.shape[1]), np.int64)
        for d in range(width):
            gap = columns[p * width + d] - books[p, :, d, None]
            gap *= gap
            far += gap
        index[p] = far.argmin(axis=0)
        least[p] = far.min(axis=0)
    return index, least


Sums = tuple[np.ndarray, np.ndarray]


def _added(books: np.ndarray):
    """Adds a block to the sums and counts of the codebooks' entries."""
    parts, entries, width = books.shape

    def add(total: Sums | None, block: Row) -> Sums:
        sums, counts = total or (np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64))
        columns = _columns(block["dims"], block["columns"], block["n"], parts * width)
        index, _ = nearest(columns, books)
        for p in range(parts):
            np.add.at(counts[p], index[p], 1)
            for d in range(width):
                np.add.at(sums[p, :, d], index[p], columns[p * width + d])
        return sums, counts

    return add


def _merged(a: Sums | None, b: Sums | None) -> Sums | None:
    if a is None or b is None:
        return b if a is None else a
    return a[0] + b[0], a[1] + b[1]


class Codes:
    """Vectors' codes, fitted to all rows.

    ``books`` (parts, entries, width) are the codebooks. ``rows`` is a row for each vector: vec_id, label, code (binary: the entry of each
    part, a byte each or two, the high one first, where a codebook has more than 256), error (squared distance to the decoded vector).
    """

    def __init__(self, vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", depth: int = 2) -> None:
        if parts < 1 or not 1 <= entries <= 1 << 16:
            raise ValueError("there is one part at least, and 1 to 65536 entries")
        prepare(vectors.sparkSession)
        own = pick(vectors.withColumn("no label", F.lit(None).cast("int")), vec_id=id_col, embedding=vector_col, label=label_col or "no label")
        own = sound(own)
        laid = keep(blocks(own, scale))
        dims = laid.agg(F.coalesce(F.max("dims"), F.lit(0)).alias("dims")).first()["dims"]
        self.width, self.parts = -(-dims // parts), parts
        first = own.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(entries).toArrow()
        start = whole(first.column(0).combine_chunks(), scale) if len(first) else np.zeros((0, 0), np.int64)
        start = _columns(len(start), start.tobytes(), start.shape[1], self.width * parts)
        self.books = np.ascontiguousarray(start.reshape(parts, self.width, start.shape[1]).transpose(0, 2, 1))
        sized = laid.select(F.size("ids").alias("n"), "dims", "columns").rdd
        for _ in range(rounds if len(first) else 0):
            sums, counts = sized.treeAggregate(None, _added(self.books), _merged, depth)
            used = counts[:, :, None] > 0
            self.books = np.where(used, sums // np.maximum(counts, 1)[:, :, None], self.books)
        self.rows = self._coded(laid)

    def _coded(self, laid: DataFrame) -> DataFrame:
        books, kind = self.books, ">u2" if self.books.shape[1] > 256 else "u1"
        label = laid.schema["labels"].dataType.elementType.simpleString()

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    ids, labels = batch.column("ids")[i].values, batch.column("labels")[i].values
                    columns = _columns(batch.column("dims")[i].as_py(), batch.column("columns")[i].as_buffer(), len(ids), books.shape[0] * books.shape[2])
                    index, least = nearest(columns, books)
                    raw = np.ascontiguousarray(index.T.astype(kind))
                    codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(raw.itemsize * raw.shape[1]), len(ids), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())
                    yield pa.record_batch([ids, labels, codes, pa.array(least.sum(axis=0))], names=["vec_id", "label", "code", "error"])
            release()

        return laid.mapInArrow(code, f"vec_id long, label {label}, code binary, error long")

    def decoded(self, code: bytes) -> np.ndarray:
        """The whole numbers that a code stands for."""
        index = np.frombuffer(code, ">u2" if self.books.shape[1] > 256 else "u1")
        return np.concatenate([self.books[p, i] for p, i in enumerate(index)])


def summed_by(rows: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of equal ``group``, nulls together; sums beyond 64 bits are null.

    Sums form before the exchange, and a join brings them back: adaptive execution splits a hot group there.
    """
    sums = rows.groupBy(group).agg(F.try_sum(value).alias(name)).withColumnRenamed(group, "group_")
    same: Column = F.col(group).eqNullSafe(F.col("group_"))
    return rows.join(sums, same).drop("group_")
