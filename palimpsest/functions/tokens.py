"""Lengths and cuts of texts in a tokenizer's tokens, in Arrow batches; ``path`` is the file of a tokenizer, which every worker can read."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _ids(column: pa.Array, path: str, n: int | None = None) -> Iterator[list[int]]:
    """The ids of each text, or its first n.

    Texts are encoded one at a time: what the tokenizer makes of a text takes some 100 bytes a token, of a whole batch more than a worker has.
    """
    own = _tokenizer(path)
    for said in column:
        yield own.encode(said.as_py() or "", add_special_tokens=False).ids[:n]


def _cut(column: pa.Array, path: str, n: int) -> pa.Array:
    own = _tokenizer(path)
    return pa.array((own.decode(ids, skip_special_tokens=False) for ids in _ids(column, path, n)), pa.string())


def _counts(column: pa.Array, path: str, kind: pa.DataType) -> pa.Array:
    return pa.array((len(ids) for ids in _ids(column, path)), kind)


def truncating(path: str, n: int) -> Callable[[Column], Column]:
    """A function of texts: their first n tokens, decoded again; null is empty."""

    @F.arrow_udf("string")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield _cut(batch, path, n)

    return cut


def truncate_tokens(x: Column, path: str, n: int) -> Column:
    """The first n tokens, decoded again; null is empty."""
    return truncating(path, n)(x)


def count_tokens(x: Column, path: str) -> Column:
    """How many tokens a text has; null has none."""

    @F.arrow_udf("bigint")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield _counts(batch, path, pa.int64())

    return count(x)


def cuts(texts: DataFrame, text: str, path: str, n: int) -> DataFrame:
    """(text, cut, tokens) of each distinct text: its first ``n`` tokens, decoded again, and how many tokens that has.

    A text is encoded once, however many rows have it; what is done with the cuts then needs no Python.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = _cut(batch.column(0), path, n)
            yield pa.record_batch([batch.column(0), short, _counts(short, path, pa.int32())], names=[text, "cut", "tokens"])

    return texts.filter(F.col(text) != "").select(text).distinct().mapInArrow(cut, f"`{text}` string, cut string, tokens int")
