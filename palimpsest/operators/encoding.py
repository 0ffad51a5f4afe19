"""What is done around an encoder: prefixes of passages, pooling of its states, sharded encoding. The encoder itself is a plug-in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import l2_normalize

# Which pooling goes with a retrieval method whose name holds the key; others pool by mean.
POOLING = {"e5": "mean", "bge": "cls", "contriever": "mean", "jina": "mean"}
# Fixed value: the instruction of the retriever that always uses the same one.
REASONING_INSTRUCTION = "<|user|>\nGiven a question, retrieve relevant passages that help answer the question\n<|embed|>\n"

Encoder = Callable[[list[str]], np.ndarray]


def passage_text(method: str, text: Column) -> Column:
    """A passage as the encoder of a method reads it."""
    return F.concat(F.lit("passage: "), text) if method == "e5" else text


def pooling_of(method: str, given: str | None = None) -> str:
    """The pooling that is given, else the one that goes with the method's name."""
    return given or next((how for name, how in POOLING.items() if name in method.lower()), "mean")


def pool(states: Column, mask: Column, how: str = "mean", pooled: Column | None = None) -> Column:
    """One vector of a text's states (array of vectors): the mean of those that ``mask`` (array of 0 and 1) has, the first, or the encoder's own."""
    if how == "cls":
        return F.get(states, F.lit(0))
    if how == "pooler":
        if pooled is None:
            raise ValueError("the encoder's own vector is not there")
        return pooled
    if how != "mean":
        raise ValueError(f"unknown pooling {how}")
    inside = F.transform(F.filter(F.arrays_zip(states.alias("s"), mask.alias("m")), lambda x: x["m"] == 1), lambda x: x["s"])
    zero = F.transform(F.get(states, F.lit(0)), lambda _: F.lit(-0.0))  # with it a sum of negative zeros keeps its sign
    total = F.aggregate(inside, zero, lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
    return F.transform(total, lambda x: x / F.size(inside))


def encode(texts: DataFrame, encoder: Encoder, prefix: str = "", normalize: bool = True, key: str = "docid") -> DataFrame:
    """(key, embedding) of (key, text), a batch of texts at a time in every task; ``encoder`` gives a matrix with a row for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = np.asarray(encoder([prefix + (t or "") for t in batch.column("text").to_pylist()]), np.float64)
                yield pa.record_batch([batch.column(key), pa.array(list(vectors), pa.list_(pa.float64()))], names=[key, "embedding"])

    out = texts.select(F.col(key).cast("string").alias(key), "text").mapInArrow(run, f"{key} string, embedding array<double>")
    return out.withColumn("embedding", l2_normalize("embedding")) if normalize else out
