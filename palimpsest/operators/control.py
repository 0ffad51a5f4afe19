"""What is still to do, who does it, and whether an index fits."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The fields of a run's metadata, in order.
METADATA = (
    "model", "temperature", "top_p", "presence_penalty", "snippet_max_tokens", "k", "searcher_type", "query_style", "retriever_model_name",
    "index_path", "dataset_name", "pooling", "normalize", "torch_dtype", "task_prefix", "max_length", "query_source",
)
FIELDS = ("retriever", "passage_max_len", "pooling", "normalize")


def pending(questions: DataFrame, done: DataFrame, key: str = "qid") -> DataFrame:
    """Questions without an output yet."""
    return questions.join(done.select(key), key, "left_anti")


def shard(rows: DataFrame, order: str, n: int, i: int) -> DataFrame:
    """Every n-th row from the i-th on, by ``order``."""
    return batches(rows, [order], n).filter(F.col("place") == i).drop("batch", "place")


def check_stamp(stamp: dict | None, wanted: dict) -> list[str]:
    """What in an index's stamp differs from what is wanted; empty if it fits."""
    if stamp is None:
        return ["the index has no stamp"]
    return [f"{f}: index has {stamp.get(f)!r}, wanted {wanted[f]!r}" for f in FIELDS if f in wanted and stamp.get(f) != wanted[f]]


def run_metadata(question: Column, **settings) -> Column:
    """A run's metadata as a struct of METADATA; what isn't set is null, ``normalize`` false. Unknown settings fail."""
    if unknown := set(settings) - set(METADATA):
        raise ValueError(f"unknown settings {sorted(unknown)}")
    values = settings | {"normalize": bool(settings.get("normalize", False))}
    return F.struct(*[(question if name == "query_source" else F.lit(values.get(name))).alias(name) for name in METADATA])


def batches(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """Adds ``batch`` and ``place``: rows in ``order`` in batches of ``size``, the last perhaps shorter.

    Ranges of the order are counted, then places are the counts before a range and those within it, so no task sees all rows.
    """
    if size < 1:
        raise ValueError("a batch holds one row at least")
    ranged = rows.repartitionByRange(*order).withColumn("range_", F.spark_partition_id())
    within = F.row_number().over(Window.partitionBy("range_").orderBy(*order))
    counts = ranged.groupBy("range_").agg(F.count(F.lit(1)).alias("n_"))
    first = counts.withColumn("first_", F.coalesce(F.sum("n_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n_")
    at = F.col("first_") + F.col("within_") - 1
    placed = ranged.withColumn("within_", within).join(F.broadcast(first), "range_")  # a row for each partition
    return placed.withColumn("batch", F.floor(at / size)).withColumn("place", F.pmod(at, F.lit(size)).cast("bigint")).drop("range_", "within_", "first_")


def judge_model(named: str | None, served: Callable[[], list[str]]) -> str:
    """The model that is named; ``auto`` or none is the first one served, and fails if there is none, rather than have every verdict fail."""
    if named and named != "auto":
        return named
    models = served()
    if not models:
        raise RuntimeError("no model is served")
    return models[0]


def tried(call: Callable[[], bool], attempts: int = 3, wait: float = 1.0, failed: bool | None = False) -> bool | None:
    """The call's answer, ``failed`` if all attempts fail."""
    for left in range(attempts - 1, -1, -1):
        try:
            return call()
        except Exception:
            if left:
                time.sleep(wait)
    return failed


def says_relevant(answer: str | None) -> bool:
    """Whether the first word after an answer's thoughts is RELEVANT."""
    said = (answer or "").strip()
    words = said.split("</think>", 1)[-1].split()
    return bool(words) and words[0] == "RELEVANT"


def with_verdicts(rows: DataFrame, text: str, judge: Callable[[str], str], attempts: int = 3, wait: float = 1.0, verdict: str = "relevant") -> DataFrame:
    """``rows`` with the judge's verdict on their text: true if the answer's first word after its thoughts is RELEVANT; false when all attempts fail.

    The judge is called once a row and attempt, in the tasks; write the result before using it twice.
    """
    place = rows.columns.index(text)

    def ask(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            found = [tried(lambda x=x: says_relevant(judge(x)), attempts, wait) for x in batch.column(place).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(found, pa.bool_())], names=[*batch.schema.names, verdict])

    from pyspark.sql import types as T

    return rows.mapInArrow(ask, T.StructType([*rows.schema.fields, T.StructField(verdict, T.BooleanType())]))
