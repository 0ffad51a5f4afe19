"""Verdicts that are asked for once: a store of them, addressed by what was asked.

A pair's key is the digest of its question and text. Distinct pairs that the store lacks go to the judge, their answers become a
segment of the store, and rows get their verdicts by a join with it: what is computed again later reads the store and asks no one. A pair
whose attempts all fail is not stored; it counts as no, and the next run asks again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.segments import Segments
from .control import says_relevant, tried

SCHEMA = "key string, relevant boolean"

#: A question and a text to a judge's answer.
Judge = Callable[[str, str], str]


def pair_key(question: str, text: str) -> Column:
    """Nulls are empty; the question's length keeps pairs apart whose parts are cut elsewhere."""
    q, t = (F.coalesce(F.col(c), F.lit("")) for c in (question, text))
    return F.sha2(F.concat_ws(":", F.length(q).cast("string"), F.concat(q, t)).cast("binary"), 256)


class VerdictStore:
    """The verdicts (key, relevant) in a folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.segments = spark, Segments(spark, path)

    def known(self) -> DataFrame:
        return self.segments.read("verdicts", SCHEMA)

    def ask(self, rows: DataFrame, question: str, text: str, judge: Judge, attempts: int = 3, wait: float = 1.0, tasks: int | None = None) -> DataFrame:
        """``rows`` with ``relevant``. The judge is called in the tasks, ``tasks`` of them if that is how many calls may run at once."""
        keyed = rows.withColumn("key_", pair_key(question, text))
        pairs = keyed.groupBy(F.col("key_").alias("key")).agg(F.first(F.struct(F.coalesce(F.col(question), F.lit("")).alias("q"), F.coalesce(F.col(text), F.lit("")).alias("t"))).alias("x"))
        unseen = pairs.join(self.known().select("key"), "key", "left_anti").select("key", "x.q", "x.t")
        unseen = unseen if tasks is None else unseen.repartition(tasks, "key")

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                said = [tried(lambda q=q, t=t: says_relevant(judge(q, t)), attempts, wait, None) for q, t in zip(batch.column("q").to_pylist(), batch.column("t").to_pylist(), strict=True)]
                yield pa.record_batch([batch.column("key"), pa.array(said, pa.bool_())], names=["key", "relevant"])

        answers = unseen.mapInArrow(ask, SCHEMA).filter("relevant is not null")
        self.segments = self.segments.append(uuid.uuid4().hex, lambda folder, _: answers.write.parquet(f"{folder}/verdicts"))
        found = self.known().dropDuplicates(["key"]).select(F.col("key").alias("key_"), "relevant")
        return keyed.join(found, "key_", "left").drop("key_").withColumn("relevant", F.coalesce("relevant", F.lit(False)))

    def compact(self) -> None:
        """One segment in place of those of all runs."""
        self.segments = self.segments.compact(lambda folder: self.known().dropDuplicates(["key"]).write.parquet(f"{folder}/verdicts"))
