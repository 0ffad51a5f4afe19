"""Questions as a stream: each is answered once, whatever fails in between.

A micro-batch's answers are one folder, named by the run and the batch's number, that is written whole. When a batch was written and not yet committed, the stream takes
it again and replaces the same folder. Questions that another batch or another run (another checkpoint) has answered are left out first, so a lost checkpoint
costs no answer twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.control import pending

QUESTIONS = "qid string, question string"


def read_questions(spark: SparkSession, path: str, files_each: int = 100) -> DataFrame:
    """Questions from a folder of tab-separated files that grows."""
    rows = spark.readStream.schema(QUESTIONS).option("sep", "\t").option("maxFilesPerTrigger", files_each).csv(path)
    return rows.filter("qid is not null").select(F.trim("qid").alias("qid"), F.trim("question").alias("question"))


def answered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All answers, with the run and batch that they are from."""
    try:
        return spark.read.schema(f"{schema}, run string, batch long").json(path)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], f"{schema}, run string, batch long")


def answer_stream(questions: DataFrame, answer: Callable[[DataFrame], DataFrame], schema: str, path: str, checkpoint: str, run: str) -> StreamingQuery:
    """Starts answering what there is. ``answer`` makes rows of ``schema``, which has a ``qid``, from (qid, question); a new checkpoint needs a new name of the ``run``."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        others = answered(spark, path, schema).filter(~((F.col("run") == run) & (F.col("batch") == number)))
        own = pending(batch.dropDuplicates(["qid"]), others.select("qid").distinct())
        answer(own).write.mode("overwrite").json(f"{path}/run={run}/batch={number}")

    return questions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
