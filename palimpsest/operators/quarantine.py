"""Faulty trajectories set aside with their reason, while the rest goes on."""

from __future__ import annotations

import threading
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.corpus import scratch

KINDS = ("search", "visit", "reasoning")


def faults(steps: DataFrame) -> DataFrame:
    """(traj, reason) of trajectories whose steps can't be trusted; the first reason that holds."""
    rules: list[tuple[str, Column]] = [
        ("a step has no place", F.count(F.when(F.col("idx").isNull(), 1)) > 0),
        ("two steps have the same place", F.countDistinct("idx") < F.count("idx")),
        ("a step is of no known type", F.count(F.when(~F.coalesce(F.col("type").isin(*KINDS), F.lit(False)), 1)) > 0),
        ("a search has no query or results", F.count(F.when((F.col("type") == "search") & (F.col("query").isNull() | F.col("returned").isNull()), 1)) > 0),
        ("a visit names no document", F.count(F.when((F.col("type") == "visit") & F.col("docid").isNull(), 1)) > 0),
    ]
    reason = F.coalesce(*[F.when(rule, F.lit(said)) for said, rule in rules])
    return steps.groupBy("traj").agg(reason.alias("reason")).filter("reason is not null")


def quarantine(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The steps of sound trajectories, and the dead letters (traj, reason) of the others."""
    dead = faults(steps)
    return steps.join(dead.select("traj"), steps.traj.eqNullSafe(dead.traj), "left_anti"), dead


def guarded(rows: DataFrame, key: str, function: Callable[[pa.Table], pa.Table], schema: str, seconds: float) -> tuple[DataFrame, DataFrame]:
    """What ``function`` makes of each trajectory's rows, as (key, columns of ``schema``), and the dead letters (key, reason) of those that failed or took longer than ``seconds``.

    A group is a trajectory, whose calls are bounded. Both results are of one run, which is written to the shared folder. A call that takes too long is left behind on
    a thread of its own; it ends with its worker.
    """
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    made = spark.createDataFrame([], f"`{key}` {kind}, reason string, {schema}")
    whole = to_arrow_schema(made.schema)
    own = [f.name for f in whole][2:]

    def run(group: pa.Table) -> pa.Table:
        out: dict[str, object] = {}

        def call() -> None:
            try:
                out["rows"] = function(group).select(own)
            except Exception as e:  # any fault of a trajectory is its own
                out["reason"] = f"{type(e).__name__}: {e}"

        thread = threading.Thread(target=call, daemon=True)
        thread.start()
        thread.join(seconds)
        name = group.column(key)[0]
        if "rows" not in out:
            reason = out.get("reason", f"took longer than {seconds:g} s")
            return pa.table([pa.array([name.as_py()], whole.field(0).type), pa.array([reason], pa.string()), *[pa.nulls(1, whole.field(c).type) for c in own]], schema=whole)
        found = out["rows"]
        return pa.table([pa.array([name.as_py()] * len(found), whole.field(0).type), pa.nulls(len(found), pa.string()), *[found.column(c).cast(whole.field(c).type) for c in own]], schema=whole)

    path = scratch(spark, "guarded")
    rows.groupBy(key).applyInArrow(run, made.schema).withColumn("failed", F.col("reason").isNotNull()).write.partitionBy("failed").parquet(path)
    kept = spark.read.schema(f"`{key}` {kind}, reason string, {schema}, failed boolean").parquet(path)
    return kept.filter("not failed").drop("failed", "reason"), kept.filter("failed").select(key, "reason")
