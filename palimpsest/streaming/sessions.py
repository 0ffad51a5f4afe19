"""Sessions as streams: de-duplicated search that goes on where the last batch stopped.

The state of a session is the list of docids it has returned, bounded by the session's call budget times k; it goes when nothing
arrived for ``idle_ms``. Such a timeout makes a query run on and on, so it is given to one that keeps running (IDLE_MS is a day); a query that
takes what there is and ends has none, and its checkpoint holds the sessions. Resuming after a failure is the checkpoint's work.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.session import POOL, K

POOLS = "traj string, step long, docids array<string>"
IDLE_MS = 24 * 60 * 60 * 1000
RESULTS = "traj string, step long, results array<string>, hidden array<string>"


def read_pools(spark: SparkSession, path: str, files_each: int = 100) -> DataFrame:
    """Candidate pools (traj, step, docids) from a folder of JSON lines that grows."""
    return spark.readStream.schema(POOLS).option("maxFilesPerTrigger", files_each).json(path)


def _fold(k: int, pool: int, idle_ms: int | None):
    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = list(state.get[0]) if state.exists else []
        known, out = set(seen), []
        rows = pd.concat(list(batches)).sort_values("step")
        for step, docids in zip(rows["step"], rows["docids"], strict=True):
            own = list(docids)[: max(k, pool)]
            results = [d for d in own if d not in known][:k]
            out.append((key[0], step, results, [d for d in own[:k] if d in known]))
            seen += results
            known.update(results)
        state.update((seen,))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["traj", "step", "results", "hidden"])

    return fold


def dedup_search_stream(pools: DataFrame, k: int = K, pool: int = POOL, idle_ms: int | None = None) -> DataFrame:
    """As operators.session.dedup_search, for a stream whose sessions' steps arrive in order."""
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return pools.groupBy("traj").applyInPandasWithState(_fold(k, pool, idle_ms), RESULTS, "seen array<string>", "append", timeout)


def visit_counts_stream(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(start, kind, n): steps of each kind in windows of event time; what comes later than ``late`` is left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "kind").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "kind", "n")


def write_stream(results: DataFrame, path: str, checkpoint: str):
    """Starts writing what there is, exactly once for each checkpoint."""
    return results.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
