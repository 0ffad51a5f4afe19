"""Session state as it is while an agent runs: a stream of steps whose searches come out with the history that they are conditioned on.

Steps are (traj, step, type, text, found): a reasoning's text, a search's query, or a visit's docid and whether the document exists. A turn is the reasonings
before a call, joined. A search sees the groups before it, each a query with its visits, and its own turn's reasoning; then it opens its group. A visit of a document
that exists joins the newest group. The reasoning of the turn after a visit goes to the last visit of the newest group that has any, if that visit has none yet. This is what an agent's
tool holds; a replay of finished runs (plans.steps) differs on purpose: it takes any parsed visit, and one reasoning step right after it.

Queries of a session are a list in the state, its groups' visits a map, so a step writes the group that it changes. State lives for ``ttl_ms`` after its last change;
a session is closed by a timer when no step came for ``idle_ms``, which emits its whole history once more as a row of type ``closed``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STEPS = "traj string, step long, type string, text string, found boolean"
HISTORY = "array<struct<query:string,docids:array<string>,reasonings:array<string>>>"
OUT = f"traj string, step long, type string, query string, reasoning string, history {HISTORY}"
TTL_MS = 7 * 24 * 60 * 60 * 1000


class LiveSession(StatefulProcessor):
    def __init__(self, ttl_ms: int | None, idle_ms: int | None) -> None:
        self.ttl_ms, self.idle_ms = ttl_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queries = handle.getListState("queries", "query string", self.ttl_ms)
        self.visits = handle.getMapState("visits", "nth int", "docids array<string>, reasonings array<string>", self.ttl_ms)
        self.turn = handle.getValueState("turn", "said array<string>, visited boolean", self.ttl_ms)

    def _held(self) -> tuple[list[str], dict[int, tuple[list[str], list[str]]], list[str], bool]:
        queries = [q for (q,) in self.queries.get()] if self.queries.exists() else []
        visits = {k[0]: (list(v[0]), list(v[1])) for k, v in self.visits.iterator()} if self.visits.exists() else {}
        said, visited = self.turn.get() if self.turn.exists() else ([], False)
        return queries, visits, list(said), bool(visited)

    @staticmethod
    def _history(queries: list[str], visits: dict) -> list[dict]:
        none = ([], [])
        return [{"query": q, "docids": list(visits.get(n, none)[0]), "reasonings": list(visits.get(n, none)[1])} for n, q in enumerate(queries)]

    @staticmethod
    def _paired(visits: dict, said: list[str]) -> set[int]:
        """Gives a turn's reasoning to the newest visit, if that has none; the group that it changed."""
        group = max(visits, default=None)
        if not said or group is None or visits[group][1][-1]:
            return set()
        visits[group][1][-1] = " ".join(said)
        return {group}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  the API's names
        queries, visits, said, visited = self._held()
        opened, changed, out = len(queries), set(), []
        for r in pd.concat(list(rows)).sort_values("step").itertuples(index=False):
            text = r.text if isinstance(r.text, str) else ""
            if r.type == "reasoning":
                said += [text.strip()] if text.strip() else []
                continue
            changed |= self._paired(visits, said if visited else [])
            if r.type == "search":
                out.append((key[0], r.step, "search", text, " ".join(said), self._history(queries, visits)))
                queries.append(text)
            elif r.type == "visit" and r.found is True and queries:
                docids, reasonings = visits.setdefault(len(queries) - 1, ([], []))
                docids.append(text)
                reasonings.append("")
                changed.add(len(queries) - 1)
            said, visited = [], r.type == "visit"
        for q in queries[opened:]:
            self.queries.appendValue((q,))
        for n in changed:
            self.visits.updateValue((n,), visits[n])
        self.turn.update((said, visited))
        if self.idle_ms is not None:
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=["traj", "step", "type", "query", "reasoning", "history"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        queries, visits, said, visited = self._held()
        self._paired(visits, said if visited else [])
        for state in (self.queries, self.visits, self.turn):
            state.clear()
        yield pd.DataFrame([(key[0], None, "closed", None, " ".join(said), self._history(queries, visits))], columns=["traj", "step", "type", "query", "reasoning", "history"])

    def close(self) -> None:
        pass


def read_steps(spark: SparkSession, path: str, files_each: int = 100) -> DataFrame:
    """Steps from a folder of JSON lines that grows; a session's steps arrive in order."""
    return spark.readStream.schema(STEPS).option("maxFilesPerTrigger", files_each).json(path)


def live_searches(steps: DataFrame, ttl_ms: int | None = None, idle_ms: int | None = None) -> DataFrame:
    """(traj, step, type, query, reasoning, history) of a stream's searches. Spark's RocksDB state store holds the sessions: set ``use_rocksdb`` before.

    A query with a time to live (TTL_MS is a week) or a timer keeps running; one that takes what there is and ends has neither, and its checkpoint holds the sessions.
    """
    return steps.groupBy("traj").transformWithStateInPandas(LiveSession(ttl_ms, idle_ms), OUT, "Append", "None" if ttl_ms is None and idle_ms is None else "ProcessingTime")


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that lists, maps, timers and TTL need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
