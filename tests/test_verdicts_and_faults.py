"""Verdicts asked once, and faulty trajectories set aside."""

import os
import time

import pyarrow as pa

from palimpsest.operators import quarantine as Q
from palimpsest.operators.verdicts import VerdictStore
from palimpsest.plans.steps import annotate
from palimpsest.operators import supervision


def test_each_distinct_pair_is_asked_once_over_runs_and_repeated_tasks(spark, tmp_path):
    log = str(tmp_path / "calls")
    os.mkdir(log)

    def judge(question, text):
        with open(f"{log}/{os.getpid()}", "a") as f:  # one machine, in this test
            f.write(f"{question}|{text}\n")
        if text == "down":
            raise RuntimeError("down")
        return "<think>RELEVANT?</think>RELEVANT" if question in text else "no"

    rows = [("q", "a q b"), ("q", "a q b"), ("q", "none"), ("a", "q b"), ("aq", " b"), (None, "x"), ("q", None), ("q", "down")] * 3
    frame = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "question string, text string, n int").repartition(5)
    store = VerdictStore(spark, str(tmp_path / "s"))
    calls = lambda: sorted(x for name in os.listdir(log) for x in open(f"{log}/{name}").read().splitlines())
    found = store.ask(frame, "question", "text", judge, attempts=2, wait=0, tasks=3)
    once = ["aq| b", "a|q b", "q|", "q|a q b", "q|none", "|x"]
    assert calls() == sorted(once + ["q|down"] * 2)
    for _ in range(2):  # computed again, no one is asked
        got = {(r["question"], r["text"]): r["relevant"] for r in found.collect()}
    assert got == {("q", "a q b"): True, ("q", "none"): False, ("a", "q b"): False, ("aq", " b"): False, (None, "x"): True, ("q", None): False, ("q", "down"): False}
    assert found.count() == len(rows) and calls() == sorted(once + ["q|down"] * 2)
    again = VerdictStore(spark, str(tmp_path / "s"))
    more = spark.createDataFrame([("q", "new q", 1), ("q", "none", 2)], frame.schema)
    assert sorted(r["relevant"] for r in again.ask(more, "question", "text", judge, wait=0).collect()) == [False, True]
    assert calls() == sorted([*once, "q|new q", "q|down", "q|down"])
    again.compact()
    assert again.known().count() == 7 and len(again.segments.folders) == 1
    assert again.ask(frame.limit(0), "question", "text", judge).collect() == []


STEPS = "traj long, idx long, type string, query string, docid string, returned array<string>, output string"


def run(t):
    return [(t, 1, "search", "q", None, ["1", "2", "3"], None), (t, 2, "visit", None, "1", None, None), (t, 3, "search", "p", None, ["2", "3"], None), (t, 4, "visit", None, "2", None, None), (t, 5, "reasoning", None, None, None, "said so")]


def test_faulty_runs_are_recorded_and_the_others_give_all_their_groups(spark):
    good = [s for t in (1, 2, 3) for s in run(t)]
    bad = [*run(4), (4, 3, "reasoning", None, None, None, "x"), (5, None, "search", "q", None, [], None), *run(6)[:2], (6, 9, "jump", None, None, None, None), (7, 1, "search", None, None, ["1"], None), (8, 1, "visit", None, None, None, None)]
    sound, dead = Q.quarantine(spark.createDataFrame(good + bad, STEPS))
    assert {r["traj"]: r["reason"] for r in dead.collect()} == {
        4: "two steps have the same place", 5: "a step has no place", 6: "a step is of no known type", 7: "a search has no query or results", 8: "a visit names no document",
    }
    corpus, verdicts = spark.createDataFrame([("1",), ("2",), ("3",)], "docid string"), spark.createDataFrame([("2", True)], "docid string, relevant boolean")

    def groups(steps):
        own = annotate(steps)
        chosen = supervision.positives(own, corpus, verdicts)
        return sorted(tuple(r) for r in supervision.groups(chosen, supervision.negatives(own, chosen, corpus, verdicts)).collect())

    assert groups(sound) == groups(spark.createDataFrame(good, STEPS)) and len(groups(sound)) == 3
    whole, none = Q.quarantine(spark.createDataFrame([], STEPS))
    assert whole.collect() == [] and none.collect() == []


def test_functions_that_fail_or_hang_cost_their_own_trajectory(spark):
    def build(steps: pa.Table) -> pa.Table:
        t = steps.column("traj")[0].as_py()
        if t == 2:
            raise ValueError("no such step")
        if t == 4:
            time.sleep(60)
        return pa.table({"n": [len(steps)] if t != 5 else pa.array([], pa.int64()), "extra": ["x"] if t != 5 else pa.array([], pa.string())})

    rows = spark.createDataFrame([(t, i) for t in range(1, 7) for i in range(t)], "traj long, i int")
    kept, dead = Q.guarded(rows, "traj", build, "n long", 3)
    assert sorted(map(tuple, kept.collect())) == [(1, 1), (3, 3), (6, 6)]
    assert {r["traj"]: r["reason"] for r in dead.collect()} == {2: "ValueError: no such step", 4: "took longer than 3 s"}
    kept, dead = Q.guarded(rows.limit(0), "traj", build, "n long", 3)
    assert kept.collect() == [] and dead.collect() == []
