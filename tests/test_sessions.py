"""Hand-made trajectories for the operators over steps."""

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import control, history, scoring, session, supervision, transcript
from palimpsest.plans import steps as st

SCHEMA = "traj string, idx long, type string, query string, docid string, returned array<string>, output string"


def run(traj, *steps):
    """search: ("s", query, ids); visit: ("v", docid); reasoning: ("r", text)."""
    rows = []
    for i, x in enumerate(steps):
        kind = {"s": "search", "v": "visit", "r": "reasoning"}[x[0]]
        rows.append((traj, i, kind, x[1] if kind == "search" else None, x[1] if kind == "visit" else None, x[2] if kind == "search" else None, x[1] if kind == "reasoning" else None))
    return rows


def frames(spark, rows, docs="ABCDEF", good="AB"):
    an = st.annotate(spark.createDataFrame(rows, SCHEMA))
    corpus = spark.createDataFrame([(d, f"text {d}") for d in docs], "docid string, text string")
    verdicts = spark.createDataFrame([(d, d in good) for d in docs], "docid string, relevant boolean")
    return an, corpus, verdicts


def groups(spark, rows, **more):
    an, corpus, verdicts = frames(spark, rows, **more)
    chosen = supervision.positives(an, corpus, verdicts)
    got = supervision.groups(chosen, supervision.negatives(an, chosen, corpus, verdicts)).collect()
    return {r["pos_id"]: (r["neg_diversity_id"], r["neg_hard_id"], r["neg_weak_id"], r["reasoning_len"]) for r in got}


BASIC = run("t", ("s", "q1", ["A", "B", "C"]), ("v", "A"), ("r", "good one"), ("s", "q2", ["B", "D", "D"]), ("v", "B"))


def test_an_earlier_relevant_visit_is_a_diversity_negative(spark):
    assert groups(spark, BASIC) == {"A": ([], [], ["C"], 2), "B": (["A"], [], ["D", "D"], 0)}


def test_an_irrelevant_visit_is_a_hard_negative(spark):
    rows = run("t", ("s", "q1", ["C", "B"]), ("v", "C"), ("s", "q2", ["B"]), ("v", "B"))
    assert groups(spark, rows) == {"B": ([], ["C"], [], 0)}


def test_a_document_of_an_earlier_search_is_a_positive_and_no_weak_negative(spark):
    rows = run("t", ("s", "q1", ["A", "E"]), ("s", "q2", ["A", "F"]), ("v", "A"))
    assert groups(spark, rows) == {"A": ([], [], ["F"], 0)}


def test_repeat_visits_visits_before_any_search_and_unknown_documents(spark):
    rows = run("t", ("v", "C"), ("s", "q", ["A", "X"]), ("v", "A"), ("v", "A"), ("s", "q2", ["B"]), ("v", "B"), ("v", "X"))
    assert groups(spark, rows, good="ABX") == {"A": ([], ["C"], [], 0), "B": (["A"], ["C"], [], 0)}


def test_no_group_without_negatives(spark):
    assert groups(spark, run("t", ("s", "q", ["A"]), ("v", "A"))) == {}


def test_reasoning_before_takes_all_and_after_takes_one(spark):
    an = frames(spark, run("t", ("r", " a "), ("r", "b"), ("s", "q", ["A"]), ("v", "A"), ("r", "c"), ("r", "d"), ("s", "q2", []), ("v", "B"), ("s", "q3", [])))[0]
    assert [r["pre"] for r in st.searches(an).orderBy("idx").collect()] == ["a b", "c d", ""]
    assert [r["reasoning"] for r in st.visits(an).orderBy("idx").collect()] == ["c", ""]


def test_styles(spark):
    an, corpus, _ = frames(spark, BASIC)
    rows = history.with_history(an, corpus).select("idx", *[history.render(s, F.lit("Q")).alias(s) for s in history.ALL_STYLES]).orderBy("idx").collect()
    assert rows[0]["i2"] == "Main Question: Q\nCurrent Subquery: q1\nPrevious Interactions: <empty>"
    assert rows[0]["i6"] == "Reasoning: Empty\n\nQuery: q1"
    assert rows[1]["i7"] == "Main Question: Q\nCurrent Reasoning: good one\nCurrent Subquery: q2\nPrevious Interactions:\nPrevious SubQuery 1: q1"
    assert rows[1]["i3"].endswith("Previous SubQuery 1: q1\nVisited Documents: text A")
    assert rows[1]["i4"].endswith("Visited Document Notes: [docs_id:A] good one")
    assert rows[1]["i5"].endswith("Visited Documents: text A\nVisited Document Notes: good one")
    with pytest.raises(ValueError):
        history.render("i9", F.lit("Q"))


def test_memory_stops_at_the_first_overflow(spark):
    notes = [" ".join(f"w{i}x{j}" for j in range(n)) for i, n in enumerate([9, 60, 9, 7, 64, 70, 64, 60])]
    df = spark.createDataFrame([(notes,)], "r array<string>").select(history.memory_block(F.col("r"), F.lit("")).alias("m"))
    kept = df.first()["m"].split(" ; ")
    assert [len(k.split()) for k in kept] == [60, 64, 64, 64] and kept[0] == notes[-1]


def test_dedup_never_returns_a_document_twice(spark):
    pools = [("t", s, [str((s * 3 + i) % 17) for i in range(12)]) for s in range(8)]
    rows = session.dedup_search(spark.createDataFrame(pools, "traj string, step long, docids array<string>"), k=4).orderBy("step").collect()
    seen = set()
    for (_, _, pool), r in zip(pools, rows, strict=True):
        wanted = [d for d in pool if d not in seen][:4]
        assert r["results"] == wanted and r["hidden"] == [d for d in pool[:4] if d in seen]
        seen |= set(wanted)


def test_each_line_is_claimed_once_and_lost_lines_fail(spark):
    lines = spark.createDataFrame([(1, "k"), (2, "k"), (3, "z")], "line long, key string")
    found = spark.createDataFrame([("t1", 1, "k"), ("t0", 5, "k")], "traj string, idx long, key string")
    got = supervision.claim(lines, found, ["key"], "line", ["traj", "idx"]).select("l.line", "r.traj")
    assert {r["line"]: r["traj"] for r in got.collect()} == {1: "t0", 2: "t1", 3: None}
    with pytest.raises(Exception, match="no candidate"):
        supervision.assert_all_claimed(got, "traj").collect()


def test_weights_have_mean_one_over_positive_lengths(spark):
    rows = supervision.reweight(spark.createDataFrame([(n,) for n in (0, 1, 2, 5, 9, None)], "reasoning_len int")).collect()
    own = [r["reweight_rate"] for r in rows if (r["reasoning_len"] or 0) > 0]
    assert abs(sum(own) / len(own) - 1) < 1e-12 and all(r["reweight_rate"] == 1 for r in rows if not r["reasoning_len"])
    assert supervision.reweight(spark.createDataFrame([(None,)], "reasoning_len int")).first()["reweight_rate"] == 1


def test_messages_become_steps_and_a_dropped_call_shifts_traces(spark):
    messages = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", "<think>a</think><think> b </think><tool_call>{\"name\": \"search\", \"arguments\": {\"query\": \"x\"}}</tool_call><tool_call>{bad</tool_call>"),
        (1, 2, "user", "<tool_response>\nhits\n</tool_response>"),
        (1, 3, "assistant", "<tool_call>{\"name\": \"visit\"}</tool_call>"),
        (1, 4, "assistant", "<think>t</think>done"),
    ]
    steps = transcript.parse_messages(spark.createDataFrame(messages, "traj int, turn int, role string, content string"))
    rows = [(r["type"], r["tool_name"], r["arguments"], r["output"]) for r in steps.orderBy("idx").collect()]
    assert rows == [("reasoning", None, None, "a"), ("reasoning", None, None, "b"), ("tool_call", "search", '{"query":"x"}', "hits"), ("tool_call", "visit", "{}", ""), ("output_text", None, None, "<think>t</think>done")]
    traces = spark.createDataFrame([(1, 1, "visit", ["v"]), (1, 2, "search", ["s"])], "traj int, nth int, tool_name string, returned_docids array<string>")
    got = transcript.attach_traces(steps, traces).orderBy("idx").collect()
    assert [r["returned_docids"] for r in got] == [None, None, None, ["v"], None]


def test_scores(spark):
    runs = spark.createDataFrame([("1", "The Ünit.", 3.0), ("2", "", 1.0), ("3", "any", 2.0), ("9", "x", 1.0)], "qid string, response string, steps double")
    truth = spark.createDataFrame([("1", "unit"), ("2", "a"), ("3", "日本")], "qid string, answer string")
    assert list(scoring.exact_match_report(runs, truth).first()) == [3, 2 / 3, 2.0]
    recall = scoring.evidence_recall(spark.createDataFrame([("1", ["a", "b"]), ("2", ["a"])], "qid string, retrieved array<string>"), spark.createDataFrame([("1", "a"), ("1", "c")], "qid string, docid string"))
    assert {r["qid"]: r["recall"] for r in recall.collect()} == {"1": 0.5, "2": 0.0}


def test_stamps():
    stamp = {"retriever": "r", "passage_max_len": 512, "pooling": "mean", "normalize": True}
    assert control.check_stamp(stamp, stamp) == [] and len(control.check_stamp(stamp, stamp | {"pooling": "cls"})) == 1 and control.check_stamp(None, stamp)
