"""Live sessions and questions as streams."""

import json
import random
import time

import pytest
from pyspark.sql.readwriter import DataFrameWriter

from palimpsest.streaming import live as L
from palimpsest.streaming import questions as Q

NAMES = ("traj", "step", "type", "text", "found")


def told(rows):
    """Each search with what it is conditioned on, by the rules as they are stated; and the histories at the end."""
    out, ends = {}, {}
    for t in {r[0] for r in rows}:
        groups, said, visited = [], [], False

        def pair(groups=groups):
            held = [g for g in groups if g[1]]
            if visited and said and held and not held[-1][2][-1]:
                held[-1][2][-1] = " ".join(said)

        for _, step, kind, text, found in sorted((r for r in rows if r[0] == t), key=lambda r: r[1]):
            if kind == "reasoning":
                said += [text.strip()] if text and text.strip() else []
                continue
            pair()
            if kind == "search":
                out[t, step] = (text, " ".join(said), [(q, list(d), list(r)) for q, d, r in groups])
                groups.append((text, [], []))
            elif found and groups:
                groups[-1][1].append(text)
                groups[-1][2].append("")
            said, visited = [], kind == "visit"
        pair()
        ends[t] = [(q, list(d), list(r)) for q, d, r in groups]
    return out, ends


def steps(seed, n=60):
    rng = random.Random(seed)
    return [(f"t{k}", i, kind, None if rng.random() < 0.05 and kind == "reasoning" else f" {kind[0]}{i}", rng.random() < 0.7 if kind == "visit" else None) for k in range(4) for i in range(n) for kind in [rng.choice(["search", "visit", "visit", "reasoning", "reasoning"])]]


def plain(history):
    return [(g["query"], list(g["docids"]), list(g["reasonings"])) for g in history]


def put(folder, name, rows):
    (folder / name).write_text("".join(json.dumps(dict(zip(NAMES, r, strict=True))) + "\n" for r in rows))


@pytest.fixture
def source(spark, tmp_path):
    L.use_rocksdb(spark)
    (tmp_path / "in").mkdir()
    return tmp_path / "in"


def test_a_stream_in_parts_equals_the_rules(spark, tmp_path, source):
    rows = steps(1)
    rows = [(*r[:3], r[3].strip() if r[2] != "reasoning" else r[3], r[4]) for r in rows]
    for part, (lo, hi) in enumerate(((0, 13), (13, 14), (14, 60))):
        put(source, f"{part}.json", [r for r in rows if lo <= r[1] < hi])
        query = L.live_searches(L.read_steps(spark, str(source))).writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    got = {(r["traj"], r["step"]): (r["query"], r["reasoning"], plain(r["history"])) for r in spark.read.schema(L.OUT).json(str(tmp_path / "out")).collect()}
    assert got == told(rows)[0]


def test_idle_sessions_are_closed_by_a_timer(spark, source, tmp_path):
    rows = [("a", 0, "search", "q", None), ("a", 1, "visit", "d", True), ("a", 2, "reasoning", "so", None)]
    put(source, "0.json", rows)
    query = L.live_searches(L.read_steps(spark, str(source)), ttl_ms=600_000, idle_ms=1500).writeStream.format("memory").queryName("closing").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        ends = time.time() + 90
        while time.time() < ends and not (closed := [r for r in spark.table("closing").collect() if r["type"] == "closed"]):
            time.sleep(1)
        assert [(r["traj"], r["reasoning"], plain(r["history"])) for r in closed] == [("a", "so", told(rows)[1]["a"])]
    finally:
        query.stop()


def ask(spark, tmp_path, run, checkpoint):
    answer = lambda rows: rows.selectExpr("qid", "concat('re ', question) as answer")
    return Q.answer_stream(Q.read_questions(spark, str(tmp_path / "asked"), 1), answer, "qid string, answer string", str(tmp_path / "out"), str(tmp_path / checkpoint), run)


def test_questions_are_answered_once_whatever_fails(spark, tmp_path, monkeypatch):
    (tmp_path / "asked").mkdir()
    write = lambda name, ids: (tmp_path / "asked" / name).write_text("".join(f"{i}\tquestion {i}\n" for i in ids))
    write("0.tsv", [1, 2, 3])
    write("1.tsv", [3, 4, 4])
    whole, left = DataFrameWriter.json, [2]

    def dies(self, path, *a, **b):
        whole(self, path, *a, **b)
        left[0] -= 1
        if left[0] == 0:  # the second batch is written, and never committed
            raise RuntimeError("killed")

    monkeypatch.setattr(DataFrameWriter, "json", dies)
    with pytest.raises(Exception, match="killed"):
        ask(spark, tmp_path, "one", "c1").awaitTermination(120)
    monkeypatch.setattr(DataFrameWriter, "json", whole)
    write("2.tsv", [5, 1])
    assert ask(spark, tmp_path, "one", "c1").awaitTermination(120)
    want = [(str(i), f"re question {i}") for i in range(1, 6)]
    got = lambda: sorted((r["qid"], r["answer"]) for r in Q.answered(spark, str(tmp_path / "out"), "qid string, answer string").collect())
    assert got() == want
    write("3.tsv", [6])
    assert ask(spark, tmp_path, "two", "c2").awaitTermination(120)  # the checkpoint is lost: all files come again
    assert got() == [*want, ("6", "re question 6")]
