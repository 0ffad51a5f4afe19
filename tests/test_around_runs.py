"""Operators around runs and encoders: verdicts, batches, tools, pooling, tokenizers, saved indexes, own searchers."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import control, dense_index, encoding, retrieval, session
from palimpsest.sources import corpus as io

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def test_verdicts_take_the_first_word_after_thoughts_and_fail_to_false(spark):
    said = {"a": "RELEVANT yes", "b": "<think>x</think> RELEVANT", "c": "IRRELEVANT", "d": "", "e": "RELEVANT."}

    def judge(x):
        if x is None:
            raise RuntimeError("down")
        return said[x]

    rows = spark.createDataFrame([(k, i) for i, k in enumerate([*said, None])], "text string, n int")
    got = {r["text"]: r["relevant"] for r in control.with_verdicts(rows, "text", judge, wait=0).collect()}
    assert got == {"a": True, "b": True, "c": False, "d": False, "e": False, None: False}
    assert control.with_verdicts(rows.limit(0), "text", judge).collect() == []


def test_attempts_are_bounded_and_models_resolved():
    calls = []

    def second_time():
        calls.append(1)
        if len(calls) < 2:
            raise OSError
        return True

    assert control.tried(second_time, 3, 0) and len(calls) == 2
    assert control.tried(lambda: 1 / 0, 2, 0) is False
    assert control.judge_model("m", list) == "m" and control.judge_model("auto", lambda: ["x", "y"]) == "x"
    with pytest.raises(RuntimeError):
        control.judge_model(None, list)


def test_batches_are_full_but_for_the_last(spark):
    rows = spark.range(23).select((F.lit(100) - F.col("id")).alias("id")).repartition(5)
    got = sorted((r["batch"], r["place"], r["id"]) for r in control.batches(rows, ["id"], 10).collect())
    assert got == [(i // 10, i % 10, 78 + i) for i in range(23)]
    assert control.batches(rows.limit(0), ["id"], 10).collect() == []
    with pytest.raises(ValueError):
        control.batches(rows, ["id"], 0)


def test_metadata_has_its_fields_in_order(spark):
    row = spark.range(1).select(control.run_metadata(F.lit("q"), model="m", normalize=1).alias("m")).first()["m"]
    assert list(row.asDict()) == list(control.METADATA) and (row["model"], row["normalize"], row["query_source"], row["k"]) == ("m", True, "q", None)
    with pytest.raises(ValueError):
        control.run_metadata(F.lit("q"), colour=1)


def test_questions_fall_back(spark):
    schema = "s string, m array<struct<role:string,content:string>>, q string, n string"
    rows = [("a", [("user", "u")], "q", "n"), ("", [("system", "s"), ("user", "u")], "q", "n"), (None, [("user", "")], "q", "n"), (None, [], "q", "n"), (None, None, "", "n"), (None, None, None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, schema).select(T.original_question("s", "m", "q", "n")).collect()]
    assert got == ["a", "u", "", "q", "n", ""]


def test_calls_meet_their_tools(spark):
    calls = ['{"name": "visit", "arguments": {"docid": "1"}}', '{"name": "search"}', '{"arguments": {}}', "[1]", None, '{"name": "x"}']
    got = [(r["tool"], r["handler"], r["arguments"], r["error"]) for r in session.dispatch(spark.createDataFrame([(c, i) for i, c in enumerate(calls)], "call string, n int")).orderBy("n").collect()]
    assert got == [("visit", "get_document", '{"docid":"1"}', None), ("search", "search", "{}", None), ("", None, "{}", "Error: Tool  not found"), (None, None, None, session.INVALID), (None, None, None, session.INVALID), ("x", None, "{}", "Error: Tool x not found")]


def test_pooling(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 6.0], [9.0, 9.0]], [1, 1, 0], [7.0])], "s array<array<double>>, m array<int>, p array<double>")
    pool = lambda how: df.select(encoding.pool(F.col("s"), F.col("m"), how, F.col("p"))).first()[0]
    assert (pool("mean"), pool("cls"), pool("pooler")) == ([2.0, 4.0], [1.0, 2.0], [7.0])
    with pytest.raises(ValueError):
        encoding.pool(F.col("s"), F.col("m"), "max")
    assert encoding.pooling_of("BGE-large") == "cls" and encoding.pooling_of("bge", "mean") == "mean"


def counting():
    """An encoder; made here so that workers get it by value."""

    def letters(texts):
        return np.array([[t.count(c) + 1e-3 for c in "abcde"] for t in texts])

    return letters


def test_an_instruction_goes_before_every_query_and_own_searchers_are_found(spark):
    letters = counting()
    corpus = encoding.encode(spark.createDataFrame([("1", "aaab"), ("2", "cccd"), ("3", None)], "docid string, text string"), letters)
    queries = spark.createDataFrame([("q", "a")], "qid string, text string")
    plain = retrieval.dense_topk(encoding.encode(queries, letters, key="qid"), corpus, 1).first()
    turned = retrieval.searcher("instructed", corpus, encoder=letters, instruction="c" * 50).search(queries, 1).first()
    assert (plain["docid"], turned["docid"]) == ("1", "2")
    retrieval.register_searcher("own", retrieval.DenseSearcher)
    assert isinstance(retrieval.searcher("own", corpus), retrieval.DenseSearcher)
    with pytest.raises(ValueError):
        retrieval.searcher("nothing", corpus)


def test_saved_cells_find_what_they_found_before(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(str(i), [float(x) for x in v / np.linalg.norm(v)]) for i, v in enumerate(rng.normal(size=(400, 16)))]
    corpus = spark.createDataFrame([*rows, ("none", None), ("empty", [])], "docid string, embedding array<double>")
    queries = corpus.filter("docid in ('3', '50', '399', 'none')").withColumnRenamed("docid", "qid")
    own = dense_index.index_of(corpus, "IVF8,Flat")
    own.save(str(tmp_path / "i"))
    again = retrieval.Cells.load(spark, str(tmp_path / "i"), probes=8)
    exact = retrieval.dense_topk(queries, corpus)
    key = lambda df: sorted((r["qid"], r["rank"], r["docid"]) for r in df.collect())
    assert key(again.search(queries)) == key(exact)
    assert retrieval.recall(retrieval.Cells(corpus).search(queries), exact).first()["recall"] >= 0.9
    assert key(own.search(queries, probes=1)) == key(retrieval.Cells.load(spark, str(tmp_path / "i")).search(queries, probes=1))
    with pytest.raises(ValueError):
        dense_index.index_of(corpus, "PQ")
    assert retrieval.Cells(corpus.limit(0)).search(queries).collect() == []


def test_indexes_without_vectors(spark, tmp_path):
    postings = spark.createDataFrame([("1", "a", 2)], "docid string, term string, tf long")
    io.write_index(postings, None, str(tmp_path / "p"))
    again, vectors = io.read_index(spark, str(tmp_path / "p"))
    assert [tuple(r) for r in again.collect()] == [("1", "a", 2)] and vectors is None


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer here")
def test_cuts_and_lengths_in_tokens(spark):
    from palimpsest.functions.tokens import count_tokens, truncate_tokens
    from tokenizers import Tokenizer

    own, said = Tokenizer.from_file(TOKENIZER), ["some words, some more", "", None, "é ü", "a <|endoftext|> b"]
    got = spark.createDataFrame([(t,) for t in said], "t string").select("t", count_tokens(F.col("t"), TOKENIZER).alias("n"), truncate_tokens(F.col("t"), TOKENIZER, 3).alias("cut")).collect()
    for r in got:
        ids = own.encode(r["t"] or "", add_special_tokens=False).ids
        assert r["n"] == len(ids) and r["cut"] == own.decode(ids[:3], skip_special_tokens=False)


def test_truncation_takes_whole_words_only(spark):
    said = ["one  two\tthree four ", " ", None, "one", "  a b c d", "x" * 5000 + " y z"]
    rows = spark.createDataFrame([(t,) for t in said], "t string").select(T.truncate("t", 3).alias("c"), T.truncate("t", 0).alias("none")).collect()
    assert [r["c"] for r in rows] == [" ".join((t or "").split()[:3]) for t in said] and all(r["none"] == "" for r in rows)
