import json

import pytest
from pyspark.sql import functions as F

from palimpsest.config import Arm, Benchmark, command
from palimpsest.functions import payload
from palimpsest.operators import retrieval


def test_docids_in_outputs(spark):
    cases = [('[{"docid": "a"}, {"docid": "a"}, {"x": 1}]', ["a"]), ('{"results": [{"docid": "b"}], "returned_earlier": [{"docid": "c"}]}', ["b"]), ('cut "docid": "d", "docid": 12', ["d", "12"]), ("none", []), (None, [])]
    df = spark.createDataFrame([(a,) for a, _ in cases], "x string").select(payload.docids_in_json(F.col("x")).alias("y"))
    assert [r["y"] for r in df.collect()] == [b for _, b in cases]


def test_unknown_styles_and_fields_fail(spark):
    one = spark.createDataFrame([("plain", "q")], "style string, query string")
    assert one.select(payload.encoder_text(F.col("style"), F.col("query")).alias("x")).first()["x"] == f"Instruct: {payload.INSTRUCTIONS['i0']}\nQuery: q"
    assert one.select(payload.encoder_text(F.col("style"), F.col("query"), "Query: ").alias("x")).first()["x"] == "Query: q"
    with pytest.raises(Exception, match="unknown style"):
        one.select(payload.encoder_text(F.lit("i9"), F.col("query"))).collect()
    with pytest.raises(ValueError):
        payload.fill("{a} {b}", a=F.lit(1))


def test_hidden_results_are_named(spark):
    row = spark.createDataFrame([([("1", "s")], [("2", "first line\nrest")])], "results array<struct<docid:string,snippet:string>>, hidden array<struct<docid:string,text:string>>")
    got = json.loads(row.select(payload.results_json(F.col("results"), F.col("hidden")).alias("x")).first()["x"])
    assert got["results"] == [{"docid": "1", "snippet": "s"}] and got["returned_earlier"] == [{"docid": "2", "title": "first line"}]


def test_searchers_and_commands(spark):
    corpus = spark.createDataFrame([("1", "red fox"), ("2", "blue fox"), ("3", None)], "docid string, text string")
    asked = spark.createDataFrame([("q", "Red FOX")], "qid string, text string")
    assert [r["docid"] for r in retrieval.searcher("bm25", corpus).search(asked, 5).orderBy("rank").collect()] == ["1", "2"]
    vectors = spark.createDataFrame([("1", [1.0, 0.0]), ("2", [1.0, 0.0]), ("3", None)], "docid string, embedding array<float>")
    query = spark.createDataFrame([("q", [1.0, 0.0])], "qid string, embedding array<float>")
    for name in ("dense", "cells"):
        assert [(r["docid"], r["rank"]) for r in retrieval.searcher(name, vectors).search(query, 10).orderBy("rank").collect()] == [("1", 1), ("2", 2)]
    assert retrieval.dense_topk(query, vectors, block=1).count() == 2
    with pytest.raises(ValueError):
        retrieval.searcher("other", corpus)
    assert "--dedup" in command(Arm("a", "r"), Benchmark("b", "q", "t", "c"), "runs")
