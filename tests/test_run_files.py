"""The data source of run files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from palimpsest.sources.run_files import SCHEMA, register_runs

RUN = "qid string, query_id string, status string, tool_call_counts map<string,double>, retrieved_docids array<string>, result array<struct<type:string,tool_name:string,arguments:string,output:string>>"


@pytest.fixture
def runs(spark):
    register_runs(spark)
    rows = [(f"q/{i}", f"{i}.0", "completed", {"search": float(i)}, [str(i)], [("tool_call", "search", '{"query": "x"}', "out é"), ("output_text", None, None, f"answer {i}")][: 1 + i % 2]) for i in range(12)]
    return spark.createDataFrame(rows, RUN).repartition(4)


def read(spark, path, **options):
    return spark.read.format("runs").options(**options).load(path)


def test_round_trip_with_one_named_file_for_each_question(spark, runs, tmp_path):
    path = str(tmp_path / "r")
    os.mkdir(path)
    runs.write.format("runs").mode("append").save(path)
    assert sorted(os.listdir(path)) == sorted(f"run_q_{i}.json" for i in range(12))
    back = read(spark, path, groupbytes="500")
    assert back.rdd.getNumPartitions() > 3 and read(spark, path).rdd.getNumPartitions() == 1
    assert sorted(map(str, back.drop("file", "bad").collect())) == sorted(map(str, runs.collect()))
    assert back.filter("bad").count() == 0
    again = runs.filter("qid = 'q/3'").withColumn("status", F.lit("again"))
    again.write.format("runs").mode("append").save(path)
    assert sorted((r["qid"], r["status"]) for r in read(spark, path).filter("status <> 'completed'").collect()) == [("q/3", "again")] and read(spark, path).count() == 12
    again.write.format("runs").mode("overwrite").save(path)
    assert os.listdir(path) == ["run_q_3.json"]


def test_failed_jobs_leave_nothing(spark, runs, tmp_path):
    path = str(tmp_path / "r")
    os.mkdir(path)
    fails = F.udf(lambda q: q if q != "q/7" else 1 / 0, "string").asNondeterministic()
    with pytest.raises(Exception, match="ZeroDivisionError"):
        runs.withColumn("qid", fails("qid")).write.format("runs").mode("append").save(path)
    assert os.listdir(path) == []
    with pytest.raises(Exception, match="several runs are named run_q_1.json"):
        runs.union(runs.filter("qid = 'q/1'")).write.format("runs").mode("append").save(path)
    assert os.listdir(path) == []
    with pytest.raises(Exception, match="runs lack"):
        runs.drop("result").write.format("runs").mode("append").save(path)


def test_files_that_are_no_runs(spark, runs, tmp_path):
    path = str(tmp_path / "r")
    os.mkdir(path)
    for name, text in {"a.json": "{", "b.json": "[]", "c.json": '{"result": 3}', "d.json": '{"qid": 5, "result": [{"type": "tool_call", "arguments": {"query": "x"}}], "tool_call_counts": {"a": 2, "b": "no"}}', "e.json": "", "f.json": '{"query": 1}', "g.txt": "x"}.items():
        (tmp_path / "r" / name).write_text(text)
    rows = {r["file"]: r for r in read(spark, path).collect()}
    assert sorted(rows) == [f"{x}.json" for x in "abcdef"] and [x for x, r in sorted(rows.items()) if not r["bad"]] == ["d.json"]
    own = rows["d.json"]
    assert own["qid"] == "5" and json.loads(own["result"][0]["arguments"]) == {"query": "x"} and own["tool_call_counts"] == {"a": 2.0}
    with pytest.raises(Exception, match="is no run"):
        read(spark, path, strict="true").collect()
    os.mkdir(str(tmp_path / "none"))
    empty = read(spark, str(tmp_path / "none"))
    assert empty.collect() == [] and empty.columns == spark.createDataFrame([], SCHEMA).columns
