import json

import pytest

from palimpsest.sources import corpus as io


def test_corpus_skips_blank_lines_and_keeps_the_last_of_a_docid(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"docid": "1", "text": "a"}\n\n{"docid": "1", "text": "b"}\n{"docid": "2", "text": "é"}\n')
    assert {r["docid"]: r["text"] for r in io.read_corpus(spark, str(tmp_path)).collect()} == {"1": "b", "2": "é"}
    only = spark.createDataFrame([("2",)], "docid string")
    assert io.read_corpus(spark, str(tmp_path), only).count() == 1


def test_rename_needs_both_columns(spark):
    assert io.rename_corpus(spark.createDataFrame([(1, "x")], "id long, contents string")).first().asDict() == {"docid": "1", "text": "x"}
    with pytest.raises(ValueError):
        io.rename_corpus(spark.createDataFrame([(1,)], "id long"))


def test_trajectories_mark_bad_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"query_id": "q", "result": [{"type": "tool_call", "arguments": {"docid": 1}}], "tool_call_counts": {"search": 2}}))
    (tmp_path / "b.json").write_text('{"query_id": "q2"}')
    (tmp_path / "c.json").write_text('{"query_id": ')
    rows = {r["file"]: r for r in io.read_trajectories(spark, str(tmp_path)).collect()}
    assert [rows[f]["bad"] for f in ("a.json", "b.json", "c.json")] == [False, True, True]
    assert rows["a.json"]["result"][0]["arguments"] == '{"docid": 1}'


def test_tables_of_questions(spark, tmp_path):
    (tmp_path / "q.tsv").write_text('1\t"a\tb"\n2\n3\t c \n')
    assert {r["qid"]: r["question"] for r in io.read_questions(spark, str(tmp_path / "q.tsv")).collect()} == {"1": "a\tb", "3": "c"}
    (tmp_path / "g.tsv").write_text('1\t"q\tx"\n1\tq\ty \n2\tz\n')
    assert {r["qid"]: r["answer"] for r in io.read_ground_truth(spark, str(tmp_path / "g.tsv")).collect()} == {"1": "y"}


def test_qrels_have_four_fields(spark, tmp_path):
    (tmp_path / "q.txt").write_text("1 0 d1 1\n1  0 d2 1\n\n")
    assert {r["docid"] for r in io.read_qrels(spark, str(tmp_path / "q.txt")).collect()} == {"d1", "d2"}
    (tmp_path / "bad.txt").write_text("1 0 d1\n")
    with pytest.raises(Exception, match="four fields"):
        io.read_qrels(spark, str(tmp_path / "bad.txt")).collect()


def test_stamp_and_groups_round_trip(spark, tmp_path):
    io.write_stamp(spark, {"pooling": "mean"}, str(tmp_path / "stamp"))
    assert io.read_stamp(spark, str(tmp_path / "stamp")) == {"pooling": "mean"} and io.read_stamp(spark, str(tmp_path / "none")) is None
    io.write_groups(spark.createDataFrame([("q", ["p"], 1.0)], "query string, pos_id array<string>, reweight_rate double"), str(tmp_path / "g"))
    (line,) = [x for part in (tmp_path / "g").glob("part-*.json") for x in part.read_text().splitlines()]  # an empty task's part has none
    assert list(json.loads(line)) == ["query", "pos_id", "reweight_rate"]


def test_embeddings_of_another_length_are_skipped(spark, tmp_path):
    spark.createDataFrame([("1", [1.0, 2.0]), ("2", [1.0]), ("3", None)], "docid string, embedding array<float>").write.parquet(str(tmp_path / "e"))
    assert io.read_embeddings(spark, str(tmp_path / "e"), 2).count() == 1
    with pytest.raises(ValueError):
        io.read_embeddings(spark, str(tmp_path / "e"), 5)
