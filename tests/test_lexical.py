"""The lexical index against scoring every document, and its versions."""

import random

import pytest
from oracle import SF
from pyspark.sql import functions as F

from palimpsest.operators import lexical
from palimpsest.operators.retrieval import bm25_topk
from palimpsest.sources.segments import Segments

WORDS = [f"w{i}" for i in range(200)]


def made(spark, n, seed):
    rng = random.Random(seed)
    text = lambda: " ".join(rng.choice(WORDS[: 1 + int(200 * rng.random() ** 3)]) for _ in range(rng.choice([0, 3, 10, 60, 400])))
    docs = spark.createDataFrame([(str(i), text() if i % 31 else None) for i in range(n)], "docid string, text string")
    asked = spark.createDataFrame([(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 12)))) for i in range(20)] + [(90, ""), (91, None), (92, "unknown words")], "qid long, text string")
    return docs, asked


def rows(df):
    return sorted((r["qid"], r["rank"], r["docid"], round(r["score"], 5)) for r in df.collect())


@pytest.mark.parametrize("size,k", [(8, 3), (4096, 500)])
def test_search_equals_scoring_everything(spark, tmp_path, size, k):
    docs, asked = made(spark, 300, size)
    index = lexical.LexicalIndex(spark, str(tmp_path / "i")).append(docs, size=size)
    assert rows(index.search(asked, k)) == rows(bm25_topk(asked, docs, k))


def test_pruning_reads_fewer_postings(spark, tmp_path):
    docs, asked = made(spark, 1500, 5)
    index = lexical.LexicalIndex(spark, str(tmp_path / "i")).append(docs, size=16)
    read = {r["step"]: r["n"] for r in index.reads(asked, 3).collect()}
    assert sum(n for s, n in read.items() if s.startswith("step")) < 0.75 * read["postings"]
    assert rows(index.search(asked, 3)) == rows(bm25_topk(asked, docs, 3))


def test_index_of_shards_equals_the_index_of_all(spark, tmp_path):
    docs, asked = made(spark, 300, 9)
    first, second = docs.filter("docid < '2'"), docs.filter("docid >= '2'")
    index = lexical.LexicalIndex(spark, str(tmp_path / "i")).append(first, "a", 32)
    index = index.append(second, "b", 32).append(first, "a", 32)  # a shard that is there changes nothing
    assert index.segments.shards == ["a", "b"] and index.segments.version == 2
    want = rows(bm25_topk(asked, docs))
    assert rows(index.search(asked)) == want
    one = index.compact()
    assert one.segments.version == 3 and len(one.segments.folders) == 1 and one.segments.shards == ["a", "b"]
    assert rows(one.search(asked)) == want and one.compact().segments.version == 3
    assert rows(bm25_topk(asked, first)) == rows(lexical.LexicalIndex(spark, str(tmp_path / "i"), version=1).search(asked))


def test_a_cut_index_is_found_out(spark, tmp_path):
    docs, _ = made(spark, 100, 3)
    own, postings = lexical.documents(docs), lexical.blocks(docs)
    assert lexical.check_count(own, postings, docs) == 100
    with pytest.raises(ValueError, match="99 of 100 documents"):
        lexical.check_count(own.filter("docid <> '7'"), postings, docs)
    with pytest.raises(ValueError, match="words were indexed"):
        lexical.check_count(own, postings.filter("term <> 'w1'"), docs)


def test_a_failed_writer_adds_nothing(spark, tmp_path, monkeypatch):
    docs, asked = made(spark, 60, 4)
    index = lexical.LexicalIndex(spark, str(tmp_path / "i")).append(docs, "a")
    monkeypatch.setattr(lexical, "check_count", lambda *a: (_ for _ in ()).throw(ValueError("lost")))
    with pytest.raises(ValueError, match="lost"):
        index.append(docs, "b")
    assert Segments(spark, str(tmp_path / "i")).shards == ["a"]
    assert rows(lexical.LexicalIndex(spark, str(tmp_path / "i")).search(asked)) == rows(bm25_topk(asked, docs))


def test_an_empty_index(spark, tmp_path):
    asked = spark.createDataFrame([(1, "a b")], "qid long, text string")
    index = lexical.LexicalIndex(spark, str(tmp_path / "i"))
    assert index.search(asked).collect() == []
    index = index.append(spark.createDataFrame([("1", None), (None, "a")], "docid string, text string"))
    assert index.search(asked).collect() == [] and index.stats().first()["n_docs"] == 1
    empty = index.append(spark.createDataFrame([], "docid string, text string"), "none")
    assert empty.search(asked.limit(0)).collect() == []


def test_query_reads_the_saved_index(spark):
    from palimpsest.catalog_io import _lexical

    items, docs, index = _lexical(spark, SF)
    assert index.segments.shards == ["odd", "even"]
    assert rows(index.search(items.filter(F.col("qid") < 5))) == rows(bm25_topk(items.filter(F.col("qid") < 5), docs))


def test_scores_are_added_up_before_anything_is_shuffled_by_question(spark):
    from palimpsest.operators import retrieval

    docs = spark.createDataFrame([(str(i), f"a b c{i % 3} d{i}") for i in range(50)], "docid string, text string")
    hits = retrieval.bm25_topk(spark.createDataFrame([(1, "a c1"), (2, "b d7")], "qid int, text string"), docs, 3)
    assert hits.count() == 6
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(qid" in plan and "docid" not in "".join(x.split(")")[0] for x in plan.split("hashpartitioning(qid")[1:])
