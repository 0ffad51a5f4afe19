"""Codes, the neighbour graph and the index that grows, against all products."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.operators import dense_index as D
from palimpsest.operators import retrieval as R


def unit(n, dims, seed):
    v = np.random.default_rng(seed).normal(size=(n, dims))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def corpus_of(spark, vectors, first=0):
    return spark.createDataFrame([(str(first + i), [float(x) for x in v]) for i, v in enumerate(vectors)], "docid string, embedding array<double>")


def key(df):
    return sorted((r["qid"], r["rank"], r["docid"], r["score"]) for r in df.collect())


@pytest.fixture(scope="module")
def made(spark):
    corpus = corpus_of(spark, unit(900, 16, 1))
    odd = spark.createDataFrame([("none", None), ("empty", []), ("short", [1.0] * 3), ("null", [None] * 16), ("nan", [float("nan")] * 16)], corpus.schema)
    asked = corpus_of(spark, unit(30, 16, 2)).withColumnRenamed("docid", "qid")
    return corpus, odd, asked


def test_codes_are_found_saved_and_small(spark, made, tmp_path):
    corpus, odd, asked = made
    exact = R.dense_topk(asked, corpus)
    own = D.Quantised(corpus.union(odd), parts=4, cells=3)
    assert R.recall(own.search(asked), exact).first()["recall"] >= 0.9
    assert key(own.search(asked, rerank=90)) == key(exact)  # every vector is ranked again
    own.save(str(tmp_path / "q"))
    assert key(D.Quantised.load(spark, str(tmp_path / "q")).search(asked)) == key(own.search(asked))
    assert tuple(own.sizes().first()) == (900, 4.0, 64.0)
    assert D.Quantised(corpus.limit(0)).search(asked).collect() == []
    with pytest.raises(ValueError, match="don't divide"):
        D.Quantised(corpus, parts=5)


def test_graph_finds_the_nearest_and_equal_vectors(spark, made):
    corpus, odd, asked = made
    same = corpus_of(spark, [[1.0] + [0.0] * 15] * 300, 5000)  # a vector that a fourth of the rows repeat
    own = D.Graph(corpus.union(odd).union(same), degree=12, rounds=2, width=96)
    exact = R.dense_topk(asked, corpus.union(same))
    assert R.recall(own.search(asked), exact).first()["recall"] >= 0.9
    assert own.edges.groupBy("a").count().agg({"count": "max"}).first()[0] <= 24
    only = same.limit(1).selectExpr("'q' as qid", "embedding")
    assert [r["docid"] for r in own.search(only, 3).orderBy("rank").collect()] == ["5000", "5001", "5002"]
    assert D.Graph(corpus.limit(0)).search(asked).collect() == []
    assert [r["docid"] for r in D.Graph(corpus.filter("docid = '7'")).search(asked.limit(1)).collect()] == ["7"]


def test_factories(spark, made):
    corpus, _, _ = made
    assert isinstance(D.index_of(corpus, "flat"), R.DenseSearcher)
    assert len(D.index_of(corpus, "IVF5,Flat").centres) == 5
    coded = D.index_of(corpus, "IVF4,PQ8")
    assert len(coded.coarse.centres) == 4 and len(coded.books) == 8
    for wrong in ("IVF4", "PQ", "IVF4,SQ8", "OPQ8,PQ8", "PQ8x4", "IVF0,Flat", "IVF4,PQ8,Flat", "LSH", ""):
        with pytest.raises(ValueError):
            D.index_of(corpus, wrong)


def test_index_of_shards_equals_the_index_of_both(spark, made, tmp_path):
    corpus, odd, asked = made
    first, second = corpus.filter("docid < '5'"), corpus.filter("docid >= '5'").union(odd)
    path = str(tmp_path / "g")
    assert D.GrowingCells(spark, path).search(asked).collect() == []
    own = D.GrowingCells(spark, path).append(first, "a", cells=8)
    assert key(own.search(asked, probes=8)) == key(R.dense_topk(asked, first))
    own = own.append(second, "b").append(second, "b")
    both = key(R.dense_topk(asked, corpus))
    assert own.segments.shards == ["a", "b"] and key(own.search(asked, probes=8)) == both
    assert key(own.search(asked, probes=2)) == key(D.GrowingCells(spark, path).compact().search(asked, probes=2))
    assert key(D.GrowingCells(spark, path).search(asked, probes=8)) == both
    assert key(D.GrowingCells(spark, path, version=1).search(asked, probes=8)) == key(R.dense_topk(asked, first))


def test_vectors_of_several_lengths_do_not_meet(spark):
    nan = float("nan")
    rows = [("a", [1.0, 2.0, 3.0]), ("b", [1.0] * 5), ("c", [2.0] * 4), ("d", [1.0, None, 1.0, 1.0]), ("e", [nan] * 4), ("f", []), ("g", None), ("h", [-1.0] * 4)]
    corpus = spark.createDataFrame(rows, "docid string, embedding array<double>")
    asked = spark.createDataFrame([("x", [1.0] * 4), ("y", [1.0, 0.0, 0.0]), ("z", [1.0] * 7), ("n", [None] * 4)], "qid string, embedding array<double>")
    assert key(R.dense_topk(asked, corpus)) == [("x", 1, "c", 8.0), ("x", 2, "h", -4.0), ("y", 1, "a", 1.0)]
    assert R.dense_topk(asked.limit(0), corpus).collect() == [] and R.dense_topk(asked, corpus.limit(0)).collect() == []


def peak_of(run):
    tracemalloc.start()
    try:
        out = run()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def vectors_of(vectors):
    return pa.array(list(vectors), pa.list_(pa.float64()))


def test_many_queries_are_scored_a_few_at_a_time():
    asked, docs = unit(9000, 4, 3), unit(2000, 4, 4)
    batch = pa.record_batch([pa.array([str(i) for i in range(2000)]), vectors_of(docs)], names=["docid", "embedding"])
    found, peak = peak_of(lambda: list(R._scorer([str(i) for i in range(9000)], asked, 5, 6)(iter([batch]))))
    assert peak < 100 << 20  # all scores are 144 MB, their order as much again
    rows = {}
    for b in found:
        for q, d, s in zip(*[c.to_pylist() for c in b.columns], strict=True):
            rows.setdefault(q, []).append((-s, d))
    assert len(rows) == 9000
    for q in (0, 4500, 8999):
        every = sorted((-s, str(i)) for i, s in enumerate(np.round(docs @ asked[q], 6)))
        assert sorted(rows[str(q)]) == every[:5]


def test_best_places_are_those_of_a_stable_order():
    scores = np.random.default_rng(5).integers(0, 6, (50, 40)).astype(float)
    for k in (1, 7, 39, 40, 99):
        assert (R.best_places(scores, k) == np.argsort(-scores, axis=1, kind="stable")[:, :k]).all()


def test_codes_of_many_queries_are_looked_up_a_few_at_a_time(spark, made, monkeypatch):
    corpus, _, asked = made
    own, taken = D.Quantised(corpus, parts=4), []
    monkeypatch.setattr(D, "meet_cells", lambda codes, placed, meet, *rest: taken.append(meet) or spark.createDataFrame([], R.HITS))
    own.search(asked)
    rng = np.random.default_rng(6)
    docs = pa.table({"docid": [str(i) for i in range(3000)], "cell": pa.array([0] * 3000, pa.int32()), "code": [rng.bytes(4) for _ in range(3000)], "embedding": vectors_of(unit(3000, 16, 7))})
    many = pa.table({"qid": [str(i) for i in range(6000)], "embedding": vectors_of(unit(6000, 16, 8)), "cell": pa.array([0] * 6000, pa.int32())})
    found, peak = peak_of(lambda: taken[0](many, docs))
    assert len(set(found.column("qid").to_pylist())) == 6000 and peak < 120 << 20  # all scores are 144 MB, their order as much again


def test_recall_does_not_fall_as_the_index_grows(spark):
    rng = np.random.default_rng(9)
    centres = unit(10, 64, 10)
    vectors = centres[rng.integers(0, 10, 24_000)] * 0.5 + rng.normal(size=(24_000, 64)) * 0.12
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    corpus = spark.createDataFrame(pa.table({"docid": [str(i) for i in range(24_000)], "embedding": vectors_of(vectors)}))
    asked = corpus.filter("docid % 600 = 0").withColumnRenamed("docid", "qid")
    own = D.index_of(corpus, "IVF2,PQ8")
    assert R.recall(own.search(asked), R.dense_topk(asked, corpus)).first()["recall"] >= 0.9


def test_a_larger_graph_is_searched_wider(spark):
    corpus = spark.createDataFrame(pa.table({"docid": [str(i) for i in range(8192)], "embedding": vectors_of(unit(8192, 8, 11))}))
    own = D.Graph(corpus, degree=2, rounds=0, planes=1)
    assert (own.width, own.beam) == (256, 64)
