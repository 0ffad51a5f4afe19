"""Scored retrieval: dense top-k exact and by cells, BM25, and document lookup."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import truncate, word_set
from .encoding import REASONING_INSTRUCTION, Encoder, encode

#: Queries in a block: its matrix is what goes to all tasks at once. Below PLAIN pairs of scores a plain join is used.
BLOCK = 4096
#: Documents of one cell that a task holds.
PART = 1 << 15
#: Queries of one cell that a task holds.
ASKED = 1 << 13
#: Scores (of some queries with a batch's documents) that a task holds at once.
AT_ONCE = 1 << 20
K1, B = 0.9, 0.4
HITS = "qid string, docid string, score double"


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    """Best k of each query, ties by docid; partial limits run before the exchange."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "docid"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k)


def sound(df: DataFrame, key: str, dims: int | None = None) -> DataFrame:
    """(key as text, embedding) of the rows that have a key and a vector (of ``dims`` components) without nulls, NaN and infinities."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fits = F.size("embedding") > 0 if dims is None else F.size("embedding") == dims
    return df.filter(F.col(key).isNotNull() & fits & ~bad).select(F.col(key).cast("string").alias(key), "embedding")


def best_places(scores: np.ndarray, k: int) -> np.ndarray:
    """Of each row the places of its k greatest scores, greatest first, ties to the first place."""
    n = scores.shape[1]
    if k >= n or np.isnan(scores).any():
        return np.argsort(-scores, axis=1, kind="stable")[:, :k]
    floor = np.partition(scores, n - k, axis=1)[:, n - k, None]
    over, ties = scores > floor, scores == floor
    over |= ties & (np.cumsum(ties, axis=1, dtype=np.int32) <= k - over.sum(axis=1, keepdims=True))
    found = np.nonzero(over)[1].reshape(-1, k)
    order = np.argsort(-np.take_along_axis(scores, found, 1), axis=1, kind="stable")
    return np.take_along_axis(found, order, 1)


def some_rows(rows: int, columns: int) -> Iterator[slice]:
    """Slices of a matrix's rows of AT_ONCE scores each."""
    step = max(1, AT_ONCE // max(columns, 1))
    return (slice(lo, lo + step) for lo in range(0, rows, step))


def _scorer(ids: list, matrix: np.ndarray, k: int, digits: int):
    """Scores the rows whose vectors are as long as the matrix's, for some of the queries at a time."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.equal(pc.list_value_length(batch.column("embedding")), matrix.shape[1]))
            if not batch.num_rows:
                continue
            docs = np.asarray(batch.column("docid").to_pylist(), object)
            order = np.argsort(docs)
            docs, vectors = docs[order], np.asarray(batch.column("embedding").flatten()).astype(np.float64).reshape(len(docs), -1)[order]
            for some in some_rows(len(matrix), len(docs)):
                scores = np.round(matrix[some] @ vectors.T, digits)
                best = best_places(scores, k)
                yield pa.record_batch([pa.array(np.repeat(ids[some], best.shape[1])), pa.array(docs[best].ravel()), pa.array(np.take_along_axis(scores, best, 1).ravel())], names=["qid", "docid", "score"])

    return score


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int = 10, block: int = BLOCK, digits: int = 6) -> DataFrame:
    """(qid, docid, score, rank): the k greatest inner products, in doubles rounded to ``digits``.

    ``queries`` (qid, embedding) are the stated set; they go in blocks of at most ``block`` as a matrix to one pass
    over ``corpus`` (docid, embedding) each, whose batches are multiplied at once and cut to k before the exchange.
    Rows with a null or empty vector, or one with a null or non-finite component, take no part; a query meets the documents whose vectors are
    as long as its own. With fewer than k of them there are fewer hits.
    """
    queries, corpus = sound(queries, "qid"), sound(corpus, "docid")
    blocks, out = queries.count() // block + 1, None
    for b in range(blocks):
        own = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)
        got = own.toArrow()
        if not len(got):
            continue
        sizes = np.asarray(pc.list_value_length(got.column("embedding")))
        for size in np.unique(sizes):
            some = got.filter(pa.array(sizes == size))
            matrix = np.array(some.column("embedding").to_pylist(), np.float64)
            part = corpus.mapInArrow(_scorer(some.column("qid").to_pylist(), matrix, k, digits), HITS)
            out = part if out is None else out.union(part)
    return _ranked(corpus.sparkSession.createDataFrame([], HITS) if out is None else out, k)


def sampled(corpus: DataFrame, sample: int) -> tuple[DataFrame, np.ndarray]:
    """The sound vectors of one length, and at most ``sample`` of them as a matrix."""
    some = sound(corpus, "docid").orderBy(F.xxhash64("docid")).limit(sample).select("embedding").toArrow()
    dims = len(some.column(0)[0]) if some.num_rows else 1
    points = np.array([x for x in some.column(0).to_pylist() if len(x) == dims], np.float32).reshape(-1, dims)
    return sound(corpus, "docid", dims), points


class Cells:
    """An inverted file: vectors in the cells of their ``spill`` nearest centres, found in each query's ``probes`` nearest cells.

    Centres come from at most ``sample`` vectors by k-means on the driver, in float32; every vector is indexed. More probes find more; all of them make the search exact.
    Vectors are as long as the first of the sample; others, and those with a null or non-finite component, are in no index.
    """

    def __init__(self, corpus: DataFrame, cells: int = 32, sample: int = 20_000, rounds: int = 10, seed: int = 1, probes: int = 16, spill: int = 2) -> None:
        vectors, points = sampled(corpus, sample)
        rng = np.random.default_rng(seed)
        centres = points[rng.choice(len(points), min(cells, len(points)), replace=False)]
        for _ in range(rounds if len(points) else 0):
            own = np.argmax(points @ centres.T, axis=1)
            total = np.zeros_like(centres)
            np.add.at(total, own, points)
            many = np.bincount(own, minlength=len(centres))[:, None]
            centres = np.where(many > 0, total / np.maximum(many, 1), centres)
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        self._use(centres.astype(np.float64), probes)
        self.index = self._placed(vectors, "docid", spill)

    def _use(self, centres: np.ndarray, probes: int) -> None:
        self.centres, self.probes = centres, probes

    def save(self, path: str) -> None:
        """The index as tables: the centres, and the vectors in a folder for each cell. A search reads its cells only."""
        spark = self.index.sparkSession
        spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(self.centres)], "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
        self.index.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")

    @classmethod
    def load(cls, spark: SparkSession, path: str, probes: int | None = None) -> Cells:
        """A saved index; ``probes`` overrides how many cells a query looks into."""
        own = cls.__new__(cls)
        rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # one row for each cell
        own._use(np.array([r["centre"] for r in rows], np.float64).reshape(len(rows), -1), probes or 16)
        own.index = spark.read.schema("docid string, embedding array<double>, cell int").parquet(f"{path}/cells")
        return own

    def _placed(self, df: DataFrame, key: str, probes: int) -> DataFrame:
        centres = self.centres

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows and len(centres):
                    x = np.asarray(batch.column("embedding").flatten()).astype(np.float64).reshape(batch.num_rows, -1)
                    near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :probes]
                    again = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
                    yield pa.record_batch([batch.column(key).take(again), batch.column("embedding").cast(pa.list_(pa.float64())).take(again), pa.array(near.ravel().astype(np.int32))], names=[key, "embedding", "cell"])

        return df.select(F.col(key).cast("string").alias(key), "embedding").mapInArrow(place, f"{key} string, embedding array<double>, cell int")

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
        """Top k among the documents in each query's nearest cells; a cell's queries and documents are multiplied as matrices."""
        asked = self._placed(sound(queries, "qid", self.centres.shape[1]), "qid", probes or self.probes)
        schema = pa.schema([("qid", pa.string()), ("docid", pa.string()), ("score", pa.float64())])

        def meet(own: pa.Table, docs: pa.Table) -> pa.Table:
            if not len(own) or not len(docs):
                return schema.empty_table()
            matrix = np.asarray(own.column("embedding").combine_chunks().flatten()).reshape(len(own), -1)
            (batch,) = docs.select(["docid", "embedding"]).combine_chunks().to_batches()
            return pa.Table.from_batches([b.cast(schema) for b in _scorer(own.column("qid").to_pylist(), matrix, k, 6)(iter([batch]))], schema)

        return _ranked(meet_cells(self.index, asked, meet).groupBy("qid", "docid").agg(F.max("score").alias("score")), k)


def meet_cells(index: DataFrame, asked: DataFrame, meet: Callable[[pa.Table, pa.Table], pa.Table], part: int = PART) -> DataFrame:
    """Hits of each cell's queries among its documents.

    A cell is dealt into parts of some thousand documents, so a large one is not one task's; its queries go to each part, in blocks of some thousand.
    """
    counts = index.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).select("cell", F.expr(f"cast(n div {part} + 1 as int)").alias("parts"))
    many = asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).select("cell", F.expr(f"cast(n div {ASKED} + 1 as int)").alias("blocks"))
    dealt = lambda key, parts: F.pmod(F.xxhash64(key), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    counts = counts.join(many, "cell")
    docs = index.join(counts, "cell").withColumn("part", dealt("docid", "parts")).withColumn("block", every("blocks")).drop("parts", "blocks")
    asked = asked.join(counts, "cell").withColumn("part", every("parts")).withColumn("block", dealt("qid", "blocks")).drop("parts", "blocks")
    return asked.groupBy("cell", "part", "block").cogroup(docs.groupBy("cell", "part", "block")).applyInArrow(meet, HITS)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, recall): the share of the exact hits that were found."""
    both = exact.select("qid", "docid").join(found.select("qid", "docid", F.lit(1).alias("hit")), ["qid", "docid"], "left")
    return both.agg(F.countDistinct("qid").alias("queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def terms(docs: DataFrame) -> DataFrame:
    """(docid, term, tf) of (docid, text): runs of a-z and 0-9 of the lower-cased text."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return docs.select("docid", F.explode(words).alias("term")).groupBy("docid", "term").agg(F.count(F.lit(1)).alias("tf"))


def lengths(docs: DataFrame) -> DataFrame:
    return docs.select("docid", F.regexp_count(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]+")).cast("bigint").alias("len"))


def bm25_stats(docs: DataFrame) -> DataFrame:
    """(n_docs, total_len, n_terms): the index's size; fails unless all documents were indexed."""
    counts = lengths(docs).agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("len"), F.lit(0)).alias("total_len"))
    distinct = docs.select(F.explode(word_set("text")).alias("term")).distinct().agg(F.count(F.lit(1)).alias("n_terms"))
    there = docs.agg(F.count(F.lit(1)).alias("there"))
    both = counts.crossJoin(distinct).crossJoin(there)
    checked = F.when(F.col("n_docs") == F.col("there"), F.col("n_docs")).otherwise(F.raise_error(F.lit("not all documents were indexed")))
    return both.select(checked.cast("bigint").alias("n_docs"), "total_len", "n_terms")


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int = 10, k1: float = K1, b: float = B, digits: int = 6) -> DataFrame:
    """(qid, docid, score, rank) for queries (qid, text) by BM25 with idf ln(1 + (N - df + 0.5) / (df + 0.5)).

    Only the queries' terms are kept of the documents, before anything is shuffled by document. The queries' terms with their idf go to all tasks;
    a document's postings meet them in one task, so what a query and a document share is added up there and only each task's best k are shuffled.
    """
    asked = queries.select(F.col("qid").cast("string").alias("qid"), F.explode(word_set("text")).alias("term"))
    wanted = asked.select("term").distinct()
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    cut = docs.select("docid", words.alias("words")).withColumn("len", F.size("words"))  # else the length is taken anew for each word
    postings = cut.select("docid", "len", F.explode("words").alias("term")).join(wanted, "term", "left_semi").groupBy("docid", "term", "len").agg(F.count(F.lit(1)).alias("tf"))
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    sizes = lengths(docs).agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"))
    weight = df.crossJoin(F.broadcast(sizes)).select("term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avg")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    dealt = postings.select(F.col("docid").cast("string").alias("docid"), "term", "len", "tf").repartition("docid")
    hits = dealt.join(F.broadcast(asked.join(weight, "term")), "term").groupBy("qid", "docid").agg(F.round(F.sum(part), digits).alias("score"))
    return _ranked(hits, k)


def get_documents(asked: DataFrame, corpus: DataFrame) -> DataFrame:
    """(docid, text) for the docids of ``asked``; an unknown one has a null text."""
    return asked.select(F.col("docid").cast("string").alias("docid")).join(corpus.select("docid", "text"), "docid", "left")


def document_view(asked: DataFrame, corpus: DataFrame, n: int = 512) -> DataFrame:
    """(docid, view): what an agent is shown of a document."""
    view = F.when(F.col("text").isNull(), F.concat(F.lit("Document not found: "), F.col("docid"))).otherwise(truncate("text", n))
    return get_documents(asked, corpus).select("docid", view.alias("view"))


class Searcher(Protocol):
    """Anything that turns queries into hits (qid, docid, score, rank)."""

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame: ...


class DenseSearcher:
    def __init__(self, corpus: DataFrame) -> None:
        self.corpus = corpus

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return dense_topk(queries, self.corpus, k)


class BM25Searcher:
    def __init__(self, corpus: DataFrame) -> None:
        self.corpus = corpus

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return bm25_topk(queries, self.corpus, k)


class InstructedSearcher:
    """Dense search where the encoder always reads the same instruction before a query's text."""

    def __init__(self, corpus: DataFrame, encoder: Encoder, instruction: str = REASONING_INSTRUCTION) -> None:
        self.corpus, self.encoder, self.instruction = corpus, encoder, instruction

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return dense_topk(encode(queries, self.encoder, self.instruction, key="qid"), self.corpus, k)


SEARCHERS: dict[str, Callable[..., Searcher]] = {"dense": DenseSearcher, "bm25": BM25Searcher, "cells": Cells, "instructed": InstructedSearcher}


def register_searcher(name: str, make: Callable[..., Searcher]) -> None:
    """An own kind of searcher: ``make(corpus, **options)``; a name in use is replaced."""
    SEARCHERS[name] = make


def searcher(name: str, corpus: DataFrame, **options) -> Searcher:
    if name not in SEARCHERS:
        raise ValueError(f"unknown searcher {name}; there are {', '.join(SEARCHERS)}")
    return SEARCHERS[name](corpus, **options)
