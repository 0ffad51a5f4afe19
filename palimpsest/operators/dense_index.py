"""Dense indexes that hold less, or look at less, than plain cells: product quantisation and a neighbour graph; and indexes by a factory's name."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.corpus import scratch
from ..sources.segments import Segments
from .retrieval import HITS, Cells, DenseSearcher, Searcher, _ranked, best_places, meet_cells, register_searcher, sampled, some_rows, sound

#: Codes that a task looks through at once, each of which parts has its best ranked again.
CODES = 1 << 13

HIT = pa.schema([("qid", pa.string()), ("docid", pa.string()), ("score", pa.float64())])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)


def _exact(pairs: DataFrame, queries: DataFrame, vectors: DataFrame, digits: int = 6) -> DataFrame:
    """(qid, docid, score) of pairs (qid, docid), by both sides' vectors."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = np.einsum("ij,ij->i", _matrix(batch.column("asked")), _matrix(batch.column("embedding")))
                yield pa.record_batch([batch.column("qid"), batch.column("docid"), pa.array(np.round(scores, digits))], schema=HIT)

    both = pairs.select("qid", "docid").join(vectors, "docid").join(queries.select("qid", F.col("embedding").alias("asked")), "qid")
    return both.mapInArrow(score, HITS)


def _codebook(points: np.ndarray, entries: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of the points by k-means."""
    centres = points[rng.choice(len(points), min(entries, len(points)), replace=False)]
    for _ in range(rounds):
        own = _nearest(points, centres)
        total, many = np.zeros_like(centres), np.bincount(own, minlength=len(centres))[:, None]
        np.add.at(total, own, points)
        centres = np.where(many > 0, total / np.maximum(many, 1), centres)
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * points @ centres.T, axis=1)


class Quantised:
    """Vectors as codes of a byte for each of ``parts`` parts, in cells; a search looks scores up in tables and ranks the best again by their vectors.

    A code holds what a vector differs by from its cell's centre. Centres and codebooks (of 256 entries) come from at most ``sample`` vectors
    by k-means on the driver; every vector of the sample's length is coded. A search sums a query's products with the codebooks' entries as the codes say,
    in its ``probes`` nearest cells; of each CODES codes of a cell the best ``rerank`` * k are scored exactly by their vectors, where these are. So what is ranked again
    grows with the index, and its recall doesn't fall; only k hits leave a part.
    """

    def __init__(self, corpus: DataFrame, parts: int = 8, cells: int = 1, probes: int | None = None, rerank: int = 20, sample: int = 20_000, rounds: int = 10, seed: int = 1) -> None:
        points = sampled(corpus, sample)[1]
        if points.shape[1] % parts and len(points):
            raise ValueError(f"{parts} parts don't divide {points.shape[1]} dimensions")
        coarse = Cells(corpus, cells=cells, sample=sample, rounds=rounds, seed=seed, probes=probes or cells, spill=1)
        rng = np.random.default_rng(seed)
        near = np.argmax(points @ coarse.centres.T.astype(np.float32), axis=1) if len(points) else np.zeros(0, int)
        rest = (points - coarse.centres[near] if len(points) else points).astype(np.float64)
        self.books = np.stack([_codebook(x, 256, rounds, rng) for x in np.split(rest, parts, axis=1)]) if len(points) else np.zeros((parts, 0, 1))
        self.coarse, self.rerank = coarse, rerank
        self.codes = self._coded(coarse.index)

    def _coded(self, placed: DataFrame) -> DataFrame:
        centres, books = self.coarse.centres, self.books

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    rest = _matrix(batch.column("embedding")) - centres[batch.column("cell").to_numpy()]
                    codes = np.stack([_nearest(x, b) for x, b in zip(np.split(rest, len(books), axis=1), books, strict=True)], axis=1).astype(np.uint8)
                    yield pa.record_batch([batch.column("docid"), batch.column("cell"), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column("embedding")], names=["docid", "cell", "code", "embedding"])

        return placed.mapInArrow(code, "docid string, cell int, code binary, embedding array<double>")

    def save(self, path: str) -> None:
        """Centres, codebooks, and codes with their vectors (columns that are read by themselves) in a folder for each cell."""
        spark = self.codes.sparkSession
        rows = [("centre", i, 0, [float(x) for x in c]) for i, c in enumerate(self.coarse.centres)] + [("book", p, e, [float(x) for x in c]) for p, b in enumerate(self.books) for e, c in enumerate(b)]
        spark.createDataFrame(rows, "kind string, place int, entry int, x array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/books")
        self.codes.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/codes")

    @classmethod
    def load(cls, spark: SparkSession, path: str, probes: int | None = None, rerank: int = 20) -> Quantised:
        own = cls.__new__(cls)
        rows = spark.read.parquet(f"{path}/books").orderBy("kind", "place", "entry").collect()  # centres and codebooks, whose number the parameters fix
        centres = np.array([r["x"] for r in rows if r["kind"] == "centre"])
        parts = 1 + max((r["place"] for r in rows if r["kind"] == "book"), default=0)
        own.books = np.array([r["x"] for r in rows if r["kind"] == "book"]).reshape(parts, -1, centres.shape[1] // parts)
        own.coarse, own.rerank = Cells.__new__(Cells), rerank
        own.coarse._use(centres, probes or len(centres))
        own.codes = spark.read.schema("docid string, code binary, embedding array<double>, cell int").parquet(f"{path}/codes")
        return own

    def sizes(self) -> DataFrame:
        """(vectors, code_bytes, vector_bytes): how many, and the mean bytes of a code and of its vector's floats."""
        return self.codes.agg(F.count(F.lit(1)).alias("vectors"), F.avg(F.octet_length("code")).alias("code_bytes"), F.avg(4 * F.size("embedding")).alias("vector_bytes"))

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, rerank: int | None = None) -> DataFrame:
        if not self.books.size:
            return _ranked(queries.sparkSession.createDataFrame([], HITS), k)
        queries = sound(queries, "qid", self.coarse.centres.shape[1])
        centres, books, most = self.coarse.centres, self.books, (rerank or self.rerank) * k

        def meet(own: pa.Table, docs: pa.Table) -> pa.Table:
            if not len(own) or not len(docs):
                return HIT.empty_table()
            docs = docs.sort_by("docid")
            asked, vectors, ids = _matrix(own.column("embedding")), _matrix(docs.column("embedding")), np.asarray(docs.column("docid").to_pylist(), object)
            codes = np.frombuffer(b"".join(docs.column("code").to_pylist()), np.uint8).reshape(len(docs), -1)
            qids, centre, out = own.column("qid").to_pylist(), centres[docs.column("cell")[0].as_py()], []
            for some in some_rows(len(asked), len(docs)):
                scores = np.repeat((asked[some] @ centre)[:, None], len(docs), axis=1)
                for p, x in enumerate(np.split(asked[some], len(books), axis=1)):
                    scores += (x @ books[p].T)[:, codes[:, p]]
                near = np.sort(best_places(scores, most), axis=1)
                exact = np.stack([np.round(vectors[at] @ x, 6) for at, x in zip(near, asked[some], strict=True)])
                best = best_places(exact, k)
                found = np.take_along_axis(near, best, 1)
                out.append(pa.table([pa.array(np.repeat(qids[some], best.shape[1])), pa.array(ids[found].ravel()), pa.array(np.take_along_axis(exact, best, 1).ravel())], schema=HIT))
            return pa.concat_tables(out)

        return _ranked(meet_cells(self.codes, self.coarse._placed(queries, "qid", probes or self.coarse.probes), meet, CODES), k)


class Graph:
    """A neighbour graph: every vector's ``degree`` nearest ones, found by joins, and a search that walks it for all queries at once.

    Equal vectors are one node. First neighbours are the nearest of some thousand nodes on the same side of random planes (``planes`` times); then, ``rounds`` times,
    the neighbours of each node, in both directions, are compared with each other, and every node keeps its best (NN-descent). A search holds ``width`` nodes a query; each step expands
    the best ``beam`` of them that were not yet, by a join with the edges, until none is left. It starts at ``entries`` nodes.
    Beyond 2,048 nodes both grow with the square root of the nodes. The graph is approximate: of the edges that lead to a node the best ``degree`` are followed backwards.
    """

    def __init__(self, corpus: DataFrame, degree: int = 16, rounds: int = 3, planes: int = 3, block: int = 512, entries: int = 64, width: int = 128, beam: int = 32, seed: int = 1) -> None:
        self.spark = corpus.sparkSession
        vectors, some = sampled(corpus, entries)
        self.dims, self.width, self.beam = some.shape[1], width, beam
        grouped = self._kept(vectors.groupBy("embedding").agg(F.min("docid").alias("node")).select("node", F.col("embedding").cast("array<double>").alias("embedding")))
        # Of equal vectors any may be asked for; they are found again by their node.
        own = vectors.withColumn("embedding", F.col("embedding").cast("array<double>")).join(grouped, "embedding").select("docid", "node")
        self.nodes, self.members = grouped, self._kept(own)
        n = grouped.count()
        wider = max(1.0, (n / 2048) ** 0.5)  # else the recall falls as the graph grows
        self.width, self.beam = round(width * wider), round(beam * wider)
        rng = np.random.default_rng(seed)
        edges = None
        for r in range(planes):
            normals = rng.normal(size=(max(0, int(n // block).bit_length()), self.dims))
            side = self._sides(normals).withColumn("place", F.concat_ws(" ", F.lit(r), "side", F.col("cut")))
            found = self._nearest(side.select("place", "node", "embedding"), degree)
            edges = found if edges is None else edges.unionByName(found)
        edges = self._kept(self._best(edges, degree))
        for _ in range(rounds):
            near = self._both(edges, degree).join(grouped.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("place"), F.col("b").alias("node"), "embedding")
            edges = self._kept(self._best(edges.unionByName(self._nearest(near, degree // 2)), degree))
        self.edges = self._kept(self._both(edges, degree))
        self.start = grouped.orderBy(F.xxhash64("node", F.lit(seed))).limit(entries).toArrow()

    def _kept(self, df: DataFrame) -> DataFrame:
        path = scratch(self.spark, "graph")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _sides(self, normals: np.ndarray) -> DataFrame:
        """Nodes with the side of each plane that they are on; large sides are cut by a hash."""

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    bits = (_matrix(batch.column("embedding")) @ normals.T > 0) @ (1 << np.arange(len(normals), dtype=np.int64))
                    yield pa.record_batch([batch.column("node"), batch.column("embedding"), pa.array(bits.astype(np.int64))], names=["node", "embedding", "side"])

        placed = self.nodes.mapInArrow(place, "node string, embedding array<double>, side long")
        cuts = placed.groupBy("side").agg(F.expr("cast(count(1) div 2048 + 1 as int)").alias("cuts"))
        return placed.join(cuts, "side").withColumn("cut", F.pmod(F.xxhash64("node"), F.col("cuts")))

    @staticmethod
    def _nearest(places: DataFrame, most: int) -> DataFrame:
        """(a, b, score): of the nodes of one place, each one's nearest ``most``."""
        schema = pa.schema([("a", pa.string()), ("b", pa.string()), ("score", pa.float64())])

        def meet(own: pa.Table) -> pa.Table:
            if len(own) < 2:
                return schema.empty_table()
            x, ids = _matrix(own.column("embedding")), np.asarray(own.column("node").to_pylist(), object)
            scores = x @ x.T
            np.fill_diagonal(scores, -np.inf)
            best = np.argpartition(-scores, min(most, len(ids) - 1) - 1, axis=1)[:, : min(most, len(ids) - 1)]
            return pa.table([pa.array(np.repeat(ids, best.shape[1])), pa.array(ids[best].ravel()), pa.array(np.take_along_axis(scores, best, 1).ravel())], schema=schema)

        return places.groupBy("place").applyInArrow(meet, "a string, b string, score double")

    @staticmethod
    def _best(edges: DataFrame, most: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))
        return edges.groupBy("a", "b").agg(F.max("score").alias("score")).withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")

    def _both(self, edges: DataFrame, degree: int) -> DataFrame:
        back = self._best(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"), degree)
        return edges.unionByName(back).groupBy("a", "b").agg(F.max("score").alias("score"))

    def search(self, queries: DataFrame, k: int = 10, width: int | None = None, steps: int = 40) -> DataFrame:
        """(qid, docid, score, rank). Steps end when no query has a node left to expand, after ``steps`` at the latest."""
        queries = sound(queries, "qid", self.dims)
        if not len(self.start):
            return _ranked(self.spark.createDataFrame([], HITS), k)
        ids, matrix, width = self.start.column("node").to_pylist(), _matrix(self.start.column("embedding")), max(k, width or self.width)

        def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    scores = _matrix(batch.column("embedding")) @ matrix.T
                    yield pa.record_batch([pa.array(np.repeat(batch.column("qid").to_pylist(), len(ids))), pa.array(ids * batch.num_rows), pa.array(scores.ravel())], schema=HIT)

        nodes = self.nodes.withColumnRenamed("node", "docid")
        state = self._kept(queries.mapInArrow(begin, HITS).withColumn("done", F.lit(False)))
        rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "docid"))
        for _ in range(steps):
            front = state.filter("not done").withColumn("rank", rank).filter(F.col("rank") <= self.beam).select("qid", "docid")
            front = self._kept(front)
            reached = front.join(self.edges, front.docid == self.edges.a).select("qid", F.col("b").alias("docid")).distinct()
            found = _exact(reached.join(state.select("qid", "docid"), ["qid", "docid"], "left_anti"), queries, nodes, 12).withColumn("done", F.lit(False))
            ahead = state.join(front.withColumn("now", F.lit(True)), ["qid", "docid"], "left").select("qid", "docid", "score", (F.col("done") | F.coalesce("now", F.lit(False))).alias("done"))
            state = self._kept(ahead.unionByName(found).withColumn("rank", rank).filter(F.col("rank") <= width).drop("rank"))
            if state.filter("not done").isEmpty():
                break
        first = self.members.withColumn("nth", F.row_number().over(Window.partitionBy("node").orderBy("docid"))).filter(F.col("nth") <= k)
        hits = state.select("qid", F.col("docid").alias("node"), F.round("score", 6).alias("score")).join(first, "node").select("qid", "docid", "score")
        return _ranked(hits, k)


class GrowingCells:
    """Cells in a folder that shards are added to: the centres are the first shard's, later ones are dealt to them; ``version`` names an older state."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None) -> None:
        self.spark, self.path = spark, path
        self._use(Segments(spark, path, version))

    def _use(self, segments: Segments) -> GrowingCells:
        self.segments, self.cells = segments, None
        if segments.folders:
            rows = self.spark.read.parquet(f"{self.path}/centres").orderBy("cell").collect()  # one row for each cell
            self.cells = Cells.__new__(Cells)
            self.cells._use(np.array([r["centre"] for r in rows]).reshape(len(rows), -1), 16)
            self.cells.index = segments.read("cells", "docid string, embedding array<double>, cell int")
        return self

    def append(self, corpus: DataFrame, shard: str, cells: int = 32, spill: int = 2, **options) -> GrowingCells:
        """Adds a shard's vectors; those of another length than the first shard's are left out, a shard that is held already changes nothing."""

        def write(folder: str, number: int) -> None:
            if self.cells is None:
                made = Cells(corpus, cells=cells, spill=spill, **options)
                if not len(made.centres):
                    raise ValueError("the first shard has no vectors")
                rows = [(i, [float(x) for x in c]) for i, c in enumerate(made.centres)]
                self.spark.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centres")
                placed = made.index
            else:
                placed = self.cells._placed(sound(corpus, "docid", self.cells.centres.shape[1]), "docid", spill)
            placed.repartition("cell").write.partitionBy("cell").parquet(f"{folder}/cells")

        return self._use(self.segments.append(shard, write))

    def compact(self) -> GrowingCells:
        """All segments written as one."""
        return self._use(self.segments.compact(lambda folder: self.cells.index.repartition("cell").write.partitionBy("cell").parquet(f"{folder}/cells")))

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
        if self.cells is None:
            return _ranked(self.spark.createDataFrame([], HITS), k)
        return self.cells.search(queries, k, probes)


FACTORY = re.compile(r"(?:IVF(?P<cells>[1-9]\d*),)?(?:(?P<flat>FLAT)|PQ(?P<parts>[1-9]\d*))|HNSW(?P<degree>[1-9]\d*)?(?:,FLAT)?")


def index_of(corpus: DataFrame, factory: str, **options) -> Searcher:
    """An index by its factory's name: ``Flat``, ``IVFn,Flat``, ``PQm``, ``IVFn,PQm`` or ``HNSWd``; anything else is refused."""
    got = FACTORY.fullmatch(factory.upper().replace(" ", ""))
    if not got:
        raise ValueError(f"unknown factory {factory}")
    if got["parts"]:
        return Quantised(corpus, parts=int(got["parts"]), cells=int(got["cells"] or 1), **options)
    if got["flat"]:
        return Cells(corpus, cells=int(got["cells"]), **options) if got["cells"] else DenseSearcher(corpus)
    return Graph(corpus, **({"degree": int(got["degree"])} if got["degree"] else {}), **options)


register_searcher("quantised", Quantised)
register_searcher("graph", Graph)
