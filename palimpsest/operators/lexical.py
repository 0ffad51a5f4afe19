"""A lexical index: postings in blocks with bounds, saved, added to, and searched by what can still matter.

Documents are dealt into ranges of about SIZE, documents of like length together. A block holds a term's postings in one range, with its greatest
frequency and its shortest document, which bound the term's part of any score in it, whatever else the index gets later. A search

1. adds up the bounds of each query's terms in each range, and scores the most promising ranges whole: the k-th best score found is a floor;
2. drops ranges whose sum is below the floor. In the others it reads the blocks of the essential terms alone: without these, the bounds of the
   rest don't reach the floor (MaxScore);
3. keeps documents whose score so far and the rest's bounds reach the floor, which rises with the scores; reads the next terms' blocks in the ranges of
   those, tier by tier, until all terms are read.

The answer is that of scoring everything. Common terms have low bounds and long postings, so it is mostly these that aren't read.

A range's documents are shuffled once; counting the terms of a document and gathering the postings of a range both use that partitioning. The index is written in
SLICES folders by term, of which a search of few terms reads some.

Documents without an id are not indexed; a repeated id is two documents. A null text has no words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import word_set
from ..sources.corpus import scratch
from ..sources.segments import Segments

SIZE, SLICES = 1024, 16
K1, B = 0.9, 0.4
#: Ranges of a query that are scored whole to find its floor, and what scores that differ by rounding alone may lack of it.
FIRST, SLACK = 2, 1e-5
#: Shares of the floor at which a query's terms, by rising bounds, are cut into tiers.
TIERS = (1.0, 0.6, 0.3)
DOCUMENTS = "range bigint, nth int, docid string, len int"
POSTINGS = "term string, range bigint, n int, most_tf int, least_len int, postings array<struct<nth:int,tf:int,len:int>>, slice int"


def _words(text: str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def _dealt(corpus: DataFrame, number: int, size: int) -> DataFrame:
    """The corpus with a range: documents of a class of lengths, and of a hash within it."""
    docs = corpus.filter("docid is not null").select(F.col("docid").cast("string").alias("docid"), "text")
    kind = F.floor(4 * F.log2(1.0 + F.coalesce(F.octet_length("text"), F.lit(0)))).cast("int")
    docs = docs.withColumn("kind", kind)
    slots = docs.groupBy("kind").agg(F.expr(f"cast(count(1) div {size} + 1 as int)").alias("slots"))  # some hundred classes at most
    place = F.expr(f"shiftleft({number}L, 40) + shiftleft(cast(kind as bigint), 32) + pmod(xxhash64(docid), slots)")
    return docs.join(F.broadcast(slots), "kind").select(place.alias("range"), "docid", "text")


def _numbered(dealt: DataFrame, *columns: Column) -> DataFrame:
    order = Window.partitionBy("range").orderBy("docid", F.xxhash64("text"))
    return dealt.withColumn("nth", F.row_number().over(order).cast("int") - 1).select("range", "nth", *columns)


def documents(corpus: DataFrame, number: int = 0, size: int = SIZE) -> DataFrame:
    return _numbered(_dealt(corpus, number, size), F.col("docid"), F.size(_words("text")).alias("len"))


def blocks(corpus: DataFrame, number: int = 0, size: int = SIZE) -> DataFrame:
    """The postings of each term in each range, by document."""
    cut = _numbered(_dealt(corpus, number, size), _words("text").alias("words"))
    counted = cut.select("range", "nth", F.size("words").alias("len"), F.explode("words").alias("term")).groupBy("range", "nth", "len", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    got = counted.groupBy("range", "term").agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.max("tf").alias("most_tf"), F.min("len").alias("least_len"), F.sort_array(F.collect_list(F.struct("nth", "tf", "len"))).alias("postings")
    )
    return got.select("term", "range", "n", "most_tf", "least_len", "postings", F.pmod(F.xxhash64("term"), F.lit(SLICES)).cast("int").alias("slice"))


def _write(docs: DataFrame, postings: DataFrame, folder: str) -> None:
    docs.write.parquet(f"{folder}/documents")
    postings.repartition("slice", F.col("range") % 64).sortWithinPartitions("slice", "term", "range").write.partitionBy("slice").parquet(f"{folder}/postings")


class LexicalIndex:
    """The index that a folder holds; ``version`` names an older one."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None) -> None:
        self.spark, self.path = spark, path
        self._use(Segments(spark, path, version))

    def _use(self, segments: Segments) -> LexicalIndex:
        self.segments = segments
        self.documents, self.postings = segments.read("documents", DOCUMENTS), segments.read("postings", POSTINGS)
        return self

    def append(self, corpus: DataFrame, shard: str = "all", size: int = SIZE) -> LexicalIndex:
        """Adds the documents (docid, text) of a shard; one that the index holds already changes nothing. Fails unless all were indexed."""

        def write(folder: str, number: int) -> None:
            _write(documents(corpus, number, size), blocks(corpus, number, size), folder)
            check_count(self.spark.read.schema(DOCUMENTS).parquet(f"{folder}/documents"), self.spark.read.schema(POSTINGS).parquet(f"{folder}/postings"), corpus)

        return self._use(self.segments.append(shard, write))

    def compact(self) -> LexicalIndex:
        """All segments written as one."""
        return self._use(self.segments.compact(lambda folder: _write(self.documents, self.postings, folder)))

    def stats(self) -> DataFrame:
        """(n_docs, total_len, n_terms) of what was written."""
        sizes = self.documents.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("len"), F.lit(0)).cast("bigint").alias("total_len"))
        return sizes.crossJoin(F.broadcast(self.postings.agg(F.countDistinct("term").alias("n_terms"))))

    def _asked(self, queries: DataFrame, k1: float, b: float) -> DataFrame:
        """A row for each query, term and range: idf, the block's bound and postings, and the mean length."""
        asked = queries.select(F.col("qid").cast("string").alias("qid"), F.explode(word_set("text")).alias("term")).distinct()
        asked = asked.withColumn("slice", F.pmod(F.xxhash64("term"), F.lit(SLICES)).cast("int"))
        head = self.postings.select("slice", "term", "range", "n", "most_tf", "least_len")
        met = asked.select("slice", "term").distinct().join(head, ["slice", "term"])
        sizes = self.documents.agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("mean"))  # one row
        df = met.groupBy("slice", "term").agg(F.sum("n").alias("df")).crossJoin(F.broadcast(sizes))
        idf = df.select("slice", "term", F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "mean")
        bounded = met.join(idf, ["slice", "term"]).withColumn("bound", F.col("idf") * _part(F.col("most_tf"), F.col("least_len"), k1, b))
        return asked.join(bounded, ["slice", "term"]).select("qid", "slice", "term", "range", "n", "idf", "mean", "bound")

    def _scored(self, chosen: DataFrame, k1: float, b: float) -> DataFrame:
        """(qid, range, nth, part) summed over the blocks of ``chosen``."""
        met = chosen.select("qid", "slice", "term", "range", "idf", "mean").join(self.postings.select("slice", "term", "range", "postings"), ["slice", "term", "range"])
        rows = met.select("qid", "range", "idf", "mean", F.inline("postings"))
        return rows.groupBy("qid", "range", "nth").agg(F.sum(F.col("idf") * _part(F.col("tf"), F.col("len"), k1, b)).alias("part"))

    def _kept(self, df: DataFrame) -> DataFrame:
        path = scratch(self.spark, "search")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _steps(self, queries: DataFrame, k: int, k1: float, b: float, first: int) -> tuple[dict[str, DataFrame], DataFrame]:
        """The blocks that the queries ask for and those that each step reads; and the documents (qid, range, nth, part) that may be among the best k, with their scores."""
        asked = self._kept(self._asked(queries, k1, b))
        total = asked.groupBy("qid", "range").agg(F.sum("bound").alias("total"))
        best = total.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("total"), "range"))).filter(F.col("place") <= first)
        read = {"postings": asked, "probed": asked.join(best.select("qid", "range"), ["qid", "range"], "left_semi")}
        floors = self._floors(self._scored(read["probed"], k1, b), k)
        upto = F.sum("bound").over(Window.partitionBy("qid", "range").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        tier = F.lit(len(TIERS))
        for i, share in reversed(list(enumerate(TIERS))):
            tier = F.when(F.col("upto") >= share * F.col("floor"), i).otherwise(tier)
        marked = asked.join(floors, "qid").withColumn("upto", upto).withColumn("tier", tier)
        whole = Window.partitionBy("qid", "range")
        rests = [F.coalesce(F.sum(F.when(F.col("tier") > i, F.col("bound"))).over(whole), F.lit(0.0)).alias(f"rest{i}") for i in range(len(TIERS) + 1)]
        marked = self._kept(marked.select("*", *rests, F.min("tier").over(whole).alias("least")).filter("least = 0").drop("upto", "least"))
        ranges = marked.select("qid", "range", "floor", *[f"rest{i}" for i in range(len(TIERS) + 1)]).distinct()
        found = None
        for i in range(len(TIERS) + 1):
            own = marked.filter(F.col("tier") == i)
            if found is not None:
                own = own.join(found.select("qid", "range").distinct(), ["qid", "range"], "left_semi")
            read[f"step{i}"] = own
            parts = self._scored(own, k1, b)
            if found is not None:
                more = parts.withColumnRenamed("part", "more")
                parts = found.join(more, ["qid", "range", "nth"], "left").select("qid", "range", "nth", (F.col("part") + F.coalesce("more", F.lit(0.0))).alias("part"))
            parts = self._kept(parts)
            now = self._floors(parts, k).withColumnRenamed("floor", "now")  # a part of a score is a floor as well
            near = parts.join(ranges, ["qid", "range"]).join(now, "qid")
            found = self._kept(near.filter(F.col("part") + F.col(f"rest{i}") >= F.greatest("floor", "now")).select("qid", "range", "nth", "part"))
        return read, found

    def _floors(self, parts: DataFrame, k: int) -> DataFrame:
        """(qid, floor): what the k-th best score is at least."""
        place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("part"), "range", "nth"))
        least = parts.withColumn("place", place).filter(F.col("place") <= k).groupBy("qid").agg(F.min("part").alias("least"), F.count(F.lit(1)).alias("n"))
        return least.select("qid", F.when(F.col("n") == k, F.col("least") - SLACK).otherwise(0.0).alias("floor"))

    def search(self, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B, digits: int = 6, first: int = FIRST) -> DataFrame:
        """(qid, docid, score, rank) for queries (qid, text), as bm25_topk() has them."""
        _, found = self._steps(queries, k, k1, b, first)
        named = found.join(self.documents.select("range", "nth", "docid"), ["range", "nth"]).withColumn("score", F.round("part", digits))
        rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "docid"))
        return named.withColumn("rank", rank).filter(F.col("rank") <= k).select("qid", "docid", "score", "rank")

    def reads(self, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B, first: int = FIRST) -> DataFrame:
        """(step, n): how many postings the queries' terms have, and how many of them a search reads in each step."""
        rows = None
        for name, part in self._steps(queries, k, k1, b, first)[0].items():
            own = part.select(F.lit(name).alias("step"), F.col("n").cast("bigint").alias("n"))
            rows = own if rows is None else rows.unionByName(own)
        return rows.groupBy("step").agg(F.sum("n").alias("n"))


def _part(tf: Column, length: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.col("mean")))


def check_count(docs: DataFrame, postings: DataFrame, corpus: DataFrame) -> int:
    """How many documents were indexed; fails unless they are all of the corpus, and the postings hold all their words."""
    there = corpus.filter("docid is not null").count()
    own = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("words")).first()
    words = postings.agg(F.coalesce(F.sum(F.aggregate("postings", F.lit(0).cast("bigint"), lambda s, p: s + p.tf)), F.lit(0)).alias("words")).first()["words"]
    if own["n"] != there or own["words"] != words:
        raise ValueError(f"{own['n']} of {there} documents and {words} of {own['words']} words were indexed")
    return own["n"]
