"""Readers and writers of the formats that runs, corpora and training groups come in."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

CORPUS = "docid string, text string"
STEP = (
    "struct<type:string,tool_name:string,arguments:string,output:string,original_query:string,retrieval_query:string,"
    "returned_docids:array<string>,returned:array<struct<docid:string,score:double>>,hidden:array<struct<docid:string,score:double>>,"
    "found_docids_before_search:array<string>,previous_queries_before_search:array<string>,visited_docids_before_search:array<string>,"
    "k:int,query_style:string,error:string>"
)
TRAJECTORY = (
    "metadata struct<query_source:string,model:string,query_style:string>, query_id string, status string, tool_call_counts map<string,double>, "
    f"tool_call_counts_all map<string,double>, retrieved_docids array<string>, result array<{STEP}>, raw_messages array<struct<role:string,content:string>>"
)
GROUP_FIELDS = ["query", "pos", "pos_id", "neg_diversity", "neg_diversity_id", "neg_hard", "neg_hard_id", "neg_weak", "neg_weak_id", "reasoning_len", "reweight_rate"]


def rename_corpus(raw: DataFrame, id_col: str = "id", text_col: str = "contents") -> DataFrame:
    """(docid, text) from a raw corpus; both columns must be there."""
    if missing := {id_col, text_col} - set(raw.columns):
        raise ValueError(f"the corpus lacks {sorted(missing)}")
    return raw.select(F.col(id_col).cast("string").alias("docid"), F.col(text_col).alias("text"))


def read_corpus(spark: SparkSession, path: str, only: DataFrame | None = None) -> DataFrame:
    """A corpus in JSON lines; of repeated docids the last row of the last file stays. ``only`` (docid) restricts it by a semi join."""
    rows = spark.read.schema(CORPUS).json(path)
    rows = rows.withColumn("order_", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id())).filter("docid is not null")
    if only is not None:
        rows = rows.join(only.select("docid"), "docid", "left_semi")
    return rows.groupBy("docid").agg(F.max_by("text", "order_").alias("text"))


def read_trajectories(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Trajectories, one JSON document a file; ``bad`` says which files hold no JSON or no result. ``strict`` fails on those."""
    reader = spark.read.schema(TRAJECTORY).option("multiLine", True).option("mode", "FAILFAST" if strict else "PERMISSIVE")
    rows = reader.json(path).withColumn("file", F.col("_metadata.file_name"))
    return rows.withColumn("bad", F.col("result").isNull())


def read_arms(spark: SparkSession, arms: dict[str, str]) -> DataFrame:
    """The runs of several folders, each under its label."""
    out = None
    for label, path in arms.items():
        part = read_trajectories(spark, path).withColumn("arm", F.lit(label))
        out = part if out is None else out.unionByName(part)
    return out


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(qid, question, answer) from a tab-separated file with quotes; rows with fewer than two fields are skipped."""
    rows = spark.read.schema("qid string, question string, answer string").option("sep", "\t").option("mode", "PERMISSIVE").csv(path)
    return rows.select(strip("qid").alias("qid"), strip("question").alias("question"), strip("answer").alias("answer")).filter("qid is not null and question is not null")


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(qid, question, answer) from a tab-separated file without quoting; rows need three fields, the last of a qid stays."""
    rows = spark.read.schema("qid string, question string, answer string").option("sep", "\t").option("quote", "").csv(path)
    rows = rows.select(strip("qid").alias("qid"), strip("question").alias("question"), strip("answer").alias("answer")).filter("qid is not null and answer is not null")
    order = F.monotonically_increasing_id()
    return rows.withColumn("o", order).groupBy("qid").agg(F.max_by(F.struct("question", "answer"), "o").alias("x")).select("qid", "x.*")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(qid, docid) from TREC lines of exactly four fields; other lines fail."""
    parts = F.split(strip("value"), r"\s+")
    rows = spark.read.text(path).filter(strip("value") != "").withColumn("parts", parts)
    checked = F.when(F.size("parts") == 4, F.col("parts")).otherwise(F.raise_error(F.concat(F.lit("not four fields: "), F.col("value"))).cast("array<string>"))
    return rows.withColumn("parts", checked).select(F.col("parts")[0].alias("qid"), F.col("parts")[2].alias("docid"))


def read_embeddings(spark: SparkSession, path: str, dims: int | None = None, id_col: str = "docid") -> DataFrame:
    """(docid, embedding) of Parquet shards; rows of another length or without a vector are skipped, no rows at all fail."""
    rows = spark.read.parquet(path).select(F.col(id_col).cast("string").alias("docid"), F.col("embedding")).filter(F.size("embedding") > 0)
    rows = rows if dims is None else rows.filter(F.size("embedding") == dims)
    if rows.isEmpty():
        raise ValueError(f"no embeddings in {path}")
    return rows


def write_corpus(corpus: DataFrame, path: str) -> None:
    corpus.select("docid", "text").write.mode("overwrite").json(path)


def write_groups(groups: DataFrame, path: str) -> None:
    """Training groups in JSON lines, fields in their fixed order."""
    groups.select(*[c for c in GROUP_FIELDS if c in groups.columns]).write.mode("overwrite").json(path)


def write_styles(rows: DataFrame, path: str) -> None:
    """One folder of JSON lines for each style."""
    rows.write.mode("overwrite").partitionBy("style").json(path)


def write_runs(runs: DataFrame, path: str) -> None:
    """One folder for each question; a rerun replaces its own questions only."""
    runs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("qid").json(path)


def write_report(metrics: DataFrame, details: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").json(f"{path}/metrics")
    details.write.mode("overwrite").json(f"{path}/details")


def write_stamp(spark: SparkSession, stamp: dict, path: str) -> None:
    """An index's stamp, beside it."""
    spark.createDataFrame([(json.dumps(stamp, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_stamp(spark: SparkSession, path: str) -> dict | None:
    try:
        return json.loads(spark.read.text(path).first()["value"])
    except Exception as missing:
        if "PATH_NOT_FOUND" in str(missing):
            return None
        raise


def write_index(postings: DataFrame, vectors: DataFrame | None, path: str) -> None:
    """An index's tables, postings by hashed term."""
    postings.write.mode("overwrite").parquet(f"{path}/postings")
    if vectors is not None:
        vectors.write.mode("overwrite").parquet(f"{path}/vectors")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    """The postings and vectors (if any) of write_index()."""
    try:
        vectors = spark.read.parquet(f"{path}/vectors")
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        vectors = None
    return spark.read.parquet(f"{path}/postings"), vectors


def write_embeddings(vectors: DataFrame, path: str, rows: int = 10_000) -> None:
    """(docid, embedding) in Parquet files of at most ``rows`` rows; read_embeddings() reads them."""
    vectors.select(F.col("docid").cast("string").alias("docid"), F.col("embedding").cast("array<float>").alias("embedding")).write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir; a temporary one only where there is one machine. It goes when the driver's JVM ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="scratch-")
    path = f"{shared}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path
