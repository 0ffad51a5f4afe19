"""The library's operators bound to the driver's tables, which hold no agent runs.

Runs are users' events in order: a view is a search, a click or purchase a visit, other events are reasonings. A search
returns the ten docids (k + 7 i) mod 100. Documents are the corpus, ``labels.quality`` the verdicts, benchmark items the questions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .steps import annotate


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("docid"), "text")


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("docid"), (F.col("quality") == 1).alias("relevant"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint")
    kind = F.when(F.col("event_type") == "view", "search").when(F.col("event_type").isin("click", "purchase"), "visit").otherwise("reasoning")
    rows = events.select(F.col("user_id").alias("traj"), idx.alias("idx"), kind.alias("type"), k.alias("k"))
    text = F.format_string("Observed value of item %d in step %d was useful. The tool returned item %d! We need to search for item %d.", "k", "idx", "k", "k")
    return rows.select(
        "traj",
        "idx",
        "type",
        F.when(F.col("type") == "search", F.format_string("find item %d", "k")).alias("query"),
        F.when(F.col("type") == "visit", F.col("k").cast("string")).alias("docid"),
        F.when(F.col("type") == "search", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.pmod(F.col("k") + 7 * i, F.lit(100)).cast("string"))).alias("returned"),
        F.when(F.col("type") == "reasoning", text).alias("output"),
    )


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate(steps(spark, sf_dir))




def question() -> Column:
    return F.format_string("Which item did user %d observe and what value was useful?", F.col("traj"))


# The same frames in DuckDB's SQL, as the heads of common table expressions.
STEPS = """st AS (SELECT traj, idx, type, k,
  CASE WHEN type = 'search' THEN 'find item ' || k END AS query, CASE WHEN type = 'visit' THEN k::VARCHAR END AS docid,
  CASE WHEN type = 'search' THEN list_transform(range(0, 10), lambda i: ((k + 7 * i) % 100)::VARCHAR) END AS returned,
  CASE WHEN type = 'reasoning' THEN 'Observed value of item ' || k || ' in step ' || idx || ' was useful. The tool returned item ' || k || '! We need to search for item ' || k || '.' END AS output
  FROM (SELECT user_id AS traj, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx,
    CASE event_type WHEN 'view' THEN 'search' WHEN 'click' THEN 'visit' WHEN 'purchase' THEN 'visit' ELSE 'reasoning' END AS type,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)),
isl AS (SELECT *, sum(CASE WHEN type <> 'reasoning' THEN 1 ELSE 0 END) OVER w AS done FROM st WINDOW w AS (PARTITION BY traj ORDER BY idx ROWS UNBOUNDED PRECEDING)),
an AS (SELECT *, max(CASE WHEN type = 'search' THEN idx END) OVER w AS snap, sum(CASE WHEN type = 'search' THEN 1 ELSE 0 END) OVER w AS turn,
  CASE WHEN type = 'visit' AND lead(type) OVER (PARTITION BY traj ORDER BY idx) = 'reasoning' THEN lead(output) OVER (PARTITION BY traj ORDER BY idx) ELSE '' END AS reasoning,
  type = 'visit' AND row_number() OVER (PARTITION BY traj, type, docid ORDER BY idx) = 1 AS first
  FROM isl WINDOW w AS (PARTITION BY traj ORDER BY idx ROWS UNBOUNDED PRECEDING)),
ret AS (SELECT traj, idx, unnest(range(0, 10)) AS place, unnest(returned) AS docid FROM st WHERE type = 'search'),
vis AS (SELECT traj, idx, turn, snap, docid, reasoning, first FROM an WHERE type = 'visit'),
rel AS (SELECT DISTINCT doc_id::VARCHAR AS docid FROM labels WHERE quality = 1),
cor AS (SELECT doc_id::VARCHAR AS docid, text FROM documents)"""

PRE = """pre AS (SELECT s.traj, s.idx, coalesce(string_agg(r.output, ' ' ORDER BY r.idx), '') AS pre FROM isl s
  LEFT JOIN isl r ON r.traj = s.traj AND r.type = 'reasoning' AND r.done = s.done - 1 AND r.idx < s.idx WHERE s.type = 'search' GROUP BY s.traj, s.idx)"""

POSITIVES = """pos AS (SELECT v.traj, v.idx, v.snap, v.docid, v.reasoning FROM vis v WHERE v.first AND v.snap IS NOT NULL
  AND (v.traj, v.docid) IN (SELECT (traj, docid) FROM ret) AND v.docid IN (SELECT docid FROM rel) AND v.docid IN (SELECT docid FROM cor))"""

NEGATIVES = """neg AS (
  SELECT p.traj, p.idx, CASE WHEN n.docid IN (SELECT docid FROM rel) THEN 'div' ELSE 'hard' END AS tier, n.idx AS place, n.docid AS neg
  FROM pos p JOIN vis n ON n.traj = p.traj AND n.first AND n.idx < p.snap AND n.docid <> p.docid WHERE n.docid IN (SELECT docid FROM cor)
  UNION ALL
  SELECT p.traj, p.idx, 'weak', r.place, r.docid FROM pos p JOIN ret r ON r.traj = p.traj AND r.idx = p.snap AND r.docid <> p.docid
  WHERE (r.traj, r.docid) NOT IN (SELECT (traj, docid) FROM vis) AND r.docid IN (SELECT docid FROM cor))"""

GROUPS = """grp AS (SELECT p.traj, p.idx, p.docid AS pos_id,
  coalesce(list(neg ORDER BY place) FILTER (tier = 'div'), []) AS neg_diversity_id, coalesce(list(neg ORDER BY place) FILTER (tier = 'hard'), []) AS neg_hard_id,
  coalesce(list(neg ORDER BY place, neg) FILTER (tier = 'weak'), []) AS neg_weak_id,
  any_value(CASE WHEN p.reasoning = '' THEN 0 ELSE len(string_split(p.reasoning, ' ')) END)::INT AS reasoning_len
  FROM pos p JOIN neg n USING (traj, idx) GROUP BY p.traj, p.idx, p.docid)"""
