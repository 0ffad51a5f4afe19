"""Scores of runs: exact match, verdicts, steps and evidence recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import normalize


def exact_match(gold: Column, response: Column) -> Column:
    """The normalized gold answer is in the normalized response; an empty response is wrong, an empty gold is in any other."""
    return (F.coalesce(response, F.lit("")) != "") & normalize(response).contains(normalize(gold))


def steps_of(counts: Column) -> Column:
    return F.aggregate(F.map_values(counts), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def exact_match_report(runs: DataFrame, truth: DataFrame) -> DataFrame:
    """(n, sr, avg_steps) of runs (qid, response, steps) that have a true answer (qid, answer)."""
    both = runs.join(truth, "qid").withColumn("correct", exact_match(F.col("answer"), F.col("response")))
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("int")).alias("sr"), F.avg("steps").alias("avg_steps"))


def evidence_recall(runs: DataFrame, qrels: DataFrame) -> DataFrame:
    """(qid, recall): the share of a question's evidence among a run's retrieved docids; 0 without evidence."""
    gold = qrels.groupBy("qid").agg(F.collect_set("docid").alias("gold"))
    share = F.size(F.array_intersect(F.col("retrieved"), F.col("gold"))) / F.size("gold")
    return runs.join(gold, "qid", "left").select("qid", F.coalesce(share, F.lit(0.0)).alias("recall"))


def judge_report(runs: DataFrame, qrels: DataFrame) -> DataFrame:
    """(arm, n, success_rate, avg_steps, recall) of judged runs (arm, qid, correct, steps, retrieved)."""
    gold = qrels.groupBy("qid").agg(F.collect_set("docid").alias("gold"))
    share = F.coalesce(F.size(F.array_intersect(F.col("retrieved"), F.col("gold"))) / F.size("gold"), F.lit(0.0))
    both = runs.join(gold, "qid", "left").withColumn("recall", share)
    return both.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("int")).alias("success_rate"), F.avg("steps").alias("avg_steps"), F.avg("recall").alias("recall"))


def auto_fail(runs: DataFrame, unanswered: Column) -> DataFrame:
    """(failed, to_judge): unanswered runs fail without a judge."""
    return runs.agg(F.count(F.when(unanswered, 1)).alias("failed"), F.count(F.when(~unanswered, 1)).alias("to_judge"))


def search_visit_recall(returned: DataFrame, visited: DataFrame, gold: DataFrame) -> DataFrame:
    """(traj, search_recall, visit_recall, ratio) over (traj, docid) pairs; ratio is of what was found, what was opened."""
    both = gold.join(returned.distinct().withColumn("r", F.lit(1)), ["traj", "docid"], "left").join(visited.distinct().withColumn("v", F.lit(1)), ["traj", "docid"], "left")
    n = F.count(F.lit(1))
    out = both.groupBy("traj").agg((F.count("r") / n).alias("search_recall"), (F.count("v") / n).alias("visit_recall"))
    return out.withColumn("ratio", F.when(F.col("search_recall") > 0, F.col("visit_recall") / F.col("search_recall")))


def shared_recall(runs: DataFrame, returned: DataFrame, visited: DataFrame, gold: DataFrame) -> DataFrame:
    """search_visit_recall() where all ``runs`` (traj) share one set of evidence, ``gold`` (docid): its size is counted once and hits are joined."""
    n = gold.agg(F.count(F.lit(1)).alias("n"))
    hits = lambda df, name: df.distinct().join(gold, "docid", "left_semi").groupBy("traj").agg(F.count(F.lit(1)).alias(name))
    both = runs.join(hits(returned, "s"), "traj", "left").join(hits(visited, "v"), "traj", "left").crossJoin(F.broadcast(n))  # one row
    share = lambda c: F.when(F.col("n") > 0, F.coalesce(c, F.lit(0)) / F.col("n"))
    out = both.select("traj", share("s").alias("search_recall"), share("v").alias("visit_recall"))
    return out.withColumn("ratio", F.when(F.col("search_recall") > 0, F.col("visit_recall") / F.col("search_recall")))
