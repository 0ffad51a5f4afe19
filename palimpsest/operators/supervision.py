"""Training groups from trajectories: positives, tiered negatives, weights, and matching of replayed candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_length
from ..plans.steps import returned_ids, visits

CAPS = {"div": 3, "hard": 3, "weak": 9}


def candidates(annotated: DataFrame, corpus: DataFrame) -> DataFrame:
    """(traj, idx, snap, docid, reasoning): first visits after a search, of documents that some search of the run returned and the corpus has."""
    opened = visits(annotated).filter("first and snap is not null")
    given = returned_ids(annotated).select("traj", "docid").distinct()
    return opened.join(given, ["traj", "docid"], "left_semi").join(corpus.select("docid"), "docid", "left_semi").select("traj", "idx", "snap", "docid", "reasoning")


def positives(annotated: DataFrame, corpus: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The candidates whose document is relevant. ``verdicts``: (docid, relevant); an absent one is no."""
    return candidates(annotated, corpus).join(verdicts.filter("relevant").select("docid"), "docid", "left_semi").select("traj", "idx", "snap", "docid", "reasoning")


def seen_before(annotated: DataFrame, chosen: DataFrame, corpus: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(traj, idx, tier, place, neg): documents first visited before the candidate's search; div if relevant, else hard."""
    opened = visits(annotated).filter("first").select("traj", F.col("docid").alias("neg"), F.col("idx").alias("place"))
    pairs = chosen.select("traj", "idx", "snap", "docid").join(opened, "traj").filter("place < snap and neg <> docid")
    known = pairs.join(corpus.select(F.col("docid").alias("neg")), "neg", "left_semi")
    marked = known.join(verdicts.filter("relevant").select(F.col("docid").alias("neg"), F.lit("div").alias("tier")), "neg", "left")
    return marked.select("traj", "idx", F.coalesce("tier", F.lit("hard")).alias("tier"), F.col("place").cast("bigint").alias("place"), "neg")


def never_opened(annotated: DataFrame, chosen: DataFrame, corpus: DataFrame) -> DataFrame:
    """(traj, idx, tier, place, neg): what the candidate's search returned and the whole run never visited, in order, repeats kept."""
    given = returned_ids(annotated).select("traj", F.col("idx").alias("snap"), "place", F.col("docid").alias("neg"))
    opened = visits(annotated).select("traj", F.col("docid").alias("neg")).distinct()
    pairs = chosen.select("traj", "idx", "snap", "docid").join(given, ["traj", "snap"]).filter("neg <> docid")
    left = pairs.join(opened, ["traj", "neg"], "left_anti").join(corpus.select(F.col("docid").alias("neg")), "neg", "left_semi")
    return left.select("traj", "idx", F.lit("weak").alias("tier"), F.col("place").cast("bigint").alias("place"), "neg")


def negatives(annotated: DataFrame, chosen: DataFrame, corpus: DataFrame, verdicts: DataFrame) -> DataFrame:
    return seen_before(annotated, chosen, corpus, verdicts).unionByName(never_opened(annotated, chosen, corpus))


def groups(chosen: DataFrame, negs: DataFrame) -> DataFrame:
    """(traj, idx, pos_id, neg_diversity_id, neg_hard_id, neg_weak_id, reasoning_len): one for each positive with any negative."""
    tier = lambda t: F.transform(F.sort_array(F.collect_list(F.when(F.col("tier") == t, F.struct("place", "neg")))), lambda x: x["neg"])
    tiers = negs.groupBy("traj", "idx").agg(tier("div").alias("neg_diversity_id"), tier("hard").alias("neg_hard_id"), tier("weak").alias("neg_weak_id"))
    return chosen.join(tiers, ["traj", "idx"]).select("traj", "idx", F.col("docid").alias("pos_id"), "neg_diversity_id", "neg_hard_id", "neg_weak_id", token_length("reasoning").alias("reasoning_len"))


def reweight(rows: DataFrame, length: str = "reasoning_len") -> DataFrame:
    """Adds ``reweight_rate``: 1 - 2 ** (-length / median), over its mean; rows without a positive length get 1. Two aggregates of one row each."""
    has = F.col(length) > 0
    median = rows.agg(F.median(F.when(has, F.col(length))).alias("half"))
    raw = F.when(has, 1 - F.exp(-F.col(length) * F.log(F.lit(2.0)) / F.col("half")))
    with_raw = rows.crossJoin(F.broadcast(median)).withColumn("raw", raw)
    mean = with_raw.agg(F.avg("raw").alias("mean"))
    return with_raw.crossJoin(F.broadcast(mean)).withColumn("reweight_rate", F.when(F.col("mean") != 0, F.coalesce(F.col("raw") / F.col("mean"), F.lit(1.0))).otherwise(1.0)).drop("half", "raw", "mean")


def tier_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("groups"), *[F.avg(F.size(f"neg_{t}_id")).alias(f"avg_{t}") for t in ("diversity", "hard", "weak")])


def group_sample(negs: DataFrame, order: Column, caps: dict[str, int] | None = None, total: int = 9) -> DataFrame:
    """At most ``caps`` negatives of each tier, then weak ones up to ``total`` for a group, by ``order``."""
    caps = caps or CAPS
    cap = F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])
    ranked = negs.withColumn("n", F.row_number().over(Window.partitionBy("traj", "idx", "tier").orderBy(order, "place", "neg"))).filter(F.col("n") <= cap[F.col("tier")])
    strong = F.when(F.col("tier") == "weak", 1).otherwise(0)
    return ranked.withColumn("m", F.row_number().over(Window.partitionBy("traj", "idx").orderBy(strong, "tier", "n"))).filter(F.col("m") <= total).select("traj", "idx", "tier", "neg")


def claim(lines: DataFrame, candidates_: DataFrame, keys: list[str], line_order: str, candidate_order: list[str]) -> DataFrame:
    """Multiset matching: the n-th line of a key with the n-th candidate of it, so each is claimed once at most; null keys are equal."""
    left = lines.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(line_order))).alias("l")
    right = candidates_.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*candidate_order))).alias("r")
    same = F.col("l.nth") == F.col("r.nth")
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return left.join(right, same, "left")


def assert_all_claimed(claimed: DataFrame, column: str) -> DataFrame:
    """Fails when a line found no candidate."""
    return claimed.withColumn(column, F.when(F.col(column).isNull(), F.raise_error(F.lit("a line has no candidate"))).otherwise(F.col(column)))


def fan_out(rows: DataFrame, styles: dict[str, Column]) -> DataFrame:
    """Each row once for each style, with its query; other fields stay."""
    pairs = F.create_map(*[x for name, query in styles.items() for x in (F.lit(name), query)])
    return rows.select("*", F.explode(pairs).alias("style", "styled_query"))
