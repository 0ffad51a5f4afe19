"""Trajectories as ordered steps, and the frames that all session operators start from.

A step has ``traj, idx, type`` (search, visit, reasoning), ``query, docid, returned, output``; which fields
are filled goes by the type. Everything is computed within a trajectory, so one exchange by ``traj``
serves all windows. Trajectories are bounded by an agent's call budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.text import strip


def order() -> WindowSpec:
    return Window.partitionBy("traj").orderBy("idx")


def so_far() -> WindowSpec:
    return order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before() -> WindowSpec:
    return order().rowsBetween(Window.unboundedPreceding, -1)


def annotate(steps: DataFrame) -> DataFrame:
    """Adds to each step:

    - ``reasoning``: of a visit, the reasoning right after it, else empty;
    - ``pre``: of a search, all consecutive reasonings right before it;
    - ``snap``: the latest search at or before the step (as-of), null before the first;
    - ``turn``: how many searches there have been;
    - ``first``: of a visit, whether it is its docid's first in the trajectory.
    """
    said = F.col("type") == "reasoning"
    out = steps.withColumn("reasoning", F.when((F.col("type") == "visit") & (F.lead("type").over(order()) == "reasoning"), F.coalesce(F.lead("output").over(order()), F.lit(""))).otherwise(""))
    out = out.withColumn("snap", F.max(F.when(F.col("type") == "search", F.col("idx"))).over(so_far()))
    out = out.withColumn("turn", F.count(F.when(F.col("type") == "search", 1)).over(so_far()))
    out = out.withColumn("island", F.count(F.when(~said, 1)).over(so_far()) - F.when(said, 0).otherwise(1))
    island = Window.partitionBy("traj", "island").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    spoken = F.collect_list(F.when(said, strip(F.coalesce("output", F.lit(""))))).over(island)
    out = out.withColumn("pre", F.when(F.col("type") == "search", strip(F.array_join(spoken, " ")))).drop("island")
    nth = F.row_number().over(Window.partitionBy("traj", "type", "docid").orderBy("idx"))
    return out.withColumn("first", (F.col("type") == "visit") & F.col("docid").isNotNull() & (nth == 1))


def searches(annotated: DataFrame) -> DataFrame:
    return annotated.filter("type = 'search'").select("traj", "idx", "turn", "query", "returned", "pre")


def visits(annotated: DataFrame) -> DataFrame:
    return annotated.filter("type = 'visit' and docid is not null").select("traj", "idx", "turn", "snap", "docid", "reasoning", "first")


def returned_ids(annotated: DataFrame) -> DataFrame:
    """(traj, idx, place, docid): what each search returned, in order."""
    return annotated.filter("type = 'search'").select("traj", "idx", F.posexplode("returned").alias("place", "docid"))


def needed_docids(annotated: DataFrame) -> DataFrame:
    """Every docid that a search returned or a visit opened."""
    return returned_ids(annotated).select("docid").union(visits(annotated).select("docid")).distinct()
