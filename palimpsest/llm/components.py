"""Connected components of links, by DataFrame joins.

Each round every node takes the least label among its own and its neighbours', then the label of that
label. Labels only fall and reach the least node of the component. Minima combine before the
shuffle, and the joins' hot keys are split by adaptive execution, so a hub with a third of all links
does not meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .session import discard, keep


def components(links: DataFrame, few: float = 0) -> DataFrame:
    """(node, component) for each node of ``links`` (a, b): the least node that it reaches.

    With ``few`` rounds end when no more than this share of the labels has moved. A label is then a node that is reached, if not always the least:
    nodes with one label are in one component, but a component may have several labels.
    """
    both = keep(links.filter("a <> b").select("a", "b").union(links.filter("a <> b").select("b", "a")).distinct())
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")))
    was = labels
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        pushed = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        up = labels.select(F.col("node").alias("new"), F.col("component").alias("top"))
        moved = pushed.join(up, "new", "left").select("node", "old", F.least("new", F.coalesce("top", "new")).alias("component"))
        changes = Observation()
        moved = keep(moved.observe(changes, F.count(F.when(F.col("component") != F.col("old"), 1)).alias("n"), F.count(F.lit(1)).alias("all")))  # counted as it is written
        seen = changes.get
        discard(was)
        was, labels = moved, moved.select("node", "component")
        if seen["n"] <= few * seen["all"]:
            discard(both)
            return labels
