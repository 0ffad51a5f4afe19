"""Bounded samples of labelled texts for training on the driver, and folds by a document's checksum."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(folds)).cast("int")


#: Bytes of all texts in a sample.
MOST_BYTES = 64 << 20


def sample(docs: DataFrame, labels: DataFrame, label: str, keep_fold: Column, most: int, per_class: bool, most_bytes: int = MOST_BYTES) -> tuple[pa.Table, dict[int, int]]:
    """(doc_id, text, y, other columns of ``docs``) of at most ``most`` labelled rows with at most ``most_bytes`` of whole texts, and how many each label has in all.

    ``labels`` is (doc_id, label); rows without a label or with another than 0 and 1 take no part, an id with
    several labels counts as its largest. Which rows are taken goes by a hash of doc_id, so reruns agree.
    """
    use = labels.filter(F.col(label).isin(0, 1) & keep_fold).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in use.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64("doc_id", F.lit(7))
    if per_class:
        taken = [use.filter(F.col("y") == y).orderBy(order, "doc_id").limit(most // 2) for y in (0, 1)]
        chosen = taken[0].unionByName(taken[1])
    else:
        chosen = use.orderBy(order, "doc_id").limit(most)
    sizes = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))  # at most ``most`` ids
    sizes = sizes.groupBy("doc_id").agg(F.sum("n").alias("n")).orderBy(order, "doc_id").toArrow()
    fit = np.cumsum(sizes.column("n").to_numpy()) <= most_bytes
    fit[:1] = True  # one text at least, however long
    ids = docs.sparkSession.createDataFrame(pa.table({"doc_id": sizes.column("doc_id").filter(pa.array(fit))}))
    rows = docs.join(F.broadcast(chosen.join(ids, "doc_id")), "doc_id")
    return rows.orderBy(order, "doc_id").toArrow(), counts
