"""Exact top-k inner products by columnar branch and bound.

Vectors become whole numbers, floor(scale * x), so scores are exact. Rows are dealt into blocks of about ROWS, queries
into blocks of about QUERIES, and each block of queries meets each block of rows once: the queries are a stated set, and every one
of them has to see every row's first dimensions. A block of rows lies
dimension by dimension; a query adds up its scores STEP dimensions at a time, those with the most mass first,
and keeps the rows whose score could still reach the k-th best lower bound, the rest of a score being at
most the product of the remaining norms (Cauchy-Schwarz). Survivors are compacted and go on. The last ones' scores are taken in whole numbers. Blocks'
best k meet in a window with a limit for each group.

Equal rows travel once, with their number: a vector that a third of the rows repeat is one row.

Cases: vectors that are null or empty, hold null or non-finite components, or have a null id take no part; every row but the query's own is
a candidate, repeated rows each take a rank, a repeat of the query's row too; of rows with an id that is asked for and different vectors the greatest vector
asks and the others are candidates; vectors of different lengths don't meet; ties go to smaller ids. Scores beyond 64 bits have no defined result.
Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import keep, parts_for, pick, prepare

ROWS, QUERIES, STEP = 1 << 15, 1 << 12, 8


def whole(vectors: pa.ChunkedArray, scale: float) -> np.ndarray:
    """floor(scale * x) in doubles, a row for each dimension."""
    flat = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.ascontiguousarray(np.floor(scale * flat).reshape(len(vectors), -1).T)


def best(query: np.ndarray, columns: np.ndarray, rest: np.ndarray, times: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the best k of rows that stand ``times`` each. ``rest``: for each step, the rows' norms in the dimensions from there on."""
    dims = len(columns)
    left = np.sqrt(np.append(np.cumsum((query**2)[::-1])[::-1], 0))
    alive = np.flatnonzero(times)
    part = columns[:STEP] if len(alive) == len(ids) else columns[:STEP, alive]
    scores = query[:STEP] @ part
    error = left[0] * rest[0][alive] * 1e-12  # of sums in doubles
    for at in range(STEP, dims + STEP, STEP):
        room = (left[at] * rest[at // STEP][alive] if at < dims else 0) * (1 + 1e-9) + error + 1e-6
        if len(alive) > k:
            least = np.partition(scores - room, len(alive) - k)[len(alive) - k]
            on = scores + room >= least
            if at >= dims or on.sum() < 0.8 * len(alive):
                alive, scores, error = alive[on], scores[on], error[on]
        if at < dims:
            scores = scores + query[at : at + STEP] @ columns[at : at + STEP, alive]
    exact = query.astype(np.int64) @ columns[:, alive].astype(np.int64)
    order = np.lexsort((ids[alive], -exact))[:k]
    many = np.minimum(times[alive[order]], k)
    return np.repeat(ids[alive[order]], many)[:k], np.repeat(exact[order], many)[:k]


def _meet(k: int, scale: float):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def meet(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(queries) or not len(rows):
            return schema.empty_table()
        ids, columns = rows.column("vec_id").to_numpy(), whole(rows.column("embedding"), scale)
        times = rows.column("n").to_numpy()
        wanted, asked = queries.column("vec_id").to_numpy(), whole(queries.column("embedding"), scale)
        same = {}
        for i, (own, raw) in enumerate(zip(ids.tolist(), rows.column("h").to_pylist(), strict=True)):
            same[own, raw] = i
        order = np.argsort(-(columns**2).sum(axis=1), kind="stable")
        columns, asked = columns[order], asked[order].T
        square = np.add.reduceat(columns**2, np.arange(0, len(columns), STEP), axis=0)
        rest = np.sqrt(np.cumsum(square[::-1], axis=0)[::-1])
        found = []
        for q, own, raw in zip(asked, wanted.tolist(), queries.column("h").to_pylist(), strict=True):
            place = same.get((own, raw))
            left = times
            if place is not None:  # the query's own row
                left = times.copy()
                left[place] -= 1
            found.append(best(q, columns, rest, left, ids, k))
        n = [len(x) for x, _ in found]
        return pa.table([np.repeat(wanted, n), np.concatenate([x for x, _ in found]), np.concatenate([s for _, s in found])], schema=schema)

    return meet


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", rows: int = ROWS, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the best k of all other rows for each row that ``is_query`` (of vec_id) names."""
    prepare(vectors.sparkSession)
    vectors = pick(vectors, vec_id=id_col, embedding=vector_col)
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = vectors.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~bad)
    one = keep(sound.groupBy("vec_id", "embedding").agg(F.count(F.lit(1)).alias("n")).withColumn("dims", F.size("embedding")).withColumn("h", F.xxhash64("embedding")))
    asked = one.filter(is_query).groupBy("vec_id").agg(F.max(F.struct("embedding", "dims", "h")).alias("x")).select("vec_id", "x.*")
    counts = one.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    n_rows, n_queries = parts_for(counts["n"], rows), parts_for(counts["q"], queries)
    block = lambda n: F.pmod(F.xxhash64("vec_id", "h"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("vec_id", "embedding", "dims", "h", block(n_queries).alias("query_block"), every(n_rows).alias("row_block"))
    right = one.select("vec_id", "embedding", "dims", "h", "n", every(n_queries).alias("query_block"), block(n_rows).alias("row_block"))
    keys = ["query_block", "row_block", "dims"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_meet(k, scale), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
