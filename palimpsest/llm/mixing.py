"""Mixing sources to target weights by entropy balancing.

A document of ``size`` words in source s is taken at a rate r between 0 and ``most``. Of all rates with which each
source gives its target of words, the ones of greatest (bounded) entropy are exponentially tilted,
r / (most - r) = exp(l_s size / u_s), with one multiplier l_s for each constraint and u_s a unit of size. The convex dual
in l is solved by Newton iterations over all sources at once; each sums gradients and curvatures over
counts of (source, size), a distributed aggregate, and falls back to halving a bracket where a step
leaves it. The rates become copies by error diffusion over a source's sizes, from large to small, so that its words end
within about its smallest document of the target; within one (source, size), which rows get the extra
copies goes by a hash. Counts of (source, size) are bounded by the longest text, not by the rows.

Targets: sources in code point order, null last, weigh ``weights`` in turn and share ``share`` times all words; a
target stops at ``most`` times its source's words, the excess going to the others by weight.

Cases: a null or empty text has size 0 and takes nothing; rows with equal ids are separate; null ids stay; an empty
table gives an empty result. Other columns are kept by mixed(), where rows that differ in any of them are separate, and ignored by rates().
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import fresh, keep, pick, prepare

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one (source, size) ranked together.
TOGETHER = 4096
STEPS, CLOSE = 60, 1e-9


def _before(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """Adds for each name the sum over all rows before a row in ``order``, by ranges of the order: sums before a range and those within it.

    One row for each range is all that meets in one task.
    """
    ranged = keep(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    within = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("range").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    totals = totals.select("range", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}_range") for n in sums])
    out = ranged.withColumns({n: F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in sums.items()}).join(F.broadcast(totals), "range")
    return out.withColumns({n: F.col(n) + F.col(f"{n}_range") for n in sums}).drop("range", *[f"{n}_range" for n in sums])


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(k, source, source_size, target) from (source, source_size); k is the source's place."""
    placed = _before(sizes, [F.col("source").isNull(), F.col("source")], k=F.lit(1))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("k") - 1, F.lit(len(weights))).cast("int") + 1)
    named = placed.withColumn("k", F.col("k") + 1).withColumn("w", weight).withColumn("cap", F.col("source_size") * float(most))
    named = _before(named, [F.col("cap") / F.col("w"), F.col("k")], caps=F.col("cap"), lighter=F.col("w"))
    totals = named.agg((F.sum("source_size") * share).alias("all"), F.sum("w").alias("weight"))
    spread = named.crossJoin(F.broadcast(totals)).withColumn("c", (F.col("all") - F.col("caps")) / (F.col("weight") - F.col("lighter")))
    fits = F.min(F.when(F.col("c") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "k", "c"))).getField("c").alias("fit")
    both = named.crossJoin(F.broadcast(spread.agg(fits)))  # one row
    return both.select("k", "source", "source_size", F.least("cap", F.coalesce(F.col("fit") * F.col("w"), F.col("cap"))).alias("target"))


def solve(counts: DataFrame, named: DataFrame, most: float) -> DataFrame:
    """(k, l, unit): the dual's solution. ``counts``: (k, size, n)."""
    units = counts.groupBy("k").agg((F.sum(F.col("n") * F.col("size") * F.col("size")) / F.sum(F.col("n") * F.col("size"))).alias("unit"))
    state = named.join(units, "k").select("k", "target", "unit", (F.col("source_size") * most <= F.col("target") * (1 + 1e-12)).alias("full"), F.lit(0.0).alias("l"), F.lit(-700.0).alias("lo"), F.lit(700.0).alias("hi"), F.lit(False).alias("done"))
    state = keep(state.withColumn("l", F.when(F.col("full"), 700.0).when(F.col("target") <= 0, -700.0).otherwise(0.0)).withColumn("done", F.col("full") | (F.col("target") <= 0)))
    for _ in range(STEPS):
        if not state.filter(~F.col("done")).limit(1).count():
            break
        z = F.col("size") / F.col("unit")
        p = 1 / (1 + F.exp(-F.col("l") * z))
        words = F.col("n") * F.col("size") * most
        sums = counts.join(state.filter(~F.col("done")).select("k", "l", "unit"), "k").groupBy("k").agg(F.sum(words * p).alias("words"), F.sum(words * p * (1 - p) * z).alias("slope"))
        g = F.col("words") - F.col("target")
        moved = state.join(sums, "k", "left").withColumn("lo", F.when(g < 0, F.col("l")).otherwise(F.col("lo"))).withColumn("hi", F.when(g > 0, F.col("l")).otherwise(F.col("hi")))
        step = F.col("l") - g / F.col("slope")
        inside = (F.col("slope") > 0) & (step > F.col("lo")) & (step < F.col("hi"))
        done = F.col("done") | (F.abs(g) <= CLOSE * F.col("target")) | (F.col("hi") - F.col("lo") < 1e-12)
        state = keep(moved.withColumn("next", F.when(done, F.col("l")).when(inside, step).otherwise((F.col("lo") + F.col("hi")) / 2)).select("k", "target", "unit", "full", F.col("next").alias("l"), "lo", "hi", F.coalesce(done, F.lit(True)).alias("done")))
    return state.select("k", "target", "l", "unit")


def _diffuse(most: int):
    def diffuse(rows: pd.DataFrame) -> pd.DataFrame:
        """Whole copies of each size, from large to small, carrying on what is over."""
        rows = rows.sort_values("size", ascending=False)
        over, out = 0.0, []
        for size, n, rate in zip(rows["size"].tolist(), rows["n"].tolist(), rows["rate"].tolist(), strict=True):
            want = rate * n * size + over
            copies = min(max(round(want / size), 0), most * n)
            over = want - copies * size
            out.append(copies)
        return rows.assign(copies=out)[["k", "size", "n", "copies"]]

    return diffuse


def rates(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """For each row: doc_id, h (a hash of the row), source, size, source_size, target, copies (0 to ``most``), taken; ``row_col`` is kept, as row."""
    prepare(docs.sparkSession)
    row = {"row": row_col} if row_col else {}
    docs = pick(docs, doc_id=id_col, text=text_col, source=source_col, **row)
    sized = keep(docs.select("doc_id", F.xxhash64("doc_id", "text", "source").alias("h"), *row, "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size")))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = keep(targets(sizes, weights, share, most))
    placed = keep(sized.join(named.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "h", *row, "k", "size"))
    counts = keep(placed.filter("size > 0").groupBy("k", "size").agg(F.count(F.lit(1)).alias("n")))
    solved = counts.join(solve(counts, named, most), "k")
    rate = F.when(F.col("target") <= 0, 0.0).otherwise(most / (1 + F.exp(-F.col("l") * F.col("size") / F.col("unit"))))
    whole = keep(solved.select("k", "size", "n", rate.alias("rate")).groupBy("k").applyInPandas(_diffuse(most), "k int, size long, n long, copies long"))
    # A row's place among those of its source and size: by parts of about TOGETHER rows, then within them.
    salted = placed.join(whole, ["k", "size"]).withColumn("salt", F.pmod(F.col("h"), F.expr(f"n div {TOGETHER} + 1")))
    first = salted.groupBy("k", "size", "salt").agg(F.count(F.lit(1)).alias("m")).withColumn("first", F.coalesce(F.sum("m").over(Window.partitionBy("k", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("k", "size", "salt").orderBy("h", "doc_id", *row))
    place = salted.withColumn("rank", rank).join(first.drop("m"), ["k", "size", "salt"]).withColumn("place", F.col("first") + F.col("rank"))
    got = place.select("doc_id", "h", *row, "k", "size", F.expr("(copies * place) div n - (copies * (place - 1)) div n").alias("copies"))
    none = placed.filter("size = 0").select("doc_id", "h", *row, "k", "size", F.lit(0).cast("bigint").alias("copies"))
    return got.unionByName(none).join(named, "k").select("doc_id", "h", *row, "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix: rows of ``docs`` with all their columns, each as often as its copies say."""
    # Hashes pass over nulls, so which columns are null is hashed too; maps can't be hashed but as text.
    value = lambda f: F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`")
    row = F.xxhash64(*[value(f) for f in docs.schema], F.array(*[F.col(f"`{c}`").isNull() for c in docs.columns]))
    h, key, copy = (fresh(docs, n) for n in ("hash_", "id_", "copy_"))
    named = docs.withColumn(h, row)
    copies = rates(named, id_col=id_col, text_col=text_col, source_col=source_col, row_col=h, **options)
    copies = copies.filter("copies > 0").groupBy(F.col("doc_id").alias("id"), "row").agg(F.sum("copies").cast("int").alias("copies"))
    rows = named.withColumn(key, F.col(f"`{id_col}`").cast("bigint")).dropDuplicates([key, h])
    joined = rows.alias("r").join(copies.alias("c"), F.col(f"r.{key}").eqNullSafe(F.col("c.id")) & (F.col(f"r.{h}") == F.col("c.row")))
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col("c.copies")))).select(*[F.col(f"r.`{c}`") for c in docs.columns])
