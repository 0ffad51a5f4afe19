"""Search within a session: what was new, what was hidden, what was seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.steps import before, returned_ids, searches, visits

POOL, K = 100, 10


def dedup_search(pools: DataFrame, k: int = K, pool: int = POOL) -> DataFrame:
    """(traj, step, results, hidden) from (traj, step, docids): each search returns the best k that no earlier search of the session returned.

    ``hidden`` are those of the best k that were left out as already returned. The result of a step depends on the
    results before it, so a session is folded in order inside one expression; docids are unique in a pool.
    """
    steps = F.sort_array(F.collect_list(F.struct("step", F.slice("docids", 1, max(k, pool)).alias("docids"))))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("seen"), F.array().cast("array<struct<step:bigint,results:array<string>,hidden:array<string>>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        results = F.slice(F.array_except(x["docids"], state["seen"]), 1, k)
        hidden = F.array_intersect(F.slice(x["docids"], 1, k), state["seen"])
        row = F.struct(x["step"].cast("bigint").alias("step"), results.alias("results"), hidden.alias("hidden"))
        return F.struct(F.concat(state["seen"], results).alias("seen"), F.concat(state["out"], F.array(row)).alias("out"))

    folded = pools.groupBy("traj").agg(F.aggregate(steps, start, step).getField("out").alias("out"))
    return folded.select("traj", F.inline("out"))


def search_trace(annotated: DataFrame) -> DataFrame:
    """For each search, what the session had found, asked and visited before it (found and visited once each, in order)."""
    found = F.array_distinct(F.flatten(F.collect_list(F.when(F.col("type") == "search", F.col("returned"))).over(before())))
    asked = F.collect_list(F.when((F.col("type") == "search") & (F.col("query") != ""), F.col("query"))).over(before())
    seen = F.array_distinct(F.collect_list(F.when(F.col("type") == "visit", F.col("docid"))).over(before()))
    out = annotated.withColumns({"found_before": found, "queries_before": asked, "visited_before": seen})
    return out.filter("type = 'search'").select("traj", "idx", "query", "found_before", "queries_before", "visited_before")


def interactions(annotated: DataFrame) -> DataFrame:
    """(traj, turn, query, docids): each search with the visits that follow it, in order."""
    opened = visits(annotated).filter("turn > 0").groupBy("traj", "turn").agg(F.sort_array(F.collect_list(F.struct("idx", "docid"))).alias("v"))
    grouped = searches(annotated).select("traj", "turn", "query").join(opened, ["traj", "turn"], "left")
    return grouped.select("traj", "turn", "query", F.coalesce(F.transform("v", lambda x: x["docid"]), F.array().cast("array<string>")).alias("docids"))


def call_counts(annotated: DataFrame, known: DataFrame) -> DataFrame:
    """(traj, searches, visits, found, calls): calls of each kind, and visits whose document exists."""
    rows = annotated.filter("type <> 'reasoning'").join(known.select(F.col("docid"), F.lit(1).alias("known")), "docid", "left")
    is_ = lambda kind: F.col("type") == kind
    return rows.groupBy("traj").agg(
        F.count(F.when(is_("search"), 1)).alias("searches"),
        F.count(F.when(is_("visit"), 1)).alias("visits"),
        F.count(F.when(is_("visit") & F.col("known").isNotNull(), 1)).alias("found"),
        F.count(F.lit(1)).alias("calls"),
    )


def termination(annotated: DataFrame, budget: int = 50) -> DataFrame:
    """(traj, label, status): how each run ended; it is completed only with an answer."""
    last = annotated.groupBy("traj").agg(F.count(F.when(F.col("type") != "reasoning", 1)).alias("calls"), F.max_by("type", "idx").alias("last"))
    label = F.when(F.col("last") == "reasoning", "answer").when(F.col("calls") >= budget, "exceed available llm calls").otherwise("answer not found")
    return last.select("traj", label.alias("label"), F.when(label == "answer", "completed").otherwise(label).alias("status"))


# What a tool call that is no JSON, or names no tool, is answered; other names of a tool.
INVALID = 'Error: Tool call is not a valid JSON. Tool call must contain a valid "name" and "arguments" field.'
ALIASES = {"visit": "get_document"}
TOOLS = ("search", "get_document")


def dispatch(calls: DataFrame) -> DataFrame:
    """Adds to raw calls (column ``call``, JSON text): ``tool`` (by its own name), ``handler``, ``arguments`` and ``error``: the answer where no tool takes the call."""
    is_object = F.coalesce(F.get_json_object("call", "$").startswith("{"), F.lit(False))
    name = F.when(is_object, F.coalesce(F.get_json_object("call", "$.name"), F.lit("")))
    alias = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    handler = F.coalesce(F.try_element_at(alias, F.col("tool")), F.col("tool"))
    error = F.when(F.col("tool").isNull(), INVALID).when(~F.col("handler").isin(*TOOLS), F.concat(F.lit("Error: Tool "), F.col("tool"), F.lit(" not found")))
    out = calls.withColumn("tool", name).withColumn("handler", handler)
    out = out.withColumn("arguments", F.when(is_object, F.coalesce(F.get_json_object("call", "$.arguments"), F.lit("{}")))).withColumn("error", error)
    return out.withColumn("handler", F.when(F.col("error").isNull(), F.col("handler")))


def tool_counts(dispatched: DataFrame, answered: Column) -> DataFrame:
    """(traj, tool, all_calls, answered_calls) of dispatch()'s rows with a traj; calls that are no JSON count as ``invalid_json``. ``answered``: whether a call gave docids."""
    tool = F.coalesce("tool", F.lit("invalid_json"))
    return dispatched.groupBy("traj", tool.alias("tool")).agg(F.count(F.lit(1)).alias("all_calls"), F.count(F.when(F.col("error").isNull() & answered, 1)).alias("answered_calls"))


# How runs are said to have ended.
ANSWERED, NO_CALLS, NO_ANSWER = "answer", "exceed available llm calls", "answer not found"
FORCED, FORCED_BADLY = "generate an answer as token limit reached", "format error: generate an answer as token limit reached"


def ended(last_message: Column, calls_left: Column, token_limit: Column) -> Column:
    """How a run ended, from its last message, the calls it had left, and whether its tokens (or calls) ran out and a final answer was asked for."""
    answered = F.coalesce(last_message.contains("<answer>"), F.lit(False))
    whole = answered & F.coalesce(last_message.contains("</answer>"), F.lit(False))
    forced = F.when(whole, FORCED).otherwise(FORCED_BADLY)
    free = F.when(answered, ANSWERED).when(calls_left == 0, NO_CALLS).otherwise(NO_ANSWER)
    return F.when(F.coalesce(token_limit, F.lit(False)), forced).otherwise(free)


def novelty_by_step(annotated: DataFrame) -> DataFrame:
    """(turn, searches, novel): how many of a session's t-th search's results are new, on average."""
    first = returned_ids(annotated).groupBy("traj", "docid").agg(F.min("idx").alias("idx")).groupBy("traj", "idx").agg(F.count(F.lit(1)).alias("new"))
    each = searches(annotated).select("traj", "idx", "turn").join(first, ["traj", "idx"], "left")
    return each.groupBy("turn").agg(F.count(F.lit(1)).alias("searches"), F.avg(F.coalesce("new", F.lit(0))).alias("novel"))


def resurface_rate(annotated: DataFrame) -> DataFrame:
    """(opened, resurfaced, rate): documents opened in a session, and those that a later search of it returned again."""
    opened = visits(annotated).filter("first").select("traj", "docid", "idx")
    last = returned_ids(annotated).groupBy("traj", "docid").agg(F.max("idx").alias("last"))
    both = opened.join(last, ["traj", "docid"], "left")
    again = F.count(F.when(F.col("last") > F.col("idx"), 1))
    return both.agg(F.count(F.lit(1)).alias("opened"), again.alias("resurfaced"), (again / F.count(F.lit(1))).alias("rate"))

