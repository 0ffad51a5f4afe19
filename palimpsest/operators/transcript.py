"""Agent transcripts: from messages to steps, and traces onto steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

CALL = "struct<name:string,arguments:string>"


def parse_messages(messages: DataFrame) -> DataFrame:
    """(traj, idx, type, tool_name, arguments, output) from (traj, turn, role, content), turns in order.

    An assistant message that is not the last gives its thoughts, then its calls; a call that is not an object in JSON is
    dropped; its output is the next message's first tool response if that is a user's. The last message is the output text.
    """
    by = Window.partitionBy("traj").orderBy("turn")
    content = F.coalesce("content", F.lit(""))
    rows = messages.withColumn("last", F.lead("turn").over(by).isNull()).withColumn("reply", F.when(F.lead("role").over(by) == "user", F.lead(content).over(by)))
    response = F.coalesce(strip(F.regexp_extract("reply", r"(?s)<tool_response>\n(.*?)\n</tool_response>", 1)), F.lit(""))
    said = F.when((F.col("role") == "assistant") & ~F.col("last"), content).otherwise("")
    thought = F.transform(F.regexp_extract_all(said, F.lit(r"(?s)<think>(.*?)</think>"), F.lit(1)), lambda x: F.struct(F.lit("reasoning").alias("type"), F.lit(None).cast("string").alias("tool_name"), F.lit(None).cast("string").alias("arguments"), strip(x).alias("output")))
    raw = F.filter(F.regexp_extract_all(said, F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), F.lit(1)), lambda x: F.get_json_object(x, "$").startswith("{"))
    calls = F.transform(raw, lambda x: F.struct(F.lit("tool_call").alias("type"), F.coalesce(F.get_json_object(x, "$.name"), F.lit("")).alias("tool_name"), F.coalesce(F.get_json_object(x, "$.arguments"), F.lit("{}")).alias("arguments"), response.alias("output")))
    final = F.when(F.col("last"), F.array(F.struct(F.lit("output_text").alias("type"), F.lit(None).cast("string").alias("tool_name"), F.lit(None).cast("string").alias("arguments"), content.alias("output"))))
    steps = rows.select("traj", "turn", F.posexplode(F.concat(thought, calls, F.coalesce(final, F.slice(thought, 1, 0)))).alias("place", "step"))
    idx = F.row_number().over(Window.partitionBy("traj").orderBy("turn", "place"))
    return steps.select("traj", idx.cast("bigint").alias("idx"), "step.*")


def attach_traces(steps: DataFrame, traces: DataFrame) -> DataFrame:
    """Traces (traj, nth, tool_name, returned_docids) in order onto the calls of the same tool; a trace waits for a call of its name, and later traces wait behind it.

    A run's calls and traces are bounded by its budget, so the walk is a fold over them in one expression.
    """
    names = traces.groupBy("traj").agg(F.sort_array(F.collect_list(F.struct("nth", "tool_name", "returned_docids"))).alias("traces"))
    calls = steps.filter("type = 'tool_call'").groupBy("traj").agg(F.sort_array(F.collect_list(F.struct("idx", "tool_name"))).alias("calls"))
    both = calls.join(names, "traj")
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<idx:bigint,n:int>>").alias("out"))

    def step(s, x):
        fits = F.coalesce(F.get(F.col("traces"), s["n"])["tool_name"] == x["tool_name"], F.lit(False))
        hit = F.struct(x["idx"].cast("bigint").alias("idx"), s["n"].alias("n"))
        return F.struct(F.when(fits, s["n"] + 1).otherwise(s["n"]).alias("n"), F.when(fits, F.concat(s["out"], F.array(hit))).otherwise(s["out"]).alias("out"))

    matched = both.select("traj", "traces", F.explode(F.aggregate("calls", start, step)["out"]).alias("m"))
    found = matched.select("traj", F.col("m.idx").alias("idx"), F.get(F.col("traces"), F.col("m.n"))["returned_docids"].alias("returned_docids"))
    return steps.join(found, ["traj", "idx"], "left")


def normalize_items(items: DataFrame) -> DataFrame:
    """Calls with their outputs from items (traj, nth, type, call_id, name, arguments, output); the last output of a call counts, and other call kinds are function calls."""
    outputs = items.filter("type in ('function_call_output', 'mcp_call_output')").groupBy("traj", "call_id").agg(F.max_by("output", "nth").alias("result"))
    calls = items.filter("type in ('function_call', 'mcp_call')").drop("output")
    name = F.regexp_replace(F.coalesce("name", F.lit("")), r"^(functions|mcp)\.", "")
    return calls.join(outputs, ["traj", "call_id"], "left").select("traj", "nth", F.lit("tool_call").alias("type"), name.alias("tool_name"), "arguments", F.coalesce("result", F.lit("")).alias("output"))


def reasoning_text(summary, content):
    """A reasoning item's text: its summary's parts, else its content's, each on a line."""
    texts = lambda x: F.array_join(F.filter(F.transform(x, lambda p: p["text"]), lambda t: F.length(t) > 0), "\n")
    return F.coalesce(F.when(F.size(summary) > 0, texts(summary)), texts(content), F.lit(""))
