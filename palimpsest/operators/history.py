"""Queries conditioned on a session's history, in eight styles."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_note, clean_reasoning, let, one_line, token_length, truncate
from ..functions.tokens import cuts
from ..plans.steps import before, searches, visits
from ..sources.corpus import scratch

# For each style whether it shows documents, notes, their ids, and words of a document.
STYLES = {"i2": (False, False, True, 128), "i3": (True, False, False, 64), "i4": (False, True, True, 128), "i5": (True, True, False, 64), "i7": (False, False, True, 128)}
ALL_STYLES = ("i0", "i1", "i2", "i3", "i4", "i5", "i6", "i7")
NOTE_WORDS, MEMORY_EACH, MEMORY_ALL, MEMORY_LEAST = 128, 64, 256, 8

# The labels that queries of the styles are made of.
QUESTION, REASONING, NOW, SUBQUERY, PAST, EMPTY = "Main Question: ", "Current Reasoning: ", "Current Subquery: ", "Previous SubQuery ", "Previous Interactions:", "<empty>"
DOCUMENTS, NOTES, DOCID, BARE_REASONING, BARE_QUERY = "Visited Documents: ", "Visited Document Notes: ", "[docs_id:", "Reasoning: ", "Query: "
LEGACY_QUESTION, LEGACY_NOW, LEGACY_MEMORY = "[Q] ", "[Now] ", "[Memory] "

VISIT = "array<struct<docid:string,text:string,reasoning:string>>"


def _shown(corpus: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(docid, text) of the documents ``wanted`` (docid), cut to what a query can show of them before anything collects them."""
    return corpus.join(wanted.select("docid").distinct(), "docid", "left_semi").select("docid", truncate("text", n).alias("text"))


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` from a file: made once, however often they are read, and of known size, so that few are sent to the other side of a join."""
    place = scratch(rows.sparkSession, name)
    rows.write.parquet(place)
    return rows.sparkSession.read.schema(rows.schema).parquet(place)


def _cut(rows: DataFrame, column: str, path: str, n: int) -> DataFrame:
    """``rows`` with the text's first n tokens and their number (tokens); the rows are written first, as their texts are read twice.

    Rows without a text, often most, are not joined: they would all meet in one task.
    """
    rows = written(rows, "texts")
    some = F.coalesce(F.col(column), F.lit("")) != ""
    cut = rows.filter(some).join(cuts(rows, column, path, n), column, "left").withColumn(column, F.coalesce("cut", column)).drop("cut")
    return cut.unionByName(rows.filter(~some).withColumn("tokens", F.lit(None).cast("int")))


def with_history(annotated: DataFrame, corpus: DataFrame) -> DataFrame:
    """(traj, idx, query, pre, history): each search with the interactions before it, [(query, [(docid, text, reasoning)])].

    Of a document's text the first words are there, as many as a style can show. To render styles, in_styles() does with less.
    """
    opened = visits(annotated).filter("turn > 0")
    opened = opened.join(_shown(corpus, opened, max(x[3] for x in STYLES.values())), "docid", "left")
    grouped = opened.groupBy("traj", "turn").agg(F.sort_array(F.collect_list(F.struct("idx", "docid", F.coalesce("text", F.lit("")).alias("text"), "reasoning"))).alias("v"))
    each = searches(annotated).join(grouped, ["traj", "turn"], "left")
    seen = F.coalesce(F.transform("v", lambda x: F.struct(x["docid"].alias("docid"), x["text"].alias("text"), x["reasoning"].alias("reasoning"))), F.array().cast(VISIT))
    return each.withColumn("history", F.collect_list(F.struct("query", seen.alias("visits"))).over(before())).select("traj", "idx", "query", "pre", "history")


def rendered(annotated: DataFrame, corpus: DataFrame, question: Column, style: str, tokens: str | None = None) -> DataFrame:
    """(traj, idx, rendered): each search's query in one style, as in_styles() makes it."""
    return in_styles(annotated, corpus, question, (style,), tokens).withColumnRenamed(style, "rendered")


def in_styles(annotated: DataFrame, corpus: DataFrame, question: Column, styles: Sequence[str] = ALL_STYLES, tokens: str | None = None) -> DataFrame:
    """(traj, idx, a column for each style): each search's query in the ``styles``; ``question`` is a Column of a trajectory.

    A visit's document and note are cut and cleaned once for all styles, an interaction's lines are made once; later searches collect the lines.
    They are cut to words, or to the tokens of the tokenizer whose file ``tokens`` names.
    """
    rows, told = searches(annotated), [s for s in styles if s in STYLES]
    if told:
        sizes = sorted({STYLES[s][3] for s in told if STYLES[s][0]})
        rows = rows.join(_seen(annotated, corpus, question, sizes, any(STYLES[s][1] for s in told), tokens), ["traj", "turn"], "left")
        rows = rows.withColumns({f"past_{s}": F.collect_list(_told(s)).over(before()) for s in told})
    pre = F.coalesce(F.col("pre"), F.lit(""))
    made = lambda s: F.concat_ws("\n", *_head(s, question, F.col("query"), pre), _past(F.col(f"past_{s}"))) if s in told else render(s, question, history=F.array())
    return rows.select("traj", "idx", *[made(s).alias(s) for s in styles])


def _seen(annotated: DataFrame, corpus: DataFrame, question: Column, sizes: list[int], notes: bool, tokens: str | None) -> DataFrame:
    """(traj, turn, v): an interaction's visits in order, [(idx, docid, note, doc<n> for each n of ``sizes``)]."""
    opened = visits(annotated).filter("turn > 0").select("traj", "idx", "turn", "docid", (clean_note("reasoning", question) if notes else F.lit("")).alias("note"))
    if notes:
        opened = opened.withColumn("note", truncate("note", NOTE_WORDS)) if tokens is None else _cut(opened.withColumn("note", one_line("note")), "note", tokens, NOTE_WORDS)
    wanted = opened.select("docid").distinct() if tokens is None or not sizes else written(opened.select("docid").distinct(), "docids")
    for n in sizes:
        shown = _shown(corpus, wanted, n) if tokens is None else _cut(corpus.join(wanted, "docid", "left_semi").select("docid", one_line("text").alias("text")), "text", tokens, n)
        opened = opened.join(shown.select("docid", F.col("text").alias(f"doc{n}")), "docid", "left")
    docs = [F.coalesce(f"doc{n}", F.lit("")).alias(f"doc{n}") for n in sizes]
    return opened.groupBy("traj", "turn").agg(F.sort_array(F.collect_list(F.struct("idx", "docid", "note", *docs))).alias("v"))


def _told(style: str) -> Column:
    """The lines of a row's interaction, of the visits in v."""
    docs, notes, tags, n = STYLES[style]

    def listed(name: str) -> Column:
        items = F.filter(F.transform("v", lambda x: _marked(x[name], tags, x["docid"])), lambda t: t != "")
        return _or_empty(F.coalesce(F.array_join(items, " ; "), F.lit("")))

    return _lines(style, F.col("turn"), F.col("query"), listed(f"doc{n}") if docs else F.lit(""), listed("note") if notes else F.lit(""))


def _or_empty(x: Column) -> Column:
    return F.when(x == "", EMPTY).otherwise(x)


def _tagged(x: Column, tags: bool, n: int, docid: Column | str = "docid") -> Column:
    """The first n words with the document's id before them; empty stays empty."""
    return _marked(truncate(x, n), tags, F.col(docid) if isinstance(docid, str) else docid)


def _marked(x: Column, tags: bool, docid: Column) -> Column:
    return let(x, lambda t: F.when(t == "", "").otherwise(F.concat(F.lit(DOCID), docid, F.lit("] "), t) if tags else t))


def _items(visits_: Column, pick: Callable[[Column], Column], tags: bool, n: int) -> Column:
    return _or_empty(F.array_join(F.filter(F.transform(visits_, lambda v: _tagged(pick(v), tags, n, v["docid"])), lambda t: t != ""), " ; "))


def _lines(style: str, number: Column, query: Column, docs: Column, notes: Column) -> Column:
    """One interaction's lines."""
    shows_docs, shows_notes, _, _ = STYLES[style]
    lines = [F.concat(F.lit(SUBQUERY), number.cast("string"), F.lit(": "), query)]
    if shows_docs:
        lines.append(F.concat(F.lit(DOCUMENTS), docs))
    if shows_notes:
        lines.append(F.concat(F.lit(NOTES), notes))
    return F.concat_ws("\n", *lines)


def _past(lines: Column) -> Column:
    return F.when(F.size(lines) == 0, f"{PAST} {EMPTY}").otherwise(F.concat_ws("\n", F.lit(PAST), F.array_join(lines, "\n")))


def _head(style: str, question: Column, query: Column, pre: Column) -> list[Column]:
    now = [F.concat(F.lit(REASONING), _or_empty(one_line(pre)))] if style == "i7" else []
    return [F.concat(F.lit(QUESTION), question), *now, F.concat(F.lit(NOW), query)]


def render(style: str, question: Column, query: Column = None, history: Column = None, pre: Column = None) -> Column:
    """The query of one style; missing histories are empty ones."""
    query, history, pre = (F.col(n) if x is None else x for n, x in (("query", query), ("history", history), ("pre", pre)))
    pre = F.coalesce(pre, F.lit(""))
    if style == "i0":
        return query
    if style == "i6":
        return F.concat(F.lit(BARE_REASONING), F.when(pre == "", "Empty").otherwise(pre), F.lit("\n\n" + BARE_QUERY), query)
    head = _head(style, question, query, pre)
    if style == "i1":
        return F.concat_ws("\n", *head)
    if style not in STYLES:
        raise ValueError(f"unknown style {style}")
    tags, doc_words = STYLES[style][2:]

    def turn(x: Column, i: Column) -> Column:
        docs = _items(x["visits"], lambda v: v["text"], tags, doc_words)
        notes = _items(x["visits"], lambda v: clean_note(v["reasoning"], question), tags, NOTE_WORDS)
        return _lines(style, i + 1, x["query"], docs, notes)

    return F.concat_ws("\n", *head, _past(F.transform(history, turn)))


def _within(items: Column, budget: int, least: int, text: Callable[[Column], Column] = lambda x: x, length: Callable[[Column], Column] = token_length) -> Column:
    """Items (newest first) until the first one beyond the budget; as none has less than ``least`` words, only so many can count."""
    start = F.struct(F.lit(0).alias("used"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        used = s["used"] + length(x)
        full = s["full"] | (used > budget)
        return F.struct(F.when(full, s["used"]).otherwise(used).alias("used"), full.alias("full"), F.when(full, s["kept"]).otherwise(F.concat(s["kept"], F.array(text(x)))).alias("kept"))

    return F.array_join(F.aggregate(F.slice(items, 1, budget // max(least, 1) + 1), start, step)["kept"], " ; ")


def memory_block(reasonings: Column, question: Column, each: int = MEMORY_EACH, budget: int = MEMORY_ALL, least: int = MEMORY_LEAST) -> Column:
    """Cleaned reasonings (oldest first in, newest first out) of at least ``least`` words until the first one beyond the budget."""
    made = F.filter(F.transform(F.reverse(reasonings), lambda r: clean_reasoning(r, question)), lambda c: token_length(c) >= least)
    return _within(F.transform(made, lambda c: truncate(c, each)), budget, min(least, each))


def with_memories(annotated: DataFrame, question: Column, each: int = MEMORY_EACH, budget: int = MEMORY_ALL, least: int = MEMORY_LEAST, tokens: str | None = None) -> DataFrame:
    """(traj, idx, query, memory): each search with its memory block; a visit's reasoning is cleaned once, not once for each later search.

    ``each`` and ``budget`` count words, or the tokens of the tokenizer whose file ``tokens`` names; ``least`` always counts words.
    """
    noted = (F.col("type") == "visit") & F.col("docid").isNotNull() & (F.col("reasoning") != "")
    if tokens is not None:
        item = F.when(noted, let(clean_reasoning("reasoning", question), lambda c: F.when(token_length(c) >= least, c)))
        rows = _cut(annotated.select("traj", "idx", "type", "query", item.alias("item")), "item", tokens, each)
        said = F.collect_list(F.when(F.col("item").isNotNull(), F.struct("item", "tokens"))).over(before())
        rows = rows.withColumn("items", said).filter("type = 'search'")
        return rows.select("traj", "idx", "query", _within(F.reverse("items"), budget, 1, lambda x: x["item"], lambda x: x["tokens"]).alias("memory"))
    item = F.when(noted, let(clean_reasoning("reasoning", question), lambda c: F.when(token_length(c) >= least, truncate(c, each))))
    said = F.collect_list("item").over(before())
    rows = annotated.select("traj", "idx", "type", "query", item.alias("item")).withColumn("items", said).filter("type = 'search'")
    return rows.select("traj", "idx", "query", _within(F.reverse("items"), budget, min(least, each)).alias("memory"))


def with_memory(annotated: DataFrame) -> DataFrame:
    """(traj, idx, query, reasonings): each search with the non-empty reasonings of all visits before it, oldest first."""
    said = F.collect_list(F.when((F.col("type") == "visit") & F.col("docid").isNotNull() & (F.col("reasoning") != ""), F.col("reasoning"))).over(before())
    return annotated.withColumn("reasonings", said).filter("type = 'search'").select("traj", "idx", "query", "reasonings")


def legacy_query(question: Column, query: Column, memory: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit(LEGACY_QUESTION), question), F.concat(F.lit(LEGACY_NOW), query), F.when(memory != "", F.concat(F.lit(LEGACY_MEMORY), memory)))
