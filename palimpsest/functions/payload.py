"""What tools return as JSON, and what encoders are given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import title

# The encoders' instruction for each style of query.
INSTRUCTIONS = {
    "i0": "Given a web search query, retrieve relevant passages that answer the query",
    "i1": "Given the main question and the current sub-query, retrieve documents relevant to the current sub-query.",
    "i2": "Given the main question, the current sub-query, and the sub-queries already tried in previous interactions, retrieve documents relevant to the current sub-query that provide NEW information not yet found.",
    "i3": "Given the main question, the current sub-query, and previous interactions with the documents already visited, retrieve documents relevant to the current sub-query that provide NEW information beyond the visited documents.",
    "i4": "Given the main question, the current sub-query, and previous interactions with notes taken on the documents already read, retrieve documents relevant to the current sub-query that provide NEW information beyond what the notes cover.",
    "i5": "Given the main question, the current sub-query, and previous interactions with the documents already visited and notes taken on them, retrieve documents relevant to the current sub-query that provide NEW information beyond the visited documents.",
    "i6": "Given the agent's reasoning that led to the current sub-query, retrieve documents relevant to the current sub-query that provide NEW information beyond what the reasoning already covers.",
    "i7": "Given the main question, the agent's reasoning and the current sub-query it led to, and the sub-queries already tried in previous interactions, retrieve documents relevant to the current sub-query that provide NEW information not yet found.",
}
# Fixed value: the note that comes with results that were returned before.
EARLIER = "Relevant docs hidden because an earlier search already returned them — you may NOT have read them yet; use get_document to read any."


def encoder_text(style: Column, query: Column, own: str | None = None) -> Column:
    """The instruction and the query as an encoder reads them; ``plain`` is i0, ``own`` replaces the prefix, other styles fail."""
    if own is not None:
        return F.concat(F.lit(own), query)
    known = F.create_map(*[F.lit(x) for pair in ({"plain": INSTRUCTIONS["i0"]} | INSTRUCTIONS).items() for x in pair])
    found = F.try_element_at(known, style)
    checked = F.when(found.isNull(), F.raise_error(F.concat(F.lit("unknown style "), style))).otherwise(found)
    return F.concat(F.lit("Instruct: "), checked, F.lit("\nQuery: "), query)


def results_json(results: Column, hidden: Column) -> Column:
    """Results [(docid, snippet, score)] as JSON; with hidden ones [(docid, text)] an object that names them too."""
    earlier = F.transform(hidden, lambda h: F.struct(h["docid"].alias("docid"), title(h["text"]).alias("title")))
    both = F.to_json(F.struct(results.alias("results"), F.lit(EARLIER).alias("returned_earlier_note"), earlier.alias("returned_earlier")))
    return F.when(F.size(hidden) > 0, both).otherwise(F.to_json(results))


def docids_in_json(output: Column) -> Column:
    """Docids of a search's output, once each: of its list or its ``results``; if it is no JSON of these, of what looks like them."""
    one = "array<struct<docid:string>>"
    listed = F.when(F.get_json_object(output, "$").startswith("["), F.from_json(output, one))
    within = F.when(F.get_json_object(output, "$.results").startswith("["), F.from_json(F.get_json_object(output, "$.results"), one))
    ids = F.transform(F.coalesce(within, listed), lambda x: x["docid"])
    quoted = F.regexp_extract_all(output, F.lit(r'"docid"\s*:\s*"([^"]+)"'), F.lit(1))
    bare = F.regexp_extract_all(output, F.lit(r'"docid"\s*:\s*(\d+)'), F.lit(1))
    found = F.coalesce(F.filter(ids, lambda x: x.isNotNull()), F.concat(quoted, bare), F.array().cast("array<string>"))
    return F.array_distinct(found)


def fill(template: str, **fields: Column) -> Column:
    """A template with its {fields} filled in; an unknown field fails at once."""
    import string

    parts = []
    for text, name, _, _ in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is not None:
            if name not in fields:
                raise ValueError(f"the template wants {name}")
            parts.append(F.coalesce(fields[name].cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")
