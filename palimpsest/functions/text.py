"""Text cleaning as Column expressions: no function here leaves the JVM.

Regular expressions follow Unicode ``\\s`` and ``\\b`` with Java's ``(?U)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases whose sentences are dropped from reasoning and notes.
NOISE = (
    r"\b(docid|doc id|doc ids|fetch|truncat|internal index|internal database|search tool return|get those|those ids|"
    r"try \d{4,}|not correct|limited fetch|expects specific|different format|full path|the system|the tool)\b"
)
RESTATEMENT = r"(the question[:\s]|the user (asks|mention|want)|question asks|asks[:\s])"
PLAN_VERBS = (
    r"(?:search|verify|check|open|look|try|examine|find|confirm|refine|visit|browse|query|google|think|consider|explore|"
    r"dig|investigate|scroll|request|ask|re-?get|re-?read|retrieve)"
)
PLAN = (
    r"(\blet'?s\s+(?:(?:also|now|then|first|next|just|instead|quickly)\s+)?" + PLAN_VERBS + r"\b"
    r"|\b(?:we|i)\s+(?:need\s+to|should|will|may\s+need\s+to|might|could|can)\s+(?:(?:also|now|then|first|next|just|instead|quickly)\s+)?" + PLAN_VERBS + r"\b"
    r"|^(?:search|try\s+searching|use\s+search)\b"
    r"|\bnext,?\s+(?:search|step|we'?ll|let'?s)\b"
    r"|\bmaybe\s+(?:search|check|try|look)\b)"
)
MAX_OVERLAP, OVERLAP_MORE_THAN = 0.6, 6

Text = Column | str


def _c(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once a row, however often ``f`` refers to it, also inside other lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(x: Text) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def one_line(x: Text) -> Column:
    """Runs of white space as single spaces; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"(?U)\s+", " "))


def words(x: Text) -> Column:
    """Words between white space."""
    line = one_line(x)
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, " "))


def truncate(x: Text, n: int) -> Column:
    """The first n words; what follows them is not looked at. The tokenizer is the white space; for others see ``tokens``."""
    return one_line(F.regexp_extract(F.coalesce(_c(x), F.lit("")), rf"(?U)^\s*+(?:\S++\s++){{0,{n - 1}}}+\S*+", 0)) if n > 0 else F.lit("")


def token_length(x: Text) -> Column:
    return F.size(words(x))


def word_set(x: Text) -> Column:
    """Distinct runs of a-z and 0-9 of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(_c(x), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def sentences(x: Text) -> Column:
    return F.split(strip(F.coalesce(_c(x), F.lit(""))), r"(?U)(?<=[.!?])\s+")


def _says(s: Column, pattern: str) -> Column:
    """Whether ``s`` holds the pattern in any case; Unicode's rules, which cost more, only where there is more than ASCII."""
    return F.when(F.octet_length(s) == F.length(s), s.rlike("(?i)" + pattern)).otherwise(s.rlike("(?iU)" + pattern))


def is_noise(s: Column) -> Column:
    return _says(s, NOISE)


def is_restatement(s: Column) -> Column:
    return _says(s, RESTATEMENT)


def is_plan(s: Column) -> Column:
    return _says(s, PLAN)


def overlaps(s: Column, question_words: Column, most: float = MAX_OVERLAP) -> Column:
    """Whether more than ``most`` of a longer sentence's distinct words are the question's."""

    def many(own: Column) -> Column:
        share = F.size(F.array_intersect(own, question_words)) / F.size(own)
        return (F.size(own) > OVERLAP_MORE_THAN) & (F.size(question_words) > 0) & (share > most)

    return let(word_set(s), many)


def _kept(x: Text) -> Column:
    return F.filter(F.transform(sentences(x), strip), lambda s: s != "")


def clean_reasoning(x: Text, question: Text, most: float = MAX_OVERLAP) -> Column:
    """The sentences that are neither tool mechanics nor a restatement of the question."""
    kept = lambda asked: F.filter(_kept(x), lambda s: ~is_noise(s) & ~is_restatement(s) & ~overlaps(s, asked, most))
    return F.array_join(let(word_set(question), kept), " ")


def clean_note(x: Text, question: Text, most: float = MAX_OVERLAP) -> Column:
    """clean_reasoning without sentences that plan the next step."""
    return F.array_join(F.filter(sentences(clean_reasoning(x, question, most)), lambda s: (strip(s) != "") & ~is_plan(s)), " ")


def title(x: Text, most: int = 50) -> Column:
    """The front matter's title if its second line gives one, else the first line, cut after ``most`` characters with an ellipsis."""
    x = F.coalesce(_c(x), F.lit(""))
    lines = F.split(x, "\n")
    own = F.regexp_replace(strip(F.replace(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), F.lit("title:"), F.lit(""))), '^"+|"+$', "")
    line = strip(F.get(lines, F.lit(0)))
    short = F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("..."))).otherwise(line)
    return F.when(x.startswith("---\ntitle:") & (own != ""), own).otherwise(short)


def snippet(x: Text, n: int = 64) -> Column:
    return truncate(x, n)


def result_text(docid: Text, text: Text, n: int = 64) -> Column:
    """One search result as an agent reads it."""
    return F.concat(F.lit("DocID:"), _c(docid), F.lit("\n["), title(text), F.lit("]\n"), snippet(text, n))


def verdict(x: Text) -> Column:
    """A verifier's answer: the first word after the first ``</think>`` (or of the whole) is RELEVANT."""
    x = F.coalesce(_c(x), F.lit(""))
    at = F.locate("</think>", x)
    rest = F.when(at > 0, F.substring(x, at + 8, F.lit(1 << 30))).otherwise(x)
    return F.coalesce(F.get(words(rest), F.lit(0)) == "RELEVANT", F.lit(False))


def judged_correct(x: Text) -> Column:
    """A judge's answer: the first ``correct: yes`` or ``correct: no``; none is no."""
    return F.lower(F.regexp_extract(F.coalesce(_c(x), F.lit("")), r"(?iU)correct:\s*(yes|no)", 1)) == "yes"


def final_response(result: Text) -> Column:
    """From (type, output) steps: empty if the last is a tool call or holds one, else its output without thoughts."""
    last = F.try_element_at(_c(result), F.lit(-1))
    output = F.coalesce(last["output"], F.lit(""))
    call = (last["type"] == "tool_call") | output.contains("<tool_call>")
    return F.when(last.isNull() | call, "").otherwise(strip(F.regexp_replace(output, r"(?s)<think>.*?</think>", "")))


def judged_response(result: Text, calls: bool = False) -> Column:
    """What a judge reads of (type, output) steps: the last output as it is. Without ``calls`` a tool call, or an output that holds one, is empty."""
    last = F.try_element_at(_c(result), F.lit(-1))
    output = F.coalesce(last["output"], F.lit(""))
    return output if calls else F.when((last["type"] == "tool_call") | output.contains("<tool_call>"), "").otherwise(output)


def original_question(source: Text, messages: Text, query: Text, question: Text) -> Column:
    """A run's question: its metadata's, else the first user's message, else its query, else its question, else empty."""
    said = F.filter(_c(messages), lambda m: m["role"] == "user")
    first = F.when(F.size(said) > 0, F.coalesce(F.get(said, F.lit(0))["content"], F.lit("")))
    some = lambda x: F.when(F.length(_c(x)) > 0, _c(x))
    return F.coalesce(some(source), first, some(query), some(question), F.lit(""))


def no_answer(x: Text) -> Column:
    x = F.coalesce(_c(x), F.lit(""))
    return (strip(x) == "") | x.contains("tool_call") | x.contains("user_query")


def plain_qid(x: Text) -> Column:
    return F.regexp_replace(_c(x).cast("string"), r"\.0$", "")


def safe_name(x: Text) -> Column:
    """For file names: other characters than A-Z a-z 0-9 _ . - become _."""
    return F.regexp_replace(_c(x).cast("string"), r"[^A-Za-z0-9_.\-]", "_")


def rounded(x: Column, digits: int) -> Column:
    """Rounded half away from zero; a number that becomes zero keeps its sign, which Spark's round drops and a file or a hash shows."""
    return F.abs(F.round(x, digits)) * F.signum(x)


def l2_normalize(v: Text) -> Column:
    v = F.transform(_c(v), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def docids_in_output(output: Text) -> Column:
    """Ids after ``DocID:`` at the start of a result text's lines."""
    lines = F.transform(F.split(F.coalesce(_c(output), F.lit("")), "\n"), strip)
    return F.transform(F.filter(lines, lambda s: s.startswith("DocID:")), lambda s: strip(F.substring(s, 7, 1 << 30)))


def browsed_docid(arguments: Text) -> Column:
    """The docid argument of a call (its first if a list), from the last colon on; null if it can't be read."""
    a = _c(arguments)
    one = F.coalesce(F.get_json_object(a, "$.docid[0]"), F.when(~F.coalesce(F.get_json_object(a, "$.docid"), F.lit("[]")).startswith("["), F.get_json_object(a, "$.docid")))
    return F.element_at(F.split(one, ":"), -1)


def searched_query(original: Text, arguments: Text) -> Column:
    """The trace's query if there is one, else the call's (its first if a list), else empty."""
    a = _c(arguments)
    own = F.coalesce(F.get_json_object(a, "$.query[0]"), F.when(~F.coalesce(F.get_json_object(a, "$.query"), F.lit("[]")).startswith("["), F.get_json_object(a, "$.query")))
    return F.coalesce(F.when(F.length(_c(original)) > 0, _c(original)), own, F.lit(""))
