"""The library's registered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import TRAINING
from .functions import payload
from .functions import text as T
from .functions.normalize import normalize
from .operators import control, history, retrieval, scoring, session, supervision, transcript
from .plans import binding as bind
from .plans import steps as st
from .sources.corpus import rename_corpus

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- text

BLANKS = r"[ \t\n\r\f\v]+"
STRIP = rf"regexp_replace(%s, '^{BLANKS}|{BLANKS}$', '', 'g')"
SENTENCES = rf"string_split(regexp_replace({STRIP % 'x'}, '([.!?]){BLANKS}', '\1' || chr(1), 'g'), chr(1))"
WORD_SET = "list_distinct(regexp_extract_all(lower(%s), '[a-z0-9]+'))"
ONE_LINE = rf"trim(regexp_replace(coalesce(%s, ''), '{BLANKS}', ' ', 'g'))"
#: Documents with the item that stands for their question.
ASKED = "a AS (SELECT d.doc_id::VARCHAR AS docid, coalesce(d.text, '') AS x, b.text AS question FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40)"
PARTS = f"{ASKED}, s AS (SELECT docid, question, list_filter({SENTENCES}, lambda s: s <> '') AS s FROM a)"


def quoted(pattern: str) -> str:
    return "'(?i)" + pattern.replace("'", "''") + "'"


OVERLAP = f"NOT (len({WORD_SET % 's'}) > 6 AND len({WORD_SET % 'question'}) > 0 AND len(list_intersect({WORD_SET % 's'}, {WORD_SET % 'question'})) / len({WORD_SET % 's'}) > 0.6)"
NOISE = f"NOT regexp_matches(s, {quoted(T.NOISE)})"
RESTATED = f"NOT regexp_matches(s, {quoted(T.RESTATEMENT)})"
PLANNED = f"NOT regexp_matches(s, {quoted(T.PLAN)})"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bind.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("docid"), F.pmod("doc_id", F.lit(40)).alias("item_id"), "text")
    items = bind.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    return docs.join(items, "item_id")


def _digest(name: str) -> Column:
    return F.md5(F.col(name)).alias("digest")


def _filtered(name: str, keep: Callable[[Column, Column], Column], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        kept = lambda text, question: F.filter(F.filter(F.transform(T.sentences(text), T.strip), lambda s: s != ""), lambda s: keep(s, T.word_set(question)))
        rows = _asked(spark, sf_dir).withColumn("kept", kept("text", "question"))
        return rows.select("docid", F.size("kept").alias("n_kept"), F.md5(F.array_join("kept", " ")).alias("digest"))

    run.__name__ = name
    register(f"WITH {PARTS}, k AS (SELECT docid, list_filter(s, lambda s: {sql}) AS k FROM s) SELECT docid, len(k)::INT AS n_kept, md5(array_to_string(k, ' ')) AS digest FROM k")(run)


_filtered("noise_filter", lambda s, q: ~T.is_noise(s), NOISE)
_filtered("qrest_filter", lambda s, q: ~T.is_restatement(s), RESTATED)
_filtered("overlap_filter", lambda s, q: ~T.overlaps(s, q), OVERLAP)
_filtered("plan_filter", lambda s, q: ~T.is_plan(s), PLANNED)


@register("SELECT doc_id::VARCHAR AS docid, text FROM documents")
def corpus_rename(spark, sf_dir):
    return rename_corpus(bind.table(spark, sf_dir, "documents"), "doc_id", "text")


@register(f"SELECT doc_id::VARCHAR AS docid, len({WORD_SET % 'text'})::INT AS n_words, md5(array_to_string(list_sort({WORD_SET % 'text'}), ' ')) AS digest FROM documents")
def word_sets(spark, sf_dir):
    rows = bind.corpus(spark, sf_dir).withColumn("w", T.word_set("text"))
    return rows.select("docid", F.size("w").alias("n_words"), F.md5(F.array_join(F.array_sort("w"), " ")).alias("digest"))


@register(f"WITH {ASKED} SELECT docid, len({SENTENCES})::INT AS n_sentences, md5(array_to_string({SENTENCES}, '|')) AS digest FROM a")
def sentences(spark, sf_dir):
    rows = _asked(spark, sf_dir).withColumn("s", T.sentences("text"))
    return rows.select("docid", F.size("s").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("digest"))


CLEAN = f"array_to_string(list_filter(s, lambda s: {NOISE} AND {RESTATED} AND {OVERLAP}), ' ')"


@register(f"WITH {PARTS} SELECT docid, md5({CLEAN}) AS digest FROM s")
def clean_reasoning(spark, sf_dir):
    return _asked(spark, sf_dir).withColumn("c", T.clean_reasoning("text", "question")).select("docid", _digest("c"))


@register(f"WITH {PARTS}, c AS (SELECT docid, {CLEAN} AS x FROM s) SELECT docid, md5(array_to_string(list_filter({SENTENCES}, lambda s: s <> '' AND {PLANNED}), ' ')) AS digest FROM c")
def clean_note(spark, sf_dir):
    return _asked(spark, sf_dir).withColumn("c", T.clean_note("text", "question")).select("docid", _digest("c"))


@register(f"SELECT doc_id::VARCHAR AS docid, md5({ONE_LINE % 'text'}) AS digest FROM documents")
def oneline(spark, sf_dir):
    return bind.corpus(spark, sf_dir).withColumn("c", T.one_line("text")).select("docid", _digest("c"))


SNIPPET = f"array_to_string(string_split({ONE_LINE % 'text'}, ' ')[1:%d], ' ')"


@register(f"SELECT doc_id::VARCHAR AS docid, {SNIPPET % 64} AS snippet FROM documents")
def snippet_64(spark, sf_dir):
    return bind.corpus(spark, sf_dir).select("docid", T.snippet("text").alias("snippet"))


@register(f"SELECT doc_id::VARCHAR AS docid, (CASE WHEN {ONE_LINE % 'text'} = '' THEN 0 ELSE len(string_split({ONE_LINE % 'text'}, ' ')) END)::INT AS n_words FROM documents")
def token_len(spark, sf_dir):
    return bind.corpus(spark, sf_dir).select("docid", T.token_length("text").alias("n_words"))


FIRST_LINE = STRIP % "string_split(text, chr(10))[1]"
TITLE = f"CASE WHEN length({FIRST_LINE}) > 50 THEN substr({FIRST_LINE}, 1, 50) || '...' ELSE {FIRST_LINE} END"


@register(f"SELECT doc_id::VARCHAR AS docid, {TITLE} AS title FROM documents")
def title(spark, sf_dir):
    return bind.corpus(spark, sf_dir).select("docid", T.title("text").alias("title"))


@register(f"SELECT doc_id::VARCHAR AS docid, 'DocID:' || doc_id || chr(10) || '[' || {TITLE} || ']' || chr(10) || {SNIPPET % 64} AS result FROM documents")
def format_results(spark, sf_dir):
    return bind.corpus(spark, sf_dir).select("docid", T.result_text("docid", "text").alias("result"))


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verifiers' and judges' answers made of conversations."""
    rows = bind.table(spark, sf_dir, "conversations")
    word = F.when(F.col("turn") % 3 == 0, "RELEVANT").when(F.col("turn") % 3 == 1, "IRRELEVANT").otherwise("RELEVANT.")
    think = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("<think>"), "text", F.lit("</think>\n "))).otherwise("")
    yes = F.when(F.col("turn") % 2 == 0, "Correct: Yes").otherwise("correct:  no, correct: yes")
    return rows.select("conv_id", "turn", F.concat(think, word, F.lit(" "), "text").alias("verdict"), F.concat("text", F.lit("\n"), yes).alias("judged"))


SAID = """v AS (SELECT conv_id, turn, (CASE WHEN conv_id % 2 = 0 THEN '<think>' || text || '</think>' || chr(10) || ' ' ELSE '' END) ||
  (CASE turn % 3 WHEN 0 THEN 'RELEVANT' WHEN 1 THEN 'IRRELEVANT' ELSE 'RELEVANT.' END) || ' ' || text AS verdict,
  text || chr(10) || (CASE WHEN turn % 2 = 0 THEN 'Correct: Yes' ELSE 'correct:  no, correct: yes' END) AS judged FROM conversations)"""


@register(rf"WITH {SAID} SELECT conv_id, turn, coalesce(regexp_extract(CASE WHEN contains(verdict, '</think>') THEN substr(verdict, strpos(verdict, '</think>') + 8) ELSE verdict END, '[^ \t\n\r]+') = 'RELEVANT', false) AS relevant FROM v")
def verdict_parse(spark, sf_dir):
    return _said(spark, sf_dir).select("conv_id", "turn", T.verdict("verdict").alias("relevant"))


@register(rf"WITH {SAID} SELECT conv_id, turn, lower(regexp_extract(judged, '(?i)correct:\s*(yes|no)', 1)) = 'yes' AS correct FROM v")
def judge_parse(spark, sf_dir):
    return _said(spark, sf_dir).select("conv_id", "turn", T.judged_correct("judged").alias("correct"))


NORMAL = r"trim(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(coalesce(%s, '')), '[^\x00-\x7F]', '', 'g')), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@register(f"SELECT d.doc_id::VARCHAR AS docid, contains({NORMAL % 'd.text'}, {NORMAL % 'b.text'}) AND coalesce(d.text, '') <> '' AS correct FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40")
def norm_match(spark, sf_dir):
    return _asked(spark, sf_dir).select("docid", scoring.exact_match(F.col("question"), F.col("text")).alias("correct"))


@register(f"SELECT conv_id, turn, md5({NORMAL % 'text'}) AS digest FROM conversations")
def normalized(spark, sf_dir):
    return bind.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(normalize(F.col("text"))).alias("digest"))


# ---- retrieval


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = bind.table(spark, sf_dir, "embeddings")
    return rows.filter("vec_id % 50 = 0").select(F.col("vec_id").cast("string").alias("qid"), "embedding"), rows.select(F.col("vec_id").cast("string").alias("docid"), "embedding")


def _best(k: int, scored: str) -> str:
    return f"SELECT qid, docid, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid)::INT AS rank FROM ({scored})) WHERE rank <= {k}"


INNER = "round(list_inner_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6)"


@register(_best(10, f"SELECT q.vec_id::VARCHAR AS qid, d.vec_id::VARCHAR AS docid, {INNER} AS score FROM embeddings q, embeddings d WHERE q.vec_id % 50 = 0"))
def dense_topk(spark, sf_dir):
    return retrieval.dense_topk(*_vectors(spark, sf_dir))


@register()
def dense_ann_recall(spark, sf_dir):
    queries, docs = _vectors(spark, sf_dir)
    return retrieval.recall(retrieval.Cells(docs).search(queries), retrieval.dense_topk(queries, docs))


@register("SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 6)) AS unit FROM embeddings")
def l2_normalize(spark, sf_dir):
    return bind.table(spark, sf_dir, "embeddings").select("vec_id", F.transform(T.l2_normalize("embedding"), lambda x: T.rounded(x, 6)).alias("unit"))


BM25 = """WITH w AS (SELECT doc_id::VARCHAR AS docid, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
t AS (SELECT docid, len(w) AS len, unnest(w) AS term FROM w), p AS (SELECT docid, term, len, count(*) AS tf FROM t GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term), n AS (SELECT count(*) AS n, avg(len(w)) AS avg FROM w),
q AS (SELECT item_id::VARCHAR AS qid, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM benchmark),
h AS (SELECT qid, docid, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * len / avg))), 6) AS score
  FROM q JOIN p USING (term) JOIN f USING (term), n GROUP BY qid, docid)
"""


@register(BM25 + _best(10, "SELECT * FROM h"))
def bm25_topk(spark, sf_dir):
    items = bind.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return retrieval.bm25_topk(items, bind.corpus(spark, sf_dir))


@register("WITH w AS (SELECT regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents) SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS total_len, (SELECT count(DISTINCT t) FROM (SELECT unnest(w) AS t FROM w)) AS n_terms FROM w")
def bm25_stats(spark, sf_dir):
    return retrieval.bm25_stats(bind.corpus(spark, sf_dir))


WANTED = "SELECT DISTINCT (k * 13)::VARCHAR AS docid FROM st"


@register(f"WITH {bind.STEPS}, w AS ({WANTED}) SELECT w.docid, cor.text FROM w LEFT JOIN cor USING (docid)")
def get_document(spark, sf_dir):
    return retrieval.get_documents(_wanted(spark, sf_dir), bind.corpus(spark, sf_dir))


@register(f"WITH {bind.STEPS}, w AS ({WANTED}) SELECT w.docid, CASE WHEN text IS NULL THEN 'Document not found: ' || w.docid ELSE {SNIPPET % 512} END AS view FROM w LEFT JOIN cor USING (docid)")
def document_view(spark, sf_dir):
    return retrieval.document_view(_wanted(spark, sf_dir), bind.corpus(spark, sf_dir))


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return bind.table(spark, sf_dir, "events").select((k * 13).cast("string").alias("docid")).distinct()


# ---- steps and sessions


def stepped(head: str, body: str) -> Callable[[Callable], Query]:
    """Registers a query over the annotated steps."""

    def add(f: Callable) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir, bind.annotated(spark, sf_dir))

        run.__name__ = f.__name__
        return register(f"WITH {', '.join(x for x in (bind.STEPS, head) if x)} {body}")(run)

    return add


@stepped("", "SELECT docid FROM ret UNION SELECT docid FROM vis")
def needed_docids(spark, sf_dir, an):
    return st.needed_docids(an)


@stepped("", "SELECT docid, text FROM cor WHERE docid IN (SELECT docid FROM ret UNION SELECT docid FROM vis)")
def corpus_semi_filter(spark, sf_dir, an):
    return bind.corpus(spark, sf_dir).join(st.needed_docids(an), "docid", "left_semi")


@stepped("", "SELECT traj, idx, returned AS docids FROM st WHERE type = 'search'")
def returned_docids(spark, sf_dir, an):
    text = F.concat(F.lit("Results\n"), F.array_join(F.transform("returned", lambda d: F.concat(F.lit("DocID: "), d, F.lit("\n[x]"))), "\n"))
    return an.filter("type = 'search'").select("traj", "idx", T.docids_in_output(text).alias("docids"))


@stepped("", "SELECT traj, idx, reasoning FROM vis")
def reasoning_after(spark, sf_dir, an):
    return st.visits(an).select("traj", "idx", "reasoning")


@stepped(bind.PRE, "SELECT traj, idx, pre FROM pre")
def reasoning_before(spark, sf_dir, an):
    return st.searches(an).select("traj", "idx", "pre")


@stepped("", "SELECT traj, docid, idx FROM vis WHERE first")
def first_visits(spark, sf_dir, an):
    return st.visits(an).filter("first").select("traj", "docid", "idx")


@stepped("", "SELECT traj, idx, docid, snap FROM vis")
def asof_snapshot(spark, sf_dir, an):
    return st.visits(an).select("traj", "idx", "docid", "snap")


POOLS = """p AS (SELECT label AS traj, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS step, list_transform(range(0, 40), lambda i: ((vec_id * 3 + 11 * i) % 97)::VARCHAR) AS docids FROM embeddings),
f AS (SELECT traj, step, docids[1:10] AS results, []::VARCHAR[] AS hidden, docids[1:10] AS seen FROM p WHERE step = 1
  UNION ALL SELECT p.traj, p.step, x.results, list_filter(p.docids[1:10], lambda d: list_contains(f.seen, d)), list_concat(f.seen, x.results)
  FROM f JOIN p ON p.traj = f.traj AND p.step = f.step + 1, LATERAL (SELECT list_filter(p.docids, lambda d: NOT list_contains(f.seen, d))[1:10] AS results) x)"""


def _pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    step = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).cast("bigint")
    ids = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.pmod(F.col("vec_id") * 3 + 11 * i, F.lit(97)).cast("string"))
    return bind.table(spark, sf_dir, "embeddings").select(F.col("label").alias("traj"), step.alias("step"), ids.alias("docids"))


@register(f"WITH RECURSIVE {POOLS} SELECT traj, step, results FROM f")
def dedup_search(spark, sf_dir):
    return session.dedup_search(_pools(spark, sf_dir)).select("traj", "step", "results")


@register(f"WITH RECURSIVE {POOLS} SELECT traj, step, hidden FROM f")
def hidden_docs(spark, sf_dir):
    return session.dedup_search(_pools(spark, sf_dir)).select("traj", "step", "hidden")


FIRST = "coalesce((SELECT list(d ORDER BY i, p) FROM (SELECT docid AS d, min(idx) AS i, arg_min(place, idx * 100 + place) AS p FROM %s b WHERE b.traj = s.traj AND b.idx < s.idx GROUP BY docid)), [])"


@stepped("v AS (SELECT *, 0 AS place FROM vis)", f"SELECT s.traj, s.idx, s.query, {FIRST % 'ret'} AS found_before, coalesce((SELECT list(b.query ORDER BY b.idx) FROM st b WHERE b.traj = s.traj AND b.idx < s.idx AND b.type = 'search'), []) AS queries_before, {FIRST % 'v'} AS visited_before FROM st s WHERE s.type = 'search'")
def search_trace(spark, sf_dir, an):
    return session.search_trace(an)


@stepped("", "SELECT s.traj, s.turn::BIGINT AS turn, s.query, coalesce((SELECT list(v.docid ORDER BY v.idx) FROM vis v WHERE v.traj = s.traj AND v.turn = s.turn), []) AS docids FROM an s WHERE s.type = 'search'")
def interactions(spark, sf_dir, an):
    return session.interactions(an)


@stepped("", "SELECT traj, count(*) FILTER (type = 'search') AS searches, count(*) FILTER (type = 'visit') AS visits, count(*) FILTER (type = 'visit' AND docid IN (SELECT docid FROM cor)) AS found, count(*) AS calls FROM st WHERE type <> 'reasoning' GROUP BY traj")
def call_counts(spark, sf_dir, an):
    return session.call_counts(an, bind.corpus(spark, sf_dir))


@stepped("x AS (SELECT traj, count(*) FILTER (type <> 'reasoning') AS calls, arg_max(type, idx) AS last FROM st GROUP BY traj), l AS (SELECT traj, CASE WHEN last = 'reasoning' THEN 'answer' WHEN calls >= 50 THEN 'exceed available llm calls' ELSE 'answer not found' END AS label FROM x)", "SELECT traj, label, CASE WHEN label = 'answer' THEN 'completed' ELSE label END AS status FROM l")
def termination(spark, sf_dir, an):
    return session.termination(an)


@stepped("f AS (SELECT traj, idx, count(*) AS new FROM (SELECT traj, docid, min(idx) AS idx FROM ret GROUP BY ALL) GROUP BY ALL)", "SELECT turn::BIGINT AS turn, count(*) AS searches, avg(coalesce(new, 0)) AS novel FROM an LEFT JOIN f USING (traj, idx) WHERE type = 'search' GROUP BY turn")
def novelty_by_step(spark, sf_dir, an):
    return session.novelty_by_step(an)


@stepped("o AS (SELECT v.traj, v.docid, v.idx, (SELECT max(r.idx) FROM ret r WHERE r.traj = v.traj AND r.docid = v.docid) AS last FROM vis v WHERE first)", "SELECT count(*) AS opened, count(*) FILTER (last > idx) AS resurfaced, count(*) FILTER (last > idx) / count(*) AS rate FROM o")
def resurface_rate(spark, sf_dir, an):
    return session.resurface_rate(an)


# ---- history

ASK = "'Which item did user ' || traj || ' observe and what value was useful?'"
#: By the binding, a note keeps its first sentence: the second tells of the tool, the third plans.
NOTE = "CASE WHEN reasoning = '' THEN '' ELSE regexp_extract(reasoning, '^[^.]*\\.') END"
DOC_64 = f"array_to_string(string_split({ONE_LINE % 'text'}, ' ')[1:64], ' ')"
TURNS = f"""vt AS (SELECT v.traj, v.turn,
    coalesce(string_agg({DOC_64}, ' ; ' ORDER BY v.idx) FILTER ({DOC_64} <> ''), '<empty>') AS docs,
    coalesce(string_agg({NOTE}, ' ; ' ORDER BY v.idx) FILTER ({NOTE} <> ''), '<empty>') AS notes,
    coalesce(string_agg('[docs_id:' || v.docid || '] ' || {NOTE}, ' ; ' ORDER BY v.idx) FILTER ({NOTE} <> ''), '<empty>') AS tagged
  FROM vis v LEFT JOIN cor USING (docid) WHERE turn > 0 GROUP BY ALL),
sq AS (SELECT s.traj, s.idx, s.turn, s.query, coalesce(docs, '<empty>') AS docs, coalesce(notes, '<empty>') AS notes, coalesce(tagged, '<empty>') AS tagged FROM an s LEFT JOIN vt USING (traj, turn) WHERE s.type = 'search')"""


def _rendered(style: str) -> tuple[str, str]:
    line = {"i2": "", "i7": "", "i3": " || chr(10) || 'Visited Documents: ' || docs", "i4": " || chr(10) || 'Visited Document Notes: ' || tagged", "i5": " || chr(10) || 'Visited Documents: ' || docs || chr(10) || 'Visited Document Notes: ' || notes"}
    if style == "i0":
        return bind.PRE, "SELECT traj, idx, query AS rendered FROM st WHERE type = 'search'"
    if style == "i6":
        return bind.PRE, "SELECT traj, idx, 'Reasoning: ' || (CASE WHEN pre = '' THEN 'Empty' ELSE pre END) || chr(10) || chr(10) || 'Query: ' || query AS rendered FROM st JOIN pre USING (traj, idx)"
    now = " || 'Current Reasoning: ' || (CASE WHEN pre = '' THEN '<empty>' ELSE pre END) || chr(10)" if style == "i7" else ""
    head = f"'Main Question: ' || {ASK} || chr(10){now} || 'Current Subquery: ' || query"
    if style == "i1":
        return bind.PRE, f"SELECT traj, idx, {head} AS rendered FROM st WHERE type = 'search'"
    past = f"string_agg('Previous SubQuery ' || turn || ': ' || query{line[style]}, chr(10)) OVER (PARTITION BY traj ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"{bind.PRE}, {TURNS}, hq AS (SELECT *, {past} AS past FROM sq)", f"SELECT traj, idx, {head} || chr(10) || coalesce('Previous Interactions:' || chr(10) || past, 'Previous Interactions: <empty>') AS rendered FROM hq JOIN pre USING (traj, idx)"


def _render(style: str) -> None:
    def run(spark: SparkSession, sf_dir: str, an: DataFrame) -> DataFrame:
        return history.rendered(an, bind.corpus(spark, sf_dir), bind.question(), style).select("traj", "idx", F.md5("rendered").alias("digest"))

    run.__name__ = f"render_{style}"
    head, body = _rendered(style)
    stepped(f"{head}, rendered AS ({body})", "SELECT traj, idx, md5(rendered) AS digest FROM rendered")(run)


for _style in history.ALL_STYLES:
    _render(_style)

#: A memory item is a note of nine words and its plan, under 64 words in all; 256 words hold the newest of them.
MEMORY = f"""ms AS (SELECT s.traj, s.idx, s.query, v.idx AS vidx, regexp_extract(v.reasoning, '^[^.]*\\.') || regexp_replace(v.reasoning, '^[^!]*!', '') AS item FROM st s LEFT JOIN vis v ON v.traj = s.traj AND v.idx < s.idx AND v.reasoning <> '' WHERE s.type = 'search'),
mu AS (SELECT *, sum(len(string_split(item, ' '))) OVER (PARTITION BY traj, idx ORDER BY vidx DESC) AS used FROM ms),
mb AS (SELECT traj, idx, any_value(query) AS query, coalesce(string_agg(item, ' ; ' ORDER BY vidx DESC) FILTER (item IS NOT NULL AND used <= 256), '') AS memory FROM mu GROUP BY traj, idx)"""


def _memory(an: DataFrame) -> DataFrame:
    return history.with_memories(an, bind.question())


@stepped(MEMORY, "SELECT traj, idx, md5(memory) AS digest FROM mb")
def memory_block(spark, sf_dir, an):
    return _memory(an).select("traj", "idx", _digest("memory"))


@stepped(MEMORY, f"SELECT traj, idx, md5('[Q] ' || {ASK} || chr(10) || '[Now] ' || query || CASE WHEN memory <> '' THEN chr(10) || '[Memory] ' || memory ELSE '' END) AS digest FROM mb")
def legacy_query(spark, sf_dir, an):
    return _memory(an).withColumn("q", history.legacy_query(bind.question(), F.col("query"), F.col("memory"))).select("traj", "idx", _digest("q"))


# ---- supervision


def _chosen(spark: SparkSession, sf_dir: str, an: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return supervision.positives(an, bind.corpus(spark, sf_dir), bind.verdicts(spark, sf_dir)), bind.corpus(spark, sf_dir), bind.verdicts(spark, sf_dir)


def _groups(spark: SparkSession, sf_dir: str, an: DataFrame) -> DataFrame:
    chosen, corpus, verdicts = _chosen(spark, sf_dir, an)
    return supervision.groups(chosen, supervision.negatives(an, chosen, corpus, verdicts))


NEGS, GRPS = f"{bind.POSITIVES}, {bind.NEGATIVES}", f"{bind.POSITIVES}, {bind.NEGATIVES}, {bind.GROUPS}"


@stepped(bind.POSITIVES, "SELECT traj, idx, snap, docid, reasoning FROM pos")
def positives(spark, sf_dir, an):
    return _chosen(spark, sf_dir, an)[0]


@stepped(NEGS, "SELECT traj, idx, tier, place, neg FROM neg")
def neg_tiers(spark, sf_dir, an):
    return supervision.negatives(an, *_chosen(spark, sf_dir, an))


@stepped(GRPS, "SELECT * FROM grp")
def groups(spark, sf_dir, an):
    return _groups(spark, sf_dir, an)


#: Group lengths vary by step in the binding, as a search's group takes its place for a length.
@stepped(f"{GRPS}, l AS (SELECT traj, idx, reasoning_len * (idx % 7) AS len FROM grp), h AS (SELECT median(len) FILTER (len > 0) AS half FROM l), r AS (SELECT traj, idx, CASE WHEN len > 0 THEN 1 - exp(-len * ln(2) / half) END AS raw FROM l, h)", "SELECT traj, idx, round(coalesce(raw / (SELECT avg(raw) FROM r), 1.0), 9) AS reweight_rate FROM r")
def reweight(spark, sf_dir, an):
    rows = _groups(spark, sf_dir, an).withColumn("reasoning_len", F.col("reasoning_len") * (F.col("idx") % 7))
    return supervision.reweight(rows).select("traj", "idx", F.round("reweight_rate", 9).alias("reweight_rate"))


@stepped(GRPS, "SELECT count(*) AS groups, avg(len(neg_diversity_id)) AS avg_diversity, avg(len(neg_hard_id)) AS avg_hard, avg(len(neg_weak_id)) AS avg_weak FROM grp")
def tier_stats(spark, sf_dir, an):
    return supervision.tier_stats(_groups(spark, sf_dir, an))


@stepped(f"{NEGS}, n AS (SELECT *, row_number() OVER (PARTITION BY traj, idx, tier ORDER BY place, neg) AS n FROM neg), m AS (SELECT *, row_number() OVER (PARTITION BY traj, idx ORDER BY (CASE WHEN tier = 'weak' THEN 1 ELSE 0 END), tier, n) AS m FROM n WHERE n <= CASE tier WHEN 'weak' THEN 9 ELSE 3 END)", "SELECT traj, idx, tier, neg FROM m WHERE m <= 9")
def group_sample(spark, sf_dir, an):
    return supervision.group_sample(supervision.negatives(an, *_chosen(spark, sf_dir, an)), F.col("place"))


CLAIM = """c AS (SELECT v.traj, v.idx, v.docid, s.query FROM vis v JOIN st s ON s.traj = v.traj AND s.idx = v.snap WHERE v.first AND (v.traj, v.docid) IN (SELECT (traj, docid) FROM ret) AND v.docid IN (SELECT docid FROM cor)),
cn AS (SELECT *, row_number() OVER (PARTITION BY query, docid ORDER BY traj, idx) AS nth FROM c),
ln AS (SELECT *, row_number() OVER (PARTITION BY query, docid ORDER BY line) AS nth FROM (SELECT traj * 1000000 + idx AS line, query, docid FROM c WHERE docid IN (SELECT docid FROM rel))),
x AS (SELECT line, l.query, l.docid, cn.traj, cn.idx FROM ln l LEFT JOIN cn ON cn.query = l.query AND cn.docid = l.docid AND cn.nth = l.nth)"""


def _claimed(spark: SparkSession, sf_dir: str, an: DataFrame) -> DataFrame:
    asked = st.searches(an).select("traj", F.col("idx").alias("snap"), "query")
    found = supervision.candidates(an, bind.corpus(spark, sf_dir)).join(asked, ["traj", "snap"]).select("traj", "idx", "docid", "query")
    good = bind.verdicts(spark, sf_dir).filter("relevant").select("docid")
    lines = found.join(good, "docid", "left_semi").select((F.col("traj") * 1000000 + F.col("idx")).alias("line"), "query", "docid")
    return supervision.claim(lines, found, ["query", "docid"], "line", ["traj", "idx"]).select("l.line", "l.query", "l.docid", "r.traj", "r.idx")


@stepped(CLAIM, "SELECT * FROM x")
def multiset_match(spark, sf_dir, an):
    return _claimed(spark, sf_dir, an)


@stepped(CLAIM, "SELECT count(*) AS lines, count(*) FILTER (traj IS NULL) AS unmatched FROM x")
def unmatched_lines(spark, sf_dir, an):
    return _claimed(spark, sf_dir, an).agg(F.count(F.lit(1)).alias("lines"), F.count(F.when(F.col("traj").isNull(), 1)).alias("unmatched"))


@stepped(f"{bind.PRE}, y AS (SELECT traj, idx, 'i0' AS style, query AS q FROM st WHERE type = 'search' UNION ALL SELECT traj, idx, 'i1', 'Main Question: ' || {ASK} || chr(10) || 'Current Subquery: ' || query FROM st WHERE type = 'search' UNION ALL SELECT traj, idx, 'i6', 'Reasoning: ' || (CASE WHEN pre = '' THEN 'Empty' ELSE pre END) || chr(10) || chr(10) || 'Query: ' || query FROM st JOIN pre USING (traj, idx))", "SELECT traj, idx, style, md5(q) AS digest FROM y")
def styles_fanout(spark, sf_dir, an):
    rows = st.searches(an).withColumn("question", bind.question())
    none = F.array().cast(f"array<struct<query:string,visits:{history.VISIT}>>")
    styles = {s: history.render(s, F.col("question"), history=none) for s in ("i0", "i1", "i6")}
    return supervision.fan_out(rows, styles).select("traj", "idx", "style", _digest("styled_query"))


# ---- transcripts and scoring

MESSAGES = """m AS (SELECT conv_id AS traj, turn, role, CASE role
  WHEN 'assistant' THEN '<think> look ' || turn || ' </think>' || text || '<tool_call>{"name": "search", "arguments": {"query": "q' || turn || '"}}</tool_call><tool_call>not json</tool_call>'
  ELSE '<tool_response>' || chr(10) || 'hit ' || turn || chr(10) || '</tool_response>' || text END AS content FROM conversations),
n AS (SELECT *, lead(turn) OVER w IS NULL AS last, lead(role) OVER w AS next_role, lead(turn) OVER w AS next_turn FROM m WINDOW w AS (PARTITION BY traj ORDER BY turn)),
s AS (SELECT traj, turn, 0 AS place, 'reasoning' AS type, NULL AS tool_name, NULL AS arguments, 'look ' || turn AS output FROM n WHERE role = 'assistant' AND NOT last
  UNION ALL SELECT traj, turn, 1, 'tool_call', 'search', '{"query":"q' || turn || '"}', CASE WHEN next_role = 'user' THEN 'hit ' || next_turn ELSE '' END FROM n WHERE role = 'assistant' AND NOT last
  UNION ALL SELECT traj, turn, 2, 'output_text', NULL, NULL, content FROM n WHERE last),
t AS (SELECT traj, row_number() OVER (PARTITION BY traj ORDER BY turn, place) AS idx, type, tool_name, arguments, output FROM s)"""


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    call = F.concat(F.lit('<tool_call>{"name": "search", "arguments": {"query": "q'), F.col("turn"), F.lit('"}}</tool_call><tool_call>not json</tool_call>'))
    agent = F.concat(F.lit("<think> look "), F.col("turn"), F.lit(" </think>"), F.col("text"), call)
    other = F.concat(F.lit("<tool_response>\nhit "), F.col("turn"), F.lit("\n</tool_response>"), F.col("text"))
    return bind.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("traj"), "turn", "role", F.when(F.col("role") == "assistant", agent).otherwise(other).alias("content"))


@register(f"WITH {MESSAGES} SELECT * FROM t")
def parse_messages(spark, sf_dir):
    return transcript.parse_messages(_messages(spark, sf_dir))


@register(f"WITH {MESSAGES}, c AS (SELECT *, row_number() OVER (PARTITION BY traj ORDER BY idx) AS nth FROM t WHERE type = 'tool_call') SELECT t.traj, t.idx, t.type, t.tool_name, t.arguments, t.output, CASE WHEN c.nth <= 2 THEN [(t.traj % 7)::VARCHAR, c.nth::VARCHAR] END AS returned_docids FROM t LEFT JOIN c USING (traj, idx)")
def attach_traces(spark, sf_dir):
    steps = transcript.parse_messages(_messages(spark, sf_dir))
    runs = bind.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("traj")).distinct()
    nth = F.explode(F.array(F.lit(1), F.lit(2)))
    traces = runs.select("traj", nth.alias("nth")).select("traj", "nth", F.lit("search").alias("tool_name"), F.array((F.col("traj") % 7).cast("string"), F.col("nth").cast("string")).alias("returned_docids"))
    return transcript.attach_traces(steps, traces)


@register(rf"WITH {MESSAGES}, r AS (SELECT traj, arg_max(output, idx) AS x FROM t GROUP BY traj) SELECT traj, CASE WHEN contains(x, '<tool_call>') THEN '' ELSE {STRIP % 'x'} END AS response FROM r")
def final_response(spark, sf_dir):
    steps = transcript.parse_messages(_messages(spark, sf_dir))
    last = steps.groupBy("traj").agg(F.max_by(F.struct("type", "output"), "idx").alias("last"))
    return last.select("traj", T.final_response(F.array("last")).alias("response"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs made of documents: the response is the text, the question the item doc_id mod 60 (of which some have no truth)."""
    docs = bind.table(spark, sf_dir, "documents")
    near = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.pmod(F.col("doc_id") + i * 3, F.lit(20)).cast("string"))
    return docs.select(F.concat(F.pmod("doc_id", F.lit(60)).cast("string"), F.lit(".0")).alias("raw"), F.col("source").alias("arm"), F.coalesce("text", F.lit("")).alias("response"), F.pmod("doc_id", F.lit(50)).cast("double").alias("steps"), F.array_distinct(near).alias("retrieved"), (F.col("doc_id") % 3 == 0).alias("correct"), "doc_id").withColumn("qid", T.plain_qid("raw"))


RUNS = "ru AS (SELECT doc_id, (doc_id % 60)::VARCHAR AS qid, source AS arm, coalesce(text, '') AS response, (doc_id % 50)::DOUBLE AS steps, list_distinct(list_transform(range(0, 5), lambda i: ((doc_id + i * 3) % 20)::VARCHAR)) AS retrieved, doc_id % 3 = 0 AS correct FROM documents), qr AS (SELECT DISTINCT (item_id % 50)::VARCHAR AS qid, (item_id * i % 20)::VARCHAR AS docid FROM benchmark, (SELECT unnest([1, 3, 7]) AS i)), g AS (SELECT qid, list(docid) AS gold FROM qr GROUP BY qid)"


def _qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.explode(F.array(F.lit(1), F.lit(3), F.lit(7)))
    return bind.table(spark, sf_dir, "benchmark").select("item_id", i.alias("i")).select((F.col("item_id") % 50).cast("string").alias("qid"), (F.col("item_id") * F.col("i") % 20).cast("string").alias("docid")).distinct()


@register(f"WITH {RUNS}, b AS (SELECT contains({NORMAL % 'response'}, {NORMAL % 'b.text'}) AND response <> '' AS correct, steps FROM ru JOIN benchmark b ON b.item_id::VARCHAR = qid) SELECT count(*) AS n, avg(correct::INT) AS sr, avg(steps) AS avg_steps FROM b")
def exact_match_report(spark, sf_dir):
    truth = bind.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("qid"), F.col("text").alias("answer"))
    return scoring.exact_match_report(_runs(spark, sf_dir), truth)


SHARE = "coalesce(len(list_intersect(retrieved, gold)) / len(gold), 0.0)"


@register(f"WITH {RUNS} SELECT arm, count(*) AS n, avg(correct::INT) AS success_rate, avg(steps) AS avg_steps, avg({SHARE}) AS recall FROM ru LEFT JOIN g USING (qid) GROUP BY arm")
def judge_report(spark, sf_dir):
    return scoring.judge_report(_runs(spark, sf_dir), _qrels(spark, sf_dir))


@register(f"WITH {RUNS} SELECT doc_id, {SHARE} AS recall FROM ru LEFT JOIN g USING (qid)")
def evidence_recall(spark, sf_dir):
    runs = _runs(spark, sf_dir).select(F.concat("qid", F.lit("|"), "doc_id").alias("run"), "qid", "retrieved")
    marked = runs.select(F.col("run").alias("qid"), "retrieved")
    gold = runs.select("run", "qid").join(_qrels(spark, sf_dir), "qid").select(F.col("run").alias("qid"), "docid")
    return scoring.evidence_recall(marked, gold).select(F.split("qid", r"\|")[1].cast("bigint").alias("doc_id"), "recall")


@register("SELECT count(*) FILTER (role = 'user' OR trim(text) = '') AS failed, count(*) FILTER (NOT (role = 'user' OR trim(text) = '')) AS to_judge FROM conversations")
def auto_fail(spark, sf_dir):
    said = F.when(F.col("role") == "user", F.concat(F.lit("user_query "), "text")).otherwise(F.col("text"))
    return scoring.auto_fail(bind.table(spark, sf_dir, "conversations"), T.no_answer(said))


@stepped("""n AS (SELECT count(*) AS n FROM rel), s AS (SELECT traj, count(DISTINCT docid) AS s FROM ret WHERE docid IN (SELECT docid FROM rel) GROUP BY traj), v AS (SELECT traj, count(DISTINCT docid) AS v FROM vis WHERE docid IN (SELECT docid FROM rel) GROUP BY traj),
r AS (SELECT t.traj, coalesce(s, 0) / n AS search_recall, coalesce(v, 0) / n AS visit_recall FROM (SELECT DISTINCT traj FROM st) t CROSS JOIN n LEFT JOIN s USING (traj) LEFT JOIN v USING (traj))""", "SELECT *, CASE WHEN search_recall > 0 THEN visit_recall / search_recall END AS ratio FROM r")
def search_visit_recall(spark, sf_dir, an):
    good = bind.verdicts(spark, sf_dir).filter("relevant").select("docid").distinct()
    return scoring.shared_recall(an.select("traj").distinct(), st.returned_ids(an).select("traj", "docid"), st.visits(an).select("traj", "docid"), good)


@stepped("d AS (SELECT DISTINCT traj FROM st WHERE type = 'visit' AND k < 5)", "SELECT DISTINCT traj FROM st WHERE traj NOT IN (SELECT traj FROM d)")
def resume_pending(spark, sf_dir, an):
    done = an.filter(F.col("docid").cast("int") < 5).select("traj").distinct()
    return control.pending(an.select("traj").distinct(), done, "traj")


@register("SELECT item_id FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS p FROM benchmark) WHERE p % 4 = 1")
def strided_shard(spark, sf_dir):
    return control.shard(bind.table(spark, sf_dir, "benchmark").select("item_id"), "item_id", 4, 1)


@stepped("", "SELECT traj, sum(CASE WHEN type = 'search' THEN 1 ELSE 0 END)::DOUBLE + sum(CASE WHEN type = 'visit' THEN 1 ELSE 0 END)::DOUBLE AS steps FROM st GROUP BY traj")
def steps(spark, sf_dir, an):
    counts = an.groupBy("traj").agg(F.count(F.when(F.col("type") == "search", 1)).cast("double").alias("s"), F.count(F.when(F.col("type") == "visit", 1)).cast("double").alias("v"))
    return counts.select("traj", scoring.steps_of(F.create_map(F.lit("search"), F.col("s"), F.lit("get_document"), F.col("v"))).alias("steps"))


# ---- payloads, prefixes and the rest

PREFIX = """CASE idx % 3
  WHEN 0 THEN 'Instruct: Given a web search query, retrieve relevant passages that answer the query'
  WHEN 1 THEN 'Instruct: Given the main question, the current sub-query, and the sub-queries already tried in previous interactions, retrieve documents relevant to the current sub-query that provide NEW information not yet found.'
  ELSE 'Instruct: Given the main question and the current sub-query, retrieve documents relevant to the current sub-query.'
END || chr(10) || 'Query: ' || query"""


@stepped("", f"SELECT traj, idx, {PREFIX} AS encoded FROM st WHERE type = 'search'")
def encoder_query(spark, sf_dir, an):
    style = F.when(F.col("idx") % 3 == 0, "plain").when(F.col("idx") % 3 == 1, "i2").otherwise("i1")
    return st.searches(an).select("traj", "idx", payload.encoder_text(style, F.col("query")).alias("encoded"))


@stepped("", "SELECT traj, idx, returned AS docids FROM st WHERE type = 'search'")
def docids_from_json(spark, sf_dir, an):
    listed = F.to_json(F.transform("returned", lambda d: F.struct(d.alias("docid"), F.lit("x").alias("snippet"))))
    output = F.when(F.col("idx") % 3 == 0, listed).when(F.col("idx") % 3 == 1, F.concat(F.lit('{"results": '), listed, F.lit("}"))).otherwise(F.concat(F.lit("cut "), listed))
    return st.searches(an).select("traj", "idx", payload.docids_in_json(output).alias("docids"))


@register(f"SELECT doc_id::VARCHAR AS docid, '[{{\"docid\":\"' || doc_id || '\",\"score\":1.5}}]' AS plain, '{{\"results\":[{{\"docid\":\"' || doc_id || '\",\"score\":1.5}}],\"returned_earlier_note\":\"Relevant docs hidden because an earlier search already returned them — you may NOT have read them yet; use get_document to read any.\",\"returned_earlier\":[{{\"docid\":\"' || doc_id || '\",\"title\":' || to_json({TITLE}) || '}}]}}' AS both FROM documents")
def json_payload(spark, sf_dir):
    rows = bind.corpus(spark, sf_dir)
    results = F.array(F.struct("docid", F.lit(1.5).alias("score")))
    hidden = F.array(F.struct("docid", "text"))
    return rows.select("docid", payload.results_json(results, F.slice(hidden, 1, 0)).alias("plain"), payload.results_json(results, hidden).alias("both"))


@register(f"WITH {RUNS} SELECT avg(steps) AS avg_steps, avg({SHARE}) AS recall, count(*) AS n FROM ru LEFT JOIN g USING (qid)")
def recall_only(spark, sf_dir):
    runs = _runs(spark, sf_dir).withColumn("arm", F.lit("all"))
    return scoring.judge_report(runs, _qrels(spark, sf_dir)).select("avg_steps", "recall", "n")


@stepped(NEGS, "SELECT tier, count(*) AS n, any_value(CASE tier WHEN 'div' THEN 3.0 WHEN 'hard' THEN 1.0 ELSE 0.3 END)::DOUBLE AS weight FROM neg GROUP BY tier")
def tier_weights(spark, sf_dir, an):
    rows = supervision.negatives(an, *_chosen(spark, sf_dir, an)).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))
    weight = F.when(F.col("tier") == "div", TRAINING["weight_diversity"]).when(F.col("tier") == "hard", TRAINING["weight_hard"]).otherwise(TRAINING["weight_weak"])
    return rows.withColumn("weight", weight)


@register("SELECT conv_id, turn, 'Question: ' || text || chr(10) || 'Turn ' || turn AS prompt FROM conversations")
def prompt_fill(spark, sf_dir):
    return bind.table(spark, sf_dir, "conversations").select("conv_id", "turn", payload.fill("Question: {question}\nTurn {turn}", question=F.col("text"), turn=F.col("turn")).alias("prompt"))


@register("WITH i AS (SELECT conv_id, turn, text, turn // 2 AS call, turn % 2 AS out FROM conversations), o AS (SELECT conv_id, call, arg_max(text, turn) AS output FROM i WHERE out = 1 GROUP BY ALL) SELECT c.conv_id AS traj, c.turn AS nth, 'tool_call' AS type, 'search' AS tool_name, c.text AS arguments, coalesce(o.output, '') AS output FROM i c LEFT JOIN o USING (conv_id, call) WHERE c.out = 0")
def normalize_items(spark, sf_dir):
    rows = bind.table(spark, sf_dir, "conversations")
    is_out = F.col("turn") % 2 == 1
    kind = F.when(is_out, "function_call_output").when(F.col("turn") % 4 == 0, "mcp_call").otherwise("function_call")
    name = F.when(is_out, F.lit(None).cast("string")).when(F.col("turn") % 4 == 0, "functions.search").otherwise("search")
    items = rows.select(F.col("conv_id").alias("traj"), F.col("turn").alias("nth"), kind.alias("type"), F.floor(F.col("turn") / 2).alias("call_id"), name.alias("name"), F.when(~is_out, F.col("text")).alias("arguments"), F.when(is_out, F.col("text")).alias("output"))
    return transcript.normalize_items(items)
