"""Registered queries of sources and sinks, each a round trip through files in shared storage, and of the operators around runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import ASKED, BM25, GRPS, INNER, MESSAGES, RUNS, SHARE, _asked, _best, _groups, _messages, _qrels, _runs, _vectors, register, stepped
from .functions import text as T
from .functions import tokens
from .operators import control, dense_index, encoding, history, lexical, quarantine, retrieval, scoring, session, transcript, verdicts
from .plans import binding as bind
from .plans import steps as st
from .sources import corpus as io
from .sources.run_files import register_runs
from .streaming import live, questions

CLEAR = r"trim(regexp_replace(text, '[\t\n\r]+', ' ', 'g'))"


def _clear(c: str = "text"):
    return F.trim(F.regexp_replace(c, r"[\t\n\r]+", " "))


@stepped("", "SELECT docid, text FROM cor WHERE docid IN (SELECT docid FROM ret UNION SELECT docid FROM vis)")
def corpus_round_trip(spark, sf_dir, an):
    path = io.scratch(spark, "corpus")
    io.write_corpus(bind.corpus(spark, sf_dir), path)
    return io.read_corpus(spark, path, st.needed_docids(an))


def _run_files(spark: SparkSession, an: DataFrame, path: str) -> None:
    """One file for each trajectory; every tenth has no result."""
    step = F.struct(F.when(F.col("type") == "reasoning", "reasoning").otherwise("tool_call").alias("type"), F.col("type").alias("tool_name"), F.coalesce("output", F.lit("")).alias("output"))
    runs = an.groupBy("traj").agg(F.sort_array(F.collect_list(F.struct("idx", step.alias("step")))).alias("s"))
    result = F.when(F.col("traj") % 10 != 0, F.transform("s", lambda x: x["step"]))
    io.write_runs(runs.select(T.safe_name(F.concat(F.lit("q "), "traj")).alias("qid"), F.concat(F.col("traj").cast("string"), F.lit(".0")).alias("query_id"), F.lit("completed").alias("status"), result.alias("result")), path)


@stepped("", "SELECT traj::VARCHAR AS qid, CASE WHEN traj % 10 <> 0 THEN count(*) END AS steps, traj % 10 = 0 AS bad FROM st GROUP BY traj")
def trajectory_files(spark, sf_dir, an):
    path = io.scratch(spark, "runs")
    _run_files(spark, an, path)
    rows = io.read_trajectories(spark, f"{path}/*")
    return rows.select(T.plain_qid("query_id").alias("qid"), F.when(~F.col("bad"), F.size("result")).cast("bigint").alias("steps"), "bad")


@stepped("", "SELECT traj::VARCHAR AS qid, 'run_' || traj || '.json' AS file, count(*) AS steps, count(*) FILTER (type <> 'reasoning') AS calls FROM st GROUP BY traj")
def run_format(spark, sf_dir, an):
    """Runs written and read by their data source, one named file for each."""
    register_runs(spark)
    path = io.scratch(spark, "runs")
    kind = F.when(F.col("type") == "reasoning", "reasoning").otherwise("tool_call").alias("type")
    step = F.struct(kind, F.col("type").alias("tool_name"), F.to_json(F.struct("query", "docid")).alias("arguments"), "output")
    runs = an.groupBy(F.col("traj").cast("string").alias("qid")).agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", step.alias("step")))), lambda x: x["step"]).alias("result"))
    runs.repartition(4, "qid").write.format("runs").mode("append").save(path)
    rows = spark.read.format("runs").load(path).filter("not bad")
    return rows.select("qid", "file", F.size("result").cast("bigint").alias("steps"), F.size(F.filter("result", lambda s: s.type == "tool_call")).cast("bigint").alias("calls"))


@stepped("", "SELECT arm, count(DISTINCT traj) AS runs, count(DISTINCT traj) FILTER (traj % 10 = 0) AS bad FROM st, (VALUES ('a'), ('b')) x(arm) GROUP BY arm")
def arms_sweep(spark, sf_dir, an):
    path = io.scratch(spark, "arms")
    _run_files(spark, an, path)
    rows = io.read_arms(spark, {"a": f"{path}/*", "b": f"{path}/*"})
    return rows.groupBy("arm").agg(F.count(F.lit(1)).alias("runs"), F.count(F.when(F.col("bad"), 1)).alias("bad"))


@register(f"SELECT item_id::VARCHAR AS qid, {CLEAR} AS question, 'a ' || item_id AS answer FROM benchmark")
def questions_file(spark, sf_dir):
    path = io.scratch(spark, "questions")
    items = bind.table(spark, sf_dir, "benchmark")
    items.select(F.concat(F.lit(" "), F.col("item_id").cast("string")), _clear(), F.concat(F.lit("a "), "item_id")).write.option("sep", "\t").option("quote", '"').option("escape", '"').csv(path)
    return io.read_questions(spark, path)


@register(f"SELECT item_id::VARCHAR AS qid, {CLEAR} AS question, '\"' || item_id AS answer FROM benchmark")
def truths_file(spark, sf_dir):
    """Two lines for each question, the second of which counts; quotes are ordinary characters."""
    path = io.scratch(spark, "truths")
    items = bind.table(spark, sf_dir, "benchmark")
    line = lambda answer: F.concat_ws("\t", F.col("item_id").cast("string"), _clear(), answer)
    lines = F.explode(F.array(line(F.lit("old")), line(F.concat(F.lit('"'), "item_id"))))
    items.coalesce(1).select(lines.alias("value")).write.text(path)
    return io.read_ground_truth(spark, path)


@register(f"WITH {RUNS} SELECT qid, docid FROM qr")
def qrels_file(spark, sf_dir):
    path = io.scratch(spark, "qrels")
    _qrels(spark, sf_dir).select(F.concat_ws(" ", "qid", F.lit("0"), "docid", F.lit("1")).alias("value")).write.text(path)
    return io.read_qrels(spark, path)


@register("SELECT vec_id::VARCHAR AS docid, len(embedding)::INT AS dims, embedding[1]::DOUBLE AS first, embedding[64]::DOUBLE AS last FROM embeddings")
def embedding_files(spark, sf_dir):
    path = io.scratch(spark, "embeddings")
    rows = bind.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("docid"), "embedding")
    short = spark.createDataFrame([("short", [1.0]), ("none", None)], "docid string, embedding array<float>")
    io.write_embeddings(rows.select(F.col("docid").cast("string").alias("docid"), "embedding").unionByName(short), path)
    back = io.read_embeddings(spark, path, 64)
    return back.select("docid", F.size("embedding").alias("dims"), F.col("embedding")[0].cast("double").alias("first"), F.col("embedding")[63].cast("double").alias("last"))


@stepped(GRPS, "SELECT pos_id, ['pos_id', 'neg_diversity_id', 'neg_hard_id', 'neg_weak_id', 'reasoning_len'] AS fields, len(neg_weak_id)::INT AS weak, reasoning_len FROM grp")
def group_lines(spark, sf_dir, an):
    path = io.scratch(spark, "groups")
    io.write_groups(_groups(spark, sf_dir, an), path)
    lines = spark.read.text(path)
    own = F.from_json("value", "pos_id string, neg_weak_id array<string>, reasoning_len int")
    return lines.select(F.json_object_keys("value").alias("fields"), own.alias("x")).select("x.pos_id", "fields", F.size("x.neg_weak_id").alias("weak"), "x.reasoning_len")


@stepped("", "SELECT style, count(*) AS n, min(query) AS least FROM st, (VALUES ('i0'), ('i1')) x(style) WHERE type = 'search' GROUP BY style")
def style_files(spark, sf_dir, an):
    path = io.scratch(spark, "styles")
    rows = st.searches(an).select("traj", "idx", "query", F.explode(F.array(F.lit("i0"), F.lit("i1"))).alias("style"))
    io.write_styles(rows, path)
    return spark.read.schema("query string, style string").json(path).groupBy("style").agg(F.count(F.lit(1)).alias("n"), F.min("query").alias("least"))


@register(f"WITH {RUNS} SELECT arm, count(*) AS n, avg(correct::INT) AS success_rate, avg(steps) AS avg_steps, avg({SHARE}) AS recall FROM ru LEFT JOIN g USING (qid) GROUP BY arm")
def report_files(spark, sf_dir):
    path = io.scratch(spark, "report")
    runs = _runs(spark, sf_dir)
    metrics = scoring.judge_report(runs, _qrels(spark, sf_dir))
    io.write_report(metrics, runs.select("qid", "correct"), path)
    return spark.read.schema(metrics.schema).json(f"{path}/metrics")


@register(_best(10, f"SELECT q.vec_id::VARCHAR AS qid, d.vec_id::VARCHAR AS docid, {INNER} AS score FROM embeddings q, embeddings d WHERE q.vec_id % 50 = 0"))
def saved_cells_topk(spark, sf_dir):
    """An index written, read again, and probed in all its cells, which makes it exact."""
    queries, docs = _vectors(spark, sf_dir)
    path = io.scratch(spark, "cells")
    dense_index.index_of(docs, "IVF16,Flat").save(path)
    return retrieval.Cells.load(spark, path, probes=16).search(queries)


@register("SELECT count(*) AS queries, true AS reached FROM embeddings WHERE vec_id % 50 = 0")
def dense_ann_reached(spark, sf_dir):
    """Whether the approximate search with its usual settings reaches a recall of 0.9."""
    queries, docs = _vectors(spark, sf_dir)
    found = retrieval.recall(retrieval.Cells(docs).search(queries), retrieval.dense_topk(queries, docs))
    return found.select("queries", (F.col("recall") >= 0.9).alias("reached"))


@register(BM25 + "SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM p GROUP BY term")
def saved_postings(spark, sf_dir):
    path = io.scratch(spark, "index")
    io.write_index(retrieval.terms(bind.corpus(spark, sf_dir)), None, path)
    postings, vectors = io.read_index(spark, path)
    assert vectors is None
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


NEAREST = _best(10, f"SELECT q.vec_id::VARCHAR AS qid, d.vec_id::VARCHAR AS docid, {INNER} AS score FROM embeddings q, embeddings d WHERE q.vec_id % 50 = 0")
REACHED = "SELECT count(*) AS queries, true AS reached FROM embeddings WHERE vec_id % 50 = 0"


@register(NEAREST)
def growing_cells_topk(spark, sf_dir):
    """An index of three shards, of which one comes twice, made one; all cells are probed, so the search is exact."""
    queries, docs = _vectors(spark, sf_dir)
    index = dense_index.GrowingCells(spark, io.scratch(spark, "growing"))
    for i in (0, 1, 1, 2):
        index = index.append(docs.filter(F.pmod(F.xxhash64("docid"), F.lit(3)) == i), f"shard {i}", cells=12)
    return index.compact().search(queries, probes=12)


def _reached(index: retrieval.Searcher, queries: DataFrame, docs: DataFrame) -> DataFrame:
    found = retrieval.recall(index.search(queries), retrieval.dense_topk(queries, docs))
    return found.select("queries", (F.col("recall") >= 0.9).alias("reached"))


@register(REACHED)
def quantised_reached(spark, sf_dir):
    """Whether codes of eight bytes, ranked again, reach a recall of 0.9; the index is written and read again."""
    queries, docs = _vectors(spark, sf_dir)
    path = io.scratch(spark, "quantised")
    dense_index.index_of(docs, "IVF4,PQ8").save(path)
    return _reached(dense_index.Quantised.load(spark, path), queries, docs)


@register("SELECT count(*) AS vectors, 8.0::DOUBLE AS code_bytes, avg(4 * len(embedding)) AS vector_bytes FROM embeddings")
def quantised_sizes(spark, sf_dir):
    return dense_index.index_of(_vectors(spark, sf_dir)[1], "PQ8").sizes()


@register(REACHED)
def graph_reached(spark, sf_dir):
    """Whether walking the neighbour graph reaches a recall of 0.9."""
    queries, docs = _vectors(spark, sf_dir)
    return _reached(dense_index.index_of(docs, "HNSW16"), queries, docs)


MIXED = "e AS (SELECT vec_id, CASE WHEN vec_id % 4 = 3 THEN embedding ELSE embedding[1:48] END AS embedding FROM embeddings WHERE vec_id % 4 <> 1)"


@register(f"WITH {MIXED}, h AS (SELECT q.vec_id::VARCHAR AS qid, d.vec_id::VARCHAR AS docid, {INNER} AS score FROM (SELECT * FROM e WHERE vec_id % 50 IN (0, 3)) q JOIN e d ON len(q.embedding) = len(d.embedding)) {_best(10, 'SELECT * FROM h')}")
def mixed_lengths_topk(spark, sf_dir):
    """Vectors of two lengths, and some that hold a null."""
    kind, v = F.col("vec_id") % 4, F.col("embedding")
    vector = F.when((kind == 0) | (kind == 2), F.slice(v, 1, 48)).when(kind == 1, F.concat(F.slice(v, 1, 10), F.array(F.lit(None).cast("float")))).otherwise(v)
    rows = bind.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("docid"), vector.alias("embedding"))
    return retrieval.dense_topk(rows.filter((F.col("docid") % 50).isin(0, 3)).withColumnRenamed("docid", "qid"), rows)


def _lexical(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, lexical.LexicalIndex]:
    """Questions, documents, and an index of the latter made of two shards, the second of which comes twice."""
    items, docs = bind.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text"), bind.corpus(spark, sf_dir)
    path, odd = io.scratch(spark, "lexical"), F.pmod(F.xxhash64("docid"), F.lit(2)) == 1
    index = lexical.LexicalIndex(spark, path).append(docs.filter(odd), "odd").append(docs.filter(~odd), "even").append(docs.filter(~odd), "even")
    return items, docs, lexical.LexicalIndex(spark, index.path)


@register(BM25 + _best(10, "SELECT * FROM h"))
def saved_bm25_topk(spark, sf_dir):
    items, _, index = _lexical(spark, sf_dir)
    return index.search(items)


@register("SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS total_len, (SELECT count(DISTINCT t) FROM (SELECT unnest(w) AS t FROM w)) AS n_terms FROM w".join(["WITH w AS (SELECT regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents) ", ""]))
def saved_bm25_stats(spark, sf_dir):
    """Sizes of an index as it was written, after its segments became one."""
    return _lexical(spark, sf_dir)[2].compact().stats()


@register(BM25 + "SELECT count(*) AS postings, true AS fewer FROM q JOIN p USING (term)")
def bm25_reads(spark, sf_dir):
    """How many postings the questions' terms have, and whether the search reads fewer."""
    items, _, index = _lexical(spark, sf_dir)
    steps = index.reads(items)
    every = F.sum(F.when(F.col("step") == "postings", F.col("n")))
    return steps.agg(every.alias("postings"), (F.sum(F.when(F.col("step").startswith("step"), F.col("n"))) < every).alias("fewer"))


@register("SELECT * FROM (VALUES (0, 'pooling: index has ''mean'', wanted ''cls'''), (1, 'normalize: index has True, wanted False')) x(nth, problem)")
def stamp_check(spark, sf_dir):
    path = io.scratch(spark, "stamp")
    io.write_stamp(spark, {"retriever": "r", "passage_max_len": 512, "pooling": "mean", "normalize": True}, path)
    wrong = control.check_stamp(io.read_stamp(spark, path), {"retriever": "r", "passage_max_len": 512, "pooling": "cls", "normalize": False})
    return spark.createDataFrame(list(enumerate(wrong)), "nth int, problem string")


# ---- runs


@register("SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'source ' || conv_id WHEN min(turn) FILTER (role = 'user') IS NOT NULL AND conv_id % 3 = 1 THEN arg_min(text, turn) FILTER (role = 'user') WHEN conv_id % 2 = 0 THEN 'query' ELSE 'question' END AS question FROM conversations GROUP BY conv_id")
def original_question(spark, sf_dir):
    said = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    runs = bind.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(said.alias("m"))
    messages = F.when(F.col("conv_id") % 3 < 2, F.col("m")).otherwise(F.slice("m", 1, 0))
    runs = runs.select("conv_id", messages.alias("m"), F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("source "), "conv_id")).otherwise("").alias("s"), F.when(F.col("conv_id") % 2 == 0, "query").otherwise("").alias("q"))
    return runs.select("conv_id", T.original_question("s", "m", "q", F.lit("question")).alias("question"))


@register(f"WITH {MESSAGES}, r AS (SELECT traj, arg_max(output, idx) AS x FROM t GROUP BY traj) SELECT traj, md5(x) AS plain, md5(CASE WHEN contains(x, '<tool_call>') THEN '' ELSE x END) AS without_calls FROM r")
def judged_responses(spark, sf_dir):
    last = transcript.parse_messages(_messages(spark, sf_dir)).groupBy("traj").agg(F.array(F.max_by(F.struct("type", "output"), "idx")).alias("r"))
    return last.select("traj", F.md5(T.judged_response("r", calls=True)).alias("plain"), F.md5(T.judged_response("r")).alias("without_calls"))


@register("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'own' ELSE CASE WHEN turn % 4 = 3 THEN '' ELSE text END END AS query FROM conversations")
def sub_query(spark, sf_dir):
    rows = bind.table(spark, sf_dir, "conversations")
    one, many = F.to_json(F.struct(F.col("text").alias("query"))), F.to_json(F.struct(F.array("text", F.lit("x")).alias("query")))
    arguments = F.when(F.col("turn") % 4 == 3, "{bad").when(F.col("turn") % 4 == 2, many).otherwise(one)
    return rows.select("conv_id", "turn", T.searched_query(F.when(F.col("turn") % 3 == 0, "own").otherwise(""), arguments).alias("query"))


@stepped("", "SELECT traj, idx, CASE WHEN idx % 4 <> 3 THEN docid END AS docid FROM st WHERE type = 'visit'")
def browsed_docids(spark, sf_dir, an):
    rows = an.filter("type = 'visit'")
    one, many = F.to_json(F.struct(F.concat(F.lit("src:doc:"), "docid").alias("docid"))), F.to_json(F.struct(F.array("docid", F.lit("9")).alias("docid")))
    arguments = F.when(F.col("idx") % 4 == 3, '{"docid": []}').when(F.col("idx") % 4 == 2, many).otherwise(one)
    return rows.select("traj", "idx", T.browsed_docid(arguments).alias("docid"))


@register(r"SELECT doc_id, doc_id::VARCHAR AS qid, regexp_replace('q ' || doc_id || '/' || coalesce(lang, ''), '[^A-Za-z0-9_.\-]', '_', 'g') AS name FROM documents")
def run_names(spark, sf_dir):
    docs = bind.table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.plain_qid(F.concat(F.col("doc_id").cast("string"), F.lit(".0"))).alias("qid"), T.safe_name(F.concat(F.lit("q "), F.col("doc_id").cast("string"), F.lit("/"), F.coalesce("lang", F.lit("")))).alias("name"))


@register("SELECT item_id, 'm' AS model, 10 AS k, 'i7' AS query_style, NULL::VARCHAR AS pooling, false AS normalize, text AS query_source FROM benchmark")
def run_metadata(spark, sf_dir):
    rows = bind.table(spark, sf_dir, "benchmark").select("item_id", control.run_metadata(F.col("text"), model="m", k=10, query_style="i7").alias("m"))
    return rows.select("item_id", "m.model", "m.k", "m.query_style", F.col("m.pooling").cast("string").alias("pooling"), "m.normalize", "m.query_source")


@register("SELECT doc_id, p // 7 AS batch, p % 7 AS place FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents)")
def judge_batches(spark, sf_dir):
    return control.batches(bind.table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 7).select("doc_id", "batch", "place")


CALLS = """cl AS (SELECT conv_id AS traj, turn, CASE turn % 4 WHEN 0 THEN 'search' WHEN 1 THEN 'visit' WHEN 2 THEN 'other' END AS tool, turn FROM conversations)"""


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("turn") % 4 == 0, "search").when(F.col("turn") % 4 == 1, "visit").when(F.col("turn") % 4 == 2, "other")
    call = F.when(name.isNull(), "{'no': json").otherwise(F.to_json(F.struct(name.alias("name"), F.struct(F.col("turn").alias("n")).alias("arguments"))))
    return session.dispatch(bind.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("traj"), "turn", call.alias("call")))


@register(f"WITH {CALLS} SELECT traj, turn, tool, CASE tool WHEN 'visit' THEN 'get_document' WHEN 'search' THEN 'search' END AS handler, CASE WHEN tool IS NOT NULL THEN '{{\"n\":' || turn || '}}' END AS arguments, CASE WHEN tool IS NULL THEN '{session.INVALID}' WHEN tool = 'other' THEN 'Error: Tool other not found' END AS error FROM cl")
def tool_dispatch(spark, sf_dir):
    return _calls(spark, sf_dir).select("traj", "turn", "tool", "handler", "arguments", "error")


@register(f"WITH {CALLS} SELECT traj, coalesce(tool, 'invalid_json') AS tool, count(*) AS all_calls, count(*) FILTER (tool IN ('search', 'visit') AND turn > 0) AS answered_calls FROM cl GROUP BY ALL")
def tool_counts(spark, sf_dir):
    return session.tool_counts(_calls(spark, sf_dir), F.col("turn") > 0)


ENDS = "e AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '<answer>' || text || '</answer>' WHEN 1 THEN '<answer>' || text ELSE text END AS last FROM conversations)"


@register(f"WITH {ENDS} SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN CASE WHEN turn % 3 = 0 THEN 'generate an answer as token limit reached' ELSE 'format error: generate an answer as token limit reached' END WHEN turn % 3 < 2 THEN 'answer' WHEN turn % 2 = 0 THEN 'exceed available llm calls' ELSE 'answer not found' END AS label FROM e")
def run_endings(spark, sf_dir):
    rows = bind.table(spark, sf_dir, "conversations")
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<answer>"), "text", F.lit("</answer>"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("<answer>"), "text")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", session.ended(said, F.col("turn") % 2, F.col("conv_id") % 2 == 0).alias("label"))


# ---- around encoders


POOLED = "list_transform(range(1, 17), lambda i: round((embedding[i]::DOUBLE + embedding[i + 16]::DOUBLE + embedding[i + 32]::DOUBLE) / 3, 6))"


@register(f"SELECT vec_id, {POOLED} AS mean, list_transform(embedding[1:16], lambda x: round(x::DOUBLE, 6)) AS first FROM embeddings")
def pooled_states(spark, sf_dir):
    """A vector as four states of which the last is padding."""
    states = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.transform(F.slice("embedding", i * 16 + 1, 16), lambda x: x.cast("double")))
    rows = bind.table(spark, sf_dir, "embeddings").select("vec_id", states.alias("s"), F.array(*[F.lit(x) for x in (1, 1, 1, 0)]).alias("m"))
    shown = lambda how: F.transform(encoding.pool(F.col("s"), F.col("m"), how), lambda x: T.rounded(x, 6))
    return rows.select("vec_id", shown("mean").alias("mean"), shown("cls").alias("first"))


@register("SELECT doc_id, 'passage: ' || text AS e5, text AS bge, 'mean' AS e5_pooling, 'cls' AS bge_pooling, 'mean' AS other_pooling FROM documents")
def passage_prefix(spark, sf_dir):
    docs = bind.table(spark, sf_dir, "documents")
    named = {f"{m}_pooling": F.lit(encoding.pooling_of(method)) for m, method in (("e5", "intfloat-E5"), ("bge", "bge-base"), ("other", "none"))}
    return docs.select("doc_id", encoding.passage_text("e5", F.col("text")).alias("e5"), encoding.passage_text("bge", F.col("text")).alias("bge"), *[c.alias(n) for n, c in named.items()])


@register("SELECT item_id, turn_of, text FROM (SELECT item_id, item_id % 4 AS turn_of, text FROM benchmark)")
def encoder_shards(spark, sf_dir):
    """A list dealt to four encoders by stride, and put together again."""
    items = bind.table(spark, sf_dir, "benchmark").select("item_id", "text")
    out = None
    for i in range(4):
        part = control.shard(items, "item_id", 4, i).withColumn("turn_of", F.lit(i).cast("bigint"))
        out = part if out is None else out.unionByName(part)
    return out.select("item_id", "turn_of", "text")


# ---- verdicts, faults, streams


@register(f"WITH {ASKED}, p AS (SELECT count(DISTINCT (question, x)) AS n FROM a) SELECT docid, strlen(x) % 3 = 0 AS relevant, n AS asked, 0::BIGINT AS again FROM a, p")
def verdicts_once(spark, sf_dir):
    """Verdicts on documents and their questions, asked twice: how many pairs the judge saw in each run."""
    rows = _asked(spark, sf_dir).select("docid", "question", "text")
    store = verdicts.VerdictStore(spark, io.scratch(spark, "verdicts"))
    judge = lambda question, text: "RELEVANT" if len(text.encode()) % 3 == 0 else "<think>RELEVANT</think> no"
    store.ask(rows, "question", "text", judge)
    first = store.known().count()
    found = store.ask(rows, "question", "text", judge)
    return found.select("docid", "relevant", F.lit(first).cast("bigint").alias("asked"), F.lit(store.known().count() - first).cast("bigint").alias("again"))


REASONS = "CASE traj % 50 WHEN 1 THEN 'a step has no place' WHEN 2 THEN 'a step is of no known type' WHEN 3 THEN 'two steps have the same place' END"


@stepped(GRPS, f"SELECT traj, {REASONS} AS reason, NULL::BIGINT AS n_groups FROM st WHERE traj % 50 IN (1, 2, 3) GROUP BY traj UNION ALL SELECT traj, NULL, count(*) FROM grp WHERE traj % 50 NOT IN (1, 2, 3) GROUP BY traj")
def quarantined(spark, sf_dir, an):
    """Groups of the sound trajectories, and the reasons for which the others were set aside."""
    kind, first = F.col("traj") % 50, F.col("idx") == 1
    steps = bind.steps(spark, sf_dir)
    broken = steps.withColumn("type", F.when((kind == 2) & first, "jump").otherwise(F.col("type"))).withColumn("idx", F.when((kind == 1) & first, None).when((kind == 3) & first, 2).otherwise(F.col("idx")))
    sound, dead = quarantine.quarantine(broken)
    groups = _groups(spark, sf_dir, st.annotate(sound)).groupBy("traj").agg(F.count(F.lit(1)).alias("n_groups"))
    return dead.select("traj", "reason", F.lit(None).cast("bigint").alias("n_groups")).unionByName(groups.select("traj", F.lit(None).cast("string").alias("reason"), "n_groups"))


LIVE = """cl AS (SELECT i.traj, i.idx, i.type, i.query, i.docid, i.k % 5 <> 0 AS found, lag(i.type) OVER w AS was, coalesce(r.said, '') AS said, sum(CASE WHEN i.type = 'search' THEN 1 ELSE 0 END) OVER w AS turn
  FROM isl i LEFT JOIN (SELECT traj, isl.done + 1 AS done, string_agg(output, ' ' ORDER BY idx) AS said FROM isl WHERE type = 'reasoning' GROUP BY traj, isl.done) r ON r.traj = i.traj AND r.done = i.done
  WHERE i.type <> 'reasoning' WINDOW w AS (PARTITION BY i.traj ORDER BY i.idx)),
vs AS (SELECT * FROM cl WHERE type = 'visit' AND found AND turn > 0),
pa AS (SELECT cl.traj, cl.idx, any_value(cl.said) AS said, max(v.idx) AS target FROM cl JOIN vs v ON v.traj = cl.traj AND v.idx < cl.idx WHERE cl.was = 'visit' AND cl.said <> '' GROUP BY cl.traj, cl.idx),
f1 AS (SELECT traj, target, min(idx) AS idx, arg_min(said, idx) AS said FROM pa GROUP BY traj, target),
gr AS (SELECT s.traj, s.idx, g.turn, '#' || any_value(g.query) || coalesce(string_agg('[' || v.docid || '=' || coalesce(f1.said, '') || ']', '' ORDER BY v.idx), '') AS x
  FROM cl s JOIN cl g ON g.traj = s.traj AND g.type = 'search' AND g.idx < s.idx LEFT JOIN vs v ON v.traj = s.traj AND v.turn = g.turn AND v.idx < s.idx
  LEFT JOIN f1 ON f1.traj = v.traj AND f1.target = v.idx AND f1.idx <= s.idx WHERE s.type = 'search' GROUP BY s.traj, s.idx, g.turn),
hi AS (SELECT traj, idx, string_agg(x, '' ORDER BY turn) AS x FROM gr GROUP BY traj, idx)"""


@stepped(LIVE, "SELECT c.traj::VARCHAR AS traj, c.idx, c.said AS reasoning, md5(coalesce(hi.x, '')) AS history FROM cl c LEFT JOIN hi USING (traj, idx) WHERE c.type = 'search'")
def live_history(spark, sf_dir, an):
    """Sessions as a stream that stops halfway and goes on: what each search is conditioned on."""
    text = F.when(F.col("type") == "search", F.col("query")).when(F.col("type") == "visit", F.col("docid")).otherwise(F.col("output"))
    steps = bind.steps(spark, sf_dir).select("traj", F.col("idx").alias("step"), "type", text.alias("text"), (F.col("docid").cast("bigint") % 5 != 0).alias("found"))
    source, out, checkpoint = (io.scratch(spark, f"live-{n}") for n in ("steps", "out", "checkpoint"))
    live.use_rocksdb(spark)
    for early in (True, False):
        steps.filter((F.col("step") <= 20) == early).write.mode("append").json(source)
        live.live_searches(live.read_steps(spark, source)).writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    group = lambda g: F.concat(F.lit("#"), g.query, F.array_join(F.zip_with(g.docids, g.reasonings, lambda d, r: F.concat(F.lit("["), d, F.lit("="), r, F.lit("]"))), ""))
    return spark.read.schema(live.OUT).json(out).select("traj", F.col("step").alias("idx"), "reasoning", F.md5(F.array_join(F.transform("history", group), "")).alias("history"))


@register(f"SELECT item_id::VARCHAR AS qid, len({CLEAR})::INT AS answer FROM benchmark")
def answered_once(spark, sf_dir):
    """Questions as a stream of two runs, in the second of which half of them come again."""
    source, out = io.scratch(spark, "asked"), io.scratch(spark, "answers")
    items = bind.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("qid"), _clear().alias("question"))
    answer = lambda rows: rows.select("qid", F.length("question").alias("answer"))
    for run, rows in (("one", items.filter("qid % 2 = 0")), ("two", items)):
        rows.write.mode("append").option("sep", "\t").csv(source)
        questions.answer_stream(questions.read_questions(spark, source), answer, "qid string, answer int", out, io.scratch(spark, "checkpoint"), run).awaitTermination()
    return questions.answered(spark, out, "qid string, answer int").select("qid", "answer")


@register("SELECT dims::INT AS dims, problem FROM (SELECT DISTINCT len(embedding) AS dims FROM embeddings), (VALUES ('passage_max_len: index has 512, wanted 256'), ('pooling: index has ''mean'', wanted ''cls''')) x(problem)")
def table_stamps(spark, sf_dir):
    """A stamp for each length of vectors in the table, written beside their index, and what in it differs from what is wanted."""
    dims = bind.table(spark, sf_dir, "embeddings").select(F.size("embedding").alias("dims")).distinct()
    rows = []
    for d in (r["dims"] for r in dims.collect()):  # an index for each length
        path = io.scratch(spark, "stamp")
        io.write_stamp(spark, {"retriever": f"dense-{d}", "passage_max_len": 512, "pooling": "mean", "normalize": True}, path)
        rows += [(d, p) for p in control.check_stamp(io.read_stamp(spark, path), {"retriever": f"dense-{d}", "passage_max_len": 256, "pooling": "cls", "normalize": True})]
    return spark.createDataFrame(rows, "dims int, problem string")


@register("SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text || chr(10) || 'more' WHEN 1 THEN text ELSE '' END AS reasoning FROM conversations")
def reasoning_texts(spark, sf_dir):
    """Reasoning items with a summary, with contents only, and with neither."""
    rows, n = bind.table(spark, sf_dir, "conversations"), F.col("turn") % 3
    part = lambda *texts: F.array(*[F.struct(t.alias("text")) for t in texts])
    summary = F.when(n == 0, part(F.col("text"), F.lit(""), F.lit("more")))
    content = F.when(n == 1, part(F.col("text"))).when(n == 0, part(F.lit("not this")))
    return rows.select("conv_id", "turn", transcript.reasoning_text(summary, content).alias("reasoning"))


# ---- in a tokenizer's tokens


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@register("SELECT doc_id::VARCHAR AS docid, true AS same, true AS fits FROM documents")
def token_cuts(spark, sf_dir):
    """Whether the table of cuts has what the tokenizer makes of each document, and whether that fits."""
    docs = bind.corpus(spark, sf_dir).select("docid", T.one_line("text").alias("text"))
    cut = tokens.cuts(docs, "text", tokenizer_path(), 64)
    rows = docs.join(cut, "text", "left").select("docid", F.coalesce("cut", F.lit("")).alias("cut"), F.coalesce("tokens", F.lit(0)).alias("n"), tokens.truncate_tokens(F.col("text"), tokenizer_path(), 64).alias("own"))
    return rows.select("docid", (F.col("cut") == F.col("own")).alias("same"), (F.col("n") <= 64).alias("fits"))


@stepped("", "SELECT traj, idx, true AS same FROM st WHERE type = 'search'")
def token_styles(spark, sf_dir, an):
    """Searches in all styles, cut by the tokenizer, against whole queries made of documents and notes that were cut one by one."""
    path, corpus, question = tokenizer_path(), bind.corpus(spark, sf_dir), bind.question()
    digest = lambda made: F.md5(F.concat(*[F.md5(made[s]) for s in history.ALL_STYLES])).alias("digest")
    own = history.in_styles(an, corpus, question, tokens=path)
    own = own.select("traj", "idx", digest(own))
    opened = st.visits(an).filter("turn > 0")
    # No filter on the snippets: it would be moved below the join, and every document cut, those visited twice.
    wanted = history.written(opened.select("docid").distinct(), "docids")
    shown = corpus.join(wanted, "docid", "left_semi").select("docid", tokens.truncate_tokens(T.one_line("text"), path, 64).alias("snippet"))
    said = opened.select("traj", "turn", "idx", "docid", T.one_line(T.clean_note("reasoning", question)).alias("note"))
    noted = said.join(shown, "docid", "left").withColumn("note", tokens.truncating(path, 128)(F.col("note")))
    visits = noted.groupBy("traj", "turn").agg(F.sort_array(F.collect_list(F.struct("idx", "docid", "snippet", "note"))).alias("v"))
    some = lambda x: F.coalesce(F.nullif(x, F.lit("")), F.lit("<empty>"))
    items = lambda make, text: some(F.array_join(F.transform(F.filter("v", lambda x: x[text] != ""), make), " ; "))
    docs = F.concat(F.lit("\nVisited Documents: "), items(lambda x: x.snippet, "snippet"))
    notes = F.concat(F.lit("\nVisited Document Notes: "), items(lambda x: x.note, "note"))
    tagged = F.concat(F.lit("\nVisited Document Notes: "), items(lambda x: F.concat(F.lit("[docs_id:"), x.docid, F.lit("] "), x.note), "note"))
    line = F.concat(F.lit("Previous SubQuery "), F.col("turn"), F.lit(": "), F.col("query"))
    lines = {"i2": line, "i3": F.concat(line, docs), "i4": F.concat(line, tagged), "i5": F.concat(line, docs, notes)}
    past = st.searches(an).join(visits, ["traj", "turn"], "left").withColumns({s: F.collect_list(x).over(st.before()) for s, x in lines.items()})
    ask, now = F.concat(F.lit("Main Question: "), question, F.lit("\n")), F.concat(F.lit("Current Subquery: "), F.col("query"))
    told = {s: F.concat(now, F.lit("\nPrevious Interactions:"), F.when(F.size(s) == 0, " <empty>").otherwise(F.concat(F.lit("\n"), F.array_join(s, "\n")))) for s in lines}
    plain = {s: F.concat(ask, x) for s, x in told.items()} | {"i0": F.col("query"), "i1": F.concat(ask, now)}
    plain["i6"] = F.concat(F.lit("Reasoning: "), F.coalesce(F.nullif("pre", F.lit("")), F.lit("Empty")), F.lit("\n\nQuery: "), F.col("query"))
    plain["i7"] = F.concat(ask, F.lit("Current Reasoning: "), some(T.one_line("pre")), F.lit("\n"), told["i2"])
    # Digests are joined: the texts grow with the square of a trajectory's searches.
    plain = past.select("traj", "idx", digest(plain).alias("plain"))
    return plain.join(own, ["traj", "idx"]).select("traj", "idx", (F.col("digest") == F.col("plain")).alias("same"))
