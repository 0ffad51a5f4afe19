"""Queries over the whole tables, one for each operator, with the operators' production parameters."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality, toxicity
from .decontaminate import contaminated
from .labelled import fold
from .line_dedup import dedup_lines
from .lm_score import scores
from .minhash import near_copies
from .mixing import rates
from .ngram_join import jaccard_components
from .periodic_runs import periodic_runs
from .session import pick, table
from .substring_dedup import repeated_passages
from .token_files import tokens_round_trip
from .topk import top_k
from .vector_codes import Codes, summed_by

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


#: The same by a join on shingles and a recursive closure of the links.
ORACLE_SQL["op1_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(g) AS g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * o >= 75 * (x.n + y.n - o)),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reach = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)"""


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE_SQL["op4_exact_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text", lang="lang")
    labels = pick(table(spark, sf_dir, "labels"), doc_id="doc_id", toxic="toxic")
    model = toxicity.fit(docs, labels, "toxic", fold("doc_id", 5) != 0)
    scored = toxicity.with_toxicity(docs, model, lang_col="lang", reject_col="rejected")
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "rejected")


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text", meta="n_chars")
    labels = pick(table(spark, sf_dir, "labels"), doc_id="doc_id", quality="quality")
    model = quality.fit(docs, labels, "quality", fold("doc_id", 4) != 2)
    return quality.scored(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op9_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


@query
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scores(table(spark, sf_dir, "documents"), fold("doc_id", 7) != 2)
    return scored.withColumn("held_out", F.coalesce(fold("doc_id", 7) == 2, F.lit(False)))


@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = Codes(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096.0)
    digest = hashlib.sha256(",".join(str(x) for x in codes.books.ravel().tolist()).encode()).hexdigest()
    rows = summed_by(codes.rows, "label", "error", "label_error")
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _books_sql(k: int) -> str:
    """The assignment of round ``k``, and the codebooks after it."""
    return f"""
f{k} AS MATERIALIZED (SELECT vec_id, p, min({{'far': far, 'e': e}}) AS m FROM (SELECT c.vec_id, c.p, b.e, sum((c.x - b.x) * (c.x - b.x))::BIGINT AS far FROM c JOIN b{k} b USING (p, d) GROUP BY ALL) GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, b.d, coalesce(s.x, b.x) AS x FROM b{k} b LEFT JOIN (
  SELECT c.p, f.m.e AS e, c.d, ((sum(c.x) - ((sum(c.x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x FROM c JOIN f{k} f USING (vec_id, p) GROUP BY ALL) s USING (p, e, d)),"""


#: Six rounds, each a join of the parts with their codebooks; // rounds to zero, so the remainder goes first.
ORACLE_SQL["op11_vector_codes"] = f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i, len(v) // 8 AS w FROM k),
c AS MATERIALIZED (SELECT vec_id, i // w AS p, i % w AS d, x FROM l),
b0 AS MATERIALIZED (SELECT p, e, d, x FROM c JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT vec_id FROM k ORDER BY vec_id LIMIT 16)) USING (vec_id)),{"".join(_books_sql(k) for k in range(7))}
r AS (SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.far)::BIGINT AS error FROM f6 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(x, ',' ORDER BY p, e, d)) FROM b6) AS codebooks_sha256
FROM r JOIN k USING (vec_id)"""


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    found = periodic_runs(_repeating(docs))
    longest = F.get(F.array_sort("runs", lambda a, b: F.when(a.length != b.length, b.length - a.length).when(a.start != b.start, a.start - b.start).otherwise(a.period - b.period).cast("int")), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r.start, F.lit(","), r.length, F.lit(","), r.period, F.lit("\n"))), "")
    found = found.withColumn("longest", longest).withColumn("lines", lines)
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "longest.start", "longest.length", "longest.period", F.expr("1000 * longest.length div longest.period").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )  # fmt: skip


def _repeating(docs: DataFrame) -> DataFrame:
    """A tenth of the documents, by a checksum of their ids, get a tail that repeats: each word from a on becomes word a + (i - a) % p."""
    hashed = docs.withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary"))).withColumn("g", F.expr("h div 10"))
    chosen = hashed.withColumn("words", F.when(F.col("h") % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    chosen = chosen.withColumn("n", F.size("words")).withColumn("a", F.expr("if(n > 0, cast(g % n as int), 0)")).withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    tail = "slice(flatten(array_repeat(slice(words, a + 1, p), cast((n - a) div p + 1 as int))), 1, n - a)"
    return chosen.select("doc_id", F.when(F.col("n") > 0, F.expr(f"array_join(concat(slice(words, 1, a), {tail}), ' ')")).otherwise(F.col("text")).alias("text"))


#: Stretches of equal words q apart are islands of pairs (i, i + q); a stretch's least q is its period. The checksum goes bit by bit over the id's digits.
ORACLE_SQL["op12_periodic_runs"] = r"""
WITH h AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-]+'), lambda x: x <> '') AS w,
    xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [256 + ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0]))),
      lambda c, x: CASE WHEN x > 0 THEN xor(c, x - 256) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295) AS h FROM documents),
g AS (SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a FROM h),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END]) ELSE w END AS w FROM g),
t AS MATERIALIZED (SELECT doc_id, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d),
e AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e) GROUP BY doc_id, q, island),
r AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM s WHERE length >= greatest(6, 4 * q) GROUP BY ALL),
m AS (SELECT doc_id, count(*) AS n_runs, min({'l': -length, 's': start, 'p': period}) AS best, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM t WHERE NOT EXISTS (FROM r WHERE r.doc_id = t.doc_id AND t.i >= r.start + r.period AND t.i < r.start + r.length) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, (-best.l)::BIGINT AS length, best.p::BIGINT AS period, (1000 * -best.l // best.p)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM documents LEFT JOIN m USING (doc_id) LEFT JOIN k USING (doc_id)"""


@query
def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


#: The same by a join on shingles of four words and a recursive closure of the links.
ORACLE_SQL["op13_minhash_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(g) AS g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * o >= 80 * (x.n + y.n - o)),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reach = l.a),
c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""
