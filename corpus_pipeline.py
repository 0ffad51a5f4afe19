"""A corpus pipeline of five operators: what each stage keeps is the next one's whole input."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import toxicity
from palimpsest.llm.decontaminate import contaminated
from palimpsest.llm.mixing import mixed
from palimpsest.llm.ngram_join import jaccard_components
from palimpsest.llm.queries import tokenizer_path
from palimpsest.llm.session import fresh, keep, one_each, pick, shared_dir, table, without
from palimpsest.llm.token_files import read_tokens, write_tokens

#: No stage with a trained model or a tokenizer can be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below their language's threshold.

    A null or empty text has the score of a text without words, a null language the usual threshold; null ids and repeated rows stay or go by their texts.
    Without labels of both kinds all scores are the labels' share. An empty table stays empty. Columns of any name come out as they were.
    """
    model = toxicity.fit(pick(docs, doc_id="doc_id", text="text", lang="lang"), pick(table(spark, sf_dir, "labels"), doc_id="doc_id", toxic="toxic"))
    score, rejected = fresh(docs, "toxicity_"), fresh(docs, "rejected_")
    scored = toxicity.with_toxicity(docs, model, lang_col="lang", score_col=score, reject_col=rejected)
    return scored.filter(~F.col(rejected)).select(*_own(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of linked documents.

    Texts without words link with nothing; documents without an id stay; rows that repeat an id are one document, of which one row stays or none.
    An empty table stays empty. Columns of any name come out as they were.
    """
    found = keep(jaccard_components(docs))
    gone = keep(found.filter("component_id <> doc_id").select("doc_id").distinct())
    repeated = keep(found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    return one_each(without(docs, "doc_id", gone), "doc_id", repeated).select(*_own(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no passage matches a benchmark item.

    Null and empty texts and items match nothing; documents without an id stay; rows that repeat an id go if one of their texts matches.
    An empty table, or benchmark, drops nothing. Columns of any name come out as they were.
    """
    gone = keep(contaminated(docs, table(spark, sf_dir, "benchmark")).filter("doc_id is not null").select("doc_id").distinct())
    return without(docs, "doc_id", gone).select(*_own(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, each row as often as its copies say.

    A text without words has no size and is not taken; a null source is the last one; rows that differ in any column are dealt copies of their own,
    equal rows share theirs; ties go by a hash of the row. An empty table stays empty.
    """
    return mixed(docs)


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files to the shared folder; returns, from them, each document's place.

    A null or empty text is the end id alone; null ids come first, rows with equal ids are ordered by their texts' hashes. An empty table
    gives no files and no rows. Other columns are ignored.
    """
    out = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    write_tokens(docs, out, tokenizer_path())
    return read_tokens(spark, out)


def _own(docs: DataFrame) -> list[Column]:
    """All columns, whatever is in their names."""
    return [F.col(f"`{c}`") for c in docs.columns]


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
