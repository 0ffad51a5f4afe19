import pytest
from oracle import SF, same

import corpus_pipeline
from palimpsest.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    assert same(queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLE_SQL[name])) > 0


def test_stages_keep_columns_and_only_what_they_should(spark):
    from palimpsest.llm.session import keep

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(keep(stage(spark, seen[-1], SF)))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    assert all(d.columns == columns for d in seen[:-1]) and seen[-1].columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in seen]
    assert ids[1] < ids[0] and len(ids[0] - ids[1]) <= len(ids[0]) // 4 and len(toxic & (ids[0] - ids[1])) >= 0.7 * len(toxic)
    from test_ngram_join import brute

    parts, _ = brute([(r["doc_id"], r["text"]) for r in seen[1].collect()])
    assert ids[2] == set(parts.values())
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {r["doc_id"] for r in seen[2].collect() if any(i in r["text"] for i in items)}
    assert leaks <= ids[2] - ids[3]
    assert ids[4] <= ids[3] and seen[5].count() == seen[4].count()


CLASHES = ["toxicity_", "rejected_", "hash_", "h_", "id_", "copy_", "copies_", "bits_", "gone_", "rank_", "words_", "component_id", "k", "size", "score"]


def test_stages_take_nulls_repeats_clashing_names_and_nothing(spark):
    long = "word " * 30000
    rows = [(1, "Some text of more than five words here.", "en", "s"), (1, "Some text of more than five words here.", "en", "s"), (2, None, None, None), (3, "", "de", "s"), (None, "A text without an id but with words.", "en", None), (4, long, "en", "t"), (5, "Some text of more than five words here.", "en", "t")]
    names = ", ".join(f"`{c}` string" for c in CLASHES)
    docs = spark.createDataFrame([(*r, len(r[1] or ""), *[f"{c}{i}" for c in CLASHES]) for i, r in enumerate(rows)], f"doc_id long, text string, lang string, source string, n_chars long, {names}")
    own = {tuple(r) for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        kept[name] = [tuple(r) for r in out.collect()]
        assert set(kept[name]) <= own, name
        assert stage(spark, docs.limit(0), SF).collect() == []
    assert len(kept["toxicity"]) == 7 and len(kept["benchmark decontamination"]) == 7
    assert sorted(r[0] or 0 for r in kept["n-gram Jaccard join"]) == [0, 1, 2, 3, 4]
    taken = kept["mixing sources to target weights"]
    assert all(r[1] for r in taken) and len(taken) > 3
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(ids) == 7 and sum(r["n_tokens"] == 1 for r in ids) == 2
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).collect() == []
