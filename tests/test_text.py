from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions.normalize import normalize


def cases():
    return [
        (T.one_line("x"), " a b\n c ", "a b c"),
        (T.strip("x"), "  a b \n", "a b"),
        (T.clean_reasoning("x", F.lit("")), "It is so. The tool failed! We know it.", "It is so. We know it."),
        (T.clean_reasoning("x", F.lit("")), "The user wants A. Fine.", "Fine."),
        (T.clean_note("x", F.lit("")), "We need to search X. We need a village. Let's also check it.", "We need a village."),
        (T.clean_note("x", F.lit("")), "Déjà vu. Maybe try it.", "Déjà vu."),
        (T.title("x"), "---\ntitle: \"A b\"\n---\nrest", "A b"),
        (T.title("x"), "y" * 60 + "\nz", "y" * 50 + "..."),
        (T.verdict("x"), "<think>no RELEVANT</think> RELEVANT indeed", True),
        (T.verdict("x"), "a</think>NOT</think> RELEVANT", False),
        (T.verdict("x"), "RELEVANT.", False),
        (T.judged_correct("x"), "Correct:  YES then correct: no", True),
        (T.judged_correct("x"), "nothing", False),
        (T.plain_qid("x"), "7.0", "7"),
        (T.safe_name("x"), "a/b c-1.x", "a_b_c-1.x"),
        (T.browsed_docid("x"), '{"docid": ["DocID:12", "13"]}', "12"),
        (T.browsed_docid("x"), '{"docid": 5}', "5"),
        (T.browsed_docid("x"), "not json", None),
        (T.searched_query(F.lit(None).cast("string"), "x"), '{"query": ["a", "b"]}', "a"),
        (T.searched_query(F.lit("own"), "x"), '{"query": "a"}', "own"),
        (T.searched_query(F.lit(""), "x"), "bad", ""),
        (T.docids_in_output("x"), "DocID: 3\n[t]\ns\nDocID:4", ["3", "4"]),
        (normalize(F.col("x")), "Ünïcode, Ça-va?  ①", "unicode ca va 1"),
        (T.token_length("x"), "  ", 0),
        (T.truncate("x", 2), "a b c", "a b"),
        (T.no_answer("x"), " ", True),
    ]


def test_goldens(spark):
    for column, given, wanted in cases():
        got = spark.createDataFrame([(given,)], "x string").select(column.alias("y")).first()["y"]
        assert got == wanted, (given, got)


def test_overlap_is_strict_and_spares_short_sentences(spark):
    q = "a1 a2 a3 a4 a5 a6"
    rows = [("a1 a2 a3 a4 a5 a6 b1 b2 b3 b4", True), ("a1 a2 a3 a4 a5 a6 b1 b2 b3", False), ("a1 a2 a3 a4 a5 a6", True)]
    df = spark.createDataFrame(rows, "s string, kept boolean").select("kept", (T.clean_reasoning("s", F.lit(q)) != "").alias("got"))
    assert all(r["kept"] == r["got"] for r in df.collect())


def test_nulls_are_empty(spark):
    df = spark.createDataFrame([(None,)], "x string").select(T.one_line("x"), T.title("x"), T.clean_note("x", F.lit("q")), T.token_length("x"), T.verdict("x"))
    assert list(df.first()) == ["", "", "", 0, False]


def signed_zeros(spark, folder):
    """Vectors with components that become zero when they are rounded."""
    import duckdb

    small = [(0, [-0.0000002, 0.0000002, -0.0, 0.0, 0.6] + [0.0125] * 59), (1, [0.1] * 5 + [-0.0000001] * 59), (2, [-0.0] * 63 + [1.0])]
    spark.createDataFrame(small, "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return duckdb.sql(f"SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")


def test_l2_normalize_keeps_the_sign_of_what_is_rounded_to_zero(spark, tmp_path):
    from oracle import same

    from palimpsest import catalog

    embeddings = signed_zeros(spark, tmp_path)
    assert same(catalog.QUERIES["l2_normalize"](spark, str(tmp_path)), embeddings.query("embeddings", catalog.ORACLE_SQL["l2_normalize"])) == 3


def test_pooled_states_keep_the_sign_of_what_is_rounded_to_zero(spark, tmp_path):
    from oracle import same

    import __spark_entry__ as driver

    embeddings = signed_zeros(spark, tmp_path)
    assert same(driver.queries()["pooled_states"](spark, str(tmp_path)), embeddings.query("embeddings", driver.oracle_sql()["pooled_states"])) == 3
