"""Classifiers and the language model."""

import collections
import math
import zlib

import numpy as np
from llm_helpers import prose
from pyspark.sql import functions as F

from palimpsest.llm import lm_score, quality, toxicity
from palimpsest.llm.labelled import fold
from palimpsest.llm.words import Texts, texts


def toxic_corpus(n):
    return [" ".join(prose(40, i)[: 20 + i % 20] + (["vile" + "xyz"[i % 3]] if i % 3 == 0 else []) + prose(10, 900 + i)) for i in range(n)], [int(i % 3 == 0) for i in range(n)]


def test_toxic_words_are_learnt_and_thresholds_go_by_language(spark, frame):
    said, marks = toxic_corpus(300)
    docs = frame(said)
    labels = spark.createDataFrame([(i, m) for i, m in enumerate(marks)] + [(5000, 1), (3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text", "lang"), labels, train_fold=fold("doc_id", 5) != 0)
    assert set(model.thresholds) <= {"", "en"}
    rows = toxicity.with_toxicity(docs, model, lang_col="lang", reject_col="rejected").collect()
    held = [(r["score"] >= 0.5, marks[r["doc_id"]], r["rejected"]) for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum(p == bool(m) for p, m, _ in held) >= 0.9 * len(held)
    edge = toxicity.with_toxicity(frame([None, "", " ", "w " * 200_000]), model).select("score").collect()
    assert len({r["score"] for r in edge[:3]}) == 1 and all(0 <= r["score"] <= 1 for r in edge)
    assert toxicity.with_toxicity(frame([]), model).collect() == []
    clash = frame(["a"]).withColumn("score", F.lit("old"))
    assert 0 <= toxicity.with_toxicity(clash, model).first()["score"] <= 1


def test_all_labelled_texts_are_trained_on_by_several_copies(spark, frame, monkeypatch):
    said, marks = toxic_corpus(900)
    said += [f"kind{i % 7}" for i in range(6600)]
    docs = frame(said)
    labels = spark.createDataFrame([(i, m) for i, m in enumerate(marks + [0] * 6600)], "doc_id long, toxic int")
    seen, averaged = [], toxicity._averaged
    monkeypatch.setattr(toxicity, "_averaged", lambda state, total: seen.append(int(total[-1][0])) or averaged(state, total))
    monkeypatch.setattr(toxicity, "PART_BYTES", 50_000)
    monkeypatch.setattr(toxicity, "COPY_BYTES", 100_000)
    model = toxicity.fit(docs.select("doc_id", "text", "lang"), labels, train_fold=fold("doc_id", 5) != 0)
    kept = docs.filter(fold("doc_id", 5) != 0).filter(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(6)) != 0).count()
    assert set(seen) == {kept} and kept > 4900
    rows = toxicity.with_toxicity(docs.filter("doc_id < 900"), model).filter(fold("doc_id", 5) == 0).collect()
    assert sum((r["score"] >= 0.5) == bool(marks[r["doc_id"]]) for r in rows) >= 0.9 * len(rows)


def test_long_texts_are_scored_whole():
    rng = np.random.default_rng(2)
    width = toxicity.FILTERS * len(toxicity.WIDTHS)
    model = toxicity.Model(rng.normal(size=(toxicity.BUCKETS + 1, toxicity.FILTERS * sum(toxicity.WIDTHS))).astype(np.float32), np.zeros(width, np.float32), rng.normal(size=width).astype(np.float32), 0.0, {"": 0.5})
    model.table[-1] = 0
    said = [" ".join(prose(n, n)) for n in (3000, 1, 0, 40)]
    raw = [s.encode() for s in said]
    chunk = Texts(np.arange(4), np.ones(4, bool), np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    whole, old = model.scores(chunk), toxicity.AT_ONCE
    toxicity.AT_ONCE = 700
    try:
        assert np.allclose(whole, model.scores(chunk))
    finally:
        toxicity.AT_ONCE = old


def test_labels_of_one_kind_or_none_give_the_share(spark, frame):
    docs = frame(["a b", "c d"])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    ones = spark.createDataFrame([(0, 1), (1, 1)], "doc_id long, toxic int")
    for labels, wanted in ((none, 0.5), (ones, 0.75)):
        model = toxicity.fit(docs.select("doc_id", "text", "lang"), labels)
        assert all(abs(r["score"] - wanted) < 1e-6 for r in toxicity.with_toxicity(docs, model).collect())


def test_quality_is_learnt(spark, frame):
    good = [" ".join(prose(60, i)) + "." for i in range(200)]
    bad = [" | ".join(x.upper() + "!!" for x in prose(60, 500 + i)) for i in range(100)]
    docs = frame(good + bad + [None, ""]).withColumn("meta", F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")))
    labels = spark.createDataFrame([(i, int(i < 200)) for i in range(300)], "doc_id long, quality int")
    model = quality.fit(docs, labels, train_fold=fold("doc_id", 4) != 2)
    rows = {r["doc_id"]: r["score"] for r in quality.scored(docs, model).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((rows[i] >= 0.7) == (i < 200) for i in held) >= 0.95 * len(held) and all(0 <= s <= 1 for s in rows.values()) and len(rows) == 302
    assert quality.scored(docs.limit(0), model).collect() == []


def test_the_machine_equals_all_pairs():
    rng = np.random.default_rng(1)
    model = quality.Model(0.3, rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, quality.FACTORS)))
    features, x = np.array([5, 17, 999, 131200]), rng.normal(size=4)
    pairs = sum(model.v[a] @ model.v[b] * p * q for i, (a, p) in enumerate(zip(features, x, strict=True)) for b, q in list(zip(features, x, strict=True))[i + 1 :])
    assert np.isclose(model.logits(np.zeros(4, int), features, x, 1)[0], 0.3 + model.w[features] @ x + pairs)


def lm_rows(df, n_docs, **options):
    rows = lm_score.scores(df, fold("doc_id", 7) != 2, **options).collect()
    assert len(rows) == n_docs
    return rows


def test_language_model(frame):
    said = [" ".join(prose(50, i % 30)) for i in range(90)] + [None, "", "new words only here"]
    rows = lm_rows(frame(said), 93)
    words = {i: (t or "").encode().lower().split() + [None] for i, t in enumerate(said)}
    counts = collections.Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        own = words[r["doc_id"]]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0
    seen = [r for r in rows if r["doc_id"] < 90]
    assert sum(r["score"] for r in seen) > 0.5 * sum(r["base_score"] for r in seen)
    assert all(math.isfinite(r["score"]) for r in rows)


def brute_scores(words, learnt, order, prior):
    """The model's log10 probabilities from exact counts, rounded down to powers of 2 as the filter's levels are."""
    grams = [collections.Counter() for _ in range(order + 1)]
    for i in learnt:
        for k in range(1, order + 1):
            full = [None] * (k - 1) + words[i]
            grams[k].update(tuple(full[j : j + k]) for j in range(len(words[i])))
    n, v = sum(grams[1].values()), len(grams[1])
    power = lambda c: 2 ** int(math.log2(c)) if c else 0

    def probability(history, w, first):
        p = (grams[1][w,] + 1) / (n + v + 1)
        for k in range(2, order + 1):
            if k > 2 and first < k - 2:
                break  # the longer n-gram has one more end before the text and says no more
            h = tuple(history[-(k - 1) :])
            seen = grams[1][h] if k == 2 else 2 * power(grams[k - 1][h]) - 1
            if seen > 0:
                p = (power(grams[k][(*h, w)]) + prior * p) / (seen + prior)
        return p

    return {i: sum(math.log10(probability([None] * order + ws[:j], w, j)) for j, w in enumerate(ws)) for i, ws in words.items()}


def test_scores_equal_brute_force_and_no_ngram_is_left_out(frame):
    said = [" ".join(f"w{(i * 37 + k * (i + 1)) % 97}" for k in range(40)) for i in range(60)] + ["", "one", "w1 w1 w1 w1 w1"] + ["w5 w6 w7 w8"] * 9
    words = {i: t.encode().split() + [None] for i, t in enumerate(said)}
    learnt = [i for i in words if zlib.crc32(str(i).encode()) % 7 != 2]
    for order in (1, 2, 3, 4):
        wanted = brute_scores(words, learnt, order, lm_score.PRIOR)
        for options in ({}, {"block_tokens": 100, "range_bytes": 500}):
            for r in lm_rows(frame(said), len(said), order=order, bits_each=400, **options):
                assert math.isclose(r["score"], wanted[r["doc_id"]], rel_tol=1e-9), (order, r)


def test_a_saved_model_scores_another_table(spark, frame, tmp_path):
    said = [" ".join(f"w{(i * 37 + k * (i + 1)) % 97}" for k in range(40)) for i in range(60)] + ["", "w1 w1 w1 w1 w1"]
    other = [" ".join(f"w{(i * 11 + k * (i + 2)) % 97}" for k in range(25)) for i in range(30)] + said[:5] + ["nothing known", "", None, "w1 w1 w1 w1 w1"]
    learnt = {i: t.encode().split() + [None] for i, t in enumerate(said)}
    asked = {1000 + i: (t or "").encode().split() + [None] for i, t in enumerate(other)}
    for order, options in ((1, {}), (3, {}), (3, {"block_tokens": 100, "range_bytes": 2000}), (4, {"block_tokens": 200, "range_bytes": 500})):
        out = str(tmp_path / f"m{order}{len(options)}")
        model = lm_score.fit(frame([*said, "no id"], [*range(len(said)), None]), out, order=order, bits_each=400, **options)
        saved = lm_score.parts(spark, out)
        assert saved.filter("kind > 0 and (words is not null or counts is not null)").count() == 0 and saved.select("kind").distinct().count() == order
        again = lm_score.load(spark, out)
        assert again == model and model.tokens == sum(map(len, learnt.values()))
        # More text than was learnt from splits the ranges' questions.
        docs = frame(other * 3, [*asked, *[None] * 2 * len(other)])
        rows = lm_score.score(docs, again, block_tokens=50, range_bytes=300).collect()
        wanted = brute_scores({**learnt, **asked}, learnt, order, lm_score.PRIOR)
        assert len(rows) == 3 * len(other) and {r["train_tokens"] for r in rows} == {model.tokens}
        for r in rows:
            if r["doc_id"] is not None:
                assert math.isclose(r["score"], wanted[r["doc_id"]], rel_tol=1e-9), (order, r)


def test_a_model_of_nothing_scores(spark, frame, tmp_path):
    model = lm_score.fit(frame([]), str(tmp_path / "m"))
    assert (model.types, model.tokens) == (0, 0) and lm_score.load(spark, model.path) == model
    (row,) = lm_score.score(frame(["a b"]), model).collect()
    assert (row["n_known"], row["n_tokens"], row["score"]) == (0, 3, 0)
    assert lm_score.score(frame([]), model).collect() == []


def test_keys_go_to_the_ranges_that_they_are_in():
    rng = np.random.default_rng(5)
    words = np.unique(rng.integers(0, 2**63, 2000, dtype=np.int64).astype(np.uint64) * np.uint64(2))
    for n in (1, 4, 1 << 16):
        for kind, keys in ((0, words), (1, np.unique(lm_score.slots(words, n)))):
            got = list(lm_score._by_range(kind, keys, n))
            assert [r for r, _, _ in got] == sorted({int(r) for r in (keys >> np.uint64(lm_score.SLIM) if kind else lm_score.ranges(keys, n))})
            assert [p.start for _, p, _ in got] == [0, *[p.stop for _, p, _ in got[:-1]]] and got[-1][1].stop == len(keys)
    assert list(lm_score._by_range(1, words[:0], 4)) == []


def test_the_model_sums_to_at_most_one(frame):
    said = [" ".join("abcde"[(i * k + k * k) % 5] for k in range(30)) for i in range(40)]
    words = {i: t.encode().split() + [None] for i, t in enumerate(said)}
    learnt = [i for i in words if zlib.crc32(str(i).encode()) % 7 != 2]
    tokens = [*(w.encode() for w in "abcde"), None]
    for before in (["a", "b"], ["e", "e"], ["c", "a"]):
        history = [w.encode() for w in before]
        tries = {i: [*history, w] for i, w in enumerate(tokens)}
        whole = brute_scores({**words, **{1000 + i: t for i, t in tries.items()}, 2000: history}, learnt, 3, lm_score.PRIOR)
        assert sum(10 ** (whole[1000 + i] - whole[2000]) for i in tries) <= 1 + 1e-9


def test_the_filters_usual_size_changes_scores_little(frame):
    said = [" ".join(f"w{(i * 37 + k * (i + 1)) % 97}" for k in range(40)) for i in range(60)]
    words = {i: t.encode().split() + [None] for i, t in enumerate(said)}
    wanted = brute_scores(words, [i for i in words if zlib.crc32(str(i).encode()) % 7 != 2], 3, lm_score.PRIOR)
    over = [abs(r["score"] - wanted[r["doc_id"]]) for r in lm_rows(frame(said), 60)]
    assert sum(over) < 0.03 * 60 * 41


def test_language_model_of_nothing(frame):
    assert lm_score.scores(frame([]), fold("doc_id", 7) != 2).collect() == []
    (row,) = lm_rows(frame(["a b"], ids=[None]), 1)
    assert (row["doc_id"], row["train_tokens"], row["n_tokens"]) == (None, 0, 3) and row["base_score"] == 0


def test_filter_counts_are_powers_below_the_count():
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 2**63, 3000, dtype=np.int64).astype(np.uint64)
    counts = rng.integers(2, 5000, 3000)
    bits = lm_score.part_of(keys, lm_score.level(counts))
    found = lm_score.probed(bits, keys)
    exact = np.log2(counts).astype(int) + 1
    assert (found >= exact).all() and (found == exact).mean() > 0.9
    other = rng.integers(0, 2**63, 3000, dtype=np.int64).astype(np.uint64)
    assert (lm_score.probed(bits, other) > 0).mean() < 0.1


def test_words_split_as_bytes_do():
    said = ["Ab  c\td", "", "é x \x0b y", "\n"]
    raw = [s.encode() for s in said]
    import pyarrow as pa

    batch = pa.record_batch([pa.array(range(4)), pa.array(said)], names=["i", "t"])
    for chunk in texts(iter([batch])):
        data, starts, ends, at = chunk.words()
        got = [[data[s:e].tobytes() for s, e in zip(starts[a:b], ends[a:b], strict=True)] for a, b in zip(at[:-1], at[1:], strict=True)]
        assert got == [r.lower().split() for r in raw]


def test_samples_are_bounded_in_rows_and_bytes(spark, frame):
    from palimpsest.llm.labelled import sample

    docs = frame([*["x" * 100] * 20, "y" * 5000, None]).select("doc_id", "text")
    labels = spark.createDataFrame([(i, i % 2) for i in range(22)], "doc_id long, toxic int")
    rows = lambda **options: sample(docs, labels, "toxic", F.lit(True), per_class=True, **options)[0]
    assert rows(most=8).num_rows == 8 and rows(most=100).num_rows == 22
    some = rows(most=100, most_bytes=1000)
    assert 1 <= some.num_rows < 22 and (some.num_rows == 1 or sum(len(t or "") for t in some.column("text").to_pylist()) <= 1000)
    assert some.equals(rows(most=100, most_bytes=1000)) and rows(most=100, most_bytes=0).num_rows >= 1
    assert sample(docs.limit(0), labels, "toxic", F.lit(True), 8, True)[0].num_rows == 0
