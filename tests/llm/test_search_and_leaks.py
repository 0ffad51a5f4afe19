"""Exact top-k and decontamination."""

import random

import numpy as np
from llm_helpers import prose
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate as D
from palimpsest.llm import topk as K

VECTORS = "vec_id long, embedding array<float>, score long"


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 20)).astype(np.float32)
    x[50:60] = x[0]
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(300)]
    bad = [(1000, None, 0), (1001, [], 0), (1002, [float("nan")] * 20, 0), (1003, [None] * 20, 0), (1004, [float("inf")] * 20, 0), (None, [1.0] * 20, 0), (1050, [1.0, 2.0], 0)]
    q = np.floor(256.0 * x.astype(np.float64)).astype(np.int64)
    for options in ({}, {"rows": 64, "queries": 3}):
        got = K.top_k(spark.createDataFrame(rows + bad, VECTORS), F.col("vec_id") % 50 == 0, **options).collect()
        for i in range(0, 300, 50):
            scores = [(-int(q[i] @ q[j]), j) for j in range(300) if j != i]
            wanted = [(r + 1, j, -s) for r, (s, j) in enumerate(sorted(scores)[:5])]
            assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == i) == wanted
        assert {r["query_id"] for r in got} == set(range(0, 300, 50))


def test_top_k_with_few_rows_repeats_and_none(spark):
    one = spark.createDataFrame([(0, [1.0], 0), (0, [1.0], 0), (1, [2.0], 0)], VECTORS)
    # The query's own row is left out once; its repeat is a candidate like any other row.
    got = [list(r) for r in K.top_k(one, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert got == [[0, 1, 1, 256 * 512], [0, 2, 0, 256 * 256]]
    assert K.top_k(one.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_top_k_keeps_repeated_rows_and_large_scores(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-4, 5, size=(40, 12)) * 1.0
    x[:, :3] *= 3e5  # scores beyond 2**53
    rows = [(int(i % 23), [float(v) for v in x[i]], 0) for i in range(40)] + [(7, [float(v) for v in x[7]], 0)] * 7
    q = [(i, [int(256 * v) for v in v]) for i, v, _ in rows]
    for options in ({}, {"rows": 8, "queries": 1}):
        got = K.top_k(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 5 == 0, **options).collect()
        for own in range(0, 23, 5):
            asks = max((v for i, v in q if i == own), key=lambda v: [float(a) for a in v])
            others = list(q)
            others.remove((own, asks))
            scores = sorted((-sum(a * b for a, b in zip(asks, v, strict=True)), i) for i, v in others)[:5]
            assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == own] == [(n + 1, i, -s) for n, (s, i) in enumerate(scores)]


def distance(item, text):
    """Least edit distance of the item to any window."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, v in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != v), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_leaks_reach_their_recall_and_nothing_else_matches(spark, frame):
    rng = random.Random(4)
    items = [prose(rng.randint(6, 60), 1000 + i) for i in range(40)]
    texts, planted = [], {}
    for k in range(200):
        words = prose(200, k)
        if k % 2:
            item, copy = items[k % 40], []
            edits = int(D.RATIO * len(item) * 0.7) if k % 4 == 1 else 0
            where = set(rng.sample(range(len(item)), edits))
            for j, w in enumerate(item):
                kind = rng.randint(0, 2) if j in where else 3
                copy += {0: ["changed"], 1: [], 2: [w, "added"], 3: [w]}[kind]
            at = rng.randint(0, 200)
            words = words[:at] + [w.upper() if k % 3 else w + "," for w in copy] + words[at:]
            planted[k] = (k % 40, edits)
        texts.append(" ".join(words))
    texts += [None, ""]
    bench = spark.createDataFrame([(i, " ".join(w), 1) for i, w in enumerate(items)] + [(99, "", 1), (98, None, 1)], "item_id long, text string, doc_id long")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in D.contaminated(frame(texts), bench).collect()}
    exact = [(k, i) for k, (i, e) in planted.items() if not e]
    edited = [(k, i) for k, (i, e) in planted.items() if e]
    assert all(got.get(p) == 0 for p in exact)
    assert sum(p in got for p in edited) >= 0.9 * len(edited)
    for (k, i), d in got.items():
        words = ["".join(c for c in w.lower() if c.isalnum()) for w in texts[k].split()]
        assert distance(items[i], words) == d <= D.RATIO * len(items[i]) and planted[k][0] == i


def test_leaks_at_the_whole_bound_are_found_at_any_length(spark, frame):
    rng = random.Random(8)
    sizes = [7, 14, 20, 30, 50, 59, 80, 120, 200, 400]
    items = [prose(n, 3000 + n) for n in sizes]
    texts = []
    for k in range(200):
        item, copy = items[k % len(items)], []
        where = set(rng.sample(range(len(item)), int(D.RATIO * len(item))))
        for j, w in enumerate(item):
            copy += {0: ["changed"], 1: [], 2: [w, "added"], 3: [w]}[rng.randint(0, 2) if j in where else 3]
        at = rng.randint(0, 60)
        texts.append(" ".join(prose(60, k)[:at] + copy + prose(60, k)[at:]))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in D.contaminated(frame(texts), bench).collect()}
    assert got == {(k, k % len(items)): distance(items[k % len(items)], t.split()) for k, t in enumerate(texts)}


def test_leaks_of_short_items_and_empty_tables(spark, frame):
    bench = spark.createDataFrame([(1, "Two words."), (2, "two words"), (3, "x")], "item_id long, text string")
    got = D.contaminated(frame(["see two WORDS, here", "two other words", "two"], ids=[7, 8, None]), bench).collect()
    assert sorted((r["doc_id"], r["item_id"], r["start_word"], r["n_words"]) for r in got) == [(7, 1, 1, 2), (7, 2, 1, 2)]
    assert D.contaminated(frame([]), bench).collect() == [] and D.contaminated(frame(["a"]), bench.limit(0)).collect() == []


def test_items_in_blocks_of_bounded_bytes(spark, frame):
    items = [(i, " ".join(f"w{i}x{k}" for k in range(10))) for i in range(30)] + [(99, "one repeated item of some seven or more words here")] * 20
    items += [(200 + i, " ".join(f"long{i}x{k}" for k in range(300))) for i in range(4)] + [(None, "an item without an id has words as well"), (5, None), (6, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    blocks = [b.collect() for b in D.item_blocks(bench, 10, 1000)]
    sizes = [sorted(len(r["text"] or "") for r in b) for b in blocks]
    assert len(blocks) > 5 and all(len(b) <= 11 and sum(s) <= 1000 + s[-1] for b, s in zip(blocks, sizes, strict=True))
    assert sorted(map(repr, (r for b in blocks for r in b))) == sorted(map(repr, bench.collect()))
    docs = frame([f"see {t} there" for _, t in items if t] + ["no match", None], ids=[*range(len([t for _, t in items if t])), None, None])
    docs = docs.unionByName(frame([items[0][1]], ids=[None]))
    rows = lambda **options: sorted(map(repr, D.contaminated(docs, bench, **options).collect()))
    whole = rows()
    assert len(whole) == 30 + 1 + 20 * 20 + 4 + 1 and whole == rows(block=10, block_bytes=1000)


def test_nearest_window():
    word = lambda s: np.array([ord(c) for c in s], np.uint64)
    assert D.nearest(word("abc"), word("xxabcxx")) == (0, 2, 5)
    assert D.nearest(word("abcd"), word("xxabdxx"))[0] == 1
