"""Vector codes against plain arithmetic."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm.vector_codes import Codes, nearest, summed_by

ROWS = "vec_id long, embedding array<float>, label int, code string, group_ int"


def brute(rows, parts, entries, rounds, scale):
    """Codes and errors of (id, vector) rows of one length that the parts divide."""
    whole = [[math.floor(scale * float(np.float32(x))) for x in v] for _, v in rows]
    width = len(whole[0]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(range(len(rows)), key=lambda i: rows[i][0])[:entries]
    books = [[cut(whole[i], p) for i in first] for p in range(parts)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    best = lambda v, p: min(range(len(books[p])), key=lambda e: (far(cut(v, p), books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            own = [best(v, p) for v in whole]
            for e in range(len(books[p])) if own else []:
                members = [cut(v, p) for v, o in zip(whole, own, strict=True) if o == e]
                if members:
                    books[p][e] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    return books, [(i, [best(v, p) for p in range(parts)], sum(far(cut(v, p), books[p][best(v, p)]) for p in range(parts))) for (i, _), v in zip(rows, whole, strict=True)]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, k % 3 if k % 7 else None, "c", 1) for k, (i, v) in enumerate(rows)], ROWS)


@pytest.mark.parametrize("parts,entries,rounds", [(8, 16, 6), (2, 3, 2), (1, 300, 1)])
def test_codes_equal_brute_force(spark, parts, entries, rounds):
    rng = np.random.default_rng(parts)
    rows = [(int(i), [float(x) for x in rng.normal(size=16)]) for i in rng.permutation(400)]
    rows[5:9] = [(r[0], rows[4][1]) for r in rows[5:9]]  # equal vectors
    made = Codes(vectors(spark, rows).repartition(7), parts, entries, rounds, 100.0)
    books, want = brute(rows, parts, entries, rounds, 100.0)
    assert made.books.tolist() == books
    coded = {r["vec_id"]: (bytes(r["code"]), r["error"]) for r in made.rows.collect()}
    kind = ">u2" if entries > 256 else "u1"
    assert {i: (np.frombuffer(c, kind).tolist(), e) for i, (c, e) in coded.items()} == {i: (c, e) for i, c, e in want}
    code, error = coded[rows[0][0]]
    whole = np.floor(100.0 * np.array(rows[0][1], np.float32).astype(float))
    assert ((made.decoded(code) - whole) ** 2).sum() == error


def test_bad_ragged_and_missing_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5] * 8), (2, None), (3, [0.1, None]), (4, [nan] * 8), (5, [inf] + [0.0] * 7), (6, [0.5] * 3), (7, []), (None, [1.0] * 9), (1, [0.5] * 8)]
    made = Codes(vectors(spark, rows), parts=4, entries=2, rounds=3, scale=10.0)
    assert made.books.shape == (4, 2, 3)
    got = sorted((r["vec_id"] or 0, r["error"]) for r in made.rows.collect())
    assert [i for i, _ in got] == [0, 1, 1, 6, 7]
    empty = Codes(vectors(spark, rows[:0]))
    assert empty.rows.collect() == [] and empty.books.size == 0
    only = Codes(vectors(spark, [(1, []), (2, [])]))
    assert sorted((r["vec_id"], r["error"]) for r in only.rows.collect()) == [(1, 0), (2, 0)]
    with pytest.raises(ValueError):
        Codes(vectors(spark, rows), entries=0)


def test_sums_by_label_keep_nulls_together(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), (1, 4), (2, 8), (1, 16), (3, 2**63 - 1), (3, 5)], "label int, error long")
    got = sorted((r["label"] or 0, r["error"], r["s"]) for r in summed_by(rows, "label", "error", "s").collect())
    assert got == [(0, 1, 3), (0, 2, 3), (1, 4, 20), (1, 16, 20), (2, 8, 8), (3, 5, None), (3, 2**63 - 1, None)]
    assert summed_by(rows.filter(F.lit(False)), "label", "error", "s").collect() == []


def test_ties_go_to_the_lower_entry():
    index, least = nearest(np.array([[0, 5, 9]]), np.array([[[0], [10], [0]]]))
    assert index.tolist() == [[0, 0, 1]] and least.tolist() == [[0, 25, 1]]
