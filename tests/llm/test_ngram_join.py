import itertools
import random

import pytest
from llm_helpers import prose

from palimpsest.llm import ngram_join as J


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows, num=75):
    """(n, component) of each (id, text)."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= num * len(x | y):
            p, q = sorted((top(a), top(b)))
            parent[q] = p
    return {i: top(i) for i, _ in sets}, {(i, len(s)) for i, s in sets}


def check(df, rows, **options):
    got = J.jaccard_components(df, **options).collect()
    parts, sizes = brute([r for r in rows if r[0] is not None], options.get("num", 75))
    assert {(r["doc_id"], r["n_shingles"]) for r in got if r["doc_id"] is not None} == sizes
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == parts
    assert len(got) == len(rows)


def family(seed, n, edits):
    rng, base = random.Random(seed), prose(rng_len(seed), seed)
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = prose(1, rng.random())[0]
        out.append(" ".join(words))
    return out


def rng_len(seed):
    return [12, 30, 90, 250][seed % 4]


@pytest.mark.parametrize("cross", [4, 0])
def test_components_equal_brute_force(frame, cross):
    texts = [t for seed in range(12) for t in family(seed, 12, 1 + seed)]
    texts += [" ".join(prose(40, 100 + i)) + " shared line of words that many texts have in common here" for i in range(40)]
    check(frame(texts), list(enumerate(texts)), cross=cross)


@pytest.mark.parametrize("num", [50, 60, 95])
def test_other_thresholds_equal_brute_force(frame, num):
    texts = [" ".join(prose(n + 4, seed)) for seed in range(8) for n in (1, 2, 3, 4, 6, 8, 190, 300)]  # runs of one text, of which the shorter is the longer's start
    texts += [t for seed in range(8) for t in family(50 + seed, 6, 4 + seed)]
    check(frame(texts), list(enumerate(texts)), num=num)


def test_a_threshold_of_nothing_fails(frame):
    with pytest.raises(ValueError):
        J.jaccard_components(frame([]), num=0)


def test_chains_link_through_members(frame):
    words = prose(100, 7)
    texts = [" ".join(words[i * 4 : 60 + i * 4]) for i in range(10)]
    check(frame(texts), list(enumerate(texts)))


def test_edge_cases(frame):
    long = " ".join(prose(30000, 3))
    texts = [None, "", " \n", "one two", "ONE\ttwo", "a b c d e", "a b c d e", long, long + " x", "é ü ß a b c", "é ü ß a b c"]
    check(frame(texts), list(enumerate(texts)))
    got = J.jaccard_components(frame(["a b c d e", "a b c d e", "x y"], ids=[5, None, 5])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None) == [(5, 5), (5, 5)]
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]


def test_an_empty_table(frame):
    assert J.jaccard_components(frame([])).collect() == []


def test_sketch_bounds_the_difference():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (3, 10, 200, 5000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64))
        b = np.unique(np.concatenate([a[n // 8 :], rng.integers(0, 2**63, n // 10, dtype=np.int64).astype(np.uint64)]))
        x, y = J.parity(a), J.parity(b)
        short = min(len(x), len(y))
        assert int(np.bitwise_count(J.fold(x, short) ^ J.fold(y, short)).sum()) <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("t", [0.75, 0.5, 0.3, 0.95])
def test_bands_of_linking_sizes_meet(t):
    for n in range(1, 3000):
        own = {b for b, *_ in J.bands(n, t)}
        for m in {n, int(n / t), int(n / t / 1.2)}:
            if m >= n and int((n + m) * (1 - t) / (1 + t) + 1e-9) >= 1:
                assert own & {b for b, *_ in J.bands(m, t)}, (n, m)


def test_the_driver_gives_freed_native_memory_back(spark):
    """The join's many exchanges have threads of their own, whose freed memory stayed in the pools of the driver's allocator."""
    import gc
    import re
    from pathlib import Path

    from palimpsest.llm.session import tidy

    pid = spark._jvm.ProcessHandle.current().pid()
    mb = lambda: int(re.search(r"\nAnonymous:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text())[1]) / 1024
    made = [spark._jvm.java.util.zip.Deflater() for _ in range(400)]  # each takes native memory
    for d in made:
        d.setInput(bytearray(100))
        d.deflate(bytearray(1000))
    for i, d in enumerate(made):
        if i % 40:  # the others keep the pool from shrinking by itself
            d.end()
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
    was = mb()
    tidy(spark)
    assert mb() < was - 20
    for d in made[::40]:
        d.end()
