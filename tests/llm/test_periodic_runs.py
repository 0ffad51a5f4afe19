"""Runs against all stretches tried one by one."""

import random

import numpy as np
import pytest

from palimpsest.llm import periodic_runs as P


def brute(words, least=6, times=4):
    n, out = len(words), set()
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            smaller = any(all(words[k] == words[k + d] for k in range(i, i + length - d)) for d in range(1, q))
            if length >= max(least, times * q) and not smaller:
                out.add((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences(seed):
    rng = random.Random(seed)
    for _ in range(40):
        n, letters = rng.randint(0, 60), rng.choice([1, 2, 3, 8])
        words = [rng.choice("abcdefgh"[:letters]) for _ in range(n)]
        if n and rng.random() < 0.6:  # a planted run with something before and after
            unit = words[: rng.randint(1, 7)]
            words = words[:9] + (unit * 9)[: rng.randint(1, 60)] + words[9:]
        yield words
    yield list("ab") * 40 + list("abc") * 30 + ["a"] * 20


@pytest.mark.parametrize("seed,least,times", [(1, 6, 4), (2, 1, 2), (3, 6, 4), (4, 2, 3), (5, 30, 4)])
def test_runs_equal_brute_force(monkeypatch, seed, least, times):
    every = list(sequences(seed))
    want = [brute(w, least, times) for w in every]
    number = [P._numbers([x.encode() for x in w]) for w in every]
    assert [[tuple(r) for r in found.tolist()] for found in P.runs_of(number, least, times)] == want
    monkeypatch.setattr(P, "GRID", 7)  # slices of a few pairs, a text at a time
    monkeypatch.setattr(P, "TOGETHER", 1)
    assert [[tuple(r) for r in found.tolist()] for found in P.runs_of(number, least, times)] == want


def test_extensions_equal_comparison():
    rng = np.random.default_rng(3)
    s = np.append(rng.integers(0, 2, 80), 9)
    found = P.Extensions(s)
    x, y = np.triu_indices(len(s), 1)
    for a, b, n in zip(x, y, found.between(x, y), strict=True):
        assert n == next(k for k in range(len(s)) if s[a + k] != s[b + k])


def test_rows_of_all_kinds(frame):
    long = " ".join(["one", "two"] * 30000)
    texts = [None, "", " \n", "a a a a a a", "a a a a a", "A a A a A a A a x", long, "x\ty\nx y  x y x y z", "x y x y x y x y"]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, None]
    rows = {r["doc_id"]: r for r in P.periodic_runs(frame(texts, ids)).collect()}
    assert len(rows) == 9
    plain = {i: ([tuple(x) for x in r["runs"]], r["collapsed"], r["n_words"]) for i, r in rows.items()}
    assert plain[0] == plain[1] == plain[2] == ([], "", 0)
    assert plain[3] == ([(0, 6, 1)], "a", 6) and plain[4] == ([], "a a a a a", 5)
    assert plain[5] == ([(0, 8, 2)], "A a x", 9) and plain[6] == ([(0, 60000, 2)], "one two", 60000)
    assert plain[7] == ([(0, 8, 2)], "x y z", 9) and plain[None] == ([(0, 8, 2)], "x y", 8)
    assert P.periodic_runs(frame([])).collect() == []
    again = P.periodic_runs(frame(["a a a a a a"] * 3, [1, 1, 1])).collect()
    assert [r["n_words"] for r in again] == [6, 6, 6]
    with pytest.raises(ValueError):
        P.periodic_runs(frame([]), times=1)


def test_query_over_repeating_tails_equals_brute_force(spark, tmp_path):
    import hashlib
    import zlib

    from palimpsest.llm.queries import op12_periodic_runs

    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 90))) if i % 17 else None) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in op12_periodic_runs(spark, str(tmp_path)).collect()}
    planted = 0
    for i, text in rows:
        words, h = (text or "").split(), zlib.crc32(str(i).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k if k < a else a + (k - a) % p] for k in range(n)]
            planted += 1
        runs = brute(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        r = got[i]
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest()
    assert planted > 15
