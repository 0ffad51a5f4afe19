"""Near copies against all pairs."""

import itertools
import random

import numpy as np
import pytest
from llm_helpers import prose

from palimpsest.llm import minhash as M


def shingles(text, n=4):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, num=80):
    sets, parent = [(i, shingles(t)) for i, t in rows], {i: i for i, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= num * len(x | y):
            p, q = sorted((top(a), top(b)))
            parent[q] = p
    return {(i, len(s), top(i), top(i) == i) for i, s in sets}


def check(df, rows, **options):
    got = M.near_copies(df, **options).collect()
    assert len(got) == len(rows)
    assert {tuple(r) for r in got if r["doc_id"] is not None} == brute([r for r in rows if r[0] is not None], options.get("num", 80))


def changed(words, rng, most):
    words = list(words)
    for _ in range(rng.randint(0, most)):
        words[rng.randrange(len(words))] = prose(1, rng.random())[0]
    return " ".join(words)


def test_components_equal_brute_force(frame):
    rng = random.Random(1)
    texts = [changed(base, rng, 1 + seed) for seed in range(10) for base in [prose([6, 40, 120, 300][seed % 4], seed)] for _ in range(12)]
    texts += [" ".join(prose(30, 100 + i)) + " some passage that very many of the texts here have in common with others of them" for i in range(40)]
    check(frame(texts), list(enumerate(texts)))


def test_hot_keys_are_split_and_lose_no_link(frame, monkeypatch):
    passage = " ".join(prose(150, 1))
    rng = random.Random(2)
    texts = []
    for k in range(60):  # most of a text is the same passage, so all share bands, and pairs link only within families of two
        own = prose(60, 1000 + k // 2)
        texts.append(passage + " " + changed(own, rng, 1))
    used = []
    whole = M._split
    monkeypatch.setattr(M, "_split", lambda families, *a: used.append(families.count()) or whole(families, *a))
    check(frame(texts), list(enumerate(texts)), cross=0)
    assert used and used[0] > 0


def test_blocks_lose_no_link(frame, spark):
    rng = random.Random(3)
    texts = [changed(prose(80, seed), rng, 6) for seed in range(6) for _ in range(15)]
    signed = M.signatures(frame(texts).select("doc_id", "text"), 4).selectExpr("doc_id as node", "n_shingles as size", "signature")
    families = signed.selectExpr("1L as family", "node", "node as part")
    nodes = signed.selectExpr("node", "node as doc_id")
    full = M._sets_of(frame(texts).select("doc_id", "text"), nodes, 4)
    sets = [shingles(t) for t in texts]
    links = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}

    def top(pairs):
        parent = list(range(len(texts)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[max(find(a), find(b))] = min(find(a), find(b))
        return [find(x) for x in range(len(texts))]

    for options in ({"block": 16}, {"block": 1000}, {"members": 600}):
        found = {tuple(r) for r in M.blocked(families, signed, full, 80, 100, **options).collect()}
        assert found <= links and top(found) == top(links)


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(7)
    for share in (0.5, 0.8, 0.95):
        seen = []
        for _ in range(60):
            n = 300
            both = rng.integers(0, 2**63, n, np.int64).astype(np.uint64)
            extra = round(n * (1 - share) / share / 2)
            x, y = (np.unique(np.concatenate([both, rng.integers(0, 2**63, extra, np.int64).astype(np.uint64)])) for _ in "xy")
            a, b = M.minima([x, y])
            seen.append((a == b).mean())
        assert abs(np.mean(seen) - n / (n + 2 * extra)) < 0.02
        assert np.std(seen) < 1.5 * (share * (1 - share) / M.HASHES) ** 0.5


def test_bounds_follow_the_posterior():
    """Least matches against the posterior's integral, and misses of pairs at the threshold."""
    for n, m in M.least_matches(0.8, 1e-4):
        x = np.linspace(0, 1, 400001)
        density = np.exp(np.clip(m * np.log(np.maximum(x, 1e-300)) + (n - m) * np.log(np.maximum(1 - x, 1e-300)), -700, 0))
        at, before = (density[x >= 0.8].sum() / density.sum() for density in (density, np.where(x < 1, density / np.maximum(x, 1e-300) * (1 - x), 0)))
        assert at >= 1e-4 > before
    rng = np.random.default_rng(1)
    same = rng.random((20000, M.HASHES)) < 0.8
    size = np.full(20000, 100)
    assert len(M.bounds(80, 100)(same.astype(np.uint8), np.ones_like(same, np.uint8), size, size)) == 20000
    far = rng.random((2000, M.HASHES)) < 0.4
    assert len(M.bounds(80, 100)(far.astype(np.uint8), np.ones_like(far, np.uint8), size[:2000], size[:2000])) == 0


def test_all_kinds_of_rows(frame):
    long = " ".join(prose(30000, 3))
    texts = [None, "", " \n", "one two", "ONE\ttwo", "a b c d", "A b c d", long, long + " x", "é ü ß a b", "é ü ß a b"]
    check(frame(texts), list(enumerate(texts)))
    got = sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in M.near_copies(frame(["a b c d e", "a b c d e", "x y", "p q r s t", "x y"], ids=[5, None, 5, 4, 3])).collect())
    assert got == [(0, None, True), (3, 3, True), (4, 4, True), (5, 3, False), (5, 3, False)]
    assert M.near_copies(frame([])).collect() == []
    with pytest.raises(ValueError):
        M.near_copies(frame([]), num=0)


def test_hot_keys_cost_three_passes_over_the_texts(frame, monkeypatch):
    """Pairs of the cold keys and of the rarest shingles are confirmed together, by components that are found once."""
    passage = " ".join(prose(150, 1))
    rng = random.Random(4)
    texts = [passage + " " + changed(prose(60, 1000 + k // 2), rng, 1) for k in range(40)]
    passes = []
    for name in ("_confirmed", "components"):
        monkeypatch.setattr(M, name, lambda *a, name=name, whole=getattr(M, name): passes.append(name) or whole(*a))
    check(frame(texts), list(enumerate(texts)), cross=0)
    assert passes.count("_confirmed") == 3 and passes.count("components") == 3


def test_components_that_end_early_are_sound(spark):
    links = [(i, i + 1) for i in range(40)] + [(i, 100) for i in range(101, 140)]
    whole, early = ({r["node"]: r["component"] for r in M.components(spark.createDataFrame(links, "a long, b long"), few).collect()} for few in (0, 1))
    assert whole == {i: 0 if i <= 40 else 100 for i in range(140) if i <= 40 or i >= 100}
    assert early.keys() == whole.keys() and all(whole[label] == whole[node] for node, label in early.items())
    assert {early[i] for i in range(100, 140)} == {100}
