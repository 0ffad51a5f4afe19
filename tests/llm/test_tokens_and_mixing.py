"""Token files and mixing."""

import struct
import zlib

import numpy as np
import pytest
from llm_helpers import prose

from palimpsest.llm import mixing, token_files
from palimpsest.llm.queries import tokenizer_path


@pytest.mark.parametrize("width", [1, 8])
def test_files_round_trip(width):
    rng = np.random.default_rng(1)
    for counts in ([], [1], [3, 0, 70000, 5]):
        ids = rng.integers(0, 50257, sum(counts)).astype("<u4")
        raw = token_files.write_file(np.arange(len(counts)), np.ones(len(counts), bool), np.array(counts, np.int64), ids, width)
        found = token_files.TokenFile(raw)
        assert found.ids().tolist() == ids.tolist() and found.counts.tolist() == counts
    assert token_files.TokenFile(raw).block(1).tolist() == ids[1 << 16 :].tolist()
    with pytest.raises(ValueError):
        token_files.TokenFile(b"XXXX" + raw[4:])


def test_ids_and_places_equal_the_tokenizer(spark, frame, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    said = [" ".join(prose(30, i)) for i in range(40)]
    said += [None, "", " ", "a  b", " lead", "trail \n", "it's <|endoftext|> x", "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|> ", "<|endoftext", "a plain one", "  <|endoftext|>\n" + "long " * 5000, "é  b c", "　x y", "tab\t x", "emoji \U0001f600 y", "a \x1c b", "x" * 30000, "word " * 20000, "x  y  z"]
    ids = [100 - i for i in range(len(said))]
    rows = {r["doc_id"]: r for r in token_files.tokens_round_trip(frame(said, ids), tokenizer_path(), str(tmp_path / "t")).collect()}
    assert plain.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    start = 0
    for i, t in sorted(zip(ids, said, strict=True)):
        own = plain.encode(t or "", add_special_tokens=False).ids + [0]
        r = rows[i]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own))), t
        start += len(own)


def test_tokens_of_equal_and_null_ids_and_of_nothing(spark, frame, tmp_path):
    rows = token_files.tokens_round_trip(frame(["b", "a", "c"], [2, None, 2]), tokenizer_path(), str(tmp_path / "t")).collect()
    assert sorted((r["start"], r["n_tokens"]) for r in rows) == [(0, 2), (2, 2), (4, 2)] and next(r["start"] for r in rows if r["doc_id"] is None) == 0
    assert token_files.tokens_round_trip(frame([]), tokenizer_path(), str(tmp_path / "e")).collect() == []


def test_rows_without_an_id_and_of_one_id_fill_several_shards(frame, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    monkeypatch.setattr(token_files, "SHARD_BYTES", 2000)
    said = [" ".join(prose(20, i)) for i in range(60)] + ["the same text"] * 200 + [" ".join(prose(15, 99 + i)) for i in range(60)]
    ids = [None] * 60 + [None] * 200 + [7] * 60
    docs = frame(said, ids)
    got = token_files.tokens_round_trip(docs, tokenizer_path(), str(tmp_path / "t")).orderBy("start").collect()
    files = docs.sparkSession.read.parquet(str(tmp_path / "t")).select("shard", "documents").collect()
    assert len({f["shard"] for f in files}) > 4 and max(f["documents"] for f in files) < 160
    assert [r["doc_id"] for r in got] == [None] * 260 + [7] * 60
    own = lambda t: plain.encode(t, add_special_tokens=False).ids + [0]
    crc = lambda x: zlib.crc32(struct.pack(f"<{len(x)}I", *x))
    assert sorted(r["ids_crc32"] for r in got) == sorted(crc(own(t)) for t in said)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]


def targets_brute(sizes):
    """Resharing of the excess until no target is above twice its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    out, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = 2 * sizes[s]
        left -= sum(out[s] for s in over)
        free -= set(over)
    return out


def test_mix_meets_its_targets(frame):
    said, sources = [], []
    for k in range(400):
        said.append(" ".join(prose((k * 7) % 60 + (500 if k % 90 == 0 else 1), k)))
        sources.append(["a", "B", "é", None, "c", "tiny"][(k * k) % 6 if k < 395 else 5])
    said += ["same text of five words"] * 200 + [None, ""]
    sources += ["a"] * 200 + ["c", "empty"]
    rows = mixing.rates(frame(said, sources=sources)).collect()
    sizes = {}
    for t, s in zip(said, sources, strict=True):
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    wanted, taken = targets_brute(sizes), {}
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - wanted[r["source"]]) < 1e-6 and r["size"] == len((said[r["doc_id"]] or "").split())
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - wanted[s]) <= max(10, 0.02 * wanted[s]) for s in sizes)
    again = mixing.rates(frame(said, sources=sources)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in again)


def test_mixed_rows_keep_their_columns(frame):
    docs = frame([" ".join(prose(9, i)) for i in range(30)] + [None], sources=["a", "b", "c"] * 10 + ["a"])
    copies = {r["doc_id"]: r["copies"] for r in mixing.rates(docs).collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    found = {}
    for r in out.collect():
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + 1
    assert found == {i: c for i, c in copies.items() if c}


def test_rows_that_differ_in_other_columns_keep_their_own_copies(frame):
    docs = frame(["a b"] * 10, ids=[1] * 10)
    langs = [f"l{i}" if i else None for i in range(10)]
    rows = [(*list(r)[:2], lang, *list(r)[3:]) for r, lang in zip(docs.collect(), langs, strict=True)]
    found = {}
    for r in mixing.mixed(docs.sparkSession.createDataFrame(rows, docs.schema)).collect():
        found[r["lang"]] = found.get(r["lang"], 0) + 1
    assert set(found) == set(langs) and sum(found.values()) == 15 and max(found.values()) == 2


def test_mix_of_nothing_and_of_equal_rows(frame):
    assert mixing.rates(frame([])).collect() == [] and mixing.mixed(frame([])).collect() == []
    rows = mixing.rates(frame(["", None])).collect()
    assert [r["taken"] for r in rows] == [0, 0]
    equal = mixing.rates(frame(["a b", "a b", "a b", "a b"], ids=[1, 1, None, None])).collect()
    assert sum(r["taken"] for r in equal) == 12
