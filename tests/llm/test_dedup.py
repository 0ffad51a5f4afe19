"""Line and substring dedup."""

from llm_helpers import prose

from palimpsest.llm import line_dedup as L
from palimpsest.llm import substring_dedup as S


def lines_brute(texts):
    rows = [(d, i, line.encode().lower().split()) for d, t in enumerate(texts) for i, line in enumerate((t or "").split("\n")) if line.split()]

    def near(a, b):
        if a == b:
            return True
        if max(len(a), len(b)) < 8 or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(a == b[:i] + b[i + 1 :] for i in range(len(b)))

    out = {d: (0, []) for d in range(len(texts))}
    for k, (d, i, w) in enumerate(rows):
        kept = out.setdefault(d, (0, []))
        out[d] = (kept[0] + 1, kept[1] + ([i] if any(near(w, v) for _, _, v in rows[:k]) else []))
    return out


def test_lines_equal_brute_force(frame):
    base = [" ".join(prose(10, s)) for s in range(6)]
    texts = []
    for k in range(30):
        words = base[k % 6].split()
        if k % 5 == 1:
            words[k % 10] = "changed"
        if k % 5 == 2:
            words.insert(k % 11, "added")
        if k % 5 == 3:
            del words[k % 10]
        if k % 5 == 4:
            words[1], words[2] = "both", "new"
        texts.append("\n".join([" ".join(words), " ".join(prose(9, 50 + k)), "short line", ""]))
    texts += [None, "", " \n\t\n ", "a a b c d e f g h", "a a x c d e f g h", "Short  LINE"]
    got = {r["doc_id"]: (r["n_lines"], r["dropped"]) for r in L.dedup_lines(frame(texts), bits=1 << 16).collect()}
    assert got == lines_brute(texts)


def test_lines_of_an_empty_table_and_of_null_ids(frame):
    assert L.dedup_lines(frame([]), bits=1 << 16).collect() == []
    got = {r["doc_id"]: r["n_dropped"] for r in L.dedup_lines(frame(["one line", "one line"], ids=[None, 3]), bits=1 << 16).collect()}
    assert got == {None: 0, 3: 1}
    rows = L.dedup_lines(frame(["x y\nz", "x y\nz", "", "", None, "q\nx  Y"], ids=[5, 5, 6, 6, None, 7]), bits=1 << 16).collect()
    assert sorted((r["doc_id"] or 0, r["n_lines"], r["n_dropped"], r["dropped"]) for r in rows) == [(0, 0, 0, []), (5, 2, 0, []), (5, 2, 0, []), (6, 0, 0, []), (6, 0, 0, []), (7, 2, 1, [1])]


def test_edits():
    assert L.near_words(list("abc"), list("abx")) and L.near_words(list("abc"), list("abxc")) and L.near_words(list("abc"), list("abc"))
    assert not L.near_words(list("abc"), list("axcx")) and not L.near_words(list("abc"), list("a"))


def test_chunks_cover_texts_and_move_with_insertions():
    import numpy as np

    text = " ".join(prose(4000, 1)).encode()
    data = np.frombuffer(text, np.uint8)
    starts, ends = S.chunks(data, np.array([0, len(text)]))
    assert starts[0] == 0 and ends[-1] == len(text) and (starts[1:] == ends[:-1]).all() and (ends - starts).max() <= S.LONGEST
    moved = np.frombuffer(b"inserted words " + text, np.uint8)
    again = S.chunks(moved, np.array([0, len(moved)]))
    own = {text[a:b] for a, b in zip(starts, ends, strict=True)}
    other = {moved.tobytes()[a:b] for a, b in zip(*again, strict=True)}
    assert len(own & other) >= len(own) - 3
    plain = np.full(5000, 97, np.uint8)
    assert (np.diff(S.chunks(plain, np.array([0, 5000]))[1]) <= S.LONGEST).all()


def test_passages_are_found_and_clean_texts_left_alone(frame):
    passage = " ".join(prose(55, 9))
    texts = [" ".join(prose(120, 20 + k)) for k in range(40)]
    for k in (3, 11, 12, 30):
        words = texts[k].split()
        texts[k] = " ".join(words[: 20 + k]) + " " + passage + " " + " ".join(words[20 + k :])
    texts += [texts[0], None, "", "tiny"]
    rows = S.repeated_passages(frame(texts)).collect()
    assert {r["doc_id"] for r in rows} == {11, 12, 30, 40} and {r["kept_doc_id"] for r in rows if r["doc_id"] != 40} == {3}
    whole = next(r for r in rows if r["doc_id"] == 40)
    assert (whole["start_byte"], whole["n_bytes"], whole["kept_doc_id"]) == (0, len(texts[0]), 0)
    for r in rows:
        mine = texts[r["doc_id"]].encode()[r["start_byte"] : r["start_byte"] + r["n_bytes"]]
        assert mine in texts[r["kept_doc_id"]].encode()


def test_passages_of_an_empty_table_null_ids_and_equal_rows(frame):
    assert S.repeated_passages(frame([])).collect() == []
    text = " ".join(prose(80, 5))
    rows = S.repeated_passages(frame([text, text, text], ids=[None, 4, 4])).collect()
    assert [(r["doc_id"], r["kept_doc_id"]) for r in rows] == [(4, None)]


def whole(rows, texts, passages, but=0):
    """How many (doc, passage) are inside a reported span of their document, but for ``but`` bytes; every span must stand in its kept text."""
    for r in rows:
        mine = texts[r["doc_id"]].encode()[r["start_byte"] : r["start_byte"] + r["n_bytes"]]
        assert mine in texts[r["kept_doc_id"]].encode() and r["n_words"] >= 50
    spans = {}
    for r in rows:
        spans.setdefault(r["doc_id"], []).append((r["start_byte"], r["start_byte"] + r["n_bytes"]))
    found = 0
    for d, p in passages:
        at = texts[d].encode().find(p.encode())
        found += any(min(b, at + len(p.encode())) - max(a, at) >= len(p.encode()) - but for a, b in spans.get(d, []))
    return found


def test_periodic_passages_are_found_whole(frame):
    passages = ["a b c " * 150, "ab " * 200, "x " * 90, "one two three four five six seven eight nine ten eleven " * 12]
    texts = [" ".join([*prose(40, 10 * i + j), p.strip(), *prose(40, 500 + 10 * i + j)]) for i, p in enumerate(passages) for j in range(2)]
    rows = S.repeated_passages(frame(texts)).collect()
    # Periodic text agrees with itself a few periods on, so an end of a span may be that far from the passage's.
    assert whole(rows, texts, [(2 * i + 1, p.strip()) for i, p in enumerate(passages)], 64) == 4
    assert len(rows) < 40


def test_passages_of_short_words_and_of_lines_that_stand_elsewhere(frame):
    import random

    rng = random.Random(3)
    short = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60)) for _ in range(40)]
    texts, wanted = [], []
    for i, p in enumerate(short):
        for j in range(2):
            texts.append(" ".join([*prose(30, 2000 + 2 * i + j), p, *prose(30, 3000 + 2 * i + j)]))
        wanted.append((len(texts) - 1, p))
    assert whole(S.repeated_passages(frame(texts)).collect(), texts, wanted) >= 36
    texts, wanted = [], []
    for i in range(12):  # lines of a passage alone in earlier documents, then documents that have them all in a row
        lines = [" ".join(prose(30, 100 * i + k)) for k in range(5)]
        texts += [" ".join([*prose(20, 5000 + 10 * i + k), line, *prose(20, 6000 + 10 * i + k)]) for k, line in enumerate(lines)]
        for j in range(2):
            texts.append(" ".join([*prose(20, 7000 + 2 * i + j), *lines, *prose(20, 8000 + 2 * i + j)]))
        wanted.append((len(texts) - 1, " ".join(lines)))
    for i in range(40):  # a phrase of the passage stands in an earlier document
        words = prose(150, 9000 + i)
        texts.append(" ".join([*prose(20, 9100 + i), *words[60:72], *prose(20, 9200 + i)]))
        for j in range(2):
            texts.append(" ".join([*prose(20, 9300 + 2 * i + j), *words, *prose(20, 9400 + 2 * i + j)]))
        wanted.append((len(texts) - 1, " ".join(words)))
    assert whole(S.repeated_passages(frame(texts)).collect(), texts, wanted) == 52
