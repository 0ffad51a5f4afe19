import numpy as np

from palimpsest.llm import shared_keys as K
from palimpsest.llm.words import span_hashes


def by_word():
    """A key for each word; made here so that workers get it by value."""

    def expand(chunk):
        data, starts, ends, at = chunk.words()
        place = np.repeat(np.arange(len(at) - 1), np.diff(at))
        return chunk.ids, chunk.ids * 2, span_hashes(data, starts, ends), place, np.arange(len(starts))

    return expand


def test_only_shared_keys_come_and_all_of_them(frame):
    texts = ["a b c", "b d", "e f f", "g", "c b", None, ""] + ["hot"] * 50
    for options in ({}, {"packet": 2, "each": 2}):
        rows = K.shared_keys(frame(texts).select("doc_id", "text"), by_word(), 100, **options).collect()
        by = {}
        for r in rows:
            by.setdefault(r["key"], []).append(r["owner"])
            assert r["remark"] == 2 * r["owner"]
        assert sorted(sorted(x) for x in by.values()) == sorted([[0, 1, 4], [0, 4], [2, 2], list(range(7, 57))])


def test_with_distinct_owners_a_text_alone_shares_nothing(frame):
    rows = K.shared_keys(frame(["f f", "g h", "h h"]).select("doc_id", "text"), by_word(), 10, distinct=True).collect()
    assert sorted({r["owner"] for r in rows}) == [1, 2]
