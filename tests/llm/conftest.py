from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, key string"


@pytest.fixture
def frame(spark):
    """A documents table with columns whose names the operators use inside."""

    def make(texts, ids=None, sources=None):
        ids = list(range(len(texts))) if ids is None else ids
        sources = ["s"] * len(texts) if sources is None else sources
        rows = [(i, t, "en", s, len(t or ""), 1, "k") for i, t, s in zip(ids, texts, sources, strict=True)]
        return spark.createDataFrame(rows, DOCS)

    return make
