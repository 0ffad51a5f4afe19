"""Styles and memory in a tokenizer's tokens, against its own cuts."""

import os
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import tokens as Tokens
from palimpsest.functions.text import clean_note, clean_reasoning, one_line
from palimpsest.operators import history as H
from palimpsest.plans.steps import annotate

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
STEPS = "traj long, idx long, type string, query string, docid string, returned array<string>, output string"
QUESTION = "Which painter of the old harbour was born on an island?"

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer here")


def said(rng, n):
    return " ".join(rng.choice(["harbour", "painter", "œuvre", "naïve", "été", "island-born", "1889", "unbelievably", "the", "of", "日本語", "a."]) for _ in range(n))


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(3)
    docs = [(str(i), said(rng, rng.choice([0, 5, 60, 400])) + ("\n\n x" if i % 2 else "")) for i in range(12)]
    steps = []
    for t in range(4):
        for i in range(40):
            kind = "search" if i == 0 else rng.choice(["search", "visit", "visit", "reasoning"])
            kind = "reasoning" if steps and steps[-1][2] == "visit" and steps[-1][0] == t and rng.random() < 0.8 else kind
            steps.append((t, i, kind, f"query {i}" if kind == "search" else None, str(rng.randrange(14)) if kind == "visit" else None, [] if kind == "search" else None, f"We saw {said(rng, rng.choice([3, 12, 90, 200]))}." if kind == "reasoning" else None))
    return annotate(spark.createDataFrame(steps, STEPS)).persist(), spark.createDataFrame(docs, "docid string, text string"), dict(docs)


def test_styles_are_cut_as_the_tokenizer_cuts(spark, made):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(TOKENIZER)
    cut = lambda x, n: own.decode(own.encode(x, add_special_tokens=False).ids[:n], skip_special_tokens=False)
    steps, corpus, docs = made
    rows = steps.withColumn("note", one_line(clean_note("reasoning", F.lit(QUESTION)))).orderBy("traj", "idx").collect()
    for style, (shows_docs, shows_notes, tags, n) in H.STYLES.items():
        if style not in ("i3", "i4", "i5"):
            continue
        want, past = {}, {}
        for r in rows:
            groups = past.setdefault(r["traj"], [])
            if r["type"] == "search":
                lines = []
                for k, (query, visits) in enumerate(groups, 1):
                    tag = lambda d, x: f"[docs_id:{d}] {x}" if tags else x
                    shown = [tag(d, cut(" ".join(docs.get(d, "").split()), n)) for d, _ in visits if docs.get(d, "").split()]
                    noted = [tag(d, cut(x, 128)) for d, x in visits if x]
                    lines.append(f"Previous SubQuery {k}: {query}")
                    lines += [f"Visited Documents: {' ; '.join(shown) or '<empty>'}"] * shows_docs + [f"Visited Document Notes: {' ; '.join(noted) or '<empty>'}"] * shows_notes
                want[r["traj"], r["idx"]] = lines
                groups.append((r["query"], []))
            elif r["type"] == "visit":
                groups[-1][1].append((r["docid"], r["note"]))
        got = {(r["traj"], r["idx"]): r["rendered"].split("\n") for r in H.rendered(steps, corpus, F.lit(QUESTION), style, tokens=TOKENIZER).collect()}
        assert {k: v[3:] for k, v in got.items()} == want
    assert any(len(own.encode(" ".join(t.split()), add_special_tokens=False).ids) > 64 for t in docs.values())


def test_memory_counts_tokens(spark, made):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(TOKENIZER)
    ids = lambda x: own.encode(x, add_special_tokens=False).ids
    steps, _, _ = made
    rows = steps.withColumn("clean", clean_reasoning("reasoning", F.lit(QUESTION))).orderBy("traj", "idx").collect()
    want, notes = {}, {}
    for r in rows:
        held = notes.setdefault(r["traj"], [])
        if r["type"] == "search":
            kept, used = [], 0
            for x in reversed(held):
                if len(x.split()) < 8:
                    continue
                snippet = own.decode(ids(x)[:64], skip_special_tokens=False)
                if used + len(ids(snippet)) > 256:
                    break
                kept.append(snippet)
                used += len(ids(snippet))
            want[r["traj"], r["idx"]] = " ; ".join(kept)
        elif r["type"] == "visit" and r["reasoning"]:
            held.append(r["clean"])
    got = {(r["traj"], r["idx"]): r["memory"] for r in H.with_memories(steps, F.lit(QUESTION), tokens=TOKENIZER).collect()}
    assert got == want and any(len(x) > 300 for x in want.values())


class Watched:
    """A tokenizer that notes how many characters it is given at once."""

    def __init__(self, own):
        self.own, self.most = own, 0

    def encode(self, text, **options):
        self.most = max(self.most, len(text))
        return self.own.encode(text, **options)

    def encode_batch(self, texts, **options):
        self.most = max(self.most, sum(map(len, texts)))
        return self.own.encode_batch(texts, **options)

    def decode(self, ids, **options):
        return self.own.decode(ids, **options)


def test_a_batch_of_long_texts_is_not_encoded_at_once(monkeypatch):
    """What a tokenizer makes of all texts of a batch doesn't fit in a worker."""
    import pyarrow as pa

    own = Watched(Tokens._tokenizer(TOKENIZER))
    monkeypatch.setattr(Tokens, "_tokenizer", lambda _: own)
    said = [" ".join(str(i * k) for k in range(500)) for i in range(40)]

    class Rows:
        """Stands for the distinct texts of a table; runs the function over one batch."""

        def __getattr__(self, _):
            return lambda *_: self

        def mapInArrow(self, run, _):  # noqa: N802
            return list(run(iter([pa.record_batch([pa.array(said)], names=["text"])])))

    monkeypatch.setattr(Tokens.F, "col", lambda name: name)
    (batch,) = Tokens.cuts(Rows(), "text", TOKENIZER, 64)
    assert batch.num_rows == 40 and max(batch.column("tokens").to_pylist()) <= 65
    assert own.most <= max(map(len, said))


def test_only_visited_documents_are_cut(spark, monkeypatch):
    """Each once: a filter on the cuts moved them below the join with the visited documents, and all documents were cut."""
    import pyarrow as pa
    from oracle import SF
    from palimpsest import catalog, catalog_io  # noqa: F401
    from palimpsest.plans import binding as bind
    from palimpsest.plans import steps as st

    cut = spark.sparkContext.accumulator(0)

    def counted(x, path, n):
        @F.arrow_udf("string")
        def count(batch: pa.Array) -> pa.Array:
            cut.add(len(batch))
            return Tokens._cut(batch, path, n)

        return count(x)

    monkeypatch.setattr(Tokens, "truncate_tokens", counted)
    rows = catalog.QUERIES["token_styles"](spark, SF)
    opened = st.visits(bind.annotated(spark, SF)).filter("turn > 0").select("docid").distinct()
    visited = bind.corpus(spark, SF).join(opened, "docid", "left_semi").count()
    assert visited < bind.corpus(spark, SF).count()
    assert {r["same"] for r in rows.collect()} == {True} and 0 < cut.value <= visited


@pytest.mark.parametrize(("name", "value"), [("NOTE_WORDS", 3), ("DOCID", "[id:"), ("NOW", "Now: "), ("REASONING", "Thoughts: "), ("BARE_QUERY", "Asked: ")])
def test_the_query_checks_whole_texts_of_all_styles(spark, monkeypatch, name, value):
    """Notes were never cut, nor anything before the past interactions compared, and only i3 was made."""
    from oracle import SF
    from palimpsest import catalog, catalog_io  # noqa: F401

    monkeypatch.setattr(H, name, value)
    assert False in {r["same"] for r in catalog.QUERIES["token_styles"](spark, SF).collect()}


@pytest.mark.parametrize("tokens", [None, TOKENIZER])
def test_all_styles_at_once_are_each_style_of_the_history(spark, made, tokens):
    steps, corpus, _ = made
    rows = H.in_styles(steps, corpus, F.lit(QUESTION), tokens=tokens)
    assert rows.columns == ["traj", "idx", *H.ALL_STYLES]
    got = {(r["traj"], r["idx"]): r for r in rows.collect()}
    assert len(got) == steps.filter("type = 'search'").count() > 20
    for style in H.ALL_STYLES:
        if tokens is None:
            want = H.with_history(steps, corpus).select("traj", "idx", H.render(style, F.lit(QUESTION)).alias("rendered"))
        else:
            want = H.rendered(steps, corpus, F.lit(QUESTION), style, tokens=tokens)
        assert {k: r[style] for k, r in got.items()} == {(r["traj"], r["idx"]): r["rendered"] for r in want.collect()}
