"""Fixed values of experiments: budgets, weights and caps."""

from __future__ import annotations

from dataclasses import dataclass

# What an agent is served, how training groups are made, how an index is stamped.
SERVING = {"k": 10, "snippet_words": 64, "calls": 50, "pool": 100}
TRAINING = {"group": 10, "passage_words": 512, "temperature": 0.02, "weight_diversity": 3.0, "weight_hard": 1.0, "weight_weak": 0.3, "most_diversity": 3, "most_hard": 3}
INDEXING = {"passage_max_len": 512, "pooling": "eos", "normalize": True}


@dataclass(frozen=True)
class Arm:
    """One way to ask: a retriever, the style of its queries, and how they are encoded."""

    name: str
    retriever: str
    style: str = "i7"
    max_length: int = 8192
    dedup: bool = True
    prefix: str | None = None


@dataclass(frozen=True)
class Benchmark:
    """A set of questions with its truths, its evidence if any, and its corpus."""

    name: str
    questions: str
    truths: str
    corpus: str
    qrels: str | None = None
    metric: str = "exact_match"


def command(arm: Arm, benchmark: Benchmark, runs: str) -> list[str]:
    """Arguments of a search run, for whatever starts it."""
    out = ["--questions", benchmark.questions, "--corpus", benchmark.corpus, "--retriever", arm.retriever, "--style", arm.style, "--max-length", str(arm.max_length), "--k", str(SERVING["k"]), "--runs", runs]
    return out + (["--dedup"] if arm.dedup else []) + (["--prefix", arm.prefix] if arm.prefix else [])
