"""Models as functions with fixed questions: a protocol, a table-backed stand-in, an offline embedder."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RETRIES = 4
DIMENSION = 384


class Judge(Protocol):
    """Answers questions about texts: for each row the named probabilities, or None where the model refused."""

    questions: tuple[str, ...]

    def ask(self, states: list[str]) -> list[dict[str, float] | None]: ...


def question_set(text: Column) -> Column:
    """16 hex digits that name a set of questions by its canonical text."""
    return F.left(F.sha2(text, 256), F.lit(16))


def judged(rows: DataFrame, state: str, judge: Judge, keys: list[str]) -> DataFrame:
    """(keys, questions..., outcome): answers for each row, in Arrow batches; a failing call is tried RETRIES times, then an error row.

    A failure never fails the job: outcome is ok, refused or error, which the ledger and the sweep read.
    """
    columns = list(judge.questions)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for attempt in range(RETRIES):
                try:
                    answers, outcome = judge.ask(pdf[state].tolist()), "ok"
                    break
                except Exception:
                    answers, outcome = [None] * len(pdf), "error"
            out = pdf[keys].copy()
            for q in columns:
                out[q] = [None if a is None else float(a[q]) for a in answers]
            out["outcome"] = ["ok" if a is not None else "error" if outcome == "error" else "refused" for a in answers]
            yield out

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, state).mapInPandas(run, kinds + "".join(f", `{q}` double" for q in columns) + ", outcome string")


class TableJudge:
    """A stand-in that answers from a table of texts, else with fixed probabilities."""

    def __init__(self, answers: dict[str, dict[str, float]], default: dict[str, float]):
        self.answers, self.default, self.questions = answers, default, tuple(default)

    def ask(self, states: list[str]) -> list[dict[str, float] | None]:
        return [self.answers.get(s, self.default) for s in states]


def embed(texts: Column, dimension: int = DIMENSION) -> Column:
    """An offline embedding: hashed words and pairs of words with signs, of unit length; null for a blank text."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        import xxhash

        out = []
        for text in s:
            words = (text or "").lower().split()
            if not words:
                out.append(None)
                continue
            v = np.zeros(dimension, np.float32)
            for gram in [*words, *map(" ".join, zip(words, words[1:]))]:
                h = xxhash.xxh64_intdigest(gram)
                v[h % dimension] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n).tolist() if n else None)
        return pd.Series(out)

    return run(texts)


def padded_batches(lengths: list[int], budget: int) -> list[list[int]]:
    """Places of texts in batches, shortest first, whose padded size (longest times count) stays within the budget.

    A text over the budget is a batch of its own.
    """
    sizes = np.asarray(lengths, np.int64)
    order = np.argsort(sizes, kind="stable")
    cuts, start = [], 0
    while start < len(order):
        padded = sizes[order[start:]] * np.arange(1, len(order) - start + 1)
        start += max(1, int(np.searchsorted(padded, budget, "right")))
        cuts.append(start)
    return [part.tolist() for part in np.split(order, cuts[:-1]) if len(part)] if cuts else []
