import math
import random

import pytest

from quern.llm import cutoffs

SCHEMA = "id long, kind string, score float, cutoff string"


def brute(rows, targets):
    out = {}
    for kind, keep in targets.items():
        ok = sorted((s for _, k, s in rows if k == kind and s is not None and not math.isnan(s) and 0 <= s <= 1), reverse=True)
        fit = [c for c in set(ok) if 1000 * sum(s >= c for s in ok) >= keep * len(ok)]
        out[kind] = (len(ok), max(fit) if fit else None, sum(s >= max(fit) for s in ok) if fit else 0)
    return out


@pytest.mark.parametrize("bracket_rows,sketch_k", [(2_000_000, 2048), (20, 8)])
def test_exact_against_brute_force(spark, bracket_rows, sketch_k):
    rng = random.Random(5)
    draw = {"flat": lambda: rng.random(), "tied": lambda: rng.choice([0.25, 0.5, 0.75]), "one": lambda: 0.5, "odd": lambda: rng.choice([None, math.nan, -0.5, 1.5, 0.0, 1.0, rng.random()])}
    rows = [(i, k, draw[k]()) for i, k in enumerate(rng.choice(list(draw)) for _ in range(4000))] + [(9001, "bad", None), (9002, None, 0.5), (9003, "few", 0.5)]
    targets = {"flat": 333, "tied": 250, "one": 10, "odd": 0, "bad": 500, "none": 100, "few": 1000}
    df = spark.createDataFrame([(i, k, s, "x") for i, k, s in rows], SCHEMA)
    goals = spark.createDataFrame([*targets.items(), (None, 3), ("untold", None), ("flat", 5)], "kind string, keep_permille int")
    rows = [tuple(r)[:3] for r in df.collect()]
    found = cutoffs.cutoffs(df, goals, bracket_rows=bracket_rows, sketch_k=sketch_k).collect()
    assert {r.kind: (r.n, r.cutoff, r.kept) for r in found} == brute(rows, targets)
    kept = cutoffs.kept(df, cutoffs.cutoffs(df, goals))
    assert kept.columns == df.columns
    want = brute(rows, targets)
    assert sorted(r.id for r in kept.collect()) == sorted(i for i, k, s in rows if want.get(k, (0, None))[1] is not None and s is not None and want[k][1] <= s <= 1)


def test_two_tied_scores_at_the_border_end(spark, monkeypatch):
    cut, tables = cutoffs.cut, []

    def counted(df, name):
        tables.append(name)
        assert len(tables) < 15, "it goes on without end"
        return cut(df, name)

    monkeypatch.setattr(cutoffs, "cut", counted)
    rows = [(i, "tied", 0.5 if i % 2 else 0.75) for i in range(400)] + [(1000 + i, "near", 0.5 if i % 2 else 0.75) for i in range(399)] + [(2000 + i, "flat", i / 400) for i in range(400)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    targets = {"tied": 500, "near": 502, "flat": 500}
    found = cutoffs.cutoffs(df, spark.createDataFrame([*targets.items()], "kind string, keep_permille int"), bracket_rows=20).collect()
    assert {r.kind: (r.n, r.cutoff, r.kept) for r in found} == brute([tuple(r)[:3] for r in df.collect()], targets)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    goals = spark.createDataFrame([("a", 5)], "kind string, keep_permille int")
    assert [tuple(r) for r in cutoffs.cutoffs(df, goals).collect()] == [("a", 5, 0, None, 0, 0)]
    assert cutoffs.cutoffs(df, goals.limit(0)).count() == 0
