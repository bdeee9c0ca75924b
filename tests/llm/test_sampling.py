import random
from collections import Counter

from quern.llm import sampling

PAIRS = "pair_id long, session_id string, entry_id string, memory_id long, form string, kind string, scope_key string, block string"
TARGETS = "form string, kind string, scoped int, share_permille int, minimum int"


def test_usable_rows(spark):
    rows = [
        (3, "s", "e", 1, "Match ", " Semantic", "x", ""),
        (2, "s", "e", 1, "\topening", "semantic", " 　", ""),
        (1, "s", "e", 1, None, "semantic", "x", ""),
        (4, None, "e", None, "match", "semantic", None, ""),
        (5, None, "e", None, "match", "semantic", None, ""),
        (6, "s", None, 1, "match", "semantic", None, ""),
    ]
    got = sampling.usable_pairs(spark.createDataFrame(rows, PAIRS)).collect()
    assert sorted(map(tuple, got)) == [(2, "opening", "semantic", 0), (4, "match", "semantic", 0)]


def test_allocation_and_draw(spark):
    rng = random.Random(2)
    have = {("match", "a", 0): 5, ("match", "a", 1): 400, ("match", "b", 0): 60, ("match", "b", 1): 0, ("opening", "a", 0): 535}
    rows, n = [], 0
    for (f, k, s), m in have.items():
        for _ in range(m):
            n += 1
            rows.append((n, str(rng.random()), "e", n, f, k, "x" if s else None, ""))
    pairs = spark.createDataFrame(rows, PAIRS)
    targets = spark.createDataFrame([("match", "a", 0, 100, 0), ("match", "a", 1, 300, 0), ("match", "b", 0, 200, 40), ("match", "b", 1, 100, 7), ("opening", "a", 0, 200, 0), ("opening", "z", 1, 100, 3)], TARGETS)
    plan = sampling.allocation(sampling.strata(pairs), targets)
    got = {(r.form, r.kind, r.scoped): r for r in plan.collect()}
    assert {k: (r.quota, r.available, r.own) for k, r in got.items()} == {("match", "a", 0): (20, 5, 5), ("match", "a", 1): (60, 400, 60), ("match", "b", 0): (40, 60, 40), ("match", "b", 1): (20, 0, 0), ("opening", "a", 0): (40, 535, 40), ("opening", "z", 1): (20, 0, 0)}
    assert got["match", "a", 1].from_siblings == 15 and got["match", "b", 0].from_siblings == 20
    assert sum(r.take for r in got.values()) == sum(r.quota for r in got.values())
    assert got["opening", "a", 0].take == 60
    for blocks in (1, 7, 4096):
        drawn = sampling.draw(pairs, plan, seed=3, blocks=blocks).collect()
        assert Counter((r.form, r.kind, r.scoped) for r in drawn) == {k: r.take for k, r in got.items() if r.take}
        assert len({r.pair_id for r in drawn}) == len(drawn)


def test_targets_that_cannot_be_met_and_empty(spark):
    pairs = spark.createDataFrame([(1, "s", "e", 1, "match", "a", None, "")], PAIRS)
    targets = spark.createDataFrame([("match", "a", 0, 1000, 5), ("match", "a", 1, 0, 0), (None, "a", 1, None, None)], TARGETS)
    got = {(r.form, r.scoped): (r.quota, r.available, r.take) for r in sampling.allocation(sampling.strata(pairs), targets).collect()}
    assert got == {("match", 0): (5, 1, 1), ("match", 1): (0, 0, 0), (None, 1): (0, 0, 0)}
    plan = sampling.allocation(sampling.strata(pairs.limit(0)), targets)
    assert sampling.draw(pairs.limit(0), plan).count() == 0
