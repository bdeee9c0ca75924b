import random

import pytest

from quern.operators import forest


def brute(rows):
    parent = {}
    for i, p in rows:
        if i is not None:
            parent[i] = p if parent.get(i) is None else parent[i] if p is None else min(p, parent[i])
    out = {}
    for i in parent:
        way = [i]
        while True:
            p = parent[way[-1]]
            if p is None or p not in parent:
                out[i] = (way[-1], len(way) - 1, way)
                break
            if p in way:
                out[i] = (min(way[way.index(p) :]), -1, [])
                break
            way.append(p)
    return out


def cases():
    rng = random.Random(3)
    rows = [(i, i + rng.randint(1, 9) if rng.random() < 0.8 else None) for i in range(400)]
    rows += [(1000 + i, 1000 + (i + 1) % 37) for i in range(37)] + [(1100 + i, 1000 + i % 5 if i < 9 else 1100 + i - 9) for i in range(60)]
    rows += [(2000, 2000), (2001, 99999), (2002, 2001), (None, 5), (None, None), (2003, None), (2003, 2000), (2003, 2001)]
    chain = list(range(3000, 3300))
    rng.shuffle(chain)
    rows += list(zip(chain, chain[1:]))
    rows += [(4000 + i, 3150) for i in range(200)] + [(2**62 + 1, 2**62 + 3), (2**62 + 3, -7)]
    return rows


@pytest.mark.parametrize("fragment_rows,quotient_rows", [(100_000, 100_000), (50, 10_000), (20, 60)])
def test_hierarchy_matches_walking(spark, fragment_rows, quotient_rows):
    rows = cases()
    df = spark.createDataFrame(rows, "id long, superseded_by long")
    got = forest.hierarchy(df, with_paths=True, fragment_rows=fragment_rows, quotient_rows=quotient_rows).collect()
    want = brute(rows)
    assert {r.id: (r.root, r.depth, r.path) for r in got} == want
    assert len(got) == len(want)


def test_circles_and_descendants(spark):
    rows = [(5, 6), (6, 7), (7, 5), (8, 5), (9, 9), (1, 2), (2, 3), (4, 2), (3, None)]
    df = spark.createDataFrame(rows, "id long, superseded_by long")
    got = {(r.root, r.length, tuple(r.members)) for r in forest.circles(df, fragment_rows=2, quotient_rows=3).collect()}
    assert got == {(5, 3, (5, 6, 7)), (9, 1, (9,))}
    below = {(r.ancestor, r.descendant, r.steps) for r in forest.descendants(forest.hierarchy(df, with_paths=True)).collect()}
    assert below == {(2, 1, 1), (3, 1, 2), (3, 2, 1), (2, 4, 1), (3, 4, 2)}


@pytest.mark.parametrize("fragment_rows,quotient_rows", [(100_000, 100_000), (20, 60)])
def test_ways_into_circles_are_followed(spark, fragment_rows, quotient_rows):
    rows = cases()
    parent = {i: p for i, p in rows if i is not None and i != 2003} | {2003: 2000}
    ways, below = {}, set()
    for i, (root, depth, _) in brute(rows).items():
        way = [i]
        while (p := parent[way[-1]]) in parent and p not in way:
            way.append(p)
        ways[i] = (root, depth, way[: way.index(root) + 1])
        below |= {(a, i, n) for n, a in enumerate(way) if n}
    found = forest.open_hierarchy(spark.createDataFrame(rows, "id long, superseded_by long"), fragment_rows=fragment_rows, quotient_rows=quotient_rows).cache()
    assert {r.id: (r.root, r.depth, r.path) for r in found.collect()} == ways
    got = forest.descendants(found).collect()
    assert {(r.ancestor, r.descendant, r.steps) for r in got} == below and len(got) == len(below)


def test_descendants_query_keeps_trees_on_circles(spark, tmp_path):
    from quern.plans import QUERIES

    rows = [(5, 6), (6, 5), (2, 6), (1, 2), (9, 9), (8, None), (7, 8)]
    spark.createDataFrame(rows, "id long, superseded_by long").write.parquet(f"{tmp_path}/memories.parquet")
    below = {tuple(r) for r in QUERIES["p1_descendants"](spark, str(tmp_path)).collect()}
    assert below == {(6, 5, 1), (5, 6, 1), (6, 2, 1), (5, 2, 2), (2, 1, 1), (6, 1, 2), (5, 1, 3), (8, 7, 1)}
    paths = {r.memory_id: r.path for r in QUERIES["p1_paths"](spark, str(tmp_path)).collect()}
    assert paths == {5: "5", 6: "6/5", 2: "2/6/5", 1: "1/2/6/5", 9: "9", 8: "8", 7: "7/8"}


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "id long, superseded_by long, root string, path string")
    assert forest.hierarchy(df).count() == 0
    assert forest.circles(df).count() == 0
    df = spark.createDataFrame([(1, 2, "x", "y"), (1, 2, "x", "y"), (2, None, None, None)], "id long, superseded_by long, root string, path string")
    assert sorted(map(tuple, forest.hierarchy(df).collect())) == [(1, 2, 2, 1), (2, None, 2, 0)]
