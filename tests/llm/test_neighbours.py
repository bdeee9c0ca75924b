import numpy as np
import pytest

from quern.llm import neighbours

SCHEMA = "id long, embedding_model string, kind string, scope_key string, embedding array<float>, block string, cosine string"


def brute(rows, k=10, least=0.8):
    ok = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and r[4] and all(x is not None and np.isfinite(x) for x in r[4]) and any(r[4])]
    out = {}
    vec = {r[0]: np.asarray(r[4], np.float32).astype(float) for r in ok}
    for a in ok:
        near = []
        for b in ok:
            if a[0] != b[0] and a[1:3] == b[1:3] and len(a[4]) == len(b[4]) and (a[3] == b[3] or a[3] is None or b[3] is None):
                near.append((-round(vec[a[0]] @ vec[b[0]] / np.sqrt((vec[a[0]] @ vec[a[0]]) * (vec[b[0]] @ vec[b[0]])), 9), b[0]))
        for place, (c, j) in enumerate(sorted(near)[:k], 1):
            if -c >= least:
                out[a[0], j] = place
    return out


def rows(seed=1, n=500):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(60, 96))
    out = []
    for i in range(n):
        v = centres[rng.integers(60)] + rng.normal(size=96) * rng.choice([0.05, 0.4, 0.6])
        out.append((i, str(rng.integers(2)), "ab"[rng.integers(2)], [None, "x", "y"][rng.integers(3)], [float(np.float32(x)) for x in v * rng.uniform(0.5, 2)], "", ""))
    return out


@pytest.mark.parametrize("how", [{}, {"bucket_rows": 15, "group_pairs": 10}, {"depth": 2, "probes": 2}, {"depth": 2, "probes": 2, "bucket_rows": 15}])
def test_against_brute_force(spark, how):
    data = rows()
    one = data[7]
    # a third of all rows are copies of one vector, in several scopes
    data += [(1000 + i, one[1], one[2], [None, "x", "y"][i % 3], one[4], "", "") for i in range(250)]
    data += [(2000, "0", "a", None, [0.0] * 96, "", ""), (2001, "0", "a", None, None, "", ""), (2002, None, "a", None, one[4], "", ""), (2003, "0", None, "x", one[4], "", ""), (2004, "0", "a", "x", [float("nan")] * 96, "", ""), (2005, "0", "a", "x", [], "", ""), (2006, "0", "a", "x", one[4][:50], "", ""), (None, "0", "a", "x", one[4], "", "")]
    found = {(r.id, r.other): r.place for r in neighbours.similar(spark.createDataFrame(data, SCHEMA), **how).collect()}
    want = brute(data)
    assert not set(found) - set(want)
    assert len(found) >= 0.99 * len(want)


def with_copies():
    data = rows(n=300)
    one = data[7]
    data += [(1000 + i, one[1], one[2], [None, "x", "y"][i % 3], one[4], "", "") for i in range(60)]
    return data + [(2000, "0", "a", None, [0.0] * 96, "", ""), (2001, "0", "a", None, None, "", ""), (2002, "0", "a", "x", one[4][:50], "", ""), (2003, None, "a", None, one[4], "", "")]


@pytest.mark.parametrize("tile", [neighbours.TILE, 40])
def test_nearest_is_the_whole_top_ten(spark, tile):
    data = with_copies()
    found = {(r.id, r.other): r.place for r in neighbours.nearest(spark.createDataFrame(data, SCHEMA), tile=tile).collect()}
    assert found == brute(data, least=-2)


def test_similar_query_has_no_least_cosine(spark, tmp_path):
    from quern.llm.queries import QUERIES

    data = with_copies()
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/memories.parquet")
    found = QUERIES["p4_similar"](spark, str(tmp_path)).collect()
    assert {(r.memory_id, r.other_id): r.place for r in found} == brute(data, least=-2)
    assert min(r.cosine for r in found) < 0.8


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(4)
    data = []
    for i in range(400):
        a = rng.normal(size=384)
        a /= np.linalg.norm(a)
        b = rng.normal(size=384)
        b -= (a @ b) * a
        b = 0.801 * a + np.sqrt(1 - 0.801**2) * b / np.linalg.norm(b)
        data += [(2 * i, "m", "k", None, a.tolist(), "", ""), (2 * i + 1, "m", "k", "x", b.tolist(), "", "")]
    found = neighbours.close_pairs(neighbours.similar(spark.createDataFrame(data, SCHEMA))).collect()
    assert len({(r.memory_id_a, r.memory_id_b) for r in found} & {(2 * i, 2 * i + 1) for i in range(400)}) >= 396


@pytest.mark.parametrize("least", [0.5, 0.8])
@pytest.mark.parametrize("how", [{}, {"depth": 2, "probes": 2}])
def test_recall_of_pairs_of_just_the_least_cosine(least, how):
    """At any least cosine the tables that are made and the bits that may differ keep nearly all pairs of it."""
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(2, 3000, 384))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= np.einsum("ij,ij->i", a, b)[:, None] * a
    b = least * a + np.sqrt(1 - least**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    probes, depth = how.get("probes", neighbours.PROBES), how.get("depth", 1)
    both = np.concatenate([a, b]).astype(np.float32)
    turns = neighbours.rotations(both, neighbours.SEED)
    words = neighbours.signs(turns).copy().view(np.uint64)
    apart = np.bitwise_count(words[:3000] ^ words[3000:]).sum(axis=1)
    met, x, at = np.zeros(3000, bool), next(turns), 0
    for _ in range(neighbours.tables_for(least, probes, depth)):
        meets = np.ones(3000, bool)
        for _ in range(depth):
            if at + neighbours.AXES > x.shape[1]:
                x, at = next(turns), 0
            axes = neighbours.nearest_axes(x[:, at : at + neighbours.AXES], probes)
            meets &= (axes[:3000, :, None] == axes[3000:, None, :]).any((1, 2))
            at += neighbours.AXES
        met |= meets
    assert (met & (apart <= neighbours.bits_apart(least))).mean() > 0.99


def test_exact_by_name_and_no_hashing_below(spark):
    data = spark.createDataFrame(with_copies(), SCHEMA)
    found = {(r.id, r.other): r.place for r in neighbours.similar(data, exact=True, least=0.0).collect()}
    assert found == brute(with_copies(), least=0.0)
    with pytest.raises(ValueError):
        neighbours.similar(data, least=0.3)


def test_empty(spark):
    assert neighbours.similar(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hadamard_keeps_length():
    x = np.random.default_rng(0).normal(size=(5, 64)).astype(np.float32)
    assert np.allclose(np.linalg.norm(neighbours.hadamard(x), axis=1), np.linalg.norm(x, axis=1), atol=1e-4)
    assert np.allclose(neighbours.hadamard(neighbours.hadamard(x)), x, atol=1e-4)
