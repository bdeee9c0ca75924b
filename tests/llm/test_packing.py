import random

import numpy as np

from quern.llm import packing, tokens

SCHEMA = "doc_id long, text string, container string, curve string"


def test_hilbert_neighbours_are_adjacent():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    key = packing.hilbert(cells, 3)
    assert sorted(key) == list(range(512))
    along = cells[np.argsort(key)]
    assert (np.abs(np.diff(along, axis=0)).sum(1) == 1).all()


def test_pack_splits_only_what_must_be():
    rng = random.Random(1)
    sizes = [rng.choice([0, 1, 5, 50, 99, 100, 101, 250]) for _ in range(3000)]
    out = packing.pack(sizes, 100)
    filled = {}
    for size, pieces in zip(sizes, out):
        assert sum(t for _, t in pieces) == size
        assert (len(pieces) == 1) == (0 < size <= 100)
        for where, t in pieces:
            filled[where] = filled.get(where, 0) + t
    assert max(filled.values()) <= 100
    assert sum(filled.values()) / (100 * len(filled)) > 0.97


def test_rows(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "日本", "x1", "\n"]
    data = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 40, 300, 900]))), "", "") for i in range(300)]
    data += [(1000, None, "", ""), (1001, "", "", ""), (1002, "word " * 9000, "", ""), (5, data[5][1], "", ""), (None, "x", "", "")]
    df = spark.createDataFrame(data, SCHEMA)
    pieces = packing.packed(df, capacity=512, range_rows=100).collect()
    sizes = tokens.sizes(df).collect()
    total = sum(r.tokens for r in sizes)
    assert sum(p.tokens for p in pieces) == total
    by = {}
    for p in pieces:
        by.setdefault(p.container, []).append(p)
    assert {p.doc_id for p in by.pop(None)} == {1000, 1001}
    for inside in by.values():
        at = 0
        for p in sorted(inside, key=lambda p: p.at):
            assert p.at == at
            at += p.tokens
        assert at <= 512
    assert total / (512 * len(by)) > 0.95
    split = {p.doc_id for p in pieces if p.piece > 0}
    assert split == {r.doc_id for r in sizes if r.tokens > 512}
    assert packing.packed(df.limit(0)).count() == 0
