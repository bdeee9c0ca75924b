import random

import numpy as np
import pytest

from quern.llm import spans

SCHEMA = "doc_id long, text string, anchors string, at int"


def brute(rows, length):
    where = {}
    for doc, text in rows:
        if doc is not None and text is not None:
            for i in range(len(text) - length + 1):
                where.setdefault(text[i : i + length], set()).add(doc)
    out = {}
    for doc, text in rows:
        if doc is None or text is None:
            continue
        mark = np.zeros(len(text), bool)
        for i in range(len(text) - length + 1):
            if len(where[text[i : i + length]]) > 1:
                mark[i : i + length] = True
        if mark.any():
            out[doc] = max(out.get(doc, 0), int(mark.sum()))
    return out


def made(seed=3, n=120):
    rng = random.Random(seed)
    letters = "abcdefgh é日🙂\n"
    noise = lambda k: "".join(rng.choice(letters) for _ in range(k))
    passages = [noise(rng.randint(15, 90)) for _ in range(12)]
    rows = []
    for i in range(n):
        text = noise(rng.randint(0, 150))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 3)
            text += p[a : len(p) - rng.randint(0, len(p) // 3)] + noise(rng.randint(0, 40))
        rows.append((i, text))
    rows += [(1000, "ab" * 100), (1001, "ab" * 60), (1002, "a" * 300), (1003, "a" * 29), (1004, "a" * 30), (1005, None), (1006, ""), (1007, rows[5][1]), (1008, rows[5][1]), (None, rows[6][1]), (7, rows[7][1]), (1009, noise(40) * 5), (8, rows[9][1] + "tail"), (8, "x" + rows[10][1])]
    return rows


@pytest.mark.parametrize("how,gram", [({}, 12), ({"slice_anchors": 100}, 20), ({"slice_anchors": 40, "cells_per_anchor": 0, "group_rows": 1, "hot_rows": 20}, 12), ({"group_rows": 3, "most_bits": 1 << 12}, 6)])
def test_against_brute_force(spark, how, gram):
    rows = made()
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).repartition(5)
    got = {r.doc_id: r.shared_chars for r in spans.shared(df, length=30, gram=gram, **how).collect()}
    assert got == brute(rows, 30)


def test_empty(spark):
    assert spans.shared(spark.createDataFrame([], SCHEMA)).count() == 0


def test_anchors_are_those_of_equal_windows():
    rng = random.Random(4)
    span = "".join(rng.choice("abcd ") for _ in range(200))
    a, b = "x" * 500 + span + "y" * 90, "q" + span + "r" * 7
    assert set(spans.anchors(a, 200, 80)) & set(spans.anchors(b, 200, 80))
