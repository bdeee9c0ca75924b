import random
from datetime import datetime, timedelta, timezone

import pytest

from quern.llm import conversations as C

SCHEMA = "id long, session_id string, entry_id string, received_at timestamp, occurred_at timestamp, actor string, actor_depth int, kind string, body string, role string, turn string"
T0 = datetime(2024, 5, 1, tzinfo=timezone.utc)


def brute(rows):
    first = {}
    for r in sorted(rows, key=lambda r: (r[3] is None, r[3] or T0, r[0])):
        if r[1] is not None:
            first.setdefault((r[1], r[2]) if r[2] is not None else ("row", r[0]), r)
    out = {}
    for s in {r[1] for r in rows if r[1] is not None}:
        said = [r for r in first.values() if r[1] == s and r[7] in C.MESSAGE_KINDS and r[6] in (0, None) and r[8] is not None and r[8].strip()]
        if any(r[5] not in C.ROLES or r[4] is None for r in said):
            out[s] = (1, len(said))
            continue
        said.sort(key=lambda r: (r[4], r[0]))
        talk = [C.ROLES[r[5]] for r in said if r[5] != "system"]
        bad = 2 if "user" not in talk else 3 if "assistant" not in talk else 4 if talk[0] != "user" else 5 if any(a == "user" and b != "assistant" for a, b in zip(talk, [*talk[1:], None])) else 0
        out[s] = (bad, len(said))
    return out


def made():
    rng = random.Random(8)
    rows, n = [], 0
    for s in range(120):
        at, turns = rng.randint(0, 200_000), rng.randint(1, 12) if s else 400
        for t in range(turns):
            for actor, kind in (("human", "prompt"), ("agent", "response")):
                if s and rng.random() < 0.06:
                    continue
                n += 1
                at += rng.choice([0, 5, 60, 4000])
                odd = s and rng.random() < 0.02
                row = [n, f"s{s}", None if rng.random() < 0.1 else f"e{n}", T0 + timedelta(seconds=at + rng.choice([1, 1, 90000])), T0 + timedelta(seconds=at), actor, rng.choice([0, None]), kind, "hello", "x", "y"]
                if odd:
                    row[rng.choice([4, 5, 8])] = None
                rows.append(tuple(row))
                if rng.random() < 0.1:
                    again = [*row]
                    again[0], again[3], again[8] = n + 100_000, row[3] + timedelta(seconds=rng.choice([-30, 300_000])), "again"
                    rows.append(tuple(again))
                if rng.random() < 0.2:
                    rows.append((n + 200_000, f"s{s}", f"x{n}", row[3], row[4], "system", 0, rng.choice(["system", "usage"]), rng.choice(["note", " \n\t", "\xa0", ""]), "x", "y"))
    rows += [(900_001, "empty", None, T0, T0, None, None, None, None, "x", "y"), (900_002, None, "e", T0, T0, "human", 0, "prompt", "lost", "x", "y"), (900_003, "noarrival", "e", None, T0, "human", 0, "prompt", "q", "x", "y"), (900_004, "noarrival", "f", None, T0, "agent", 0, "response", "a", "x", "y"), (900_005, "noarrival", "f", T0, T0 + timedelta(1), "agent", 1, "response", "a", "x", "y")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("idle,delay,triggers,files", [(C.IDLE, C.DELAY, 4, 5), (3600, 60, 5, 5), (10, 0, 20, 9), (30 * 86400, 600, 1, 3)])
def test_against_brute_force(spark, tmp_path, idle, delay, triggers, files):
    """Rows in files of any order: with a short idle time most sessions are emitted before some of their rows come."""
    rows = made()
    path = f"file://{tmp_path}/logs.parquet"
    spark.createDataFrame(rows, SCHEMA).repartition(files).write.parquet(path)
    found = C.emitted(spark, path, idle=idle, delay=delay, triggers=triggers)
    want = brute(rows)
    assert {r.session_id: (C.REASONS.index(r.reason), r.messages) for r in C.sessions(found).collect()} == want
    got = {}
    for r in C.conversations(found, spark.createDataFrame(rows, SCHEMA)).orderBy("session_id", "turn").collect():
        got.setdefault(r.session_id, []).append(r)
    assert set(got) == {s for s, (bad, _) in want.items() if not bad}
    for s, said in got.items():
        assert [r.turn for r in said] == list(range(1, want[s][1] + 1))


def test_closing_by_timeout_before_the_end(spark, tmp_path):
    """A session idle for longer than the timeout is emitted while later ones still come in."""
    first = [(1, "old", "a", T0, T0, "human", 0, "prompt", "q", "", ""), (2, "old", "b", T0, T0 + timedelta(seconds=1), "agent", 0, "response", "a", "", "")]
    later = [(3, "new", "a", T0 + timedelta(days=3), T0 + timedelta(days=3), "human", 0, "prompt", "q", "", "")]
    path = f"file://{tmp_path}/logs.parquet"
    for part in (first, later):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    found = C.sessions(C.emitted(spark, path, idle=3600, triggers=2))
    assert {(r.session_id, r.reason) for r in found.collect()} == {("old", ""), ("new", "no assistant")}


def test_empty(spark, tmp_path):
    path = f"file://{tmp_path}/logs.parquet"
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    assert C.sessions(C.emitted(spark, path)).count() == 0
