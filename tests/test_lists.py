"""Opening lists and standing statements of many prompts: whole results, at a cost that is linear in prompts."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from quern.operators import newest, recall

NOW = datetime(2024, 6, 1, tzinfo=timezone.utc)
MEMORY = "id long, kind string, scope_key string, created_at timestamp, said_at timestamp, superseded_by long, superseded_at timestamp, ended_at timestamp, until_moment timestamp, actionable double"
SCOPES = [None, "", "a", "a/b", "a/b/c", "a//b", "a/", "ab", "a/b_c", "\x00", "z"]
KINDS = ["semantic", "praise", "odd", None]


def statements(spark, n, scopes=SCOPES, instants=50):
    """Statements with repeated ids, without ids, of equal worth and instant, retired, and never said."""
    at = lambda i: None if i % 19 == 0 else NOW - timedelta(minutes=i * 37 % instants)
    rows = [(None if i % 97 == 0 else i // 2 if i % 10 == 1 else i, KINDS[i * 7 % 4], scopes[i * 5 % len(scopes)], NOW - timedelta(minutes=i % 13), at(i), 1 if i % 11 == 0 else None, None, None, NOW - timedelta(days=1) if i % 23 == 0 else None, None) for i in range(1, n + 1)]
    return rows, spark.createDataFrame(rows, MEMORY).repartition(3)


def reaches(ask, scope):
    return ask is not None and scope is not None and (ask == scope or ask.startswith(scope + "/"))


def most_rows(df):
    """The most rows that any step of the executed plan of df gave out."""
    df.collect()
    found, open_ = 0, [df._jdf.queryExecution().executedPlan()]
    while open_:
        node = open_.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            open_.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            open_.append(node.plan())
        kept = node.metrics().get("numOutputRows")
        found = max(found, kept.get().value() if kept.isDefined() else 0)
        open_ += [node.children().apply(i) for i in range(node.children().size())]
    return found


@pytest.mark.parametrize("with_seen", [False, True])
def test_opening_lists_are_those_of_all_pairs(spark, with_seen):
    rows, df = statements(spark, 400)
    asks = [(i // 2 if i % 9 == 1 else i, s, [m for m in range(1, 401) if (m * 31 + i) % 3] if i % 4 else None) for i, s in enumerate([*SCOPES, "a/b/c/d", "a/x", "q"] * 3)]
    prompts = spark.createDataFrame(asks, "prompt_id long, ask string, seen array<long>")
    worth = recall.memory.worth(F.col("kind"), F.col("said_at"), F.col("created_at"), F.lit(NOW))
    worth = {(r.kind, r.said, r.created): r.worth for r in df.select("kind", F.unix_seconds("said_at").alias("said"), F.unix_seconds("created_at").alias("created"), worth.alias("worth")).collect()}
    of = {}
    for p, ask, seen in asks:
        for i, kind, scope, created, said, gone, _, _, until, _ in rows:
            if reaches(ask, scope) and not gone and not until and not (with_seen and i in (seen or [])):
                of.setdefault(p, []).append((-worth[kind, said and said.timestamp(), created.timestamp()], -created.timestamp(), 1e9 if i is None else i))
    want = sorted((p, n, None if m == 1e9 else m, round(-w, 9)) for p, found in of.items() for n, (w, _, m) in enumerate(sorted(found)[:7], 1))
    got = recall.opening(prompts if with_seen else prompts.drop("seen"), df, F.lit(NOW), 7).collect()
    assert sorted((r.prompt_id, r.place, r.memory_id, round(r.rank, 9)) for r in got) == want


def test_opening_meets_no_pairs_of_a_crowded_scope(spark):
    _, df = statements(spark, 1000, ["a"])
    asks = df.select(F.col("id").alias("prompt_id"), F.lit("a/b").alias("ask")).distinct().cache()
    found = recall.opening(asks, df, F.lit(NOW), 10)
    assert most_rows(found) <= 10 * asks.count() == found.count()


@pytest.mark.parametrize("rows,at_once,instants", [(10_000, 2_000_000, 50), (15, 40, 50), (15, 1, 2), (15, 40, 1)])
def test_standing_statements_are_those_of_all_pairs(spark, monkeypatch, rows, at_once, instants):
    monkeypatch.setattr(newest, "ROWS", rows)  # many slices, and instants that fill several
    monkeypatch.setattr(newest, "AT_ONCE", at_once)
    held, df = statements(spark, 300, instants=instants)
    kinds = [["semantic"], ["odd", "praise", None, "odd"], [None], None, [], ["semantic", "praise", "odd", "other"]]
    asked = [(i // 2 if i % 9 == 1 else i, s, kinds[i % 6], None if i % 17 == 5 else NOW - timedelta(minutes=i * 7 % instants, seconds=i % 2 * 30 - 1)) for i, s in enumerate([*SCOPES, "a/b/c/d", "a/x", "q"] * 6)]
    of = {}
    for p, ask, fired, at in asked:
        for i, kind, scope, _, said, gone, *_ in held:
            if at and said and said < at and not gone and kind in [k for k in fired or [] if k] and (scope is None or reaches(ask, scope)):
                of.setdefault(p, []).append((said, -1 if i is None else i))
    want = sorted((p, n, None if m == -1 else m) for p, found in of.items() for n, (_, m) in enumerate(sorted(found, reverse=True)[:5], 1))
    messages = spark.createDataFrame(asked, "prompt_id long, ask string, kinds array<string>, said_at timestamp")
    got = recall.standing(messages, df, 5).collect()
    assert sorted((r.prompt_id, r.number, r.memory_id) for r in got) == [(p, n, m) for p, n, m in want]
    assert recall.standing(messages.limit(0), df, 5).count() == recall.standing(messages, df.limit(0), 5).count() == 0


def test_standing_meets_no_pairs_of_a_crowded_scope(spark):
    df = spark.range(1, 1001).select("id", F.lit("semantic").alias("kind"), F.lit("a").alias("scope_key"), F.timestamp_seconds("id").alias("said_at"), F.lit(None).cast("long").alias("superseded_by"), F.lit(None).cast("timestamp").alias("ended_at"))
    asked = df.select(F.col("id").alias("prompt_id"), F.lit("a/b").alias("ask"), F.array("kind").alias("kinds"), "said_at").cache()
    found = recall.standing(asked, df, 5)
    assert most_rows(found) <= 5 * 1000
    assert {(r.prompt_id, r.memory_id, r.number) for r in found.collect()} == {(p, p - n, n) for p in range(1, 1001) for n in range(1, 6) if p > n}
