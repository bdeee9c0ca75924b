from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from quern.operators import ledger, record
from quern.operators.sorting import placed

T0 = datetime(2024, 5, 6, 10, tzinfo=timezone.utc)
LOG = "id long, session_id string, entry_id string, occurred_at timestamp, kind string, actor string, body string, tool_name string, error_type string, attributes map<string,string>"


def at(m, s=0):
    return T0 + timedelta(minutes=m, seconds=s)


def log(i, m, kind="prompt", body="x", actor="human", session="s", entry=None, **more):
    return (i, session, entry or f"e{i}", None if m is None else at(m), kind, actor, body, more.get("tool"), more.get("error"), more.get("attributes", {}))


def logs(spark, rows):
    return spark.createDataFrame(rows, LOG)


CALL = "id long, called_at timestamp, session_id string, entry_id string, task string, outcome string, run string, model string, input_tokens long, output_tokens long"


def test_usage_counts_sums_and_unknown_groups(spark):
    calls = spark.createDataFrame([(1, at(0), "s", "e", "a", "ok", "r", "m", 5, None), (2, at(1), "s", "e", "a", "error", None, None, None, None), (3, at(2000), "s", "e", "b", "ok", "r", "m", 8, 2)], CALL)
    assert [(r["group"], r.calls, r.input_tokens, r.output_tokens) for r in ledger.usage(calls, "task").collect()] == [("a", 2, 5, 0), ("b", 1, 8, 2)]
    assert [r["group"] for r in ledger.usage(calls, "run").collect()] == ["r", None]
    assert ledger.usage(calls, "day", F.lit(at(0)), F.lit(at(1))).first().calls == 1
    assert ledger.usage_all(calls).where("by = 'model'").count() == 2
    with pytest.raises(ValueError):
        ledger.usage(calls, "colour")
    assert ledger.usage(calls.limit(0), "task").count() == 0


def test_trap_t26_estimates_round_half_to_even(spark):
    calls = spark.createDataFrame([(1, at(0), "s", "e", "a", "ok", "r", "m", 5, 0), (2, at(0), "s", "e", "a", "error", "r", "m", 99, 0), (3, at(0), "s", "e", "b", "ok", "q", "m", 7, 0)], CALL)
    planned = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 1.0)], "task string, planned double")
    assert {r.task: r.estimate for r in ledger.mean_tokens(calls, planned).collect()} == {"a": 2, "b": 4, "c": None}
    assert {r.task: r.estimate for r in ledger.mean_tokens(calls, planned, run="q").collect()} == {"a": None, "b": 4, "c": None}


def test_pages_follow_a_cursor_through_ties(spark):
    calls = spark.createDataFrame([(i, at(i // 3), "s", "e", "a", "ok", "r", "m", 1, 1) for i in range(10)], CALL)
    seen, cursor = [], None
    while True:
        page = ledger.calls_page(calls, 4, cursor)
        rows = page.collect()
        seen += [r.id for r in rows]
        last = ledger.next_cursor(page, 4).collect()
        if not last:
            break
        cursor = (last[0].called_at, last[0].id)
    assert seen == list(range(9, -1, -1))
    with pytest.raises(ValueError):
        ledger.calls_page(calls, 4, "nonsense")


def test_sweep_latest_error_lookback_and_cap(spark):
    rows = [(1, at(0), "s", "a", "t", "error"), (2, at(1), "s", "a", "t", "ok"), (3, at(0), "s", "b", "t", "error"), (4, at(-999), "s", "c", "t", "error"), (5, at(0), None, "d", "t", "error"), (6, at(1), "s", "f", "t", "ok"), (7, at(1), "s", "f", "t", "error")]
    rows += [(100 + i, at(i), "s", "many", "t", "error") for i in range(12)] + [(200 + i, at(i), "s", "few", "t", "error") for i in range(11)]
    calls = spark.createDataFrame([(*r, "r", "m", 1, 1) for r in rows], CALL)
    got = {r.entry_id: (r.attempts, r.ready) for r in ledger.attempts(calls, ["session_id", "entry_id"], F.lit(at(-10)), 12).collect()}
    assert got == {"b": (1, True), "f": (1, True), "many": (12, False), "few": (11, True)}


def test_exposition_escapes(spark):
    df = spark.createDataFrame([('a"b\\c', 3), (None, 1)], "task string, value long")
    assert {r.line for r in ledger.exposition(df, "n", "task").collect()} == {'n{task="a\\"b\\\\c"} 3', 'n{task=""} 1'}


def test_trap_t24_form_is_inferred_over_all_rows(spark):
    inj = spark.createDataFrame([(1, "s", at(0), None), (2, "s", at(0), None), (3, "s", at(5), "opening"), (4, "t", at(1), "match")], "id long, session_id string, injected_at timestamp, form string")
    assert {r.id: r.form for r in record.ranked_injections(inj).collect()} == {1: "opening", 2: "match", 3: "opening", 4: "match"}


def test_trap_t23_as_of_with_slack(spark):
    prompts = [log(1, 0), log(2, 10), log(3, 20, body="<noise>"), log(4, 20, actor="agent"), log(5, None)]
    inj = spark.createDataFrame([(1, "s", at(10, -5), [7], None, None), (2, "s", at(10, -6), [7, 8, 999], None, "x/y"), (3, "s", at(30), [8], "match", None), (4, "s", at(-30), [8], None, None), (5, "s", at(31), [], "match", None), (6, "s", at(31), [7], "match", "bad/z")], "id long, session_id string, injected_at timestamp, memory_ids array<long>, form string, scope_key string")
    statements = spark.createDataFrame([(7, "semantic"), (8, "praise")], "id long, kind string")
    got = {(r.entry_id, r.memory_id, r.form, r.kind, r.scope_key) for r in record.candidate_pairs(inj, logs(spark, prompts), statements, F.lit(at(-60)), F.lit(at(60)), spark.createDataFrame([("bad",)], "scope string")).collect()}
    assert got == {("e2", 7, "match", "semantic", None), ("e1", 7, "match", "semantic", "x/y"), ("e1", 8, "match", "praise", "x/y"), ("e2", 8, "match", "praise", None)}


def test_as_of_ties_empty_and_same_names(spark):
    left = spark.createDataFrame([(1, "k", at(5)), (2, "k", at(0)), (3, None, at(9))], "id long, key string, t timestamp")
    right = spark.createDataFrame([(1, "k", at(5), "a"), (2, "k", at(5), "b"), (3, "k", None, "c")], "rid long, key string, u timestamp, v string")
    got = {r.id: r.v for r in record.as_of(left, right, "key", "t", "u", "rid", carried=["v"]).collect()}
    assert got == {1: "b", 2: None, 3: None}
    assert record.as_of(left, right.limit(0), "key", "t", "u", "rid", carried=["v"]).where("v is null").count() == 3


def test_round_robin_over_strata(spark):
    rows = [(i, "a") for i in range(10)] + [(100 + i, "b") for i in range(2)] + [(200, None)]
    df = spark.createDataFrame(rows, "id long, kind string")
    got = [r.id for r in ledger.ordered_sample(df, ["kind"], 7, F.col("id")).collect()]
    assert got == [200, 0, 100, 1, 101, 2, 3]


def test_context_window(spark):
    rows = [log(1, 0, body="one"), log(2, 1, "response", " first \n", "agent"), log(3, 2, body="two"), log(4, 3, "response", " ", "agent"), log(5, 3, body="<noise>"), log(6, 4, body="three"), log(7, 200, body="four"), log(8, 5, "tool_call", "no", "agent")]
    got = {r.entry_id: (r.before, r.message) for r in record.context_windows(logs(spark, rows), rounds=2).collect()}
    assert got == {"e1": ("", "one"), "e3": ("[person] one\n\n[agent] first", "two"), "e6": ("[person] two", "three"), "e7": ("[person] three", "four")}


def test_context_window_fits_its_budget(spark):
    rows = [log(1, 0, body="a" * 30), log(2, 1, "response", "b" * 30, "agent"), log(3, 2, body="c" * 20), log(4, 3, body="d" * 100)]
    got = {r.entry_id: (r.before, r.message) for r in record.context_windows(logs(spark, rows), rounds=5, budget=70).collect()}
    assert got["e3"] == ("[agent] " + "b" * 30, "c" * 20)
    assert got["e4"] == ("", "d" * 35 + "\n\n[... 30 characters left out ...]\n\n" + "d" * 35)


def test_exchange_pages(spark):
    rows = [log(i, i) for i in range(3)] + [log(9, 5, body="/compact")]
    got = sorted((r.page, r.id, r.until_at) for r in record.exchanges(logs(spark, rows)).collect())
    assert [(p, i) for p, i, _ in got] == [(0, 2), (1, 1), (2, 0)] and got[0][2] is None and got[1][2] is not None


def test_tool_results_join_on_the_call(spark):
    key = {"gen_ai.tool.call.id": "c"}
    rows = [log(1, 0, "tool_call", attributes=key, tool="ls"), log(2, 1, "tool_result", attributes=key, error="tool_error"), log(3, 1, "tool_result", attributes=key, session="other"), log(4, 2, "tool_call")]
    assert [tuple(r) for r in record.tool_results(logs(spark, rows)).collect()] == [("s", 1, 2, "ls", True)]


def test_labels(spark):
    events = spark.createDataFrame([("s", "e", 1, "good", at(0), 1), ("s", "e", 1, "wrong", at(1), 2), ("s", "e", 2, "noise", at(0), 3)], "session_id string, entry_id string, memory_id long, label string, labelled_at timestamp, id long")
    latest = record.latest_labels(events)
    assert {r.memory_id: r.label for r in latest.collect()} == {1: "wrong", 2: "noise"}
    pairs = spark.createDataFrame([("p", "s", "e", m, m * 10) for m in (1, 2, 3, 4)], "sample string, session_id string, entry_id string, memory_id long, id long")
    assert tuple(record.progress(pairs, latest).first()) == ("p", 4, 2)
    assert record.next_unlabelled(pairs, latest, 30).first().memory_id == 4
    assert record.next_unlabelled(pairs, latest, 40).first().memory_id == 3


def test_placement(spark):
    rows = [(1, 0.4, 0.6, 0.9, "today", 0.9), (2, 0.4, 0.4, 0.9, "today", 0.9), (3, 0.6, 0.9, 0.9, "event", 0.1), (4, 0.1, 0.1, 0.1, "today", 0.9), (5, 0.9, 0.0, 0.0, "today", 0.4), (6, 0.9, 0.0, 0.0, "never", 0.9)]
    df = spark.createDataFrame([(*r, T0, "text", "semantic") for r in rows], "id int, commitment double, decision double, state double, ends string, ends_confidence double, said_at timestamp, statement string, ends_kind string")
    got = {r.id: (r.placement, r.new_kind, r.until_event, r.until_moment is not None) for r in placed(df).collect()}
    assert got == {1: ("decision", "semantic", None, False), 2: ("state", None, None, False), 3: ("commitment", None, "text", False), 4: ("commitment", None, None, True), 5: ("commitment", None, None, False), 6: ("commitment", None, None, False)}
