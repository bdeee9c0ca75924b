import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from quern.api import Engine
from quern.sources import otlp, store, tail, transcripts
from quern.streaming import ingest

T0 = datetime(2024, 5, 1, tzinfo=timezone.utc)


def kv(k, v):
    return {"key": k, "value": v if isinstance(v, dict) else {"stringValue": v}}


def export(*records, resource=()):
    return json.dumps({"resourceLogs": [{"resource": {"attributes": list(resource)}, "scopeLogs": [{"scope": {"name": "n", "version": "1"}, "logRecords": list(records)}]}]})


def record(session, entry, body="x", kind="prompt", *more, **fields):
    attributes = [*([kv("session.id", session)] if session else []), *([kv("memory.entry.id", entry)] if entry else []), kv("memory.kind", kind), *more]
    return {"timeUnixNano": "1714500000000000000", "body": body if isinstance(body, dict) else {"stringValue": body}, "attributes": attributes, **fields}


def bronze(spark, *exports):
    return spark.createDataFrame([(i, T0 + timedelta(minutes=i), e) for i, e in enumerate(exports)], "export_id long, received_at timestamp, export string")


def test_trap_t09_a_null_on_the_record_hides_the_resource(spark):
    rows = [record("s", "a", "x", "prompt", kv("host.name", {})), record("s", "b")]
    got = {r.entry_id: r.machine for r in otlp.rebuild(bronze(spark, export(*rows, resource=[kv("host.name", "m")]))).collect()}
    assert got == {"a": None, "b": "m"}


def test_trap_t07_t08_first_wins_and_nulls_never_conflict(spark):
    one = export(record("s", "a", "first"), record("s", "a", "second"), record("s", None, "n1"), record("s", None, "n2"), record(None, "a", "n3"), record("s", None, "n2"))
    rows = otlp.rebuild(bronze(spark, one, export(record("s", "a", "third"), record("s", "b", "new")))).collect()
    assert sorted(r.body for r in rows) == ["first", "n1", "n2", "n2", "n3", "new"]


def test_trap_t10_t12_values(spark):
    value = {"kvlistValue": {"values": [kv("a", {"arrayValue": {"values": [{"stringValue": 'q"'}, {"boolValue": True}, {"intValue": "3"}, {}]}}), kv("b", {"doubleValue": 1.5})]}}
    rows = [record("s", "a", "nul\x00here"), record("s", "b", value), record("s", "c", {"boolValue": True}), record("s", "d", {"other": 1}), record("s", "e", "x", "prompt", kv("k", "1"), kv("k", "2"), kv("gen_ai.usage.input_tokens", "x"), kv("gen_ai.usage.output_tokens", {"intValue": "7"}))]
    got = {r.entry_id: r for r in otlp.rebuild(bronze(spark, export(*rows))).collect()}
    assert got["a"].body == "nul�here" and got["b"].body == '{"a": ["q\\"", true, 3, null], "b": 1.5}' and got["c"].body == "True" and got["d"].body is None
    assert got["e"].attributes["k"] == "2" and got["e"].input_tokens is None and got["e"].output_tokens == 7


def test_broken_and_empty_exports(spark):
    assert otlp.rebuild(bronze(spark, "not json", "{}", '{"resourceLogs": []}', export())).count() == 0


def test_dimensions(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), (None, "z")], "fp string, v string")
    new = otlp.new_dimension(rows, spark.createDataFrame([("b",)], "fingerprint string"), "fp", ["v"])
    assert [(r.fingerprint, r.v) for r in new.collect()] == [("a", "x")]


def jsonl(spark, *entries):
    return spark.createDataFrame([("d/2024_f1.jsonl", 0, i, e if isinstance(e, str) else json.dumps(e)) for i, e in enumerate(entries)], "file string, block long, seq long, value string")


def test_block_reader(spark):
    got = transcripts.read(
        "claude-code",
        jsonl(
            spark,
            {"type": "ai-title", "sessionId": "S", "aiTitle": "t"},
            "partial {",
            {"type": "user", "uuid": "u1", "sessionId": "S", "cwd": "/w", "version": "2", "timestamp": "2024-01-01T00:00:00.5Z", "message": {"content": "[Image] hello"}},
            {"type": "assistant", "uuid": "u2", "sessionId": "S", "message": {"model": "m", "usage": {"input_tokens": 5, "cache_read_input_tokens": 2}, "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}, {"type": "thinking", "thinking": "t0"}, {"type": "tool_use", "id": "c1", "name": "ls", "input": {"p": 1}}]}},
            {"type": "user", "uuid": "u3", "sessionId": "S", "cwd": "/v", "message": {"content": [{"type": "tool_result", "content": "plain"}, {"type": "tool_result", "content": [{"type": "text", "text": "in"}], "is_error": True}]}},
            {"type": "user", "uuid": "u4", "sessionId": "T", "isSidechain": True, "message": {"content": [{"type": "text", "text": "sub"}]}},
            {"type": "user", "uuid": "u5", "message": {"content": "no session"}},
        ),
        machine="box",
    ).collect()
    by = {r.entry_id: r for r in got}
    assert set(by) == {"2024_f1:line-0:title", "u1:prompt", "u2:response", "u2:thinking:0", "u2:tool_call:c1", "u3:tool_result", "u4:prompt"}
    assert by["u2:response"].body == "a\nb" and by["u2:response"].input_tokens == 5 and by["u2:response"].provider == "anthropic" and by["u2:tool_call:c1"].attributes == {"gen_ai.tool.call.id": "c1"}
    assert by["u3:tool_result"].body == "plain\nin" and by["u3:tool_result"].error_type == "tool_error" and by["u3:tool_result"].working_directory == "/v"
    assert (by["u4:prompt"].actor, by["u4:prompt"].actor_depth, by["u1:prompt"].actor) == ("agent", 1, "human")
    assert by["2024_f1:line-0:title"].working_directory == "/w" and by["u1:prompt"].occurred_at == datetime(2024, 1, 1, 0, 0, 0, 500000)


def test_rollout_and_message_readers(spark):
    rollout = jsonl(spark, {"type": "state"}, {"type": "session_meta", "payload": {"id": "R", "session_id": "S", "cwd": "/a"}}, {"type": "response_item", "payload": {"type": "message", "role": "developer", "content": "sys"}}, {"type": "turn_context", "payload": {"cwd": "/b"}}, {"type": "response_item", "ordinal": 4, "payload": {"type": "function_call_output", "call_id": "c", "output": [{"text": "x"}, {"text": "y"}]}}, {"type": "response_item", "payload": {"type": "reasoning", "id": "own", "summary": [{"text": "why"}]}}, {"type": "event_msg", "payload": {"type": "user_message", "message": "q"}})
    by = {r.entry_id: r for r in transcripts.read("codex", rollout).collect()}
    assert set(by) == {"R:line-2:system", "R:4:tool_result", "own:thinking", "R:line-6:prompt"}
    assert by["R:line-2:system"].working_directory == "/a" and by["R:4:tool_result"].working_directory == "/b" and by["R:4:tool_result"].body == "x\ny" and by["own:thinking"].body == "why"
    messages = jsonl(spark, {"type": "session", "id": "P", "parentSession": "/x/2024_abc.jsonl"}, {"type": "message", "id": "m1", "message": {"role": "user", "content": None, "timestamp": 1700000000000}}, {"type": "message", "id": "m2", "message": {"role": "assistant", "usage": {"cost": {"total": 0.25}}, "content": [{"type": "toolCall", "id": "t", "name": "rd", "arguments": {"a": 1}}]}}, {"type": "message", "message": "odd"}, {"type": "other"})
    by = {r.entry_id: r for r in transcripts.read("pi", messages).collect()}
    assert set(by) == {"m1:prompt", "m2:response", "m2:tool_call:t"}
    assert by["m1:prompt"].previous_session == "abc" and float(by["m2:response"].cost_total) == 0.25 and by["m1:prompt"].body == ""
    with pytest.raises(ValueError):
        transcripts.read("codex", rollout, entries_before=3)
    with pytest.raises(ValueError):
        transcripts.read("nobody", rollout)
    assert transcripts.read("pi", messages.limit(0)).count() == 0


def test_lines_and_chunks_number_alike(spark, tmp_path):
    (tmp_path / "d").mkdir()
    lines = [json.dumps({"type": "bookkeeping", "sessionId": "S", "n": i}) for i in range(20)]
    (tmp_path / "d" / "f.jsonl").write_text("\n".join([*lines[:10], "", "broken", *lines[10:]]) + "\n")
    whole = {r.entry_id for r in transcripts.read("claude-code", transcripts.lines(spark, str(tmp_path))).collect()}
    part = jsonl(spark, *lines[10:]).withColumn("file", F.lit("d/f.jsonl"))
    assert {r.entry_id for r in transcripts.read("claude-code", part, entries_before=10).collect()} == {f"f:line-{i}:bookkeeping" for i in range(10, 20)}
    assert whole == {f"f:line-{i}:bookkeeping" for i in range(20)}


def test_tail_source_resumes_and_restarts(spark, tmp_path):
    tail.register(spark)
    folder, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    folder.mkdir()
    (folder / "a.jsonl").write_text("one\ntwo\npart")

    def run():
        q = spark.readStream.format("jsonl_tail").option("path", str(folder)).load().writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r.value for r in spark.read.schema(tail.SCHEMA).parquet(out).collect())

    assert run() == ["one", "two"]
    with open(folder / "a.jsonl", "a") as f:
        f.write("ial\nthree\n")
    (folder / "b.jsonl").write_text("other\n")
    assert run() == ["one", "other", "partial", "three", "two"]
    (folder / "a.jsonl").write_text("new\n")
    assert run() == ["new", "one", "other", "partial", "three", "two"]


def test_tail_reads_whole_lines_only(tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text("a" * 50 + "\nbb\nc")
    assert tail.whole_lines_end(str(p), 0, 10) == 51 and tail.whole_lines_end(str(p), 51, 10) == 54 and tail.whole_lines_end(str(p), 54, 10) == 54


def test_events_fold_in_time(spark):
    statements = spark.createDataFrame([(1, "a", None, None, None, None), (2, "b", None, None, None, None)], "id long, statement string, superseded_by long, superseded_at timestamp, ended_at timestamp, ended_reason string")
    event = lambda seq, m, i, what, survivor=None, reason=None: (seq, T0 + timedelta(minutes=m), i, what, survivor, reason, "r", None, None, None)
    events = spark.createDataFrame([event(1, 1, 1, "retired", 2), event(2, 5, 1, "restored"), event(3, 5, 2, "ended", reason="state"), event(4, 9, 1, "retired", 7)], store.EVENTS)
    full = statements.withColumns({c: F.lit(None).cast(t) for c, t in (("retired_by_run", "string"), ("until_moment", "timestamp"), ("embedding", "array<float>"), ("embedding_model", "string"), ("merged_at", "timestamp"))})
    state = lambda at=None: {r.id: (r.superseded_by, r.ended_reason) for r in store.view(full, events, at).collect()}
    assert state() == {1: (7, None), 2: (None, "state")}
    assert state(F.lit(T0 + timedelta(minutes=2))) == {1: (2, None), 2: (None, None)}
    assert state(F.lit(T0 + timedelta(minutes=6))) == {1: (None, None), 2: (None, "state")}
    assert store.view(full, events.limit(0)).count() == 2


def test_guards(spark):
    current = spark.createDataFrame([(1, None, None), (2, None, None), (3, 1, None)], "id long, superseded_by long, ended_at timestamp")
    wanted = spark.createDataFrame([(1, 2), (2, 2), (3, 1), (1, 3)], "memory_id long, survivor long")
    assert [tuple(r) for r in store.retirements(wanted, current).collect()] == [(1, 2)]
    assert [r.memory_id for r in store.endings(spark.createDataFrame([(1, "event"), (3, "state")], "memory_id long, reason string"), current).collect()] == [1]
    with pytest.raises(Exception, match="unknown reason"):
        store.endings(spark.createDataFrame([(1, "mood")], "memory_id long, reason string"), current).collect()


def test_streaming_ingest_stores_once(spark, tmp_path):
    landing, s = tmp_path / "landing", store.Store(spark, f"file://{tmp_path}/store")
    landing.mkdir()
    (landing / "a.json").write_text(export(record("s", "a", "1"), record("s", "a", "2"), record("s", None, "n"), resource=[kv("host.name", "m")]) + "\n")
    ingest.ingest(spark, str(landing), s, str(tmp_path / "check")).awaitTermination()
    (landing / "b.json").write_text(export(record("s", "a", "again"), record("s", "b", "3"), resource=[kv("host.name", "m")]) + "\n")
    ingest.ingest(spark, str(landing), s, str(tmp_path / "check")).awaitTermination()
    ingest.ingest(spark, str(landing), s, str(tmp_path / "check")).awaitTermination()
    assert sorted(r.body for r in s.read("logs").collect()) == ["1", "3", "n"]
    assert s.read("resources").count() == 1


def test_unseen_stream_keeps_a_session_s_set(spark, tmp_path):
    schema = "session_id string, prompt_id long, occurred_at timestamp, found array<long>"
    turns = lambda *rows: spark.createDataFrame([(s, p, T0 + timedelta(minutes=p), f) for s, p, f in rows], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/turns")

    def run():
        q = ingest.unseen_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/turns")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination()
        return {(r.session_id, r.prompt_id): r.memory_ids for r in spark.read.parquet(f"{tmp_path}/out").collect()}

    turns(("a", 1, [1, 2]), ("a", 2, [2, 3]), ("b", 1, [1]))
    assert run() == {("a", 1): [1, 2], ("a", 2): [3], ("b", 1): [1]}
    turns(("a", 3, [3, 4]), ("b", 2, None))
    assert run()["a", 3] == [4]


def test_pane_stream_emits_changed_windows_again(spark, tmp_path):
    schema = "session_id string, occurred_at timestamp, received_at timestamp"
    s = store.Store(spark, f"file://{tmp_path}/store")

    def arrive(*rows):
        spark.createDataFrame([("s", T0 + timedelta(minutes=o), T0 + timedelta(minutes=r)) for o, r in rows], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        ingest.pane_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/events"), ["session_id"], s, "windows", f"{tmp_path}/check", size=7200, slide=3600).awaitTermination()

    arrive((10, 11), (20, 21), (70, 71))
    arrive((30, 100), (40, 5000))
    rows = s.read("windows").collect()
    base = int(T0.timestamp())
    last = {}
    for r in sorted(rows, key=lambda r: r.batch):
        last[(r.window_start - base) // 3600] = (r.records, r.late)
    assert last == {-1: (3, 1), 0: (4, 1), 1: (1, 0)}
    assert {(r.window_start - base) // 3600 for r in rows if r.batch == max(x.batch for x in rows)} == {-1, 0}


def test_streamed_panes_in_any_order_and_replayed(spark, tmp_path):
    """Batches that bring re-sends before their originals end at the counts of one pass over all rows."""
    import random

    from quern.operators import panes

    rng = random.Random(5)
    schema = "id long, session_id string, entry_id string, received_at timestamp, occurred_at timestamp"
    rows = []
    for i in range(400):
        o = T0 + timedelta(minutes=rng.randrange(600))
        late = rng.choice([1, 2, 70, 400, 3000])
        rows.append((i, rng.choice("ab"), rng.choice([None, f"e{rng.randrange(120)}"]), rng.choice([o + timedelta(minutes=late)] * 9 + [None]), rng.choice([o] * 9 + [None])))
    df = spark.createDataFrame(rows, schema)
    rng.shuffle(rows)
    s = store.Store(spark, f"file://{tmp_path}/store")
    for part in range(4):
        spark.createDataFrame(rows[part * 100 : part * 100 + 100], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        ingest.pane_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/events"), ["session_id"], s, "w", f"{tmp_path}/check", size=7200, slide=3600, resends=10**9).awaitTermination()
    want = panes.windows(panes.panes(panes.first_arrivals(df, "occurred_at"), ["session_id"]), ["session_id"], size=7200, slide=3600)
    got = {(r.session_id, r.window_start): (r.records - r.late, r.late, r.dropped) for r in ingest.last_windows(s, "w", ["session_id"]).collect()}
    assert {k: v for k, v in got.items() if any(v)} == {(r.session_id, r.window_start): (r.on_time, r.late, r.dropped) for r in want.collect()}
    # the last batch again, as after a failure between its writes and its commit
    import os

    os.remove(f"{tmp_path}/check/commits/3")
    os.path.exists(f"{tmp_path}/check/commits/.3.crc") and os.remove(f"{tmp_path}/check/commits/.3.crc")
    ingest.pane_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/events"), ["session_id"], s, "w", f"{tmp_path}/check", size=7200, slide=3600, resends=10**9).awaitTermination()
    assert {(r.session_id, r.window_start): (r.records - r.late, r.late, r.dropped) for r in ingest.last_windows(s, "w", ["session_id"]).collect()} == got


def test_engine(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.json").write_text(export(record("s", "a", "hello", "prompt", kv("memory.actor", "human")), record("s", "a", "again"), record("s", "b", "hi", "response"), resource=[kv("host.name", "m")]) + "\n")
    e = Engine(spark, f"file://{tmp_path}/store")
    with pytest.raises(LookupError):
        e.records()
    assert tuple(e.ingest_exports(f"{tmp_path}/x", "2024-05-01 00:00:00").first()) == (3, 2, 1)
    assert tuple(e.ingest_exports(f"{tmp_path}/x", "2024-05-02 00:00:00").first()) == (3, 0, 3)
    assert e.records(kind="prompt").count() == 1 and e.health().first().status == "ok"
    e.rebuild()
    assert e.store.read("logs_rebuilt").count() == 2
    replies = spark.createDataFrame([("s", "a:prompt", "semantic", "o/r", T0, "fp", 'ok [{"statement": "A", "everywhere": true}, {"statement": "B"}]')], "session_id string, entry_id string, kind string, scope_key string, said_at timestamp, questions_fingerprint string, reply string")
    assert [(r.statement, r.scope_key) for r in e.write(replies).collect()] == [("A", None)]
    columns = "id long, statement string, kind string, score double, scope_key string, session_id string, entry_id string, questions_fingerprint string, created_at timestamp, said_at timestamp, actor string, actor_depth int, superseded_by long, superseded_at timestamp, ended_at timestamp, ended_reason string, until_moment timestamp, actionable double, embedding array<float>, embedding_model string, merged_at timestamp, retired_by_run string"
    row = lambda i, text, v: (i, text, "semantic", 0.9, None, "s", f"e{i}", "fp", T0, T0 + timedelta(minutes=i), "human", 0, None, None, None, None, None, None, v, "m", None, None)
    e.store.append("statements", spark.createDataFrame([row(1, "same words", [1.0, 0.0]), row(2, "same words", [1.0, 0.01]), row(3, "other words", [0.0, 1.0])], columns))
    merges = e.merge()
    assert [(r.retired_id, r.survivor_id, r.reason) for r in merges.collect()] == [(1, 2, "cutoff")]
    e.apply_merges(merges, "run-1", "2024-05-03 00:00:00")
    assert {r.id for r in e.memories(now="2024-05-04 00:00:00").collect()} == {2, 3}
    assert e.undo("run-1").count() == 0  # its survivor says the same
    e.end(spark.createDataFrame([(3, "state")], "memory_id long, reason string"), "2024-05-05 00:00:00")
    assert {r.id for r in e.memories(now="2024-05-06 00:00:00").collect()} == {2}
    assert {r.id for r in e.statements("2024-05-02 00:00:00").where("superseded_by is null").collect()} == {1, 2, 3}
    assert e.embed("another").count() == 3
    assert any(r.line.startswith('store_rows{table="logs"} 2') for r in e.metrics().collect())
