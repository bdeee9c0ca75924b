import math
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from quern.functions import judge
from quern.operators import merging, recall, vectors

NOW = datetime(2024, 6, 1, tzinfo=timezone.utc)
MEMORY = "id long, statement string, kind string, score double, scope_key string, created_at timestamp, said_at timestamp, superseded_by long, superseded_at timestamp, ended_at timestamp, until_moment timestamp, actionable double, embedding array<float>, embedding_model string, retired_by_run string"


def angle(similarity, d=8):
    t = math.acos(similarity)
    return [math.cos(t), math.sin(t), *[0.0] * (d - 2)]


def statement(i, vec=None, **over):
    row = dict(id=i, statement=f"s{i}", kind="semantic", score=0.9, scope_key=None, created_at=NOW - timedelta(days=9), said_at=NOW - timedelta(days=10) + timedelta(minutes=i), superseded_by=None, superseded_at=None, ended_at=None, until_moment=None, actionable=None, embedding=vec or angle(0.1), embedding_model="m", retired_by_run=None)
    return tuple((row | over).values())


def table(spark, rows):
    return spark.createDataFrame(rows, MEMORY)


PROMPT = "prompt_id long, ask string, model string, vector array<float>, seen array<long>"

@pytest.fixture
def now(spark):
    return F.lit(NOW)


@pytest.mark.parametrize("sims,want", [([i / 10000 for i in range(10000)], 0.9899), ([i / 100 for i in range(50)], 0.39), ([0.5] * 10, None), ([0.9] * 11, 0.9)])
def test_trap_t03_order_statistic(spark, sims, want):
    met = spark.createDataFrame([(1, i, float(s)) for i, s in enumerate(sims)], "prompt_id long, memory_id long, similarity double")
    floor = recall.baseline(met).first().floor
    assert floor is None if want is None else abs(floor - want) < 1e-9


def test_trap_t04_match_strictly_over_and_filters_after_the_floor(spark, now):
    rows = [statement(i, angle(0.2)) for i in range(1, 31)] + [statement(100, angle(0.9)), statement(101, angle(0.95), actionable=0.1), statement(102, angle(0.96)), statement(103, angle(0.97), embedding_model="other"), statement(104, angle(0.99), superseded_by=1), statement(105, angle(0.29)), statement(106, angle(0.9), scope_key="a/b"), statement(107, angle(0.9), scope_key="z")]
    prompts = spark.createDataFrame([(1, "a/b/c", "m", angle(1.0), [102]), (2, None, "m", angle(1.0), None), (3, "a/b", "none", angle(1.0), None)], PROMPT)
    found = recall.match(prompts, table(spark, rows), now).orderBy("prompt_id", "place").collect()
    assert [(r.prompt_id, r.memory_id) for r in found] == [(1, 106), (1, 100), (2, 102), (2, 100)]  # of equal similarity the younger is worth more
    assert all(abs(r.floor - 0.2) < 1e-6 for r in found)
    assert recall.match(prompts.limit(0), table(spark, rows), now).count() == 0
    assert recall.match(prompts, table(spark, []), now).count() == 0


def test_opening_and_read(spark, now):
    rows = [statement(1, scope_key="a"), statement(2), statement(3, scope_key="a/b", kind="praise"), statement(4, scope_key="a", superseded_by=1), statement(5, scope_key="ab"), statement(6, scope_key="a", until_moment=NOW - timedelta(days=1))]
    asks = spark.createDataFrame([(1, "a/b"), (2, None)], "prompt_id long, ask string")
    got = recall.opening(asks, table(spark, rows), now, 5).orderBy("place").collect()
    assert [(r.prompt_id, r.memory_id) for r in got] == [(1, 1), (1, 3)]
    assert [r.id for r in recall.read(table(spark, rows), "a/b", now).collect()] == [2, 1, 3]
    assert {r.id for r in recall.read(table(spark, rows), None, now, order="newest").collect()} == {1, 2, 3, 5}
    with pytest.raises(ValueError):
        recall.read(table(spark, rows), None, now, order="odd")


def test_trap_t15_t16_silence(spark):
    at = lambda d: NOW - timedelta(days=d)
    far = [(i, "m", angle(0.1), False, at(20)) for i in range(300)]
    near = [(1000 + i, "m", angle(0.9), True, at(15)) for i in range(20)]
    later = [(2000 + i, "m", angle(0.99), False, at(1)) for i in range(60)]
    readings = spark.createDataFrame(far + near + later, "id long, model string, vector array<float>, empty boolean, classified_at timestamp")
    prompts = spark.createDataFrame([(1, "m", angle(1.0), at(10)), (2, "m", angle(1.0), NOW), (3, "m", angle(1.0), at(30))], "prompt_id long, model string, vector array<float>, as_of timestamp")
    got = {r.prompt_id: (r.neighbours, r.empty_share, r.silent) for r in recall.holds_nothing(prompts, readings).collect()}
    assert got == {1: (20, 1.0, True), 2: (20, 0.0, False)}
    few = recall.holds_nothing(prompts, readings.where("id >= 1000 and id < 1019")).where("prompt_id = 1").first()
    assert few.neighbours == 19 and not few.silent
    share = readings.where("id between 1000 and 1015").union(readings.where("id < 4"))
    assert not recall.holds_nothing(prompts, share).where("prompt_id = 1").first().silent  # 80 % is not over 80 %


def test_seen_and_replay(spark):
    handed = spark.createDataFrame([("a", [3, 1]), ("a", [1]), ("b", []), ("c", None)], "session_id string, memory_ids array<long>")
    assert {r.session_id: r.seen for r in recall.seen(handed).collect()} == {"a": [1, 3], "b": [], "c": []}
    turns = spark.createDataFrame([("a", i, NOW + timedelta(minutes=i), i == 2, i == 3) for i in range(1, 6)] + [("b", 9, NOW, False, False)], "session_id string, prompt_id long, occurred_at timestamp, noise boolean, silent boolean")
    matched = spark.createDataFrame([(p, m, 1.0 / m) for p in (1, 2, 3, 4, 9) for m in (1, 2, 3)] + [(5, 3, 1.0)], "prompt_id long, memory_id long, rank double")
    out = recall.replay(turns, matched, 2)
    got = {r.prompt_id: (r.form, r.memory_ids) for r in out.collect()}
    assert got == {1: ("opening", [1, 2]), 2: ("noise", []), 3: ("match", []), 4: ("match", [3]), 5: ("match", []), 9: ("opening", [1, 2])}
    labels = spark.createDataFrame([("a", 1, "good")], "session_id string, memory_id long, label string")
    report = {(r.measure, r.of): r.n for r in recall.report(out, table(spark, [statement(1), statement(2, scope_key="x")]), labels).collect()}
    assert report["turns", ""] == 6 and report["nothing", ""] == 3 and report["statements", ""] == 5 and report["label", "good"] == 1 and report["kind", "gone"] == 1
    assert recall.handed_lines(out).first().line == "a\t1\topening\t1"


def test_replay_turns_goes_on_past_the_third_turn(spark, tmp_path):
    from quern.plans import QUERIES

    body = lambda s, i: "/clear" if (s, i) == ("a", 4) else "say more"
    logs = [(s, 100 * "abc".index(s) + i, f"{s}{i}", NOW + timedelta(minutes=i), NOW + timedelta(minutes=i), "human", 0, "prompt", None, body(s, i)) for s in "abc" for i in range(1, 9)]
    spark.createDataFrame(logs, "session_id string, id long, entry_id string, received_at timestamp, occurred_at timestamp, actor string, actor_depth int, kind string, scope_key string, body string").write.parquet(f"{tmp_path}/logs.parquet")
    given = [("a", list(range(20, 34))), ("a", [20, 5, None]), ("b", [7, 9]), ("c", []), (None, [1])]
    spark.createDataFrame(given, "session_id string, memory_ids array<long>").write.parquet(f"{tmp_path}/injections.parquet")
    got = {r.prompt_id: (r.form, r.memory_ids) for r in QUERIES["replay_turns"](spark, str(tmp_path)).collect()}
    want = {}
    for s, left in (("a", {*range(20, 34), 5}), ("b", {7, 9}), ("c", set())):
        handed = False
        for i in range(1, 9):
            prompt = 100 * "abc".index(s) + i
            if (s, i) == ("a", 4):
                want[prompt] = ("noise", "")
                continue
            ids = [] if prompt % 11 == 0 else sorted(left, key=lambda m: ((m * 31 + prompt * 17) % 101, m))[:3]
            want[prompt] = ("match" if handed else "opening", ",".join(map(str, ids)))
            left, handed = left - set(ids), handed or bool(ids)
    assert got == want
    assert all(want[i][1] for i in (5, 6))


def test_queries_over_statements_ask_for_all_of_them(spark, tmp_path):
    from quern.plans import QUERIES

    rows = table(spark, [statement(i, scope_key="x") for i in range(1, 13)]).withColumn("ended_reason", F.lit(None).cast("string"))
    rows.write.parquet(f"{tmp_path}/memories.parquet")
    got = {n: QUERIES[n](spark, str(tmp_path)).collect() for n in ("opening_list", "standing_candidates", "event_fold")}
    assert {(r.prompt_id, r.memory_id, r.place) for r in got["opening_list"]} == {(p, m, m) for p in range(1, 13) for m in range(1, 11)}
    assert {(r.prompt_id, r.memory_id, r.number) for r in got["standing_candidates"]} == {(p, m, p - m) for p in range(1, 13) for m in range(1, p)}
    assert {(r.id, r.superseded_by, r.ended_reason) for r in got["event_fold"]} == {(i, None if i % 3 else i + 1, None if i % 4 else "state") for i in range(1, 13)}


def test_tiles_give_all_pairs_once(spark):
    left = spark.createDataFrame([(i, "x" if i % 3 else None, angle(0.5 + i / 100)) for i in range(30)], "left_id long, b string, left_vector array<float>")
    right = spark.createDataFrame([(i, "x", angle(0.5 + i / 100) if i else [0.0] * 8) for i in range(25)], "right_id long, b string, right_vector array<float>")
    got = vectors.cosines(left, right, ["b"], tile=4).collect()
    assert len(got) == len({(r.left_id, r.right_id) for r in got}) == 20 * 25
    assert sum(r.similarity is None for r in got) == 20
    assert all(abs(r.similarity - 1) < 1e-6 for r in got if r.left_id == r.right_id and r.similarity is not None)


def test_trap_t17_t18_pairs(spark, now):
    rows = [statement(1, angle(1.0)), statement(2, angle(0.9)), statement(3, angle(0.79)), statement(4, angle(0.95), scope_key="s"), statement(5, angle(0.99), scope_key="s"), statement(6, angle(0.99), kind="praise"), statement(7, angle(0.99), said_at=None), statement(8, angle(0.99), embedding_model="o"), statement(9, angle(1.0), said_at=NOW - timedelta(days=10) + timedelta(minutes=1))]
    pairs = merging.similar_pairs(table(spark, rows), now).collect()
    assert {(r.older_id, r.newer_id, r.scope_key) for r in pairs} == {(1, 2, None), (1, 9, None), (2, 3, None), (4, 5, "s"), (9, 2, None)}
    assert {(r.older_id, r.newer_id) for r in merging.similar_pairs(table(spark, rows), now, upper=0.95).collect()} == {(1, 2), (9, 2)} | ({(2, 3)} if 0.79 * 0.9 + math.sqrt((1 - 0.79**2) * (1 - 0.9**2)) < 0.95 else set())


PAIR = "older_id long, newer_id long, scope_key string, older_kind string, newer_kind string, older_statement string, newer_statement string, older_said_at timestamp, newer_said_at timestamp, similarity double"


def pair(i, sim=0.9, older="semantic", newer="semantic", a="same words", b="same words", gap=1, scope=None):
    return (i, i + 100, scope, older, newer, a, b, NOW, NOW + timedelta(minutes=gap), sim)


@pytest.mark.parametrize(
    "row,answers,want",
    [
        (pair(1, 0.95), None, "cutoff"), (pair(1, 0.95, a="use --fast"), None, "ask"), (pair(1, 0.95, a="use --fast"), (0.9, 0.0, 0.9), "literals"), (pair(1), (0.9, 0.0, 0.9), "same"), (pair(1), (0.9, 0.0, 0.3), "literals"), (pair(1), (0.4, 0.7, 0.9), "settles"),
        (pair(1, gap=0), (0.4, 0.9, 0.9), "both"), (pair(1), (0.4, 0.69, 0.9), "both"), (pair(1, 0.99, older="preference"), None, "guard"), (pair(1, 0.99, newer="praise"), None, "guard"), (pair(1, 0.99, older="praise"), None, "cutoff"), (pair(1, 0.99, older="other"), None, "guard"),
        (pair(1, 0.99, older="correction", newer="preference"), None, "cutoff"), (pair(1, 0.99, older="semantic", newer="prospective"), None, "guard"),
    ],
)
def test_merge_decision(spark, row, answers, want):
    df = spark.createDataFrame([row], PAIR)
    said = spark.createDataFrame([(row[0], row[1], *answers)] if answers else [], "older_id long, newer_id long, same double, settles double, keeps double")
    assert merging.decide(df, said).first().reason == want


def test_trap_t19_fold_is_in_order_and_needs_live_survivors(spark):
    rows = [("s", o, n, NOW + timedelta(minutes=o), NOW + timedelta(minutes=n), "cutoff") for o, n in ((1, 2), (1, 3), (2, 3), (3, 4))] + [(None, 1, 9, NOW, NOW, "same"), ("s", 5, 6, NOW, NOW, "both")]
    df = spark.createDataFrame(rows, "scope_key string, older_id long, newer_id long, older_said_at timestamp, newer_said_at timestamp, reason string")
    got = {(r.scope_key, r.retired_id, r.survivor_id) for r in merging.fold(df).collect()}
    assert got == {("s", 1, 2), ("s", 2, 3), ("s", 3, 4), (None, 1, 9)}


def test_trap_t25_undo(spark):
    rows = [statement(1, retired_by_run="r", superseded_by=2, superseded_at=NOW), statement(2), statement(3, retired_by_run="r", superseded_by=4, superseded_at=NOW, statement="same"), statement(4, statement="same"), statement(5, superseded_by=2, superseded_at=NOW), statement(6, retired_by_run="other", superseded_by=2, superseded_at=NOW)]
    df = table(spark, rows)
    assert [r.id for r in merging.undo(df, "r").collect()] == [1]
    assert sorted(r.id for r in merging.undo(df, "r", since=F.lit(NOW), until=F.lit(NOW + timedelta(days=1))).collect()) == [1, 5]
    with pytest.raises(ValueError):
        merging.undo(df, "r", since=F.lit(NOW))


def test_judges_and_embeddings(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, state string")
    got = {r.id: (r.same, r.outcome) for r in judge.judged(df, "state", judge.TableJudge({"a": {"same": 0.9}, "b": None}, {"same": 0.1}), ["id"]).collect()}
    assert got == {1: (0.9, "ok"), 2: (None, "refused"), 3: (0.1, "ok")}

    class Broken:
        questions = ("same",)

        def ask(self, states):
            raise RuntimeError

    assert {r.outcome for r in judge.judged(df, "state", Broken(), ["id"]).collect()} == {"error"}
    rows = spark.createDataFrame([("use the tool",), (" ",), (None,)], "t string").select(judge.embed(F.col("t"), 64).alias("v")).collect()
    assert abs(sum(x * x for x in rows[0].v) - 1) < 1e-5 and rows[1].v is None and rows[2].v is None
    assert judge.padded_batches([5, 1, 9, 2, 2, 100], 10) == [[1, 3, 4], [0], [2], [5]] and judge.padded_batches([], 5) == []
