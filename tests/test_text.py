from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from quern.functions import memory, scope, text


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "body,want",
    [
        ("<command>", True), ("\n\t\x0b\x0c<x", True), ("[Request interrupted by user]", True), ("Goal check-in: x", True), ("/compact", True), (" /plugin:do-it \n", True), ("/café", True), ("/compact now", False), ("[Image #1]\n[Image #2] ", True),
        ("[Image #1] what is this", False), ("\xa0<x", False), (" /compact", False), ("\x1c<x", False), ("fix it", False), ("", False), (None, None), ("Stop hook feedback: no", True),
    ],
)
def test_trap_t13_t14_noise(spark, body, want):
    assert one(spark, body, text.noise) is want


@pytest.mark.parametrize(
    "sentence,want",
    [
        ("use https://api.example.test/v1.", {"https://api.example.test/v1"}), ("run --osc=no then -x", {"--osc", "-x"}), ("read/write and/or CI/CD 24/7", {"24", "7"}), ("see src/app.py or ~/x/", {"src/app.py", "~/x"}),
        ("pyproject.toml e.g. i.e.", {"pyproject.toml"}), ("set WIDGET_TOKEN in merge_backlog", {"WIDGET_TOKEN", "merge_backlog"}), ("commit 3f2a91c and deadbeef 1234567", {"3f2a91c", "1234567"}), ("v2.4.1 python3.12 sha256 1,000", {"2.4.1", "3.12", "1000"}),
        ("call `do it` now", {"do it"}), ("", set()),
    ],
)
def test_literals(spark, sentence, want):
    assert set(one(spark, sentence, text.literals)) == want


def test_lacking(spark):
    df = spark.createDataFrame([("the base URL is https://api.example.test/v1", "use the example provider")], "a string, b string")
    assert df.select(text.lacking(F.col("a"), F.col("b")).alias("r")).first().r == ["https://api.example.test/v1"]


def test_identity_skips_empty_parts(spark):
    df = spark.createDataFrame([("e", "k", "w"), ("", "k", None), (None, None, ""), ("e", None, "w")], "e string, k string, w string")
    assert [r.r for r in df.select(text.identity(F.col("e"), F.col("k"), F.col("w")).alias("r")).collect()] == ["e:k:w", "k", None, "e:w"]


def test_fingerprint_ignores_key_order(spark):
    a, b = F.create_map(F.lit("x"), F.lit("1"), F.lit("y"), F.lit("2")), F.create_map(F.lit("y"), F.lit("2"), F.lit("x"), F.lit("1"))
    r = spark.range(1).select(text.fingerprint(a).alias("a"), text.fingerprint(b).alias("b")).first()
    assert r.a == r.b and len(r.a) == 16


def test_trap_t11_nanos_and_casts(spark):
    df = spark.createDataFrame([("1700000000123456789",), ("x",), (None,), ("12.5",)], "v string")
    rows = df.select(text.nanos_time(F.col("v")).alias("t"), text.lenient(F.col("v"), "bigint").alias("n")).collect()
    assert rows[0].t == datetime(2023, 11, 14, 22, 13, 20, 123456) and [r.n for r in rows] == [1700000000123456789, None, None, None]
    assert [r.t for r in rows[1:]] == [None, None, None]


@pytest.mark.parametrize("url,want", [("git@host:owner/name.git", ("owner", "name")), ("https://host/owner/name", ("owner", "name")), ("name.git", ("", "name")), ("", ("", "")), ("ssh://u@h/a/b/c.git/", ("b", "c"))])
def test_remote_parts(spark, url, want):
    r = one(spark, url, text.remote_parts)
    assert (r.owner, r.name) == want


@pytest.mark.parametrize("name,want", [("example.org", True), (".hidden.org", False), ("nodot", False), ("a.b1", False), ("x.io", True)])
def test_domain(spark, name, want):
    assert one(spark, name, text.looks_like_domain) is want


def test_moments_over_a_change_of_clocks(spark):
    said = datetime(2026, 9, 26, 1, 44, tzinfo=timezone.utc)  # Friday evening in New York
    df = spark.createDataFrame([(said,), (datetime(2024, 3, 9, 12, tzinfo=timezone.utc),)], "t timestamp").select(text.moments(F.col("t"), "America/New_York").alias("m")).select(*[F.unix_seconds(f"m.{c}").alias(c) for c in ("today", "tomorrow_morning", "tomorrow", "monday")])
    at = lambda *a: int(datetime(*a, tzinfo=timezone.utc).timestamp())
    first, second = df.collect()
    assert tuple(first) == (at(2026, 9, 26, 4), at(2026, 9, 26, 13), at(2026, 9, 27, 4), at(2026, 9, 28, 13))
    assert tuple(second) == (at(2024, 3, 10, 5), at(2024, 3, 10, 13), at(2024, 3, 11, 4), at(2024, 3, 11, 13))


def test_block_lines(spark):
    now = F.lit("2024-03-10 12:00:00").cast("timestamp")
    rows = [("semantic", None, "human", 0, datetime(2024, 3, 10, 11, tzinfo=timezone.utc), "a"), ("praise", "o/r", "agent", 2, datetime(2024, 3, 9, 1, tzinfo=timezone.utc), "b"), ("other", "", None, None, None, "c"), ("x", "s", "human", 1, datetime(2024, 3, 1, tzinfo=timezone.utc), "d")]
    df = spark.createDataFrame(rows, "k string, s string, a string, d int, t timestamp, x string")
    got = [r.r for r in df.select(text.block_line(F.col("k"), F.col("s"), F.col("a"), F.col("d"), F.col("t"), F.col("x"), now).alias("r")).collect()]
    assert got == ["- semantic, everywhere, person, today: a", "- praise, o/r, agent at depth 2, 1 day ago: b", "- other, everywhere, unknown at depth 0, undated: c", "- x, s, human at depth 1, 9 days ago: d"]


SCOPES = [None, "forge/liken-sh", "forge/liken-sh/liken", "forge/liken_sh", "forge/liken-sh-two"]


@pytest.mark.parametrize(
    "rule,ask,want",
    [
        (scope.reach_read, None, 5), (scope.reach_read, "forge/liken-sh/liken", 3), (scope.reach_read, "forge/liken-sh", 2), (scope.reach_match, None, 1), (scope.reach_match, "forge/liken-sh/liken", 3), (scope.reach_match, "forge/likenXsh", 1),
        (scope.reach_opening, None, 0), (scope.reach_opening, "forge/liken-sh/liken", 2), (scope.reach_opening, "forge/liken_sh/x", 1),
    ],
)
def test_trap_t01_t02_three_ways_to_reach(spark, rule, ask, want):
    df = spark.createDataFrame([(s,) for s in SCOPES], "s string")
    assert df.where(rule(F.lit(ask).cast("string"), F.col("s"))).count() == want


def test_ancestor_join_is_the_prefix_join(spark):
    rows = spark.createDataFrame([(s,) for s in SCOPES], "s string")
    asks = spark.createDataFrame([(i, a) for i, a in enumerate([None, "forge", "forge/liken-sh", "forge/liken-sh/liken/x", ""])], "i int, ask string")
    a = scope.reachable_join(asks, rows, "ask", "s").select("i", "s")
    b = asks.join(rows, scope.reach_match(F.col("ask"), F.col("s"))).select("i", "s")
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_trap_t27_excluded_scopes_keep_nulls(spark):
    rows = spark.createDataFrame([(None,), ("a",), ("a/b",), ("ab",), ("c/a",)], "s string")
    out = scope.without_excluded(rows, spark.createDataFrame([("a",)], "scope string"), "s")
    assert sorted(str(r.s) for r in out.collect()) == ["None", "ab", "c/a"]


def test_scope_of_directories(spark):
    dirs = spark.createDataFrame([("/home/me/git.example.org", False), ("/home/me/git.example.org/org", False), ("/home/me/git.example.org/org/repo", True), ("/home/me/plain/x", False), ("/home/me/solo", True)], "path string, is_repository boolean")
    places = spark.createDataFrame([(p, "/home/me") for p in ("/home/me/git.example.org/org/repo/src", "/home/me/git.example.org/org", "/home/me/plain/x", "/home/me/solo", "/home/me", "/srv/work")], "path string, home string")
    got = {r.path: (r.scope_key, r.scope_kind) for r in scope.scope_of(places, dirs).collect()}
    assert got == {
        "/home/me/git.example.org/org/repo/src": ("git.example.org/org/repo", "repository"),
        "/home/me/git.example.org/org": ("git.example.org/org", "organisation"),
        "/home/me/plain/x": ("plain", "directory"),
        "/home/me/solo": ("solo", "repository"),
        "/home/me": ("me", "directory"),
        "/srv/work": ("work", "directory"),
    }


def test_trap_t21_worth(spark):
    now = datetime(2024, 4, 1, tzinfo=timezone.utc)
    rows = [("semantic", datetime(2024, 1, 2, tzinfo=timezone.utc), now), ("semantic", None, now), ("praise", datetime(2024, 3, 2, tzinfo=timezone.utc), now), ("odd", now, now), ("semantic", datetime(2025, 1, 1, tzinfo=timezone.utc), now)]
    df = spark.createDataFrame(rows, "k string, s timestamp, c timestamp")
    got = [round(r.r, 6) for r in df.select(memory.worth(F.col("k"), F.col("s"), F.col("c"), F.lit(now)).alias("r")).collect()]
    assert got == [0.72, 0.9, 0.25, 0.1, 0.9]


def test_trap_t05_actionable(spark):
    df = spark.createDataFrame([(None,), (0.6,), (0.59,)], "actionable double")
    assert df.where(memory.actionable(0.6)).count() == 2


def test_trap_t06_live_at(spark):
    d = lambda n: datetime(2024, 1, n, tzinfo=timezone.utc)
    rows = [(1, d(5), d(4), None, None, None, None), (2, d(5), d(4), 9, d(8), None, None), (3, d(5), d(6), None, None, None, None), (4, d(7), d(6), None, None, d(7), None), (5, d(5), None, None, None, None, d(6)), (6, d(1), d(1), 9, None, None, None)]
    df = spark.createDataFrame(rows, "id int, created_at timestamp, said_at timestamp, superseded_by int, superseded_at timestamp, ended_at timestamp, until_moment timestamp")
    ids = lambda where: [r.id for r in df.where(where).orderBy("id").collect()]
    at, null, now = F.lit(d(6)), F.lit(None).cast("timestamp"), F.lit(d(20))
    assert ids(memory.live_at(at, now)) == [1, 2, 3]
    assert ids(memory.live_at(null, now)) == [1, 3]
    assert ids(memory.live_at(at, now, by_said_at=True)) == [1]
    assert ids(memory.live_at(null, now, by_said_at=True)) == []


def test_kinds_of_a_reading(spark):
    df = spark.createDataFrame([(0.9, 0.9, 0.1), (0.1, 0.75, 0.2), (None, 0.1, 0.1)], "preference double, correction double, praise double")
    scores = {k: F.col(k) for k in ("preference", "correction", "praise")}
    rows = df.select(memory.best_kind(scores).alias("b"), memory.firing(scores).alias("f")).collect()
    assert [(r.b, r.f) for r in rows] == [("preference", ["preference", "correction"]), ("correction", ["correction"]), ("correction", [])]


def test_reply_items(spark):
    got = one(spark, 'Sure: [{"statement": "a", "everywhere": true}, {"statement": "b"}] done', lambda c: text.json_items(c, "statement string, everywhere boolean"))
    assert [(r.statement, r.everywhere) for r in got] == [("a", True), ("b", None)]
    assert one(spark, "none", lambda c: text.json_items(c, "statement string")) is None
