"""Queries over statements: reading, reaching, matching, merging, the store."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import memory, scope, text
from quern.operators import merging, recall, sorting
from quern.plans.registry import query
from quern.plans.views import NOW_SQL, THEN_SQL, WORTH, at, NOW, THEN
from quern.sources import store
from quern.tables import table

ASK = "forge.example/quillon/lathe"
LIVE = "superseded_by IS NULL AND ended_at IS NULL"
WITHIN = "({a} = {s} OR starts_with({a}, {s} || '/'))"


def _memories(spark, d):
    return table(spark, d, "memories")


@query(f"SELECT id, round({WORTH}, 6) AS rank FROM memories WHERE {LIVE} AND (scope_key IS NULL OR {WITHIN.format(a=repr(ASK), s='scope_key')}) AND (until_moment IS NULL OR until_moment > {NOW_SQL}) ORDER BY {WORTH} DESC, created_at DESC, id LIMIT 50")
def memories_rank(spark, d):
    return recall.read(_memories(spark, d), ASK, at(NOW)).select("id", F.round("rank", 6).alias("rank"))


@query(f"SELECT id FROM memories WHERE {LIVE} AND (until_moment IS NULL OR until_moment > {NOW_SQL}) ORDER BY created_at DESC, id LIMIT 50")
def memories_newest(spark, d):
    return recall.read(_memories(spark, d), None, at(NOW), order="newest").select("id")


_STOOD = "(superseded_by IS NULL OR superseded_at > {m}) AND (ended_at IS NULL OR ended_at > {m}) AND ({m} IS NULL OR created_at <= {m}) AND (until_moment IS NULL OR until_moment > coalesce({m}, {now}))"


@query(f"SELECT 'then' AS at, id FROM memories WHERE {_STOOD.format(m=THEN_SQL, now=NOW_SQL)} UNION ALL SELECT 'now', id FROM memories WHERE {_STOOD.format(m='CAST(NULL AS TIMESTAMPTZ)', now=NOW_SQL)} UNION ALL SELECT 'said', id FROM memories WHERE {LIVE} AND said_at < {THEN_SQL} AND (until_moment IS NULL OR until_moment > {THEN_SQL})")
def memories_live_at(spark, d):
    rows, null = _memories(spark, d), F.lit(None).cast("timestamp")
    pick = lambda name, where: rows.where(where).select(F.lit(name).alias("at"), "id")
    return pick("then", memory.live_at(at(THEN), at(NOW))).union(pick("now", memory.live_at(null, at(NOW)))).union(pick("said", memory.live_at(at(THEN), at(NOW), by_said_at=True)))


_ASKS = "asks(ask) AS (VALUES ('forge.example/quillon/lathe'), ('forge.example/quillon/lathe-web'), ('forge.example'), ('home'), (NULL))"


def _asks(spark):
    return spark.createDataFrame([("forge.example/quillon/lathe",), ("forge.example/quillon/lathe-web",), ("forge.example",), ("home",), (None,)], "ask string")


def _reach(rule):
    def run(spark, d):
        rows = _memories(spark, d).select(F.col("scope_key")).groupBy("scope_key").agg(F.count("*").alias("held"))
        return _asks(spark).join(rows, rule(F.col("ask"), F.col("scope_key"))).groupBy("ask").agg(F.sum("held").alias("n"))

    return run


@query(f"WITH {_ASKS} SELECT ask, count(*) AS n FROM asks JOIN memories ON ask IS NULL OR scope_key IS NULL OR {WITHIN.format(a='ask', s='scope_key')} GROUP BY ask")
def reach_read(spark, d):
    return _reach(scope.reach_read)(spark, d)


@query(f"WITH {_ASKS} SELECT ask, count(*) AS n FROM asks JOIN memories ON scope_key IS NULL OR {WITHIN.format(a='ask', s='scope_key')} GROUP BY ask")
def reach_match(spark, d):
    held = _memories(spark, d).groupBy("scope_key").agg(F.count("*").alias("held"))
    return scope.reachable_join(_asks(spark), held, "ask", "scope_key").groupBy("ask").agg(F.sum("held").alias("n"))


@query(f"WITH {_ASKS} SELECT ask, count(*) AS n FROM asks JOIN memories ON {WITHIN.format(a='ask', s='scope_key')} GROUP BY ask")
def reach_opening(spark, d):
    return _reach(scope.reach_opening)(spark, d)


@query(f"SELECT id FROM memories WHERE scope_key IS NULL OR NOT ({WITHIN.format(a='scope_key', s=repr('forge.example/quillon'))} OR {WITHIN.format(a='scope_key', s=repr('forge.example/tarnholt/lathe'))})")
def excluded_scopes(spark, d):
    out = spark.createDataFrame([("forge.example/quillon",), ("forge.example/tarnholt/lathe",)], "scope string")
    return scope.without_excluded(_memories(spark, d), out, "scope_key").select("id")


_PROMPTS = """vec AS (SELECT id, embedding_model AS model, kind, scope_key, CAST(embedding AS DOUBLE[]) AS e, said_at, created_at, superseded_by, superseded_at, ended_at, until_moment, actionable FROM memories WHERE embedding IS NOT NULL),
asked AS (SELECT id AS prompt_id, scope_key AS ask, model, e AS v FROM vec WHERE id % 50 = 0)"""
_COS = "CASE WHEN sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(e, e)) = 0 THEN NULL ELSE list_dot_product(v, e) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(e, e))) END"
_MET = f"""{_PROMPTS}, met AS (SELECT prompt_id, id AS memory_id, kind, said_at, created_at, actionable, {_COS} AS similarity FROM asked JOIN vec ON asked.model = vec.model AND (scope_key IS NULL OR {WITHIN.format(a='ask', s='scope_key')})
  WHERE superseded_by IS NULL AND ended_at IS NULL AND (until_moment IS NULL OR until_moment > {NOW_SQL})),
ranked AS (SELECT *, count(*) OVER (PARTITION BY prompt_id) AS n, row_number() OVER (PARTITION BY prompt_id ORDER BY similarity DESC NULLS LAST, memory_id) AS nth FROM met),
floors AS (SELECT *, max(CASE WHEN nth = CAST(greatest(10, ceil(n / 100.0)) AS INT) + 1 THEN similarity END) OVER (PARTITION BY prompt_id) AS floor FROM ranked)"""


def _asked(spark, d):
    """Statements stand in for prompts, those of ids divisible by 50, each against all statements."""
    return _memories(spark, d).where("embedding is not null and id % 50 = 0").select(F.col("id").alias("prompt_id"), F.col("scope_key").alias("ask"), F.col("embedding_model").alias("model"), F.col("embedding").alias("vector"))


@query(f"WITH {_MET} SELECT DISTINCT prompt_id, n, round(floor, 6) AS floor FROM floors")
def match_baseline(spark, d):
    met = recall.neighbours(_asked(spark, d), _memories(spark, d), F.lit(None).cast("timestamp"), at(NOW))
    return recall.baseline(met).select("prompt_id", "n", F.round("floor", 6).alias("floor")).distinct()


@query(f"WITH {_MET}, kept AS (SELECT *, similarity * {WORTH} AS rank FROM floors WHERE similarity > floor + 0.09 AND (actionable IS NULL OR CAST(actionable AS DOUBLE) >= 0.6)), placed AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY rank DESC, memory_id) AS place FROM kept) SELECT prompt_id, memory_id, round(similarity, 6) AS similarity, round(rank, 6) AS rank, place FROM placed WHERE place <= 5")
def match_topk(spark, d):
    found = recall.match(_asked(spark, d), _memories(spark, d), at(NOW))
    return found.select("prompt_id", "memory_id", F.round("similarity", 6).alias("similarity"), F.round("rank", 6).alias("rank"), "place")


@query(f"""WITH asks AS (SELECT id AS prompt_id, scope_key AS ask FROM memories),
met AS (SELECT prompt_id, m.id AS memory_id, {WORTH} AS rank, created_at FROM asks JOIN memories m ON {WITHIN.format(a='ask', s='m.scope_key')} WHERE {LIVE} AND (until_moment IS NULL OR until_moment > {NOW_SQL}))
SELECT prompt_id, memory_id, round(rank, 6) AS rank, place FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY rank DESC, created_at DESC, memory_id) AS place FROM met) WHERE place <= 10""")
def opening_list(spark, d):
    asks = _memories(spark, d).select(F.col("id").alias("prompt_id"), F.col("scope_key").alias("ask"))
    return recall.opening(asks, _memories(spark, d), at(NOW), 10).withColumn("rank", F.round("rank", 6))


@query(f"""WITH asks AS (SELECT id AS prompt_id, scope_key AS ask, kind AS k, said_at AS s FROM memories WHERE said_at IS NOT NULL),
met AS (SELECT prompt_id, m.id AS memory_id, m.said_at FROM asks JOIN memories m ON (m.scope_key IS NULL OR {WITHIN.format(a='ask', s='m.scope_key')}) AND m.kind = k AND m.said_at < s WHERE {LIVE})
SELECT prompt_id, memory_id, number FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY said_at DESC, memory_id DESC) AS number FROM met) WHERE number <= 40""")
def standing_candidates(spark, d):
    asks = _memories(spark, d).where("said_at is not null").select(F.col("id").alias("prompt_id"), F.col("scope_key").alias("ask"), F.array("kind").alias("kinds"), "said_at")
    return recall.standing(asks, _memories(spark, d))


@query("""WITH vec AS (SELECT id, embedding_model AS model, CAST(embedding AS DOUBLE[]) AS e, coalesce(score < 0.4, false) AS empty, created_at FROM memories WHERE embedding IS NOT NULL AND created_at IS NOT NULL),
met AS (SELECT p.id AS prompt_id, r.id AS reading_id, r.empty, CASE WHEN list_dot_product(p.e, p.e) * list_dot_product(r.e, r.e) > 0 THEN list_cosine_similarity(p.e, r.e) END AS similarity FROM vec p JOIN vec r ON p.model = r.model AND r.created_at <= p.created_at WHERE p.id % 50 = 0),
top AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY similarity DESC, reading_id) AS nth FROM met WHERE similarity IS NOT NULL)
SELECT prompt_id, count(*) AS neighbours, round(avg(CAST(empty AS INT)), 6) AS empty_share, count(*) >= 20 AND avg(CAST(empty AS INT)) > 0.8 AS silent FROM top WHERE nth <= 20 GROUP BY prompt_id""")
def silence_vote(spark, d):
    rows = _memories(spark, d).where("embedding is not null and created_at is not null")
    known = rows.select("id", F.col("embedding_model").alias("model"), F.col("embedding").alias("vector"), F.coalesce(F.col("score").cast("double") < 0.4, F.lit(False)).alias("empty"), F.col("created_at").alias("classified_at"))
    asked = rows.where("id % 50 = 0").select(F.col("id").alias("prompt_id"), F.col("embedding_model").alias("model"), F.col("embedding").alias("vector"), F.col("created_at").alias("as_of"))
    return recall.holds_nothing(asked, known).withColumn("empty_share", F.round("empty_share", 6))


_PAIRS = f"""live AS (SELECT id, kind, scope_key, embedding_model, said_at, statement, CAST(embedding AS DOUBLE[]) AS e FROM memories WHERE {LIVE} AND said_at IS NOT NULL AND embedding IS NOT NULL AND (until_moment IS NULL OR until_moment > {NOW_SQL}) AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
alike AS (SELECT a.id AS older_id, b.id AS newer_id, a.scope_key, a.kind AS older_kind, b.kind AS newer_kind, a.said_at AS older_said_at, b.said_at AS newer_said_at, list_cosine_similarity(a.e, b.e) AS similarity
  FROM live a JOIN live b ON a.scope_key IS NOT DISTINCT FROM b.scope_key AND a.embedding_model = b.embedding_model AND (a.said_at, a.id) < (b.said_at, b.id))"""


@query(f"WITH {_PAIRS} SELECT older_id, newer_id, scope_key, round(similarity, 6) AS similarity FROM alike WHERE older_kind = newer_kind AND similarity >= 0.8")
def similar_pairs(spark, d):
    return merging.similar_pairs(_memories(spark, d), at(NOW)).select("older_id", "newer_id", "scope_key", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_PAIRS} SELECT count(*) AS pairs FROM alike WHERE older_kind = newer_kind AND similarity >= 0.8 AND similarity < 0.95")
def similar_band(spark, d):
    return merging.similar_pairs(_memories(spark, d), at(NOW), upper=0.95).agg(F.count("*").alias("pairs"))


@query(f"WITH {_PAIRS} SELECT scope_key IS NULL AS everywhere, older_kind = newer_kind AS same_kind, count(*) AS pairs FROM alike WHERE similarity >= 0.5 GROUP BY ALL")
def null_safe_scope_pairs(spark, d):
    pairs = merging.similar_pairs(_memories(spark, d), at(NOW), lower=0.5, across_kinds=True)
    return pairs.groupBy(F.col("scope_key").isNull().alias("everywhere"), (F.col("older_kind") == F.col("newer_kind")).alias("same_kind")).agg(F.count("*").alias("pairs"))


def _decided(spark, d):
    pairs = merging.similar_pairs(_memories(spark, d), at(NOW), lower=0.5, across_kinds=True)
    said = pairs.select("older_id", "newer_id", (F.col("older_id") * 7 % 10 / 10.0).alias("same"), (F.col("newer_id") * 3 % 10 / 10.0).alias("settles"), (F.col("older_id") * 11 % 10 / 10.0).alias("keeps"))
    return merging.decide(pairs, said)


@query()
def merge_decision(spark, d):
    """The decision on each similar pair, with answers by rule; the literals it reads need lookbehind, which the SQL lacks."""
    return _decided(spark, d).select("older_id", "newer_id", "reason")


@query()
def merge_backlog(spark, d):
    return merging.fold(_decided(spark, d))


@query()
def statement_literals(spark, d):
    return _memories(spark, d).select("id", F.array_join(text.literals(F.col("statement")), "|").alias("literals"))


@query(f"SELECT m.id, m.superseded_by FROM memories m JOIN memories s ON s.id = m.superseded_by WHERE m.retired_by_run = 'run-04' AND m.statement <> s.statement")
def undo_run(spark, d):
    return merging.undo(_memories(spark, d), "run-04")


@query("SELECT m.id, m.superseded_by FROM memories m JOIN memories s ON s.id = m.superseded_by WHERE (m.retired_by_run = 'run-04' OR (m.retired_by_run IS NULL AND m.superseded_at >= TIMESTAMPTZ '2024-01-05 00:00:00+00' AND m.superseded_at < TIMESTAMPTZ '2024-02-05 00:00:00+00')) AND m.statement <> s.statement")
def undo_window(spark, d):
    return merging.undo(_memories(spark, d), "run-04", since=at("2024-01-05"), until=at("2024-02-05"))


@query(f"WITH live AS (SELECT id FROM memories WHERE {LIVE}), wanted AS (SELECT id AS memory_id, id + 7 AS survivor FROM memories WHERE id % 5 = 0 UNION ALL SELECT id, id FROM memories WHERE id % 9 = 0) SELECT memory_id, survivor FROM wanted WHERE memory_id <> survivor AND memory_id IN (SELECT id FROM live) AND survivor IN (SELECT id FROM live)")
def retire_guard(spark, d):
    m = _memories(spark, d)
    wanted = m.where("id % 5 = 0").select(F.col("id").alias("memory_id"), (F.col("id") + 7).alias("survivor")).union(m.where("id % 9 = 0").select("id", "id"))
    return store.retirements(wanted, m)


@query(f"SELECT id, CASE WHEN id % 3 = 0 THEN id + 1 END AS superseded_by, CASE WHEN id % 4 = 0 THEN 'state' END AS ended_reason FROM memories WHERE {LIVE}")
def event_fold(spark, d):
    """Events folded into statements: retired and restored, ended and reopened, the last one counting."""
    m = _memories(spark, d).where(memory.live())
    base = m.select(F.col("id").alias("memory_id"))
    event = lambda rows, seq, what, **v: rows.select(F.lit(seq).cast("long").alias("seq"), at(THEN).alias("at"), "memory_id", F.lit(what).alias("what"), v.get("survivor", F.lit(None)).cast("long").alias("survivor"), v.get("reason", F.lit(None)).cast("string").alias("reason"), F.lit("r").alias("run"), F.lit(None).cast("timestamp").alias("until_moment"), F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("embedding_model"))
    events = event(base, 1, "retired", survivor=F.col("memory_id") + 1).union(event(base.where("memory_id % 3 <> 0"), 2, "restored")).union(event(base, 3, "ended", reason=F.lit("event"))).union(event(base.where("memory_id % 4 <> 0"), 4, "reopened")).union(event(base.where("memory_id % 4 = 0"), 5, "ended", reason=F.lit("state")))
    return store.view(m, events).select("id", "superseded_by", "ended_reason")


@query("SELECT id FROM memories WHERE (embedding IS NULL OR embedding_model IS DISTINCT FROM 'lodestar-small') AND trim(coalesce(statement, '')) <> ''")
def needs_embedding(spark, d):
    return store.needs_embedding(_memories(spark, d), "lodestar-small").select("id")


@query(f"""SELECT id, '- ' || coalesce(kind, '') || ', ' || coalesce(nullif(scope_key, ''), 'everywhere') || ', ' || CASE WHEN actor = 'human' AND coalesce(actor_depth, 0) = 0 THEN 'person' ELSE coalesce(nullif(actor, ''), 'unknown') || ' at depth ' || coalesce(actor_depth, 0) END || ', ' ||
CASE WHEN said_at IS NULL THEN 'undated' WHEN epoch_us({NOW_SQL}) - epoch_us(said_at) < 86400000000 THEN 'today' WHEN (epoch_us({NOW_SQL}) - epoch_us(said_at)) // 86400000000 = 1 THEN '1 day ago' ELSE ((epoch_us({NOW_SQL}) - epoch_us(said_at)) // 86400000000) || ' days ago' END || ': ' || coalesce(statement, '') AS line FROM memories""")
def block_lines(spark, d):
    return _memories(spark, d).select("id", text.block_line(F.col("kind"), F.col("scope_key"), F.col("actor"), F.col("actor_depth"), F.col("said_at"), F.col("statement"), at(NOW)).alias("line"))


_ZONED = "date_trunc('day', said_at AT TIME ZONE 'America/New_York')"


@query(f"""SELECT id, CAST(epoch_us(({_ZONED} + INTERVAL 1 DAY) AT TIME ZONE 'America/New_York') AS BIGINT) AS today, CAST(epoch_us(({_ZONED} + INTERVAL 33 HOUR) AT TIME ZONE 'America/New_York') AS BIGINT) AS tomorrow_morning,
CAST(epoch_us(({_ZONED} + INTERVAL 2 DAY) AT TIME ZONE 'America/New_York') AS BIGINT) AS tomorrow, CAST(epoch_us(({_ZONED} + to_days(CAST(8 - isodow({_ZONED}) AS INT)) + INTERVAL 9 HOUR) AT TIME ZONE 'America/New_York') AS BIGINT) AS monday FROM memories WHERE said_at IS NOT NULL""")
def moments_zone(spark, d):
    m = _memories(spark, d).where("said_at is not null").withColumn("m", text.moments(F.col("said_at"), "America/New_York"))
    return m.select("id", *[F.unix_micros(f"m.{c}").alias(c) for c in ("today", "tomorrow_morning", "tomorrow", "monday")])


@query("""WITH a AS (SELECT id, said_at, (id * 3 % 10) / 10.0 AS commitment, (id * 7 % 10) / 10.0 AS decision, (id % 4) / 4.0 AS state, id % 3 AS e FROM memories)
SELECT id, CASE WHEN commitment < 0.5 AND decision >= 0.5 THEN 'decision' WHEN commitment < 0.5 AND state >= 0.5 THEN 'state' ELSE 'commitment' END AS placement,
NOT (commitment < 0.5 AND (decision >= 0.5 OR state >= 0.5)) AND e = 0 AS by_event, NOT (commitment < 0.5 AND (decision >= 0.5 OR state >= 0.5)) AND e = 1 AND said_at IS NOT NULL AS by_moment FROM a""")
def place_sorted(spark, d):
    m = _memories(spark, d).drop("until_moment").withColumns({"statement": F.lit("x"), "commitment": F.col("id") * 3 % 10 / 10.0, "decision": F.col("id") * 7 % 10 / 10.0, "state": F.col("id") % 4 / 4.0, "ends": F.element_at(F.array(F.lit("event"), F.lit("today"), F.lit("never")), (F.col("id") % 3 + 1).cast("int")), "ends_confidence": F.lit(0.9), "ends_kind": F.lit("semantic")})
    return sorting.placed(m).select("id", "placement", F.col("until_event").isNotNull().alias("by_event"), F.col("until_moment").isNotNull().alias("by_moment"))


@query("SELECT scope_key, len(string_split(scope_key, '/')) AS levels, array_to_string(list_transform(range(1, len(string_split(scope_key, '/')) + 1), lambda i: array_to_string(list_slice(string_split(scope_key, '/'), 1, i), '/')), '|') AS above FROM memories WHERE scope_key IS NOT NULL GROUP BY scope_key")
def scope_ancestors(spark, d):
    rows = _memories(spark, d).where("scope_key is not null").select("scope_key").distinct()
    return rows.select("scope_key", F.size(F.split("scope_key", "/")).cast("long").alias("levels"), F.array_join(scope.ancestors(F.col("scope_key")), "|").alias("above"))
