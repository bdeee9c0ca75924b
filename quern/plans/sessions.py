"""Queries over the record of sessions: pairing, sampling, windows, replay, ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import scope, text
from quern.operators import ledger, recall, record
from quern.plans.registry import query
from quern.plans.views import LABELS, LOGS, NOISE, PROMPTS, READINGS, SPACES, at, labels, logs, readings
from quern.sources import otlp
from quern.tables import cut, table


@query("SELECT session_id, string_agg(DISTINCT CAST(m AS VARCHAR), ',' ORDER BY CAST(m AS VARCHAR)) AS seen FROM (SELECT session_id, unnest(memory_ids) AS m FROM injections) GROUP BY session_id")
def seen_by_session(spark, d):
    found = recall.seen(table(spark, d, "injections")).where(F.size("seen") > 0)
    return found.select("session_id", F.array_join(F.array_sort(F.col("seen").cast("array<string>")), ",").alias("seen"))


@query("SELECT id, unnest(memory_ids) AS memory_id FROM injections")
def injection_members(spark, d):
    return table(spark, d, "injections").select("id", F.explode("memory_ids").alias("memory_id"))


@query("SELECT id FROM injections WHERE list_contains(memory_ids, 100) OR len(memory_ids) = 0")
def injections_holding(spark, d):
    return table(spark, d, "injections").where(F.array_contains("memory_ids", F.lit(100).cast("long")) | (F.size("memory_ids") == 0)).select("id")


_RANKED = "ranked AS (SELECT *, coalesce(form, CASE WHEN row_number() OVER (PARTITION BY session_id ORDER BY injected_at NULLS FIRST, id) = 1 THEN 'opening' ELSE 'match' END) AS f FROM injections)"


@query(f"WITH {_RANKED} SELECT id, f AS form FROM ranked")
def ranked_injections(spark, d):
    return record.ranked_injections(table(spark, d, "injections")).select("id", "form")


_PAIRED = f"""{PROMPTS}, {_RANKED}, ranged AS (SELECT * FROM ranked WHERE injected_at >= TIMESTAMPTZ '2024-01-02 00:00:00+00' AND injected_at < TIMESTAMPTZ '2024-01-09 00:00:00+00' AND (scope_key IS NULL OR NOT (scope_key = 'forge.example/quillon' OR starts_with(scope_key, 'forge.example/quillon/')))),
human AS (SELECT session_id, entry_id, id, occurred_at FROM prompts WHERE actor = 'human'),
paired AS (SELECT r.id AS injection_id, r.session_id, r.f AS form, r.scope_key, r.memory_ids, h.entry_id, row_number() OVER (PARTITION BY r.id ORDER BY h.occurred_at DESC, h.id DESC) AS nth FROM ranged r JOIN human h ON h.session_id = r.session_id AND h.occurred_at <= r.injected_at + INTERVAL 5 SECOND)"""


@query(f"WITH {_PAIRED} SELECT injection_id, entry_id FROM paired WHERE nth = 1")
def as_of_prompt(spark, d):
    ranged = _ranged(spark, d).withColumnRenamed("id", "injection_id")
    human = record.prompts(logs(spark, d)).where("actor = 'human'").select("session_id", "entry_id", F.col("id").alias("log_id"), "occurred_at")
    return record.as_of(ranged.select("injection_id", "session_id", "injected_at"), human, "session_id", "injected_at", "occurred_at", "log_id", slack=5, carried=["entry_id"]).where("entry_id is not null").select("injection_id", "entry_id")


def _ranged(spark, d):
    rows = record.ranked_injections(table(spark, d, "injections")).where((F.col("injected_at") >= at("2024-01-02")) & (F.col("injected_at") < at("2024-01-09")))
    return scope.without_excluded(rows, spark.createDataFrame([("forge.example/quillon",)], "scope string"), "scope_key")


@query(f"WITH {_PAIRED} SELECT DISTINCT session_id, entry_id, memory_id, form, m.kind, scope_key FROM (SELECT *, unnest(memory_ids) AS memory_id FROM paired WHERE nth = 1) p JOIN (SELECT id, kind FROM memories) m ON m.id = p.memory_id")
def candidate_pairs(spark, d):
    return record.candidate_pairs(table(spark, d, "injections"), logs(spark, d), table(spark, d, "memories"), at("2024-01-02"), at("2024-01-09"), spark.createDataFrame([("forge.example/quillon",)], "scope string"))


@query("SELECT pair_id FROM (SELECT *, row_number() OVER (PARTITION BY form, kind ORDER BY pair_id) AS turn FROM pairs) ORDER BY turn, form NULLS FIRST, kind NULLS FIRST LIMIT 200")
def stratified_sample(spark, d):
    return ledger.ordered_sample(table(spark, d, "pairs"), ["form", "kind"], 200, F.col("pair_id")).select("pair_id")


_SAMPLED = "sampled AS (SELECT 's' || (pair_id % 3) AS sample, session_id, entry_id, memory_id, min(pair_id) AS id FROM pairs GROUP BY ALL)"


def _sampled(spark, d):
    return table(spark, d, "pairs").groupBy(F.concat(F.lit("s"), (F.col("pair_id") % 3).cast("string")).alias("sample"), "session_id", "entry_id", "memory_id").agg(F.min("pair_id").alias("id"))


@query(f"WITH {LABELS}, {_SAMPLED} SELECT sample, count(*) AS pairs, count(*) FILTER (EXISTS (SELECT 1 FROM labels l WHERE l.session_id = p.session_id AND l.entry_id = p.entry_id AND l.memory_id = p.memory_id)) AS labelled FROM sampled p GROUP BY sample")
def label_progress(spark, d):
    return record.progress(_sampled(spark, d), labels(spark, d))


@query(f"WITH {LABELS}, {_SAMPLED} SELECT id, sample FROM sampled p WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.session_id = p.session_id AND l.entry_id = p.entry_id AND l.memory_id = p.memory_id) ORDER BY id <= 1000, id, sample LIMIT 1")
def next_unlabelled(spark, d):
    return record.next_unlabelled(_sampled(spark, d), labels(spark, d), 1000).select("id", "sample")


@query(f"WITH {LABELS} SELECT session_id, entry_id, memory_id, label FROM (SELECT *, row_number() OVER (PARTITION BY session_id, entry_id, memory_id ORDER BY labelled_at DESC NULLS LAST, id DESC) AS nth FROM labels) WHERE nth = 1")
def labels_latest(spark, d):
    return record.latest_labels(labels(spark, d))


@query(f"WITH {PROMPTS} SELECT session_id, row_number() OVER w - 1 AS page, id, CAST(epoch_us(occurred_at) AS BIGINT) AS from_at, CAST(epoch_us(lag(occurred_at) OVER w) AS BIGINT) AS until_at FROM prompts WHERE session_id IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY occurred_at DESC, id DESC)")
def earlier_exchange(spark, d):
    found = record.exchanges(logs(spark, d))
    return found.select("session_id", F.col("page").cast("long").alias("page"), "id", F.unix_micros("from_at").alias("from_at"), F.unix_micros("until_at").alias("until_at"))


@query(f"WITH {PROMPTS} SELECT id, CAST(epoch_us(coalesce(lag(occurred_at, 4) OVER (PARTITION BY session_id ORDER BY occurred_at, id), min(occurred_at) OVER (PARTITION BY session_id))) AS BIGINT) AS start_at FROM prompts WHERE session_id IS NOT NULL")
def rounds_window(spark, d):
    return record.round_starts(logs(spark, d)).select("id", F.unix_micros("start_at").alias("start_at"))


_SAID = f"""{LOGS}, spoken AS (SELECT *, {NOISE} AS noise FROM first_logs WHERE kind IN ('prompt', 'response') AND session_id IS NOT NULL AND occurred_at IS NOT NULL),
said AS (SELECT session_id, entry_id, id, occurred_at, body, coalesce(lag(occurred_at, 4) OVER (PARTITION BY session_id ORDER BY occurred_at, id), min(occurred_at) OVER (PARTITION BY session_id)) AS start_at FROM spoken WHERE kind = 'prompt' AND NOT noise),
turns AS (SELECT session_id, id, occurred_at, CASE kind WHEN 'prompt' THEN '[person] ' ELSE '[agent] ' END || trim(body, {SPACES}) AS line FROM spoken WHERE (kind = 'response' OR NOT noise) AND trim(coalesce(body, ''), {SPACES}) <> ''),
windows AS (SELECT s.session_id, s.entry_id, any_value(s.body) AS message, coalesce(string_agg(t.line, chr(10) || chr(10) ORDER BY t.occurred_at, t.id), '') AS before
  FROM said s LEFT JOIN turns t ON t.session_id = s.session_id AND t.occurred_at >= s.start_at AND t.occurred_at < s.occurred_at WHERE s.entry_id IS NOT NULL GROUP BY s.session_id, s.entry_id, s.id)"""


@query(f"WITH {_SAID} SELECT session_id, entry_id, CAST(length(before) AS INTEGER) AS before_chars, CAST(length(message) AS INTEGER) AS message_chars, md5(before) AS before_md5 FROM windows")
def context_window(spark, d):
    """Each prompt with the exchanges of its last rounds; the budget is over what these texts reach."""
    return record.context_windows(logs(spark, d)).select("session_id", "entry_id", F.length("before").alias("before_chars"), F.length("message").alias("message_chars"), F.md5("before").alias("before_md5"))


@query("SELECT count(*) AS n, count(DISTINCT id) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY session_id, entry_id ORDER BY received_at NULLS LAST, id) AS nth FROM logs WHERE session_id IS NOT NULL AND entry_id IS NOT NULL) WHERE nth = 1")
def dedupe_count(spark, d):
    rows = table(spark, d, "logs").where("session_id is not null and entry_id is not null").select("session_id", "entry_id", "received_at", "id")
    kept = otlp.new_rows(rows, None, ["session_id", "entry_id"], ["received_at", "id"])
    return kept.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS nth FROM lineitem) WHERE nth = 1 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0)")
def dedupe_insert(spark, d):
    """Rows to append where a key may repeat and some keys are stored already."""
    rows = table(spark, d, "lineitem")
    fresh = otlp.new_rows(rows, None, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"])
    stored = table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return fresh.join(stored, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber", "l_suppkey")


@query("SELECT fingerprint, max(host_name) AS host_name FROM resources WHERE fingerprint NOT IN (SELECT fingerprint FROM resources WHERE id % 2 = 0) GROUP BY fingerprint")
def dimension_upsert(spark, d):
    r = table(spark, d, "resources")
    return otlp.new_dimension(r, r.where("id % 2 = 0"), "fingerprint", ["host_name"]).select("fingerprint", "host_name")


@query("SELECT l.id, r.host_name FROM logs l JOIN resources r ON r.id = l.resource_id WHERE l.kind = 'system'")
def records_with_resource(spark, d):
    return table(spark, d, "logs").where("kind = 'system'").join(table(spark, d, "resources").select(F.col("id").alias("resource_id"), "host_name"), "resource_id").select("id", "host_name")


@query("SELECT id, left(sha256('{\"host\":\"' || host_name || '\",\"os\":\"' || os_type || '\"}'), 16) AS named FROM resources WHERE host_name IS NOT NULL AND os_type IS NOT NULL")
def fingerprints(spark, d):
    r = table(spark, d, "resources").where("host_name is not null and os_type is not null")
    return r.select("id", text.fingerprint(F.create_map(F.lit("os"), F.col("os_type"), F.lit("host"), F.col("host_name"))).alias("named"))


@query(r"""WITH u AS (SELECT DISTINCT repository AS url FROM logs WHERE repository IS NOT NULL), p AS (SELECT url, list_filter(string_split(regexp_extract(url, '^.*?://(.*)$', 1), '/'), lambda x: x <> '') AS parts FROM u WHERE contains(url, '://'))
SELECT url, coalesce(parts[-2], '') AS owner, regexp_replace(coalesce(parts[-1], ''), '\.git$', '') AS name FROM p""")
def remote_parts(spark, d):
    rows = table(spark, d, "logs").where("repository like '%://%'").select(F.col("repository").alias("url")).distinct()
    return rows.withColumn("p", text.remote_parts(F.col("url"))).select("url", "p.owner", "p.name")


@query(r"SELECT DISTINCT machine, regexp_matches(machine, '^[^.].*\.[A-Za-z]{2,}$') AS domain FROM logs WHERE machine IS NOT NULL")
def domain_test(spark, d):
    return table(spark, d, "logs").where("machine is not null").select("machine", text.looks_like_domain(F.col("machine")).alias("domain")).distinct()


@query("SELECT id, TRY_CAST(attributes['code.line.number'] AS BIGINT) AS line, TRY_CAST(body AS DOUBLE) AS number FROM logs WHERE attributes['code.line.number'] IS NOT NULL")
def lenient_casts(spark, d):
    line = F.try_element_at("attributes", F.lit("code.line.number"))
    return table(spark, d, "logs").where(line.isNotNull()).select("id", text.lenient(line, "bigint").alias("line"), text.lenient(F.col("body"), "double").alias("number"))


@query(f"WITH {READINGS}, best AS (SELECT session_id, max_by(id, (occurred_at, id)) AS reading_id FROM readings GROUP BY session_id) SELECT m.id, b.reading_id FROM memories m LEFT JOIN best b ON b.session_id = m.session_id WHERE m.until_moment IS NULL")
def latest_reading(spark, d):
    best = readings(spark, d).groupBy("session_id").agg(F.max_by("id", F.struct("occurred_at", "id")).alias("reading_id"))
    return table(spark, d, "memories").where("until_moment is null").select("id", "session_id").join(best, "session_id", "left").select("id", "reading_id")


def _turns(spark, d):
    rows = logs(spark, d).where("kind = 'prompt' and session_id is not null and entry_id is not null and occurred_at is not null")
    return rows.select("session_id", F.col("id").alias("prompt_id"), "entry_id", "occurred_at", F.coalesce(text.noise(F.col("body")), F.lit(True)).alias("noise"), (F.col("id") % 11 == 0).alias("silent"))


def _handed(spark, d):
    """Each turn matched with what its session was handed in fact, folded so that nothing is handed twice."""
    offered = table(spark, d, "injections").select("session_id", F.explode("memory_ids").alias("memory_id"))
    return recall.replay_from(_turns(spark, d), offered, lambda ids, prompt: (ids * 31 + prompt * 17) % 101, 3)


@query()
def replay_turns(spark, d):
    return _handed(spark, d).select("session_id", "prompt_id", "form", F.array_join(F.col("memory_ids").cast("array<string>"), ",").alias("memory_ids"))


@query()
def replay_report(spark, d):
    return recall.report(cut(_handed(spark, d), "handed"), table(spark, d, "memories"), record.latest_labels(labels(spark, d)).groupBy("session_id", "memory_id").agg(F.max("label").alias("label")))


@query("""WITH t AS (SELECT session_id, form, unnest(memory_ids) AS memory_id FROM injections WHERE form IS NOT NULL), l AS (SELECT concat_ws(chr(9), session_id, form, CAST(memory_id AS VARCHAR)) AS line, memory_id FROM t)
SELECT 'first' AS side, line FROM (SELECT line FROM l WHERE memory_id % 3 <> 0 EXCEPT ALL SELECT line FROM l WHERE memory_id % 3 <> 1) UNION ALL SELECT 'second', line FROM (SELECT line FROM l WHERE memory_id % 3 <> 1 EXCEPT ALL SELECT line FROM l WHERE memory_id % 3 <> 0)""")
def replay_diff(spark, d):
    rows = table(spark, d, "injections").where("form is not null").select("session_id", "form", F.explode("memory_ids").alias("memory_id"))
    line = F.concat_ws("\t", "session_id", "form", F.col("memory_id").cast("string")).alias("line")
    return recall.difference(rows.where("memory_id % 3 <> 0").select(line), rows.where("memory_id % 3 <> 1").select(line))


@query()
def session_windows(spark, d):
    """An extension: bursts of a session's records, closed by a gap of an hour."""
    rows = logs(spark, d).where("session_id is not null and occurred_at is not null")
    return rows.groupBy("session_id", F.session_window("occurred_at", "1 hour")).agg(F.count("*").alias("records")).select("session_id", F.unix_micros("session_window.start").alias("start"), "records")
