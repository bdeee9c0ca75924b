"""Queries over the ledger of model calls, and backlogs from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import memory
from quern.operators import ledger, record
from quern.plans.registry import query
from quern.plans.views import CALLS, LOGS, NOISE, PROMPTS, READINGS, SCORES, at, logs, model_calls, readings
from quern.tables import table

_USAGE = "SELECT {g} AS \"group\", count(*) AS calls, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens FROM calls GROUP BY 1"


@query(f"WITH {CALLS} " + _USAGE.format(g="CAST(epoch_us(date_trunc('day', called_at)) AS BIGINT)"))
def usage_by_day(spark, d):
    return ledger.usage(model_calls(spark, d), "day").withColumn("group", F.unix_micros("group"))


@query(f"WITH {CALLS} {_USAGE.format(g='model')}")
def usage_by_model(spark, d):
    return ledger.usage(model_calls(spark, d), "model")


@query(f"WITH {CALLS} {_USAGE.format(g='task')}")
def usage_by_task(spark, d):
    return ledger.usage(model_calls(spark, d), "task")


@query(f"WITH {CALLS} " + _USAGE.format(g="run").replace("FROM calls", "FROM calls WHERE called_at >= TIMESTAMP '2024-01-05 00:00:00' AND called_at < TIMESTAMP '2024-01-20 00:00:00'"))
def usage_by_run(spark, d):
    return ledger.usage(model_calls(spark, d), "run", at("2024-01-05"), at("2024-01-20"))


@query(f"WITH {CALLS} " + " UNION ALL ".join(f"SELECT '{by}' AS by, * FROM ({_USAGE.format(g=g)})" for by, g in (("model", "model"), ("task", "task"), ("run", "run"))))
def usage_all(spark, d):
    return ledger.usage_all(model_calls(spark, d)).where("by <> 'day'")


@query(f"WITH {CALLS}, mean AS (SELECT task, avg(CAST(input_tokens AS DOUBLE)) AS m FROM calls WHERE outcome = 'ok' GROUP BY task) SELECT p.task, round(m, 6) AS mean_tokens, CAST(round_even(m * p.planned, 0) AS BIGINT) AS estimate FROM (VALUES ('classify', 7), ('synthesize', 3), ('merge', 5)) AS p(task, planned) LEFT JOIN mean USING (task)")
def mean_tokens(spark, d):
    planned = spark.createDataFrame([("classify", 7), ("synthesize", 3), ("merge", 5)], "task string, planned long")
    return ledger.mean_tokens(model_calls(spark, d), planned).withColumn("mean_tokens", F.round("mean_tokens", 6))


@query(f"WITH {CALLS} SELECT id, session_id, task, outcome, model FROM calls WHERE task = 'classify' AND (called_at, id) < (TIMESTAMP '2024-01-20 00:00:00', 5000) ORDER BY called_at DESC, id DESC LIMIT 25")
def calls_page(spark, d):
    return ledger.calls_page(model_calls(spark, d), 25, ("2024-01-20 00:00:00", 5000), task="classify").select("id", "session_id", "task", "outcome", "model")


@query("SELECT (SELECT count(*) FROM logs) AS logs, (SELECT count(*) FROM memories) AS memories, (SELECT count(*) FROM injections) AS injections, (SELECT count(*) FROM memories WHERE superseded_by IS NULL AND ended_at IS NULL) AS live")
def metrics_gauges(spark, d):
    m = table(spark, d, "memories")
    return ledger.gauges(logs=table(spark, d, "logs"), memories=m, injections=table(spark, d, "injections"), live=m.where(memory.live()))


@query(f"WITH {CALLS} SELECT 'model_calls_total{{task=\"' || task || '\"}} ' || count(*) AS line FROM calls GROUP BY task")
def metrics_lines(spark, d):
    counted = model_calls(spark, d).groupBy("task").agg(F.count("*").alias("value"))
    return ledger.exposition(counted, "model_calls_total", "task")


@query(f"WITH {CALLS} SELECT task, count(*) AS n FROM calls GROUP BY task")
def calls_by_task(spark, d):
    return model_calls(spark, d).groupBy("task").agg(F.count("*").alias("n"))


@query(f"WITH {CALLS} SELECT session_id, task, outcome, id FROM (SELECT *, row_number() OVER (PARTITION BY session_id, task ORDER BY called_at DESC, id DESC) AS nth FROM calls) WHERE nth = 1")
def latest_call(spark, d):
    return ledger.latest(model_calls(spark, d), ["session_id", "task"], "called_at").select("session_id", "task", "outcome", "id")


_ATTEMPTS = f"""{CALLS}, seen AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY called_at DESC, id DESC) AS nth FROM calls WHERE called_at >= TIMESTAMP '2024-01-03' AND session_id IS NOT NULL),
failing AS (SELECT session_id, CAST(count(*) FILTER (outcome = 'error') AS BIGINT) AS attempts FROM seen GROUP BY session_id HAVING max(outcome) FILTER (nth = 1) = 'error')"""


@query(f"WITH {_ATTEMPTS} SELECT session_id, attempts, attempts < 12 AS ready FROM failing")
def sweep_attempts(spark, d):
    return ledger.attempts(model_calls(spark, d), ["session_id"], at("2024-01-03"), 12).select("session_id", "attempts", "ready")


@query(f"WITH {_ATTEMPTS} SELECT attempts < 12 AS ready, count(*) AS n FROM failing GROUP BY 1")
def sweep_cap_split(spark, d):
    return ledger.attempts(model_calls(spark, d), ["session_id"], at("2024-01-03"), 12).groupBy("ready").agg(F.count("*").alias("n"))


@query(f"WITH {PROMPTS} SELECT id FROM prompts p WHERE session_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM memories m WHERE m.session_id = p.session_id AND m.entry_id = p.entry_id)")
def sweep_unread(spark, d):
    """Prompts that no statement was written from."""
    return record.backlog(record.prompts(logs(spark, d)).where("session_id is not null"), table(spark, d, "memories"), ["session_id", "entry_id"]).select("id")


_FIRING = " OR ".join(f"{k} >= {memory.KINDS[k][3]}" for k in SCORES)


@query(f"WITH {READINGS} SELECT id FROM readings r WHERE ({_FIRING}) AND NOT EXISTS (SELECT 1 FROM memories m WHERE m.session_id = r.session_id AND m.entry_id = r.entry_id) ORDER BY occurred_at NULLS LAST, received_at, id LIMIT 200")
def worth_writing(spark, d):
    """Readings over some threshold that nothing was written from, oldest message first."""
    rows = readings(spark, d)
    over = rows.where(F.size(memory.firing({k: F.col(k) for k in SCORES})) > 0)
    return record.backlog(over, table(spark, d, "memories"), ["session_id", "entry_id"]).orderBy(F.asc_nulls_last("occurred_at"), "received_at", "id").limit(200).select("id")


@query(f"WITH {READINGS} SELECT id, preference FROM readings WHERE preference >= 0.9 ORDER BY preference DESC, id LIMIT 50")
def classified_above(spark, d):
    return readings(spark, d).where(F.col("preference") >= 0.9).orderBy(F.desc("preference"), "id").limit(50).select("id", "preference")


@query(f"WITH {READINGS} SELECT id, CASE greatest({', '.join(SCORES)}) " + " ".join(f"WHEN {k} THEN '{k}'" for k in SCORES) + " END AS kind FROM readings")
def best_kind(spark, d):
    return readings(spark, d).select("id", memory.best_kind({k: F.col(k) for k in SCORES}).alias("kind"))


@query(f"WITH {READINGS} SELECT id, concat_ws(',', " + ", ".join(f"CASE WHEN {k} >= {memory.KINDS[k][3]} THEN '{k}' END" for k in SCORES) + ") AS kinds FROM readings")
def firing_kinds(spark, d):
    return readings(spark, d).select("id", F.array_join(memory.firing({k: F.col(k) for k in SCORES}), ",").alias("kinds"))


@query(f"WITH {READINGS} SELECT count(*) FILTER ({' AND '.join(f'{k} < 0.5' for k in SCORES)}) AS empty, count(*) FILTER (correction >= 0.7) AS pushes_back FROM readings")
def readings_empty(spark, d):
    empty = F.lit(True)
    for k in SCORES:
        empty = empty & (F.col(k) < 0.5)
    return readings(spark, d).agg(F.count_if(empty).alias("empty"), F.count_if(F.col("correction") >= 0.7).alias("pushes_back"))


@query(f"WITH {CALLS}, edge(e) AS (VALUES (1.0), (10.0), (100.0), (NULL)) SELECT task, CAST(e AS DOUBLE) AS edge, CAST(count(*) FILTER (e IS NULL OR output_tokens <= e) AS BIGINT) AS at_most FROM calls, edge GROUP BY ALL")
def latency_histogram(spark, d):
    return ledger.histogram(model_calls(spark, d), "task", "output_tokens", [1, 10, 100])


@query(f"WITH {CALLS} SELECT k, count(*) AS n FROM calls GROUP BY k")
def calls_json_field(spark, d):
    return model_calls(spark, d).groupBy("k").agg(F.count("*").alias("n"))


@query(f"WITH {LOGS} SELECT id, left(body, 200) AS summary FROM first_logs WHERE kind = 'prompt' AND harness = 'loom' ORDER BY occurred_at DESC NULLS LAST, id DESC LIMIT 30")
def records_recent(spark, d):
    from quern.operators import panes

    rows = panes.first_arrivals(table(spark, d, "logs"), "occurred_at", "kind", "harness", "body").where("kind = 'prompt' and harness = 'loom'")
    return rows.orderBy(F.desc_nulls_last("occurred_at"), F.desc("id")).limit(30).select("id", F.left("body", F.lit(200)).alias("summary"))


@query("SELECT attributes['gen_ai.agent.version'] AS version, count(*) AS n FROM logs GROUP BY 1")
def records_attribute(spark, d):
    return table(spark, d, "logs").groupBy(F.try_element_at("attributes", F.lit("gen_ai.agent.version")).alias("version")).agg(F.count("*").alias("n"))


@query(f"WITH {LOGS} SELECT id, {NOISE} AS noise FROM first_logs WHERE kind = 'prompt'")
def noise_flags(spark, d):
    from quern.functions import text

    return logs(spark, d).where("kind = 'prompt'").select("id", text.noise(F.col("body")).alias("noise"))


@query(f"WITH {PROMPTS} SELECT id FROM prompts WHERE occurred_at >= TIMESTAMPTZ '2024-01-03 00:00:00+00' AND occurred_at < TIMESTAMPTZ '2024-01-06 00:00:00+00' ORDER BY occurred_at, id LIMIT 100")
def readable_prompts(spark, d):
    rows = record.prompts(logs(spark, d)).where((F.col("occurred_at") >= at("2024-01-03")) & (F.col("occurred_at") < at("2024-01-06")))
    return rows.orderBy("occurred_at", "id").limit(100).select("id")
