"""Views of the test tables that stand for tables they lack, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text
from quern.functions.memory import KINDS
from quern.operators import panes
from quern.tables import table

#: The moment that queries take for now, and one in the past.
NOW, THEN = "2024-03-01 00:00:00", "2024-01-08 00:00:00"
SCORES = {k: p for k, p in zip(KINDS, (7, 13, 19, 29, 37, 43))}


def at(moment: str):
    return F.lit(moment).cast("timestamp")


def model_calls(spark: SparkSession, d: str) -> DataFrame:
    """Events as calls of a model."""
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("called_at"),
        F.col("user_id").alias("session_id"),
        F.when(F.col("event_type").isin("signup", "purchase"), "synthesize").otherwise("classify").alias("task"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("outcome"),
        F.concat(F.lit("run-"), (F.col("user_id") % 3).cast("string")).alias("run"),
        F.when(F.col("user_id") % 4 != 0, F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string"))).alias("model"),
        F.floor(F.col("value") * 10).cast("long").alias("input_tokens"),
        F.floor("value").cast("long").alias("output_tokens"),
        F.get_json_object("props", "$.k").try_cast("bigint").alias("k"),
    )


CALLS = """calls AS (SELECT event_id AS id, ts AS called_at, user_id AS session_id, CASE WHEN event_type IN ('signup', 'purchase') THEN 'synthesize' ELSE 'classify' END AS task,
  CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS outcome, 'run-' || (user_id % 3) AS run, CASE WHEN user_id % 4 <> 0 THEN 'm' || (user_id % 4) END AS model,
  CAST(floor(value * 10) AS BIGINT) AS input_tokens, CAST(floor(value) AS BIGINT) AS output_tokens, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


def logs(spark: SparkSession, d: str) -> DataFrame:
    """First arrivals of the record, with the columns most queries read."""
    carried = ["occurred_at", "actor", "actor_depth", "kind", "scope_key", "body"]
    return panes.first_arrivals(table(spark, d, "logs"), *carried)


LOGS = """first_logs AS (
  SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY session_id, entry_id ORDER BY received_at NULLS LAST, id) AS nth FROM logs WHERE session_id IS NOT NULL AND entry_id IS NOT NULL) WHERE nth = 1
  UNION ALL SELECT * FROM logs WHERE session_id IS NULL OR entry_id IS NULL)"""

SPACES = "chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"
_OPEN = " OR ".join("starts_with(ltrim(body, {sp}), '{o}')".format(sp=SPACES, o=o.replace("'", "''")) for o in text.NOISE_OPENINGS)
NOISE = f"({_OPEN} OR regexp_full_match(body, '[ \\t\\n\\r\\f\\v]*(/[\\w:.-]+|(\\[Image[^\\]]*\\][ \\t\\n\\r\\f\\v]*)+)[ \\t\\n\\r\\f\\v]*'))"
PROMPTS = f"{LOGS}, prompts AS (SELECT * FROM first_logs WHERE kind = 'prompt' AND entry_id IS NOT NULL AND occurred_at IS NOT NULL AND NOT {NOISE})"


def readings(spark: SparkSession, d: str) -> DataFrame:
    """Every prompt scored on the kinds by rule."""
    from quern.operators import record

    rows = record.prompts(logs(spark, d)).where("session_id is not null")
    return rows.select("id", "session_id", "entry_id", "scope_key", "occurred_at", "received_at", *[((F.col("id") * p) % 1000 / F.lit(1000.0)).alias(k) for k, p in SCORES.items()])


READINGS = f"{PROMPTS}, readings AS (SELECT id, session_id, entry_id, scope_key, occurred_at, received_at, " + ", ".join(f"((id * {p}) % 1000) / 1000.0::DOUBLE AS {k}" for k, p in SCORES.items()) + " FROM prompts WHERE session_id IS NOT NULL)"


def labels(spark: SparkSession, d: str) -> DataFrame:
    """Label events: two on some pairs, the later one counting."""
    p = table(spark, d, "pairs").where("session_id is not null and entry_id is not null and memory_id is not null and pair_id % 4 <> 0")
    return p.select("session_id", "entry_id", "memory_id", F.col("pair_id").alias("id"), F.col("injected_at").alias("labelled_at"), F.element_at(F.array(F.lit("good"), F.lit("noise"), F.lit("wrong")), (F.col("pair_id") % 3 + 1).cast("int")).alias("label"))


LABELS = "labels AS (SELECT session_id, entry_id, memory_id, pair_id AS id, injected_at AS labelled_at, CASE pair_id % 3 WHEN 0 THEN 'good' WHEN 1 THEN 'noise' ELSE 'wrong' END AS label FROM pairs WHERE session_id IS NOT NULL AND entry_id IS NOT NULL AND memory_id IS NOT NULL AND pair_id % 4 <> 0)"
WORTH_CASES = [" ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in KINDS.items()) for i in range(3)]
NOW_SQL, THEN_SQL = f"TIMESTAMPTZ '{NOW}+00'", f"TIMESTAMPTZ '{THEN}+00'"
AGE = f"greatest((epoch_us({NOW_SQL}) - epoch_us(coalesce(said_at, created_at))) / 86400000000.0::DOUBLE, 0.0)"
WORTH = f"((CASE kind {WORTH_CASES[0]} ELSE 0.1 END)::DOUBLE * ((CASE kind {WORTH_CASES[2]} ELSE 0.0 END)::DOUBLE + (1 - (CASE kind {WORTH_CASES[2]} ELSE 0.0 END)::DOUBLE) * pow(0.5::DOUBLE, {AGE} / (CASE kind {WORTH_CASES[1]} ELSE 90.0 END)::DOUBLE)))"
