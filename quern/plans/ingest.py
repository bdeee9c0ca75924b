"""Queries that write the record out as exports and transcripts and read it back, and places of work."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import scope, text
from quern.operators import recall, record
from quern.plans.registry import query
from quern.plans.views import LOGS, PROMPTS, logs
from quern.sources import otlp, transcripts
from quern.tables import table


def _exports(spark, d):
    """Each record of the table as an export of its own."""
    text_of = lambda c: F.struct(F.col(c).cast("string").alias("stringValue"))
    pair = lambda k, c: F.struct(F.lit(k).alias("key"), text_of(c).alias("value"))
    attributes = F.array(pair("session.id", "session_id"), pair("memory.entry.id", "entry_id"), pair("memory.kind", "kind"), pair("gen_ai.usage.input_tokens", "input_tokens"), pair("memory.cost.total", "cost_total"))
    one = F.struct((F.unix_micros("occurred_at").cast("decimal(38,0)") * 1000).cast("string").alias("timeUnixNano"), F.col("severity").alias("severityText"), text_of("body").alias("body"), attributes.alias("attributes"))
    scoped = F.struct(F.struct(F.lit("s").alias("name")).alias("scope"), F.array(one).alias("logRecords"))
    whole = F.struct(F.array(F.struct(F.struct(F.array(pair("host.name", "machine")).alias("attributes")).alias("resource"), F.array(scoped).alias("scopeLogs"))).alias("resourceLogs"))
    return table(spark, d, "logs").select(F.col("id").alias("export_id"), "received_at", F.to_json(whole).alias("export"))


@query(f"WITH {LOGS} SELECT session_id, entry_id, kind, body, machine, CAST(epoch_us(occurred_at) AS BIGINT) AS occurred, input_tokens, severity FROM first_logs")
def otlp_round_trip(spark, d):
    rows = otlp.rebuild(_exports(spark, d))
    return rows.select("session_id", "entry_id", "kind", "body", "machine", F.unix_micros("occurred_at").alias("occurred"), "input_tokens", "severity")


@query(f"WITH {LOGS} SELECT count(*) AS records, count(DISTINCT machine) AS machines FROM first_logs")
def otlp_rebuild_count(spark, d):
    return otlp.rebuild(_exports(spark, d)).agg(F.count("*").alias("records"), F.countDistinct("resource_fingerprint").alias("fingerprints"), F.countDistinct("machine").alias("machines")).select("records", "machines")


@query(f"WITH {LOGS} SELECT session_id, entry_id || ':' || kind AS entry_id, CASE kind WHEN 'prompt' THEN 'human' ELSE 'agent' END AS actor, kind, coalesce(body, '') AS body, CAST(epoch_us(occurred_at) AS BIGINT) AS occurred FROM first_logs WHERE kind IN ('prompt', 'response') AND session_id IS NOT NULL AND entry_id IS NOT NULL")
def transcript_round_trip(spark, d):
    """The spoken rows written as session files and read by the reader of such files."""
    from quern.operators import panes

    rows = panes.first_arrivals(table(spark, d, "logs"), "occurred_at", "kind", "body").where("kind in ('prompt', 'response') and session_id is not null and entry_id is not null")
    message = F.struct(F.when(F.col("kind") == "prompt", "user").otherwise("assistant").alias("role"), F.coalesce("body", F.lit("")).alias("content"), (F.unix_micros("occurred_at") / 1000).alias("timestamp"))
    lines = rows.select(F.concat("session_id", F.lit(".jsonl")).alias("file"), F.lit(1).cast("long").alias("block"), F.col("id").alias("seq"), F.to_json(F.struct(F.lit("message").alias("type"), F.col("entry_id").alias("id"), message.alias("message"))).alias("value"))
    heads = rows.select("session_id").distinct().select(F.concat("session_id", F.lit(".jsonl")).alias("file"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("seq"), F.to_json(F.struct(F.lit("session").alias("type"), F.col("session_id").alias("id"))).alias("value"))
    read = transcripts.read("pi", heads.unionByName(lines))
    return read.select("session_id", "entry_id", "actor", "kind", "body", F.unix_micros("occurred_at").alias("occurred"))


@query(f"WITH {PROMPTS} SELECT id, len(regexp_extract_all(body, '[^\\s\\v\\p{{Z}}\\x{{85}}]+')) <= 12 AS short FROM prompts")
def short_prompts(spark, d):
    return record.prompts(logs(spark, d)).select("id", text.short_prompt(F.col("body")).alias("short"))


@query()
def scope_of_directories(spark, d):
    rows = table(spark, d, "logs").where("working_directory is not null")
    dirs = rows.groupBy(F.col("working_directory").alias("path")).agg(F.max(F.col("repository").isNotNull()).alias("is_repository"))
    return scope.scope_of(dirs.select("path", F.lit("/srv").alias("home")), dirs)


@query("SELECT concat_ws(chr(9), session_id, CAST(id AS VARCHAR), coalesce(form, 'match'), CAST(m AS VARCHAR)) AS line FROM (SELECT *, unnest(memory_ids) AS m FROM injections) WHERE session_id IS NOT NULL")
def handed_lines(spark, d):
    rows = table(spark, d, "injections").where("session_id is not null").select("session_id", F.col("id").alias("prompt_id"), F.coalesce("form", F.lit("match")).alias("form"), "memory_ids")
    return recall.handed_lines(rows)


@query("SELECT id, body FROM logs WHERE contains(body, 'rerun') AND harness = 'loom'")
def records_containing(spark, d):
    """An extension: records that hold a word."""
    return table(spark, d, "logs").where(F.col("body").contains("rerun") & (F.col("harness") == "loom")).select("id", "body")


@query("SELECT id, nullif(concat_ws(':', nullif(entry_id, ''), nullif(kind, ''), nullif(tool_name, '')), '') AS identity FROM logs")
def record_identity(spark, d):
    return table(spark, d, "logs").select("id", text.identity(F.col("entry_id"), F.col("kind"), F.col("tool_name")).alias("identity"))


@query("SELECT id, replace(body, chr(0), chr(65533)) AS body FROM logs WHERE kind = 'system'")
def clean_bodies(spark, d):
    return table(spark, d, "logs").where("kind = 'system'").select("id", text.clean_nul(F.col("body")).alias("body"))


@query("SELECT id FROM logs WHERE occurred_at >= TIMESTAMPTZ '2024-01-03 00:00:00+00' AND occurred_at < least(TIMESTAMPTZ '2024-01-09 00:00:00+00', TIMESTAMPTZ '2024-01-06 00:00:00+00') AND received_at <= TIMESTAMPTZ '2024-01-06 00:00:00+00'")
def records_as_of(spark, d):
    """A time range clipped by the moment of the reading: what had happened and had arrived by then."""
    at = lambda m: F.lit(m).cast("timestamp")
    seen = at("2024-01-06 00:00:00")
    return table(spark, d, "logs").where((F.col("occurred_at") >= at("2024-01-03 00:00:00")) & (F.col("occurred_at") < F.least(at("2024-01-09 00:00:00"), seen)) & (F.col("received_at") <= seen)).select("id")


@query("SELECT id, array_to_string(list_sort(list_distinct(list_concat(memory_ids, [1, 2, 3]))), ',') AS joined, len(list_filter(list_distinct(memory_ids), lambda x: x NOT IN (1, 2, 3))) AS rest FROM injections WHERE memory_ids IS NOT NULL")
def handed_sets(spark, d):
    few = F.array(*[F.lit(i).cast("long") for i in (1, 2, 3)])
    rows = table(spark, d, "injections").where("memory_ids is not null")
    return rows.select("id", F.array_join(F.array_sort(F.array_union("memory_ids", few)).cast("array<string>"), ",").alias("joined"), F.size(F.array_except("memory_ids", few)).cast("long").alias("rest"))


@query("WITH c AS (SELECT id, session_id, attributes['vcs.ref.head.name'] AS branch, received_at FROM logs WHERE attributes['vcs.ref.head.name'] IS NOT NULL AND session_id IS NOT NULL) SELECT session_id, first(branch ORDER BY received_at, id) AS first_branch, last(branch ORDER BY received_at, id) AS last_branch FROM c GROUP BY session_id")
def carried_forward(spark, d):
    """The first and the last branch that a session's records name."""
    branch = F.try_element_at("attributes", F.lit("vcs.ref.head.name"))
    rows = table(spark, d, "logs").where("session_id is not null").select("session_id", branch.alias("branch"), F.struct("received_at", "id").alias("at")).where("branch is not null")
    return rows.groupBy("session_id").agg(F.min_by("branch", "at").alias("first_branch"), F.max_by("branch", "at").alias("last_branch"))
