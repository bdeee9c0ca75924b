"""Queries of the training-data problems tagged llm, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import conversations, cutoffs, neighbours, packing, pii, sampling, spans, tokens
from quern.tables import cut, table


def p2_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    return cutoffs.cutoffs(table(spark, d, "memories"), table(spark, d, "kind_targets"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "memories").select("id", "kind", "score")
    return cutoffs.kept(rows, cutoffs.cutoffs(rows, table(spark, d, "kind_targets"))).select(F.col("id").alias("memory_id"))


def _plan(spark: SparkSession, d: str, usable: DataFrame | None = None) -> DataFrame:
    usable = sampling.usable_pairs(table(spark, d, "pairs")) if usable is None else usable
    return sampling.allocation(cut(sampling.strata_of(usable), "strata"), table(spark, d, "sample_targets"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d).where("short > 0").select("form", "kind", "scoped")


def p3_allocation(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d)


def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    usable = cut(sampling.usable_pairs(table(spark, d, "pairs")), "usable")
    return sampling.drawn_of(usable, cut(_plan(spark, d, usable), "plan"))


def p4_similar(spark: SparkSession, d: str) -> DataFrame:
    found = neighbours.nearest(table(spark, d, "memories"))
    return found.select(F.col("id").alias("memory_id"), F.col("other").alias("other_id"), F.round("cosine", 6).alias("cosine"), "place")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.close_pairs(neighbours.similar(table(spark, d, "memories")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.sessions(conversations.emitted(spark, f"{d}/logs.parquet")).where("reason <> ''").select("session_id")


def p6_sessions(spark: SparkSession, d: str) -> DataFrame:
    return conversations.sessions(conversations.emitted(spark, f"{d}/logs.parquet"))


def p6_conversations(spark: SparkSession, d: str) -> DataFrame:
    found = cut(conversations.emitted(spark, f"{d}/logs.parquet"), "emitted")
    return conversations.conversations(found, table(spark, d, "logs")).select("session_id", "turn", "role", "log_id", "body")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = pii.found(table(spark, d, "logs"), table(spark, d, "name_parts"))
    return found.select("log_id", "pii_type", "span_start")


def p7_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(table(spark, d, "logs"), table(spark, d, "name_parts")).withColumnRenamed("id", "log_id")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encoded(table(spark, d, "documents"))


USABLE = """usable AS (SELECT m.id, m.kind, CAST(m.score AS DOUBLE) AS value FROM memories m WHERE m.score >= 0 AND m.score <= 1 AND NOT isnan(m.score)),
goal AS (SELECT kind, max(keep_permille) AS keep FROM kind_targets WHERE kind IS NOT NULL AND keep_permille IS NOT NULL GROUP BY kind),
sized AS (SELECT kind, count(*) AS n FROM usable GROUP BY kind),
level AS (SELECT kind, value, count(*) AS ties FROM usable GROUP BY kind, value),
reach AS (SELECT kind, value, ties, sum(ties) OVER (PARTITION BY kind ORDER BY value DESC) AS kept FROM level),
best AS (SELECT r.kind, max(value) AS cutoff FROM reach r JOIN goal g ON g.kind = r.kind JOIN sized s ON s.kind = r.kind WHERE 1000 * kept >= g.keep * s.n GROUP BY r.kind)"""
SPACE = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || ' '"
LEAVES = f"""usable AS (
  SELECT pair_id, lower(trim(form, {SPACE})) AS form, lower(trim(kind, {SPACE})) AS kind, CASE WHEN scope_key IS NOT NULL AND trim(scope_key, {SPACE}) <> '' THEN 1 ELSE 0 END AS scoped,
    row_number() OVER (PARTITION BY session_id, entry_id, memory_id ORDER BY pair_id) AS nth
  FROM pairs WHERE entry_id IS NOT NULL AND form IS NOT NULL AND kind IS NOT NULL),
leaf AS (SELECT form, kind, scoped, count(*) AS available FROM usable WHERE nth = 1 GROUP BY ALL),
quotas AS (
  SELECT t.form, t.kind, t.scoped, CAST(greatest(t.minimum, (t.share_permille * ((SELECT count(*) FROM usable WHERE nth = 1) // 5)) // 1000) AS BIGINT) AS quota, coalesce(l.available, 0) AS available
  FROM sample_targets t LEFT JOIN leaf l ON l.form = t.form AND l.kind = t.kind AND l.scoped = t.scoped)"""



def _passed_on(source: str, name: str, within: str) -> str:
    """SQL of one step of passing unmet quota on, from the table source to the table name, in column name."""
    part = f"PARTITION BY {within}" if within else ""
    along = f"OVER ({part} ORDER BY form, kind, scoped ROWS UNBOUNDED PRECEDING)"
    return f"""{name}_a AS (SELECT *, available - taken AS room, least(sum(unmet) OVER ({part}), sum(available - taken) OVER ({part})) AS moved, sum(available - taken) OVER ({part}) AS space FROM {source}),
{name}_b AS (SELECT *, CASE WHEN space > 0 THEN moved * room // space ELSE 0 END AS share FROM {name}_a),
{name}_c AS (SELECT *, moved - sum(share) OVER ({part}) AS rest, room - share AS spare FROM {name}_b),
{name}_d AS (SELECT *, share + greatest(least(rest - (sum(spare) {along} - spare), spare), 0) AS {name}, greatest(least(moved - (sum(unmet) {along} - unmet), unmet), 0) AS settled FROM {name}_c),
{name}_e AS (SELECT * EXCLUDE (room, moved, space, share, rest, spare, settled, unmet, taken), unmet - settled AS unmet, taken + {name} AS taken FROM {name}_d)"""


NEAREST = """vec AS (SELECT id, embedding_model, kind, scope_key, CAST(embedding AS DOUBLE[]) AS e FROM memories WHERE embedding IS NOT NULL AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
compared AS (
  SELECT a.id AS x, b.id AS y, list_cosine_similarity(a.e, b.e) AS cosine FROM vec a JOIN vec b
  ON a.embedding_model = b.embedding_model AND a.kind = b.kind AND (a.scope_key = b.scope_key OR a.scope_key IS NULL OR b.scope_key IS NULL) AND a.id <> b.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY cosine DESC, y) AS place FROM compared)"""

def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents")).where("piece > 0").select("doc_id").distinct()


def p9_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(packing.packed(table(spark, d, "documents")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared(table(spark, d, "documents")).select("doc_id", "shared_chars")


def p10_spans(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared(table(spark, d, "documents"))


WHITE = "'[ \\t\\n\\r\\f\\v\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+'"
TALK = f"""arrival AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, entry_id ORDER BY received_at NULLS LAST, id) AS nth FROM logs WHERE session_id IS NOT NULL AND entry_id IS NOT NULL) WHERE nth = 1
  UNION ALL SELECT *, 1 FROM logs WHERE session_id IS NOT NULL AND entry_id IS NULL),
message AS (
  SELECT session_id, id, occurred_at, CASE actor WHEN 'human' THEN 'user' WHEN 'agent' THEN 'assistant' WHEN 'system' THEN 'system' END AS role, body
  FROM arrival WHERE kind IN ('prompt', 'response', 'system') AND coalesce(actor_depth, 0) = 0 AND body IS NOT NULL AND regexp_replace(body, {WHITE}, '', 'g') <> ''),
talk AS (
  SELECT session_id, role, row_number() OVER w AS nth, lead(role) OVER w AS next FROM message WHERE role IS NULL OR role <> 'system'
  WINDOW w AS (PARTITION BY session_id ORDER BY occurred_at NULLS FIRST, id)),
verdict AS (
  SELECT s.session_id, coalesce(m.messages, 0) AS messages,
    CASE WHEN m.missing > 0 THEN 'actor or time missing' WHEN coalesce(m.users, 0) = 0 THEN 'no user' WHEN m.assistants = 0 THEN 'no assistant'
      WHEN t.start THEN 'does not start with the user' WHEN t.unanswered THEN 'user without reply' ELSE '' END AS reason
  FROM (SELECT DISTINCT session_id FROM logs WHERE session_id IS NOT NULL) s
  LEFT JOIN (SELECT session_id, count(*) AS messages, count(*) FILTER (role IS NULL OR occurred_at IS NULL) AS missing, count(*) FILTER (role = 'user') AS users, count(*) FILTER (role = 'assistant') AS assistants FROM message GROUP BY 1) m ON m.session_id = s.session_id
  LEFT JOIN (SELECT session_id, bool_or(nth = 1 AND role <> 'user') AS start, bool_or(role = 'user' AND (next IS NULL OR next = 'user')) AS unanswered FROM talk GROUP BY 1) t ON t.session_id = s.session_id)"""

QUERIES = {f.__name__: f for f in (p2_found, p2_cutoffs, p3_found, p3_allocation, p3_sample, p4_found, p4_similar, p6_found, p6_sessions, p6_conversations, p7_found, p7_redacted, p8_ids, p9_found, p9_packing, p9_containers, p10_found, p10_spans)}
SQL = {
    "p2_found": f"WITH {USABLE} SELECT u.id AS memory_id FROM usable u JOIN best b ON b.kind = u.kind WHERE u.value >= b.cutoff",
    "p2_cutoffs": f"""WITH {USABLE} SELECT g.kind, CAST(g.keep AS BIGINT) AS keep_permille, coalesce(s.n, 0) AS n, b.cutoff, CAST(coalesce(r.kept, 0) AS BIGINT) AS kept, coalesce(r.ties, 0) AS ties
      FROM goal g LEFT JOIN sized s ON s.kind = g.kind LEFT JOIN best b ON b.kind = g.kind LEFT JOIN reach r ON r.kind = g.kind AND r.value = b.cutoff""",
    "p4_found": f"WITH {NEAREST} SELECT DISTINCT least(x, y) AS memory_id_a, greatest(x, y) AS memory_id_b FROM ranked WHERE place <= 10 AND cosine >= 0.8",
    "p4_similar": f"WITH {NEAREST} SELECT x AS memory_id, y AS other_id, round(cosine, 6) AS cosine, place FROM ranked WHERE place <= 10",
    "p6_found": f"WITH {TALK} SELECT session_id FROM verdict WHERE reason <> ''",
    "p6_sessions": f"WITH {TALK} SELECT session_id, reason, messages FROM verdict",
    "p6_conversations": f"WITH {TALK} SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY occurred_at, id) AS turn, role, id AS log_id, body FROM message WHERE session_id IN (SELECT session_id FROM verdict WHERE reason = '')",
    "p3_allocation": f"""WITH {LEAVES}, start AS (SELECT *, least(quota, available) AS own, least(quota, available) AS taken, quota - least(quota, available) AS unmet FROM quotas),
      {_passed_on('start', 'from_siblings', 'form, kind')}, {_passed_on('from_siblings_e', 'from_cousins', 'form')}, {_passed_on('from_cousins_e', 'from_others', '')}
      SELECT form, kind, scoped, quota, available, own, CAST(from_siblings AS BIGINT) AS from_siblings, CAST(from_cousins AS BIGINT) AS from_cousins, CAST(from_others AS BIGINT) AS from_others, CAST(taken AS BIGINT) AS take, greatest(quota - available, 0) AS short FROM from_others_e""",
    "p3_found": f"WITH {LEAVES} SELECT form, kind, scoped FROM quotas WHERE available < quota",
}
