"""Queries of the general training-data problems: hierarchies (1) and late events (5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import forest, panes
from quern.sources.store import Store
from quern.streaming import ingest
from quern.tables import own_path, streamed, table


def _links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "memories").select("id", "superseded_by")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = forest.hierarchy(_links(spark, d)).where("parent is not null")
    return found.select(F.col("id").alias("memory_id"), F.col("root").alias("root_id"), "depth")


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    found = forest.open_hierarchy(_links(spark, d))
    return found.select(F.col("id").alias("memory_id"), F.col("root").alias("root_id"), "depth", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    found = forest.descendants(forest.open_hierarchy(_links(spark, d)))
    return found.select(F.col("ancestor").alias("memory_id"), F.col("descendant").alias("retired_id"), "steps")


def p1_circles(spark: SparkSession, d: str) -> DataFrame:
    found = forest.circles(_links(spark, d))
    return found.select(F.col("root").alias("root_id"), "length", F.array_join(F.col("members").cast("array<string>"), "/").alias("members"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    logs = table(spark, d, "logs").where("session_id is not null").select("id", "session_id", "entry_id", "received_at", "occurred_at")
    return panes.first_arrivals(logs, "occurred_at")


def _windows(spark: SparkSession, d: str, size: int) -> DataFrame:
    """The last counts of each window of that size every hour, as pane_stream emits them over the record."""
    logs = streamed(spark, f"{d}/logs.parquet", ["id", "session_id", "entry_id", "received_at", "occurred_at"]).where("session_id is not null")
    held = Store(spark, own_path(spark, "panes"))
    ingest.pane_stream(logs, ["session_id"], held, "windows", f"{held.root}/checkpoint", size=size, slide=panes.HOUR).awaitTermination()
    return ingest.last_windows(held, "windows", ["session_id"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Hours that a late record changed: windows of one pane."""
    return _windows(spark, d, panes.HOUR).where("late > 0").select("session_id", F.col("window_start").alias("hour_epoch"))


def p5_panes(spark: SparkSession, d: str) -> DataFrame:
    return panes.panes(_records(spark, d), ["session_id"]).select("session_id", F.col("pane").alias("hour_epoch"), "on_time", "late", "dropped")


def p5_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of three hours every hour, composed of the hour panes."""
    found = _windows(spark, d, 3 * panes.HOUR)
    return found.select("session_id", "window_start", (F.col("records") - F.col("late")).alias("on_time"), "late", "dropped")


def p5_revisions(spark: SparkSession, d: str) -> DataFrame:
    return panes.revisions(_records(spark, d), ["session_id"]).withColumnRenamed("pane", "hour_epoch")


FIRST_ARRIVALS = """first_arrival AS (
  SELECT session_id, entry_id, id, received_at, occurred_at FROM (
    SELECT *, row_number() OVER (PARTITION BY session_id, entry_id ORDER BY received_at NULLS LAST, id) AS nth
    FROM logs WHERE session_id IS NOT NULL AND entry_id IS NOT NULL) WHERE nth = 1
  UNION ALL SELECT session_id, entry_id, id, received_at, occurred_at FROM logs WHERE session_id IS NOT NULL AND entry_id IS NULL),
placed AS (
  SELECT session_id, received_at, CAST(epoch_us(occurred_at) - (((epoch_us(occurred_at) % 3600000000) + 3600000000) % 3600000000) AS BIGINT) // 1000000 AS pane
  FROM first_arrival WHERE occurred_at IS NOT NULL),
timed AS (SELECT session_id, pane, epoch_us(received_at) - (pane + 3600) * 1000000 AS behind FROM placed),
pane_counts AS (
  SELECT session_id, pane,
    CAST(count(*) FILTER (behind IS NULL OR behind <= 300000000) AS BIGINT) AS on_time,
    CAST(count(*) FILTER (behind > 300000000 AND behind <= 86400000000) AS BIGINT) AS late,
    CAST(count(*) FILTER (behind > 86400000000) AS BIGINT) AS dropped
  FROM timed GROUP BY session_id, pane)"""

WALK = """RECURSIVE ids AS (SELECT DISTINCT id FROM memories),
link AS (SELECT m.id, CASE WHEN p.id IS NULL THEN NULL ELSE m.superseded_by END AS parent, m.superseded_by FROM memories m LEFT JOIN ids p ON p.id = m.superseded_by),
walk(id, place, depth, path) AS (
  SELECT id, id, CAST(0 AS BIGINT), [id] FROM link
  UNION ALL
  SELECT w.id, l.parent, w.depth + 1, list_append(w.path, l.parent) FROM walk w JOIN link l ON l.id = w.place
  WHERE l.parent IS NOT NULL AND NOT list_contains(w.path, l.parent)),
ending AS (SELECT id, place, depth, path FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY depth DESC) AS nth FROM walk) WHERE nth = 1),
ended AS (
  SELECT e.id AS memory_id, e.place, l.parent AS again, e.path,
    CASE WHEN l.parent IS NULL THEN e.place ELSE list_min(list_slice(e.path, list_position(e.path, l.parent), len(e.path))) END AS root_id,
    CASE WHEN l.parent IS NULL THEN e.depth ELSE -1 END AS depth
  FROM ending e JOIN link l ON l.id = e.place)"""

QUERIES = {f.__name__: f for f in (p1_found, p1_paths, p1_descendants, p1_circles, p5_found, p5_panes, p5_windows, p5_revisions)}
SQL = {
    "p1_found": f"WITH {WALK} SELECT memory_id, CAST(root_id AS BIGINT) AS root_id, CAST(depth AS BIGINT) AS depth FROM ended WHERE memory_id IN (SELECT id FROM memories WHERE superseded_by IS NOT NULL)",
    "p1_paths": f"WITH {WALK} SELECT memory_id, CAST(root_id AS BIGINT) AS root_id, CAST(depth AS BIGINT) AS depth, array_to_string(list_slice(path, 1, list_position(path, root_id)), '/') AS path FROM ended",
    "p1_descendants": f"WITH {WALK} SELECT w.place AS memory_id, w.id AS retired_id, w.depth AS steps FROM walk w WHERE w.depth > 0",
    "p1_circles": f"WITH {WALK} SELECT root_id, CAST(len(path) AS BIGINT) AS length, array_to_string(path, '/') AS members FROM ended WHERE depth = -1 AND memory_id = root_id",
    "p5_found": f"WITH {FIRST_ARRIVALS} SELECT session_id, pane AS hour_epoch FROM pane_counts WHERE late > 0",
    "p5_panes": f"WITH {FIRST_ARRIVALS} SELECT session_id, pane AS hour_epoch, on_time, late, dropped FROM pane_counts",
    "p5_revisions": f"""WITH {FIRST_ARRIVALS}, told AS (SELECT session_id, pane, behind, pane + 3900 AS closes, behind / 1000000.0 + pane + 3600 AS arrived FROM timed WHERE behind IS NULL OR behind <= 86400000000),
      changes AS (SELECT session_id, pane, CASE WHEN behind IS NULL OR behind <= 300000000 THEN closes ELSE closes + CAST(ceil((ceil(arrived) - closes) / 3600.0) AS BIGINT) * 3600 END AS emitted_at, count(*) AS changed FROM told GROUP BY ALL)
      SELECT session_id, pane AS hour_epoch, emitted_at, CAST(sum(changed) OVER (PARTITION BY session_id, pane ORDER BY emitted_at) AS BIGINT) AS records FROM changes""",
    "p5_windows": f"WITH {FIRST_ARRIVALS} SELECT session_id, pane - back AS window_start, CAST(sum(on_time) AS BIGINT) AS on_time, CAST(sum(late) AS BIGINT) AS late, CAST(sum(dropped) AS BIGINT) AS dropped FROM pane_counts, (VALUES (0), (3600), (7200)) AS v(back) GROUP BY ALL",
}
