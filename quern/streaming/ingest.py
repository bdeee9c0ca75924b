"""Streaming forms: idempotent ingest, per-session seen sets, panes that are emitted again when late records change them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from quern.operators import panes
from quern.sources import otlp
from quern.sources.store import Store


def ingest(spark: SparkSession, landing: str, store: Store, checkpoint: str, *, namespace: str = "memory", trigger: dict | None = None):
    """Runs exports that land in a folder into the store; each record is stored once whatever is sent again.

    A micro-batch is de-duplicated and anti-joined with what is stored, with no horizon. If a batch is replayed after a
    failure its records are stored already. Returns the query.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = otlp.unpack(otlp.flatten(batch), namespace).withColumns({"received_at": F.current_timestamp(), "batch": F.lit(number).cast("long"), "n": F.monotonically_increasing_id()})
        stored = store.read("logs")
        fresh = otlp.new_rows(rows, None if stored is None else stored, ["session_id", "entry_id"], ["batch", "n"])
        if stored is not None:
            # a replayed batch: rows without a key are known by their batch number
            fresh = fresh.join(stored.select("batch").distinct(), "batch", "left_anti")
        resources = otlp.new_dimension(fresh, store.read("resources"), "resource_fingerprint", ["resource"])
        fresh.persist()
        store.append("resources", resources)
        store.append("logs", fresh.drop("resource"))
        fresh.unpersist()

    stream = otlp.exports(spark, landing, stream=True)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _seen(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    had = set(state.get[0]) if state.exists else set()
    rows = pd.concat(list(batches), ignore_index=True).sort_values(["occurred_at", "prompt_id"])
    out = []
    for prompt, found in zip(rows["prompt_id"], rows["found"]):
        fresh = [int(m) for m in (found if found is not None else []) if m not in had]
        had.update(fresh)
        out.append((key[0], int(prompt), fresh))
    state.update((sorted(had),))
    yield pd.DataFrame(out, columns=["session_id", "prompt_id", "memory_ids"])


def unseen_stream(turns: DataFrame) -> DataFrame:
    """(session_id, prompt_id, memory_ids): of each turn's found statements those its session was not handed before.

    turns is a stream with session_id, prompt_id, occurred_at, found. State is the set of a session's ids.
    """
    return turns.groupBy("session_id").applyInPandasWithState(_seen, "session_id string, prompt_id long, memory_ids array<long>", "seen array<long>", "append", GroupStateTimeout.NoTimeout)


PANE_ROW = "{keys}, entry_id string, received_at timestamp, id long, pane long, sign int, batch long, day int"
PANE_COUNT = "{keys}, pane long, on_time long, late long, dropped long, batch long, day int"


def pane_stream(events: DataFrame, keys: list[str], store: Store, table: str, checkpoint: str, *, size: int, slide: int, width: int = panes.HOUR, grace: int = panes.GRACE, lateness: int = panes.LATENESS, resends: int | None = None, trigger: dict | None = None):
    """Keeps counts of windows of a stream by event time; a late record changes one pane and re-emits the windows on it.

    events has the keys, occurred_at and received_at; with entry_id and id also re-sends are told: of rows of equal
    non-null session_id and entry_id the one of least (received_at, id) counts, in whatever batch it comes. Each
    micro-batch appends the changes of its panes, composes the windows on these panes again from all changes so far,
    and appends those as (keys, window_start, records, late, dropped, batch): the last batch of a window holds. A
    record without event time changes nothing; one without arrival time is in time.

    What is kept are tables in the store, not operator state: rows by day of arrival, changes by day of pane. A batch
    reads the days its own panes lie on, and rows that arrived up to resends seconds before its first one, by default
    as long as a pane stays open; a re-send later than that finds its pane closed and can only be counted as dropped
    once more. Each batch writes folders of its own number over again, so a replayed batch changes nothing. Returns
    the query.
    """
    kinds = ", ".join(f"`{k}` {events.schema[k].dataType.simpleString()}" for k in keys)
    told = "entry_id" in events.columns
    horizon = width + grace + lateness if resends is None else resends
    day = lambda c: F.coalesce(F.floor(c / F.lit(86400)), F.lit(0)).cast("int")

    def kept(name: str, schema: str, number: int) -> DataFrame | None:
        if not store.exists(name):
            return None
        return events.sparkSession.read.schema(schema).parquet(store.path(name)).where(F.col("batch") < number)

    def put(name: str, rows: DataFrame, number: int) -> DataFrame:
        path = f"{store.path(name)}/batch={number}"
        rows.withColumn("day", F.col("day").cast("int")).write.mode("overwrite").partitionBy("day").parquet(path)
        return events.sparkSession.read.schema(rows.schema).parquet(path)

    def write(batch: DataFrame, number: int) -> None:
        start = panes.pane_start(F.col("occurred_at"), width).alias("pane")
        if told:
            first = panes.first_arrivals(batch, "occurred_at", *[k for k in keys if k not in ("session_id", "entry_id")])
            rows = first.select(*keys, "entry_id", "received_at", "id", start, F.lit(1).alias("sign"), "session_id")
            rows = rows if "session_id" not in keys else first.select(*keys, "entry_id", "received_at", "id", start, F.lit(1).alias("sign"))
            rows = _replacing(rows, kept(f"{table}_rows", PANE_ROW.format(keys=kinds), number), horizon)
        else:
            rows = batch.select(*keys, F.lit(None).cast("string").alias("entry_id"), "received_at", F.lit(None).cast("long").alias("id"), start, F.lit(1).alias("sign"))
        rows = put(f"{table}_rows", rows.withColumn("day", day(F.unix_seconds("received_at"))), number)
        behind = F.unix_micros("received_at") - (F.col("pane") + width) * 1_000_000
        late, dropped = F.coalesce((behind > grace * 1_000_000) & (behind <= lateness * 1_000_000), F.lit(False)), F.coalesce(behind > lateness * 1_000_000, F.lit(False))
        tally = lambda of: F.sum(F.when(of, F.col("sign")).otherwise(0)).cast("long")
        changed = rows.where("pane is not null").groupBy(*keys, "pane").agg(tally(~late & ~dropped).alias("on_time"), tally(late).alias("late"), tally(dropped).alias("dropped"))
        changed = put(f"{table}_panes", changed.withColumn("day", day(F.col("pane"))), number)
        whole, earlier = changed, kept(f"{table}_panes", PANE_COUNT.format(keys=kinds), number)
        if earlier is not None:
            near = changed.select("day").distinct()
            reach = -(-size // 86400)
            near = near.select(F.explode(F.sequence(F.col("day") - reach, F.col("day") + reach)).alias("day")).distinct()
            whole = earlier.join(near, "day", "left_semi").select(changed.columns).unionByName(changed)
        totals = whole.groupBy(*keys, "pane").agg(*[F.sum(c).alias(c) for c in ("on_time", "late", "dropped")])
        found = panes.windows(totals, keys, size=size, slide=slide, width=width)
        if earlier is not None:
            touched = panes.windows(changed, keys, size=size, slide=slide, width=width).select(*keys, "window_start").distinct()
            same = None
            for k in [*keys, "window_start"]:
                one = F.col(f"f.{k}").eqNullSafe(F.col(f"t.{k}"))
                same = one if same is None else same & one
            found = found.alias("f").join(touched.alias("t"), same, "left_semi")
        found.select(*keys, "window_start", (F.col("on_time") + F.col("late")).alias("records"), "late", "dropped").write.mode("overwrite").parquet(f"{store.path(table)}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _replacing(rows: DataFrame, stored: DataFrame | None, horizon: int) -> DataFrame:
    """rows less the re-sends of stored ones; a row that comes before a stored one of its entry takes it back (sign -1)."""
    if stored is None:
        return rows
    first = rows.agg(F.unix_seconds(F.min("received_at")).alias("first")).first()["first"]  # one number
    near = stored.where((F.col("day") == 0) | (F.col("day") >= ((first or 0) - horizon) // 86400)).where("sign = 1 and entry_id is not null and session_id is not null")
    order = lambda: F.struct(F.col("received_at").isNull().alias("unknown"), "received_at", "id")
    carried = [c for c in rows.columns if c not in ("session_id", "entry_id", "sign")]
    known = near.groupBy("session_id", "entry_id").agg(F.min_by(F.struct(*carried), order()).alias("was"))
    met = rows.withColumn("mine", order()).join(known, ["session_id", "entry_id"], "left")
    was = F.struct(F.col("was.received_at").isNull().alias("unknown"), F.col("was.received_at").alias("received_at"), F.col("was.id").alias("id"))
    fresh = met.where(F.col("was").isNull() | (F.col("mine") < was))
    back = fresh.where("was is not null").select("session_id", "entry_id", *[F.col(f"was.{c}").alias(c) for c in carried], F.lit(-1).alias("sign"))
    return fresh.select(rows.columns).unionByName(back.select(rows.columns))


def last_windows(store: Store, table: str, keys: list[str]) -> DataFrame:
    """(keys, window_start, records, late, dropped): what pane_stream emitted last for each window that still has a record."""
    rows = store.read(table)
    values = F.struct("records", "late", "dropped")
    return rows.groupBy(*keys, "window_start").agg(F.max_by(values, "batch").alias("last")).select(*keys, "window_start", "last.*").where("records <> 0 or dropped <> 0")
