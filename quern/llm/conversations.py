"""Conversations put together from message rows, as a streaming query with keyed state.

Rows stream in by arrival, in several micro-batches. A key is a shard of the record by session and entry, so that
re-sends meet and a session of any share of the rows is spread over all shards, with nothing known of the input before
it comes. The state of a shard buffers its rows, in any order of event time; a new batch is only appended to it. When
the watermark says that a session's rows there have been idle long enough they are reduced to first arrivals and
emitted as messages, and leave the state. The messages of a session are composed by slices of time: a slice is reduced
to its counts and its first and last speaker, which compose to the verdict over the whole session.

No row is ever too late: rows carry no watermark themselves, a sample of clock rows does. Where a row comes after
its session was emitted from the shard, the second emission tells, and that session is put together from the record
again. At the end of a bounded input a mark later than every timeout closes what is still open.

The watermark is on received_at, the clock of the receiver, since occurred_at comes from clocks that may be wrong.
"""

from __future__ import annotations

import io
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from quern.operators import panes
from quern.tables import cut, own_path, streamed

ROLES = {"human": "user", "agent": "assistant", "system": "system"}
MESSAGE_KINDS = ("prompt", "response", "system")
#: Shards for each shuffle partition; seconds of a slice of a session.
SHARDS = 4
SLICE = 3600
#: Seconds without a row after which a session's rows in a shard are emitted, and by which the watermark trails.
IDLE = 2 * 86400
DELAY = 600
#: Micro-batches that a bounded input is read in; one in so many rows is a clock row too.
TRIGGERS, CLOCK = 4, 64
#: The end mark, and the latest time a clock row tells; both within what Arrow's nanoseconds hold.
END, LATEST = "2260-01-01", "2250-01-01"
NOTHING = -(2**63)
USER, ASSISTANT, SYSTEM, NONE = 0, 1, 2, 3
NAMES = ["user", "assistant", "system", None]
REASONS = ["", "actor or time missing", "no user", "no assistant", "does not start with the user", "user without reply"]
BUFFER = ["session_id", "entry_id", "received", "id", "occurred", "role", "message", "arrived"]
COLUMNS = ["id", "session_id", "entry_id", "received_at", "occurred_at", "actor", "actor_depth", "kind", "body"]
EMITTED = "session_id string, shard int, closed long, id long, occurred long, role int"
#: The store of state that grows beyond memory.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _told() -> tuple[Column, Column]:
    """Whether a row is a message, and the number of its role."""
    white = F.regexp_replace("body", r"(?U)[\s\x1c-\x1f\x85]+", "") == ""
    message = F.col("kind").isin(*MESSAGE_KINDS) & (F.coalesce("actor_depth", F.lit(0)) == 0) & F.col("body").isNotNull() & ~white
    role = F.lit(NONE)
    for actor, name in ROLES.items():
        role = F.when(F.col("actor") == actor, F.lit(NAMES.index(name))).otherwise(role)
    return F.coalesce(message, F.lit(False)), role.cast("int")


def _prepared(rows: DataFrame, shards: int) -> DataFrame:
    message, role = _told()
    told = F.when(F.col("received_at").isNotNull(), F.least(F.col("received_at"), F.lit(LATEST).cast("timestamp")))
    ready = rows.select(
        F.pmod(F.xxhash64("session_id", F.coalesce(F.col("entry_id"), F.col("id").cast("string"))), F.lit(shards)).cast("int").alias("shard"),
        "session_id",
        "entry_id",
        F.coalesce(F.unix_micros("received_at"), F.lit(-NOTHING - 1)).alias("received"),
        F.coalesce("id", F.lit(NOTHING)).alias("id"),
        F.coalesce(F.unix_micros("occurred_at"), F.lit(NOTHING)).alias("occurred"),
        role.alias("role"),
        message.alias("message"),
        F.coalesce(F.unix_seconds(told), F.lit(0)).alias("arrived"),
        F.when(F.col("mark"), F.col("received_at")).otherwise(told).alias("told"),
        "mark",
    )
    # a clock row is a copy that only has a time; the row itself has none, so it is behind no watermark
    clock = F.coalesce(F.col("mark"), F.pmod(F.xxhash64("id"), F.lit(CLOCK)) == 0)
    copies = F.explode(F.when(F.coalesce("mark", F.lit(False)), F.array(F.lit(True))).when(clock, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
    ready = ready.withColumn("clock", copies)
    return ready.select("shard", *BUFFER, "clock", F.when(F.col("clock"), F.col("told")).alias("arrived_at"))


def first_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    """First arrivals: of equal session and non-null entry the least (received, id); rows without entry stay."""
    keyed = pdf["entry_id"].notna()
    known = pdf[keyed].sort_values(["received", "id"], kind="stable").drop_duplicates(["session_id", "entry_id"])
    return pd.concat([known, pdf[~keyed]], ignore_index=True)


def _packed(pdf: pd.DataFrame) -> bytes:
    out = io.BytesIO()
    pdf[BUFFER].to_parquet(out, index=False, compression="zstd")
    return out.getvalue()


def stateful(idle: int):
    """The state function of a shard: appends rows unread, and where a timeout has passed emits idle sessions and keeps the others.

    The state is the packed batches and the soonest time at which a session can be idle, which later rows only put off.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        blobs, soonest = state.get if state.exists else ([], None)
        if not state.hasTimedOut:
            new = [b[~b["clock"]] for b in batches]
            new = [b for b in new if len(b)]
            if new:
                rows = pd.concat(new, ignore_index=True)
                due = int(rows.groupby("session_id")["arrived"].max().min()) + idle
                soonest = due if soonest is None else min(soonest, due)
                blobs = [*blobs, _packed(rows)]
        now = state.getCurrentWatermarkMs()
        if blobs and soonest * 1000 <= now:
            rows = first_rows(pd.concat([pd.read_parquet(io.BytesIO(b)) for b in blobs], ignore_index=True))
            ends = rows.groupby("session_id")["arrived"].transform("max") + idle
            closed = (ends <= now / 1000).to_numpy()
            if closed.any():
                done = rows[closed]
                there = done[["session_id"]].drop_duplicates().assign(id=NOTHING, occurred=NOTHING, role=NONE)
                out = pd.concat([there, done.loc[done["message"], ["session_id", "id", "occurred", "role"]]], ignore_index=True)
                # any number that no other emission of the shard has
                yield out.assign(shard=key[0], closed=time.time_ns())[["session_id", "shard", "closed", "id", "occurred", "role"]]
            rows = rows[~closed]
            blobs = [_packed(rows)] if len(rows) else []
            soonest = int(ends[~closed].min()) if len(rows) else None
        if not blobs:
            if state.exists:
                state.remove()
            return
        state.update((blobs, soonest))
        state.setTimeoutTimestamp(max(soonest * 1000, now + 1))

    return run


def conversation_stream(rows: DataFrame, shards: int, *, idle: int = IDLE, delay: int = DELAY) -> DataFrame:
    """The streaming operator: rows is a stream with COLUMNS and mark (null but for an end mark); emits EMITTED rows as sessions close."""
    ready = _prepared(rows, shards).withWatermark("arrived_at", f"{delay} seconds")
    return ready.groupBy("shard").applyInPandasWithState(stateful(idle), EMITTED, "buffers array<binary>, soonest long", "append", GroupStateTimeout.EventTimeTimeout)


def emitted(spark: SparkSession, path: str, *, idle: int = IDLE, delay: int = DELAY, triggers: int = TRIGGERS, shards: int | None = None) -> DataFrame:
    """(session_id, id, occurred, role) of the Parquet files at path, from a streaming query that is run to its end.

    A row a message, and rows of id NOTHING that only say the session is there. The files are read in about triggers
    micro-batches, at least one file each, in their order of writing; sessions close by their idle time in between, and
    those a row came to afterwards are taken from the record as a whole.
    """
    logs = spark.read.parquet(path).select(*COLUMNS)
    shards = shards or SHARDS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    marks, out, state = own_path(spark, "mark"), own_path(spark, "conversations"), own_path(spark, "state")
    per_trigger = max(1, -(-len(logs.inputFiles()) // triggers))
    rows = streamed(spark, path, COLUMNS, per_trigger).where("session_id is not null").withColumn("mark", F.lit(None).cast("boolean"))
    # later than every timeout; the query is resumed for it, after the last of the files
    mark = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields]).withColumns({"mark": F.lit(True), "received_at": F.lit(END).cast("timestamp")})
    mark.limit(0).write.parquet(marks)
    stream = conversation_stream(rows.unionByName(streamed(spark, marks)), shards, idle=idle, delay=delay)
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True)
    name, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name, ROCKS)
    try:
        writer.start().awaitTermination()
        mark.write.mode("append").parquet(marks)
        writer.start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    found = spark.read.schema(stream.schema).parquet(out)
    again = found.groupBy("session_id", "shard").agg(F.min("closed").alias("a"), F.max("closed").alias("b")).where("a < b").select("session_id").distinct()
    if again.isEmpty():
        return found.drop("shard", "closed")
    again = cut(again, "again")
    return found.join(again, "session_id", "left_anti").drop("shard", "closed").unionByName(_from_record(logs.join(again, "session_id", "left_semi")))


def _from_record(logs: DataFrame) -> DataFrame:
    """What emitted() gives of these rows, without a stream."""
    message, role = _told()
    rows = logs.withColumns({"received_at": F.col("received_at").cast("timestamp"), "occurred": F.coalesce(F.unix_micros(F.col("occurred_at").cast("timestamp")), F.lit(NOTHING)), "role": role, "message": message})
    first = panes.first_arrivals(rows, "occurred", "role", "message").where("message").select("session_id", "id", "occurred", "role")
    return first.unionByName(logs.select("session_id", F.lit(NOTHING).alias("id"), F.lit(NOTHING).alias("occurred"), F.lit(NONE).alias("role")).distinct())


def _composed(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(session_id, reason, messages) of all sessions, and their messages with turns, by slices of time."""
    rows = parts.where(F.col("id") != NOTHING).withColumn("slice", F.when(F.col("occurred") != NOTHING, F.floor(F.col("occurred") / F.lit(SLICE * 1_000_000))))
    inside = Window.partitionBy("session_id", "slice").orderBy("occurred", "id")
    rows = rows.withColumn("nth", F.row_number().over(inside))
    talk = rows.where(F.col("role") != SYSTEM).withColumn("next", F.lead("role").over(inside)).withColumn("before", F.lag("role").over(inside))
    ends = talk.groupBy("session_id", "slice").agg(
        F.max(F.when(F.col("before").isNull(), F.col("role"))).alias("first"),
        F.max(F.when(F.col("next").isNull(), F.col("role"))).alias("last"),
        F.max((F.col("role") == USER) & (F.col("next") == USER)).alias("doubled"),
    )
    sizes = rows.groupBy("session_id", "slice").agg(F.count("*").alias("messages"), F.count_if(F.col("role") == USER).alias("users"), F.count_if(F.col("role") == ASSISTANT).alias("assistants"), F.count_if((F.col("role") == NONE) | F.col("slice").isNull()).alias("missing"))
    along = Window.partitionBy("session_id").orderBy("slice")
    slices = ends.withColumn("next_first", F.lead("first").over(along)).withColumn("opening", F.row_number().over(along) == 1)
    broken = slices.groupBy("session_id").agg(
        F.max(F.coalesce("doubled", F.lit(False)) | ((F.col("last") == USER) & F.coalesce(F.col("next_first") == USER, F.lit(True)))).alias("unanswered"),
        F.max(F.col("opening") & (F.col("first") != USER)).alias("wrong_start"),
    )
    totals = sizes.groupBy("session_id").agg(*[F.sum(c).alias(c) for c in ("messages", "users", "assistants", "missing")])
    everyone = parts.select("session_id").distinct().join(totals, "session_id", "left").join(broken, "session_id", "left")
    reason = F.when(F.col("missing") > 0, 1).when(F.coalesce("users", F.lit(0)) == 0, 2).when(F.col("assistants") == 0, 3).when(F.col("wrong_start"), 4).when(F.col("unanswered"), 5).otherwise(0)
    up_to = along.rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("session_id").alias("of_session"), F.col("slice").alias("of_slice"), F.coalesce(F.sum("messages").over(up_to), F.lit(0)).alias("earlier"))
    turned = rows.join(starts, (F.col("session_id") == F.col("of_session")) & F.col("slice").eqNullSafe(F.col("of_slice"))).select("session_id", "id", "role", (F.col("earlier") + F.col("nth")).alias("turn"))
    return everyone.select("session_id", reason.alias("reason"), F.coalesce("messages", F.lit(0)).cast("long").alias("messages")), turned


def sessions(emitted_rows: DataFrame) -> DataFrame:
    """(session_id, reason, messages): one row per session; an empty reason means a whole conversation.

    Messages are first arrivals of kind prompt, response or system with actor_depth 0 or null and a body that is not
    blank. A session without messages has no user. An actor other than human, agent and system counts as missing.
    """
    composed, _ = _composed(emitted_rows)
    names = F.array(*[F.lit(r) for r in REASONS])
    return composed.select("session_id", F.element_at(names, F.col("reason") + 1).alias("reason"), "messages")


def conversations(emitted_rows: DataFrame, logs: DataFrame) -> DataFrame:
    """(session_id, turn, role, log_id, body): the messages of whole conversations in their order, from emitted()."""
    composed, turned = _composed(emitted_rows)
    good = composed.where("reason = 0").select("session_id")
    names = F.array(*[F.lit(n) for n in NAMES])
    return turned.join(good, "session_id", "left_semi").join(logs.select("id", "body"), "id").select("session_id", "turn", F.element_at(names, F.col("role") + 1).alias("role"), F.col("id").alias("log_id"), "body")
