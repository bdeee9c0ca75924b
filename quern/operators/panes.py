"""Counts per event-time period that are corrected while late records come in.

The stream is sliced into panes, non-overlapping periods at window-boundary granularity. A record touches the one
pane of its event time. Windows are composed of whole panes, so a late record recomposes only the windows that cover
its pane, and only these are emitted again.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3600
#: Seconds after the end of a pane up to which records are in time, and up to which they still correct it.
GRACE = 300
LATENESS = 24 * HOUR


def first_arrivals(logs: DataFrame, *carried: str) -> DataFrame:
    """(session_id, entry_id, received_at, id, *carried): of rows with equal non-null session and entry the first to arrive.

    First is the least (received_at, id), a null received_at last. A row with a null in either key is one itself.
    carried columns are those of the chosen row.
    """
    names = ["received_at", "id", *carried]
    value = F.struct(F.col("received_at").isNull().alias("unknown"), *names)
    whole = F.col("session_id").isNotNull() & F.col("entry_id").isNotNull()
    # a row with a null key is a group of its own, so that the table is read once
    marked = logs.withColumn("__own", F.when(~whole, F.monotonically_increasing_id()))
    chosen = marked.groupBy("session_id", "entry_id", "__own").agg(F.min(value).alias("row"))
    return chosen.select("session_id", "entry_id", *[F.col(f"row.{c}").alias(c) for c in names])


def pane_width(size: int, slide: int) -> int:
    """Seconds of a pane on whose borders all borders of windows of that size and slide lie."""
    return gcd(size, slide)


def pane_start(when: Column, width: int) -> Column:
    """Start of the pane that holds the instant, in seconds since 1970; floors before 1970 too."""
    micros = F.unix_micros(when)
    return F.floor((micros - F.pmod(micros, F.lit(width * 1_000_000))) / F.lit(1_000_000)).cast("long")


def panes(events: DataFrame, keys: list[str], occurred: str = "occurred_at", received: str = "received_at", *, width: int = HOUR, grace: int = GRACE, lateness: int = LATENESS) -> DataFrame:
    """(keys, pane, on_time, late, dropped, first_late_at, last_late_at): one row per key and pane that got a record.

    late records came more than grace and at most lateness seconds after the end of the pane and correct it; dropped
    ones came after it was closed to them. Records without event time are left out; without an arrival time they
    count as on time. Counts are combined before the shuffle, so a key of any share of the rows costs one row a task.
    """
    start = pane_start(F.col(occurred), width)
    behind = F.unix_micros(received) - (start + width) * 1_000_000
    late = F.coalesce((behind > grace * 1_000_000) & (behind <= lateness * 1_000_000), F.lit(False))
    dropped = F.coalesce(behind > lateness * 1_000_000, F.lit(False))
    rows = events.where(F.col(occurred).isNotNull()).select(*keys, start.alias("pane"), late.alias("is_late"), dropped.alias("is_dropped"), F.col(received).alias("arrived"))
    return rows.groupBy(*keys, "pane").agg(
        F.count_if(~F.col("is_late") & ~F.col("is_dropped")).alias("on_time"),
        F.count_if("is_late").alias("late"),
        F.count_if("is_dropped").alias("dropped"),
        F.min(F.when(F.col("is_late"), F.col("arrived"))).alias("first_late_at"),
        F.max(F.when(F.col("is_late"), F.col("arrived"))).alias("last_late_at"),
    )


def windows(of: DataFrame, keys: list[str], *, size: int, slide: int, width: int = HOUR) -> DataFrame:
    """(keys, window_start, on_time, late, dropped): windows composed of panes; those without a record are absent.

    size and slide are seconds and multiples of the pane's width.
    """
    if pane_width(size, slide) % width:
        raise ValueError(f"windows of {size} s every {slide} s don't lie on borders of panes of {width} s")
    last = F.floor(F.col("pane") / slide) * slide
    covering = F.filter(F.sequence(last - F.lit((size // slide) * slide), last, F.lit(slide)), lambda w: (w <= F.col("pane")) & (w + size > F.col("pane")))
    return of.withColumn("window_start", F.explode(covering)).groupBy(*keys, "window_start").agg(*[F.sum(c).alias(c) for c in ("on_time", "late", "dropped")])


def revisions(events: DataFrame, keys: list[str], occurred: str = "occurred_at", received: str = "received_at", *, width: int = HOUR, grace: int = GRACE, lateness: int = LATENESS, every: int = HOUR) -> DataFrame:
    """(keys, pane, emitted_at, records): what is emitted for each pane as time passes.

    A pane is first emitted when its grace has passed, then again at the end of each period of every seconds in which
    a late record changed it, until it closes; records is the count as known then. A pane that has only late records
    is first emitted with the first of them. emitted_at is in seconds since 1970.
    """
    start = pane_start(F.col(occurred), width)
    closes = start + width + grace
    arrived = F.ceil(F.unix_micros(received) / F.lit(1_000_000)).cast("long")
    period = F.when(F.unix_micros(received) <= closes * 1_000_000, closes).otherwise(closes + F.ceil((arrived - closes) / F.lit(every)).cast("long") * every)
    rows = events.where(F.col(occurred).isNotNull()).select(*keys, start.alias("pane"), F.coalesce(period, closes).alias("emitted_at"), (F.unix_micros(received) - (start + width) * 1_000_000).alias("behind"))
    changes = rows.where(F.coalesce(F.col("behind") <= lateness * 1_000_000, F.lit(True))).groupBy(*keys, "pane", "emitted_at").agg(F.count("*").alias("changed"))
    so_far = Window.partitionBy(*keys, "pane").orderBy("emitted_at").rowsBetween(Window.unboundedPreceding, 0)
    return changes.select(*keys, "pane", "emitted_at", F.sum("changed").over(so_far).alias("records"))
