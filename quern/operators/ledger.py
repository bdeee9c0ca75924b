"""The ledger of model calls: usage by day, model, task or run, mean tokens, pages, gauges, latency buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUPS = {"day": F.date_trunc, "model": None, "task": None, "run": None}
TOKENS = ("input_tokens", "output_tokens")


def group_column(by: str) -> Column:
    if by not in GROUPS:
        raise ValueError(f"usage is by {', '.join(GROUPS)}, not by {by}")
    return F.date_trunc("day", "called_at") if by == "day" else F.col(by)


def usage(calls: DataFrame, by: str, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """(group, calls, input_tokens, output_tokens) over the half-open time range; sums of nothing are 0, most calls first."""
    for bound, keep in ((since, lambda b: F.col("called_at") >= b), (until, lambda b: F.col("called_at") < b)):
        if bound is not None:
            calls = calls.where(keep(bound))
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in TOKENS]
    return calls.groupBy(group_column(by).alias("group")).agg(F.count("*").alias("calls"), *sums).orderBy(F.desc("calls"), "group")


def usage_all(calls: DataFrame) -> DataFrame:
    """(by, group, calls, input_tokens, output_tokens): all four groupings in one pass over the calls."""
    rows = calls.select(F.explode(F.array(*[F.struct(F.lit(by).alias("by"), group_column(by).cast("string").alias("group")) for by in GROUPS])).alias("g"), *TOKENS)
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in TOKENS]
    return rows.groupBy("g.by", "g.group").agg(F.count("*").alias("calls"), *sums)


def mean_tokens(calls: DataFrame, planned: DataFrame, *, run: str | None = None) -> DataFrame:
    """(task, mean_tokens, estimate): mean input tokens of successful calls, of one run if given, times planned calls.

    planned has task and planned; the estimate rounds half to even and is null where there was no such call.
    """
    good = calls.where("outcome = 'ok'")
    if run is not None:
        good = good.where(F.col("run") == run)
    mean = good.groupBy("task").agg(F.avg(F.col("input_tokens").cast("double")).alias("mean_tokens"))
    return planned.join(mean, "task", "left").select("task", "mean_tokens", F.bround(F.col("mean_tokens") * F.col("planned")).cast("long").alias("estimate"))


def calls_page(calls: DataFrame, limit: int, cursor: tuple[str, int] | None = None, **equal: str | None) -> DataFrame:
    """The newest calls before a cursor (called_at, id), newest first; equal filters columns where a value is given."""
    for name, value in equal.items():
        if value is not None:
            calls = calls.where(F.col(name) == value)
    if cursor is not None:
        try:
            moment, number = cursor
            number = int(number)
        except (TypeError, ValueError) as e:
            raise ValueError(f"a cursor is a time and an id, not {cursor!r}") from e
        calls = calls.where(F.struct("called_at", "id") < F.struct(F.lit(moment).cast("timestamp"), F.lit(number).cast("long")))
    return calls.orderBy(F.desc("called_at"), F.desc("id")).limit(limit)


def next_cursor(page: DataFrame, limit: int) -> DataFrame:
    """(called_at, id) of the last row of a full page; no row if the page isn't full."""
    return page.groupBy().agg(F.count("*").alias("n"), F.min(F.struct("called_at", "id")).alias("last")).where(F.col("n") == limit).select("last.*")


def gauges(**counts: DataFrame) -> DataFrame:
    """One row with the number of rows of each table, as scalar subqueries of one query."""
    spark = next(iter(counts.values())).sparkSession
    return spark.range(1).select(*[df.agg(F.count("*")).scalar().alias(name) for name, df in counts.items()])


def exposition(counted: DataFrame, name: str, label: str) -> DataFrame:
    """(line): text exposition of a counter per label; counted has label and value. Quotes and backslashes are escaped."""
    value = F.replace(F.replace(F.coalesce(F.col(label), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return counted.select(F.concat(F.lit(f'{name}{{{label}="'), value, F.lit('"} '), F.col("value").cast("string")).alias("line"))


def histogram(rows: DataFrame, by: str, value: str, edges: list[float]) -> DataFrame:
    """(by, edge, at_most): cumulative counts at each edge, the last edge null for all."""
    tops = F.array(*[F.lit(float(e)) for e in edges], F.lit(None).cast("double"))
    return rows.select(by, value, F.explode(tops).alias("edge")).groupBy(by, "edge").agg(F.count_if(F.col("edge").isNull() | (F.col(value) <= F.col("edge"))).alias("at_most"))


def latest(rows: DataFrame, keys: list[str], when: str, tie: str = "id") -> DataFrame:
    """The latest row per key, by (when, tie); columns kept. Partial maxima before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*others), F.struct(when, tie)).alias("row")
    return rows.groupBy(*keys).agg(best).select(*keys, "row.*")


def attempts(calls: DataFrame, keys: list[str], since: Column, cap: int) -> DataFrame:
    """(keys, outcome, attempts, ready): keys whose latest call since then is an error, and how often they failed.

    Null keys take no part. ready is whether fewer than cap attempts failed.
    """
    seen = calls.where((F.col("called_at") >= since) & F.expr(" and ".join(f"{k} is not null" for k in keys)))
    per = seen.groupBy(*keys).agg(F.max_by("outcome", F.struct("called_at", "id")).alias("outcome"), F.count_if(F.col("outcome") == "error").alias("attempts"))
    return per.where("outcome = 'error'").withColumn("ready", F.col("attempts") < cap)


def ordered_sample(rows: DataFrame, strata: list[str], size: int, order: Column) -> DataFrame:
    """Round-robin over strata: each gives one row a round, in the order of its strata, until size rows are drawn."""
    turn = F.row_number().over(Window.partitionBy(*strata).orderBy(order))
    return rows.withColumn("turn", turn).where(F.col("turn") <= size).orderBy("turn", *[F.asc_nulls_first(s) for s in strata]).limit(size)
