"""The store: append-only tables and events, folded to views. Nothing is updated in place.

A change to a statement is an event (at, seq, statement, what, value columns). The view of statements is their rows
with the last event of each field folded in, so any earlier state is a fold over fewer events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import memory

EVENTS = "seq long, at timestamp, memory_id long, what string, survivor long, reason string, run string, until_moment timestamp, embedding array<float>, embedding_model string"
#: What sets a field and what clears it again.
FIELDS = {"retired": ("superseded_by", "superseded_at", "retired_by_run"), "ended": ("ended_at", "ended_reason"), "sorted": ("until_moment",), "embedded": ("embedding", "embedding_model"), "compared": ("merged_at",)}
ENDINGS = ("event", "reread", "state")


class Store:
    """Parquet tables under a root folder, appended to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def exists(self, table: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(table))
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def read(self, table: str, schema: str | None = None) -> DataFrame | None:
        if self.exists(table):
            return self.spark.read.parquet(self.path(table))
        return self.spark.createDataFrame([], schema) if schema else None

    def append(self, table: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path(table))

    def overwrite(self, table: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(self.path(table))


def view(statements: DataFrame, events: DataFrame, as_of: Column | None = None) -> DataFrame:
    """statements with their events folded in, up to a moment if given; the last event of each field wins.

    restored clears retired, reopened clears ended, embedded also clears compared. One aggregation over the events.
    """
    if as_of is not None:
        events = events.where(F.col("at") <= as_of)
    latest = lambda *whats: F.max_by(F.struct("at", "what", "survivor", "reason", "run", "until_moment", "embedding", "embedding_model"), F.when(F.col("what").isin(*whats), F.struct("at", "seq")))
    folded = events.groupBy("memory_id").agg(
        latest("retired", "restored").alias("r"), latest("ended", "reopened").alias("e"), latest("sorted").alias("s"), latest("embedded").alias("v"), latest("compared", "uncompared", "embedded").alias("c")
    )
    rows = statements.join(folded, F.col("id") == F.col("memory_id"), "left")
    has = lambda at, what: F.coalesce(F.col(f"{at}.what") == what, F.lit(False))
    touched = lambda at: F.col(f"{at}.what").isNotNull()
    pick = lambda at, what, new, old: F.when(has(at, what), new).when(touched(at), F.lit(None)).otherwise(F.col(old)).alias(old)
    new = {
        "superseded_by": pick("r", "retired", F.col("r.survivor"), "superseded_by"),
        "superseded_at": pick("r", "retired", F.col("r.at"), "superseded_at"),
        "retired_by_run": pick("r", "retired", F.col("r.run"), "retired_by_run"),
        "ended_at": pick("e", "ended", F.col("e.at"), "ended_at"),
        "ended_reason": pick("e", "ended", F.col("e.reason"), "ended_reason"),
        "until_moment": pick("s", "sorted", F.col("s.until_moment"), "until_moment"),
        "embedding": pick("v", "embedded", F.col("v.embedding"), "embedding"),
        "embedding_model": pick("v", "embedded", F.col("v.embedding_model"), "embedding_model"),
        "merged_at": pick("c", "compared", F.col("c.at"), "merged_at"),
    }
    return rows.select(*[new.get(c, F.col(c)) for c in statements.columns])


def retirements(wanted: DataFrame, current: DataFrame) -> DataFrame:
    """wanted (memory_id, survivor, ...) whose statement and survivor are both live and differ."""
    live = current.where(memory.live()).select("id")
    both = wanted.where(F.col("memory_id") != F.col("survivor")).join(live.withColumnRenamed("id", "memory_id"), "memory_id", "left_semi")
    return both.join(live.withColumnRenamed("id", "survivor"), "survivor", "left_semi").select(wanted.columns)


def endings(wanted: DataFrame, current: DataFrame) -> DataFrame:
    """wanted (memory_id, reason) of live statements; another reason than ENDINGS is an error when it runs."""
    known = F.when(F.col("reason").isin(*ENDINGS), F.col("reason")).otherwise(F.raise_error(F.concat(F.lit("unknown reason "), F.coalesce("reason", F.lit("null")))))
    live = current.where(memory.live()).select(F.col("id").alias("memory_id"))
    return wanted.withColumn("reason", known).join(live, "memory_id", "left_semi").select(wanted.columns)


def needs_embedding(statements: DataFrame, model: str, text_col: str = "statement") -> DataFrame:
    """Rows without a vector or with one of another model whose text is not blank."""
    return statements.where((F.col("embedding").isNull() | ~F.col("embedding_model").eqNullSafe(F.lit(model))) & (F.trim(F.coalesce(text_col, F.lit(""))) != ""))


def insert_or_ignore(rows: DataFrame, stored: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows whose key is not stored, the first per key; nulls in a key never conflict."""
    from quern.sources.otlp import new_rows

    return new_rows(rows, stored, keys, order)
