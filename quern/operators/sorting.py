"""Where a statement belongs in time, from a model's answers about it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text

THRESHOLD = 0.5


def placed(statements: DataFrame, zone: str = "UTC", threshold: float = THRESHOLD) -> DataFrame:
    """statements with placement, new_kind, until_moment and until_event.

    statements has statement, said_at and the answers commitment, decision, state, ends, ends_confidence, ends_kind.
    The first rule that holds decides: decision, state, else commitment, which may end at a named moment after said_at.
    """
    free = F.col("commitment") < threshold
    placement = F.when(free & (F.col("decision") >= threshold), "decision").when(free & (F.col("state") >= threshold), "state").otherwise("commitment")
    rows = statements.withColumn("placement", placement)
    bound = F.col("placement") == "commitment"
    named = text.moments(F.col("said_at"), zone)
    moment = F.lit(None).cast("timestamp")
    for name in ("today", "tomorrow", "tomorrow_morning", "monday"):
        moment = F.when(F.col("ends") == name, named[name]).otherwise(moment)
    return rows.withColumns(
        {
            "new_kind": F.when(F.col("placement") == "decision", F.col("ends_kind")),
            "until_event": F.when(bound & (F.col("ends") == "event"), F.col("statement")),
            "until_moment": F.when(bound & (F.col("ends_confidence") >= threshold), moment),
        }
    )
