"""Near-duplicate statements: pairs by similarity, the decision on each pair, the ordered fold, and its undoing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import memory, text
from quern.operators import vectors

LOWER, UPPER, SETTLES, KEEPS, SAME = 0.80, 0.95, 0.7, 0.4, 0.5


def eligible(statements: DataFrame, now: Column) -> DataFrame:
    """Live, timed, embedded and unexpired statements."""
    return statements.where(memory.live() & F.col("said_at").isNotNull() & F.col("embedding").isNotNull() & (F.col("until_moment").isNull() | (F.col("until_moment") > now)))


def similar_pairs(statements: DataFrame, now: Column, *, lower: float = LOWER, upper: float | None = None, across_kinds: bool = False) -> DataFrame:
    """(older_id, newer_id, scope_key, older_kind, newer_kind, similarity): pairs at or over lower (and under upper).

    Both have the same scope (null is a scope of its own), the same model and, unless across_kinds, the same kind;
    older comes first by (said_at, id). Blocked by those keys as equalities; an exact pass over each block. For
    blocks beyond millions of rows candidates should come from a hashed search first.
    """
    rows = eligible(statements, now).select("id", "kind", "scope_key", "embedding_model", "said_at", "embedding", "statement")
    block = [F.coalesce("scope_key", F.lit("\x00")).alias("at"), F.col("embedding_model").alias("model"), *([] if across_kinds else [F.col("kind").alias("of")])]
    names = ["at", "model", *([] if across_kinds else ["of"])]
    left, right = (rows.select(F.col("id").alias(f"{side}_id"), F.col("embedding").alias(f"{side}_vector"), *block) for side in ("left", "right"))
    close = vectors.cosines(left, right, names, least=lower).where("left_id <> right_id")
    if upper is not None:
        close = close.where(F.col("similarity") < upper)
    told = rows.drop("embedding", "embedding_model")
    a = told.select(*[F.col(c).alias("scope_key" if c == "scope_key" else f"older_{c}") for c in told.columns])
    b = told.drop("scope_key").select(*[F.col(c).alias(f"newer_{c}") for c in told.columns if c != "scope_key"])
    pairs = close.withColumnsRenamed({"left_id": "older_id", "right_id": "newer_id"}).join(a, "older_id").join(b, "newer_id")
    return pairs.where(F.struct("older_said_at", "older_id") < F.struct("newer_said_at", "newer_id"))


def decide(pairs: DataFrame, answers: DataFrame | None = None, *, upper: float = UPPER, settles: float = SETTLES, keeps: float = KEEPS) -> DataFrame:
    """pairs with reason: cutoff, same, settles, or why both are kept (guard, literals, ask, both).

    answers has older_id, newer_id, same, settles, keeps. Cheap rules come first; only pairs with reason ask need
    answers, so a caller can ask a model about those and no others.
    """
    tier = lambda side: memory.by_kind(F.col(f"{side}_kind"), 4)
    rule = lambda side: memory.by_kind(F.col(f"{side}_kind"), 5)
    guarded = tier("older").isNull() | tier("newer").isNull() | (rule("older") & ~rule("newer")) | (tier("newer") < tier("older"))
    lacks = F.size(text.lacking(F.col("older_statement"), F.col("newer_statement"))) > 0
    if answers is not None:
        pairs = pairs.join(answers.select("older_id", "newer_id", *[F.col(c).alias(f"says_{c}") for c in ("same", "settles", "keeps")]), ["older_id", "newer_id"], "left")
    else:
        pairs = pairs.withColumns({f"says_{c}": F.lit(None).cast("double") for c in ("same", "settles", "keeps")})
    later = F.col("newer_said_at") > F.col("older_said_at")
    reason = (
        F.when(guarded, "guard")
        .when((F.col("similarity") >= upper) & ~lacks, "cutoff")
        .when(F.col("says_same").isNull(), "ask")
        .when((F.col("says_same") >= SAME) & (lacks | (F.col("says_keeps") < keeps)), "literals")
        .when(F.col("says_same") >= SAME, "same")
        .when(later & (F.col("says_settles") >= settles), "settles")
        .otherwise("both")
    )
    return pairs.withColumn("reason", reason).drop("says_same", "says_settles", "says_keeps")


def fold(decided: DataFrame) -> DataFrame:
    """(scope_key, retired_id, survivor_id, reason): merges applied in order, oldest subject first, a lane per scope.

    A subject takes in its older neighbours; both must still be live when it is written. A scope's lane holds its
    decided pairs only, in order, and streams through the task.
    """
    pairs = decided.where(F.col("reason").isin("cutoff", "same", "settles")).withColumn("lane", F.coalesce(F.col("scope_key"), F.lit("\x00")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lane, gone = None, set()
        for pdf in batches:
            out = []
            for at, key, older, newer, reason in pdf[["lane", "scope_key", "older_id", "newer_id", "reason"]].itertuples(index=False):
                if at != lane:
                    lane, gone = at, set()
                if older not in gone and newer not in gone:
                    gone.add(older)
                    out.append((key, older, newer, reason))
            if out:
                yield pd.DataFrame(out, columns=["scope_key", "retired_id", "survivor_id", "reason"])

    ordered = pairs.repartition("lane").sortWithinPartitions("lane", "newer_said_at", "newer_id", "older_said_at", "older_id")
    return ordered.select("lane", "scope_key", "older_id", "newer_id", "reason").mapInPandas(run, "scope_key string, retired_id long, survivor_id long, reason string")


def undo(statements: DataFrame, run: str, *, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """(id, superseded_by): statements that undoing a run restores: retired by it into one of another text.

    With both ends of a window also those retired in it without a run. The result is the dry run; writing restored
    events for it is the undoing.
    """
    if (since is None) != (until is None):
        raise ValueError("a window needs both ends")
    mine = F.col("retired_by_run") == run
    if since is not None:
        mine = mine | (F.col("retired_by_run").isNull() & (F.col("superseded_at") >= since) & (F.col("superseded_at") < until))
    texts = statements.select(F.col("id").alias("survivor"), F.col("statement").alias("survivor_text"))
    rows = statements.where(mine & F.col("superseded_by").isNotNull()).join(texts, F.col("superseded_by") == F.col("survivor"))
    return rows.where(F.col("statement") != F.col("survivor_text")).select("id", "superseded_by")
