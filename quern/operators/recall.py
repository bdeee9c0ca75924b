"""Which statements a prompt is handed: matching by vector, opening lists, silence, replay over a record of sessions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import memory, scope
from quern.operators import newest, skew, vectors

MARGIN, LIMIT, ACTIONABLE = 0.09, 5, 0.6
NEIGHBOURS, EMPTY_SHARE, SILENCE_WORDS = 20, 0.8, 12


def neighbours(prompts: DataFrame, statements: DataFrame, moment: Column, now: Column, *, by_said_at: bool = False) -> DataFrame:
    """prompts x reachable statements that stood at the moment and were embedded by the same model, with similarity.

    prompts has prompt_id, ask, model, vector; statements are rows of memories. Reachability is equality with one of the
    exploded scope ancestors, so a prompt meets only the statements of its scopes, tile by tile.
    """
    mine = statements.where("embedding is not null").where(memory.live_at(moment, now, by_said_at))
    placed = mine.select(F.col("id").alias("right_id"), F.col("embedding").alias("right_vector"), F.col("embedding_model").alias("model"), F.coalesce("scope_key", F.lit("\x00")).alias("at"))
    asked = prompts.select(F.col("prompt_id").alias("left_id"), F.col("vector").alias("left_vector"), "model", F.explode(F.concat(scope.ancestors(F.col("ask")), F.array(F.lit("\x00")))).alias("at"))
    met = vectors.cosines(asked, placed, ["model", "at"]).withColumnsRenamed({"left_id": "prompt_id", "right_id": "memory_id"})
    met = met.join(mine.select(F.col("id").alias("memory_id"), "kind", "said_at", "created_at", "actionable"), "memory_id")
    more = [c for c in prompts.columns if c not in ("prompt_id", "ask", "model", "vector", *met.columns)]
    return met.join(prompts.select("prompt_id", *more), "prompt_id") if more else met


def baseline(met: DataFrame, keys: list[str] = ["prompt_id"]) -> DataFrame:
    """met with floor: the similarity with max(10, ceil(n / 100)) rows strictly better placed, of n per key.

    An order statistic, not an interpolated percentile; null where no more rows than that are there.
    """
    whole = Window.partitionBy(*keys)
    down = whole.orderBy(F.desc("similarity"), "memory_id")
    above = F.greatest(F.lit(10), F.ceil(F.col("n") / 100)).cast("int")
    ranked = met.withColumn("n", F.count("*").over(whole)).withColumn("nth", F.row_number().over(down))
    return ranked.withColumn("floor", F.max(F.when(F.col("nth") == above + 1, F.col("similarity"))).over(whole)).drop("nth")


def match(prompts: DataFrame, statements: DataFrame, now: Column, *, moment: Column | None = None, by_said_at: bool = False, margin: float = MARGIN, limit: int = LIMIT, threshold: float = ACTIONABLE) -> DataFrame:
    """(prompt_id, memory_id, similarity, floor, rank, place): what each prompt is handed.

    The floor is taken over all reachable rows, seen and unactionable ones too; kept are those strictly over floor +
    margin, unseen (prompts.seen is an array of ids or null) and actionable, ranked by similarity * worth.
    """
    met = neighbours(prompts, statements, F.lit(None).cast("timestamp") if moment is None else moment, now, by_said_at=by_said_at)
    if "seen" not in met.columns:
        met = met.withColumn("seen", F.lit(None).cast("array<long>"))
    unseen = ~F.coalesce(F.array_contains("seen", F.col("memory_id")), F.lit(False))
    kept = baseline(met).where((F.col("similarity") > F.col("floor") + margin) & unseen & memory.actionable(threshold))
    kept = kept.withColumn("rank", F.col("similarity") * memory.worth(F.col("kind"), F.col("said_at"), F.col("created_at"), now))
    best = Window.partitionBy("prompt_id").orderBy(F.desc("rank"), "memory_id")
    return kept.withColumn("place", F.row_number().over(best).cast("long")).where(F.col("place") <= limit).select("prompt_id", "memory_id", "similarity", "floor", "rank", "place")


def opening(asks: DataFrame, statements: DataFrame, now: Column, limit: int) -> DataFrame:
    """(prompt_id, memory_id, rank, place): the worthiest scoped statements reachable from each ask, unseen, live, actionable.

    The worth of a statement is the same for every ask, so the list is made once per scope that is asked for, from the
    first rows of each scope above it, and prompts join it by equality: cost is linear in prompts and statements. Lists
    are longer than limit by as many rows as the prompt with most seen ids can hide.
    """
    mine = statements.where(memory.live() & F.col("scope_key").isNotNull() & memory.live_at(F.lit(None).cast("timestamp"), now)).select(F.col("id").alias("memory_id"), F.col("scope_key").alias("at_scope"), "created_at", memory.worth(F.col("kind"), F.col("said_at"), F.col("created_at"), now).alias("rank"))
    some = asks.select("prompt_id", "ask", *(["seen"] if "seen" in asks.columns else [])).where("ask is not null")
    hidden, reach = F.lit(0), limit
    if "seen" in some.columns:
        copies = mine.groupBy("memory_id").count().agg(F.max("count")).first()[0] or 0  # rows that one seen id hides
        hidden = F.greatest(F.coalesce(F.size("seen"), F.lit(0)), F.lit(0)) * F.lit(copies)
        reach += some.agg(F.max(hidden)).first()[0] or 0
    order = [F.desc("rank"), F.desc("created_at"), F.asc_nulls_last("memory_id")]
    first = lambda rows, key, n: rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= n)
    above = some.select("ask").distinct().withColumn("at_scope", F.explode(scope.ancestors(F.col("ask"))))
    listed = first(above.join(first(mine, "at_scope", reach).drop("place"), "at_scope"), "ask", reach)
    listed = listed.groupBy("ask").agg(F.array_sort(F.collect_list(F.struct("place", "memory_id", "rank", "created_at"))).alias("list"))
    met = skew.spread_join(some, listed, ["ask"], skew.hot_keys(some.groupBy("ask").agg(F.count("*").alias("n")), ["ask"]), ["prompt_id"])
    if "seen" in some.columns:
        unseen = lambda x: ~F.coalesce(F.array_contains("seen", x["memory_id"]), F.lit(False))
        met = met.withColumn("list", F.slice(F.filter(F.slice("list", F.lit(1), F.lit(limit) + hidden), unseen), 1, limit))
    each = met.select("prompt_id", F.posexplode("list").alias("place", "found")).select("prompt_id", "found.memory_id", "found.rank", (F.col("place") + 1).cast("long").alias("place"), "found.created_at")
    if not _once(some):
        each = first(each, "prompt_id", limit).withColumn("place", F.col("place").cast("long"))
    return each.select("prompt_id", "memory_id", "rank", "place")


def _once(prompts: DataFrame) -> bool:
    """Whether no prompt_id stands in two rows; the lists of rows that share one are ranked together."""
    return prompts.groupBy("prompt_id").count().where("count > 1").isEmpty()


def read(statements: DataFrame, ask: str | None, now: Column, *, order: str = "rank", limit: int = 50) -> DataFrame:
    """Live statements reachable from a scope, by worth or newest first, with their rank; at most limit."""
    rows = statements.where(memory.live() & scope.reach_read(F.lit(ask).cast("string"), F.col("scope_key")) & (F.col("until_moment").isNull() | (F.col("until_moment") > now)))
    rows = rows.withColumn("rank", memory.worth(F.col("kind"), F.col("said_at"), F.col("created_at"), now))
    by = {"rank": [F.desc("rank"), F.desc("created_at"), F.asc("id")], "newest": [F.desc("created_at"), F.asc("id")]}
    if order not in by:
        raise ValueError(f"order is rank or newest, not {order}")
    return rows.orderBy(*by[order]).limit(limit)


def standing(messages: DataFrame, statements: DataFrame, limit: int = 40) -> DataFrame:
    """(prompt_id, memory_id, number): live reachable statements of the firing kinds said strictly before each message.

    messages has prompt_id, ask, kinds, said_at; newest first, numbered from 1, at most limit each. A statement is held
    under its kind and scope, and a message asks under its kinds and the scopes above it, so no pairs are formed.
    """
    # the length tells where a kind ends; without a scope nothing follows
    key = lambda kind, at: F.concat(F.length(kind).cast("string"), F.lit(":"), kind, F.coalesce(F.concat(F.lit("/"), at), F.lit("")))
    held = statements.where(memory.live()).select(key(F.col("kind"), F.col("scope_key")).alias("key"), F.col("id").alias("memory_id"), F.unix_micros("said_at").alias("at")).where("key is not null and at is not null")
    above = F.concat(scope.ancestors(F.col("ask")), F.array(F.lit(None).cast("string")))
    keys = F.flatten(F.transform(F.array_distinct(F.array_compact("kinds")), lambda kind: F.transform(F.col("above"), lambda at: key(kind, at))))
    asked = messages.withColumn("above", above).select("prompt_id", keys.alias("keys"), F.unix_micros("said_at").alias("at")).where("size(keys) > 0 and at is not null")
    met = newest.newest_before(asked, held, limit)
    if not _once(asked):
        again = Window.partitionBy("prompt_id").orderBy(F.desc("at"), F.desc("memory_id"))
        met = met.withColumn("number", F.row_number().over(again)).where(F.col("number") <= limit).withColumn("number", F.col("number").cast("long"))
    return met.select("prompt_id", "memory_id", "number")


def seen(handed: DataFrame) -> DataFrame:
    """(session_id, seen): the sorted set of all ids handed in a session; an empty array where nothing was."""
    ids = handed.select("session_id", F.explode_outer("memory_ids").alias("memory_id"))
    return ids.groupBy("session_id").agg(F.array_sort(F.collect_set("memory_id")).alias("seen"))


def holds_nothing(prompts: DataFrame, readings: DataFrame, *, nearest: int = NEIGHBOURS, share: float = EMPTY_SHARE) -> DataFrame:
    """(prompt_id, neighbours, empty_share, silent): whether more than share of the nearest earlier readings are empty.

    readings has model, vector, empty, classified_at, id; filters come before the nearest are taken. Fewer than nearest
    neighbours never silence.
    """
    asked = prompts.select(F.col("prompt_id").alias("left_id"), F.col("vector").alias("left_vector"), "model", F.unix_micros("as_of").alias("left_order")).where("left_order is not null")
    known = readings.select(F.col("id").alias("right_id"), F.col("vector").alias("right_vector"), "model", F.unix_micros("classified_at").alias("right_order")).where("right_order is not null")
    met = vectors.cosines(asked, known, ["model"], top=nearest, ordered=True).withColumnsRenamed({"left_id": "prompt_id", "right_id": "reading_id"})
    met = met.join(readings.select(F.col("id").alias("reading_id"), "empty"), "reading_id")
    close = Window.partitionBy("prompt_id").orderBy(F.desc("similarity"), "reading_id")
    top = met.withColumn("nth", F.row_number().over(close)).where(F.col("nth") <= nearest)
    votes = top.groupBy("prompt_id").agg(F.count("*").alias("neighbours"), F.avg(F.col("empty").cast("double")).alias("empty_share"))
    return votes.withColumn("silent", (F.col("neighbours") >= nearest) & (F.col("empty_share") > share))


TURN = "session_id string, prompt_id long, form string, memory_ids array<long>"


def replay(turns: DataFrame, matched: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(session_id, prompt_id, form, memory_ids): what each turn is handed when a session never sees a statement twice.

    turns has session_id, prompt_id, occurred_at, noise, silent; matched has prompt_id, memory_id, rank, all candidates
    of a turn in rank order. The fold over a session is sequential, sessions run side by side; a session's rows are
    its turns with their few candidates. Form is noise, match once anything was handed, else opening.
    """
    lists = matched.groupBy("prompt_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("down"), "memory_id"))), lambda x: x["memory_id"]).alias("found"))
    rows = turns.join(lists, "prompt_id", "left").select("session_id", "prompt_id", "occurred_at", "noise", "silent", "found")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, handed = None, set()
        for pdf in batches:
            out = []
            for sid, prompt, _, noise, silent, found in pdf.itertuples(index=False):
                if sid != session:
                    session, handed = sid, set()
                if noise:
                    out.append((sid, prompt, "noise", []))
                    continue
                form = "match" if handed else "opening"
                ids = [] if silent or found is None else [int(m) for m in found if m not in handed][:limit]
                handed.update(ids)
                out.append((sid, prompt, form, ids))
            yield pd.DataFrame(out, columns=["session_id", "prompt_id", "form", "memory_ids"])

    ordered = rows.where("session_id is not null").repartition("session_id").sortWithinPartitions("session_id", "occurred_at", "prompt_id")
    return ordered.mapInPandas(fold, TURN)


def replay_from(turns: DataFrame, offered: DataFrame, place: Callable[[np.ndarray, int], np.ndarray], limit: int = LIMIT) -> DataFrame:
    """replay() where every turn of a session has the same candidates: offered has session_id, memory_id.

    place gives the candidates of a prompt their places, least first, ties to the smaller id. The list of a session is
    one row that the fold reads before its turns and keeps less what was handed, so no turn carries it.
    """
    lists = offered.where("session_id is not null and memory_id is not null").groupBy("session_id").agg(F.array_sort(F.collect_set("memory_id")).alias("open"))
    none = lambda kind: F.lit(None).cast(kind)
    heads = lists.select("session_id", none("long").alias("prompt_id"), none("timestamp").alias("occurred_at"), F.lit(False).alias("noise"), F.lit(False).alias("silent"), "open", F.lit(0).alias("part"))
    rows = turns.select("session_id", F.col("prompt_id").cast("long").alias("prompt_id"), "occurred_at", "noise", "silent", none("array<long>").alias("open"), F.lit(1).alias("part"))
    ordered = rows.where("session_id is not null").unionByName(heads).repartition("session_id").sortWithinPartitions("session_id", "part", "occurred_at", "prompt_id")
    # a null among longs would reach pandas as a float
    ordered = ordered.select("session_id", F.coalesce("prompt_id", F.lit(0)).alias("prompt_id"), "noise", "silent", "open", "part")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, left, handed = None, np.empty(0, np.int64), False
        for pdf in batches:
            out = []
            for sid, prompt, noise, silent, ids, part in pdf.itertuples(index=False):
                if sid != session:
                    session, left, handed = sid, np.empty(0, np.int64), False
                if part == 0:
                    left = np.asarray(ids, np.int64)
                    continue
                if noise:
                    out.append((sid, prompt, "noise", []))
                    continue
                form, given = "match" if handed else "opening", []
                if not silent and len(left):
                    first = np.lexsort((left, place(left, prompt)))[:limit]
                    given, left, handed = left[first].tolist(), np.delete(left, first), True
                out.append((sid, prompt, form, given))
            yield pd.DataFrame(out, columns=["session_id", "prompt_id", "form", "memory_ids"])

    return ordered.mapInPandas(fold, TURN)


def report(handed: DataFrame, statements: DataFrame, labels: DataFrame) -> DataFrame:
    """(measure, of, n): turns, turns handed nothing, statements handed, unscoped ones, and counts per form, kind and label."""
    turns = handed.select(F.lit("turns").alias("measure"), F.lit("").alias("of"), F.lit(1).alias("n"))
    nothing = handed.where(F.size("memory_ids") == 0).select(F.lit("nothing"), F.lit(""), F.lit(1))
    each = handed.select("session_id", "form", F.explode("memory_ids").alias("memory_id")).join(statements.select(F.col("id").alias("memory_id"), "kind", "scope_key"), "memory_id", "left")
    each = each.join(labels.select("session_id", "memory_id", "label"), ["session_id", "memory_id"], "left")
    parts = [each.select(F.lit(m), v, F.lit(1)) for m, v in (("statements", F.lit("")), ("form", F.col("form")), ("kind", F.coalesce("kind", F.lit("gone"))), ("label", F.coalesce("label", F.lit("none"))))]
    parts.append(each.where("scope_key is null").select(F.lit("unscoped"), F.lit(""), F.lit(1)))
    rows = turns
    for p in [nothing, *parts]:
        rows = rows.union(p)
    return rows.groupBy("measure", "of").agg(F.sum("n").alias("n"))


def handed_lines(handed: DataFrame) -> DataFrame:
    """(line): session, prompt, form and statement of each handed pair, tab-separated, sorted."""
    each = handed.select("session_id", F.col("prompt_id").cast("string").alias("prompt"), "form", F.explode("memory_ids").alias("memory_id"))
    return each.select(F.concat_ws("\t", "session_id", "prompt", "form", F.col("memory_id").cast("string")).alias("line")).orderBy("line")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, line): lines of only the first or only the second, with their multiplicity."""
    return a.exceptAll(b).select(F.lit("first").alias("side"), "line").union(b.exceptAll(a).select(F.lit("second"), "line"))
