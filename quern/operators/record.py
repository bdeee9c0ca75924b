"""The record of sessions: context windows, as-of pairing, sampling of handed pairs, exchanges, backlogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import scope, text

SLACK = 5
#: Seconds of a period of an as-of join.
PERIOD = 6 * 3600
ROUNDS, BUDGET = 5, 60_000


def prompts(logs: DataFrame) -> DataFrame:
    """Prompts that a person can be pointed to: with entry id, time, and no harness noise."""
    return logs.where("kind = 'prompt' and entry_id is not null and occurred_at is not null").where(text.not_noise(F.col("body")))


def as_of(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, tie: str, *, slack: int = 0, carried: list[str]) -> DataFrame:
    """left with the carried columns of the latest right row of its key at most slack seconds after it, null if none.

    No range join: right rows are placed slack seconds earlier, both sides are sorted by time within (key, period of
    PERIOD seconds), and each left row takes the last right row at or before it, else the last of the earlier periods,
    which are composed per key from one row a period. So a key of any share of the rows is spread over its periods.
    """
    tag = F.struct(*[F.col(c) for c in carried])
    period = lambda c: F.floor(F.col(c) / F.lit(PERIOD * 1_000_000)).alias("__period")
    r = right.where(F.col(right_at).isNotNull() & F.col(key).isNotNull()).select(F.col(key), (F.unix_micros(right_at) - slack * 1_000_000).alias("__at"), F.lit(0).alias("__side"), F.col(tie).cast("long").alias("__tie"), tag.alias("__row"))
    l = left.select(F.col(key), F.unix_micros(left_at).alias("__at"), F.lit(1).alias("__side"), F.lit(0).cast("long").alias("__tie"), F.lit(None).cast(r.schema["__row"].dataType).alias("__row"), F.struct(*left.columns).alias("__left"))
    r = r.withColumn("__left", F.lit(None).cast(l.schema["__left"].dataType))
    both = r.unionByName(l).withColumn("__period", period("__at"))
    last = both.groupBy(key, "__period").agg(F.max_by("__row", F.when(F.col("__side") == 0, F.struct("__at", "__tie"))).alias("__last"))
    earlier = Window.partitionBy(key).orderBy("__period").rowsBetween(Window.unboundedPreceding, -1)
    before = last.select(F.col(key).alias("__of"), F.col("__period").alias("__in"), F.last("__last", ignorenulls=True).over(earlier).alias("__before")).where("__before is not null")
    along = Window.partitionBy(key, "__period").orderBy("__at", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__found", F.last("__row", ignorenulls=True).over(along)).where("__side = 1")
    found = found.join(before, (F.col(key) == F.col("__of")) & (F.col("__period") == F.col("__in")), "left").withColumn("__found", F.coalesce("__found", "__before"))
    return found.select("__left.*", *[F.col(f"__found.{c}").alias(c) for c in carried])


def ranked_injections(injections: DataFrame) -> DataFrame:
    """injections with form, which old rows lack: the first of a session is opening, later ones match."""
    first = F.row_number().over(Window.partitionBy("session_id").orderBy("injected_at", "id")) == 1
    return injections.withColumn("form", F.coalesce("form", F.when(first, "opening").otherwise("match")))


def candidate_pairs(injections: DataFrame, logs: DataFrame, statements: DataFrame, since: Column, until: Column, excluded: DataFrame | None = None) -> DataFrame:
    """(session_id, entry_id, memory_id, form, kind, scope_key): each statement handed to a person's prompt.

    The prompt is the latest human one at most SLACK seconds after the handing. The form of old rows is inferred over
    all rows before the time range is applied. Ids of statements that are gone are dropped.
    """
    ranged = ranked_injections(injections).where((F.col("injected_at") >= since) & (F.col("injected_at") < until))
    if excluded is not None:
        ranged = scope.without_excluded(ranged, excluded, "scope_key")
    human = prompts(logs).where("actor = 'human'").select("session_id", F.col("occurred_at").alias("said"), "entry_id", F.col("id").alias("log_id"))
    paired = as_of(ranged.select("id", "session_id", "injected_at", "form", "scope_key", "memory_ids"), human, "session_id", "injected_at", "said", "log_id", slack=SLACK, carried=["entry_id"]).where("entry_id is not null")
    each = paired.select("session_id", "entry_id", "form", "scope_key", F.explode("memory_ids").alias("memory_id"))
    return each.join(statements.select(F.col("id").alias("memory_id"), "kind"), "memory_id").select("session_id", "entry_id", "memory_id", "form", "kind", "scope_key").distinct()


def context_windows(logs: DataFrame, *, rounds: int = ROUNDS, budget: int = BUDGET) -> DataFrame:
    """(session_id, entry_id, before, message): each prompt with the exchanges of its last rounds.

    before starts at the earliest of the last rounds prompts up to and with this one, holds prompts and responses
    earlier than it, without empty bodies and noise, each as a tagged turn. Over budget characters the message is
    cut in its middle, else before loses whole turns from its front. Turns are numbered along the session, so a window
    is a range of numbers and its turns come from an equi-join on buckets of them.
    """
    spoken = logs.where("kind in ('prompt', 'response') and session_id is not null and occurred_at is not null")
    noise = (F.col("kind") == "prompt") & F.coalesce(text.noise(F.col("body")), F.lit(True))
    turns = spoken.withColumn("noise", noise).select("session_id", "entry_id", "id", "occurred_at", "kind", "body", "noise")
    prompt = (F.col("kind") == "prompt") & ~F.col("noise") & F.col("entry_id").isNotNull()
    said = turns.where((F.col("kind") == "prompt") & ~F.col("noise"))
    along = Window.partitionBy("session_id").orderBy("occurred_at", "id")
    first = F.coalesce(F.lag("occurred_at", rounds - 1).over(along), F.min("occurred_at").over(Window.partitionBy("session_id")))
    targets = said.withColumn("start_at", first).where(prompt).select("session_id", F.col("entry_id").alias("of_entry"), F.col("id").alias("of_id"), F.col("occurred_at").alias("of_at"), F.col("body").alias("message"), "start_at")
    usable = turns.where(~F.col("noise") & (F.trim(F.coalesce("body", F.lit("")), F.lit(text.SPACE)) != ""))
    usable = usable.select("session_id", "id", "occurred_at", F.concat(F.when(F.col("kind") == "prompt", "[person] ").otherwise("[agent] "), F.trim("body", F.lit(text.SPACE))).alias("line"))
    hour = lambda c: F.floor(F.unix_seconds(c) / F.lit(3600))
    spread = targets.withColumn("bucket", F.explode(F.sequence(hour("start_at"), hour("of_at"))))
    met = spread.join(usable.withColumn("bucket", hour("occurred_at")), ["session_id", "bucket"]).where((F.col("occurred_at") >= F.col("start_at")) & (F.col("occurred_at") < F.col("of_at")))
    lines = met.groupBy("session_id", "of_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("occurred_at", "id", "line"))), lambda x: x["line"]), "\n\n").alias("before"))
    whole = targets.join(lines, ["session_id", "of_id"], "left").withColumn("before", F.coalesce("before", F.lit("")))
    half, size = budget // 2, F.length("message")
    cut = F.concat(F.left("message", F.lit(half)), F.lit("\n\n[... "), (size - 2 * half).cast("string"), F.lit(" characters left out ...]\n\n"), F.right("message", F.lit(half)))
    room = F.lit(budget) - size
    tail = F.right("before", F.greatest(room, F.lit(0)))
    turn = F.locate("\n\n[", tail)
    fitted = F.when(size >= budget, "").when(F.length("before") <= room, F.col("before")).when(turn > 0, F.substring(tail, turn + 2, F.lit(budget))).otherwise("")
    return whole.select("session_id", F.col("of_entry").alias("entry_id"), fitted.alias("before"), F.when(size >= budget, cut).otherwise(F.col("message")).alias("message"))


def round_starts(logs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(session_id, id, occurred_at, start_at): for each prompt the time of the first of its last rounds prompts."""
    along = Window.partitionBy("session_id").orderBy("occurred_at", "id")
    first = F.coalesce(F.lag("occurred_at", rounds - 1).over(along), F.min("occurred_at").over(Window.partitionBy("session_id")))
    return prompts(logs).where("session_id is not null").select("session_id", "id", "occurred_at").withColumn("start_at", first)


def exchanges(logs: DataFrame) -> DataFrame:
    """(session_id, page, id, from_at, until_at): the exchanges of a session, newest first; a page ends where the next begins.

    until_at is null for the newest, which is still open.
    """
    rows = prompts(logs).where("session_id is not null").select("session_id", "id", F.col("occurred_at").alias("from_at"))
    down = Window.partitionBy("session_id").orderBy(F.desc("from_at"), F.desc("id"))
    return rows.select("session_id", (F.row_number().over(down) - 1).alias("page"), "id", "from_at", F.lag("from_at").over(down).alias("until_at"))


def tool_results(logs: DataFrame, key: str = "gen_ai.tool.call.id") -> DataFrame:
    """(session_id, call_id, result_id, tool_name, failed): each tool call with its result, on the call id in the attributes."""
    at = F.try_element_at("attributes", F.lit(key))
    calls = logs.where("kind = 'tool_call'").select("session_id", F.col("id").alias("call_id"), "tool_name", at.alias("call"))
    results = logs.where("kind = 'tool_result'").select("session_id", F.col("id").alias("result_id"), at.alias("call"), F.col("error_type").isNotNull().alias("failed"))
    return calls.join(results, ["session_id", "call"]).select("session_id", "call_id", "result_id", "tool_name", "failed")


def progress(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(sample, pairs, labelled): per sample how many pairs it has and how many of them have a label."""
    done = labels.select("session_id", "entry_id", "memory_id").distinct().withColumn("done", F.lit(1))
    return pairs.join(done, ["session_id", "entry_id", "memory_id"], "left").groupBy("sample").agg(F.count("*").alias("pairs"), F.count("done").alias("labelled"))


def next_unlabelled(pairs: DataFrame, labels: DataFrame, after: int) -> DataFrame:
    """The first unlabelled pair with an id over after, else the first of all."""
    open_ = pairs.join(labels.select("session_id", "entry_id", "memory_id"), ["session_id", "entry_id", "memory_id"], "left_anti")
    return open_.orderBy(F.col("id") <= after, "id").limit(1)


def latest_labels(events: DataFrame) -> DataFrame:
    """(session_id, entry_id, memory_id, label): the last label given to a pair, by (labelled_at, id)."""
    return events.groupBy("session_id", "entry_id", "memory_id").agg(F.max_by("label", F.struct("labelled_at", "id")).alias("label"))


def backlog(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """wanted rows that have no done row of the same keys; null keys never match and stay."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")
