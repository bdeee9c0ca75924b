"""One facade over a store: a method for each thing the service answers, each giving a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import judge, memory, text
from quern.operators import ledger, merging, panes, recall, record
from quern.sources import otlp, transcripts
from quern.sources.store import EVENTS, Store, endings, insert_or_ignore, needs_embedding, retirements, view

PAGE = 50


class Engine:
    """Reads and appends the tables of a store: exports, logs, resources, readings, statements, events, injections, calls, labels, label_pairs."""

    def __init__(self, spark: SparkSession, root: str, *, zone: str = "UTC", namespace: str = "memory"):
        self.spark, self.store, self.zone, self.namespace = spark, Store(spark, root), zone, namespace

    def _table(self, name: str) -> DataFrame:
        df = self.store.read(name)
        if df is None:
            raise LookupError(f"the store has no {name} yet")
        return df

    def health(self) -> DataFrame:
        return self.spark.range(1).select(F.lit("ok").alias("status"))

    def metrics(self) -> DataFrame:
        """Lines of text: rows of each table, and calls per task."""
        names = [t for t in ("logs", "statements", "injections", "calls", "labels") if self.store.exists(t)]
        counts = None
        for t in names:
            n = self._table(t).agg(F.count("*").alias("value")).withColumn("table", F.lit(t))
            counts = n if counts is None else counts.unionByName(n)
        lines = ledger.exposition(counts, "store_rows", "table") if counts is not None else self.spark.createDataFrame([], "line string")
        if "calls" in names:
            lines = lines.union(ledger.exposition(self._table("calls").groupBy("task").agg(F.count("*").alias("value")), "model_calls_total", "task"))
        return lines

    def ingest_exports(self, path: str, received_at: str | None = None) -> DataFrame:
        """Stores a folder of exports once, raw and unpacked; gives received, inserted and repeated records."""
        raw = self.spark.read.text(path).where("trim(value) <> ''")
        moment = F.lit(received_at).cast("timestamp") if received_at else F.current_timestamp()
        bronze = raw.select(F.xxhash64("value").alias("export_id"), moment.alias("received_at"), F.col("value").alias("export"))
        every = otlp.unpack(otlp.flatten(bronze.select(F.from_json("export", otlp.EXPORT_DDL).alias("e")).select("e.resourceLogs")), self.namespace)
        received = every.count()
        stored = self.store.read("logs")
        fresh = otlp.rebuild(bronze, self.namespace)
        if stored is not None:
            whole = F.col("session_id").isNotNull() & F.col("entry_id").isNotNull()
            fresh = fresh.where(whole).join(stored.select("session_id", "entry_id"), ["session_id", "entry_id"], "left_anti").select(fresh.columns).unionByName(fresh.where(~whole))
        fresh = fresh.withColumn("id", F.xxhash64("export_id", "session_id", "entry_id", "occurred_at", "body"))
        before = 0 if stored is None else stored.count()
        self.store.append("resources", otlp.new_dimension(fresh, self.store.read("resources"), "resource_fingerprint", ["resource"]))
        self.store.append("exports", bronze)
        self.store.append("logs", fresh.drop("resource"))
        inserted = self._table("logs").count() - before
        return self.spark.createDataFrame([(received, inserted, received - inserted)], "received long, inserted long, repeated long")

    def ingest_transcripts(self, harness: str, path: str, *, machine: str | None = None, cwd: str | None = None) -> DataFrame:
        """The records of a folder of session files, those not stored yet."""
        rows = transcripts.read(harness, transcripts.lines(self.spark, path), machine=machine, cwd=cwd)
        stored = self.store.read("logs")
        return otlp.new_rows(rows, stored, ["session_id", "entry_id"], ["file", "index"])

    def rebuild(self) -> None:
        """Unpacks all raw exports again into logs; times of arrival stay."""
        fresh = otlp.rebuild(self._table("exports"), self.namespace)
        self.store.overwrite("logs_rebuilt", fresh.withColumn("id", F.xxhash64("export_id", "session_id", "entry_id", "occurred_at", "body")).drop("resource"))

    def records(self, limit: int = PAGE, **equal: str | None) -> DataFrame:
        """The newest records, with the start of their bodies; equal filters scope_key, session_id, kind and the like."""
        rows = self._table("logs")
        for name, value in equal.items():
            if value is not None:
                rows = rows.where(F.col(name) == value)
        return rows.orderBy(F.desc_nulls_last("occurred_at"), F.desc("id")).limit(limit).withColumn("body", F.left("body", F.lit(200)))

    def classifications(self, kind: str | None = None, above: float = 0.0, limit: int = PAGE) -> DataFrame:
        """Readings at or above a score of one kind, highest first; without a kind the newest."""
        rows = self._table("readings")
        if kind is None:
            return rows.orderBy(F.desc("classified_at"), F.desc("id")).limit(limit)
        if kind not in memory.KINDS:
            raise ValueError(f"unknown kind {kind}")
        return rows.where(F.col(kind) >= above).orderBy(F.desc(kind), F.desc("id")).limit(limit)

    def reread(self, since, until, limit: int | None = None) -> DataFrame:
        """Prompts of a time range that a model may read again, in order."""
        rows = record.prompts(self._table("logs")).where((F.col("occurred_at") >= F.lit(since).cast("timestamp")) & (F.col("occurred_at") < F.lit(until).cast("timestamp"))).orderBy("occurred_at", "id")
        return rows if limit is None else rows.limit(limit)

    def classify(self, model: judge.Judge, rounds: int = record.ROUNDS) -> DataFrame:
        """Answers for every prompt without a reading, from its context window."""
        windows = record.context_windows(self._table("logs"), rounds=rounds)
        done = self.store.read("readings", "session_id string, entry_id string")
        wanted = record.backlog(windows, done, ["session_id", "entry_id"]).where("message <> ''")
        state = wanted.withColumn("state", F.to_json(F.struct("before", "message")))
        return judge.judged(state, "state", model, ["session_id", "entry_id"])

    def write(self, replies: DataFrame) -> DataFrame:
        """Statements from writers' replies (session_id, entry_id, kind, scope_key, said_at, questions_fingerprint, reply), new ones only.

        A reply holds a JSON array of {statement, everywhere, replaces}. A statement holds everywhere only if it says so.
        """
        items = replies.withColumn("item", F.explode(text.json_items(F.col("reply"), "statement string, everywhere boolean, replaces array<int>")))
        rows = items.select("session_id", "entry_id", "kind", F.when(F.col("item.everywhere"), F.lit(None)).otherwise(F.col("scope_key")).alias("scope_key"), "said_at", "questions_fingerprint", F.col("item.statement").alias("statement"), F.col("item.replaces").alias("replaces"))
        rows = rows.where(F.trim(F.coalesce("statement", F.lit(""))) != "")
        keys = ["session_id", "entry_id", "kind", "questions_fingerprint"]
        return insert_or_ignore(rows, self.store.read("statements", "session_id string, entry_id string, kind string, questions_fingerprint string"), keys, ["statement"])

    def statements(self, as_of=None) -> DataFrame:
        """The view of statements with their events folded in."""
        events = self.store.read("events", EVENTS)
        return view(self._table("statements"), events, None if as_of is None else F.lit(as_of).cast("timestamp"))

    def memories(self, scope_key: str | None = None, limit: int = PAGE, order: str = "rank", now=None) -> DataFrame:
        return recall.read(self.statements(), scope_key, self._now(now), order=order, limit=min(limit, PAGE))

    def recall(self, prompts: DataFrame, now=None, opening_limit: int = 0, **how) -> DataFrame:
        """What prompts (prompt_id, ask, model, vector, seen) are handed, by matching and, if asked for, by opening lists."""
        found = recall.match(prompts, self.statements(), self._now(now), **how).select("prompt_id", "memory_id", "rank", F.lit("match").alias("form"))
        if opening_limit:
            listed = recall.opening(prompts, self.statements(), self._now(now), opening_limit).select("prompt_id", "memory_id", "rank", F.lit("opening").alias("form"))
            found = found.unionByName(listed.join(found, ["prompt_id", "memory_id"], "left_anti"))
        return found

    def handout(self, found: DataFrame) -> DataFrame:
        """(prompt_id, answer): each prompt's handed statements as JSON."""
        rows = found.join(self.statements().select(F.col("id").alias("memory_id"), "statement", "kind", "scope_key", "actor", "actor_depth", "said_at"), "memory_id")
        item = F.struct("form", F.col("rank"), "memory_id", "statement", "kind", "scope_key", "actor", "actor_depth", "said_at")
        return rows.groupBy("prompt_id").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("answer"))

    def injections(self, limit: int = PAGE) -> DataFrame:
        return record.ranked_injections(self._table("injections")).orderBy(F.desc("injected_at"), F.desc("id")).limit(limit)

    def embed(self, model: str, limit: int | None = None) -> DataFrame:
        """(id, embedding): vectors for statements that lack one of this model."""
        rows = needs_embedding(self.statements(), model)
        rows = rows if limit is None else rows.orderBy("id").limit(limit)
        return rows.select("id", judge.embed(F.col("statement")).alias("embedding"))

    def merge(self, answers: DataFrame | None = None, now=None, **how) -> DataFrame:
        """The merges that the backlog gives: (scope_key, retired_id, survivor_id, reason)."""
        pairs = merging.similar_pairs(self.statements(), self._now(now), **how)
        return merging.fold(merging.decide(pairs, answers))

    def apply_merges(self, merges: DataFrame, run: str, at) -> None:
        """Appends a retired event for each merge whose two statements are both live."""
        wanted = retirements(merges.select(F.col("retired_id").alias("memory_id"), F.col("survivor_id").alias("survivor")), self.statements())
        self._event(wanted.withColumn("run", F.lit(run)), "retired", at)

    def end(self, wanted: DataFrame, at) -> None:
        """Ends live statements (memory_id, reason)."""
        self._event(endings(wanted, self.statements()), "ended", at)

    def undo(self, run: str, at=None, **window) -> DataFrame:
        """The statements that undoing a run restores; with a moment also restores them."""
        found = merging.undo(self.statements(), run, **window)
        if at is not None:
            self._event(found.select(F.col("id").alias("memory_id")), "restored", at)
        return found

    def _event(self, rows: DataFrame, what: str, at) -> None:
        events = self.store.read("events", EVENTS)
        last = events.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("m")).first()["m"]
        kinds = {f.name: f.dataType for f in events.schema.fields}
        filled = rows.withColumns({"seq": F.monotonically_increasing_id() + last + 1, "at": F.lit(at).cast("timestamp"), "what": F.lit(what)})
        for name, kind in kinds.items():
            if name not in filled.columns:
                filled = filled.withColumn(name, F.lit(None).cast(kind))
        self.store.append("events", filled.select(*[F.col(n).cast(k) for n, k in kinds.items()]))

    def usage(self, by: str = "day", since=None, until=None) -> DataFrame:
        bound = lambda m: None if m is None else F.lit(m).cast("timestamp")
        return ledger.usage(self._table("calls"), by, bound(since), bound(until))

    def model_calls(self, limit: int = PAGE, cursor: tuple | None = None, **equal) -> DataFrame:
        return ledger.calls_page(self._table("calls"), limit, cursor, **equal)

    def sweep(self, since, cap: int = 12) -> DataFrame:
        """Entries whose latest call failed, and whether they may be tried again."""
        return ledger.attempts(self._table("calls"), ["session_id", "entry_id"], F.lit(since).cast("timestamp"), cap)

    def next_label(self, after: int = 0) -> DataFrame:
        return record.next_unlabelled(self._table("label_pairs"), self._labels(), after)

    def label_progress(self) -> DataFrame:
        return record.progress(self._table("label_pairs"), self._labels())

    def label(self, rows: DataFrame) -> None:
        """Appends labels (session_id, entry_id, memory_id, label, labelled_at, id); the last one counts."""
        self.store.append("labels", rows)

    def _labels(self) -> DataFrame:
        return record.latest_labels(self.store.read("labels", "session_id string, entry_id string, memory_id long, label string, labelled_at timestamp, id long"))

    def sample(self, name: str, size: int, since, until, seed: int = 1) -> DataFrame:
        """A stratified sample of handed pairs by form and kind; pairs that are in it already are not drawn again."""
        pairs = record.candidate_pairs(self._table("injections"), self._table("logs"), self.statements(), F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp"))
        drawn = ledger.ordered_sample(pairs, ["form", "kind"], size, F.xxhash64(F.lit(seed), "session_id", "entry_id", "memory_id"))
        rows = drawn.select(F.lit(name).alias("sample"), "session_id", "entry_id", "memory_id", "form", "kind", "scope_key", F.xxhash64(F.lit(name), "session_id", "entry_id", "memory_id").alias("id"))
        had = self.store.read("label_pairs", "sample string, session_id string, entry_id string, memory_id long")
        return rows.join(had, ["sample", "session_id", "entry_id", "memory_id"], "left_anti")

    def context(self, session_id: str, page: int = 0) -> DataFrame:
        """The exchange of that page before a session's newest."""
        return record.exchanges(self._table("logs").where(F.col("session_id") == session_id)).where(F.col("page") == page)

    def late_panes(self) -> DataFrame:
        return panes.panes(panes.first_arrivals(self._table("logs").where("session_id is not null"), "occurred_at"), ["session_id"])

    def _now(self, now):
        return F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
