"""OTLP log exports as JSON: read, flattened to records, unpacked to the columns of logs, stored once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text

PAIRS = "array<struct<key:string,value:string>>"
#: A value of any type is read as the text of its JSON object and decoded by any_text.
EXPORT_DDL = (
    f"""resourceLogs array<struct<resource:struct<attributes:{PAIRS}>, scopeLogs:array<struct<scope:struct<name:string,version:string,attributes:{PAIRS}>,
    logRecords:array<struct<timeUnixNano:string,observedTimeUnixNano:string,severityText:string,severityNumber:string,traceId:string,spanId:string,body:string,attributes:{PAIRS}>>>>>>"""
)
NESTING = 4
#: The attribute of each lifted column; own/ stands for the producer's namespace.
TEXTS = {
    "session_id": "session.id", "previous_session": "session.previous_id", "entry_id": "own/entry.id", "harness": "gen_ai.agent.name", "machine": "host.name", "actor": "own/actor", "root": "own/root", "kind": "own/kind",
    "operation": "gen_ai.operation.name", "provider": "gen_ai.provider.name", "model": "gen_ai.request.model", "response_model": "gen_ai.response.model", "tool_name": "gen_ai.tool.name", "scope_key": "own/scope", "scope_kind": "own/scope.kind",
    "repository": "vcs.repository.url.full", "owner": "vcs.owner.name", "revision": "vcs.ref.head.revision", "working_directory": "process.working_directory", "error_type": "error.type",
}
NUMBERS = {
    "actor_depth": ("own/actor.depth", "int"), "input_tokens": ("gen_ai.usage.input_tokens", "bigint"), "output_tokens": ("gen_ai.usage.output_tokens", "bigint"), "cache_read_tokens": ("gen_ai.usage.cache_read.input_tokens", "bigint"),
    "cache_write_tokens": ("gen_ai.usage.cache_write.input_tokens", "bigint"), "reasoning_tokens": ("gen_ai.usage.reasoning.output_tokens", "bigint"), "cost_total": ("own/cost.total", "decimal(12,6)"),
}


def exports(spark: SparkSession, path: str, *, stream: bool = False) -> DataFrame:
    """Exports from a folder of JSON files, one export a line, with the declared schema; never inferred."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(EXPORT_DDL).json(path)


def _quoted(s: Column) -> Column:
    """The string as JSON text."""
    whole = F.to_json(F.struct(s.alias("s")))
    return F.when(s.isNotNull(), F.substring(whole, 6, F.length(whole) - 6))


def _json(v: Column, depth: int) -> Column:
    """The plain JSON of an AnyValue's text, lists and maps down to depth; deeper ones stay as they came."""
    at = lambda k: F.get_json_object(v, f"$.{k}")
    out = F.when(at("stringValue").isNotNull(), _quoted(at("stringValue"))).when(at("intValue").isNotNull(), at("intValue")).when(at("doubleValue").isNotNull(), at("doubleValue")).when(at("boolValue").isNotNull(), at("boolValue"))
    if depth:
        # one list of (key, value) for both, so that the expression grows with depth and not with its power
        items = F.from_json(at("arrayValue.values"), "array<string>")
        pairs = F.from_json(at("kvlistValue.values"), PAIRS)
        listed = F.transform(items, lambda x: F.named_struct(F.lit("key"), F.lit(None).cast("string"), F.lit("value"), x))
        inner = F.transform(F.coalesce(pairs, listed, F.array().cast(PAIRS)), lambda p: F.concat(F.coalesce(F.concat(_quoted(p["key"]), F.lit(": ")), F.lit("")), F.coalesce(_json(p["value"], depth - 1), F.lit("null"))))
        mapped = at("kvlistValue").isNotNull()
        out = out.when(mapped | at("arrayValue").isNotNull(), F.concat(F.when(mapped, "{").otherwise("["), F.array_join(inner, ", "), F.when(mapped, "}").otherwise("]")))
    return out.otherwise(v if depth == 0 else F.lit(None).cast("string"))


def any_text(v: Column) -> Column:
    """An AnyValue as text: strings as they are, True and False, numbers, JSON for lists and maps; null for an unknown type."""
    at = lambda k: F.get_json_object(v, f"$.{k}")
    plain = F.coalesce(at("stringValue"), at("intValue"), at("doubleValue"), F.initcap(at("boolValue")))
    return text.clean_nul(F.coalesce(plain, _json(v, NESTING)))


def as_map(pairs: Column) -> Column:
    """Key-value pairs as a map; of a key listed again the last counts; a key without value is kept with null."""
    keys = F.transform(pairs, lambda p: p["key"])
    last = F.filter(pairs, lambda p, i: p["key"].isNotNull() & ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), p["key"]))
    return F.coalesce(F.map_from_entries(F.transform(last, lambda p: F.struct(p["key"].alias("key"), any_text(p["value"]).alias("value")))), F.create_map().cast("map<string,string>"))


def flatten(rows: DataFrame) -> DataFrame:
    """One row per record: resource, scope_name, scope_version, scope_attributes, record."""
    resources = rows.select(F.explode("resourceLogs").alias("r"))
    scopes = resources.select(as_map(F.col("r.resource.attributes")).alias("resource"), F.explode("r.scopeLogs").alias("s"))
    return scopes.select("resource", F.col("s.scope.name").alias("scope_name"), F.col("s.scope.version").alias("scope_version"), as_map(F.col("s.scope.attributes")).alias("scope_attributes"), F.explode("s.logRecords").alias("record"))


def unpack(records: DataFrame, namespace: str = "memory", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns of logs, but for ids and arrival, and resource with its fingerprint.

    An attribute of the record hides the resource's, also when it is null. Numbers that are none become null.
    namespace is the prefix of the producer's own attributes; keep names columns to carry along.
    """
    # exploded from an array of one, so that the optimizer can't repeat the map in each of the columns lifted from it
    rows = records.select("*", F.explode(F.array(as_map(F.col("record.attributes")))).alias("attributes"), any_text(F.col("record.body")).alias("body"))
    named = lambda k: k.replace("own/", f"{namespace}.")
    get = lambda k: F.when(F.map_contains_key("attributes", F.lit(named(k))), F.try_element_at("attributes", F.lit(named(k)))).otherwise(F.try_element_at("resource", F.lit(named(k))))
    return rows.select(
        *keep,
        "resource",
        text.fingerprint(F.col("resource")).alias("resource_fingerprint"),
        "scope_name",
        "scope_version",
        text.nanos_time(F.col("record.timeUnixNano")).alias("occurred_at"),
        text.nanos_time(F.col("record.observedTimeUnixNano")).alias("observed_at"),
        F.col("record.severityText").alias("severity"),
        F.col("record.severityNumber").try_cast("smallint").alias("severity_number"),
        F.col("record.traceId").alias("trace_id"),
        F.col("record.spanId").alias("span_id"),
        "body",
        "attributes",
        *[get(k).alias(c) for c, k in TEXTS.items()],
        *[text.lenient(get(k), kind).alias(c) for c, (k, kind) in NUMBERS.items()],
    )


def new_rows(rows: DataFrame, stored: DataFrame | None, keys: list[str], order: list[str]) -> DataFrame:
    """Rows to append: of equal non-null keys the first by order, and only if not stored yet; rows with a null key all.

    Nulls never conflict, though grouping would take them as equal; an anti-join keeps them.
    """
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    others = [c for c in rows.columns if c not in keys]
    # a row with a null key is a group of its own, so that the rows are read once
    marked = rows.withColumn("__own", F.when(~whole, F.monotonically_increasing_id()))
    first = marked.groupBy(*keys, "__own").agg(F.min_by(F.struct(*others), F.struct(*order)).alias("row")).select(*keys, "row.*").select(rows.columns)
    if stored is not None:
        first = first.join(stored.select(*keys), keys, "left_anti").select(rows.columns)
    return first


def new_dimension(rows: DataFrame, stored: DataFrame | None, fingerprint: str, value: list[str]) -> DataFrame:
    """(id, fingerprint, value...): dimension rows not stored yet; the id is a hash of the fingerprint, so it needs no counter."""
    once = rows.where(F.col(fingerprint).isNotNull()).groupBy(F.col(fingerprint).alias("fingerprint")).agg(*[F.any_value(v).alias(v) for v in value])
    if stored is not None:
        once = once.join(stored.select("fingerprint"), "fingerprint", "left_anti")
    return once.select(F.xxhash64("fingerprint").alias("id"), "fingerprint", *value)


def rebuild(bronze: DataFrame, namespace: str = "memory") -> DataFrame:
    """logs as a pure function of the raw exports (export_id, received_at, export as JSON text), in one distributed scan."""
    parsed = bronze.select("export_id", "received_at", F.from_json("export", EXPORT_DDL).alias("e")).select("export_id", "received_at", "e.resourceLogs")
    resources = parsed.select("export_id", "received_at", F.explode("resourceLogs").alias("r"))
    scopes = resources.select("export_id", "received_at", as_map(F.col("r.resource.attributes")).alias("resource"), F.posexplode("r.scopeLogs").alias("s_at", "s"))
    flat = scopes.select("export_id", "received_at", "resource", F.col("s.scope.name").alias("scope_name"), F.col("s.scope.version").alias("scope_version"), "s_at", F.posexplode("s.logRecords").alias("r_at", "record"))
    rows = unpack(flat, namespace, keep=("export_id", "received_at", "s_at", "r_at"))
    return new_rows(rows, None, ["session_id", "entry_id"], ["received_at", "export_id", "s_at", "r_at"]).drop("s_at", "r_at")
