"""Session transcripts of coding harnesses, JSON lines in growing files, read as records.

A reader takes lines with their file and order and gives the columns of logs that a line can fill. Everything is
expressed over the lines: carry-forward of headers and directories is a window over a file, blocks are exploded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text

ORDER = ["block", "seq"]
#: Kinds of a block harness's own entries.
OWN_KINDS = {"ai-title": "title", "cost-state": "cost", "file-history-delta": "file_history", "file-history-snapshot": "file_history"}


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, seq, value): the lines of all *.jsonl files below path, with an order within each file."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value")


def entries(of: DataFrame, entries_before: int = 0) -> DataFrame:
    """Lines that are JSON objects, with v, the parsed entry, and index, its number in the file; others are left out."""
    parsed = of.withColumn("v", F.try_parse_json("value")).where("v is not null").where(F.schema_of_variant("v").startswith("OBJECT"))
    along = Window.partitionBy("file").orderBy(*ORDER)
    name = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"(?<=.)\.[^.]*\z", "")
    return parsed.withColumn("index", F.row_number().over(along) - 1 + entries_before).withColumn("file_id", name)


def _at(path: str, kind: str = "string", v: str = "v") -> Column:
    return F.try_variant_get(F.col(v), f"$.{path}", kind)


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _json(v: Column) -> Column:
    return F.to_json(v)


def _blocks(content: Column) -> Column:
    """Content as a list of blocks, each as JSON text; text that is no list is one text block."""
    single = F.array(F.to_json(F.struct(F.lit("text").alias("type"), F.coalesce(content.try_cast("string"), F.lit("")).alias("text"))))
    return F.when(_is(content, "ARRAY"), F.from_json(F.to_json(content), "array<string>")).otherwise(single)


def _field(block: Column, name: str) -> Column:
    return F.get_json_object(block, f"$.{name}")


def _joined(blocks: Column, of: str = "text") -> Column:
    """The texts of the blocks of a type, one a line."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: _field(b, "type") == of), lambda b: F.coalesce(_field(b, of), F.lit(""))), "\n")


def _results(blocks: Column) -> Column:
    """The text of every tool result: its content is text, or text blocks of its own."""

    def one(b: Column) -> Column:
        inner = F.from_json(_field(b, "content"), "array<string>")
        return F.when(_field(b, "content[0].type").isNotNull(), _joined(inner)).otherwise(_field(b, "content"))

    return F.array_join(F.filter(F.transform(F.filter(blocks, lambda b: _field(b, "type") == "tool_result"), one), lambda x: x.isNotNull()), "\n")


def _when(v: str, path: str) -> Column:
    """A time given as ISO text or as milliseconds; null if it is neither."""
    ms = _at(path, "double", v)
    return F.coalesce(F.when(_is(F.try_variant_get(F.col(v), f"$.{path}", "variant"), "STRING"), F.try_to_timestamp(_at(path, "string", v))), F.timestamp_micros(F.round(ms * 1000).cast("bigint")))


def _record(kind: Column | str, actor: Column | str, body: Column, within: Column | None = None, **more: Column) -> Column:
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    fields = {"operation": "string", "provider": "string", "model": "string", "response_model": "string", "tool_name": "string", "call": "string", "error_type": "string", "input_tokens": "bigint", "output_tokens": "bigint", "cache_read_tokens": "bigint", "cache_write_tokens": "bigint", "reasoning_tokens": "bigint", "cost_total": "decimal(12,6)"}
    return F.struct(
        as_col(kind).cast("string").alias("kind"),
        as_col(actor).cast("string").alias("actor"),
        F.coalesce(body, F.lit("")).alias("body"),
        (F.lit(None) if within is None else within).cast("string").alias("within"),
        *[more.get(name, F.lit(None)).try_cast(kind_).alias(name) for name, kind_ in fields.items()],
    )


def _finish(rows: DataFrame, harness: str, machine: str | None) -> DataFrame:
    """Records exploded, with their identity entry:kind:within and the attributes a call and its result join on."""
    flat = rows.withColumn("record", F.explode("records")).select("*", "record.*")
    call = F.when(F.col("call").isNotNull(), F.create_map(F.lit("gen_ai.tool.call.id"), F.col("call"))).otherwise(F.create_map().cast("map<string,string>"))
    return flat.select(
        "session_id", "previous_session", text.identity(F.col("entry"), F.col("kind"), F.col("within")).alias("entry_id"), F.lit(harness).alias("harness"), F.lit(machine).cast("string").alias("machine"), "occurred_at", "actor", "actor_depth", F.lit("person").alias("root"), "kind", "body",
        "operation", "provider", "model", "response_model", "tool_name", "error_type", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens", "cost_total", "working_directory", call.alias("attributes"), "file", "index",
    )


def read_blocks(of: DataFrame, machine: str | None = None, cwd: str | None = None, entries_before: int = 0) -> DataFrame:
    """Files without a header whose entries carry their session; a chunk from the middle reads like the whole file.

    A user entry with tool results is an agent's tool_result, another a prompt, the person's unless it is a side chain's.
    An assistant entry is a response, and a record for each thinking and tool_use block. The directory is the last one
    given in the session's run of entries, else the first of the file.
    """
    rows = entries(of, entries_before).withColumns({"session_id": F.nullif(_at("sessionId"), F.lit("")), "cwd": F.nullif(_at("cwd"), F.lit(""))})
    whole = Window.partitionBy("file").orderBy(*ORDER)
    rows = rows.withColumn("first_cwd", F.first("cwd", ignorenulls=True).over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).where("session_id is not null")
    rows = rows.withColumn("run", F.sum((~F.col("session_id").eqNullSafe(F.lag("session_id").over(whole))).cast("int")).over(whole.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("file", "run").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("working_directory", F.coalesce(F.last("cwd", ignorenulls=True).over(run), "first_cwd", F.lit(cwd)))
    rows = rows.withColumns({"type": _at("type"), "depth": F.when(F.coalesce(_at("isSidechain", "boolean"), F.lit(False)), 1).otherwise(0), "message": F.try_variant_get("v", "$.message", "variant")})
    rows = rows.withColumn("blocks", _blocks(F.try_variant_get("v", "$.message.content", "variant")))
    rows = rows.withColumn("occurred_at", F.coalesce(_when("v", "timestamp"), F.timestamp_micros(F.round(_at("message.timestamp", "double") * 1000).cast("bigint"))))
    blocks, model = F.col("blocks"), _at("message.model")
    result = F.exists(blocks, lambda b: F.coalesce(_field(b, "type") == "tool_result", F.lit(False)))
    failed = F.exists(blocks, lambda b: F.coalesce(_field(b, "is_error") == "true", F.lit(False)))
    user = F.when(result, F.array(_record("tool_result", "agent", _results(blocks), operation=F.lit("execute_tool"), error_type=F.when(failed, "tool_error")))).otherwise(F.array(_record("prompt", F.when(F.col("depth") == 0, "human").otherwise("agent"), _joined(blocks))))
    tokens = {c: _at(f"message.usage.{k}", "bigint") for c, k in (("input_tokens", "input_tokens"), ("output_tokens", "output_tokens"), ("cache_read_tokens", "cache_read_input_tokens"), ("cache_write_tokens", "cache_creation_input_tokens"))}
    response = F.array(_record("response", "agent", _joined(blocks), operation=F.lit("chat"), provider=F.when(model != "", "anthropic"), model=model, **tokens))
    thinking = F.transform(F.filter(blocks, lambda b: _field(b, "type") == "thinking"), lambda b, i: _record("thinking", "agent", _field(b, "thinking"), i, model=model))
    calls = F.transform(F.filter(blocks, lambda b: _field(b, "type") == "tool_use"), lambda b: _record("tool_call", "agent", F.coalesce(_field(b, "input"), F.lit("{}")), _field(b, "id"), operation=F.lit("execute_tool"), tool_name=_field(b, "name"), call=_field(b, "id")))
    own = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in OWN_KINDS.items() for x in kv]), F.col("type")), F.lit("bookkeeping"))
    rest = F.array(_record(own, "system", F.col("value"), cost_total=_at("totalCostUSD")))
    records = F.when(F.col("type") == "user", user).when(F.col("type") == "assistant", F.concat(response, thinking, calls)).when(F.col("type") == "attachment", F.array(_record("attachment", "system", _json(F.try_variant_get("v", "$.attachment", "variant"))))).when(F.col("type") == "system", F.array(_record("system", "system", F.coalesce(_json(F.col("message")), F.lit("{}"))))).otherwise(rest)
    entry = F.coalesce(F.nullif(_at("uuid"), F.lit("")), F.concat("file_id", F.lit(":line-"), F.col("index").cast("string")))
    return _finish(rows.withColumns({"records": records, "entry": entry, "actor_depth": F.col("depth"), "previous_session": F.lit(None).cast("string")}), "claude-code", machine)


def read_rollout(of: DataFrame, machine: str | None = None, cwd: str | None = None, entries_before: int = 0) -> DataFrame:
    """Files opened by a session_meta line; later lines dispatch on (type, payload.type). A turn_context moves the directory.

    An entry's id is its payload's, else rollout:ordinal, else rollout:line-N.
    """
    rows = entries(of, entries_before).withColumns({"type": _at("type"), "what": _at("payload.type")})
    meta = F.col("type") == "session_meta"
    along = Window.partitionBy("file").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    header = F.when(meta, F.struct(F.coalesce(_at("payload.session_id"), _at("payload.id")).alias("session_id"), _at("payload.id").alias("rollout"), F.coalesce(_at("payload.cwd"), F.lit(cwd)).alias("cwd")))
    rows = rows.withColumn("header", F.last(header, ignorenulls=True).over(along)).withColumn("run", F.count(F.when(meta, 1)).over(along)).where("header is not null")
    run = Window.partitionBy("file", "run").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    moved = F.when(F.col("type") == "turn_context", F.nullif(_at("payload.cwd"), F.lit("")))
    rows = rows.withColumn("working_directory", F.coalesce(F.last(moved, ignorenulls=True).over(run), F.col("header.cwd"))).where("type is null or type not in ('session_meta', 'turn_context')")
    content = F.try_variant_get("v", "$.payload.content", "variant")
    texts = lambda v: F.array_join(F.transform(F.filter(F.from_json(F.to_json(v), "array<string>"), lambda b: _field(b, "text").isNotNull()), lambda b: _field(b, "text")), "\n")
    body = F.when(_is(content, "STRING"), content.try_cast("string")).when(_is(content, "ARRAY"), texts(content)).otherwise("")
    output = F.try_variant_get("v", "$.payload.output", "variant")
    result = F.when(_is(output, "STRING"), output.try_cast("string")).when(_is(output, "ARRAY"), texts(output)).otherwise("")
    summary = F.try_variant_get("v", "$.payload.summary", "variant")
    role, tool = _at("payload.role"), {"operation": F.lit("execute_tool"), "call": _at("payload.call_id")}
    counts = F.coalesce(_is(F.try_variant_get("v", "$.payload.info.last_token_usage", "variant"), "OBJECT"), F.lit(False))
    count = lambda k: F.when(counts, _at(f"payload.info.last_token_usage.{k}", "bigint")).otherwise(_at(f"payload.info.total_token_usage.{k}", "bigint"))
    usage = {c: count(k) for c, k in (("input_tokens", "input_tokens"), ("output_tokens", "output_tokens"), ("cache_read_tokens", "cached_input_tokens"), ("cache_write_tokens", "cache_write_input_tokens"), ("reasoning_tokens", "reasoning_output_tokens"))}
    own = _record("bookkeeping", "system", F.coalesce(_json(F.try_variant_get("v", "$.payload", "variant")), F.lit("{}")))
    message = F.when(role == "assistant", _record("response", "agent", body, operation=F.lit("chat"))).when(role.isin("developer", "system"), _record("system", "system", body)).otherwise(_record("prompt", "human", body))
    item = (
        F.when(F.col("what") == "message", message)
        .when(F.col("what") == "reasoning", _record("thinking", "agent", F.when(_is(summary, "ARRAY"), texts(summary))))
        .when(F.col("what").isin("custom_tool_call", "function_call"), _record("tool_call", "agent", F.coalesce(F.nullif(_at("payload.input"), F.lit("")), _at("payload.arguments")), tool_name=_at("payload.name"), **tool))
        .when(F.col("what").isin("custom_tool_call_output", "function_call_output"), _record("tool_result", "agent", result, **tool))
        .when(F.col("what") == "token_count", _record("usage", "system", F.coalesce(_json(F.try_variant_get("v", "$.payload.info", "variant")), F.lit("{}")), **usage))
        .otherwise(own)
    )
    event = F.when(F.col("what") == "user_message", _record("prompt", "human", _at("payload.message"))).when(F.col("what") == "agent_message", _record("response", "agent", _at("payload.message"))).otherwise(own)
    record = F.when(F.col("type") == "response_item", item).when(F.col("type") == "event_msg", event).otherwise(own)
    place = F.coalesce(F.nullif(F.col("header.rollout"), F.lit("")), "file_id")
    own_id = F.when(_is(F.try_variant_get("v", "$.payload.id", "variant"), "STRING"), F.nullif(_at("payload.id"), F.lit("")))
    entry = F.coalesce(own_id, F.concat(place, F.lit(":"), _at("ordinal")), F.concat(place, F.lit(":line-"), F.col("index").cast("string")))
    return _finish(rows.withColumns({"records": F.array(record), "entry": entry, "occurred_at": _when("v", "timestamp"), "session_id": F.col("header.session_id"), "actor_depth": F.lit(0), "previous_session": F.lit(None).cast("string")}), "codex", machine)


def read_messages(of: DataFrame, machine: str | None = None, cwd: str | None = None, entries_before: int = 0) -> DataFrame:
    """Files opened by a session line; message lines dispatch on their role."""
    rows = entries(of, entries_before).withColumn("type", _at("type"))
    along = Window.partitionBy("file").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    header = F.when(F.col("type") == "session", F.struct(_at("id").alias("session_id"), F.coalesce(_at("cwd"), F.lit(cwd)).alias("cwd"), text.session_in_path(_at("parentSession")).alias("previous")))
    rows = rows.withColumn("header", F.last(header, ignorenulls=True).over(along)).where("header is not null and type = 'message'")
    rows = rows.where(_is(F.try_variant_get("v", "$.message", "variant"), "OBJECT")).withColumn("blocks", _blocks(F.try_variant_get("v", "$.message.content", "variant")))
    blocks, role, model = F.col("blocks"), _at("message.role"), _at("message.model")
    usage = {c: _at(f"message.usage.{k}", "bigint") for c, k in (("input_tokens", "input"), ("output_tokens", "output"), ("cache_read_tokens", "cacheRead"), ("cache_write_tokens", "cacheWrite"), ("reasoning_tokens", "reasoning"))}
    response = F.array(_record("response", "agent", _joined(blocks), operation=F.lit("chat"), provider=_at("message.provider"), model=model, response_model=F.coalesce(F.nullif(_at("message.responseModel"), F.lit("")), model), cost_total=_at("message.usage.cost.total"), **usage))
    thinking = F.transform(F.filter(blocks, lambda b: _field(b, "type") == "thinking"), lambda b, i: _record("thinking", "agent", _field(b, "thinking"), i, operation=F.lit("chat"), model=model))
    calls = F.transform(F.filter(blocks, lambda b: _field(b, "type") == "toolCall"), lambda b: _record("tool_call", "agent", F.coalesce(_field(b, "arguments"), F.lit("{}")), _field(b, "id"), operation=F.lit("execute_tool"), tool_name=_field(b, "name"), call=_field(b, "id")))
    result = _record("tool_result", "agent", _joined(blocks), operation=F.lit("execute_tool"), tool_name=_at("message.toolName"), call=_at("message.toolCallId"), error_type=F.when(_at("message.isError", "boolean"), "tool_error"))
    system = _record("system", "system", F.coalesce(_json(F.try_variant_get("v", "$.message.sections", "variant")), _json(F.try_variant_get("v", "$.message.content", "variant")), F.lit('""')))
    records = F.when(role == "user", F.array(_record("prompt", "human", _joined(blocks)))).when(role == "assistant", F.concat(response, thinking, calls)).when(role == "toolResult", F.array(result)).when(role == "system", F.array(system))
    return _finish(rows.withColumns({"records": records, "entry": _at("id"), "occurred_at": _when("v", "message.timestamp"), "session_id": F.col("header.session_id"), "working_directory": F.col("header.cwd"), "actor_depth": F.lit(0), "previous_session": F.col("header.previous")}), "pi", machine)


#: The readers by harness, and those that can start in the middle of a file; add a reader here.
READERS: dict[str, Callable[..., DataFrame]] = {"claude-code": read_blocks, "codex": read_rollout, "pi": read_messages}
FROM_THE_MIDDLE = {"claude-code"}


def read(harness: str, of: DataFrame, *, machine: str | None = None, cwd: str | None = None, entries_before: int = 0) -> DataFrame:
    """The records of lines by a harness's reader; an unknown harness, or a middle chunk of files with a header, is an error."""
    if harness not in READERS:
        raise ValueError(f"no reader for {harness}")
    if entries_before and harness not in FROM_THE_MIDDLE:
        raise ValueError(f"{harness} files can't be read from the middle")
    return READERS[harness](of, machine, cwd, entries_before)
