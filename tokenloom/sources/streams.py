"""Saved presentation streams of three kinds of producer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.text import PREVIEW_CHARS, target_label, truncate
from tokenloom.sources import variant as j

SURFACES = ["codex-exec", "codex-app-server", "claude-stream"]

# Records that only describe progress.
EXEC_PROGRESS = ["item.started", "item.updated", "turn.failed", "error"]
SERVER_PROGRESS = [
    "turn/completed",
    "item/started",
    "item/agentMessage/delta",
    "item/reasoning/summaryTextDelta",
    "item/commandExecution/outputDelta",
]
STREAM_EVENTS = [
    "message_start",
    "message_delta",
    "message_stop",
    "content_block_start",
    "content_block_delta",
    "content_block_stop",
    "ping",
]


class StreamError(ValueError):
    pass


@dataclass(frozen=True)
class StreamImport:
    events: DataFrame
    usage: DataFrame
    rejected: DataFrame


def _event(kind, **fields: Column) -> Column:
    names = ["role", "preview", "char_len", "redacted", "tool", "call_id", "target", "is_error", "subtype", "label", "mechanism"]
    types = {"char_len": "bigint", "redacted": "boolean", "is_error": "boolean"}
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    return F.struct(
        kind.alias("kind"),
        *[fields.get(n, F.lit(None)).cast(types.get(n, "string")).alias(n) for n in names],
    )


def _said(role, text: Column) -> Column:
    role = role if isinstance(role, Column) else F.lit(role)
    return _event("message", role=role, preview=truncate(text, PREVIEW_CHARS), char_len=F.length(text))


def _progress(subtype) -> Column:
    return _event("session_event", subtype=subtype if isinstance(subtype, Column) else F.lit(subtype))


def _finalized(item: Column, camel: bool) -> Column:
    """A completed item; repeats of its id are handled by the caller."""
    kind = j.text(item, "$.type")
    text = F.coalesce(j.text(item, "$.text"), F.lit(""))
    blocks = j.items(item, "$.content")
    user_text = F.array_join(F.transform(blocks, lambda b: j.text(b, "$.text")), "\n")
    output = F.coalesce(j.text(item, "$.aggregatedOutput" if camel else "$.aggregated_output"), F.lit(""))
    code = F.try_variant_get(item, "$.exitCode" if camel else "$.exit_code", "bigint")
    if camel:
        thought = F.coalesce(
            F.aggregate(
                F.try_variant_get(item, "$.summary", "array<string>"), F.lit(0), lambda a, s: a + F.coalesce(F.length(s), F.lit(0))
            ),
            F.lit(0),
        )
    else:
        thought = F.length(text)
    return (
        F.when(kind.isin("agent_message", "agentMessage"), _said("assistant", text))
        .when(
            (kind == "userMessage") & blocks.isNotNull() & F.forall(blocks, lambda b: F.coalesce(j.text(b, "$.type") == "text", F.lit(False))),
            _said("user", user_text),
        )
        .when(kind == "reasoning", _event("reasoning", char_len=thought, redacted=F.lit(False)))
        .when(
            kind.isin("command_execution", "commandExecution"),
            _event(
                "tool_result",
                tool=F.lit("shell"),
                call_id=j.text(item, "$.id"),
                char_len=F.length(output),
                is_error=F.coalesce(code != 0, F.lit(False)),
            ),
        )
        .when(kind.isin("todo_list", "plan", "error"), _progress("presentation-item"))
        .otherwise(_event("unrecognised"))
    )


def _graph_message(message: Column, role: Column) -> Column:
    """``array<event>`` of a message: one per block, at least one."""
    text = j.plain_text(message, "$.content")
    blocks = j.items(message, "$.content")

    def one(b: Column) -> Column:
        kind = j.text(b, "$.type")
        thinking = j.text(b, "$.thinking")
        return (
            F.when(kind == "text", _said(role, F.coalesce(j.text(b, "$.text"), F.lit(""))))
            .when(
                kind == "thinking",
                _event(
                    "reasoning",
                    char_len=F.coalesce(F.length(thinking), F.lit(0)),
                    redacted=F.coalesce(F.length(thinking), F.lit(0)) == 0,
                ),
            )
            .when(kind == "redacted_thinking", _event("reasoning", char_len=F.lit(0), redacted=F.lit(True)))
            .when(
                kind == "tool_use",
                _event(
                    "tool_call",
                    tool=F.coalesce(j.text(b, "$.name"), F.lit("unknown")),
                    call_id=j.text(b, "$.id"),
                    char_len=F.coalesce(F.length(j.json_of(b, "$.input")), F.lit(0)),
                    target=target_label(j.json_of(b, "$.input")),
                ),
            )
            .when(
                kind == "tool_result",
                _event(
                    "tool_result",
                    call_id=j.text(b, "$.tool_use_id"),
                    char_len=F.coalesce(F.length(j.plain_text(b, "$.content")), F.lit(0)),
                    is_error=j.flag(b, "$.is_error"),
                ),
            )
            .when(
                kind.isin("image", "document"),
                _event(
                    "context_injection",
                    mechanism=F.lit("stream-media"),
                    label=F.lit("Media/document block [tokens unmeasured]"),
                    char_len=F.lit(0),
                ),
            )
            .otherwise(_event("unrecognised"))
        )

    return (
        F.when(text.isNotNull(), F.array(_said(role, text)))
        .when(F.size(blocks) > 0, F.transform(blocks, one))
        .otherwise(F.array(_event("unrecognised")))
    )


def import_stream(lines: DataFrame, surface: str, version: str) -> StreamImport:
    """Events and usage of captured streams; inconsistent captures are rejected whole.

    ``lines``: ``file``, ``line_no``, ``raw``.  A capture that mixes sessions,
    contradicts the declared producer version or names no session is listed in
    ``rejected``.  Usage keeps its scope and is never added up across scopes.
    """
    if surface not in SURFACES:
        raise StreamError(f"unknown surface '{surface}'; expected one of: {', '.join(SURFACES)}")
    if not version.strip():
        raise StreamError("a captured producer version is required")
    v = F.col("v")
    opened = lines.withColumn("v", F.try_parse_json("raw"))
    kind = F.coalesce(j.text(v, "$.type"), F.lit("unreadable"))
    nothing = F.lit(None)
    item = request = declared = nothing.cast("string")
    if surface == "codex-exec":
        ident = j.text(v, "$.thread_id")
        completed = kind == "item.completed"
        item_v = j.part(v, "$.item")
        item = F.when(completed, j.text(item_v, "$.id"))
        raw_type = F.when(completed, F.concat(F.lit("item.completed/"), F.coalesce(j.text(item_v, "$.type"), F.lit("unknown")))).otherwise(kind)
        parsed = (
            F.when(kind == "thread.started", _event("session_started"))
            .when(kind == "turn.started", _event("turn_started"))
            .when(kind == "turn.completed", _progress("turn.completed"))
            .when(completed, F.when(item.isNull(), _event("unrecognised")).otherwise(_finalized(item_v, False)))
            .when(kind.isin(*EXEC_PROGRESS), _progress(kind))
            .otherwise(_event("unrecognised"))
        )
        kinds = F.array(parsed)
        scope = F.when((kind == "turn.completed") & j.present(v, "$.usage"), "turn-aggregate")
        reported = j.part(v, "$.usage")
    elif surface == "codex-app-server":
        method = F.coalesce(j.text(v, "$.method"), F.lit("rpc-response"))
        ident = F.coalesce(j.text(v, "$.params.threadId"), j.text(v, "$.params.thread.id"))
        completed = method == "item/completed"
        item_v = j.part(v, "$.params.item")
        item = F.when(completed, j.text(item_v, "$.id"))
        raw_type = F.when(v.isNull(), "unreadable").otherwise(
            F.when(completed, F.concat(F.lit("item/completed/"), F.coalesce(j.text(item_v, "$.type"), F.lit("unknown")))).otherwise(method)
        )
        answer = (method == "rpc-response") & j.present(v, "$.id") & (j.present(v, "$.result") | j.present(v, "$.error"))
        parsed = (
            F.when(method == "thread/started", _event("session_started"))
            .when(method == "turn/started", _event("turn_started"))
            .when(completed, F.when(item.isNull(), _event("unrecognised")).otherwise(_finalized(item_v, True)))
            .when((method == "thread/tokenUsage/updated") | method.isin(*SERVER_PROGRESS) | answer, _progress(method))
            .otherwise(_event("unrecognised"))
        )
        kinds = F.array(parsed)
        scope = F.when(
            (method == "thread/tokenUsage/updated") & j.present(v, "$.params.tokenUsage.last"), "last-request-snapshot"
        )
        reported = j.part(v, "$.params.tokenUsage.last")
    else:
        child = j.present(v, "$.parent_tool_use_id") & (j.json_of(v, "$.parent_tool_use_id") != "null")
        child = F.coalesce(child, F.lit(False))
        ident = F.when(~child, j.text(v, "$.session_id"))
        speaks = kind.isin("assistant", "user")
        nested = F.coalesce(j.text(v, "$.event.type"), F.lit("unknown"))
        raw_type = (
            F.when(kind == "system", F.concat(F.lit("system/"), F.coalesce(j.text(v, "$.subtype"), F.lit("unknown"))))
            .when(kind == "stream_event", F.concat(F.lit("stream_event/"), nested))
            .otherwise(kind)
        )
        init = raw_type == "system/init"
        declared = F.when(init, j.text(v, "$.claude_code_version"))
        single = (
            F.when(init, _event("session_started"))
            .when(speaks & child, _progress("subagent-message"))
            .when(kind.isin("result", "rate_limit_event"), _progress(kind))
            .when((kind == "stream_event") & nested.isin(*STREAM_EVENTS), _progress(F.concat(F.lit("stream_event/"), nested)))
            .otherwise(_event("unrecognised"))
        )
        role = F.when(kind == "user", "user").otherwise("assistant")
        kinds = F.when(speaks & ~child, _graph_message(j.part(v, "$.message"), role)).otherwise(F.array(single))
        request = F.when(speaks & ~child & j.present(v, "$.message.usage"), F.coalesce(j.text(v, "$.request_id"), j.text(v, "$.message.id")))
        scope = F.when(request.isNotNull(), "request").when((kind == "result") & j.present(v, "$.usage"), "session-aggregate")
        reported = F.when(request.isNotNull(), j.part(v, "$.message.usage")).otherwise(j.part(v, "$.usage"))
    rows = opened.select(
        "file",
        "line_no",
        ident.alias("ident"),
        declared.alias("declared"),
        item.alias("item_id"),
        request.alias("request_id"),
        raw_type.alias("raw_type"),
        F.when(v.isNull(), F.array(_event("unrecognised"))).otherwise(kinds).alias("kinds"),
        scope.alias("scope"),
        F.to_json(reported).alias("reported"),
    )
    checks = rows.groupBy("file").agg(
        F.min("ident").alias("first_id"),
        F.max("ident").alias("last_id"),
        F.bool_or(F.coalesce(F.col("declared") != version, F.lit(False))).alias("other_version"),
    )
    bad = checks.withColumn(
        "reason",
        F.when((F.col("first_id") != F.col("last_id")) | F.col("other_version"), "more than one session, or another producer version than declared").when(
            F.col("first_id").isNull(), "no session identity for this kind of stream"
        ),
    ).where(F.col("reason").isNotNull())
    good = rows.join(bad.select("file"), "file", "left_anti")
    named = checks.select("file", F.col("first_id").alias("session_id"))
    first_of = lambda key: (
        good.where(F.col(key).isNotNull()).groupBy("file", key).agg(F.min("line_no").alias("first_line"))
    )
    repeat = _progress("repeated-finalized-item")
    marked = good.join(first_of("item_id"), ["file", "item_id"], "left")
    again = F.coalesce(F.col("first_line") < F.col("line_no"), F.lit(False))
    events = (
        marked.withColumn("kinds", F.when(again, F.array(repeat)).otherwise(F.col("kinds")))
        .select("file", "line_no", "raw_type", F.posexplode("kinds").alias("block", "e"))
        .join(named, "file")
        .select(
            "file",
            "session_id",
            "line_no",
            F.col("block").cast("bigint").alias("block"),
            F.when(F.col("block") > 0, F.concat(F.lit("claude-message/block-"), F.col("block").cast("string")))
            .otherwise(F.col("raw_type"))
            .alias("raw_type"),
            "e.*",
        )
    )
    once = good.join(first_of("request_id"), ["file", "request_id"], "left").where(
        F.col("request_id").isNull() | (F.col("first_line") == F.col("line_no"))
    )
    usage = once.where(F.col("scope").isNotNull()).select("file", "line_no", "scope", "reported")
    return StreamImport(events, usage, bad.select("file", "reason"))
