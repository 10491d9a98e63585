"""Normalise the straight session format into events."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.functions.text import PREVIEW_CHARS, collapse_whitespace, file_target, file_target_dir, strip, target_label, truncate
from tokenloom.functions.text import TARGET_CHARS
from tokenloom.functions.usage import cached_split, usage_struct
from tokenloom.schema import AGENT_LINEAR, TOOL_OP
from tokenloom.sources import variant as j
from tokenloom.sources.events import conform
from tokenloom.sources.lines import is_oversized, parsed, sniffed_type

# Notices the agent is known to write.
KNOWN_EVENT_MESSAGES = [
    "error",
    "warning",
    "auth_recovery_started",
    "auth_recovery_completed",
    "guardian_warning",
    "realtime_conversation_started",
    "realtime_conversation_realtime",
    "realtime_conversation_closed",
    "realtime_conversation_sdp",
    "model_reroute",
    "model_verification",
    "turn_moderation_metadata",
    "safety_buffering",
    "context_compacted",
    "turn_started",
    "thread_settings_applied",
    "turn_complete",
    "agent_message",
    "user_message",
    "agent_reasoning",
    "agent_reasoning_raw_content",
    "agent_reasoning_section_break",
    "session_configured",
    "environment_connected",
    "environment_disconnected",
    "thread_goal_updated",
    "thread_queue_changed",
    "mcp_startup_update",
    "mcp_startup_complete",
    "mcp_tool_call_begin",
    "mcp_tool_call_end",
    "web_search_begin",
    "web_search_end",
    "image_generation_begin",
    "image_generation_end",
    "exec_command_begin",
    "exec_command_output_delta",
    "terminal_interaction",
    "exec_command_end",
    "view_image_tool_call",
    "exec_approval_request",
    "request_permissions",
    "request_user_input",
    "dynamic_tool_call_request",
    "dynamic_tool_call_response",
    "elicitation_request",
    "apply_patch_approval_request",
    "guardian_assessment",
    "deprecation_notice",
    "stream_error",
    "patch_apply_begin",
    "patch_apply_updated",
    "patch_apply_end",
    "turn_diff",
    "realtime_conversation_list_voices_response",
    "plan_update",
    "turn_aborted",
    "shutdown_complete",
    "entered_review_mode",
    "exited_review_mode",
    "raw_response_completed",
    "item_started",
    "item_completed",
    "hook_started",
    "hook_completed",
    "agent_message_content_delta",
    "plan_delta",
    "reasoning_content_delta",
    "reasoning_raw_content_delta",
    "collab_agent_spawn_begin",
    "collab_agent_spawn_end",
    "collab_agent_interaction_begin",
    "collab_agent_interaction_end",
    "collab_waiting_begin",
    "collab_waiting_end",
    "collab_close_begin",
    "collab_close_end",
    "collab_resume_begin",
    "collab_resume_end",
    "sub_agent_activity",
    "task_started",
    "task_complete",
]
PLAIN_RECORDS = ["world_state", "inter_agent_communication_metadata", "token_usage_record"]
RETAINED = ["verified_answer", "delivered_assistant_message"]
OUTPUTS = ["function_call_output", "custom_tool_call_output", "tool_search_output"]
CALLS = ["function_call", "custom_tool_call", "tool_search_call"]
TEXT_KEYS = ["text", "input_text", "output_text"]
MEDIA_KEYS = ["image_url", "audio_url", "file_id"]
MEDIA_TYPES = ["input_image", "image", "input_audio", "audio"]


def _without_media(value):
    if isinstance(value, list):
        return [_without_media(v) for v in value]
    if not isinstance(value, dict):
        return value
    typed = value.get("type") in MEDIA_TYPES
    return {
        k: _without_media(v)
        for k, v in value.items()
        if not (
            k in MEDIA_KEYS
            and (typed or (isinstance(v, str) and v.startswith(("data:image/", "data:audio/"))))
        )
    }


@F.pandas_udf(T.LongType())
def chars_without_media(outputs: pd.Series) -> pd.Series:
    """Serialized size of a tool output after its media references are taken out."""
    return outputs.map(
        lambda text: None
        if text is None
        else len(json.dumps(_without_media(json.loads(text)), separators=(",", ":"), ensure_ascii=False))
    )


def _length(text: Column) -> Column:
    return F.coalesce(F.length(text), F.lit(0))


def _list_chars(blocks: Column, keys: list[str]) -> Column:
    """Characters under any of ``keys`` over a list of blocks."""
    return F.coalesce(
        F.aggregate(
            blocks, F.lit(0), lambda acc, b: acc + sum((_length(j.text(b, f"$.{k}")) for k in keys[1:]), _length(j.text(b, f"$.{keys[0]}")))
        ),
        F.lit(0),
    )


def _string_or_json(p: Column, key: str) -> Column:
    """Size of a member that is text or structured; scalars of other kinds count nothing."""
    return _length(F.coalesce(j.plain_text(p, f"$.{key}"), j.json_of(p, f"$.{key}")))


def normalise(lines: DataFrame, with_content: bool = False) -> DataFrame:
    """Lines (session, ``line_no``, ``byte_offset``, ``byte_len``, ``raw``) to events."""
    raw, v, p = F.col("raw"), F.col("v"), F.col("p")
    opened = lines.withColumn("v", parsed(raw)).withColumn("p", j.part(v, "$.payload"))
    big = is_oversized(raw)
    head_inner = F.regexp_extract(raw, r'"payload"\s*:\s*\{[^{}\[\]]*?"type"\s*:\s*"([^"]*)"', 1)
    outer = F.coalesce(j.text(v, "$.type"), F.when(big, sniffed_type(raw)), F.lit("unknown"))
    inner = F.coalesce(j.text(p, "$.type"), F.when(big & (F.length(head_inner) > 0), head_inner))
    output = j.json_of(p, "$.output")
    output_text = j.plain_text(p, "$.output")
    opened = opened.select(
        "*",
        outer.alias("outer"),
        inner.alias("inner"),
        output_text.alias("out_text"),
        F.when(output_text.isNull(), output).alias("out_json"),
    )
    outer, inner, out_text, out_json = (F.col(x) for x in ("outer", "inner", "out_text", "out_json"))
    has_media = out_json.rlike('"(image_url|audio_url|file_id)"')
    opened = opened.withColumn("out_lean", chars_without_media(F.when(has_media, out_json)))
    item = outer == "response_item"
    chars = (
        _list_chars(j.items(p, "$.content"), [*TEXT_KEYS, "encrypted_content"])
        + F.when(inner == "image_generation_call", _length(j.text(p, "$.revised_prompt"))).otherwise(0)
        + _string_or_json(p, "arguments")
        + _string_or_json(p, "input")
        + F.when(j.items(p, "$.tools").isNotNull(), _length(j.json_of(p, "$.tools"))).otherwise(0)
        + _length(j.plain_text(p, "$.encrypted_content"))
        + F.coalesce(F.length(out_text), "out_lean", F.length(out_json), F.lit(0))
        + F.when(j.is_object(p, "$.action"), _length(j.json_of(p, "$.action"))).otherwise(0)
        + _list_chars(j.items(p, "$.summary"), ["text"])
    ).cast("bigint")
    urls = F.when(out_text.startswith("data:image"), F.array(out_text)).otherwise(
        F.regexp_extract_all(out_json, F.lit(r'"image_url":"(data:image[^"\\]*)"'), F.lit(1))
    )
    is_output = item & inner.isin(*OUTPUTS)
    images = F.when(is_output, F.coalesce(F.size(urls), F.lit(0))).otherwise(0)
    payload_chars = F.coalesce(F.aggregate(urls, F.lit(0), lambda acc, u: acc + F.length(u)), F.lit(0))
    rest_chars = F.when(out_text.isNotNull(), 0).otherwise(F.length(out_json) - payload_chars - 2 * images)
    pictured = images > 0
    instructions = F.coalesce(j.plain_text(p, "$.base_instructions"), j.text(p, "$.base_instructions.text"))
    has_base = j.present(p, "$.base_instructions")
    compaction = (outer == "compacted") | (item & inner.isin("compaction", "compaction_summary"))
    kind = (
        F.when(v.isNull(), "unrecognised")
        .when(outer == "session_meta", F.when(has_base, "context_injection").otherwise("session_started"))
        .when(outer == "turn_context", "turn_started")
        .when(compaction, "compacted")
        .when(
            item,
            F.when(inner.isin("message", "agent_message"), "message")
            .when(inner == "reasoning", "reasoning")
            .when(inner.isin(*CALLS, "local_shell_call", "web_search_call"), "tool_call")
            .when(inner.isin("additional_tools", "context_compaction"), "context_injection")
            .when(inner == "image_generation_call", "tool_result")
            .when(inner == "configuration_update", "session_event")
            .when(inner.isin(*OUTPUTS), F.when(pictured, "oversized_tool_result").otherwise("tool_result"))
            .otherwise("unrecognised"),
        )
        .when(
            outer == "event_msg",
            F.when(inner == "token_count", "token_report")
            .when(inner.isin(*KNOWN_EVENT_MESSAGES), "session_event")
            .otherwise("unrecognised"),
        )
        .when((outer == "retained_context") & inner.isin(*RETAINED), "session_event")
        .when(outer.isin(*PLAIN_RECORDS), "session_event")
        .otherwise("unrecognised")
    )
    # Results that several columns read are columns of their own, so each is computed once.
    arguments = F.coalesce(
        j.plain_text(p, "$.arguments"), j.plain_text(p, "$.input"), j.json_of(p, "$.arguments"), j.json_of(p, "$.input")
    )
    is_call = item & inner.isin(*CALLS)
    opened = (
        opened.withColumn("record_kind", F.coalesce(kind, F.lit("unrecognised")))
        .withColumn("args", F.when(is_call, arguments))
        .withColumn("urls", urls)
        .withColumn("images", images)
        .withColumn("payload_chars", payload_chars)
    )
    kind, arguments = F.col("record_kind"), F.col("args")
    images, payload_chars = F.col("images"), F.col("payload_chars")
    rest_chars = F.when(out_text.isNotNull(), 0).otherwise(F.length(out_json) - payload_chars - 2 * images)
    opened = opened.withColumn("file_arg", file_target(arguments)).withColumn("args_target", target_label(arguments))
    first_text = F.get(
        F.filter(
            F.transform(
                j.items(p, "$.content"), lambda b: F.coalesce(*[j.text(b, f"$.{k}") for k in TEXT_KEYS])
            ),
            lambda t: t.isNotNull(),
        ),
        0,
    )
    literal = F.when(F.try_parse_json(arguments).isNull(), truncate(collapse_whitespace(arguments), TARGET_CHARS))
    shell = F.array_join(F.try_variant_get(p, "$.action.command", "array<string>"), " ")
    role = (
        F.when(inner == "agent_message", "assistant")
        .when(j.text(p, "$.role").isin("assistant", "developer", "system"), j.text(p, "$.role"))
        .otherwise("user")
    )
    info = "$.info.last_token_usage"
    fresh, cached = cached_split(j.number(p, f"{info}.input_tokens"), j.number(p, f"{info}.cached_input_tokens"))
    failed = F.coalesce(j.text(p, "$.status") == "failed", F.lit(False))
    tool = (
        F.when(is_call, F.coalesce(j.text(p, "$.name"), F.when(inner == "tool_search_call", "tool_search").otherwise("unknown")))
        .when(inner == "local_shell_call", "local_shell")
        .when(inner == "web_search_call", "web_search")
        .when(inner == "image_generation_call", "image_generation")
    )
    call_id = (
        F.when(inner == "local_shell_call", F.coalesce(j.text(p, "$.call_id"), j.text(p, "$.id")))
        .when(inner.isin("web_search_call", "image_generation_call"), j.text(p, "$.id"))
        .otherwise(j.text(p, "$.call_id"))
    )
    target = (
        F.when(is_call, F.coalesce("args_target", literal))
        .when(inner == "local_shell_call", shell)
        .when(inner == "web_search_call", target_label(j.json_of(p, "$.action")))
    )
    tool_record = kind.isin("tool_call", "tool_result", "oversized_tool_result")
    mechanism = F.when(outer == "session_meta", "base_instructions").otherwise(inner)
    label = (
        F.when(outer == "session_meta", "Codex system prompt")
        .when(inner == "additional_tools", "Additional tool definitions")
        .otherwise("Opaque context compaction item (replacement not recorded here)")
    )
    size = (
        F.when(kind == "oversized_tool_result", rest_chars)
        .when(outer == "session_meta", F.length(F.coalesce(instructions, j.json_of(p, "$.base_instructions"))))
        .otherwise(chars)
    )
    counted = kind.isin("message", "reasoning", "context_injection") | tool_record
    events = opened.select(
        F.lit(AGENT_LINEAR).alias("agent"),
        *[F.col(k) for k in lines.columns if k not in ("agent", "raw", "byte_offset", "byte_len", "line_no")],
        (F.col("line_no") - 1).alias("seq"),
        "line_no",
        "byte_offset",
        "byte_len",
        j.timestamp(v).alias("ts"),
        F.when(outer.isin("response_item", "event_msg") & inner.isNotNull(), F.concat(outer, F.lit("/"), inner)).otherwise(outer).alias("raw_type"),
        kind.alias("kind"),
        F.when(kind == "message", role).alias("role"),
        F.when(kind == "message", truncate(strip(F.coalesce(first_text, F.lit(""))), PREVIEW_CHARS)).alias("preview"),
        F.when(counted, size).cast("bigint").alias("char_len"),
        F.when(kind == "reasoning", F.lit(False)).alias("redacted"),
        F.when(tool_record, tool).alias("tool"),
        F.when(tool_record, call_id).alias("call_id"),
        F.when(kind == "tool_call", target).alias("target"),
        F.col("file_arg").alias("file_path"),
        F.when(F.col("file_arg").isNotNull(), file_target_dir(arguments, F.lit(None).cast("string"))).alias("file_dir"),
        F.when(kind == "tool_result", failed).alias("is_error"),
        F.when(kind == "oversized_tool_result", images).alias("image_count"),
        F.when(kind == "oversized_tool_result", payload_chars).alias("image_payload_chars"),
        F.when(kind == "context_injection", mechanism).alias("mechanism"),
        F.when(kind == "context_injection", label).alias("label"),
        F.when(
            kind == "session_event",
            F.when(outer == "retained_context", F.concat(F.lit("retained_context/"), inner))
            .when(outer.isin("event_msg", "response_item"), inner)
            .otherwise(outer),
        ).alias("subtype"),
        F.when(
            kind == "compacted",
            F.struct(
                F.lit(None).cast("string").alias("trigger"),
                F.lit(None).cast("bigint").alias("tokens_before"),
                F.lit(None).cast("bigint").alias("tokens_after"),
                F.lit(None).cast("bigint").alias("cumulative_dropped"),
                F.lit(None).cast("bigint").alias("duration_ms"),
                j.present(p, "$.replacement_history").alias("replacement_recorded"),
            ),
        ).alias("compaction"),
        F.when(
            kind == "token_report",
            usage_struct(
                input=fresh,
                cache_read=cached,
                output=j.number(p, f"{info}.output_tokens"),
                reasoning=j.number(p, f"{info}.reasoning_output_tokens"),
                context_window=j.number(p, "$.info.model_context_window"),
                api_calls=F.lit(1),
            ),
        ).alias("usage"),
        F.when(kind == "turn_started", j.text(p, "$.model")).alias("model"),
        F.lit(False).alias("is_sidechain"),
        *([_content(kind, item, inner, p, raw, instructions, outer).alias("content")] if with_content else []),
    )
    ops = F.when(
        F.col("kind").isin("tool_call", "tool_result"),
        F.array(F.struct(F.col("kind").alias("op"), "tool", "call_id", "char_len", "target", "is_error")),
    ).otherwise(F.array())
    return conform(events.withColumn("tool_ops", ops.cast(f"array<{TOOL_OP.simpleString()}>")))


def _content(kind, item, inner, p, raw, instructions, outer) -> Column:
    """The text that identifies a record's content."""
    at = lambda path: F.get_json_object(raw, f"$.payload.{path}")
    spoken = F.array_join(
        F.flatten(
            F.transform(
                j.items(p, "$.content"),
                lambda b: F.array_compact(F.array(*[j.text(b, f"$.{k}") for k in TEXT_KEYS])),
            )
        ),
        "",
    )
    opaque = F.exists(
        j.items(p, "$.content"),
        lambda b: j.present(b, "$.image_url") | j.present(b, "$.file_id") | j.present(b, "$.audio_url") | j.present(b, "$.encrypted_content"),
    )

    def joined(*keys: str) -> Column:
        parts = [
            F.when(j.present(p, f"$.{k}"), F.concat(F.lit(f'"{k}":'), j.json_of(p, f"$.{k}"))) for k in keys
        ]
        return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))

    text = (
        F.when(outer == "session_meta", F.coalesce(instructions, at("base_instructions")))
        .when(
            item & inner.isin("message", "agent_message"),
            F.when((F.length(spoken) > 0) & ~opaque, spoken).otherwise(at("content")),
        )
        .when(item & inner.isin(*OUTPUTS), at("output"))
        .when(item & (inner == "web_search_call"), at("action"))
        .when(item & (inner == "reasoning"), joined("summary", "encrypted_content"))
        .when(item & inner.isin(*CALLS), joined("name", "arguments", "input"))
    )
    return F.when(~text.isin("", "[]", "{}", "null"), text)
