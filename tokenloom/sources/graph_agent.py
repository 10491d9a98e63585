"""Normalise the graph-linked session format into events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions import content as c
from tokenloom.functions.text import PREVIEW_CHARS, file_target, file_target_dir, strip, target_label, truncate
from tokenloom.functions.usage import largest_iteration, usage_struct
from tokenloom.schema import AGENT_GRAPH, TOOL_OP
from tokenloom.sources import variant as j
from tokenloom.sources.events import conform
from tokenloom.sources.lines import is_oversized, parsed, sniffed_type

# Records written beside the conversation that never reach the model.
SIDECAR_TYPES = [
    "file-history-snapshot",
    "file-history-delta",
    "pr-link",
    "frame-link",
    "ai-title",
    "custom-title",
    "agent-name",
    "mode",
    "permission-mode",
    "agent-setting",
    "last-prompt",
    "queue-operation",
    "worktree-state",
    "bridge-session",
    "relocated",
    "summary",
    "atis-latch",
    "cost-state",
    "artifact-autoreact-ledger",
    "artifact-comment-monitor",
]
SYSTEM_NOTICES = [
    "turn_duration",
    "stop_hook_summary",
    "api_error",
    "local_command",
    "informational",
    "away_summary",
    "bridge_status",
]
ATTACHMENT_KEYS = ["content", "stdout", "planContent", "snippet", "prompt", "skills", "addedLines", "addedBlocks"]
LABEL_KEYS = ["displayPath", "path", "filename", "planFilePath", "skillDir"]
MECHANISM_LABELS = {
    "skill_listing": "Skill listing",
    "invoked_skills": "Invoked skills",
    "agent_listing_delta": "Agent listing",
    "mcp_instructions_delta": "MCP server instructions",
    "deferred_tools_delta": "Deferred tool definitions",
    "task_reminder": "Task reminder",
    "queued_command": "Queued command",
    "command_permissions": "Command permissions",
    "date_change": "Date change",
}


def _block(b: Column) -> Column:
    """The fields of one content block; ``size`` is NULL where nested text must be counted."""
    kind = j.text(b, "$.type")
    thinking, body = j.text(b, "$.thinking"), j.text(b, "$.text")
    result = j.plain_text(b, "$.content")
    input_text = j.plain_text(b, "$.input")
    input_json = j.json_of(b, "$.input")
    result_blocks = j.items(b, "$.content")
    texts_only = F.forall(
        result_blocks, lambda x: (j.text(x, "$.type") == "text") & (F.size(F.try_variant_get(x, "$", "map<string,variant>")) == 2)
    )
    size = (
        F.when(
            kind == "thinking",
            F.when(F.length(thinking) > 0, F.length(thinking)).otherwise(
                c.redacted_thinking_chars(F.coalesce(j.text(b, "$.signature"), F.lit("")))
            ),
        )
        .when(kind == "text", F.coalesce(F.length(body), F.lit(0)))
        .when(kind == "tool_use", F.coalesce(F.length(F.coalesce(input_text, input_json)), F.lit(0)))
        .when(
            kind == "tool_result",
            F.when(~j.present(b, "$.content"), 0)
            .when(result.isNotNull(), F.length(result))
            .when(
                texts_only,
                F.aggregate(
                    result_blocks, F.lit(0), lambda acc, x: acc + F.coalesce(F.length(j.text(x, "$.text")), F.lit(0))
                ),
            ),
        )
        .when(kind == "image", F.coalesce(c.image_chars(j.text(b, "$.source.data")), F.lit(0)))
    ).cast("bigint")
    return F.struct(
        kind.alias("type"),
        body.alias("text"),
        size.alias("size"),
        F.when(size.isNull(), F.when(kind == "tool_result", j.json_of(b, "$.content")).otherwise(F.to_json(b))).alias("nested"),
        j.text(b, "$.id").alias("id"),
        j.text(b, "$.name").alias("name"),
        j.text(b, "$.tool_use_id").alias("tool_use_id"),
        j.flag(b, "$.is_error").alias("is_error"),
        input_json.alias("input"),
        ((kind == "thinking") & (F.coalesce(F.length(thinking), F.lit(0)) == 0) & j.present(b, "$.signature")).alias(
            "redacted"
        ),
    )


def _iteration_usage(v: Column) -> Column:
    usage = "$.message.usage"
    one = lambda x: F.struct(
        *[j.number(x, f"$.{n}").alias(n) for n in ("input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")]
    )
    iterations = F.transform(j.items(v, f"{usage}.iterations"), one)
    many = F.size(iterations) > 1
    chosen = F.when(many, largest_iteration(iterations)).otherwise(one(j.part(v, usage)))
    return F.when(
        (j.text(v, "$.type") == "assistant") & j.present(v, usage),
        usage_struct(
            input=chosen["input_tokens"],
            cache_creation=chosen["cache_creation_input_tokens"],
            cache_read=chosen["cache_read_input_tokens"],
            output=j.number(v, f"{usage}.output_tokens"),
            api_calls=F.when(many, F.size(iterations)).otherwise(1),
        ),
    )


def normalise(lines: DataFrame, with_content: bool = False) -> DataFrame:
    """Lines (session, ``line_no``, ``byte_offset``, ``byte_len``, ``raw``) to events.

    Nothing fails on an odd record: what is not understood becomes an
    ``unrecognised`` event and is counted.
    """
    v = F.col("v")
    opened = lines.withColumn("v", parsed(F.col("raw")))
    opened = opened.select(
        "*",
        F.coalesce(j.text(v, "$.type"), F.when(is_oversized(F.col("raw")), sniffed_type(F.col("raw"))), F.lit("unknown")).alias("type"),
        F.transform(j.items(v, "$.message.content"), _block).alias("blocks"),
        F.when(j.items(v, "$.message.content").isNull(), j.plain_text(v, "$.message.content")).alias("said"),
        j.part(v, "$.attachment").alias("att"),
    )
    att = F.col("att")
    attached = [(k, j.plain_text(att, f"$.{k}"), j.json_of(att, f"$.{k}")) for k in ATTACHMENT_KEYS]
    is_att = F.col("type") == "attachment"
    any_key = F.lit(False)
    for k in ATTACHMENT_KEYS:
        any_key = any_key | j.present(att, f"$.{k}")
    simple_att = sum((F.coalesce(F.length(t), F.lit(0)) for _, t, _ in attached[1:]), F.coalesce(F.length(attached[0][1]), F.lit(0)))
    nested_att = F.array(
        *[F.when(t.isNull(), js) for _, t, js in attached], F.when(~any_key, F.to_json(att))
    )
    nested_blocks = F.transform("blocks", lambda b: b["nested"])
    nested = F.when(is_att, nested_att).otherwise(nested_blocks)
    needs = F.exists(nested, lambda n: n.isNotNull())
    # Only records that hold nested objects visit Python; the others send NULL.
    opened = opened.withColumn("deep", c.nested_text_chars(F.when(needs, nested)))
    deep = F.col("deep")
    sizes = F.transform(
        "blocks", lambda b, i: F.coalesce(b["size"], F.element_at(deep, i + 1), F.lit(0).cast("bigint"))
    )
    opened = opened.withColumn("sizes", sizes)
    total = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda acc, n: acc + n)
    att_total = simple_att + F.coalesce(
        F.aggregate(deep, F.lit(0).cast("bigint"), lambda acc, n: acc + F.coalesce(n, F.lit(0))), F.lit(0)
    )
    first = lambda kind: F.get(F.filter("blocks", lambda b: b["type"] == kind), 0)
    has = lambda kind: F.coalesce(F.exists("blocks", lambda b: b["type"] == kind), F.lit(False))
    kind_of = F.col("type")
    assistant, user = kind_of == "assistant", kind_of == "user"
    # Results that several columns read are columns of their own, so each is computed once.
    opened = opened.withColumn("call", first("tool_use")).withColumn("result", first("tool_result"))
    call, result = F.col("call"), F.col("result")
    is_call = assistant & call.isNotNull()
    is_result = user & result.isNotNull()
    thinks = assistant & has("thinking") & ~has("text")
    subtype = F.coalesce(j.text(v, "$.subtype"), F.lit("system"))
    notice = (kind_of == "system") & subtype.isin(*SYSTEM_NOTICES)
    boundary = (kind_of == "system") & (subtype == "compact_boundary")
    kind = (
        F.when(v.isNull(), "unrecognised")
        .when(is_call, "tool_call")
        .when(thinks, "reasoning")
        .when(is_result, "tool_result")
        .when(assistant | user, "message")
        .when(is_att, "context_injection")
        .when(boundary, "compacted")
        .when(notice | kind_of.isin(*SIDECAR_TYPES), "session_event")
        .otherwise("unrecognised")
    )
    opened = (
        opened.withColumn("record_kind", kind)
        .withColumn("call_target", target_label(call["input"]))
        .withColumn("call_file", file_target(call["input"]))
    )
    kind = F.col("record_kind")
    mechanism = F.coalesce(j.text(att, "$.type"), F.lit("attachment"))
    named = F.create_map(*[F.lit(x) for pair in MECHANISM_LABELS.items() for x in pair])
    label = F.coalesce(
        *[j.text(att, f"$.{k}") for k in LABEL_KEYS], named[mechanism], F.replace(mechanism, F.lit("_"), F.lit(" "))
    )
    first_text = F.get(F.filter(F.transform("blocks", lambda b: b["text"]), lambda t: t.isNotNull()), 0)
    cwd = j.text(v, "$.cwd")
    ops = F.transform(
        F.filter(
            F.arrays_zip("blocks", "sizes"),
            lambda z: (assistant & (z["blocks"]["type"] == "tool_use")) | (user & (z["blocks"]["type"] == "tool_result")),
        ),
        lambda z: F.struct(
            F.when(z["blocks"]["type"] == "tool_use", "tool_call").otherwise("tool_result").alias("op"),
            F.when(z["blocks"]["type"] == "tool_use", F.coalesce(z["blocks"]["name"], F.lit("unknown"))).alias("tool"),
            F.coalesce(
                F.when(z["blocks"]["type"] == "tool_use", z["blocks"]["id"]).otherwise(z["blocks"]["tool_use_id"])
            ).alias("call_id"),
            z["sizes"].alias("char_len"),
            F.when(z["blocks"]["type"] == "tool_use", target_label(z["blocks"]["input"])).alias("target"),
            F.when(z["blocks"]["type"] == "tool_result", z["blocks"]["is_error"]).alias("is_error"),
        ),
    )
    message_like = assistant | user
    events = opened.select(
        F.lit(AGENT_GRAPH).alias("agent"),
        *[F.col(k) for k in lines.columns if k not in ("agent", "raw", "byte_offset", "byte_len", "line_no")],
        (F.col("line_no") - 1).alias("seq"),
        "line_no",
        "byte_offset",
        "byte_len",
        j.timestamp(v).alias("ts"),
        F.when(
            (kind == "unrecognised") & (kind_of == "system"),
            F.concat(F.lit("system/"), F.coalesce(j.text(v, "$.subtype"), F.lit("missing-subtype"))),
        )
        .otherwise(kind_of)
        .alias("raw_type"),
        kind.alias("kind"),
        F.when(kind == "message", F.when(assistant, "assistant").otherwise("user")).alias("role"),
        F.when(kind == "message", truncate(strip(F.coalesce("said", first_text, F.lit(""))), PREVIEW_CHARS)).alias("preview"),
        F.when(is_att & v.isNotNull(), att_total)
        .when(message_like & v.isNotNull(), F.coalesce(F.when(user, F.length("said")), total, F.lit(0)))
        .cast("bigint")
        .alias("char_len"),
        F.when(kind == "reasoning", F.exists("blocks", lambda b: b["redacted"])).alias("redacted"),
        F.when(is_call, F.coalesce(call["name"], F.lit("unknown"))).alias("tool"),
        F.when(is_call, call["id"]).when(is_result, result["tool_use_id"]).alias("call_id"),
        F.when(is_call, F.col("call_target")).alias("target"),
        F.when(is_call, F.col("call_file")).alias("file_path"),
        F.when(is_call & F.col("call_file").isNotNull(), file_target_dir(call["input"], cwd)).alias("file_dir"),
        F.when(is_result, result["is_error"]).alias("is_error"),
        F.when(is_att, mechanism).alias("mechanism"),
        F.when(is_att, label).alias("label"),
        F.when(kind == "session_event", F.when(notice, subtype).otherwise(kind_of)).alias("subtype"),
        F.when(
            boundary,
            F.struct(
                j.text(v, "$.compactMetadata.trigger").alias("trigger"),
                j.number(v, "$.compactMetadata.preTokens").alias("tokens_before"),
                j.number(v, "$.compactMetadata.postTokens").alias("tokens_after"),
                j.number(v, "$.compactMetadata.cumulativeDroppedTokens").alias("cumulative_dropped"),
                j.number(v, "$.compactMetadata.durationMs").alias("duration_ms"),
                F.lit(False).alias("replacement_recorded"),
            ),
        ).alias("compaction"),
        _iteration_usage(v).alias("usage"),
        F.when(assistant, j.text(v, "$.message.model")).alias("model"),
        F.when(assistant, F.coalesce(j.text(v, "$.requestId"), j.text(v, "$.message.id"))).alias("request_id"),
        j.text(v, "$.uuid").alias("uuid"),
        j.text(v, "$.parentUuid").alias("parent_uuid"),
        j.text(v, "$.logicalParentUuid").alias("logical_parent_uuid"),
        j.flag(v, "$.isSidechain").alias("is_sidechain"),
        F.coalesce(ops, F.array().cast(f"array<{TOOL_OP.simpleString()}>")).alias("tool_ops"),
        *([_content(kind).alias("content")] if with_content else [F.lit(None).cast("string").alias("content")]),
    )
    return conform(events)


def _content(kind: Column) -> Column:
    """The text that identifies a record's content; link ids are left out.

    Redacted reasoning has none: equal signatures do not prove equal text.
    """
    raw = F.col("raw")
    blocks = F.get_json_object(raw, "$.message.content")
    tools = kind.isin("tool_call", "tool_result")
    stripped = F.get(
        c.without_member(F.when(tools, blocks), F.when(kind == "tool_call", "id").otherwise("tool_use_id")), 0
    )
    attachment = F.col("att")
    keys = [k for k in ATTACHMENT_KEYS]
    held = [F.get_json_object(raw, f"$.attachment.{k}") for k in keys]
    count = sum((h.isNotNull().cast("int") for h in held[1:]), held[0].isNotNull().cast("int"))
    as_object = F.concat(
        F.lit("{"),
        F.concat_ws(
            ",",
            *[
                F.when(
                    h.isNotNull(),
                    F.concat(F.lit(f'"{k}":'), j.json_of(attachment, f"$.{k}")),
                )
                for k, h in zip(keys, held)
            ],
        ),
        F.lit("}"),
    )
    injected = F.when(count == 1, F.coalesce(*held)).when(count > 1, as_object)
    thinking = F.to_json(
        F.transform(
            F.filter(j.items(F.col("v"), "$.message.content"), lambda b: j.text(b, "$.type") == "thinking"),
            lambda b: j.text(b, "$.thinking"),
        )
    )
    redacted = F.exists("blocks", lambda b: b["redacted"])
    text = (
        F.when(tools, stripped)
        .when((kind == "reasoning") & ~redacted, thinking)
        .when(kind == "message", blocks)
        .when(kind == "context_injection", injected)
    )
    return F.when(~text.isin("", "[]", "{}"), text)
