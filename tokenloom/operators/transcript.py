"""Readable transcripts: kinds, texts and pages of a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.text import LINEAR_AGENT_MARKERS, truncate
from tokenloom.operators.turns import occupies_context
from tokenloom.plans.scan import dense_number
from tokenloom.schema import SESSION
from tokenloom.sources import variant as j
from tokenloom.sources.graph_agent import ATTACHMENT_KEYS

PAGE_DEFAULT = 40
PAGE_TEXT_CHARS, LABEL_CHARS = 2_000, 60

# Placeholders for content that has no text.
IMAGE = "[inline image]"
NO_THINKING = "[thinking, recorded without its text]"
ENCRYPTED = "[encrypted content]"
ENCRYPTED_REASONING = "[encrypted reasoning]"
INJECTED_BLOCK_MARKERS = [
    *LINEAR_AGENT_MARKERS,
    "<subagent_notification>",
    "<codex_internal_context",
    "<turn_aborted>",
]


def transcript_kind() -> Column:
    kind, role = F.col("kind"), F.col("role")
    return (
        F.when((kind == "message") & (role == "assistant"), "assistant")
        .when((kind == "message") & (role == "user"), "user")
        .when(kind == "reasoning", "reasoning")
        .when(kind == "tool_call", "toolCall")
        .when(kind.isin("tool_result", "oversized_tool_result"), "toolResult")
        .when(kind == "compacted", "compaction")
        .otherwise("injection")
    )


def entry_label() -> Column:
    kind = F.col("kind")
    return (
        F.when((kind == "reasoning") & F.col("redacted"), "recorded without its text")
        .when(
            kind == "tool_call",
            F.when(
                F.col("target").isNotNull(),
                F.concat(F.col("tool"), F.lit(" · "), truncate(F.col("target"), LABEL_CHARS)),
            ).otherwise(F.col("tool")),
        )
        .when(
            kind == "tool_result",
            F.coalesce("tool", F.concat(F.lit("call "), truncate(F.col("call_id"), LABEL_CHARS))),
        )
        .when(
            (kind == "oversized_tool_result") & (F.col("image_count") > 0),
            F.concat(F.col("image_count").cast("string"), F.lit(" inline image(s)")),
        )
        .when(kind == "context_injection", F.col("label"))
        .when(kind == "compacted", F.col("compaction.trigger"))
    )


def _graph_block(b: Column, inner: bool = True) -> Column:
    """Text of one content block of graph logs."""
    kind = j.text(b, "$.type")
    bare = F.when(kind.isNull() & ~j.is_object(b, "$"), j.plain_text(b, "$"))
    thinking = j.text(b, "$.thinking")
    note = F.concat(F.lit("[unsupported content block: "), kind, F.lit("]"))
    content = j.plain_text(b, "$.content")
    if inner:
        nested = F.array_join(
            F.array_compact(F.transform(j.items(b, "$.content"), lambda x: _graph_block(x, inner=False))), "\n"
        )
    else:
        nested = j.json_of(b, "$.content")
    return (
        F.when(bare.isNotNull(), bare)
        .when(kind == "text", j.text(b, "$.text"))
        .when(kind == "thinking", F.when(F.length(thinking) > 0, thinking).otherwise(NO_THINKING))
        .when(kind == "redacted_thinking", NO_THINKING)
        .when(kind == "tool_use", F.coalesce(j.plain_text(b, "$.input"), j.json_of(b, "$.input")))
        .when(
            kind == "tool_result",
            F.coalesce(
                content,
                F.when(j.items(b, "$.content").isNotNull(), nested),
                j.json_of(b, "$.content"),
                F.lit(""),
            ),
        )
        .when(kind == "image", IMAGE)
        .when(kind.isNotNull(), F.concat_ws("\n", note, j.text(b, "$.text")))
    )


def graph_text(raw: Column) -> Column:
    """The readable text of one record of graph logs; NULL when there is none."""
    v = F.try_parse_json(raw)
    kind = j.text(v, "$.type")
    spoken = F.coalesce(
        j.plain_text(v, "$.message.content"),
        F.array_join(F.array_compact(F.transform(j.items(v, "$.message.content"), lambda b: _graph_block(b))), "\n"),
    )
    parts = F.concat_ws(
        "\n",
        *[
            F.coalesce(
                F.when(F.length(j.plain_text(v, f"$.attachment.{k}")) > 0, j.plain_text(v, f"$.attachment.{k}")),
                F.when(
                    j.plain_text(v, f"$.attachment.{k}").isNull(), j.json_of(v, f"$.attachment.{k}")
                ),
            )
            for k in ATTACHMENT_KEYS
        ],
    )
    attached = F.when(F.length(parts) > 0, parts).otherwise(j.json_of(v, "$.attachment"))
    text = (
        F.when(kind.isin("user", "assistant"), spoken)
        .when(kind == "attachment", attached)
        .when(kind == "system", j.text(v, "$.content"))
    )
    return F.when(F.length(F.trim(text)) > 0, text)


def _linear_block(b: Column) -> Column:
    kind = j.text(b, "$.type")
    bare = F.when(~j.is_object(b, "$"), j.plain_text(b, "$"))
    return F.coalesce(
        bare,
        j.text(b, "$.text"),
        j.text(b, "$.input_text"),
        j.text(b, "$.output_text"),
        F.when(j.present(b, "$.image_url") | (kind == "input_image"), IMAGE),
        F.when(kind == "encrypted_content", ENCRYPTED),
        F.concat(F.lit("[unsupported content block: "), F.coalesce(kind, F.lit("unknown")), F.lit("]")),
    )


def _lines_of(blocks: Column) -> Column:
    return F.when(F.size(blocks) > 0, F.array_join(F.transform(blocks, _linear_block), "\n"))


def linear_text(raw: Column) -> Column:
    """The readable text of one record of straight logs; NULL when there is none."""
    v = F.try_parse_json(raw)
    p = "$.payload"
    listed = _lines_of(j.items(v, f"{p}.output"))
    output = F.coalesce(
        j.plain_text(v, f"{p}.output"),
        F.when(F.length(F.trim(listed)) > 0, listed),
        j.json_of(v, f"{p}.output"),
    )
    item = F.concat_ws(
        "\n",
        _lines_of(j.items(v, f"{p}.content")),
        _lines_of(j.items(v, f"{p}.summary")),
        j.plain_text(v, f"{p}.arguments"),
        j.plain_text(v, f"{p}.input"),
        F.when(j.present(v, f"{p}.encrypted_content"), ENCRYPTED_REASONING),
        output,
        j.json_of(v, f"{p}.action"),
    )
    kind = j.text(v, "$.type")
    text = (
        F.when(
            kind == "session_meta",
            F.coalesce(j.plain_text(v, f"{p}.base_instructions"), j.text(v, f"{p}.base_instructions.text")),
        )
        .when(kind == "response_item", item)
        .when(kind == "compacted", j.text(v, f"{p}.message"))
    )
    return F.when((F.length(F.trim(text)) > 0) | (kind != "response_item"), text)


def linear_block_roles(raw: Column) -> Column:
    """``array<struct<role, text>>`` of a message; injected blocks are not the user's words."""
    v = F.try_parse_json(raw)
    declared = j.text(v, "$.payload.role")

    def one(b: Column) -> Column:
        text = _linear_block(b)
        injected = F.lit(False)
        for marker in INJECTED_BLOCK_MARKERS:
            injected = injected | F.ltrim(text).startswith(marker)
        role = F.when(declared.isin("assistant", "developer", "system"), declared).when(injected, "developer").otherwise("user")
        return F.struct(role.alias("role"), text.alias("text"))

    return F.transform(j.items(v, "$.payload.content"), one)


def visible(events: DataFrame) -> DataFrame:
    """Records a transcript shows, numbered from 0 within their session."""
    shown = events.where(occupies_context() | (F.col("kind") == "compacted"))
    return dense_number(shown, SESSION, "seq", "__n").withColumn("index", F.col("__n") - 1).drop("__n")


def page(numbered: DataFrame, offset: int, limit: int = PAGE_DEFAULT, budget: int = PAGE_TEXT_CHARS) -> DataFrame:
    """Entries ``offset .. offset + limit`` of every session given.

    ``numbered`` carries ``text`` and may carry ``blocks`` (``array<struct<role, text>>``,
    see :func:`linear_block_roles`).  Only the page's texts are shortened and returned.
    An entry with blocks reads as its blocks joined by line ends, and the blocks share
    the budget evenly: ``parts`` holds each with its whole length.
    """
    limit = max(1, limit)
    part = numbered.where(F.col("index").between(offset, offset + limit - 1))
    said = F.col("text")
    extra = []
    if "blocks" in numbered.columns:
        each = F.floor(F.lit(budget) / F.greatest(F.size("blocks"), F.lit(1))).cast("int")
        said = F.when(F.size("blocks") > 0, F.array_join(F.col("blocks.text"), "\n")).otherwise(F.col("text"))
        shortened = F.transform(
            "blocks",
            lambda b: F.struct(
                b["role"].alias("role"),
                F.length(b["text"]).cast("bigint").alias("chars"),
                (F.length(b["text"]) > each).alias("truncated"),
                F.when(F.length(b["text"]) > each, F.concat(F.left(b["text"], each), F.lit("…")))
                .otherwise(b["text"])
                .alias("text"),
            ),
        )
        extra = [F.coalesce(shortened, F.array().cast("array<struct<role:string,chars:bigint,truncated:boolean,text:string>>")).alias("parts")]
    part = part.withColumn("text", said)
    full = F.coalesce("text", F.when(F.col("kind") == "message", F.col("preview")), F.lit(""))
    return part.select(
        *SESSION,
        "index",
        "line_no",
        "turn",
        transcript_kind().alias("entry_kind"),
        entry_label().alias("entry_label"),
        truncate(full, budget).alias("text"),
        (F.length(full) > budget).alias("truncated"),
        F.col("text").isNull().alias("unavailable"),
        F.coalesce("is_error", F.lit(False)).alias("error"),
        *extra,
    )


def timeline(events: DataFrame, limit: int | None = 60) -> DataFrame:
    """The first records of every session given, in log order."""
    numbered = dense_number(
        events.select(*SESSION, "seq", "line_no", "kind", "raw_type", "turn", "char_len"), SESSION, "seq"
    )
    return numbered if limit is None else numbered.where(F.col("n") <= limit)
