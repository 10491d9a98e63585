"""The normalised model: column types, names and fixed values."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values.  These must equal what the analysed agents and the published
# accounting rules use, so they are stated here as plain text.
# ---------------------------------------------------------------------------

AGENT_GRAPH = "claude-code"  # logs form a parent graph
AGENT_LINEAR = "codex"  # logs form a straight list

CATEGORIES = [
    "system-instructions",
    "developer-instructions",
    "repository-instructions",
    "tool-definitions",
    "user-messages",
    "assistant-messages",
    "reasoning",
    "tool-calls",
    "tool-outputs",
    "file-contents",
    "summaries",
    "current-prompt",
    "unattributed",
    "other",
]

SOURCE_KINDS = [
    "system-prompt",
    "instruction-file",
    "project-config",
    "harness",
    "user",
    "tool",
    "file",
    "compaction-summary",
    "model",
    "unknown",
]

#: Ordered from strongest to weakest; the position is the ordinal.
CONFIDENCES = ["observed", "derived", "estimated"]

#: Event kinds that take room in the prompt.
OCCUPYING_KINDS = [
    "message",
    "reasoning",
    "tool_call",
    "tool_result",
    "oversized_tool_result",
    "context_injection",
]

RATIO_CODE = 3.1
RATIO_PROSE = 3.6
RATIO_LINEAR_AGENT = 3.8

SPIKE_TOKENS = 20_000
RESIDUAL_STEP_TOKENS = 5_000
STEP_WINDOW = 5
LOW_ENTROPY_BYTES = 4 * 1024
LOW_ENTROPY_RATIO = 0.75

# ---------------------------------------------------------------------------
# Struct types
# ---------------------------------------------------------------------------

USAGE = T.StructType(
    [
        T.StructField("input", T.LongType()),
        T.StructField("cache_creation", T.LongType()),
        T.StructField("cache_read", T.LongType()),
        T.StructField("output", T.LongType()),
        T.StructField("reasoning", T.LongType()),
        T.StructField("context_window", T.LongType()),
        T.StructField("api_calls", T.LongType()),
    ]
)

COMPACTION = T.StructType(
    [
        T.StructField("trigger", T.StringType()),
        T.StructField("tokens_before", T.LongType()),
        T.StructField("tokens_after", T.LongType()),
        T.StructField("cumulative_dropped", T.LongType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("replacement_recorded", T.BooleanType()),
    ]
)

TOOL_OP = T.StructType(
    [
        T.StructField("op", T.StringType()),  # tool_call | tool_result
        T.StructField("tool", T.StringType()),
        T.StructField("call_id", T.StringType()),
        T.StructField("char_len", T.LongType()),
        T.StructField("target", T.StringType()),
        T.StructField("is_error", T.BooleanType()),
    ]
)

#: One row per log record; kind-specific columns are NULL elsewhere.
EVENTS = T.StructType(
    [
        T.StructField("agent", T.StringType(), False),
        T.StructField("session_id", T.StringType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("line_no", T.LongType(), False),
        T.StructField("byte_offset", T.LongType()),
        T.StructField("byte_len", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("raw_type", T.StringType()),
        T.StructField("kind", T.StringType(), False),
        T.StructField("role", T.StringType()),
        T.StructField("preview", T.StringType()),
        T.StructField("char_len", T.LongType()),
        T.StructField("redacted", T.BooleanType()),
        T.StructField("tool", T.StringType()),
        T.StructField("call_id", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("file_dir", T.StringType()),
        T.StructField("is_error", T.BooleanType()),
        T.StructField("image_count", T.LongType()),
        T.StructField("image_payload_chars", T.LongType()),
        T.StructField("mechanism", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("subtype", T.StringType()),
        T.StructField("compaction", COMPACTION),
        T.StructField("usage", USAGE),
        T.StructField("model", T.StringType()),
        T.StructField("request_id", T.StringType()),
        T.StructField("uuid", T.StringType()),
        T.StructField("parent_uuid", T.StringType()),
        T.StructField("logical_parent_uuid", T.StringType()),
        T.StructField("is_sidechain", T.BooleanType()),
        T.StructField("tool_ops", T.ArrayType(TOOL_OP)),
        T.StructField("content", T.StringType()),
    ]
)

#: Every table of one session is keyed by these two columns.
SESSION = ["agent", "session_id"]
