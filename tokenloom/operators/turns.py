"""Turn assignment: which request each log record belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.usage import prompt_tokens
from tokenloom.plans.scan import last_known, next_known, running, running_count, running_sum
from tokenloom.schema import OCCUPYING_KINDS, SESSION


def occupies_context(kind: Column | str = "kind") -> Column:
    kind = F.col(kind) if isinstance(kind, str) else kind
    return kind.isin(*OCCUPYING_KINDS)


def _is_system_prompt() -> Column:
    return (F.col("kind") == "context_injection") & (F.col("mechanism") == "base_instructions")


# ---------------------------------------------------------------------------
# Straight logs: a turn ends at each token report
# ---------------------------------------------------------------------------


def assign_linear_turns(events: DataFrame, ratio: float | Column | None = None) -> DataFrame:
    """Add ``turn`` and the running sizes a linear replay needs.

    Records after the last report belong to no turn.  One scan supplies the
    turn number, the model in force, the compaction in force, the running
    prompt size and whether a record opens the response.
    """
    report = F.col("kind") == "token_report"
    compacted = F.col("kind") == "compacted"
    reset = (
        (F.col("kind") == "turn_started")
        | compacted
        | ((F.col("kind") == "message") & F.col("role").isin("user", "developer", "system"))
    )
    system = _is_system_prompt()
    body = occupies_context() & ~system
    chars = F.coalesce(F.col("char_len"), F.lit(0))
    tokens = F.ceil(chars / (F.lit(1.0) if ratio is None else ratio if isinstance(ratio, Column) else F.lit(ratio))).cast("bigint")
    scanned = running(
        events,
        SESSION,
        "seq",
        {
            "__reports": running_count(report),
            "__report_at": next_known(F.when(report, F.col("seq"))),
            "__mark": next_known(F.when(reset, F.lit("reset")).when(report, F.lit("report")), inclusive=False),
            "active_model": last_known(
                F.when(F.col("kind") == "turn_started", F.struct(F.col("model").alias("m"))), inclusive=True
            ),
            "comp_seq": last_known(F.when(compacted, F.col("seq"))),
            "body_chars": running_sum(F.when(body, chars)),
            "body_tokens": running_sum(F.when(body, tokens)),
            "body_items": running_count(body),
            "sys_chars": running_sum(F.when(system, chars)),
            "sys_tokens": running_sum(F.when(system, tokens)),
            "sys_items": running_count(system),
        },
    )
    output = ((F.col("kind") == "message") & (F.col("role") == "assistant")) | F.col("kind").isin(
        "reasoning", "tool_call"
    )
    return (
        scanned.withColumn("turn", F.when(F.col("__report_at").isNotNull(), F.col("__reports") + 1))
        .withColumn("opens_response", F.coalesce(output & (F.col("__mark") == "report"), F.lit(False)))
        .withColumn("active_model", F.col("active_model")["m"])
        .drop("__reports", "__report_at", "__mark")
    )


_AT_CUTOFF = [
    "comp_seq",
    "body_chars",
    "body_tokens",
    "body_items",
    "sys_chars",
    "sys_tokens",
    "sys_items",
]


def linear_turns(assigned: DataFrame) -> DataFrame:
    """One row per turn, with what had been logged when its response began."""
    report = F.col("kind") == "token_report"
    opens = F.col("opens_response")
    state = F.struct(*_AT_CUTOFF)
    report_seq = F.when(report, F.col("seq"))
    turns = (
        assigned.where(F.col("turn").isNotNull())
        .groupBy(*SESSION, "turn")
        .agg(
            F.max_by(F.struct("ts", "usage", "active_model"), report_seq).alias("r"),
            F.max(report_seq).alias("anchor_seq"),
            F.min(F.when(opens, F.col("seq"))).alias("response_start_seq"),
            F.min_by(state, F.when(opens, F.col("seq"))).alias("at_response"),
            F.max_by(state, report_seq).alias("at_anchor"),
            F.count(F.lit(1)).alias("event_count"),
            F.min("seq").alias("first_seq"),
        )
    )
    cut = F.when(F.col("response_start_seq").isNotNull(), F.col("at_response")).otherwise(F.col("at_anchor"))
    return turns.select(
        *SESSION,
        "turn",
        F.col("r.ts").alias("ts"),
        F.col("r.active_model").alias("model"),
        F.col("r.usage").alias("usage"),
        prompt_tokens(F.col("r.usage")).alias("prompt_tokens"),
        "anchor_seq",
        "response_start_seq",
        F.coalesce("response_start_seq", "anchor_seq").alias("cutoff_seq"),
        "event_count",
        "first_seq",
        *[cut[c].alias(c) for c in _AT_CUTOFF],
    )


def linear_context_sizes(assigned: DataFrame, turns: DataFrame) -> DataFrame:
    """Prompt size of every turn from running totals, without listing its items.

    The prompt holds what was logged since the last compaction, the compaction's
    summary (sized by its record) and every system prompt.
    """
    comps = assigned.where(F.col("kind") == "compacted").select(
        *SESSION,
        F.col("seq").alias("comp_seq"),
        F.col("body_chars").alias("c_chars"),
        F.col("body_tokens").alias("c_tokens"),
        F.col("body_items").alias("c_items"),
        F.col("byte_len").alias("c_bytes"),
    )
    joined = turns.join(comps, [*SESSION, "comp_seq"], "left")
    zero = F.lit(0).cast("bigint")
    since = lambda total, base: F.col(total) - F.coalesce(F.col(base), zero)
    summary = F.coalesce(F.col("c_bytes"), zero)
    has_summary = F.when(F.col("comp_seq").isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    return joined.select(
        *[F.col(c) for c in turns.columns],
        (since("body_chars", "c_chars") + F.col("sys_chars") + summary).alias("context_chars"),
        (since("body_items", "c_items") + F.col("sys_items") + has_summary).alias("context_items"),
        (since("body_tokens", "c_tokens") + F.col("sys_tokens")).alias("context_tokens_without_summary"),
        summary.alias("summary_chars"),
    )


# ---------------------------------------------------------------------------
# Graph logs: adjacent usage records of one request are one turn
# ---------------------------------------------------------------------------


def assign_graph_turns(events: DataFrame) -> DataFrame:
    """Add ``turn`` and the request each record leads up to.

    A response is written as several records that repeat one usage figure.  A
    usage record opens a turn unless it continues the request of the usage
    record before it; everything up to a usage record belongs to its turn.
    """
    has_usage = F.col("usage").isNotNull()
    request = F.struct(F.col("request_id").alias("id"))
    seen = running(events, SESSION, "seq", {"__before": last_known(F.when(has_usage, request))})
    opens = has_usage & ~F.coalesce(F.col("request_id") == F.col("__before")["id"], F.lit(False))
    marked = seen.withColumn("opens_turn", opens).drop("__before")
    ahead = F.struct(
        F.col("opens_turn").alias("opens"), F.col("seq").alias("seq"), F.col("request_id").alias("request")
    )
    scanned = running(
        marked,
        SESSION,
        "seq",
        {
            "__opened": running_count(F.col("opens_turn")),
            "__ahead": next_known(F.when(has_usage, ahead)),
        },
    )
    nxt = F.col("__ahead")
    own_request = (F.col("seq") == nxt["seq"]) | (F.col("request_id") == nxt["request"])
    return (
        scanned.withColumn(
            "turn",
            F.when(nxt.isNotNull(), F.col("__opened") + F.when(nxt["opens"], F.lit(1)).otherwise(F.lit(0))),
        )
        .withColumn(
            "opens_response",
            F.coalesce(nxt["opens"] & (F.col("raw_type") == "assistant") & own_request, F.lit(False)),
        )
        .drop("__opened", "__ahead")
    )


def graph_turns(assigned: DataFrame) -> DataFrame:
    """One row per request: first usage of the group, last record as anchor."""
    opening = F.when(F.col("opens_turn"), F.col("seq"))
    model = F.when(~F.col("model").startswith("<"), F.col("model"))
    turns = (
        assigned.where(F.col("turn").isNotNull())
        .groupBy(*SESSION, "turn")
        .agg(
            F.max_by(F.struct("ts", "usage", model.alias("model")), opening).alias("o"),
            F.max(F.when(F.col("usage").isNotNull(), F.col("seq"))).alias("anchor_seq"),
            F.min(F.when(F.col("opens_response"), F.col("seq"))).alias("response_start_seq"),
            F.count(F.lit(1)).alias("event_count"),
            F.min("seq").alias("first_seq"),
        )
    )
    return turns.select(
        *SESSION,
        "turn",
        F.col("o.ts").alias("ts"),
        F.col("o.model").alias("model"),
        F.col("o.usage").alias("usage"),
        prompt_tokens(F.col("o.usage")).alias("prompt_tokens"),
        "anchor_seq",
        "response_start_seq",
        "event_count",
        "first_seq",
    )
