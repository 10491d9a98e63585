"""What a request carried: context items and their membership in turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.text import item_label
from tokenloom.functions.usage import confidence_name, confidence_rank
from tokenloom.operators.turns import occupies_context
from tokenloom.plans.scan import last_known, running
from tokenloom.schema import AGENT_GRAPH, AGENT_LINEAR, SESSION

# What an injection mechanism puts into the prompt (graph logs).
GRAPH_MECHANISMS = {
    "nested_memory": ("repository-instructions", "instruction-file"),
    "file": ("file-contents", "file"),
    "edited_text_file": ("file-contents", "file"),
    "compact_file_reference": ("summaries", "compaction-summary"),
    "deferred_tools_delta": ("tool-definitions", "harness"),
    "agent_listing_delta": ("tool-definitions", "harness"),
    "mcp_instructions_delta": ("tool-definitions", "harness"),
    "skill_listing": ("developer-instructions", "harness"),
    "invoked_skills": ("developer-instructions", "harness"),
    "dynamic_skill": ("developer-instructions", "harness"),
    "hook_additional_context": ("developer-instructions", "harness"),
    "hook_success": ("developer-instructions", "harness"),
    "plan_mode": ("developer-instructions", "harness"),
    "plan_mode_exit": ("developer-instructions", "harness"),
    "plan_mode_reentry": ("developer-instructions", "harness"),
    "plan_file_reference": ("developer-instructions", "harness"),
}


def name_results(events: DataFrame) -> DataFrame:
    """Add ``call``: the call a record answers, as known when it was logged.

    Only the latest earlier call with the same id counts.  The look-back runs
    per ``(session, call_id)``.
    """
    linked = running(
        events.where(F.col("call_id").isNotNull()),
        [*SESSION, "call_id"],
        "seq",
        {"call": last_known(F.when(F.col("kind") == "tool_call", F.struct("tool", "target")))},
    )
    plain = events.where(F.col("call_id").isNull()).withColumn(
        "call", F.lit(None).cast("struct<tool:string,target:string>")
    )
    return linked.unionByName(plain)


def session_calls(events: DataFrame) -> DataFrame:
    """The last call per id in a session."""
    return (
        events.where((F.col("kind") == "tool_call") & F.col("call_id").isNotNull())
        .groupBy(*SESSION, "call_id")
        .agg(F.max_by(F.struct("tool", "target"), F.col("seq")).alias("call"))
    )


def _summarise(prefix: str) -> Column:
    return F.when(F.length("preview") > 0, F.concat(F.lit(prefix + ": "), F.col("preview"))).otherwise(prefix)


def classify(events: DataFrame) -> DataFrame:
    """Add category, source kind, source payload and label to context-bearing records.

    Expects ``call`` from :func:`name_results` (or a join with
    :func:`session_calls`).
    """
    kind, role, mech = F.col("kind"), F.col("role"), F.col("mechanism")
    linear = F.col("agent") == AGENT_LINEAR
    result = kind.isin("tool_result", "oversized_tool_result")
    result_tool = F.coalesce("tool", F.col("call.tool"), "call_id", F.lit("tool"))
    mech_category = F.create_map(*[F.lit(x) for m, (c, _) in GRAPH_MECHANISMS.items() for x in (m, c)])
    mech_source = F.create_map(*[F.lit(x) for m, (_, s) in GRAPH_MECHANISMS.items() for x in (m, s)])
    injected_category = F.when(
        linear,
        F.when(mech == "base_instructions", "system-instructions")
        .when(mech == "context_compaction", "summaries")
        .otherwise("developer-instructions"),
    ).otherwise(F.coalesce(mech_category[mech], F.lit("other")))
    injected_source = F.when(
        linear, F.when(mech == "base_instructions", "system-prompt").otherwise("harness")
    ).otherwise(F.coalesce(mech_source[mech], F.lit("harness")))
    category = (
        F.when((kind == "message") & (role == "user"), "user-messages")
        .when((kind == "message") & (role == "assistant"), "assistant-messages")
        .when(kind == "message", "developer-instructions")
        .when(kind == "reasoning", "reasoning")
        .when(kind == "tool_call", "tool-calls")
        .when(result, "tool-outputs")
        .when(kind == "context_injection", injected_category)
    )
    source_kind = (
        F.when((kind == "message") & (role == "user"), "user")
        .when((kind == "message") & (role == "assistant"), "model")
        .when(kind == "message", "harness")
        .when(kind == "reasoning", "model")
        .when(kind.isin("tool_call") | result, "tool")
        .when(kind == "context_injection", injected_source)
    )
    payload = (
        F.when((kind == "message") & role.isin("developer", "system"), F.when(linear, "developer message").otherwise("system message"))
        .when(kind == "tool_call", F.col("tool"))
        .when(result, result_tool)
        .when(
            kind == "context_injection",
            F.when(source_kind == "harness", mech).when(
                source_kind.isin("instruction-file", "file"), F.col("label")
            ),
        )
    )
    oversized_note = (
        F.when(
            (F.col("image_count") == 0) & (F.col("image_payload_chars") == 0) & (F.col("char_len") == 0),
            "oversized output; size unmeasured",
        )
        .when(F.col("image_count") == 0, "oversized output; partial size")
        .otherwise(
            F.concat(
                F.lit("tool output; "),
                F.col("image_count").cast("string"),
                F.lit(" inline image(s), "),
                F.col("image_payload_chars").cast("string"),
                F.lit(" payload chars excluded from text estimate"),
            )
        )
    )
    answered = item_label(result_tool, F.col("call.target"))
    label = (
        F.when((kind == "message") & (role == "user"), _summarise("User message"))
        .when((kind == "message") & (role == "assistant"), _summarise("Assistant message"))
        .when(kind == "message", F.when(linear, "Developer instructions").otherwise("System message"))
        .when(
            kind == "reasoning",
            F.when(linear, "Reasoning").when(F.col("redacted"), "Thinking (redacted, size derived)").otherwise("Thinking"),
        )
        .when(kind == "tool_call", item_label(F.col("tool"), F.col("target")))
        .when(
            kind == "tool_result",
            F.when(
                F.col("raw_type") == "response_item/image_generation_call",
                "Image generation [media tokens unmeasured]",
            ).otherwise(answered),
        )
        .when(kind == "oversized_tool_result", F.concat(answered, F.lit(" ["), oversized_note, F.lit("]")))
        .when(kind == "context_injection", F.col("label"))
    )
    return (
        events.withColumn("category", category)
        .withColumn("source_kind", source_kind)
        .withColumn("source_payload", payload)
        .withColumn("item_label", label)
    )


ITEM_COLUMNS = [
    *SESSION,
    "item_id",
    "seq",
    "line_no",
    "category",
    "source_kind",
    "source_payload",
    "label",
    "char_len",
    "first_seen_turn",
    "membership_confidence",
]


def item_pool(events: DataFrame) -> DataFrame:
    """Every record that can be a context item, once, whatever turns hold it.

    ``events`` carries ``turn`` and ``call``.  In straight logs a compaction
    contributes one summary item sized by its record.
    """
    linear = F.col("agent") == AGENT_LINEAR
    occupying = classify(events).where(occupies_context()).where(F.col("category").isNotNull())
    prefix = F.when(linear, "codex:").otherwise("claude:")
    body = occupying.select(
        *SESSION,
        F.concat(prefix, F.col("line_no").cast("string")).alias("item_id"),
        "seq",
        "line_no",
        "category",
        "source_kind",
        "source_payload",
        F.col("item_label").alias("label"),
        F.coalesce("char_len", F.lit(0)).cast("bigint").alias("char_len"),
        F.col("turn").alias("first_seen_turn"),
        F.when(linear, "estimated").otherwise("observed").alias("membership_confidence"),
    )
    summaries = events.where(linear & (F.col("kind") == "compacted")).select(
        *SESSION,
        F.concat(F.lit("codex:compaction:"), F.col("line_no").cast("string")).alias("item_id"),
        "seq",
        "line_no",
        F.lit("summaries").alias("category"),
        F.lit("compaction-summary").alias("source_kind"),
        F.lit(None).cast("string").alias("source_payload"),
        F.lit("Compacted history").alias("label"),
        F.col("byte_len").cast("bigint").alias("char_len"),
        F.col("turn").alias("first_seen_turn"),
        F.lit("estimated").alias("membership_confidence"),
    )
    return body.unionByName(summaries)


#: Positions of a log that meet in one group when items are joined to turns.
MEMBER_RANGE = 4_096


def linear_members(pool: DataFrame, turns: DataFrame, width: int = MEMBER_RANGE) -> DataFrame:
    """Items of the given turns of straight logs.

    ``turns`` carries ``cutoff_seq`` and ``comp_seq``; pass only the turns
    wanted, because the result lists every item of every turn.  A turn reads the
    ranges of ``width`` positions between its compaction and its cutoff, the
    system prompts (range -1) and the summary of its compaction (a range of its
    own below that), so items of other epochs never meet it and a long session
    is many groups.  Each item lies in one range: no pair appears twice.
    """
    summary = F.col("source_kind") == "compaction-summary"
    system = F.col("source_kind") == "system-prompt"
    items = pool.withColumn(
        "__range",
        F.when(summary, -F.col("seq") - 2)
        .when(system, F.lit(-1))
        .otherwise(F.floor(F.col("seq") / F.lit(width)))
        .cast("bigint"),
    )
    first = F.floor((F.coalesce("comp_seq", F.lit(-1)) + 1) / F.lit(width)).cast("bigint")
    last = F.floor((F.col("cutoff_seq") - 1) / F.lit(width)).cast("bigint")
    own = F.when(F.col("comp_seq").isNotNull(), F.array(F.lit(-1).cast("bigint"), -F.col("comp_seq") - 2)).otherwise(
        F.array(F.lit(-1).cast("bigint"))
    )
    between = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    wanted = turns.where(F.col("cutoff_seq").isNotNull()).select(
        *SESSION, "turn", "cutoff_seq", "comp_seq", F.explode(F.concat(own, between)).alias("__range")
    )
    apart = F.col("comp_seq").isNull() | (F.col("__range") < 0) | (F.col("seq") > F.col("comp_seq"))
    return (
        items.join(wanted, [*SESSION, "__range"])
        .where((F.col("seq") < F.col("cutoff_seq")) & apart)
        .drop("cutoff_seq", "comp_seq", "__range")
    )


def promote_current_prompt(items: DataFrame) -> DataFrame:
    """The last user message of a turn is the prompt being answered."""
    latest = (
        items.where(F.col("category") == "user-messages")
        .groupBy(*SESSION, "turn")
        .agg(F.max("seq").alias("__prompt_seq"))
    )
    return (
        items.join(latest, [*SESSION, "turn"], "left")
        .withColumn(
            "category",
            F.when(
                (F.col("category") == "user-messages") & (F.col("seq") == F.col("__prompt_seq")),
                "current-prompt",
            ).otherwise(F.col("category")),
        )
        .drop("__prompt_seq")
    )


def item_confidence() -> Column:
    """Membership and size together are as weak as the weaker of the two."""
    size = F.when(F.col("size_kind") == "observed", 0).when(F.col("size_kind") == "exact", 1).otherwise(2)
    return confidence_name(F.greatest(confidence_rank(F.col("membership_confidence")), size))


__all__ = [
    "AGENT_GRAPH",
    "classify",
    "item_confidence",
    "item_pool",
    "linear_members",
    "name_results",
    "promote_current_prompt",
    "session_calls",
]
