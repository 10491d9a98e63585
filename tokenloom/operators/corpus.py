"""Totals over all sessions: activity, tools, projects, pressure, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.text import path_has_prefix
from tokenloom.operators.composition import peak_turns
from tokenloom.operators.growth import reclaimed
from tokenloom.schema import SESSION

TOP_N = 12


def session_event_facts(events: DataFrame) -> DataFrame:
    """Per session: record counts, losses, compactions.  One map-side aggregation."""
    compacted = F.col("kind") == "compacted"
    facts = F.col("compaction")
    return events.groupBy(*SESSION).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("kind") == "unrecognised").alias("unrecognised_events"),
        F.count_if(compacted).alias("compactions"),
        F.count_if(compacted & facts["tokens_before"].isNotNull() & facts["tokens_after"].isNotNull()).alias(
            "compactions_measured"
        ),
        F.coalesce(F.sum(F.when(compacted, reclaimed(facts))), F.lit(0)).alias("reclaimed_tokens"),
        F.count_if((F.col("kind") == "reasoning") & F.col("redacted")).alias("redacted_reasoning"),
    )


def session_turn_facts(turns: DataFrame) -> DataFrame:
    """Per session: turns, output, peak, first day, incomplete turns."""
    stamped = F.col("ts").isNotNull()
    return turns.groupBy(*SESSION).agg(
        F.count(F.lit(1)).alias("turns"),
        F.coalesce(F.sum("usage.output"), F.lit(0)).alias("output_tokens"),
        F.max("prompt_tokens").alias("peak_prompt_tokens"),
        F.to_date(F.min_by("ts", F.when(stamped, F.col("turn")))).alias("first_day"),
        F.count_if(F.col("prompt_tokens").isNull()).alias("turns_without_usage"),
        F.count_if(F.col("usage.api_calls") > 1).alias("multi_call_turns"),
    )


def fidelity(unrecognised: Column, events: Column) -> Column:
    """Share of records that were understood; 1 for an empty log."""
    return F.lit(1.0) - F.coalesce(F.try_divide(F.least(unrecognised, events), events), F.lit(0.0))


def session_facts(sessions: DataFrame, events: DataFrame, turns: DataFrame) -> DataFrame:
    """The row per session that every corpus report is built from."""
    zero = F.lit(0).cast("bigint")
    counts = [
        "events",
        "unrecognised_events",
        "compactions",
        "compactions_measured",
        "reclaimed_tokens",
        "redacted_reasoning",
        "turns",
        "output_tokens",
        "turns_without_usage",
        "multi_call_turns",
    ]
    joined = sessions.join(session_event_facts(events), SESSION, "left").join(
        session_turn_facts(turns), SESSION, "left"
    )
    return joined.select(
        *[F.col(c) for c in sessions.columns],
        *[F.coalesce(c, zero).alias(c) for c in counts],
        "peak_prompt_tokens",
        "first_day",
    )


def pressure_band(peak: Column, window: Column) -> Column:
    """Fullness band of a session's largest prompt in the session's own window."""
    used = F.try_divide(peak, F.when(window > 0, window))
    return (
        F.when(used.isNull(), "unmeasured")
        .when(used >= 0.9, "critical")
        .when(used >= 0.75, "tight")
        .when(used >= 0.5, "warming")
        .otherwise("comfortable")
    )


def corpus_totals(facts: DataFrame, tools: DataFrame) -> DataFrame:
    """The one-row summary of the whole lake."""
    totals = facts.agg(
        F.count(F.lit(1)).alias("sessions"),
        *[
            F.coalesce(F.sum(c), F.lit(0)).alias(c)
            for c in (
                "turns",
                "events",
                "output_tokens",
                "unrecognised_events",
                "compactions",
                "compactions_measured",
                "reclaimed_tokens",
            )
        ],
        F.count_if(F.col("compactions") > 0).alias("sessions_with_compaction"),
    )
    used = tools.agg(
        F.coalesce(F.sum("calls"), F.lit(0)).alias("tool_calls"),
        F.coalesce(F.sum("errors"), F.lit(0)).alias("tool_errors"),
    )
    # Two one-row results become one row.
    both = totals.unionByName(used, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def totals_by(facts: DataFrame, key: Column, name: str) -> DataFrame:
    return facts.groupBy(key.alias(name)).agg(
        F.count(F.lit(1)).alias("sessions"),
        F.sum("turns").alias("turns"),
        F.sum("events").alias("events"),
        F.sum("output_tokens").alias("output_tokens"),
    )


def by_project(facts: DataFrame, limit: int = TOP_N) -> DataFrame:
    grouped = totals_by(facts, F.coalesce("project", F.lit("unknown project")), "project").drop("events")
    return grouped.orderBy(F.col("turns").desc(), F.col("project")).limit(limit)


def by_day(turns: DataFrame, facts: DataFrame) -> DataFrame:
    """Turns and output per UTC day; a session counts on the day of its first dated turn."""
    activity = turns.where(F.col("ts").isNotNull()).groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("turns"), F.coalesce(F.sum("usage.output"), F.lit(0)).alias("output_tokens")
    )
    started = (
        facts.where(F.col("first_day").isNotNull())
        .groupBy(F.col("first_day").alias("day"))
        .agg(F.count(F.lit(1)).alias("sessions"))
    )
    return activity.join(started, "day", "left").withColumn(
        "sessions", F.coalesce("sessions", F.lit(0).cast("bigint"))
    )


def tool_operations(events: DataFrame) -> DataFrame:
    """Each call and result as its own row, keyed by record and position."""
    return events.select(*SESSION, "seq", "turn", F.posexplode("tool_ops").alias("op_index", "o")).select(
        *SESSION, "seq", "turn", F.col("op_index").cast("bigint").alias("op_index"), "o.*"
    )


def by_tool(operations: DataFrame) -> DataFrame:
    """Calls, errors and result sizes per tool.

    A result names no tool; it takes the name of the last call with its id in
    the session, else "unattributed".
    """
    calls = (
        operations.where((F.col("op") == "tool_call") & F.col("call_id").isNotNull())
        .groupBy(*SESSION, "call_id")
        .agg(F.max_by("tool", F.struct("seq", "op_index")).alias("called"))
    )
    named = operations.join(calls, [*SESSION, "call_id"], "left")
    result = F.col("op") == "tool_result"
    name = F.when(result, F.coalesce("tool", "called", F.lit("unattributed"))).otherwise(F.col("tool"))
    return named.groupBy(name.alias("tool")).agg(
        F.count_if(~result).alias("calls"),
        F.count_if(result & F.col("is_error")).alias("errors"),
        F.coalesce(F.sum(F.when(result, F.col("char_len"))), F.lit(0)).alias("result_chars"),
    )


def top_tools(tools: DataFrame, limit: int = TOP_N) -> DataFrame:
    return tools.orderBy(F.col("result_chars").desc(), F.col("tool")).limit(limit)


def by_model(turns: DataFrame) -> DataFrame:
    """Turns per model; turns without one are a group of their own (NULL)."""
    return turns.groupBy("model").agg(F.count(F.lit(1)).alias("turns"))


def pressure_bands(facts: DataFrame) -> DataFrame:
    return facts.groupBy(
        pressure_band(F.col("peak_prompt_tokens"), F.col("context_window")).alias("band")
    ).agg(F.count(F.lit(1)).alias("sessions"))


def largest_sessions(facts: DataFrame, limit: int = TOP_N) -> DataFrame:
    return (
        facts.where(F.col("peak_prompt_tokens").isNotNull())
        .orderBy(F.col("peak_prompt_tokens").desc(), *SESSION)
        .limit(limit)
    )


def costliest_sessions(costs: DataFrame, limit: int = TOP_N) -> DataFrame:
    return costs.where(F.col("total_micros") > 0).orderBy(F.col("total_micros").desc(), *SESSION).limit(limit)


def diagnostics(facts: DataFrame, turns: DataFrame) -> DataFrame:
    """The health row of every session."""
    peaks = peak_turns(turns).select(*SESSION, F.col("turn").alias("peak_turn"))
    return facts.join(peaks, SESSION, "left").withColumn(
        "fidelity", fidelity(F.col("unrecognised_events"), F.col("events"))
    )


def fidelity_trend(events: DataFrame) -> DataFrame:
    """Understood share per turn; records outside every turn are the NULL turn."""
    return (
        events.groupBy(*SESSION, "turn")
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.count_if(F.col("kind") == "unrecognised").alias("unrecognised_events"),
        )
        .withColumn("fidelity", fidelity(F.col("unrecognised_events"), F.col("events")))
    )


class NothingMatched(ValueError):
    """A drift sweep whose path prefix selects no session is a failure, not a clean bill."""


def require_match(sessions: DataFrame, prefix: str | None) -> DataFrame:
    """The sessions under a path prefix; raises when a given prefix selects none."""
    chosen = sessions.where(path_has_prefix(F.col("path"), prefix))
    if prefix and chosen.isEmpty():
        raise NothingMatched(f"no session path starts with '{prefix}'")
    return chosen


def format_drift(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Unknown record types per agent: how many records and sessions, and one example."""
    # Counted per session first, so a type that floods one session stays one row.
    per_session = (
        events.where(F.col("kind") == "unrecognised")
        .groupBy(*SESSION, "raw_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(sessions.select(*SESSION), SESSION, "left_semi")
    )
    return per_session.groupBy("agent", "raw_type").agg(
        F.sum("n").alias("events"),
        F.count(F.lit(1)).alias("sessions"),
        F.min("session_id").alias("example"),
    )


def scanned_by_agent(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("agent").agg(F.count(F.lit(1)).alias("sessions_scanned"))
