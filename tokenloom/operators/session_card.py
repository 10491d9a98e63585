"""The detail card of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.usage import context_window_at
from tokenloom.operators.composition import peak_turns
from tokenloom.operators.corpus import fidelity
from tokenloom.operators.growth import unplaced_compactions
from tokenloom.schema import SESSION


def session_cards(facts: DataFrame, events: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per session: volume, peak and the window at the peak, losses.

    ``facts`` is the per-session table with the session's own ``model`` and
    ``context_window``.
    """
    at_peak = turns.join(peak_turns(turns).select(*SESSION, "turn"), [*SESSION, "turn"], "left_semi").select(
        *SESSION,
        F.col("turn").alias("peak_turn"),
        F.col("model").alias("peak_model"),
        F.col("usage.context_window").alias("peak_window"),
    )
    unnamed = turns.groupBy(*SESSION).agg(F.count_if(F.col("model").isNull()).alias("unattributed_model_turns"))
    zero = F.lit(0).cast("bigint")
    return (
        facts.join(at_peak, SESSION, "left")
        .join(unnamed, SESSION, "left")
        .join(unplaced_compactions(events), SESSION, "left")
        .select(
            "session_id",
            F.col("events").alias("event_count"),
            F.col("turns").alias("turn_count"),
            F.col("output_tokens").alias("total_output_tokens"),
            "peak_turn",
            "peak_prompt_tokens",
            F.when(
                F.col("peak_turn").isNotNull(),
                context_window_at(F.col("peak_window"), F.col("peak_model"), F.col("context_window"), F.col("model")),
            ).alias("context_window"),
            fidelity(F.col("unrecognised_events"), F.col("events")).alias("fidelity"),
            "unrecognised_events",
            F.coalesce("unplaced_compactions", zero).alias("unplaced_compactions"),
            F.coalesce("unattributed_model_turns", zero).alias("unattributed_model_turns"),
        )
    )
