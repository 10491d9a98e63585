"""How prompts grow from turn to turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.plans.scan import dense_number, last_known, running
from tokenloom.plans.skew import top_k_per_group
from tokenloom.schema import SESSION, SPIKE_TOKENS

TURN = [*SESSION, "turn"]


def reclaimed(facts: F.Column) -> F.Column:
    """Tokens a compaction gave back; NULL when it was not measured."""
    return F.greatest(facts["tokens_before"] - facts["tokens_after"], F.lit(0)) + F.when(
        facts["tokens_before"].isNull() | facts["tokens_after"].isNull(), F.lit(None)
    ).otherwise(F.lit(0))


def timeline(events: DataFrame, turns: DataFrame) -> DataFrame:
    """One point per turn with its prompt size and the last compaction placed in it."""
    marks = (
        events.where((F.col("kind") == "compacted") & F.col("turn").isNotNull())
        .groupBy(*TURN)
        .agg(
            F.max_by(
                F.struct("line_no", F.col("compaction.trigger").alias("trigger"), reclaimed(F.col("compaction")).alias("reclaimed")),
                F.col("seq"),
            ).alias("mark")
        )
    )
    return turns.select(*TURN, "prompt_tokens").join(marks, TURN, "left").select(
        *TURN,
        "prompt_tokens",
        F.col("mark.line_no").alias("compaction_line"),
        F.col("mark.trigger").alias("compaction_trigger"),
        F.col("mark.reclaimed").alias("reclaimed"),
    )


def unplaced_compactions(events: DataFrame) -> DataFrame:
    """Compactions after the last turn, per session."""
    return (
        events.where((F.col("kind") == "compacted") & F.col("turn").isNull())
        .groupBy(*SESSION)
        .agg(F.count(F.lit(1)).alias("unplaced_compactions"))
    )


def in_range(points: DataFrame, first: int | None = None, last: int | None = None, column: str = "turn") -> DataFrame:
    if first is not None:
        points = points.where(F.col(column) >= first)
    if last is not None:
        points = points.where(F.col(column) <= last)
    return points


def largest_jumps(points: DataFrame, k: int) -> DataFrame:
    """The ``k`` largest changes between consecutive *measured* turns.

    Turns without a size are bridged and counted in ``skipped``.
    """
    measured = points.where(F.col("prompt_tokens").isNotNull())
    previous = running(
        measured, SESSION, "turn", {"p": last_known(F.struct("turn", "prompt_tokens"))}
    ).where(F.col("p").isNotNull())
    jumps = previous.select(
        *TURN,
        F.col("p.prompt_tokens").alias("from_tokens"),
        F.col("prompt_tokens").alias("to_tokens"),
        (F.col("prompt_tokens") - F.col("p.prompt_tokens")).alias("growth"),
        (F.col("turn") - F.col("p.turn") - 1).alias("skipped"),
    )
    return top_k_per_group(
        jumps, SESSION, [F.abs("growth").desc(), F.col("turn").asc()], k, spread=F.col("turn")
    )


def chart_buckets(points: DataFrame, width: int) -> DataFrame:
    """Equal runs of turns, at most ``width`` per session: peak and compactions of each."""
    sizes = points.groupBy(*SESSION).agg(F.ceil(F.count(F.lit(1)) / F.lit(width)).cast("bigint").alias("per"))
    placed = dense_number(points, SESSION, "turn").join(sizes, SESSION)
    return (
        placed.withColumn("bucket", F.floor((F.col("n") - 1) / F.col("per")).cast("bigint"))
        .groupBy(*SESSION, "bucket")
        .agg(
            F.min("turn").alias("from_turn"),
            F.max("turn").alias("to_turn"),
            F.max("prompt_tokens").alias("peak"),
            F.count("compaction_line").alias("compactions"),
        )
    )


def prompt_spikes(turns: DataFrame, threshold: int = SPIKE_TOKENS) -> DataFrame:
    """Turns that grew by at least ``threshold`` over the turn right before.

    Unlike jumps, an unmeasured turn in between breaks the pair.
    """
    pairs = running(
        turns.select(*TURN, "prompt_tokens"), SESSION, "turn", {"p": last_known(F.struct("prompt_tokens"))}
    )
    before = F.col("p.prompt_tokens")
    return pairs.where((before > 0) & (F.col("prompt_tokens") - before >= threshold)).select(
        *TURN,
        before.alias("previous_tokens"),
        F.col("prompt_tokens").alias("tokens"),
        (F.col("prompt_tokens") - before).alias("growth"),
    )


def spike_causes(spikes: DataFrame, events: DataFrame, calls: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` largest tool records and injections of each spiking turn."""
    candidates = (
        events.where(F.col("kind").isin("tool_result", "tool_call", "context_injection"))
        .join(spikes.select(*TURN), TURN, "left_semi")
        .select(*TURN, "seq", "kind", "tool", "call_id", "label", F.coalesce("char_len", F.lit(0)).alias("chars"))
        .join(calls.withColumnRenamed("call", "answered"), [*SESSION, "call_id"], "left")
    )
    name = F.coalesce("tool", F.col("answered.tool"), "call_id", F.lit("tool"))
    described = candidates.withColumn(
        "cause",
        F.when(F.col("kind") == "tool_result", F.concat(F.lit("tool output: "), name))
        .when(F.col("kind") == "tool_call", F.concat(F.lit("tool call: "), F.col("tool")))
        .otherwise(F.concat(F.lit("injected: "), F.col("label"))),
    )
    return top_k_per_group(
        described, TURN, [F.col("chars").desc(), F.col("seq").asc()], k, spread=F.col("seq")
    ).select(*TURN, "rank", "cause", "chars")
