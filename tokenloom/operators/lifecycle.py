"""When a context item entered the prompt, left it and came back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.plans.scan import (
    dense_number,
    last_known,
    next_known,
    running,
    running_count,
)
from tokenloom.schema import AGENT_GRAPH, SESSION

THREAD = [*SESSION, "side"]
ITEM = [*SESSION, "item_id"]


def number_scans(scans: DataFrame) -> DataFrame:
    """Position of every turn in its thread, what follows it and what was unreadable so far.

    ``scans``: session, ``turn``, ``side``, ``readable``, ``compaction_line``.
    """
    following = F.struct("turn", "readable", "compaction_line")
    return running(
        scans,
        THREAD,
        "turn",
        {
            "ordinal": running_count(F.lit(True), inclusive=True),
            "unread": running_count(~F.col("readable"), inclusive=True),
            "next": next_known(following, inclusive=False),
        },
    )


def item_runs(presence: DataFrame, numbered: DataFrame) -> DataFrame:
    """Unbroken stretches of turns holding an item (gaps and islands).

    ``presence``: session, ``item_id``, ``side``, ``turn``.  A turn that does
    not hold the item, readable or not, ends a stretch.
    """
    placed = presence.join(numbered.select(*THREAD, "turn", "ordinal"), [*THREAD, "turn"])
    ranked = dense_number(placed, ITEM, "turn", "seen")
    return (
        ranked.withColumn("island", F.col("ordinal") - F.col("seen"))
        .groupBy(*ITEM, "side", "island")
        .agg(
            F.min("turn").alias("from_turn"),
            F.max("turn").alias("to_turn"),
            F.count(F.lit(1)).alias("turns"),
        )
        .drop("island")
    )


def thread_order(bases: DataFrame) -> DataFrame:
    """Every turn's position in its thread and where the chains of its neighbours begin.

    ``bases``: session, ``side``, ``turn``, ``base``, ``base_entry`` (NULL: nothing held).
    """
    place = F.struct("base_entry")
    return running(
        bases,
        THREAD,
        "turn",
        {
            "ordinal": running_count(F.lit(True), inclusive=True),
            "__before": last_known(place),
            "__after": next_known(place, inclusive=False),
        },
    ).select(*THREAD, "turn", "ordinal", "base", "base_entry", F.col("__before.base_entry").alias("before"), F.col("__after.base_entry").alias("after"))


def change_runs(changes: DataFrame) -> DataFrame:
    """Unbroken stretches from their ends: every entry goes with the next leaving.

    ``changes``: session, ``item_id``, ``side``, ``turn``, ``ordinal``, ``enters``.
    """
    leaves = ~F.col("enters")
    # An item may enter and leave within one turn; the entry comes first.
    ranked = changes.withColumn("__at", F.col("ordinal") * 2 + leaves.cast("bigint"))
    paired = running(
        ranked, ITEM, "__at", {"__to": next_known(F.when(leaves, F.struct("turn", "ordinal")), inclusive=False)}
    ).where("enters")
    return paired.select(
        *ITEM,
        "side",
        F.col("turn").alias("from_turn"),
        F.col("__to.turn").alias("to_turn"),
        (F.col("__to.ordinal") - F.col("ordinal") + 1).alias("turns"),
    )


def departure(agent: Column, nxt: Column, held: Column) -> Column:
    """Why an item left after its last turn; NULL when it did not or nobody knows."""
    moved = nxt["compaction_line"].isNotNull() & ~nxt["compaction_line"].eqNullSafe(held)
    return F.when(nxt.isNotNull() & nxt["readable"], F.when(moved, "compaction").when(agent == AGENT_GRAPH, "branch-diverged").otherwise("unexplained"))


def lifecycles(runs: DataFrame, numbered: DataFrame, recorded: DataFrame) -> DataFrame:
    """One row per item: span, stretches, departure, doubts.

    ``recorded`` = (session, item_id, first_seen_turn), what the log itself said.
    """
    spans = runs.groupBy(*ITEM, "side").agg(
        F.min("from_turn").alias("first_present"),
        F.max("to_turn").alias("last_present"),
        F.sum("turns").alias("turns_present"),
        F.count(F.lit(1)).alias("runs"),
    )
    at_end = numbered.select(
        *THREAD,
        F.col("turn").alias("last_present"),
        F.col("unread").alias("unread_end"),
        F.col("next"),
        F.col("compaction_line").alias("held"),
    )
    at_start = numbered.select(
        *THREAD, F.col("turn").alias("first_present"), F.col("unread").alias("unread_start")
    )
    joined = (
        spans.join(at_end, [*THREAD, "last_present"])
        .join(at_start, [*THREAD, "first_present"])
        .join(recorded.select(*ITEM, "first_seen_turn"), ITEM, "left")
    )
    blocked = F.coalesce(~F.col("next.readable"), F.lit(False))
    return joined.select(
        *ITEM,
        "first_present",
        "last_present",
        "turns_present",
        "runs",
        F.col("next").isNull().alias("still_present"),
        departure(F.col("agent"), F.col("next"), F.col("held")).alias("departure"),
        F.col("next.turn").alias("departure_turn"),
        (F.col("unread_end") - F.col("unread_start") + blocked.cast("bigint")).alias("unknown_turns"),
        F.coalesce(F.col("first_seen_turn") != F.col("first_present"), F.lit(False)).alias("first_seen_disagrees"),
    )


def linear_spans(assigned: DataFrame, turns: DataFrame, pool: DataFrame) -> DataFrame:
    """First and last turn holding each item of straight logs, without listing the turns.

    Prompts of a straight log only grow until the next compaction, so an item is
    present in one stretch: from the first response that began after it to the
    last one that began before the next compaction.  System prompts stay to the
    end.
    """
    cutoffs = turns.select(*SESSION, F.col("cutoff_seq").alias("seq"), F.col("turn").alias("cut_turn"))
    marked = assigned.select(*SESSION, "seq", "kind").join(cutoffs, [*SESSION, "seq"], "left")
    first = running(
        marked,
        SESSION,
        "seq",
        {
            "from_turn": next_known(F.col("cut_turn"), inclusive=False),
            "upto": last_known(F.col("cut_turn"), inclusive=True),
        },
    )
    bounded = running(
        first,
        SESSION,
        "seq",
        {"at_comp": next_known(F.when(F.col("kind") == "compacted", F.struct("upto")), inclusive=False)},
    ).select(*SESSION, "seq", "from_turn", "at_comp")
    last_turn = turns.groupBy(*SESSION).agg(F.max("turn").alias("last_turn"))
    stays = F.col("at_comp").isNull() | (F.col("source_kind") == "system-prompt")
    placed = (
        pool.join(bounded, [*SESSION, "seq"])
        .join(last_turn, SESSION)
        .withColumn("to_turn", F.when(stays, F.col("last_turn")).otherwise(F.col("at_comp.upto")))
        .where(F.col("from_turn").isNotNull() & (F.col("to_turn") >= F.col("from_turn")))
    )
    return placed.select(
        *ITEM,
        "label",
        F.col("from_turn").alias("first_present"),
        F.col("to_turn").alias("last_present"),
        (F.col("to_turn") - F.col("from_turn") + 1).alias("turns_present"),
        (F.col("to_turn") == F.col("last_turn")).alias("still_present"),
        F.when(F.col("to_turn") < F.col("last_turn"), "compaction").alias("departure"),
        F.coalesce(F.col("first_seen_turn") != F.col("from_turn"), F.lit(False)).alias("first_seen_disagrees"),
    )


class ItemNotFound(LookupError):
    pass


def resolve_item(spans: DataFrame, needle: str) -> DataFrame:
    """The item an id or part of a label means; several candidates come longest-present first."""
    wanted = needle.strip()
    exact = spans.where(F.col("item_id") == wanted)
    if not exact.isEmpty():
        return exact
    matched = spans.where(F.lower("label").contains(wanted.lower()))
    if matched.isEmpty():
        raise ItemNotFound(wanted)
    return matched.orderBy(F.col("turns_present").desc(), "item_id")
