"""The alert feed: written once per finding, paged, marked and pruned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.text import alert_key
from tokenloom.plans.scan import running, running_count, running_min
from tokenloom.session import cut


def qualify(alerts: DataFrame) -> DataFrame:
    """Give every candidate its feed-wide key."""
    return alerts.withColumn(
        "dedupe_key", alert_key(F.col("rule"), F.col("agent"), F.col("session_id"), F.col("dedupe_key"))
    )


def unseen(alerts: DataFrame, seen_keys: DataFrame) -> DataFrame:
    """Candidates that were never in the feed, one per key; the earliest wins.

    Keys are kept apart from the records, so clearing the feed does not bring
    old findings back.
    """
    first = alerts.groupBy("dedupe_key").agg(
        F.min_by(F.struct(*[c for c in alerts.columns if c != "dedupe_key"]), F.struct("seq", "agent", "session_id")).alias("a")
    )
    return first.join(seen_keys.select("dedupe_key"), "dedupe_key", "left_anti").select("dedupe_key", "a.*")


def number(alerts: DataFrame, after_id: int, detected_at: Column, catch_up: bool) -> DataFrame:
    """Turn new candidates into feed records with increasing ids."""
    placed = cut(alerts.withColumn("__m", F.monotonically_increasing_id()))
    numbered = running(
        placed.withColumn("__feed", F.lit(1)),
        ["__feed"],
        "__m",
        {"n": running_count(F.lit(True), inclusive=True)},
        block=F.shiftright(F.col("__m"), 33),
    )
    return numbered.drop("__feed", "__m").select(
        (F.lit(after_id) + F.col("n")).alias("id"),
        *alerts.columns,
        detected_at.alias("detected_at"),
        F.lit(catch_up).alias("catch_up"),
    )


def prune(records: DataFrame, now: Column, days: int | None = None, newest: int | None = None) -> DataFrame:
    """Records of the last ``days``, and of those the ``newest``; without limits all stay."""
    if days is not None:
        records = records.where(F.col("detected_at") >= now - F.make_dt_interval(F.lit(days)))
    return records if newest is None else records.orderBy(F.col("id").desc()).limit(newest)


def feed_page(records: DataFrame, before_id: int | None = None, limit: int = 50) -> DataFrame:
    """Newest first, below ``before_id``."""
    part = records if before_id is None else records.where(F.col("id") < before_id)
    return part.orderBy(F.col("id").desc()).limit(limit)


def with_state(records: DataFrame, marks: DataFrame) -> DataFrame:
    """Add ``read_at`` and ``dismissed_at`` from an append-only log of marks.

    ``records`` are the pruned feed.  ``marks`` = (``id`` or NULL for all, ``up_to_id``, ``action``, ``at``).  The first mark of
    a kind counts.  A mark without id covers every record that existed then.
    """
    single = marks.where(F.col("id").isNotNull()).groupBy("id").agg(
        F.min(F.when(F.col("action") == "read", F.col("at"))).alias("one_read"),
        F.min(F.when(F.col("action") == "dismiss", F.col("at"))).alias("dismissed_at"),
    )
    # A mark for all is spread over the records it covers as a running minimum
    # from the newest id down, in blocks of ids.
    everything = (
        marks.where(F.col("id").isNull() & (F.col("action") == "read"))
        .groupBy(F.col("up_to_id").alias("id"))
        .agg(F.min("at").alias("at"))
    )
    points = (
        records.select("id", F.lit(None).cast("timestamp").alias("at"), F.lit(True).alias("is_record"))
        .unionByName(everything.withColumn("is_record", F.lit(False)))
        .groupBy("id")
        .agg(F.min("at").alias("at"), F.max("is_record").alias("is_record"))
        .select("*", (-F.col("id")).alias("falling"), F.lit(1).alias("feed"))
    )
    covered = (
        running(points, ["feed"], "falling", {"all_read": running_min(F.col("at"), inclusive=True)})
        .where("is_record")
        .select("id", "all_read")
    )
    return (
        records.join(single, "id", "left")
        .join(covered, "id", "left")
        .withColumn("read_at", F.least("one_read", "all_read"))
        .drop("one_read", "all_read")
    )
