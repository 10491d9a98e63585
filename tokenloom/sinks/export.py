"""NDJSON export: session, turn and item records that add up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.secrets import redacted
from tokenloom.schema import SESSION

SCHEMA_VERSION = 1


def export_records(sessions: DataFrame, snapshots: DataFrame, items: DataFrame, redact: bool = True) -> DataFrame:
    """One JSON text per record, with the columns that order them.

    A session record, a turn record per snapshot, its items, and always one
    record for the unattributed remainder, so items of a turn sum to its total.
    """
    clean = (lambda c: redacted(c)) if redact else (lambda c: c)
    zero, none = F.lit(0).cast("bigint"), lambda t: F.lit(None).cast(t)
    head = sessions.select(
        *SESSION,
        zero.alias("turn"),
        F.lit(0).alias("part"),
        zero.alias("seq"),
        F.to_json(
            F.struct(
                F.lit("session").alias("type"),
                F.lit(SCHEMA_VERSION).alias("schema"),
                clean(F.col("session_id")).alias("id"),
                "agent",
                clean(F.col("path")).alias("path"),
                clean(F.col("project")).alias("project"),
                clean(F.col("model")).alias("model"),
                "turns",
                "events",
                F.lit("redacted" if redact else "none").alias("redaction"),
                "fidelity",
            )
        ).alias("value"),
    )
    turn = snapshots.select(
        *SESSION,
        "turn",
        F.lit(1).alias("part"),
        zero.alias("seq"),
        F.to_json(
            F.struct(
                F.lit("turn").alias("type"),
                "turn",
                F.col("total").alias("total_tokens"),
                "total_confidence",
                F.col("accounted").alias("accounted_tokens"),
                F.col("residual").alias("residual_tokens"),
                F.col("item_count").alias("items"),
                "calibration_scale",
            )
        ).alias("value"),
    )
    item = lambda **f: F.to_json(F.struct(F.lit("item").alias("type"), *[c.alias(k) for k, c in f.items()]))
    rows = items.select(
        *SESSION,
        "turn",
        F.lit(2).alias("part"),
        "seq",
        item(
            turn=F.col("turn"),
            id=clean(F.col("item_id")),
            category=F.col("category"),
            label=clean(F.col("label")),
            source=F.col("source_kind"),
            detail=clean(F.col("source_payload")),
            tokens=F.col("tokens"),
            confidence=F.col("confidence"),
            raw_estimate=F.col("raw_estimate"),
            first_seen_turn=F.col("first_seen_turn"),
            line_no=F.col("line_no"),
        ).alias("value"),
    )
    rest = snapshots.select(
        *SESSION,
        "turn",
        F.lit(3).alias("part"),
        zero.alias("seq"),
        item(
            turn=F.col("turn"),
            id=none("string"),
            category=F.lit("unattributed"),
            label=F.lit("Unattributed"),
            tokens=F.col("residual"),
            confidence=F.lit("derived"),
        ).alias("value"),
    )
    return head.unionByName(turn).unionByName(rows).unionByName(rest)


def write_export(records: DataFrame, path: str) -> None:
    """Write the records as text, ordered within each agent's files by session, turn and item."""
    (
        records.repartitionByRange(*SESSION, "turn", "part", "seq")
        .sortWithinPartitions(*SESSION, "turn", "part", "seq")
        .select("agent", "value")
        .write.partitionBy("agent")
        .text(path)
    )
