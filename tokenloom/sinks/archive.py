"""Redacted copies of session logs, with a manifest that can be verified."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.secrets import redact_record
from tokenloom.plans.digest import ordered_digest
from tokenloom.schema import SESSION

Transform = Callable[[Column], Column]


def copy_lines(lines: DataFrame, transform: Transform = redact_record) -> DataFrame:
    """Lines (session, ``line_no``, ``raw``) with their archived form and replacement count."""
    return lines.withColumn("__t", transform(F.col("raw"))).select(
        *SESSION, "line_no", "raw", F.col("__t.text").alias("archived"), F.col("__t.n").alias("replaced")
    )


def log_digest(lines: DataFrame, column: str, name: str) -> DataFrame:
    hashed = lines.select(*SESSION, "line_no", F.sha2(column, 256).alias("d"))
    return ordered_digest(hashed, SESSION, "line_no", "d", name)


def manifest_entries(copied: DataFrame, mode: str, archived_at: Column) -> DataFrame:
    """One manifest row per archived session."""
    sums = copied.groupBy(*SESSION).agg(
        F.count(F.lit(1)).alias("records"),
        F.sum(F.octet_length("raw") + 1).alias("source_bytes"),
        F.sum(F.octet_length("archived") + 1).alias("archived_bytes"),
        F.count_if(F.col("replaced") > 0).alias("redacted_records"),
        F.sum("replaced").alias("redacted_values"),
    )
    return (
        sums.join(log_digest(copied, "raw", "source_digest"), SESSION)
        .join(log_digest(copied, "archived", "archived_digest"), SESSION)
        .withColumn("redaction", F.lit(mode))
        .withColumn("archived_at", archived_at)
    )


def write_archive(copied: DataFrame, path: str) -> None:
    """Store the copies by agent; a session may span files, its lines stay in order."""
    (
        copied.select(*SESSION, "line_no", F.col("archived").alias("raw"))
        .repartitionByRange(*SESSION, "line_no")
        .sortWithinPartitions(*SESSION, "line_no")
        .write.partitionBy("agent")
        .parquet(path)
    )


def read_manifest(lines: DataFrame) -> DataFrame:
    """Manifest rows from JSON lines (``seq``, ``value``); unreadable lines are skipped."""
    schema = (
        "agent string, session_id string, archived_at timestamp, redaction string, records bigint, source_bytes bigint,"
        " archived_bytes bigint, source_digest string, archived_digest string, redacted_records bigint, redacted_values bigint"
    )
    parsed = lines.select("seq", F.from_json("value", schema).alias("m"))
    return parsed.where(F.col("m.agent").isNotNull() & F.col("m.session_id").isNotNull()).select("seq", "m.*")


def latest_entries(manifest: DataFrame) -> DataFrame:
    """The last appended entry of each session."""
    rest = [c for c in manifest.columns if c not in SESSION]
    return manifest.groupBy(*SESSION).agg(F.max_by(F.struct(*rest), F.col("seq")).alias("e")).select(*SESSION, "e.*")


def list_archive(latest: DataFrame) -> DataFrame:
    """Newest first, then by id."""
    return latest.orderBy(F.col("archived_at").desc(), "session_id", "agent")


def verify(latest: DataFrame, stored: DataFrame, source: DataFrame) -> DataFrame:
    """Integrity of every archived session.

    ``stored`` and ``source`` = (session, ``digest``) recomputed today.  A
    damaged copy outranks everything, then a missing source, then a changed one.
    """
    joined = (
        latest.join(stored.select(*SESSION, F.col("digest").alias("now_copy")), SESSION, "left")
        .join(source.select(*SESSION, F.col("digest").alias("now_source")), SESSION, "left")
    )
    outcome = (
        F.when(~F.col("now_copy").eqNullSafe(F.col("archived_digest")), "archive-damaged")
        .when(F.col("now_source").isNull(), "source-gone")
        .when(F.col("now_source") != F.col("source_digest"), "source-changed")
        .otherwise("intact")
    )
    return joined.select(*SESSION, outcome.alias("integrity")).select(
        "*",
        (F.col("integrity") != "archive-damaged").alias("copy_is_sound"),
        F.col("integrity").isin("source-changed", "archive-damaged").alias("rebuildable"),
    )
