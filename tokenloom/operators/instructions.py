"""Instructions over time, and recorded bodies against today's files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.text import comparable_path
from tokenloom.plans.scan import last_known, running
from tokenloom.schema import SESSION

TRACKED = ["base_instructions", "nested_memory", "skill", "dynamic_skill"]


def instruction_drift(events: DataFrame) -> DataFrame:
    """Instructions whose recorded size differs from the last time they were injected.

    Identity is mechanism and label, so a renamed file starts a new history.
    """
    seen = events.where((F.col("kind") == "context_injection") & F.col("mechanism").isin(*TRACKED)).select(
        *SESSION, "mechanism", "label", "seq", "turn", "char_len"
    )
    return (
        running(seen, [*SESSION, "mechanism", "label"], "seq", {"p": last_known(F.struct("turn", "char_len"))})
        .where(F.col("p").isNotNull() & (F.col("p.char_len") != F.col("char_len")))
        .select(
            *SESSION,
            "mechanism",
            "label",
            F.col("p.turn").alias("from_turn"),
            F.col("turn").alias("to_turn"),
            F.col("p.char_len").alias("from_char_len"),
            F.col("char_len").alias("to_char_len"),
            "seq",
        )
    )


def read_instruction_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Digest and size of today's instruction files below ``path`` whose name matches ``glob``."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    )
    return files.select(
        F.regexp_replace("path", "^file:", "").alias("path"),
        F.lit(True).alias("regular"),
        F.col("length").alias("bytes"),
        F.sha2("content", 256).alias("digest"),
        F.length(F.decode("content", "utf-8")).cast("bigint").alias("chars"),
    )


def compare_files(recorded: DataFrame, files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Status of every recorded instruction body against the current file.

    ``recorded``: session, ``line_no``, ``turn``, ``label``, ``fp``, ``char_len``,
    ``root``; ``files``: ``path``, ``regular``, ``bytes``, ``digest``, ``chars``
    (a file that could not be read has none of the last three).  Files above
    ``max_bytes`` are reported as too large; without it every file is compared.
    """
    placed = recorded.withColumn("resolved", comparable_path(F.col("label"), F.col("root")))
    joined = placed.join(files.withColumnRenamed("path", "resolved"), "resolved", "left")
    status = (
        F.when(F.col("fp").isNull(), "recordedBodyUnavailable")
        .when(F.col("resolved").isNull(), "unsafePath")
        .when(F.col("regular").isNull(), "missing")
        .when(~F.col("regular"), "notRegular")
        .when(F.col("bytes") > F.lit(max_bytes), "tooLarge")
        .when(F.col("digest").isNull(), "unreadable")
        .when(F.col("digest") == F.col("fp"), "matching")
        .otherwise("changed")
    )
    compared = status.isin("matching", "changed")
    return joined.select(
        *SESSION,
        "line_no",
        "turn",
        F.coalesce("resolved", "label").alias("path"),
        status.alias("status"),
        F.col("fp").alias("recorded_digest"),
        F.when(compared, F.col("digest")).alias("current_digest"),
        F.col("char_len").alias("recorded_chars"),
        F.when(compared, F.col("chars")).alias("current_chars"),
    )
