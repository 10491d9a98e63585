"""From a folder of logs to the normalised tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.schema import SESSION
from tokenloom.session import many_files, stage
from tokenloom.sources.lines import read_lines, with_positions
from tokenloom.sources.profile import AgentProfile


@dataclass(frozen=True)
class LogTables:
    sessions: DataFrame
    events: DataFrame
    turns: DataFrame


def ingest(
    spark: SparkSession,
    agent: AgentProfile,
    path: str | list[str],
    with_content: bool = False,
    glob: str = "*.jsonl",
) -> LogTables:
    """Parse every log below ``path`` whose file name matches ``glob``.

    Lines are parsed where they are read and only the narrow event columns are
    kept; numbering, turn assignment and everything after work on those.  Raw
    text is never shuffled.
    """
    lines = read_lines(spark, path, glob)
    with many_files(spark):
        sessions = stage(agent.inventory(lines))
    parsed = agent.normalise(
        lines.select(
            F.lit("").alias("session_id"),
            "path",
            "block",
            "rid",
            "framed_bytes",
            (F.octet_length("raw") == 0).alias("blank"),
            F.lit(None).cast("bigint").alias("line_no"),
            F.lit(None).cast("bigint").alias("byte_offset"),
            F.octet_length("raw").cast("bigint").alias("byte_len"),
            "raw",
        ),
        with_content=with_content,
    )
    with many_files(spark):
        narrow = stage(parsed.drop("line_no", "byte_offset", "seq", "session_id"))
    placed = with_positions(narrow).where(~F.col("blank")).drop("framed_bytes", "blank")
    named = placed.join(sessions.select("path", "session_id"), "path").withColumn("seq", F.col("line_no") - 1)
    events = stage(agent.assign_turns(named))
    return LogTables(sessions, events, stage(agent.turns(events)))


def write_tables(tables: LogTables, root: str) -> None:
    """Store the tables by agent, sorted so that readers of one session skip the rest."""
    for name, df, order in (
        ("sessions", tables.sessions, SESSION),
        ("events", tables.events, [*SESSION, "seq"]),
        ("turns", tables.turns, [*SESSION, "turn"]),
    ):
        (
            df.repartitionByRange(*order)
            .sortWithinPartitions(*order)
            .write.mode("append")
            .partitionBy("agent")
            .parquet(f"{root}/{name}")
        )
