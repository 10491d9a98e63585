"""New lines of growing logs whose line table is at hand, landed as files a stream can read.

This works on a table of numbered lines, so it costs a pass over that table.  Where
logs grow in place, :mod:`tokenloom.sources.growing` reads only the bytes that are new.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OFFSETS = "path string, next_offset bigint, next_line bigint"


def new_lines(lines: DataFrame, offsets: DataFrame) -> DataFrame:
    """Lines of :func:`tokenloom.sources.lines.raw_lines` not landed before.

    A file shorter than its known offset was rotated and starts over.  A last line
    without a line end may be half written, so it waits for a later poll.
    """
    ends = lines.groupBy("path").agg(F.max(F.col("byte_offset") + F.col("byte_len")).alias("end"))
    known = offsets.select("path", "next_offset").join(ends, "path").select(
        "path", F.when(F.col("end") + 1 >= F.col("next_offset"), F.col("next_offset")).otherwise(0).alias("from_offset")
    )
    return (
        lines.join(known, "path", "left")
        .where("complete")
        .where(F.col("byte_offset") >= F.coalesce("from_offset", F.lit(0)))
        .drop("from_offset", "complete")
    )


def advance(offsets: DataFrame, landed: DataFrame) -> DataFrame:
    """Offsets after landing: the end of the last landed line per path."""
    ends = landed.groupBy("path").agg(
        F.max(F.col("byte_offset") + F.col("byte_len") + 1).alias("next_offset"),
        (F.max("line_no") + 1).alias("next_line"),
    )
    kept = offsets.join(ends.select("path"), "path", "left_anti")
    return kept.unionByName(ends)


def land(lines: DataFrame, path: str) -> None:
    """Append the lines to the folder the stream watches."""
    lines.write.mode("append").parquet(path)
