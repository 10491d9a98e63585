"""Log lines with their position, from files of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.secrets import redact_line
from tokenloom.plans.scan import running, running_count, running_sum

#: Records up to this size always fit into a VARIANT.
VARIANT_BYTES = 16 * 1024 * 1024


def read_lines(spark: SparkSession, path: str | list[str], glob: str = "*.jsonl") -> DataFrame:
    """Every line of every log file below ``path``, as Spark splits the files.

    Columns: ``path``, ``block`` (start of the file split), ``rid`` (order inside
    the split), ``framed_bytes`` (with line end) and ``raw`` (without it).  Blank
    lines are kept: they count as lines.
    """
    text = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .option("lineSep", "\n")
        .text(path)
    )
    return text.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("rid"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_modification_time").alias("modified"),
        (F.octet_length("value") + 1).cast("bigint").alias("framed_bytes"),
        F.regexp_replace("value", "\r$", "").alias("raw"),
    )


def with_positions(lines: DataFrame) -> DataFrame:
    """Add ``line_no`` and ``byte_offset``; drop blank lines.

    Works on any projection of :func:`read_lines` that kept ``path``, ``block``,
    ``rid`` and ``framed_bytes``: parse first, keep the narrow columns, then
    number them, and the raw text is never shuffled.  The file split is the
    block of the scan, so a file of any size is numbered in parallel.
    """
    return running(
        lines,
        ["path"],
        "rid",
        {
            "line_no": running_count(F.lit(True), inclusive=True),
            "byte_offset": running_sum(F.col("framed_bytes")),
        },
        block=F.col("block"),
    ).drop("block", "rid")


def raw_lines(spark: SparkSession, path: str | list[str], glob: str = "*.jsonl") -> DataFrame:
    """The raw-line table: ``path, line_no, byte_offset, byte_len, oversized, complete, raw``.

    ``complete`` is false for a last line that has no line end yet.
    """
    return (
        with_positions(read_lines(spark, path, glob))
        .where(F.octet_length("raw") > 0)
        .select(
            "path",
            "line_no",
            "byte_offset",
            F.octet_length("raw").cast("bigint").alias("byte_len"),
            is_oversized(F.col("raw")).alias("oversized"),
            (F.col("byte_offset") + F.col("framed_bytes") <= F.col("file_size")).alias("complete"),
            "raw",
        )
    )


def is_oversized(raw: Column) -> Column:
    """Whether VARIANT may refuse the record for its size alone."""
    return F.octet_length(raw) > VARIANT_BYTES


_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def _nested(depth: int) -> str:
    """The inside of an object or list, up to ``depth`` more levels of nesting."""
    inner = "" if depth == 0 else rf"|[{{\[]{_nested(depth - 1)}[}}\]]"
    return rf'(?:{_STRING}|[^"{{}}\[\]]{inner})*+'


_VALUE = rf'(?:{_STRING}|[^",{{}}\[\]]++|[{{\[]{_nested(5)}[}}\]])'
_TOP_TYPE = rf'^\s*\{{\s*(?:(?!"type"){_STRING}\s*:\s*{_VALUE}\s*,\s*)*+"type"\s*:\s*"([^"\\]*)"'


def sniffed_type(raw: Column) -> Column:
    """The outer ``type`` of a record that VARIANT does not take, from its whole text."""
    found = F.regexp_extract(raw, _TOP_TYPE, 1)
    return F.when(F.length(found) > 0, found)


def parsed(raw: Column) -> Column:
    """The record as VARIANT; NULL when VARIANT does not take it or it is not JSON."""
    return F.try_parse_json(raw)


def recover_records(items: DataFrame, lines: DataFrame, redact=redact_line) -> DataFrame:
    """The raw record behind each item, redacted as a record unless told otherwise.

    ``items`` carry ``path`` and ``line_no``; only those lines are fetched.  ``None``
    for ``redact`` gives them as they are.
    """
    found = items.join(lines.select("path", "line_no", "raw"), ["path", "line_no"], "left")
    return found if redact is None else found.withColumn("raw", redact(F.col("raw")))
