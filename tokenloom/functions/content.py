"""Sizes and fingerprints of record content."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Members that are linkage, not text the model reads.
NON_TEXT_KEYS = ["type", "signature", "id", "tool_use_id", "cache_control", "is_error", "name"]
SIGNATURE_CHARS_PER_THINKING_CHAR = 2.353
IMAGE_MAX_EQUIVALENT_CHARS = 4_000


def _text_chars(value) -> int:
    """Text characters at any depth."""
    total, todo = 0, [value]
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            total += len(part)
        elif isinstance(part, list):
            todo += part
        elif isinstance(part, dict):
            todo += [v for k, v in part.items() if k not in NON_TEXT_KEYS]
    return total


@F.pandas_udf(T.ArrayType(T.LongType()))
def nested_text_chars(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Text characters of nested JSON values; NULL entries stay NULL.

    Callers pass NULL wherever a column expression can do the counting.
    """
    for documents in batches:
        yield documents.map(
            lambda row: None if row is None else [None if d is None else _text_chars(json.loads(d)) for d in row]
        )


@F.pandas_udf(T.ArrayType(T.StringType()))
def without_member(documents: pd.Series, member: pd.Series) -> pd.Series:
    """Each JSON list of blocks without one link member, order of the rest kept."""

    def strip(text, key):
        blocks = json.loads(text)
        for block in blocks:
            if isinstance(block, dict):
                block.pop(key, None)
        return json.dumps(blocks, separators=(",", ":"), ensure_ascii=False)

    return pd.Series([None if d is None else [strip(d, k)] for d, k in zip(documents, member)])


@F.pandas_udf(T.LongType())
def deflated_size(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Bytes of the content after DEFLATE at level 6, without container."""

    def size(data):
        if data is None:
            return None
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        return len(packer.compress(data)) + len(packer.flush())

    for contents in batches:
        yield contents.map(size)


def fingerprint(text: Column) -> Column:
    return F.sha2(text, 256)


def canonical_json(raw: Column) -> Column:
    """JSON with sorted members at every depth, for identity."""
    return F.to_json(F.try_parse_json(raw))


def redacted_thinking_chars(signature: Column) -> Column:
    """Size of reasoning that was logged without its text, from its signature."""
    return F.floor(F.length(signature) / F.lit(SIGNATURE_CHARS_PER_THINKING_CHAR)).cast("bigint")


def image_chars(data: Column) -> Column:
    """An inline image never costs more than a fixed equivalent, however long its encoding."""
    return F.least(F.length(data), F.lit(IMAGE_MAX_EQUIVALENT_CHARS)).cast("bigint")


def measure(contents, column: str = "content"):
    """``fp``, ``original_bytes`` and ``compressed_bytes`` of each *distinct* content.

    Content is compressed once however often it occurs: fingerprints are
    deduplicated before the Python step.
    """
    keyed = contents.where(F.length(column) > 0).select(
        fingerprint(F.col(column)).alias("fp"), F.encode(column, "utf-8").alias("data")
    )
    distinct = keyed.groupBy("fp").agg(F.first("data").alias("data"))
    return distinct.select(
        "fp",
        F.octet_length("data").cast("bigint").alias("original_bytes"),
        deflated_size("data").alias("compressed_bytes"),
    )
