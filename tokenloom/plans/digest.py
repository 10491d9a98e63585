"""One digest per ordered sequence of any length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN_IN = 4096
LEVELS = 4  # 4096 ** 4 positions


def ordered_digest(lines: DataFrame, keys: Sequence[str], position: str, digest: str, name: str) -> DataFrame:
    """Digest of a sequence of digests: a tree with at most ``FAN_IN`` children per node.

    ``position`` is a number from 0 or 1 up, unique within ``keys``, so no task
    ever holds more than ``FAN_IN`` entries of one sequence, and two equal
    sequences have equal digests wherever they are stored.
    """
    level = lines.select(*keys, F.col(position).cast("bigint").alias("__at"), F.col(digest).alias("__d"))
    for _ in range(LEVELS):
        level = (
            level.groupBy(*keys, F.floor(F.col("__at") / FAN_IN).cast("bigint").alias("__up"))
            .agg(F.array_sort(F.collect_list(F.struct("__at", "__d"))).alias("__kids"))
            .select(
                *keys,
                F.col("__up").alias("__at"),
                F.sha2(F.array_join(F.transform("__kids", lambda s: s["__d"]), "\n"), 256).alias("__d"),
            )
        )
    return level.select(*keys, F.col("__d").alias(name))
