"""Exact order statistics per group by counting, without collecting a group."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.plans.scan import running, running_sum


def ranked_values(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: Mapping[str, Callable[[Column], Column]],
    bucket: Column,
) -> DataFrame:
    """Pick elements of each group's sorted values by 0-based position.

    ``ranks`` maps an output name to a function of the group size.  Equal values
    are counted before anything is shuffled; ``bucket`` is a non-decreasing
    function of the value that splits large groups over tasks.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    placed = running(counts, keys, value, {"__start": running_sum(F.col("__c"))}, block=bucket)
    sizes = counts.groupBy(*keys).agg(F.sum("__c").alias("group_size"))
    joined = placed.join(sizes, list(keys))
    end = F.col("__start") + F.col("__c")
    picks = []
    for name, rank in ranks.items():
        at = rank(F.col("group_size"))
        picks.append(F.max(F.when((F.col("__start") <= at) & (at < end), F.col(value))).alias(name))
    return joined.groupBy(*keys).agg(F.max("group_size").alias("group_size"), *picks)


def median_ranks(prefix: str) -> dict[str, Callable[[Column], Column]]:
    """The two middle positions; both are the middle one when the size is odd."""
    return {
        f"{prefix}_low": lambda n: F.floor((n - 1) / 2),
        f"{prefix}_high": lambda n: F.floor(n / 2),
    }


def nearest_rank(p: float) -> Callable[[Column], Column]:
    """Position ``(n - 1) * p`` rounded half away from zero."""
    return lambda n: F.round((n - 1) * F.lit(p)).cast("bigint")
