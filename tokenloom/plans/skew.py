"""Size-checked broadcasts and two-step aggregation for hot groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest dimension table that is broadcast, in rows.
BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only after counting that it fits; else leave the join to AQE.

    The count stops at ``rows + 1``.  A shuffled join gives the same result, and
    AQE splits a hot key of the big side there.
    """
    held = df.limit(rows + 1).count()
    return F.broadcast(df) if held <= rows else df


def top_k_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    spread: Column,
    salts: int = 64,
    rank: str = "rank",
) -> DataFrame:
    """The first ``k`` rows of each group without sending a hot group to one task.

    Every group is cut into ``salts`` parts by ``spread`` (a row-unique column);
    each part keeps its own best ``k``, and only those meet in the final rank.
    """
    from pyspark.sql.window import Window

    salted = df.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    inner = Window.partitionBy(*keys, "__salt").orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("__r", F.row_number().over(inner))
        .where(F.col("__r") <= k)
        .drop("__r", "__salt")
        .withColumn(rank, F.row_number().over(outer))
        .where(F.col(rank) <= k)
    )
