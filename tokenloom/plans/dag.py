"""Ancestor chains over a parent forest, by pointer doubling.

A node knows its parent.  After round ``k`` it knows the ancestor ``2**k`` steps
up and the totals of everything in between, so a chain of 100 000 records needs
17 equi-joins, whatever the number of nodes.  No chain is longer than the nodes
of its group; nodes that are unresolved after that many rounds are on a circle
or lead to one.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.session import cut


def _rounds(nodes: DataFrame, keys: Sequence[str]) -> int:
    """Doublings after which only circles are unresolved, from the largest group."""
    largest = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    return max(1, math.ceil(math.log2(max(2, largest))))


def ancestor_totals(
    nodes: DataFrame,
    keys: Sequence[str],
    sums: Mapping[str, Column],
    farthest: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Totals over each node's chain to its root, the node itself included.

    ``nodes`` has ``node``, ``parent`` and ``stop``; a chain ends at a stop
    node, whose own values do not count.  ``farthest`` columns report the
    non-null value nearest the root.  Nodes on or below a circle have
    ``resolved = false``; chains may have any length.
    """
    farthest = farthest or {}
    open_node = ~F.col("stop")
    state = nodes.select(
        *keys,
        "node",
        F.when(open_node, F.col("parent")).alias("jump"),
        F.lit(1).cast("bigint").alias("depth"),
        F.when(F.col("stop"), F.col("node")).alias("stop_at"),
        *[F.when(open_node, F.coalesce(c, F.lit(0))).otherwise(0).cast("bigint").alias(n) for n, c in sums.items()],
        *[F.when(open_node, c).alias(n) for n, c in farthest.items()],
    )
    state = cut(state)
    for _ in range(_rounds(nodes, keys)):
        active = state.where(F.col("jump").isNotNull())
        if active.isEmpty():
            break
        above = state.select(
            *keys,
            F.col("node").alias("jump"),
            F.col("jump").alias("a_jump"),
            F.col("depth").alias("a_depth"),
            F.col("stop_at").alias("a_stop"),
            *[F.col(n).alias(f"a_{n}") for n in [*sums, *farthest]],
        )
        moved = active.join(above, [*keys, "jump"]).select(
            *keys,
            "node",
            F.col("a_jump").alias("jump"),
            (F.col("depth") + F.col("a_depth")).alias("depth"),
            F.coalesce("stop_at", "a_stop").alias("stop_at"),
            *[(F.col(n) + F.col(f"a_{n}")).alias(n) for n in sums],
            *[F.coalesce(f"a_{n}", n).alias(n) for n in farthest],
        )
        state = cut(state.where(F.col("jump").isNull()).unionByName(moved))
    return state.withColumn("resolved", F.col("jump").isNull()).drop("jump")


def jump_tables(nodes: DataFrame, keys: Sequence[str]) -> list[DataFrame]:
    """``tables[k]`` maps a node to its ancestor ``2**k`` steps up, where there is one."""
    level = cut(
        nodes.where(F.col("parent").isNotNull() & ~F.col("stop")).select(
            *keys, "node", F.col("parent").alias("jump")
        )
    )
    tables = []
    for _ in range(_rounds(nodes, keys) + 1):
        if level.isEmpty():
            break
        tables.append(level)
        above = level.select(*keys, F.col("node").alias("jump"), F.col("jump").alias("next"))
        level = cut(
            level.join(above, [*keys, "jump"]).select(*keys, "node", F.col("next").alias("jump"))
        )
    return tables


def chain_members(
    starts: DataFrame, keys: Sequence[str], label: Sequence[str], tables: Sequence[DataFrame]
) -> DataFrame:
    """Every ancestor of every start, with its distance; the start has distance 0.

    A distance is a sum of powers of two in exactly one way, so walking the
    jump tables from the longest jump down, keeping both the place and the
    jumped-to place, lists each ancestor once.
    """
    reached = starts.select(*keys, *label, "node", F.lit(0).cast("bigint").alias("distance"))
    for k in range(len(tables) - 1, -1, -1):
        here = F.struct("node", "distance")
        there = F.struct(F.col("jump").alias("node"), (F.col("distance") + (1 << k)).alias("distance"))
        reached = (
            reached.join(tables[k], [*keys, "node"], "left")
            .withColumn("__at", F.explode(F.when(F.col("jump").isNull(), F.array(here)).otherwise(F.array(here, there))))
            .select(*keys, *label, "__at.node", "__at.distance")
        )
    return reached
