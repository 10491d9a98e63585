"""Interval numbers of a parent forest.

Every node gets the place ``entry`` at which a depth-first walk meets it and the place
``end`` behind its subtree, so that

    x is y or an ancestor of y   <=>   x.entry <= y.entry < x.end

whatever the length of the chain between them: membership in a chain is an interval
test, and no chain is listed.  The numbers come from doublings and one scan over
siblings: subtree sizes are gathered along the jump tables, an elder sibling's size
moves the younger ones on, and the moves add up along the chain to the root.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.plans.dag import ancestor_totals
from tokenloom.plans.scan import running, running_sum
from tokenloom.session import cut


def subtree_sizes(nodes: DataFrame, keys: Sequence[str], tables: Sequence[DataFrame]) -> DataFrame:
    """Nodes of each node's subtree, itself included, as ``size``.

    After table ``k`` a node knows its descendants less than ``2**(k+1)`` steps below: its
    own so far, and those of the nodes exactly ``2**k`` steps below.
    """
    state = cut(nodes.select(*keys, "node", F.lit(1).cast("bigint").alias("size")))
    for table in tables:
        below = table.join(state, [*keys, "node"]).groupBy(*keys, F.col("jump").alias("node"))
        below = below.agg(F.sum("size").alias("more"))
        grown = F.col("size") + F.coalesce("more", F.lit(0))
        state = cut(state.join(below, [*keys, "node"], "left").select(*keys, "node", grown.alias("size")))
    return state


def intervals(nodes: DataFrame, keys: Sequence[str], tables: Sequence[DataFrame]) -> DataFrame:
    """``(keys, node, entry, end)`` of a forest without circles.

    ``nodes`` has ``node`` and ``parent`` (NULL at roots), ``tables`` are its jump tables.
    """
    sized = nodes.select(*keys, "node", "parent").join(subtree_sizes(nodes, keys, tables), [*keys, "node"])
    # Roots are siblings of each other.
    sized = cut(sized.withColumn("over", F.coalesce("parent", F.lit(-1).cast("bigint"))))
    placed = running(sized, [*keys, "over"], "node", {"elder": running_sum(F.col("size"))})
    step = F.col("elder") + F.when(F.col("parent").isNull(), 0).otherwise(1)
    moved = placed.select(*keys, "node", "parent", "size", step.alias("step"), F.lit(False).alias("stop"))
    moved = cut(moved)
    entry = ancestor_totals(moved, keys, {"entry": F.col("step")}).select(*keys, "node", "entry")
    out = moved.select(*keys, "node", "size").join(entry, [*keys, "node"])
    return out.select(*keys, "node", "entry", (F.col("entry") + F.col("size")).alias("end"))


def within(entry: Column, outer_entry: Column, outer_end: Column) -> Column:
    """Whether the node at ``entry`` lies in the subtree of the other one."""
    return (entry >= outer_entry) & (entry < outer_end)


def way_up(
    starts: DataFrame, keys: Sequence[str], label: Sequence[str], tables: Sequence[DataFrame], numbers: DataFrame
) -> DataFrame:
    """The start node and its ancestors below the first one that also holds the place ``other``.

    ``starts`` has ``node``, ``other`` (an entry number, NULL: every ancestor is listed) and
    the columns ``label``.  What holds ``other`` only ever lies above what does not, so the
    jumps that lead there are left out and only nodes of the result are ever produced.
    """
    apart = F.col("other").isNull() | ~within(F.col("other"), F.col("entry"), F.col("end"))
    spans = numbers.select(*keys, "node", "entry", "end")
    reached = starts.join(spans, [*keys, "node"]).where(apart).select(*keys, *label, "other", "node")
    for table in reversed(tables):
        target = spans.withColumnRenamed("node", "jump")
        jumps = table.join(target, [*keys, "jump"])
        here, there = F.col("node"), F.when(F.col("jump").isNotNull() & apart, F.col("jump"))
        places = F.array_compact(F.array(here, there))
        reached = reached.join(jumps, [*keys, "node"], "left").select(
            *keys, *label, "other", F.explode(places).alias("node")
        )
    return reached.drop("other")


def path_sums(
    weights: DataFrame, points: DataFrame, keys: Sequence[str], group: str, values: Sequence[str]
) -> DataFrame:
    """For every point and group, the sums over the nodes whose subtree holds the point's ``entry``.

    A weight counts from its node's ``entry`` to its ``end``, so the sum over a chain is a
    running sum over the places of the walk: added at the entry, taken off at the end.
    ``weights`` has ``entry``, ``end``, the column ``group`` and ``values``; ``points`` has
    ``entry`` and columns of its own.  A point has a row for each group of its keys, with
    zeros where nothing of the group lies on its chain.
    """
    own = [c for c in points.columns if c not in keys and c != "entry"]
    none = F.lit(None)
    # Whatever happens at one place: first subtrees end, then a node begins, then points are read.
    sides = [
        weights.select(
            *keys, group, (F.col(at) * 3 + turn).alias("__place"), *[(sign * F.col(v)).alias(v) for v in values],
            *[none.cast(points.schema[c].dataType).alias(c) for c in own], F.lit(False).alias("__asks"),
        )
        for at, turn, sign in (("end", 0, -1), ("entry", 1, 1))
    ]
    groups = weights.select(*keys, group).distinct()
    asked = points.where("entry is not null").join(groups, list(keys)).select(
        *keys, group, (F.col("entry") * 3 + 2).alias("__place"), *[F.lit(0).cast("bigint").alias(v) for v in values],
        *own, F.lit(True).alias("__asks"),
    )
    both = sides[0].unionByName(sides[1]).unionByName(asked)
    summed = running(both, [*keys, group], "__place", {f"__sum_{v}": running_sum(F.col(v)) for v in values})
    return summed.where("__asks").select(*keys, *own, group, *[F.col(f"__sum_{v}").alias(v) for v in values])
