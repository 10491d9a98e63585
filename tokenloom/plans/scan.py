"""Ordered running measures over sequences of any length.

``Window.partitionBy(session)`` sends a whole session to one task, which fails
when one session holds a third of the lake.  Sessions are ordered by a unique
number (the line number, the turn number), so a session can be cut into blocks
of at most ``block_rows`` rows:

1. an ordinary window inside ``(session, block)`` gives the value *within* the
   block -- at most ``block_rows`` rows per group, whatever the session's size;
2. one row per block is pre-aggregated map-side and a window over those few
   rows gives what every block inherits from the blocks before it;
3. both halves meet in an equi-join on ``(session, block)``, the partitioning
   the rows already have.

The result equals the plain window row for row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of one sequence handled by one window group.
BLOCK_ROWS = 65_536

_BLOCK = "__block"


def block_rows(df: DataFrame) -> int:
    """Block height, overridable per session with ``tokenloom.scan.blockRows``."""
    return int(df.sparkSession.conf.get("tokenloom.scan.blockRows", str(BLOCK_ROWS)))


@dataclass(frozen=True)
class Measure:
    """One running value: how to compute it in a block and across blocks."""

    kind: str
    expr: Column
    inclusive: bool

    def local(self, part: Sequence[str], order: str) -> Column:
        end = Window.currentRow if self.inclusive else -1
        ahead = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, end)
        if self.kind == "sum":
            return F.coalesce(F.sum(self.expr).over(ahead), F.lit(0))
        if self.kind == "max":
            return F.max(self.expr).over(ahead)
        if self.kind == "min":
            return F.min(self.expr).over(ahead)
        if self.kind == "last":
            return F.last(self.expr, ignorenulls=True).over(ahead)
        # "next": read the block backwards, because a frame that ends at
        # UNBOUNDED FOLLOWING costs a rescan per row.
        behind = (
            Window.partitionBy(*part)
            .orderBy(F.col(order).desc())
            .rowsBetween(Window.unboundedPreceding, end)
        )
        return F.last(self.expr, ignorenulls=True).over(behind)

    def block_total(self, order: str) -> Column:
        if self.kind == "sum":
            return F.sum(self.expr)
        if self.kind == "max":
            return F.max(self.expr)
        if self.kind == "min":
            return F.min(self.expr)
        position = F.when(self.expr.isNotNull(), F.col(order))
        return F.max_by(self.expr, position) if self.kind == "last" else F.min_by(self.expr, position)

    def carried(self, total: Column, keys: Sequence[str]) -> Column:
        blocks = Window.partitionBy(*keys).orderBy(_BLOCK)
        before = blocks.rowsBetween(Window.unboundedPreceding, -1)
        if self.kind == "sum":
            return F.coalesce(F.sum(total).over(before), F.lit(0))
        if self.kind == "max":
            return F.max(total).over(before)
        if self.kind == "min":
            return F.min(total).over(before)
        if self.kind == "last":
            return F.last(total, ignorenulls=True).over(before)
        after = Window.partitionBy(*keys).orderBy(F.col(_BLOCK).desc())
        return F.last(total, ignorenulls=True).over(after.rowsBetween(Window.unboundedPreceding, -1))

    def combined(self, local: Column, carried: Column) -> Column:
        if self.kind == "sum":
            return local + carried
        if self.kind == "max":
            return F.greatest(local, carried)
        if self.kind == "min":
            return F.least(local, carried)
        return F.coalesce(local, carried)


def running_sum(expr: Column, inclusive: bool = False) -> Measure:
    return Measure("sum", expr, inclusive)


def running_count(condition: Column, inclusive: bool = False) -> Measure:
    return Measure("sum", F.when(condition, F.lit(1)).otherwise(F.lit(0)).cast("bigint"), inclusive)


def running_max(expr: Column, inclusive: bool = False) -> Measure:
    return Measure("max", expr, inclusive)


def running_min(expr: Column, inclusive: bool = False) -> Measure:
    return Measure("min", expr, inclusive)


def last_known(expr: Column, inclusive: bool = False) -> Measure:
    """The latest non-null value at or before the row (before it, when exclusive)."""
    return Measure("last", expr, inclusive)


def next_known(expr: Column, inclusive: bool = True) -> Measure:
    """The earliest non-null value at or after the row (after it, when exclusive)."""
    return Measure("next", expr, inclusive)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    measures: Mapping[str, Measure],
    block: Column | None = None,
) -> DataFrame:
    """Add one column per measure to every row of ``df``.

    ``order`` is unique within ``keys``.  ``block`` may replace the default
    ``order div block_rows`` with any expression that never decreases in
    ``order``.
    """
    if block is None:
        block = F.floor(F.col(order) / F.lit(block_rows(df))).cast("bigint")
    part = [*keys, _BLOCK]
    base = df.withColumn(_BLOCK, block)
    local = base.select(
        "*", *[m.local(part, order).alias(f"__in_{name}") for name, m in measures.items()]
    )
    totals = base.groupBy(*part).agg(
        *[m.block_total(order).alias(f"__tot_{name}") for name, m in measures.items()]
    )
    carried = totals.select(
        *part,
        *[m.carried(F.col(f"__tot_{n}"), keys).alias(f"__pre_{n}") for n, m in measures.items()],
    )
    joined = local.join(carried, part, "inner")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[
            m.combined(F.col(f"__in_{n}"), F.col(f"__pre_{n}")).alias(n)
            for n, m in measures.items()
        ],
    )


def dense_number(df: DataFrame, keys: Sequence[str], order: str, name: str = "n") -> DataFrame:
    """1-based position of each row in its sequence."""
    return running(df, keys, order, {name: running_count(F.lit(True), inclusive=True)})


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    before: int,
    after: int,
    columns: Mapping[str, Column],
) -> DataFrame:
    """Evaluate bounded-frame window columns on a densely numbered sequence.

    Rows next to a block edge are copied into the neighbouring block, so every
    frame of ``before`` rows back and ``after`` rows ahead is complete inside
    its block; the copies are dropped afterwards.  ``columns`` maps a name to a
    column built on ``neighbour_window(keys, position)``.
    """
    rows = max(block_rows(df), before + after + 1)
    home = F.floor((F.col(position) - 1) / F.lit(rows)).cast("bigint")
    left = F.floor((F.col(position) - 1 + before) / F.lit(rows)).cast("bigint")
    right = F.floor((F.col(position) - 1 - after) / F.lit(rows)).cast("bigint")
    spread = df.withColumn("__home", home).withColumn(
        _BLOCK, F.explode(F.array_distinct(F.array(home, left, right)))
    )
    return (
        spread.select("*", *[c.alias(n) for n, c in columns.items()])
        .where(F.col("__home") == F.col(_BLOCK))
        .drop("__home", _BLOCK)
    )


def neighbour_window(keys: Sequence[str], position: str):
    return Window.partitionBy(*keys, _BLOCK).orderBy(position)
