"""Paths of bounded hops through sequences of any length.

Some folds over an ordered sequence keep one row at a time, and which row takes
its place depends on the kept row alone.  Such a fold is a path: every row names
how many rows ahead its successor is, at most ``reach``.  Entering a row at
offset 1 visits it and leaves at its hop; entering at offset ``e > 1`` passes it
and leaves at ``e - 1``.  A row is thus a map of ``reach`` numbers, maps compose,
and composition is associative: blocks of ``FAN`` maps become one map, twice, and
the entries found at the top are handed down again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Maps composed by one group, as a power of two.
FAN_BITS = 10


def _grouped(maps: DataFrame, keys: Sequence[str], up: Column) -> DataFrame:
    return maps.groupBy(*keys, up.alias("up")).agg(F.array_sort(F.collect_list(F.struct("id", "map"))).alias("maps"))


def _above(maps: DataFrame, keys: Sequence[str], reach: int, bits: int) -> DataFrame:
    """One composed map for each block of maps."""
    through = lambda e: F.aggregate("maps", e, lambda at, m: F.element_at(m["map"], at))
    return _grouped(maps, keys, F.shiftright("id", bits)).select(
        *keys, F.col("up").alias("id"), F.array(*[through(F.lit(e)) for e in range(1, reach + 1)]).alias("map")
    )


def _entries(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Where the path enters each map of a block, given where it enters the block."""
    walked = F.aggregate(
        "maps",
        F.array("entry"),
        lambda acc, m: F.array_append(acc, F.element_at(m["map"], F.element_at(acc, -1))),
    )
    each = F.arrays_zip(F.col("maps.id").alias("id"), F.slice(walked, F.lit(1), F.size("maps")).alias("entry"))
    return blocks.select(*keys, F.explode(each).alias("e")).select(*keys, "e.id", "e.entry").where("entry is not null")


def on_path(rows: DataFrame, keys: Sequence[str], number: str, hop: str, reach: int, bits: int = FAN_BITS) -> DataFrame:
    """The rows visited from the first row of each sequence on.

    ``number`` counts 1, 2, 3 ... within ``keys``; ``hop`` (1 to ``reach``) is how
    many rows ahead the path goes on, NULL where it ends.  A group holds at most
    ``2**bits`` maps, the last one ``rows / 4**bits``.  ``rows`` are read several
    times: pass a table or a checkpoint.
    """
    passing = [F.lit(i) for i in range(1, reach)]
    levels = [
        rows.select(*keys, (F.col(number) - 1).alias("id"), F.array(F.col(hop).cast("int"), *passing).alias("map"))
    ]
    for _ in range(2):
        levels.append(_above(levels[-1], keys, reach, bits))
    found = _entries(_grouped(levels.pop(), keys, F.lit(0)).withColumn("entry", F.lit(1)), keys)
    for maps in reversed(levels):
        blocks = _grouped(maps, keys, F.shiftright("id", bits))
        found = _entries(blocks.join(found.withColumnRenamed("id", "up"), [*keys, "up"]), keys)
    visited = found.where("entry = 1").select(*keys, (F.col("id") + 1).alias(number))
    return rows.join(visited, [*keys, number], "left_semi")
