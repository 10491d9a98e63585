"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.session import stage


def _signature(edges: DataFrame):
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of every node that has a link; the component is its smallest node.

    ``links`` has the two columns ``a`` and ``b`` (long, direction and repeats do
    not matter, self-links and NULLs are ignored).  Each round is written to the
    shared folder; the smallest neighbours are written before they are joined, so
    that a hot node's links can be split over tasks.  No table has more rows than two for
    each link of the round before, so few links make few files.  Rounds end when the
    table no longer changes, after about the logarithm of the longest chain.
    """
    edges = stage(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    before = _signature(edges)
    while before[0]:
        most = 2 * before[0]
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), most)
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.distinct(), most)
        least = stage(large.groupBy("u").agg(F.min("v").alias("m")), most)
        near = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(near.union(least.select("u", F.col("m").alias("v"))).distinct(), most)
        after = _signature(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
