"""Replace estimates by a tokenizer's counts where the text is known."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def recount(items: DataFrame, count_tokens: Callable[[Column], Column]) -> DataFrame:
    """``items`` carry ``content`` (NULL when it cannot be read) and ``opaque``.

    ``count_tokens`` is a column function: built-ins, or an Arrow UDF around any
    tokenizer the caller has.  Opaque items keep their estimate.
    """
    opaque = F.col("opaque")
    status = F.when(opaque, "opaque").when(F.col("content").isNull(), "unavailable").otherwise("counted")
    counted = count_tokens(F.when(status == "counted", F.col("content")))
    return (
        items.withColumn("status", status)
        .withColumn("exact", F.when(F.col("status") == "counted", counted))
        .withColumn("raw_tokens", F.coalesce("exact", "raw_tokens"))
        .withColumn("size_kind", F.when(F.col("exact").isNotNull(), "exact").otherwise(F.col("size_kind")))
    )


def recount_coverage(counted: DataFrame) -> DataFrame:
    """How many items were counted, opaque or unavailable."""
    return counted.groupBy("status").agg(F.count(F.lit(1)).alias("items"), F.sum("exact").alias("tokens"))
