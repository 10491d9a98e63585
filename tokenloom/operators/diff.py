"""Two prompts side by side: by category, by tool, by item."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.usage import confidence_name, confidence_rank


@dataclass(frozen=True)
class Instrument:
    """What sized the items of one side."""

    name: str
    chars_per_token: float | None = None


@dataclass(frozen=True)
class Comparability:
    kind: str  # identical | skewed | incomparable
    skew: float | None


def comparability(left: Instrument, right: Instrument) -> Comparability:
    """Whether sizes of the two sides are on one scale, and how far apart the scales are."""
    l, r = left.chars_per_token, right.chars_per_token
    if l and r and l > 0 and r > 0:
        if l == r and left.name == right.name:
            return Comparability("identical", 0.0)
        return Comparability("skewed", abs(l / r - 1.0))
    if l is None and r is None and left.name == right.name:
        return Comparability("identical", 0.0)
    return Comparability("incomparable", None)


def instrument_bound(skew: float | None, left: Column, right: Column) -> Column:
    """Differences up to this many tokens may come from the instruments alone."""
    if skew is None:
        return F.lit(None).cast("bigint")
    return F.ceil(F.greatest(left, right) * F.lit(skew)).cast("bigint")


def _meaningful(delta: Column, bound: Column) -> Column:
    return F.coalesce(F.abs(delta) > bound, F.lit(False))


def _both(left: DataFrame, right: DataFrame, on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Full outer join with absent numbers as zero."""
    l = left.select(*on, *[F.col(v).alias(f"left_{v}") for v in values])
    r = right.select(*on, *[F.col(v).alias(f"right_{v}") for v in values])
    zero = F.lit(0).cast("bigint")
    return l.join(r, list(on), "full_outer").select(
        *on,
        *[F.coalesce(f"{side}_{v}", zero).alias(f"{side}_{v}") for side in ("left", "right") for v in values],
    )


def category_delta(
    left: DataFrame,
    right: DataFrame,
    left_snaps: DataFrame,
    right_snaps: DataFrame,
    on: Sequence[str],
    skew: float | None,
) -> DataFrame:
    """Tokens and items per category on both sides.

    The unattributed row inherits its uncertainty from everything that *was*
    attributed, so its bound comes from the accounted totals.
    """
    merged = _both(left, right, [*on, "category"], ["tokens", "item_count"])
    accounted = left_snaps.select(*on, F.col("accounted").alias("l_acc")).join(
        right_snaps.select(*on, F.col("accounted").alias("r_acc")), list(on)
    )
    joined = merged.join(accounted, list(on))
    rest = F.col("category") == "unattributed"
    bound = F.when(rest, instrument_bound(skew, F.col("l_acc"), F.col("r_acc"))).otherwise(
        instrument_bound(skew, F.col("left_tokens"), F.col("right_tokens"))
    )
    delta = F.col("right_tokens") - F.col("left_tokens")
    return (
        joined.withColumn("delta", delta)
        .withColumn("item_delta", F.col("right_item_count") - F.col("left_item_count"))
        .withColumn("instrument_bound", bound)
        .withColumn("meaningful", _meaningful(F.col("delta"), F.col("instrument_bound")))
        .drop("l_acc", "r_acc")
    )


def tool_usage(items: DataFrame, on: Sequence[str]) -> DataFrame:
    return (
        items.where(F.col("source_kind") == "tool")
        .groupBy(*on, F.col("source_payload").alias("tool"))
        .agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"))
    )


def tool_delta(left: DataFrame, right: DataFrame, on: Sequence[str], skew: float | None) -> DataFrame:
    """Items and tokens per tool on both sides."""
    merged = _both(tool_usage(left, on), tool_usage(right, on), [*on, "tool"], ["calls", "tokens"])
    return (
        merged.withColumn("call_delta", F.col("right_calls") - F.col("left_calls"))
        .withColumn("token_delta", F.col("right_tokens") - F.col("left_tokens"))
        .withColumn("instrument_bound", instrument_bound(skew, F.col("left_tokens"), F.col("right_tokens")))
        .withColumn("meaningful", _meaningful(F.col("token_delta"), F.col("instrument_bound")))
    )


def item_delta(left: DataFrame, right: DataFrame, on: Sequence[str], skew: float | None) -> DataFrame:
    """Items gained, retained and removed between the two sides, by item id."""
    cols = ["label", "category", "tokens", "confidence"]
    l = left.select(*on, "item_id", *[F.col(c).alias(f"l_{c}") for c in cols])
    r = right.select(*on, "item_id", *[F.col(c).alias(f"r_{c}") for c in cols])
    both = l.join(r, [*on, "item_id"], "full_outer")
    zero = F.lit(0).cast("bigint")
    bound = instrument_bound(skew, F.coalesce("l_tokens", zero), F.coalesce("r_tokens", zero))
    return both.select(
        *on,
        "item_id",
        F.when(F.col("l_tokens").isNull(), "gained")
        .when(F.col("r_tokens").isNull(), "removed")
        .otherwise("retained")
        .alias("change"),
        F.coalesce("r_label", "l_label").alias("label"),
        F.coalesce("r_category", "l_category").alias("category"),
        F.col("l_tokens").alias("left_tokens"),
        F.col("r_tokens").alias("right_tokens"),
        (F.col("r_tokens") - F.col("l_tokens")).alias("token_delta"),
        _meaningful(F.col("r_tokens") - F.col("l_tokens"), bound).alias("meaningful"),
        confidence_name(
            F.greatest(confidence_rank(F.col("l_confidence")), confidence_rank(F.col("r_confidence")))
        ).alias("confidence"),
    )
