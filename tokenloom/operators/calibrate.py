"""Fit estimated item sizes to the prompt size the provider reported."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.usage import is_trustworthy
from tokenloom.operators.reconstruct import item_confidence
from tokenloom.schema import SESSION

TURN = [*SESSION, "turn"]


def calibrate(items: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Balance items against observed totals: ``(items, snapshots)``.

    ``items`` carry ``raw_tokens`` and ``size_kind``; ``turns`` carry
    ``prompt_tokens``.  Measured sizes are kept while they fit; estimates share
    the room that is left, each rounded down, and the residual takes what
    remains.  Turns without an observed total keep their estimates.
    """
    measured = F.when(is_trustworthy(F.col("size_kind")), F.col("raw_tokens")).otherwise(0)
    sums = items.groupBy(*TURN).agg(
        F.sum(measured).alias("measured"),
        F.sum(F.col("raw_tokens") - measured).alias("estimated"),
        F.count(F.lit(1)).alias("item_count"),
    )
    zero = F.lit(0).cast("bigint")
    plan = (
        turns.select(*TURN, F.col("prompt_tokens").alias("observed_total"))
        .join(sums, TURN, "left")
        .select(
            *TURN,
            "observed_total",
            F.coalesce("measured", zero).alias("measured"),
            F.coalesce("estimated", zero).alias("estimated"),
            F.coalesce("item_count", zero).alias("item_count"),
        )
    )
    total, m, e = F.col("observed_total"), F.col("measured"), F.col("estimated")
    scale_all = total.isNotNull() & (m > total)
    scale_some = total.isNotNull() & (m <= total) & (e > total - m)
    plan = (
        plan.withColumn("scaling", F.when(scale_all, "all").when(scale_some, "estimates").otherwise("none"))
        .withColumn("numerator", F.when(scale_all, total).otherwise(total - m))
        .withColumn("denominator", F.when(scale_all, m + e).otherwise(e))
    )
    joined = items.join(plan.select(*TURN, "scaling", "numerator", "denominator"), TURN)
    touched = (F.col("scaling") == "all") | (
        (F.col("scaling") == "estimates") & ~is_trustworthy(F.col("size_kind"))
    )
    # Integer division, so that every item is rounded down exactly.
    scaled = F.expr(
        "cast((cast(raw_tokens as decimal(19,0)) * cast(numerator as decimal(19,0))) div denominator as bigint)"
    )
    balanced = (
        joined.withColumn("tokens", F.when(touched & (F.col("denominator") > 0), scaled).otherwise(F.col("raw_tokens")))
        .withColumn("raw_estimate", F.when(touched, F.col("raw_tokens")))
        .withColumn("size_kind", F.when(touched, "calibrated").otherwise(F.col("size_kind")))
        .withColumn("confidence", item_confidence())
        .drop("scaling", "numerator", "denominator")
    )
    accounted = balanced.groupBy(*TURN).agg(
        F.sum("tokens").alias("accounted"),
        F.sum(F.when(F.col("size_kind") == "calibrated", F.col("tokens"))).alias("cal_scaled"),
        F.sum(F.when(F.col("size_kind") == "calibrated", F.col("raw_estimate"))).alias("cal_raw"),
    )
    snapshots = plan.join(accounted, TURN, "left").select(
        *TURN,
        F.coalesce("observed_total", F.col("measured") + F.col("estimated")).alias("total"),
        F.when(F.col("observed_total").isNotNull(), "observed").otherwise("estimated").alias("total_confidence"),
        "item_count",
        F.coalesce("accounted", zero).alias("accounted"),
        F.try_divide("cal_scaled", "cal_raw").alias("calibration_scale"),
    )
    snapshots = snapshots.withColumn("residual", F.greatest(F.col("total") - F.col("accounted"), zero)).withColumn(
        "residual_meaningful", F.coalesce(F.try_divide("residual", "total") >= 0.005, F.lit(False))
    )
    return balanced, snapshots


def unbalanced(items: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Snapshots whose items and residual do not add up to the total; must be empty."""
    sums = items.groupBy(*TURN).agg(F.sum("tokens").alias("items_total"))
    return (
        snapshots.join(sums, TURN, "left")
        .withColumn("items_total", F.coalesce("items_total", F.lit(0)))
        .where(F.col("items_total") + F.col("residual") != F.col("total"))
    )
