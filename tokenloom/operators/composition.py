"""What fills a prompt: composition, filters, largest items, repeats, padding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.usage import confidence_name, confidence_rank
from tokenloom.plans.skew import top_k_per_group
from tokenloom.schema import (
    CATEGORIES,
    CONFIDENCES,
    LOW_ENTROPY_BYTES,
    LOW_ENTROPY_RATIO,
    SESSION,
    SOURCE_KINDS,
)

TURN = [*SESSION, "turn"]


class FilterError(ValueError):
    """A filter argument outside the allowed values."""

    def __init__(self, field: str, value: str, allowed: list[str]):
        super().__init__(f"unknown {field} '{value}'; expected one of: {', '.join(allowed)}")
        self.field, self.value, self.allowed = field, value, allowed


def _checked(field: str, value: str, allowed: list[str]) -> str:
    flat = value.strip().lower().replace("_", "-")
    if flat not in allowed:
        raise FilterError(field, value.strip(), allowed)
    return flat


@dataclass(frozen=True)
class ItemFilter:
    """A conjunction over context items; an empty filter keeps everything."""

    category: str | None = None
    source: str | None = None
    source_detail: str | None = None
    min_confidence: str | None = None
    min_tokens: int | None = None

    @staticmethod
    def parse(
        category: str | None = None,
        source: str | None = None,
        min_confidence: str | None = None,
        min_tokens: int | None = None,
    ) -> "ItemFilter":
        """Validate text arguments; ``source`` is ``kind`` or ``kind:needle``."""
        kind = detail = None
        if source is not None:
            head, _, tail = source.partition(":")
            kind, detail = _checked("source", head, SOURCE_KINDS), tail.strip() or None
        return ItemFilter(
            _checked("category", category, CATEGORIES) if category is not None else None,
            kind,
            detail,
            _checked("confidence", min_confidence, CONFIDENCES) if min_confidence is not None else None,
            min_tokens,
        )

    @property
    def active(self) -> bool:
        return self != ItemFilter()

    def matches(self) -> Column:
        keep = F.lit(True)
        if self.category is not None:
            keep = keep & (F.col("category") == self.category)
        if self.source is not None:
            keep = keep & (F.col("source_kind") == self.source)
        if self.source_detail is not None:
            keep = keep & F.coalesce(
                F.lower("source_payload").contains(self.source_detail.lower()), F.lit(False)
            )
        if self.min_confidence is not None:
            keep = keep & (confidence_rank(F.col("confidence")) <= CONFIDENCES.index(self.min_confidence))
        if self.min_tokens is not None:
            keep = keep & (F.col("tokens") >= self.min_tokens)
        return keep

    def residual_survives(self) -> Column:
        """Whether the unattributed remainder is part of the filtered view."""
        if not self.active:
            return F.lit(True)
        if self.category != "unattributed" or self.source is not None or self.source_detail is not None:
            return F.lit(False)
        if self.min_confidence is not None and CONFIDENCES.index(self.min_confidence) < 1:
            return F.lit(False)
        return F.lit(True) if self.min_tokens is None else F.col("residual") >= self.min_tokens


def peak_turns(turns: DataFrame) -> DataFrame:
    """The turn with the largest prompt per session; the earliest on ties."""
    measured = turns.where(F.col("prompt_tokens").isNotNull())
    best = measured.groupBy(*SESSION).agg(
        F.max_by("turn", F.struct("prompt_tokens", (-F.col("turn")).alias("t"))).alias("turn"),
        F.max("prompt_tokens").alias("peak_prompt_tokens"),
    )
    return best


def share(tokens: Column, total: Column) -> Column:
    return tokens / F.greatest(total, F.lit(1))


def by_category(items: DataFrame, snapshots: DataFrame, keep: ItemFilter = ItemFilter()) -> DataFrame:
    """Tokens per category with the share of the *whole* prompt, remainder included."""
    grouped = (
        items.where(keep.matches())
        .groupBy(*TURN, "category")
        .agg(
            F.sum("tokens").alias("tokens"),
            F.count(F.lit(1)).alias("item_count"),
            F.max(confidence_rank(F.col("confidence"))).alias("weakest"),
        )
    )
    rest = snapshots.where(keep.residual_survives() & (F.col("residual") > 0)).select(
        *TURN,
        F.lit("unattributed").alias("category"),
        F.col("residual").alias("tokens"),
        F.lit(1).cast("bigint").alias("item_count"),
        F.lit(1).alias("weakest"),
    )
    totals = snapshots.select(*TURN, "total")
    return (
        grouped.unionByName(rest)
        .join(totals, TURN)
        .select(
            *TURN,
            "category",
            "tokens",
            share(F.col("tokens"), F.col("total")).alias("share"),
            "item_count",
            confidence_name(F.col("weakest")).alias("confidence"),
        )
    )


def view_header(items: DataFrame, snapshots: DataFrame, keep: ItemFilter = ItemFilter()) -> DataFrame:
    """How much of each prompt a filter selects; the denominator stays the whole."""
    matched = items.groupBy(*TURN).agg(
        F.sum(F.when(keep.matches(), F.col("tokens")).otherwise(0)).alias("m_tokens"),
        F.count_if(keep.matches()).alias("matched_items"),
        F.count(F.lit(1)).alias("total_items"),
    )
    zero = F.lit(0).cast("bigint")
    survives = keep.residual_survives()
    return (
        snapshots.join(matched, TURN, "left")
        .withColumn("residual_included", survives)
        .withColumn(
            "matched_tokens",
            F.coalesce("m_tokens", zero) + F.when(survives, F.col("residual")).otherwise(zero),
        )
        .select(
            *TURN,
            "total",
            "residual",
            "residual_included",
            "matched_tokens",
            F.coalesce("matched_items", zero).alias("matched_items"),
            F.coalesce("total_items", zero).alias("total_items"),
            share(F.col("matched_tokens"), F.col("total")).alias("share_of_total"),
        )
    )


def available_values(items: DataFrame) -> DataFrame:
    """Categories, source kinds and confidences present in each turn, with their tokens."""
    # One pass: each item is counted once per facet.
    facets = items.select(
        *TURN,
        "tokens",
        F.explode(
            F.array(
                F.struct(F.lit("category").alias("facet"), F.col("category").alias("value")),
                F.struct(F.lit("source").alias("facet"), F.col("source_kind").alias("value")),
                F.struct(F.lit("confidence").alias("facet"), F.col("confidence").alias("value")),
            )
        ).alias("f"),
    )
    return facets.groupBy(*TURN, F.col("f.facet").alias("facet"), F.col("f.value").alias("value")).agg(
        F.sum("tokens").alias("tokens")
    )


def largest_contributors(
    items: DataFrame, snapshots: DataFrame, k: int = 15, keep: ItemFilter = ItemFilter()
) -> DataFrame:
    """The ``k`` largest items of each turn; earlier items first on ties."""
    top = top_k_per_group(
        items.where(keep.matches()),
        TURN,
        [F.col("tokens").desc(), F.col("seq").asc()],
        k,
        spread=F.col("seq"),
    )
    return top.join(snapshots.select(*TURN, "total"), TURN).withColumn(
        "share", share(F.col("tokens"), F.col("total"))
    )


def duplicate_groups(items: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Items of a turn with identical content; all but the first are repeats.

    ``items`` carry ``fp``.  Only sums travel, so the number of copies of one
    content is no limit; :func:`duplicate_members` lists the copies.
    """
    groups = (
        items.where(F.col("fp").isNotNull())
        .groupBy(*TURN, "fp")
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.sum("tokens").alias("total_tokens"),
            F.min_by("tokens", "seq").alias("first_tokens"),
            F.min_by("item_id", "seq").alias("first_item"),
            F.max(confidence_rank(F.col("confidence"))).alias("weakest"),
        )
        .where(F.col("copies") > 1)
    )
    return groups.join(snapshots.select(*TURN, "total"), TURN).select(
        *TURN,
        "fp",
        "copies",
        "total_tokens",
        (F.col("total_tokens") - F.col("first_tokens")).alias("repeated_tokens"),
        "first_item",
        share(F.col("total_tokens"), F.col("total")).alias("share"),
        confidence_name(F.col("weakest")).alias("confidence"),
    )


def duplicate_members(items: DataFrame, groups: DataFrame) -> DataFrame:
    """The items behind each duplicate group."""
    return items.join(groups.select(*TURN, "fp"), [*TURN, "fp"], "left_semi")


def low_information(items: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Large items that compress well, scored by the tokens that carry nothing new."""
    ratio = F.try_divide("compressed_bytes", "original_bytes")
    return (
        items.where(F.col("original_bytes") >= LOW_ENTROPY_BYTES)
        .withColumn("compression_ratio", ratio)
        .where(F.col("compression_ratio") <= LOW_ENTROPY_RATIO)
        .join(snapshots.select(*TURN, "total"), TURN)
        .withColumn(
            "waste_score_tokens",
            F.round(F.col("tokens") * F.greatest(F.lit(0.0), 1 - F.col("compression_ratio"))).cast("bigint"),
        )
        .withColumn("share", share(F.col("tokens"), F.col("total")))
    )


def unmeasured_items(items: DataFrame) -> DataFrame:
    """Items per turn whose content could not be fingerprinted."""
    return items.groupBy(*TURN).agg(F.count_if(F.col("fp").isNull()).alias("unmeasured_items"))


def diagnosis(items: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Repeats, low information and unmeasured items of every turn, in figures."""
    repeats = duplicate_groups(items, snapshots).groupBy(*TURN).agg(
        F.count(F.lit(1)).alias("duplicate_groups"), F.sum("repeated_tokens").alias("repeated_tokens")
    )
    low = low_information(items, snapshots).groupBy(*TURN).agg(
        F.count(F.lit(1)).alias("low_information_items"), F.sum("waste_score_tokens").alias("waste_score_tokens")
    )
    counts = ["duplicate_groups", "repeated_tokens", "low_information_items", "waste_score_tokens"]
    return (
        unmeasured_items(items)
        .join(repeats, TURN, "left")
        .join(low, TURN, "left")
        .select(*TURN, "unmeasured_items", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counts])
    )


def worst_items(items: DataFrame, snapshots: DataFrame, k: int = 8) -> DataFrame:
    """The ``k`` items of each turn that waste most; earlier items first on ties."""
    return top_k_per_group(
        low_information(items, snapshots), TURN, [F.col("waste_score_tokens").desc(), F.col("seq")], k, spread=F.col("seq")
    )
