"""Column expressions over one usage record, one size or one price."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom.schema import CONFIDENCES


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def prompt_tokens(usage: Column | str = "usage") -> Column:
    """Tokens sent with a request; NULL when nothing was recorded or all is zero."""
    u = _c(usage)
    parts = [u[name] for name in ("input", "cache_creation", "cache_read")]
    total = sum((F.coalesce(p, F.lit(0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0)))
    return F.nullif(total.cast("bigint"), F.lit(0).cast("bigint"))


def utilisation(prompt: Column, window: Column) -> Column:
    """Share of the context window in use; NULL without a positive window."""
    return F.when(window > 0, F.try_divide(prompt, window))


def estimate_tokens(chars: Column, ratio: Column | float) -> Column:
    """Characters to tokens, rounded up."""
    ratio = ratio if isinstance(ratio, Column) else F.lit(ratio)
    return F.ceil(F.coalesce(chars, F.lit(0)) / ratio).cast("bigint")


def size_confidence(size_kind: Column) -> Column:
    """How far a token figure can be trusted, from how it was obtained."""
    return (
        F.when(size_kind == "observed", "observed")
        .when(size_kind == "exact", "derived")
        .otherwise("estimated")
    )


def is_trustworthy(size_kind: Column) -> Column:
    return size_kind.isin("observed", "exact")


def confidence_rank(confidence: Column) -> Column:
    """0 observed, 1 derived, 2 estimated; larger is weaker."""
    ranks = F.create_map(*[F.lit(x) for i, name in enumerate(CONFIDENCES) for x in (name, i)])
    return ranks[confidence]


def confidence_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in CONFIDENCES]), (rank + 1).cast("int"))


def weakest(*confidences: Column) -> Column:
    return confidence_name(F.greatest(*[confidence_rank(c) for c in confidences]))


def context_window_at(
    turn_window: Column, turn_model: Column, meta_window: Column, meta_model: Column
) -> Column:
    """The turn's own window, else the session's when the model is the session's."""
    own = F.when(turn_window > 0, turn_window)
    inherited = F.when(
        (turn_model.isNull() | (turn_model == meta_model)) & (meta_window > 0), meta_window
    )
    return F.coalesce(own, inherited)


def cached_split(input_tokens: Column, cached: Column) -> tuple[Column, Column]:
    """(fresh input, cache read) where ``input_tokens`` counts cached ones too.

    A cached figure larger than the input it is part of is not usable.
    """
    read = F.when(cached <= input_tokens, cached)
    return input_tokens - F.coalesce(read, F.lit(0)), read


def largest_iteration(iterations: Column) -> Column:
    """Of several API calls logged together, the one with the largest prompt.

    Ties go to the later call.
    """
    ranked = F.transform(
        iterations,
        lambda it, i: F.struct(
            (
                F.coalesce(it["input_tokens"], F.lit(0))
                + F.coalesce(it["cache_creation_input_tokens"], F.lit(0))
                + F.coalesce(it["cache_read_input_tokens"], F.lit(0))
            ).alias("prompt"),
            i.alias("position"),
            it.alias("usage"),
        ),
    )
    return F.array_max(ranked)["usage"]


def category_cost(tokens: Column, rate_per_million: Column) -> Column:
    """Micro-dollars for one category of one request, truncated."""
    exact = F.coalesce(tokens, F.lit(0)).cast("decimal(20,0)") * rate_per_million.cast(
        "decimal(18,0)"
    )
    return F.floor(exact / F.lit(1_000_000)).cast("bigint")


def tier_price(base: Column, tiers: Column, prompt: Column) -> Column:
    """The rate of the largest tier threshold the prompt exceeds, else the base rate.

    ``tiers`` is an array of ``struct<threshold, rate>``.
    """
    reached = F.filter(tiers, lambda t: prompt > t["threshold"])
    return F.when(F.size(reached) > 0, F.array_max(reached)["rate"]).otherwise(base)


def usage_struct(**fields: Column) -> Column:
    """A usage record with every field present; the ones not given are NULL."""
    names = [
        "input",
        "cache_creation",
        "cache_read",
        "output",
        "reasoning",
        "context_window",
        "api_calls",
    ]
    return F.struct(*[fields.get(n, F.lit(None)).cast("bigint").alias(n) for n in names])
