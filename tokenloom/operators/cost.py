"""What requests cost at the price in force when they were made."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.usage import category_cost, tier_price
from tokenloom.plans.scan import next_known, running
from tokenloom.plans.skew import broadcast_if_small
from tokenloom.schema import AGENT_GRAPH, AGENT_LINEAR, SESSION

TURN = [*SESSION, "turn"]

# category -> (usage field, rate column)
CATEGORIES = {
    "input": ("input", "input"),
    "cache_read": ("cache_read", "cache_read"),
    "cache_write": ("cache_creation", "cache_write"),
    "output": ("output", "output"),
}


@dataclass(frozen=True)
class Scenario:
    """What-if settings; the default prices what was logged."""

    model_override: str | None = None
    cap_input_tokens: int | None = None
    cap_output_tokens: int | None = None
    forecast_turns: int | None = None


#: Why a turn has no price, in the order the causes are checked.
REASONS = {
    "model": "no model was logged",
    "usage": "input or output tokens are missing",
    "split": "the cached part of the input is unknown, so any price would mislead",
    "calls": "several calls were logged as one; only the largest prompt is known",
    "future": "the request lies in the future",
    "revision": "no price revision is that old",
    "match": "the price catalog does not list this model",
    "mode": "the model is not priced by text tokens",
    "rate": "the catalog lacks a rate for tokens that were used",
}


def reason_text(reason: Column) -> Column:
    """The cause in words."""
    return F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])[reason]


def revision_days(revisions: DataFrame, now: dt.datetime) -> DataFrame:
    """Each revision on every day it was in force, with its exact interval.

    An as-of lookup becomes an equality on the day plus a check inside the day.
    Of revisions with one time the last ``sha`` is in force.  The end of each
    interval is the next time known, looked up in blocks of one day.
    """
    stamped = (
        revisions.where(F.col("recorded_at") <= F.lit(now))
        .groupBy("recorded_at")
        .agg(F.max("sha").alias("sha"))
        .withColumn("file", F.lit(1))
    )
    day = F.unix_date(F.to_date("recorded_at")).cast("bigint")
    ends = {"until": next_known(F.col("recorded_at"), inclusive=False)}
    spans = running(stamped, ["file"], "recorded_at", ends, block=day).select("sha", "recorded_at", "until")
    last_day = F.to_date(F.coalesce("until", F.lit(now)))
    return spans.withColumn("day", F.explode(F.sequence(F.to_date("recorded_at"), last_day)))


def as_of_revision(turns: DataFrame, revisions: DataFrame, now: dt.datetime) -> DataFrame:
    """Add ``sha``: the latest revision recorded at or before each request.

    Requests without a time get the current revision, requests in the future
    none.
    """
    days = broadcast_if_small(revision_days(revisions, now))
    at = F.coalesce(F.col("ts"), F.lit(now))
    dated = turns.withColumn("__at", at).withColumn("day", F.to_date(at))
    matched = dated.join(
        days,
        (dated["day"] == days["day"])
        & (dated["__at"] >= days["recorded_at"])
        & (days["until"].isNull() | (dated["__at"] < days["until"]))
        & (dated["__at"] <= F.lit(now)),
        "left",
    )
    return matched.select(*[dated[c] for c in turns.columns], days["sha"])


def match_overrides(models: DataFrame, overrides: DataFrame) -> DataFrame:
    """Contract rates per model: the longest matching prefix.

    Every model lists its own prefixes, so the match is an equality join over
    the few distinct model names.
    """
    lowered = models.select("model").where(F.col("model").isNotNull()).distinct()
    spelled = lowered.withColumn(
        "model_prefix",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.length("model")), lambda n: F.left(F.lower(F.col("model")), n)
            )
        ),
    )
    return (
        spelled.join(overrides, "model_prefix")
        .groupBy("model")
        .agg(
            F.max_by(
                F.struct("version", *[f"{r}_rate" for _, r in CATEGORIES.values()]), F.length("model_prefix")
            ).alias("o")
        )
        .select(
            "model",
            F.col("o.version").alias("contract_version"),
            *[F.col(f"o.{r}_rate").alias(f"contract_{r}") for _, r in CATEGORIES.values()],
        )
    )


def _priced(usage: Column, rate: str, prompt: Column) -> Column:
    return tier_price(F.col(f"{rate}_rate"), F.col(f"{rate}_tiers"), prompt)


def price_turns(
    turns: DataFrame,
    catalog: DataFrame,
    now: dt.datetime,
    scenario: Scenario = Scenario(),
    overrides: DataFrame | None = None,
) -> DataFrame:
    """Cost of every turn per category, or the reason why it has none.

    ``turns``: session, ``turn``, ``ts``, ``model``, ``usage``; ``catalog``:
    :func:`tokenloom.sources.pricing.price_catalog`.  Rates are micro-dollars
    per million tokens; each category is truncated on its own.
    """
    model = F.lit(scenario.model_override) if scenario.model_override else F.col("model")
    usage = F.col("usage")
    cap = lambda c, limit: c if limit is None else F.least(c, F.lit(limit))
    base = turns.select(
        *TURN,
        "ts",
        model.cast("string").alias("model"),
        cap(usage["input"], scenario.cap_input_tokens).alias("input"),
        usage["cache_read"].alias("cache_read"),
        usage["cache_creation"].alias("cache_creation"),
        cap(usage["output"], scenario.cap_output_tokens).alias("output"),
        usage["api_calls"].alias("api_calls"),
    )
    missing_split = F.col("cache_read").isNull() | (
        (F.col("agent") == AGENT_GRAPH) & F.col("cache_creation").isNull()
    )
    early = (
        F.when(F.col("model").isNull(), "model")
        .when(F.col("input").isNull() | F.col("output").isNull(), "usage")
        .when(missing_split, "split")
        .when(F.col("api_calls") > 1, "calls")
    )
    base = base.withColumn("early", early)
    revisions = catalog.select("sha", "recorded_at").distinct()
    dated = as_of_revision(base, revisions, now).withColumn("model_key", F.lower(F.trim("model")))
    rates = catalog.drop("recorded_at").withColumnRenamed("model", "model_key")
    listed = dated.join(
        broadcast_if_small(rates.withColumn("in_catalog", F.lit(True))), ["sha", "model_key"], "left"
    )
    if overrides is not None:
        contract = match_overrides(base.select("model"), overrides)
        listed = listed.join(broadcast_if_small(contract), "model", "left")
    else:
        listed = listed.withColumn("contract_version", F.lit(None).cast("string"))
        for _, rate in CATEGORIES.values():
            listed = listed.withColumn(f"contract_{rate}", F.lit(None).cast("bigint"))
    zero = F.lit(0).cast("bigint")
    prompt = sum((F.coalesce(c, zero) for c in ("cache_read", "cache_creation")), F.coalesce("input", zero))
    by_contract = F.col("contract_version").isNotNull()
    lacking = F.lit(False)
    for field, rate in CATEGORIES.values():
        listed = listed.withColumn(f"price_{rate}", _priced(usage, rate, prompt))
        lacking = lacking | (F.col(f"price_{rate}").isNull() & (F.coalesce(field, zero) > 0))
    reason = F.coalesce(
        "early",
        F.when(~by_contract & (F.col("ts") > F.lit(now)), "future")
        .when(~by_contract & F.col("sha").isNull(), "revision")
        .when(~by_contract & F.col("in_catalog").isNull(), "match")
        .when(~by_contract & F.coalesce(~F.col("mode").isin("chat", "completion"), F.lit(False)), "mode")
        .when(~by_contract & lacking, "rate"),
    )
    out = listed.withColumn("reason", reason)
    for name, (field, rate) in CATEGORIES.items():
        unit = F.when(by_contract, F.col(f"contract_{rate}")).otherwise(F.col(f"price_{rate}"))
        out = out.withColumn(
            f"{name}_micros", F.when(F.col("reason").isNull(), category_cost(F.col(field), F.coalesce(unit, zero)))
        )
    return out.select(
        *TURN,
        "model",
        "ts",
        "reason",
        F.when(F.col("reason").isNull(), F.coalesce("contract_version", "sha")).alias("pricing_version"),
        *[F.coalesce(f, zero).alias(f"{n}_tokens") for n, (f, _) in CATEGORIES.items()],
        *[f"{n}_micros" for n in CATEGORIES],
        sum((F.col(f"{n}_micros") for n in list(CATEGORIES)[1:]), F.col("input_micros")).alias("total_micros"),
    )


def session_costs(priced: DataFrame) -> DataFrame:
    """Sums per session; unpriced turns are counted, never priced at zero."""
    ok = F.col("reason").isNull()
    zero = F.lit(0).cast("bigint")
    return priced.groupBy(*SESSION).agg(
        *[F.coalesce(F.sum(F.when(ok, F.col(f"{n}_tokens"))), zero).alias(f"{n}_tokens") for n in CATEGORIES],
        *[F.coalesce(F.sum(f"{n}_micros"), zero).alias(f"{n}_micros") for n in CATEGORIES],
        F.coalesce(F.sum("total_micros"), zero).alias("total_micros"),
        F.count_if(ok).alias("priced_turns"),
        F.count_if(~ok).alias("unpriced_turns"),
        F.count_distinct("pricing_version").alias("pricing_versions"),
    )


def unpriced_reasons(priced: DataFrame) -> DataFrame:
    return priced.where(F.col("reason").isNotNull()).groupBy("agent", "reason").agg(
        F.count(F.lit(1)).alias("turns")
    )


def compare_scenario(baseline: DataFrame, hypothetical: DataFrame) -> DataFrame:
    """Savings per session of a what-if over what was logged, never negative."""
    b = baseline.select(*SESSION, F.col("total_micros").alias("baseline_micros"))
    h = hypothetical.select(*SESSION, F.col("total_micros").alias("hypothetical_micros"))
    return b.join(h, SESSION).withColumn(
        "savings_micros",
        F.greatest(F.col("baseline_micros") - F.col("hypothetical_micros"), F.lit(0).cast("bigint")),
    )


def forecast(priced: DataFrame, repriced: DataFrame, additional_turns: int) -> DataFrame:
    """Cost of more turns like the logged ones at *current* prices.

    ``repriced`` are the same turns priced without their time.  Averages are
    truncated per category.  Sessions with any unpriced turn have no forecast.
    """
    observed = session_costs(priced).where((F.col("unpriced_turns") == 0) & (F.col("priced_turns") > 0))
    current = session_costs(repriced).where(F.col("unpriced_turns") == 0)
    average = current.select(
        *SESSION,
        *[F.expr(f"{n}_tokens div priced_turns").alias(f"avg_{n}_tokens") for n in CATEGORIES],
        sum(
            (F.expr(f"{n}_micros div priced_turns") for n in list(CATEGORIES)[1:]),
            F.expr("input_micros div priced_turns"),
        ).alias("per_turn_micros"),
    )
    return (
        observed.select(*SESSION, F.col("total_micros").alias("observed_micros"))
        .join(average, SESSION)
        .withColumn("projected_additional_micros", F.col("per_turn_micros") * F.lit(additional_turns))
        .withColumn("projected_total_micros", F.col("observed_micros") + F.col("projected_additional_micros"))
    )


def without_time(turns: DataFrame) -> DataFrame:
    """The same turns as if asked about now."""
    return turns.withColumn("ts", F.lit(None).cast("timestamp"))


def cache_usage(turns: DataFrame) -> DataFrame:
    """Fresh, read and written tokens per session; shares only over complete turns."""
    u = F.col("usage")
    linear = F.col("agent") == AGENT_LINEAR
    fresh = F.when(~linear | u["cache_read"].isNotNull(), u["input"])
    prompt = F.coalesce(u["input"], F.lit(0)) + F.coalesce(u["cache_read"], F.lit(0)) + F.coalesce(
        u["cache_creation"], F.lit(0)
    )
    complete = (
        u["input"].isNotNull()
        & u["cache_read"].isNotNull()
        & (prompt > 0)
        & (linear | u["cache_creation"].isNotNull())
    )
    grouped = turns.groupBy(*SESSION).agg(
        F.sum(fresh).alias("fresh_input_tokens"),
        F.sum(u["cache_read"]).alias("cache_read_tokens"),
        F.sum(u["cache_creation"]).alias("cache_write_tokens"),
        F.count_if(complete).alias("complete_turns"),
        F.count(F.lit(1)).alias("total_turns"),
        F.count_if(u["api_calls"] > 1).alias("multi_call_turns"),
        F.sum(F.when(complete, u["cache_read"])).alias("__reads"),
        F.sum(F.when(complete, prompt)).alias("__input"),
    )
    return grouped.withColumn("cache_read_share", F.try_divide("__reads", "__input")).drop("__reads", "__input")
