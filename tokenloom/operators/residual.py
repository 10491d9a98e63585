"""The part of a prompt the log does not explain: ratio fit, series and steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.plans.hops import on_path
from tokenloom.plans.quantile import median_ranks, nearest_rank, ranked_values
from tokenloom.plans.scan import (
    dense_number,
    last_known,
    neighbour_window,
    running,
    with_neighbours,
)
from tokenloom.schema import RESIDUAL_STEP_TOKENS, SESSION, STEP_WINDOW
from tokenloom.session import cut

TURN = [*SESSION, "turn"]

# Which pairs of turns say something about characters per token.
MIN_CHAR_GROWTH = 500
MIN_TOKEN_GROWTH = 50
MIN_PAIRS = 5
PLAUSIBLE = (0.5, 20.0)


def _mean(low: str, high: str) -> Column:
    return (F.col(low) + F.col(high)) / 2


def fit_ratio(samples: DataFrame) -> DataFrame:
    """Characters per token of each session, from how prompts grew.

    ``samples`` has one measured turn per row: ``turn``, ``chars``, ``tokens``
    and ``depth`` (items).  Sessions with fewer than five usable pairs are left
    out.
    """
    pairs = running(
        samples.select(*TURN, "chars", "tokens", "depth"),
        SESSION,
        "turn",
        {"p": last_known(F.struct("chars", "tokens", "depth"))},
    )
    grown = pairs.where(F.col("depth") >= F.col("p.depth")).select(
        *SESSION,
        (F.col("chars") - F.col("p.chars")).alias("dc"),
        (F.col("tokens") - F.col("p.tokens")).alias("dt"),
    )
    ratios = (
        grown.where((F.col("dc") >= MIN_CHAR_GROWTH) & (F.col("dt") >= MIN_TOKEN_GROWTH))
        .select(*SESSION, F.try_divide("dc", "dt").alias("ratio"))
        .where(F.col("ratio").between(*PLAUSIBLE))
    )
    fitted = (
        ranked_values(
            ratios,
            SESSION,
            "ratio",
            {**median_ranks("mid"), "p25": nearest_rank(0.25), "p75": nearest_rank(0.75)},
            bucket=F.floor(F.col("ratio") * 1000),
        )
        .where(F.col("group_size") >= MIN_PAIRS)
        .select(
            *SESSION,
            _mean("mid_low", "mid_high").alias("chars_per_token"),
            F.col("group_size").alias("pairs_used"),
            F.try_divide("p75", "p25").alias("dispersion"),
        )
    )
    over = samples.join(fitted.select(*SESSION, "chars_per_token"), SESSION).select(
        *SESSION, (F.col("tokens") - F.try_divide("chars", "chars_per_token")).alias("over")
    )
    overhead = ranked_values(
        over, SESSION, "over", median_ranks("mid"), bucket=F.floor(F.col("over") / 1024)
    ).select(*SESSION, _mean("mid_low", "mid_high").alias("overhead"))
    return (
        fitted.join(overhead, SESSION)
        .withColumn("unlogged_overhead", F.when(F.col("overhead") > 0, F.floor("overhead").cast("bigint")))
        .drop("overhead")
    )


def residual_series(samples: DataFrame, ratios: DataFrame) -> DataFrame:
    """Accounted and unlogged tokens per turn; a remainder of zero or less is unknown."""
    joined = samples.join(ratios.select(*SESSION, "chars_per_token"), SESSION)
    rest = F.col("tokens") - F.try_divide("chars", "chars_per_token")
    return joined.select(
        *TURN,
        F.col("tokens").alias("prompt_tokens"),
        F.floor(F.try_divide("chars", "chars_per_token")).cast("bigint").alias("accounted"),
        F.when(rest > 0, F.floor(rest).cast("bigint")).alias("unlogged"),
        F.col("depth").alias("items"),
    )


def _middle(values: Column) -> Column:
    """Integer median of an array; the even case divides without remainder."""
    ordered = F.sort_array(values)
    n = F.size(ordered)
    high = F.element_at(ordered, (F.floor(n / 2) + 1).cast("int"))
    low = F.element_at(ordered, F.greatest(F.floor(n / 2), F.lit(1)).cast("int"))
    return F.when(n % 2 == 1, high).otherwise(F.floor((low + high) / 2))


def residual_steps(
    series: DataFrame, threshold: int = RESIDUAL_STEP_TOKENS, window: int = STEP_WINDOW
) -> DataFrame:
    """Lasting changes of the unlogged part, one row per change.

    The medians of the ``window`` known turns before and from a turn on are
    compared.  Candidates of one sign at most ``window`` turns apart are one
    change; the larger wins and moves the reference point.  That fold is a path
    of hops over at most ``window + 1`` candidates, so runs may have any length.
    """
    known = dense_number(series.where(F.col("unlogged").isNotNull()).select(*TURN, "unlogged"), SESSION, "turn")
    frame = neighbour_window(SESSION, "n")
    around = with_neighbours(
        known,
        SESSION,
        "n",
        window,
        window - 1,
        {
            "before": F.collect_list("unlogged").over(frame.rowsBetween(-window, -1)),
            "after": F.collect_list("unlogged").over(frame.rowsBetween(0, window - 1)),
        },
    ).where((F.size("before") == window) & (F.size("after") == window))
    steps = (
        around.withColumn("from_tokens", _middle(F.col("before")).cast("bigint"))
        .withColumn("to_tokens", _middle(F.col("after")).cast("bigint"))
        .withColumn("growth", F.col("to_tokens") - F.col("from_tokens"))
        .where(F.abs("growth") >= threshold)
        .select(*TURN, "from_tokens", "to_tokens", "growth")
    )
    # What takes a candidate's place depends on the candidate alone: the first
    # later one that is larger, of the other sign, or out of reach.
    reach = window + 1
    frame = neighbour_window(SESSION, "n").rowsBetween(1, reach)
    later = with_neighbours(
        dense_number(steps, SESSION, "turn"),
        SESSION,
        "n",
        0,
        reach,
        {"ahead": F.collect_list(F.struct("turn", "growth")).over(frame)},
    )
    apart = lambda s: (s["turn"] - F.col("turn") > window) | (F.signum(s["growth"]) != F.signum("growth"))
    larger = lambda s: F.abs(s["growth"]) > F.abs("growth")
    hop = F.array_position(F.transform("ahead", lambda s: apart(s) | larger(s)), True)
    hops = later.withColumn("hop", F.when(hop > 0, hop))
    final = F.col("hop").isNull() | apart(F.get("ahead", F.col("hop").cast("int") - 1))
    candidates = cut(hops.withColumn("final", final).drop("ahead"))
    return on_path(candidates, SESSION, "n", "hop", reach).where("final").select(*steps.columns)


def near_compaction(steps: DataFrame, events: DataFrame, within: int = STEP_WINDOW) -> DataFrame:
    """Mark steps that a compaction at most ``within`` turns away explains.

    Each compaction is spread over the turns it can explain, which makes the
    range condition an equality.
    """
    reach = (
        events.where((F.col("kind") == "compacted") & F.col("turn").isNotNull())
        .select(*SESSION, F.explode(F.sequence(F.col("turn") - within, F.col("turn") + within)).alias("turn"))
        .distinct()
        .withColumn("near_compaction", F.lit(True))
    )
    return steps.join(reach, TURN, "left").withColumn(
        "near_compaction", F.coalesce("near_compaction", F.lit(False))
    )
