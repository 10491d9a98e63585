"""Alert rules over finished tables; the streaming monitor gives the same findings."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.text import short_label
from tokenloom.operators.growth import prompt_spikes, reclaimed
from tokenloom.plans.scan import last_known, next_known, running, running_count
from tokenloom.schema import SESSION

RULES = [
    "context_pressure",
    "prompt_spike",
    "large_contributor",
    "tool_error_streak",
    "compaction",
    "secret_exposure",
    "format_drift",
    "duplicate_context",
    "low_entropy_content",
    "residual_step",
    "instruction_drift",
    "cost_budget",
]


@dataclass(frozen=True)
class AlertSettings:
    """Thresholds of the rules; defaults are the published ones."""

    enabled: bool = True
    include_subagents: bool = True
    pressure_warning: float = 0.75
    pressure_critical: float = 0.90
    pressure_reset_warning: float = 0.70
    pressure_reset_critical: float = 0.85
    spike_tokens: int = 20_000
    contributor_tokens: int = 20_000
    contributor_share: float = 0.25
    error_streak: int = 3
    duplicate_tokens: int = 10_000
    low_entropy_tokens: int = 20_000
    residual_tokens: int = 5_000
    cost_budget_micros: int | None = None
    forecast_turns: int = 10
    rules_off: frozenset[str] = frozenset()

    def __post_init__(self):
        if not (
            0 <= self.pressure_reset_warning
            < self.pressure_warning
            <= self.pressure_reset_critical
            < self.pressure_critical
        ):
            raise ValueError("pressure thresholds must rise: reset warning < warning <= reset critical < critical")
        for name in ("spike_tokens", "contributor_tokens", "duplicate_tokens", "low_entropy_tokens", "residual_tokens"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        if self.error_streak < 1:
            object.__setattr__(self, "error_streak", 1)
        unknown = set(self.rules_off) - set(RULES)
        if unknown:
            raise ValueError(f"unknown rules: {', '.join(sorted(unknown))}")

    def without(self, *rules: str) -> "AlertSettings":
        return replace(self, rules_off=self.rules_off | frozenset(rules))


ALERT_COLUMNS = [*SESSION, "rule", "severity", "turn", "line_no", "seq", "dedupe_key", "amount", "detail"]


def _alert(df: DataFrame, rule: str, severity, key: list, turn, line, seq, amount, detail) -> DataFrame:
    text = F.concat_ws(":", *[c if isinstance(c, Column) else F.lit(c) for c in key])
    severity = severity if isinstance(severity, Column) else F.lit(severity)
    return df.select(
        *SESSION,
        F.lit(rule).alias("rule"),
        severity.alias("severity"),
        turn.cast("bigint").alias("turn"),
        line.cast("bigint").alias("line_no"),
        seq.cast("bigint").alias("seq"),
        text.alias("dedupe_key"),
        amount.cast("bigint").alias("amount"),
        detail.cast("string").alias("detail"),
    )


_NONE = F.lit  # NULL columns are spelled _NONE(None)


def pressure_bands(turns: DataFrame, s: AlertSettings = AlertSettings()) -> DataFrame:
    """Band of every measured turn with hysteresis, and the band before it.

    ``turns``: session, ``turn``, ``prompt_tokens``, ``window``.  Five classes of
    fullness decide the next band: three fix it whatever came before, two keep
    part of the history.  So the band follows from the last fixing turn, the
    first weakly falling turn after it and the last strongly filled turn --
    three look-backs instead of a step-by-step fold.
    """
    use = F.try_divide("prompt_tokens", F.when(F.col("window") > 0, F.col("window")))
    measured = turns.withColumn("used", use).where(F.col("used").isNotNull())
    v = F.col("used")
    cls = (
        F.when(v >= s.pressure_critical, "A")
        .when(v >= s.pressure_reset_critical, "B")
        .when(v >= s.pressure_warning, "D")
        .when(v >= s.pressure_reset_warning, "E")
        .otherwise("F")
    )
    classed = measured.withColumn("cls", cls)
    c, t = F.col("cls"), F.col("turn")
    ahead = running(classed, SESSION, "turn", {"next_e": next_known(F.when(c == "E", t), inclusive=False)})
    fixing = F.when(c.isin("A", "D", "F"), F.struct(c.alias("cls"), t.alias("turn"), F.col("next_e").alias("e")))
    placed = running(
        ahead,
        SESSION,
        "turn",
        {
            "x": last_known(fixing, inclusive=True),
            "b": last_known(F.when(c == "B", t), inclusive=True),
        },
    )
    x, b = F.col("x"), F.col("b")
    refilled = lambda since: F.coalesce(b > since, F.lit(False))
    band = (
        F.when(x["cls"] == "D", 1)
        .when(
            x["cls"] == "A",
            F.when(x["e"].isNull() | (x["e"] > t), 2).when(refilled(x["e"]), 1).otherwise(0),
        )
        .otherwise(F.when(refilled(F.coalesce(x["turn"], F.lit(-1))), 1).otherwise(0))
    )
    banded = placed.withColumn("band", band).drop("x", "b", "next_e", "cls")
    return running(banded, SESSION, "turn", {"p": last_known(F.struct("band"))}).select(
        *[F.col(k) for k in banded.columns], F.coalesce(F.col("p.band"), F.lit(0)).alias("previous_band")
    )


def context_pressure(turns: DataFrame, s: AlertSettings) -> DataFrame:
    rising = pressure_bands(turns, s).where(F.col("band") > F.col("previous_band"))
    return _alert(
        rising,
        "context_pressure",
        F.when(F.col("band") == 2, "critical").otherwise("warning"),
        ["pressure", F.col("session_id"), F.col("turn")],
        F.col("turn"),
        _NONE(None),
        F.col("anchor_seq"),
        F.col("prompt_tokens"),
        F.element_at(F.array(F.lit("normal"), F.lit("warning"), F.lit("critical")), F.col("band") + 1),
    )


def prompt_spike(turns: DataFrame, s: AlertSettings) -> DataFrame:
    spikes = prompt_spikes(turns, s.spike_tokens).join(
        turns.select(*SESSION, "turn", "anchor_seq"), [*SESSION, "turn"]
    )
    return _alert(
        spikes, "prompt_spike", "warning", ["spike", F.col("session_id"), F.col("turn")], F.col("turn"), _NONE(None),
        F.col("anchor_seq"), F.col("growth"), _NONE(None),
    )


def error_streaks(results: DataFrame) -> DataFrame:
    """Length of the run of failures of one tool on one target that each failure ends.

    ``results``: session, ``pos`` (unique order), ``failed``, ``key``.
    """
    seen = running(
        results, SESSION, "pos", {"p": last_known(F.struct("failed", "key")), "n": running_count(F.lit(True), inclusive=True)}
    )
    same = F.coalesce(F.col("p.failed") & (F.col("p.key") == F.col("key")), F.lit(False))
    started = seen.withColumn("starts", F.col("failed") & ~same).drop("p")
    at = running(started, SESSION, "pos", {"first_n": last_known(F.when(F.col("starts"), F.col("n")), inclusive=True)})
    return at.where("failed").withColumn("streak", F.col("n") - F.col("first_n") + 1)


#: Room for operations of one record in the order of operations.
OPS_PER_RECORD = 65_536


def tool_error_streak(events: DataFrame, s: AlertSettings) -> DataFrame:
    """Fires when a streak reaches the limit, once per streak.

    ``events`` carry ``call``: what was known of the call when the result was
    logged.
    """
    ops = events.select(*SESSION, "seq", "line_no", "turn", "call", F.posexplode("tool_ops").alias("i", "o")).where(
        F.col("o.op") == "tool_result"
    )
    tool = F.coalesce("o.tool", "call.tool")
    results = ops.select(
        *SESSION,
        "seq",
        "line_no",
        "turn",
        F.col("i").alias("op_index"),
        (F.col("seq") * OPS_PER_RECORD + F.col("i")).alias("pos"),
        F.coalesce("o.is_error", F.lit(False)).alias("failed"),
        F.coalesce(tool, F.lit("tool")).alias("tool"),
        F.when(tool.isNull(), "tool").otherwise(F.concat_ws("\u0001", tool, F.col("call.target"))).alias("key"),
    )
    fired = error_streaks(results).where(F.col("streak") == s.error_streak)
    return _alert(
        fired, "tool_error_streak", "warning", ["tool-errors", F.col("session_id"), F.col("seq"), F.col("op_index")],
        F.col("turn"), F.col("line_no"), F.col("seq"), F.col("streak"), F.col("tool"),
    )


def compaction(events: DataFrame, s: AlertSettings) -> DataFrame:
    return _alert(
        events.where(F.col("kind") == "compacted"), "compaction", "info", ["compaction", F.col("session_id"), F.col("line_no")],
        F.col("turn"), F.col("line_no"), F.col("seq"), reclaimed(F.col("compaction")), F.col("compaction.trigger"),
    )


def format_drift(events: DataFrame, s: AlertSettings) -> DataFrame:
    """One candidate per session and type; their shared key makes it one finding per agent."""
    unknown = (
        events.where(F.col("kind") == "unrecognised")
        .groupBy(*SESSION, "raw_type")
        .agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq"))
    )
    return _alert(
        unknown, "format_drift", "warning", ["format", F.col("agent"), F.col("raw_type")], _NONE(None), _NONE(None),
        F.col("seq"), F.col("n"), F.col("raw_type"),
    )


def large_contributor(top: DataFrame, s: AlertSettings) -> DataFrame:
    """``top``: the twenty largest items of each turn with their share."""
    big = top.where((F.col("tokens") >= s.contributor_tokens) | (F.col("share") >= s.contributor_share))
    return _alert(
        big, "large_contributor", "warning", ["contributor", F.col("session_id"), F.col("turn"), F.col("item_id")],
        F.col("turn"), _NONE(None), F.col("seq"), F.col("tokens"), short_label(F.col("label")),
    )


def duplicate_context(groups: DataFrame, s: AlertSettings) -> DataFrame:
    big = groups.where(F.col("repeated_tokens") >= s.duplicate_tokens)
    return _alert(
        big, "duplicate_context", "warning", ["duplicate", F.col("session_id"), F.col("turn"), F.col("fp")], F.col("turn"),
        _NONE(None), F.col("turn"), F.col("repeated_tokens"), F.col("copies"),
    )


def low_entropy_content(items: DataFrame, s: AlertSettings) -> DataFrame:
    big = items.where(F.col("waste_score_tokens") >= s.low_entropy_tokens)
    return _alert(
        big, "low_entropy_content", "warning", ["entropy", F.col("session_id"), F.col("turn"), F.col("item_id")],
        F.col("turn"), _NONE(None), F.col("seq"), F.col("waste_score_tokens"), short_label(F.col("label")),
    )


def secret_exposure(findings: DataFrame, s: AlertSettings) -> DataFrame:
    return _alert(
        findings, "secret_exposure", F.col("severity"), ["secret", F.col("session_id"), F.col("line_no"), F.col("kind")],
        F.col("turn"), F.col("line_no"), F.col("line_no"), F.col("occurrences"), F.col("kind"),
    )


def residual_step(steps: DataFrame, s: AlertSettings) -> DataFrame:
    big = steps.where(F.abs("growth") >= s.residual_tokens)
    return _alert(
        big, "residual_step", "warning", ["residual", F.col("session_id"), F.col("turn")], F.col("turn"), _NONE(None),
        F.col("turn"), F.col("growth"), _NONE(None),
    )


def instruction_change(changes: DataFrame, s: AlertSettings, after_turn: Column | None = None) -> DataFrame:
    """Changes placed in a turn, later than ``after_turn`` when given."""
    placed = changes.where(F.col("to_turn").isNotNull())
    if after_turn is not None:
        placed = placed.where(after_turn.isNull() | (F.col("to_turn") > after_turn))
    return _alert(
        placed, "instruction_drift", "warning", ["instructions", F.col("session_id"), F.col("mechanism"), F.col("to_turn")],
        F.col("to_turn"), _NONE(None), F.col("seq"), F.col("to_char_len") - F.col("from_char_len"), short_label(F.col("label")),
    )


def cost_budget(costs: DataFrame, s: AlertSettings) -> DataFrame:
    """``costs``: ``observed_micros`` and, where it exists, ``projected_total_micros``."""
    if s.cost_budget_micros is None:
        return _alert(costs.limit(0), "cost_budget", "warning", ["cost"], _NONE(None), _NONE(None), _NONE(None), _NONE(None), _NONE(None))
    compared = F.coalesce("projected_total_micros", "observed_micros")
    return _alert(
        costs.where(compared >= s.cost_budget_micros), "cost_budget", "warning",
        ["cost", F.col("session_id"), F.lit(s.cost_budget_micros)], _NONE(None), _NONE(None), F.lit(0), compared, _NONE(None),
    )


def evaluate(
    events: DataFrame,
    turns: DataFrame,
    s: AlertSettings = AlertSettings(),
    sessions: DataFrame | None = None,
    deep: list[DataFrame] | None = None,
) -> DataFrame:
    """Candidates of all rules that need only the log, plus prepared ``deep`` ones.

    ``events`` carry ``turn`` and ``call``; ``turns`` carry ``prompt_tokens``,
    ``window`` and ``anchor_seq``.  With ``include_subagents`` off, ``sessions``
    tells the threads apart.
    """
    if not s.enabled:
        return context_pressure(turns.limit(0), s)
    if not s.include_subagents:
        roots = sessions.where(F.col("thread_role") == "root").select(*SESSION)
        events, turns = events.join(roots, SESSION, "left_semi"), turns.join(roots, SESSION, "left_semi")
    rules = {
        "context_pressure": lambda: context_pressure(turns, s),
        "prompt_spike": lambda: prompt_spike(turns, s),
        "tool_error_streak": lambda: tool_error_streak(events, s),
        "compaction": lambda: compaction(events, s),
        "format_drift": lambda: format_drift(events, s),
    }
    parts = [build() for name, build in rules.items() if name not in s.rules_off] + list(deep or [])
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where(~F.col("rule").isin(*s.rules_off)) if s.rules_off else out
