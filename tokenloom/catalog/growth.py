"""Turns, growth, jumps and spikes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom.catalog import lake
from tokenloom.catalog.registry import query
from tokenloom.catalog.sql import EVT, q
from tokenloom.operators import growth
from tokenloom.operators.composition import peak_turns
from tokenloom.operators.reconstruct import session_calls


@query(
    "turns_linear",
    q(
        EVT,
        """SELECT session_id, turn, ts, model, prompt_tokens, anchor_seq, response_start_seq, cutoff_seq, comp_seq FROM turns""",
    ),
)
def turns_linear(spark, sf_dir):
    return lake.linear_turn_table(spark, sf_dir).select(
        "session_id", "turn", "ts", "model", "prompt_tokens", "anchor_seq", "response_start_seq", "cutoff_seq", "comp_seq"
    )


@query("turn_of_event_linear", q(EVT, "SELECT session_id, seq, kind, turn FROM evt"))
def turn_of_event_linear(spark, sf_dir):
    return lake.linear_events(spark, sf_dir).select("session_id", "seq", "kind", "turn")


@query(
    "active_model_per_event",
    q(EVT, "SELECT e.session_id, e.seq, m.model AS active_model FROM evt e LEFT JOIN ev m ON m.session_id=e.session_id AND m.seq=e.start_seq"),
)
def active_model_per_event(spark, sf_dir):
    return lake.linear_events(spark, sf_dir).select("session_id", "seq", "active_model")


TIMELINE = (
    EVT
    + """,
mark AS (SELECT * FROM (SELECT session_id, turn, line_no, trig, CASE WHEN tok_before IS NOT NULL AND tok_after IS NOT NULL
            THEN greatest(tok_before-tok_after,0) END AS reclaimed,
            row_number() OVER (PARTITION BY session_id, turn ORDER BY seq DESC) AS rn
          FROM evt WHERE kind='compacted' AND turn IS NOT NULL) WHERE rn=1),
points AS (SELECT t.session_id, t.turn, t.prompt_tokens, m.line_no AS compaction_line, m.trig AS compaction_trigger, m.reclaimed
          FROM turns t LEFT JOIN mark m ON m.session_id=t.session_id AND m.turn=t.turn)
"""
)


def points(spark, sf_dir):
    return growth.timeline(lake.linear_events(spark, sf_dir), lake.linear_turn_table(spark, sf_dir))


@query("growth_timeline", q(TIMELINE, "SELECT * FROM points"))
def growth_timeline(spark, sf_dir):
    return points(spark, sf_dir).drop("agent")


@query("growth_timeline_range", q(TIMELINE, "SELECT * FROM points WHERE turn BETWEEN 3 AND 7"))
def growth_timeline_range(spark, sf_dir):
    return growth.in_range(points(spark, sf_dir), 3, 7).drop("agent")


@query(
    "growth_unplaced_compactions",
    q(EVT, "SELECT session_id, count(*) AS unplaced_compactions FROM evt WHERE kind='compacted' AND turn IS NULL GROUP BY 1"),
)
def growth_unplaced_compactions(spark, sf_dir):
    return growth.unplaced_compactions(lake.linear_events(spark, sf_dir)).drop("agent")


@query(
    "growth_largest_jumps",
    q(
        TIMELINE,
        """,
j AS (SELECT session_id, turn, lag(prompt_tokens) OVER w AS from_tokens, prompt_tokens AS to_tokens,
       turn - lag(turn) OVER w - 1 AS skipped FROM points WHERE prompt_tokens IS NOT NULL
       WINDOW w AS (PARTITION BY session_id ORDER BY turn))
SELECT session_id, turn, from_tokens, to_tokens, to_tokens-from_tokens AS growth, skipped, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY abs(to_tokens-from_tokens) DESC, turn) AS rank FROM j WHERE from_tokens IS NOT NULL)
WHERE rank<=3
""",
    ),
)
def growth_largest_jumps(spark, sf_dir):
    return growth.largest_jumps(points(spark, sf_dir), 3).withColumn("rank", F.col("rank").cast("bigint")).drop("agent")


@query(
    "growth_chart_buckets",
    q(
        TIMELINE,
        """,
n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS rn, count(*) OVER (PARTITION BY session_id) AS c FROM points)
SELECT session_id, (rn-1)//CAST(ceil(c/5.0) AS BIGINT) AS bucket, min(turn) AS from_turn, max(turn) AS to_turn, max(prompt_tokens) AS peak,
  count(compaction_line) AS compactions FROM n GROUP BY ALL
""",
    ),
)
def growth_chart_buckets(spark, sf_dir):
    return growth.chart_buckets(points(spark, sf_dir), 5).drop("agent")


SPIKES = (
    EVT
    + """,
sp AS (SELECT * FROM (SELECT session_id, turn, lag(prompt_tokens) OVER (PARTITION BY session_id ORDER BY turn) AS previous_tokens,
        prompt_tokens AS tokens FROM turns) WHERE previous_tokens>0 AND tokens-previous_tokens>=20000)
"""
)


@query("prompt_spikes", q(SPIKES, "SELECT session_id, turn, previous_tokens, tokens, tokens-previous_tokens AS growth FROM sp"))
def prompt_spikes(spark, sf_dir):
    return growth.prompt_spikes(lake.linear_turn_table(spark, sf_dir)).drop("agent")


@query(
    "prompt_spike_causes",
    q(
        SPIKES,
        """,
lastcall AS (SELECT session_id, call_id, tool FROM (SELECT *, row_number() OVER (PARTITION BY session_id, call_id ORDER BY seq DESC) AS rn
     FROM ev WHERE kind='tool_call' AND call_id IS NOT NULL) WHERE rn=1),
cand AS (SELECT e.session_id, e.turn, e.seq, coalesce(e.char_len,0) AS chars,
     CASE e.kind WHEN 'tool_result' THEN 'tool output: '||coalesce(l.tool, e.call_id, 'tool')
       WHEN 'tool_call' THEN 'tool call: '||e.tool ELSE 'injected: '||e.label END AS cause
     FROM evt e JOIN sp ON sp.session_id=e.session_id AND sp.turn=e.turn
     LEFT JOIN lastcall l ON l.session_id=e.session_id AND l.call_id=e.call_id
     WHERE e.kind IN ('tool_result','tool_call','context_injection'))
SELECT session_id, turn, rank, cause, chars FROM (SELECT *, row_number() OVER (PARTITION BY session_id, turn ORDER BY chars DESC, seq) AS rank FROM cand) WHERE rank<=3
""",
    ),
)
def prompt_spike_causes(spark, sf_dir):
    events = lake.linear_events(spark, sf_dir)
    spikes = growth.prompt_spikes(lake.linear_turn_table(spark, sf_dir))
    return (
        growth.spike_causes(spikes, events, session_calls(events))
        .withColumn("rank", F.col("rank").cast("bigint"))
        .drop("agent")
    )


@query(
    "session_peak_turn",
    q(
        EVT,
        """SELECT session_id, turn, prompt_tokens AS peak_prompt_tokens FROM (
 SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY prompt_tokens DESC, turn) AS rn FROM turns WHERE prompt_tokens IS NOT NULL) WHERE rn=1""",
    ),
)
def session_peak_turn(spark, sf_dir):
    return peak_turns(lake.linear_turn_table(spark, sf_dir)).drop("agent")


@query(
    "context_size_per_turn",
    q(
        EVT,
        """
SELECT t.session_id, t.turn,
 CAST(coalesce(sum(e.char_len) FILTER (WHERE e.occ AND (e.mechanism IS NOT DISTINCT FROM 'base_instructions' OR t.comp_seq IS NULL OR e.seq>t.comp_seq)),0)
   + coalesce(max(CASE WHEN e.seq=t.comp_seq THEN e.byte_len END),0) AS BIGINT) AS context_chars,
 count(e.seq) FILTER (WHERE e.occ AND (e.mechanism IS NOT DISTINCT FROM 'base_instructions' OR t.comp_seq IS NULL OR e.seq>t.comp_seq))
   + CASE WHEN max(t.comp_seq) IS NULL THEN 0 ELSE 1 END AS context_items
FROM turns t LEFT JOIN ev e ON e.session_id=t.session_id AND e.seq<t.cutoff_seq GROUP BY t.session_id, t.turn
""",
    ),
)
def context_size_per_turn(spark, sf_dir):
    return lake.linear_turn_table(spark, sf_dir).select("session_id", "turn", "context_chars", "context_items")
