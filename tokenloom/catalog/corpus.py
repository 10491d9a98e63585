"""Corpus-wide reports, health and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom import bridge
from tokenloom.catalog import lake
from tokenloom.catalog.lake import r6
from tokenloom.catalog.registry import query
from tokenloom.catalog.sql import EVT, q
from tokenloom.operators import corpus

FACTS = (
    EVT
    + """,
meta AS (SELECT agent, session_id, arg_min(u_window, seq) FILTER (WHERE u_window IS NOT NULL) AS context_window,
   arg_min(model, seq) FILTER (WHERE kind='turn_started' AND model IS NOT NULL) AS model,
   CASE WHEN CAST(session_id AS BIGINT)%11<>0 THEN '/work/p'||CAST(CAST(session_id AS BIGINT)%14 AS VARCHAR) END AS project,
   '/logs/'||CAST(CAST(session_id AS BIGINT)%5 AS VARCHAR)||'/s'||session_id||'.jsonl' AS path FROM ev GROUP BY 1,2),
evf AS (SELECT session_id, count(*) AS events, count(*) FILTER (WHERE kind='unrecognised') AS unrec, count(*) FILTER (WHERE kind='compacted') AS comps,
   count(*) FILTER (WHERE tok_before IS NOT NULL AND tok_after IS NOT NULL) AS comps_m,
   CAST(coalesce(sum(greatest(tok_before-tok_after,0)) FILTER (WHERE tok_before IS NOT NULL AND tok_after IS NOT NULL),0) AS BIGINT) AS recl,
   count(*) FILTER (WHERE redacted) AS redacted FROM ev GROUP BY 1),
tf AS (SELECT session_id, count(*) AS turns, CAST(coalesce(sum(u_out),0) AS BIGINT) AS output, max(prompt_tokens) AS peak,
   CAST(arg_min(ts, turn) FILTER (WHERE ts IS NOT NULL) AS DATE) AS first_day, count(*) FILTER (WHERE prompt_tokens IS NULL) AS no_usage,
   count(*) FILTER (WHERE u_calls>1) AS multi FROM turns GROUP BY 1),
facts AS (SELECT m.*, e.events, e.unrec, e.comps, e.comps_m, e.recl, e.redacted, coalesce(t.turns,0) AS turns, coalesce(t.output,0) AS output,
   t.peak, t.first_day, coalesce(t.no_usage,0) AS no_usage, coalesce(t.multi,0) AS multi
   FROM meta m JOIN evf e ON e.session_id=m.session_id LEFT JOIN tf t ON t.session_id=m.session_id),
lastcall AS (SELECT session_id, call_id, tool AS called FROM (SELECT *, row_number() OVER (PARTITION BY session_id, call_id ORDER BY seq DESC) AS rn
     FROM ev WHERE kind='tool_call' AND call_id IS NOT NULL) WHERE rn=1),
ops AS (SELECT e.kind, CASE WHEN e.kind='tool_call' THEN e.tool ELSE coalesce(l.called,'unattributed') END AS tool, e.is_error, e.char_len
   FROM ev e LEFT JOIN lastcall l ON l.session_id=e.session_id AND l.call_id=e.call_id WHERE e.kind IN ('tool_call','tool_result')),
tools AS (SELECT tool, count(*) FILTER (WHERE kind='tool_call') AS calls, count(*) FILTER (WHERE kind='tool_result' AND is_error) AS errors,
   CAST(coalesce(sum(char_len) FILTER (WHERE kind='tool_result'),0) AS BIGINT) AS result_chars FROM ops GROUP BY 1)
"""
)


@lake.table
def sessions(spark, sf_dir):
    return bridge.log_sessions(spark, sf_dir)


@lake.table
def facts(spark, sf_dir):
    return corpus.session_facts(
        sessions(spark, sf_dir), lake.linear_events(spark, sf_dir), lake.linear_turn_table(spark, sf_dir)
    )


def tools(spark, sf_dir):
    return corpus.by_tool(corpus.tool_operations(lake.linear_events(spark, sf_dir)))


@query(
    "corpus_totals",
    q(
        FACTS,
        """
SELECT count(*) AS sessions, CAST(sum(turns) AS BIGINT) AS turns, CAST(sum(events) AS BIGINT) AS events, CAST(sum(output) AS BIGINT) AS output_tokens,
  CAST(sum(unrec) AS BIGINT) AS unrecognised_events, CAST(sum(comps) AS BIGINT) AS compactions, CAST(sum(comps_m) AS BIGINT) AS compactions_measured,
  CAST(sum(recl) AS BIGINT) AS reclaimed_tokens, count(*) FILTER (WHERE comps>0) AS sessions_with_compaction,
  (SELECT CAST(sum(calls) AS BIGINT) FROM tools) AS tool_calls, (SELECT CAST(sum(errors) AS BIGINT) FROM tools) AS tool_errors FROM facts
""",
    ),
)
def corpus_totals(spark, sf_dir):
    return corpus.corpus_totals(facts(spark, sf_dir), tools(spark, sf_dir))


@query(
    "corpus_by_agent",
    q(FACTS, "SELECT agent, count(*) AS sessions, CAST(sum(turns) AS BIGINT) AS turns, CAST(sum(events) AS BIGINT) AS events, CAST(sum(output) AS BIGINT) AS output_tokens FROM facts GROUP BY 1"),
)
def corpus_by_agent(spark, sf_dir):
    return corpus.totals_by(facts(spark, sf_dir), F.col("agent"), "agent")


@query(
    "corpus_by_project",
    q(
        FACTS,
        """SELECT coalesce(project,'unknown project') AS project, count(*) AS sessions, CAST(sum(turns) AS BIGINT) AS turns, CAST(sum(output) AS BIGINT) AS output_tokens
FROM facts GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 12""",
    ),
)
def corpus_by_project(spark, sf_dir):
    return corpus.by_project(facts(spark, sf_dir))


@query(
    "corpus_by_day",
    q(
        FACTS,
        """SELECT a.day, a.turns, a.output_tokens, coalesce(s.sessions,0) AS sessions FROM
(SELECT CAST(ts AS DATE) AS day, count(*) AS turns, CAST(coalesce(sum(u_out),0) AS BIGINT) AS output_tokens FROM turns WHERE ts IS NOT NULL GROUP BY 1) a
LEFT JOIN (SELECT first_day, count(*) AS sessions FROM facts WHERE first_day IS NOT NULL GROUP BY 1) s ON s.first_day=a.day""",
    ),
)
def corpus_by_day(spark, sf_dir):
    return corpus.by_day(lake.linear_turn_table(spark, sf_dir), facts(spark, sf_dir))


@query("corpus_by_tool", q(FACTS, "SELECT * FROM tools ORDER BY result_chars DESC, tool LIMIT 12"))
def corpus_by_tool(spark, sf_dir):
    return corpus.top_tools(tools(spark, sf_dir))


@query(
    "tool_operations",
    q(EVT, "SELECT session_id, seq, turn, CAST(0 AS BIGINT) AS op_index, kind AS op, tool, call_id, char_len, target, is_error FROM evt WHERE kind IN ('tool_call','tool_result')"),
)
def tool_operations(spark, sf_dir):
    return corpus.tool_operations(lake.linear_events(spark, sf_dir)).drop("agent")


@query("corpus_by_model", q(EVT, "SELECT model, count(*) AS turns FROM turns GROUP BY 1"))
def corpus_by_model(spark, sf_dir):
    return corpus.by_model(lake.linear_turn_table(spark, sf_dir))


@query(
    "corpus_pressure_bands",
    q(
        FACTS,
        """SELECT CASE WHEN context_window IS NULL OR context_window<=0 OR peak IS NULL THEN 'unmeasured' WHEN peak*1.0/context_window>=0.9 THEN 'critical'
 WHEN peak*1.0/context_window>=0.75 THEN 'tight' WHEN peak*1.0/context_window>=0.5 THEN 'warming' ELSE 'comfortable' END AS band, count(*) AS sessions FROM facts GROUP BY 1""",
    ),
)
def corpus_pressure_bands(spark, sf_dir):
    return corpus.pressure_bands(facts(spark, sf_dir))


@query(
    "corpus_largest_sessions",
    q(FACTS, "SELECT session_id, project, turns, peak AS peak_prompt_tokens, output AS output_tokens FROM facts WHERE peak IS NOT NULL ORDER BY peak DESC, session_id LIMIT 12"),
)
def corpus_largest_sessions(spark, sf_dir):
    return corpus.largest_sessions(facts(spark, sf_dir)).select(
        "session_id", "project", "turns", "peak_prompt_tokens", "output_tokens"
    )


@query(
    "session_diagnostics",
    q(
        FACTS,
        """,
pk AS (SELECT session_id, turn AS peak_turn FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY prompt_tokens DESC, turn) AS rn FROM turns WHERE prompt_tokens IS NOT NULL) WHERE rn=1)
SELECT f.session_id, events, unrec AS unrecognised_events, turns, no_usage AS turns_without_usage, multi AS multi_call_turns, redacted AS redacted_reasoning,
  comps AS compactions, recl AS reclaimed_tokens, peak AS peak_prompt_tokens, p.peak_turn, round(1.0 - unrec*1.0/events,6) AS fidelity
FROM facts f LEFT JOIN pk p ON p.session_id=f.session_id""",
    ),
)
def session_diagnostics(spark, sf_dir):
    return corpus.diagnostics(facts(spark, sf_dir), lake.linear_turn_table(spark, sf_dir)).select(
        "session_id",
        "events",
        "unrecognised_events",
        "turns",
        "turns_without_usage",
        "multi_call_turns",
        "redacted_reasoning",
        "compactions",
        "reclaimed_tokens",
        "peak_prompt_tokens",
        "peak_turn",
        r6("fidelity"),
    )


@query(
    "fidelity_trend",
    q(EVT, "SELECT session_id, turn, count(*) AS events, count(*) FILTER (WHERE kind='unrecognised') AS unrecognised_events, round(1.0-count(*) FILTER (WHERE kind='unrecognised')*1.0/count(*),6) AS fidelity FROM evt GROUP BY 1,2"),
)
def fidelity_trend(spark, sf_dir):
    return corpus.fidelity_trend(lake.linear_events(spark, sf_dir)).select(
        "session_id", "turn", "events", "unrecognised_events", r6("fidelity")
    )


@query(
    "format_drift",
    q(
        FACTS,
        """SELECT e.agent, e.raw_type, count(*) AS events, count(DISTINCT e.session_id) AS sessions, min(e.session_id) AS example
FROM ev e JOIN meta m ON m.session_id=e.session_id WHERE e.kind='unrecognised' AND lower(m.path) LIKE '/logs/3/%' GROUP BY 1,2""",
    ),
)
def format_drift(spark, sf_dir):
    chosen = corpus.require_match(sessions(spark, sf_dir), "\\LOGS\\3\\")
    return corpus.format_drift(lake.linear_events(spark, sf_dir), chosen)


@query(
    "drift_scanned_by_agent",
    q(FACTS, "SELECT agent, count(*) AS sessions_scanned FROM meta WHERE path LIKE '/logs/3/%' GROUP BY 1"),
)
def drift_scanned_by_agent(spark, sf_dir):
    return corpus.scanned_by_agent(corpus.require_match(sessions(spark, sf_dir), "/logs/3"))
