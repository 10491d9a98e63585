"""Saved presentation streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom import bridge
from tokenloom.catalog.registry import query
from tokenloom.catalog.sql import q
from tokenloom.sources.streams import import_stream

ST = """
s0 AS (SELECT 'u'||CAST(user_id AS VARCHAR) AS file, event_id+1 AS line_no, user_id AS u, CAST(props->>'$.k' AS BIGINT) AS k, event_type AS t FROM events),
mixed AS (SELECT file, bool_or(k%50=1 AND {has_id}) AND bool_or(k%50<>1 AND {has_id}) AS two, bool_or(t='error' AND u%17=9) AS oldv, u FROM s0 GROUP BY file, u),
badf AS (SELECT file FROM mixed WHERE u%17=5 OR (u%17=0 AND two) {extra}),
s AS (SELECT * FROM s0 WHERE file NOT IN (SELECT file FROM badf)),
it AS (SELECT *, k%30 AS item, min(line_no) OVER (PARTITION BY file, k%30) AS first_line FROM s WHERE t IN ('click','purchase'))
"""
EXEC = ST.format(has_id="TRUE", extra="")
SERVER = ST.format(has_id="t<>'error'", extra="")
GRAPH = ST.format(has_id="NOT (t IN ('click','purchase') AND k%11=0)", extra="OR oldv")


def _events(spark, sf_dir, surface, version):
    out = import_stream(bridge.stream_lines(spark, sf_dir, surface), surface, version)
    return out.events.select("file", "line_no", "block", "raw_type", "kind", "role", "char_len", "is_error", "subtype")


def _usage(spark, sf_dir, surface, version, field):
    out = import_stream(bridge.stream_lines(spark, sf_dir, surface), surface, version)
    return out.usage.select(
        "file", "line_no", "scope", F.get_json_object("reported", f"$.{field}").cast("bigint").alias("input_tokens")
    )


@query(
    "stream_exec_events",
    q(
        EXEC,
        """SELECT file, line_no, CAST(0 AS BIGINT) AS block, 'item.completed/'||CASE k%3 WHEN 0 THEN 'agent_message' WHEN 1 THEN 'command_execution' ELSE 'strange' END AS raw_type,
 CASE WHEN line_no>first_line THEN 'session_event' WHEN k%3=0 THEN 'message' WHEN k%3=1 THEN 'tool_result' ELSE 'unrecognised' END AS kind, CASE WHEN line_no=first_line AND k%3=0 THEN 'assistant' END AS role,
 CASE WHEN line_no=first_line AND k%3<>2 THEN k+1 END AS char_len, CASE WHEN line_no=first_line AND k%3=1 THEN k%2=1 END AS is_error, CASE WHEN line_no>first_line THEN 'repeated-finalized-item' END AS subtype FROM it
UNION ALL SELECT file, line_no, 0, CASE t WHEN 'signup' THEN 'turn.completed' WHEN 'view' THEN 'item.updated' ELSE 'novel' END, CASE WHEN t='error' THEN 'unrecognised' ELSE 'session_event' END, NULL, NULL, NULL,
 CASE t WHEN 'signup' THEN 'turn.completed' WHEN 'view' THEN 'item.updated' END FROM s WHERE t NOT IN ('click','purchase')""",
    ),
)
def stream_exec_events(spark, sf_dir):
    return _events(spark, sf_dir, "codex-exec", "0.161.0")


@query("stream_exec_usage", q(EXEC, "SELECT file, line_no, 'turn-aggregate' AS scope, k AS input_tokens FROM s WHERE t='signup'"))
def stream_exec_usage(spark, sf_dir):
    return _usage(spark, sf_dir, "codex-exec", "0.161.0", "input_tokens")


@query(
    "stream_server_events",
    q(
        SERVER,
        """SELECT file, line_no, CAST(0 AS BIGINT) AS block, 'item/completed/'||CASE WHEN k%2=0 THEN 'reasoning' ELSE 'userMessage' END AS raw_type,
 CASE WHEN line_no>first_line THEN 'session_event' WHEN k%2=0 THEN 'reasoning' ELSE 'message' END AS kind, CASE WHEN line_no=first_line AND k%2=1 THEN 'user' END AS role,
 CASE WHEN line_no=first_line THEN k+3 END AS char_len, CAST(NULL AS BOOLEAN) AS is_error, CASE WHEN line_no>first_line THEN 'repeated-finalized-item' END AS subtype FROM it
UNION ALL SELECT file, line_no, 0, r, 'session_event', NULL, NULL, NULL, r FROM (SELECT *, CASE t WHEN 'signup' THEN 'thread/tokenUsage/updated' WHEN 'view' THEN 'item/started' ELSE 'rpc-response' END AS r FROM s WHERE t NOT IN ('click','purchase'))""",
    ),
)
def stream_server_events(spark, sf_dir):
    return _events(spark, sf_dir, "codex-app-server", "0.161.0")


@query("stream_server_usage", q(SERVER, "SELECT file, line_no, 'last-request-snapshot' AS scope, k AS input_tokens FROM s WHERE t='signup'"))
def stream_server_usage(spark, sf_dir):
    return _usage(spark, sf_dir, "codex-app-server", "0.161.0", "inputTokens")


@query(
    "stream_graph_events",
    q(
        GRAPH,
        """SELECT file, line_no, CAST(b AS BIGINT) AS block, CASE WHEN b=0 THEN 'assistant' ELSE 'claude-message/block-1' END AS raw_type, CASE WHEN k%11=0 THEN 'session_event' WHEN b=0 THEN 'message' ELSE 'tool_call' END AS kind,
 CASE WHEN k%11<>0 AND b=0 THEN 'assistant' END AS role, CASE WHEN k%11=0 THEN NULL WHEN b=0 THEN k+1 ELSE length('{"file_path":"a.py"}') END AS char_len, CAST(NULL AS BOOLEAN) AS is_error, CASE WHEN k%11=0 THEN 'subagent-message' END AS subtype
 FROM s CROSS JOIN (VALUES (0),(1)) x(b) WHERE t IN ('click','purchase') AND (b=0 OR k%11<>0)
UNION ALL SELECT file, line_no, 0, CASE t WHEN 'signup' THEN 'result' WHEN 'error' THEN 'system/init' ELSE CASE WHEN k%2=0 THEN 'stream_event/ping' ELSE 'stream_event/odd' END END,
 CASE WHEN t='error' THEN 'session_started' WHEN t='view' AND k%2=1 THEN 'unrecognised' ELSE 'session_event' END, NULL, NULL, NULL, CASE WHEN t='signup' THEN 'result' WHEN t='view' AND k%2=0 THEN 'stream_event/ping' END FROM s WHERE t NOT IN ('click','purchase')""",
    ),
)
def stream_graph_events(spark, sf_dir):
    return _events(spark, sf_dir, "claude-stream", "2.0")


@query(
    "stream_graph_usage",
    q(
        GRAPH,
        """SELECT file, line_no, 'session-aggregate' AS scope, k AS input_tokens FROM s WHERE t='signup'
UNION ALL SELECT file, line_no, 'request', k FROM (SELECT *, row_number() OVER (PARTITION BY file, k%10 ORDER BY line_no) AS rn FROM s WHERE t IN ('click','purchase') AND k%11<>0) WHERE rn=1""",
    ),
)
def stream_graph_usage(spark, sf_dir):
    """Each request is reported once, however many records repeat it."""
    return _usage(spark, sf_dir, "claude-stream", "2.0", "input_tokens")


@query("stream_rejected_captures", q(GRAPH, "SELECT file FROM badf"))
def stream_rejected_captures(spark, sf_dir):
    return import_stream(bridge.stream_lines(spark, sf_dir, "claude-stream"), "claude-stream", "2.0").rejected.select("file")
