"""Parsing log lines into events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom import bridge
from tokenloom.catalog import lake
from tokenloom.catalog.registry import query
from tokenloom.catalog.sql import q
from tokenloom.sources import graph_agent, linear_agent


@lake.table
def graph_parsed(spark, sf_dir):
    return graph_agent.normalise(bridge.graph_lines(spark, sf_dir), with_content=True)


GL = """
c0 AS (SELECT *, conv_id AS v, turn AS t, CAST(conv_id AS VARCHAR) AS session_id, conv_id%10=0 AND turn%3=2 AS broken, conv_id%10=5 AND turn%3=2 AS future,
   role='assistant' AS asst, role='system' AS sysm, role='user' AND turn%4=2 AS res, conv_id%5=1 AS thinks, turn%4=1 AS calls FROM conversations),
gl AS (SELECT *, CASE WHEN broken OR future THEN 'unrecognised' WHEN asst AND calls THEN 'tool_call' WHEN asst AND thinks AND FALSE THEN 'x'
   WHEN asst THEN 'message' WHEN sysm THEN 'context_injection' WHEN res THEN 'tool_result' ELSE 'message' END AS kind,
   CAST('{"file_path":"src/a'||CAST(t AS VARCHAR)||'.py","n":'||CAST(v AS VARCHAR)||'}' AS VARCHAR) AS inp FROM c0)
"""


@query(
    "ingest_graph_events",
    q(
        GL,
        """SELECT session_id, t AS seq, t+1 AS line_no, CASE WHEN broken THEN NULL WHEN future THEN NULL ELSE TIMESTAMP '2026-01-01' + INTERVAL (CAST(t%9 AS INTEGER)) DAY END AS ts,
 CASE WHEN broken THEN 'unknown' WHEN future THEN 'some-future-type' WHEN asst THEN 'assistant' WHEN sysm THEN 'attachment' ELSE 'user' END AS raw_type, kind,
 CASE WHEN kind='message' THEN CASE WHEN asst THEN 'assistant' ELSE 'user' END END AS role,
 CASE WHEN broken OR future THEN NULL WHEN asst THEN CASE WHEN thinks THEN CAST(floor((v%90+10)/2.353) AS BIGINT) ELSE length(text) END
      + CASE WHEN calls THEN length(inp) WHEN thinks THEN 0 ELSE 4 END ELSE length(text) END AS char_len,
 CASE WHEN kind='tool_call' THEN 'Read' END AS tool, CASE WHEN kind='tool_call' THEN 't'||CAST(t AS VARCHAR) WHEN kind='tool_result' THEN 't'||CAST(t-1 AS VARCHAR) END AS call_id,
 CASE WHEN kind='tool_call' THEN 'src/a'||CAST(t AS VARCHAR)||'.py' END AS target, CASE WHEN kind='tool_call' THEN 'src/a'||CAST(t AS VARCHAR)||'.py' END AS file_path,
 CASE WHEN kind='tool_call' THEN '/work/demo' END AS file_dir, CASE WHEN kind='tool_result' THEN v%4=0 END AS is_error,
 CASE WHEN kind='context_injection' THEN CASE WHEN v%2=0 THEN 'nested_memory' ELSE 'skill_listing' END END AS mechanism,
 CASE WHEN kind='context_injection' THEN CASE WHEN v%2=0 THEN 'docs/RULES.md' ELSE 'Skill listing' END END AS label,
 CASE WHEN broken THEN NULL WHEN future THEN 'x'||CAST(t AS VARCHAR) ELSE 'u'||CAST(t AS VARCHAR) END AS uuid,
 CASE WHEN NOT broken AND NOT future AND t>0 THEN 'u'||CAST(t-1 AS VARCHAR) END AS parent_uuid,
 NOT broken AND NOT future AND v%7=3 AS is_sidechain,
 CASE WHEN asst AND NOT broken AND NOT future THEN 'req'||CAST(t//4 AS VARCHAR) END AS request_id,
 CASE WHEN asst AND NOT broken AND NOT future THEN CASE WHEN v%9=0 THEN '<synthetic>' ELSE 'model-x' END END AS model FROM gl""",
    ),
)
def ingest_graph_events(spark, sf_dir):
    return graph_parsed(spark, sf_dir).select(
        "session_id", "seq", "line_no", "ts", "raw_type", "kind", "role", "char_len", "tool", "call_id", "target",
        "file_path", "file_dir", "is_error", "mechanism", "label", "uuid", "parent_uuid", "is_sidechain", "request_id", "model",
    )


@query(
    "ingest_graph_usage",
    q(
        GL,
        """SELECT session_id, t AS seq, CASE WHEN v%6=0 THEN v%50+1 ELSE v%50 END AS input, CASE WHEN v%6=0 THEN 0 WHEN t%3<>0 THEN v*3 END AS cache_creation,
 CASE WHEN v%6=0 THEN t*50 ELSE t*100 END AS cache_read, t+7 AS output, CASE WHEN v%6=0 THEN 2 ELSE 1 END AS api_calls FROM gl WHERE asst AND NOT broken AND NOT future""",
    ),
)
def ingest_graph_usage(spark, sf_dir):
    """Several calls logged together: the largest counts, later ones win ties."""
    return (
        graph_parsed(spark, sf_dir)
        .where(F.col("usage").isNotNull())
        .select("session_id", "seq", "usage.input", "usage.cache_creation", "usage.cache_read", "usage.output", "usage.api_calls")
    )


@query(
    "ingest_tool_operations",
    q(
        GL,
        """SELECT session_id, t AS seq, kind AS op, CASE WHEN kind='tool_call' THEN 'Read' END AS tool, CASE WHEN kind='tool_call' THEN 't'||CAST(t AS VARCHAR) ELSE 't'||CAST(t-1 AS VARCHAR) END AS call_id,
 CASE WHEN kind='tool_call' THEN length(inp) ELSE length(text) END AS char_len FROM gl WHERE kind IN ('tool_call','tool_result')""",
    ),
)
def ingest_tool_operations(spark, sf_dir):
    return graph_parsed(spark, sf_dir).select("session_id", "seq", F.explode("tool_ops").alias("o")).select(
        "session_id", "seq", "o.op", "o.tool", "o.call_id", "o.char_len"
    )


@lake.table
def linear_parsed(spark, sf_dir):
    return linear_agent.normalise(bridge.linear_lines(spark, sf_dir), with_content=True)


LL = """
l0 AS (SELECT *, CAST(props->>'$.k' AS BIGINT) AS k, CAST(round(value*10) AS BIGINT) AS size, CAST(round(value*1000) AS BIGINT) AS big FROM events),
ll AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS seq, ts, k, size, big,
  CASE event_type WHEN 'purchase' THEN 'usage' WHEN 'signup' THEN 'comp' WHEN 'click' THEN 'call'
   WHEN 'error' THEN CASE WHEN k%10=9 THEN 'notice' ELSE 'result' END
   ELSE CASE k%7 WHEN 0 THEN 'start' WHEN 1 THEN 'msg' WHEN 2 THEN 'msg' WHEN 3 THEN 'think' WHEN 4 THEN 'tools' WHEN 5 THEN 'meta' ELSE 'notice' END END AS w FROM l0)
"""


@query(
    "ingest_linear_events",
    q(
        LL,
        """SELECT session_id, seq, CAST(date_trunc('milliseconds', ts) AS TIMESTAMP) AS ts,
 CASE w WHEN 'usage' THEN 'event_msg/token_count' WHEN 'comp' THEN 'compacted' WHEN 'call' THEN 'response_item/function_call' WHEN 'result' THEN 'response_item/function_call_output'
  WHEN 'msg' THEN 'response_item/message' WHEN 'think' THEN 'response_item/reasoning' WHEN 'tools' THEN 'response_item/additional_tools' WHEN 'meta' THEN 'session_meta' WHEN 'start' THEN 'turn_context'
  ELSE CASE WHEN k%3=0 THEN 'event_msg/task_started' ELSE 'event_msg/unheard_of' END END AS raw_type,
 CASE w WHEN 'usage' THEN 'token_report' WHEN 'comp' THEN 'compacted' WHEN 'call' THEN 'tool_call' WHEN 'result' THEN CASE WHEN k%5=0 THEN 'oversized_tool_result' ELSE 'tool_result' END
  WHEN 'msg' THEN 'message' WHEN 'think' THEN 'reasoning' WHEN 'tools' THEN 'context_injection' WHEN 'meta' THEN 'context_injection' WHEN 'start' THEN 'turn_started'
  ELSE CASE WHEN k%3=0 THEN 'session_event' ELSE 'unrecognised' END END AS kind,
 CASE WHEN w='msg' THEN CASE WHEN k%5=1 THEN 'user' ELSE 'assistant' END END AS role, CASE WHEN w='msg' THEN 'p'||CAST(k AS VARCHAR) END AS preview,
 CASE w WHEN 'call' THEN length('{"command":["run","f0.py"],"pad":""}')+size WHEN 'result' THEN CASE WHEN k%5=0 THEN length('[{"type":"input_image","image_url":},{"type":"input_text","text":"t"}]')+length(CAST(k AS VARCHAR)) ELSE size END
  WHEN 'msg' THEN size+1+length(CAST(k AS VARCHAR)) WHEN 'think' THEN size+CASE WHEN k%2=0 THEN 10 ELSE 0 END WHEN 'tools' THEN length('[{"name":""}]')+size WHEN 'meta' THEN size END AS char_len,
 CASE WHEN w='call' THEN 'shell' END AS tool, CASE WHEN w IN ('call','result') THEN 'c'||CAST(k%20 AS VARCHAR) END AS call_id, CASE WHEN w='call' THEN 'run f'||CAST(k%6 AS VARCHAR)||'.py' END AS target,
 CASE WHEN w='result' AND k%5<>0 THEN k%2=0 END AS is_error, CASE WHEN w='result' AND k%5=0 THEN 1 END AS image_count, CASE WHEN w='result' AND k%5=0 THEN length('data:image/png;base64,')+size END AS image_payload_chars,
 CASE w WHEN 'tools' THEN 'additional_tools' WHEN 'meta' THEN 'base_instructions' END AS mechanism, CASE WHEN w='start' AND k%4<>0 THEN 'model-'||CAST(k%3 AS VARCHAR) END AS model FROM ll""",
    ),
)
def ingest_linear_events(spark, sf_dir):
    return linear_parsed(spark, sf_dir).select(
        "session_id", "seq", "ts", "raw_type", "kind", "role", "preview", "char_len", "tool", "call_id", "target", "is_error",
        "image_count", "image_payload_chars", "mechanism", "model",
    )


@query(
    "ingest_linear_usage",
    q(
        LL,
        """SELECT session_id, seq, CASE WHEN k%17<>0 THEN big-CASE WHEN k%7<>0 AND k*900<=big THEN k*900 ELSE 0 END END AS input,
 CASE WHEN k%17<>0 AND k%7<>0 AND k*900<=big THEN k*900 END AS cache_read, k*7+1 AS output, k%5 AS reasoning, CASE WHEN k%3<>0 THEN 250000+k*1000 END AS context_window FROM ll WHERE w='usage'""",
    ),
)
def ingest_linear_usage(spark, sf_dir):
    """Per-request figures, never the running total; a cached part above its whole is dropped."""
    return (
        linear_parsed(spark, sf_dir)
        .where(F.col("kind") == "token_report")
        .select("session_id", "seq", "usage.input", "usage.cache_read", "usage.output", "usage.reasoning", "usage.context_window")
    )


@query(
    "ingest_compaction_facts",
    q(LL, "SELECT session_id, seq, k%2=0 AS replacement_recorded FROM ll WHERE w='comp'"),
)
def ingest_compaction_facts(spark, sf_dir):
    return (
        linear_parsed(spark, sf_dir)
        .where(F.col("kind") == "compacted")
        .select("session_id", "seq", "compaction.replacement_recorded")
    )


@query(
    "ingest_fingerprints",
    q(
        LL,
        """SELECT session_id, seq, sha256(CASE w WHEN 'msg' THEN 'p'||CAST(k AS VARCHAR)||repeat('x',size) WHEN 'meta' THEN repeat('x',size)
  WHEN 'think' THEN '{"summary":[{"text":"'||repeat('x',size)||'","type":"summary_text"}]'||CASE WHEN k%2=0 THEN ',"encrypted_content":"yyyyyyyyyy"' ELSE '' END||'}'
  WHEN 'result' THEN repeat('x',size) END) AS fp FROM ll WHERE w IN ('msg','think') OR (w='meta' AND size>0) OR (w='result' AND k%5<>0 AND size>0)""",
    ),
)
def ingest_fingerprints(spark, sf_dir):
    from tokenloom.functions.content import fingerprint

    wanted = F.col("kind").isin("message", "reasoning", "tool_result") | (F.col("mechanism") == "base_instructions")
    return (
        linear_parsed(spark, sf_dir)
        .where(wanted & F.col("content").isNotNull())
        .select("session_id", "seq", fingerprint(F.col("content")).alias("fp"))
    )
