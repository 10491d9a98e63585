"""Derived columns, classification and the remaining small operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom import bridge
from tokenloom.catalog import lake
from tokenloom.catalog.lake import r6
from tokenloom.catalog.registry import query
from tokenloom.catalog.sessions import scanned_files
from tokenloom.catalog.sql import EV, EVT, GV, q
from tokenloom.functions import text, usage
from tokenloom.functions.content import image_chars, redacted_thinking_chars
from tokenloom.operators.reconstruct import classify, name_results
from tokenloom.operators.turns import occupies_context
from tokenloom.sources.pricing import check_overrides
from tokenloom.streaming.tail import advance, new_lines


@query(
    "usage_expressions",
    q(
        EV,
        """SELECT session_id, seq, p AS prompt_tokens, round(p*1.0/u_window,6) AS utilisation, p IS NOT NULL AS measured FROM (SELECT *, nullif(coalesce(u_input,0)+coalesce(u_read,0),0) AS p FROM ev WHERE kind='token_report')""",
    ),
)
def usage_expressions(spark, sf_dir):
    prompt = usage.prompt_tokens("usage")
    return (
        bridge.log_events(spark, sf_dir)
        .where(F.col("kind") == "token_report")
        .select(
            "session_id",
            "seq",
            prompt.alias("prompt_tokens"),
            r6(usage.utilisation(prompt, F.col("usage.context_window")), "utilisation"),
            prompt.isNotNull().alias("measured"),
        )
    )


@query(
    "confidence_expressions",
    """
WITH e AS (SELECT event_id, CASE event_id%4 WHEN 0 THEN 'observed' WHEN 1 THEN 'exact' WHEN 2 THEN 'calibrated' ELSE 'estimated' END AS size_kind, CASE event_id%3 WHEN 0 THEN 'observed' WHEN 1 THEN 'derived' ELSE 'estimated' END AS member FROM events)
SELECT event_id, CASE size_kind WHEN 'observed' THEN 'observed' WHEN 'exact' THEN 'derived' ELSE 'estimated' END AS confidence, size_kind IN ('observed','exact') AS trustworthy,
 CASE WHEN member='estimated' OR size_kind IN ('calibrated','estimated') THEN 'estimated' WHEN member='derived' OR size_kind='exact' THEN 'derived' ELSE 'observed' END AS weakest FROM e
""",
)
def confidence_expressions(spark, sf_dir):
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % n + 1).cast("int"))
    kind = pick(["observed", "exact", "calibrated", "estimated"], 4)
    member = pick(["observed", "derived", "estimated"], 3)
    return bridge.read(spark, sf_dir, "events").select(
        "event_id",
        usage.size_confidence(kind).alias("confidence"),
        usage.is_trustworthy(kind).alias("trustworthy"),
        usage.weakest(member, usage.size_confidence(kind)).alias("weakest"),
    )


@query(
    "size_estimates",
    """SELECT doc_id, CAST(ceil(length(text)/CAST(3.1 AS DOUBLE)) AS BIGINT) AS code, CAST(ceil(length(text)/CAST(3.6 AS DOUBLE)) AS BIGINT) AS prose, CAST(floor(length(text)/2.353) AS BIGINT) AS hidden_thinking, least(length(text),4000) AS as_image FROM documents""",
)
def size_estimates(spark, sf_dir):
    return bridge.read(spark, sf_dir, "documents").select(
        "doc_id",
        usage.estimate_tokens(F.length("text"), 3.1).alias("code"),
        usage.estimate_tokens(F.length("text"), 3.6).alias("prose"),
        redacted_thinking_chars(F.col("text")).alias("hidden_thinking"),
        image_chars(F.col("text")).alias("as_image"),
    )


@query(
    "text_labels",
    """SELECT page_id, CASE WHEN length(u)>40 THEN left(u,40)||'…' ELSE u END AS cut, regexp_extract(url,'([^/\\\\]*)$',1) AS short, starts_with(lower(url),'http://') AS plain_http, length(url)>0 AND contains(url,'://') AS unsafe
FROM (SELECT *, trim(regexp_replace(url||'  '||left(html,30),'\\s+',' ','g')) AS u FROM pages)""",
)
def text_labels(spark, sf_dir):
    args = F.to_json(F.struct(F.col("url").alias("path")))
    return bridge.read(spark, sf_dir, "pages").select(
        "page_id",
        text.truncate(text.collapse_whitespace(F.concat("url", F.lit("  "), F.left("html", F.lit(30)))), 40).alias("cut"),
        text.short_label(F.col("url")).alias("short"),
        text.path_has_prefix(F.col("url"), "HTTP:\\\\").alias("plain_http"),
        text.file_target(args).isNull().alias("unsafe"),
    )


@query(
    "tool_targets",
    """SELECT event_id, CASE event_id%4 WHEN 0 THEN 'src/'||event_type||'.py' WHEN 1 THEN 'run '||event_type WHEN 2 THEN CAST(event_id AS VARCHAR) END AS target, CASE WHEN event_id%4=0 THEN 'src/'||event_type||'.py' END AS file_path FROM events""",
)
def tool_targets(spark, sf_dir):
    e = F.col("event_id")
    args = (
        F.when(e % 4 == 0, F.concat(F.lit('{"command":"x","file_path":"src/'), F.col("event_type"), F.lit('.py"}')))
        .when(e % 4 == 1, F.concat(F.lit('{"command":["run","'), F.col("event_type"), F.lit('"],"prompt":"p"}')))
        .when(e % 4 == 2, F.concat(F.lit('{"other":true,"query":'), e.cast("string"), F.lit("}")))
        .otherwise('{"unknown":"y","path":{"nested":1}}')
    )
    return bridge.read(spark, sf_dir, "events").select(
        "event_id", text.target_label(args).alias("target"), F.when(e % 4 == 0, text.file_target(args)).alias("file_path")
    )


@query(
    "classify_linear",
    q(
        EV,
        """,
c AS (SELECT e.session_id, e.seq, c.tool, c.target FROM ev e ASOF JOIN (SELECT session_id, call_id, seq, tool, target FROM ev WHERE kind='tool_call' AND call_id IS NOT NULL) c ON c.session_id=e.session_id AND c.call_id=e.call_id AND e.seq>c.seq WHERE e.kind='tool_result')
SELECT e.session_id, e.seq, CASE kind WHEN 'message' THEN CASE WHEN role='user' THEN 'user-messages' ELSE 'assistant-messages' END WHEN 'reasoning' THEN 'reasoning' WHEN 'tool_call' THEN 'tool-calls' WHEN 'tool_result' THEN 'tool-outputs'
  ELSE CASE mechanism WHEN 'base_instructions' THEN 'system-instructions' WHEN 'context_compaction' THEN 'summaries' ELSE 'developer-instructions' END END AS category,
 CASE kind WHEN 'message' THEN CASE WHEN role='user' THEN 'user' ELSE 'model' END WHEN 'reasoning' THEN 'model' WHEN 'tool_call' THEN 'tool' WHEN 'tool_result' THEN 'tool' ELSE CASE WHEN mechanism='base_instructions' THEN 'system-prompt' ELSE 'harness' END END AS source_kind,
 CASE kind WHEN 'tool_call' THEN e.tool WHEN 'tool_result' THEN coalesce(c.tool, call_id, 'tool') WHEN 'context_injection' THEN CASE WHEN mechanism<>'base_instructions' THEN mechanism END END AS source_payload,
 CASE kind WHEN 'message' THEN CASE WHEN role='user' THEN 'User message: ' ELSE 'Assistant message: ' END||preview WHEN 'reasoning' THEN 'Reasoning' WHEN 'tool_call' THEN e.tool||coalesce(' '||e.target,'') WHEN 'tool_result' THEN coalesce(c.tool, call_id, 'tool')||coalesce(' '||c.target,'') ELSE label END AS label
FROM ev e LEFT JOIN c ON c.session_id=e.session_id AND c.seq=e.seq WHERE occ""",
    ),
)
def classify_linear(spark, sf_dir):
    named = classify(name_results(lake.linear_events(spark, sf_dir))).where(occupies_context())
    return named.select("session_id", "seq", "category", "source_kind", "source_payload", F.col("item_label").alias("label"))


@query(
    "classify_graph",
    q(
        GV,
        """SELECT session_id, seq, CASE kind WHEN 'message' THEN CASE WHEN asst THEN 'assistant-messages' ELSE 'user-messages' END WHEN 'tool_result' THEN 'tool-outputs' ELSE CASE WHEN k%2=0 THEN 'repository-instructions' ELSE 'developer-instructions' END END AS category,
 CASE kind WHEN 'message' THEN CASE WHEN asst THEN 'model' ELSE 'user' END WHEN 'tool_result' THEN 'tool' ELSE CASE WHEN k%2=0 THEN 'instruction-file' ELSE 'harness' END END AS source_kind,
 CASE kind WHEN 'tool_result' THEN 'c'||CAST(k%20 AS VARCHAR) WHEN 'context_injection' THEN CASE WHEN k%2=0 THEN 'l'||CAST(k%3 AS VARCHAR) ELSE 'skill_listing' END END AS source_payload FROM gv WHERE kind IN ('message','tool_result','context_injection')""",
    ),
)
def classify_graph(spark, sf_dir):
    named = classify(name_results(lake.graph_log(spark, sf_dir))).where(occupies_context())
    return named.select("session_id", "seq", "category", "source_kind", "source_payload")


@query(
    "preceding_compaction",
    q(EVT, "SELECT t.session_id, t.turn, c.line_no AS compaction_line, c.trig AS trigger FROM turns t JOIN ev c ON c.session_id=t.session_id AND c.seq=t.comp_seq"),
)
def preceding_compaction(spark, sf_dir):
    turns = lake.linear_turn_table(spark, sf_dir).where(F.col("comp_seq").isNotNull())
    comps = lake.linear_events(spark, sf_dir).where(F.col("kind") == "compacted").select(
        "session_id", F.col("seq").alias("comp_seq"), F.col("line_no").alias("compaction_line"), F.col("compaction.trigger").alias("trigger")
    )
    return turns.select("session_id", "turn", "comp_seq").join(comps, ["session_id", "comp_seq"]).drop("comp_seq")


@query(
    "contract_overrides_load",
    "SELECT lower('Prefix'||r_name) AS model_prefix, 1000+CAST(r_regionkey AS BIGINT) AS input_rate, 2000+CAST(r_regionkey AS BIGINT) AS output_rate FROM region",
)
def contract_overrides_load(spark, sf_dir):
    r = F.col("r_regionkey").cast("bigint")
    rate = F.struct(
        (1000 + r).alias("input_per_million"), (2000 + r).alias("output_per_million"),
        r.alias("cache_read_per_million"), r.alias("cache_write_per_million"),
    )
    entry = F.struct(F.concat(F.lit("  Prefix"), F.col("r_name"), F.lit(" ")).alias("model_prefix"), rate.alias("rate"))
    document = bridge.read(spark, sf_dir, "region").agg(F.collect_list(entry).alias("rates")).select(
        F.lit("v1").alias("version"), F.lit("contract").alias("source"), "rates"
    )
    return check_overrides(document).select("model_prefix", "input_rate", "output_rate")


@query(
    "tail_new_lines",
    """
WITH f0 AS (SELECT CAST(user_id%40 AS VARCHAR)||'-'||CAST(event_id//65536 AS VARCHAR) AS file, event_id AS n, CAST(props->>'$.k' AS BIGINT) AS k FROM events),
f1 AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n) AS line_no FROM f0)
SELECT file, n FROM f1 WHERE k%10<>0 AND line_no>10
""",
)
def tail_new_lines(spark, sf_dir):
    """Lines after the tenth of every file, given the offsets after ten lines."""
    table = scanned_files(spark, sf_dir)
    none = table.sparkSession.createDataFrame([], "path string, next_offset bigint, next_line bigint")
    offsets = advance(none, table.where(F.col("line_no") <= 10))
    return new_lines(table, offsets).select(
        F.regexp_extract("path", "file=([^/]+)", 1).alias("file"), F.get_json_object("raw", "$.n").cast("bigint").alias("n")
    )
