"""Content measures, repeats, instructions, transcripts and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tokenloom import bridge
from tokenloom.catalog import lake
from tokenloom.catalog.context import peak_items
from tokenloom.catalog.corpus import facts
from tokenloom.catalog.ingest import LL, linear_parsed
from tokenloom.catalog.lake import r6
from tokenloom.catalog.registry import query
from tokenloom.catalog.sql import CITEMS, EVT, q
from tokenloom.functions import content
from tokenloom.functions.usage import estimate_tokens
from tokenloom.operators import composition as comp
from tokenloom.operators import instructions, transcript
from tokenloom.plans.skew import top_k_per_group
from tokenloom.schema import SESSION
from tokenloom.session import ensure_checkpoint_dir
from tokenloom.sinks import archive, export, feed

# --- documents as items: language = session, source = turn -------------------

DOCS = """
d0 AS (SELECT lang AS session_id, CAST(substr(source,4) AS BIGINT)+1 AS turn, doc_id AS seq, text, CAST(ceil(length(text)/CAST(3.6 AS DOUBLE)) AS BIGINT) AS tokens,
   CASE WHEN doc_id%13<>0 THEN sha256(text) END AS fp, strlen(text) AS bytes FROM documents),
dt AS (SELECT session_id, turn, CAST(sum(tokens) AS BIGINT) AS total FROM d0 GROUP BY ALL),
dg AS (SELECT d.session_id, d.turn, d.fp, count(*) AS copies, CAST(sum(tokens) AS BIGINT) AS total_tokens, arg_min(tokens, seq) AS first_tokens, min(seq) AS first_seq, max(t.total) AS total
   FROM d0 d JOIN dt t ON t.session_id=d.session_id AND t.turn=d.turn WHERE fp IS NOT NULL GROUP BY d.session_id, d.turn, d.fp HAVING count(*)>1)
"""


@lake.table
def document_measures(spark, sf_dir):
    return content.measure(bridge.read_spread(spark, sf_dir, "documents"), "text")


@lake.table
def document_items(spark, sf_dir):
    docs = bridge.read(spark, sf_dir, "documents").select(
        F.lit("claude-code").alias("agent"),
        F.col("lang").alias("session_id"),
        (F.substring("source", 4, 10).cast("bigint") + 1).alias("turn"),
        F.col("doc_id").alias("seq"),
        F.concat(F.lit("claude:"), F.col("doc_id").cast("string")).alias("item_id"),
        F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("label"),
        estimate_tokens(F.length("text"), 3.6).alias("tokens"),
        F.when(F.col("doc_id") % 13 != 0, content.fingerprint(F.col("text"))).alias("fp"),
        F.lit("estimated").alias("confidence"),
    )
    return docs.join(document_measures(spark, sf_dir), "fp", "left")


def document_snaps(spark, sf_dir):
    return document_items(spark, sf_dir).groupBy(*SESSION, "turn").agg(F.sum("tokens").alias("total"))


@query("content_measures", "SELECT sha256(text) AS fp, max(strlen(text)) AS original_bytes FROM documents WHERE text<>'' GROUP BY 1")
def content_measures(spark, sf_dir):
    return document_measures(spark, sf_dir).select("fp", "original_bytes")


@query("content_compressed_sizes")
def content_compressed_sizes(spark, sf_dir):
    """DEFLATE sizes; SQL has no DEFLATE, the tests compare with zlib."""
    return document_measures(spark, sf_dir)


@query(
    "canonical_json_identity",
    """SELECT event_id, '{"a":'||CAST(event_id%3 AS VARCHAR)||',"k":'||(props->>'$.k')||',"t":"'||event_type||'"}' AS canonical FROM events""",
)
def canonical_json_identity(spark, sf_dir):
    raw = F.concat(
        F.lit('{ "t" : "'), F.col("event_type"), F.lit('", "k": '), F.get_json_object("props", "$.k"), F.lit(', "a": '),
        (F.col("event_id") % 3).cast("string"), F.lit("}"),
    )
    return bridge.read(spark, sf_dir, "events").select("event_id", content.canonical_json(raw).alias("canonical"))


@query(
    "duplicate_groups",
    q(DOCS, "SELECT session_id, turn, fp, copies, total_tokens, total_tokens-first_tokens AS repeated_tokens, 'claude:'||CAST(first_seq AS VARCHAR) AS first_item, round(total_tokens*1.0/total,6) AS share FROM dg"),
)
def duplicate_groups(spark, sf_dir):
    groups = comp.duplicate_groups(document_items(spark, sf_dir), document_snaps(spark, sf_dir))
    return groups.select("session_id", "turn", "fp", "copies", "total_tokens", "repeated_tokens", "first_item", r6("share"))


@query("duplicate_members", q(DOCS, "SELECT d.session_id, d.turn, 'claude:'||CAST(d.seq AS VARCHAR) AS item_id FROM d0 d JOIN dg g ON g.session_id=d.session_id AND g.turn=d.turn AND g.fp=d.fp"))
def duplicate_members(spark, sf_dir):
    items = document_items(spark, sf_dir)
    groups = comp.duplicate_groups(items, document_snaps(spark, sf_dir))
    return comp.duplicate_members(items, groups).select("session_id", "turn", "item_id")


@query("unmeasured_items", q(DOCS, "SELECT session_id, turn, count(*) FILTER (WHERE fp IS NULL) AS unmeasured_items FROM d0 GROUP BY 1,2"))
def unmeasured_items(spark, sf_dir):
    return comp.unmeasured_items(document_items(spark, sf_dir)).drop("agent")


# Sizes taken from the table instead of DEFLATE, so that the rule itself has an oracle.
SIZED = (
    DOCS
    + """,
sz AS (SELECT d.*, 'claude:'||CAST(seq AS VARCHAR) AS item_id, bytes*(seq%97+3)//100 AS packed FROM d0 d),
low AS (SELECT s.*, packed*1.0/bytes AS ratio, CAST(round(s.tokens*greatest(0, 1-packed*1.0/bytes)) AS BIGINT) AS waste, t.total
   FROM sz s JOIN dt t ON t.session_id=s.session_id AND t.turn=s.turn WHERE bytes>=4096 AND packed*1.0/bytes<=0.75)
"""
)


@lake.table
def sized_items(spark, sf_dir):
    sizes = bridge.read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"), F.octet_length("text").cast("bigint").alias("original_bytes")
    )
    items = document_items(spark, sf_dir).drop("original_bytes", "compressed_bytes").join(sizes, "seq")
    return items.withColumn("compressed_bytes", F.floor(F.col("original_bytes") * (F.col("seq") % 97 + 3) / 100))


@query(
    "low_information_given_sizes",
    q(SIZED, "SELECT session_id, turn, item_id, tokens, round(ratio,6) AS compression_ratio, waste AS waste_score_tokens, round(tokens*1.0/total,6) AS share FROM low"),
)
def low_information_given_sizes(spark, sf_dir):
    out = comp.low_information(sized_items(spark, sf_dir), document_snaps(spark, sf_dir))
    return out.select("session_id", "turn", "item_id", "tokens", r6("compression_ratio"), "waste_score_tokens", r6("share"))


@query("low_information_items")
def low_information_items(spark, sf_dir):
    """Needs DEFLATE sizes; compared with zlib in the tests."""
    out = comp.low_information(document_items(spark, sf_dir), document_snaps(spark, sf_dir))
    return out.select("session_id", "turn", "item_id", "tokens", r6("compression_ratio"), "waste_score_tokens", r6("share"))


@query(
    "doctor_duplicates",
    q(
        DOCS,
        """SELECT session_id, turn, CAST(sum(copies) AS BIGINT) AS copies_in_top, CAST(sum(total_tokens-first_tokens) AS BIGINT) AS repeated_in_top, max(n) AS duplicate_groups, CAST(max(r) AS BIGINT) AS repeated_tokens FROM (
 SELECT *, row_number() OVER (PARTITION BY session_id, turn ORDER BY total_tokens DESC, copies DESC, 'claude:'||CAST(first_seq AS VARCHAR)) AS rn, count(*) OVER (PARTITION BY session_id, turn) AS n, sum(total_tokens-first_tokens) OVER (PARTITION BY session_id, turn) AS r FROM dg)
 WHERE rn<=8 GROUP BY 1,2""",
    ),
)
def doctor_duplicates(spark, sf_dir):
    """The doctor panel's duplicate section of every turn: totals and the top eight groups."""
    groups = comp.duplicate_groups(document_items(spark, sf_dir), document_snaps(spark, sf_dir))
    keys = ["session_id", "turn"]
    totals = groups.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("duplicate_groups"), F.sum("repeated_tokens").alias("repeated_tokens")
    )
    top = top_k_per_group(
        groups, keys, [F.col("total_tokens").desc(), F.col("copies").desc(), F.col("first_item")], 8, spread=F.col("fp")
    )
    shown = top.groupBy(*keys).agg(
        F.sum("copies").alias("copies_in_top"), F.sum("repeated_tokens").alias("repeated_in_top")
    )
    return totals.join(shown, keys)


@query(
    "doctor_panel",
    q(
        SIZED,
        """SELECT i.session_id, i.turn, i.unmeasured_items, coalesce(g.n,0) AS duplicate_groups, coalesce(g.r,0) AS repeated_tokens, coalesce(l.n,0) AS low_information_items, coalesce(l.w,0) AS waste_score_tokens
 FROM (SELECT session_id, turn, count(*) FILTER (WHERE fp IS NULL) AS unmeasured_items FROM d0 GROUP BY 1,2) i
 LEFT JOIN (SELECT session_id, turn, count(*) AS n, CAST(sum(total_tokens-first_tokens) AS BIGINT) AS r FROM dg GROUP BY 1,2) g ON g.session_id=i.session_id AND g.turn=i.turn
 LEFT JOIN (SELECT session_id, turn, count(*) AS n, CAST(sum(waste) AS BIGINT) AS w FROM low GROUP BY 1,2) l ON l.session_id=i.session_id AND l.turn=i.turn""",
    ),
)
def doctor_panel(spark, sf_dir):
    """The figures of the panel for every turn; sizes as the table gives them."""
    return comp.diagnosis(sized_items(spark, sf_dir), document_snaps(spark, sf_dir)).drop("agent")


@query(
    "doctor_low_information",
    q(
        SIZED,
        "SELECT session_id, turn, item_id, waste AS waste_score_tokens FROM (SELECT *, row_number() OVER (PARTITION BY session_id, turn ORDER BY waste DESC, seq) AS rn FROM low) WHERE rn<=8",
    ),
)
def doctor_low_information(spark, sf_dir):
    """The panel's eight worst items of every turn."""
    worst = comp.worst_items(sized_items(spark, sf_dir), document_snaps(spark, sf_dir))
    return worst.select("session_id", "turn", "item_id", "waste_score_tokens")


@query(
    "exact_recount_coverage",
    """SELECT CASE WHEN role='system' THEN 'opaque' WHEN turn=0 THEN 'unavailable' ELSE 'counted' END AS status, count(*) AS items, CAST(sum(CASE WHEN role<>'system' AND turn<>0 THEN len(string_split(text,' ')) END) AS BIGINT) AS tokens FROM conversations GROUP BY 1""",
)
def exact_recount_coverage(spark, sf_dir):
    """Recount with a caller's tokenizer: here one token per space-separated piece."""
    from tokenloom.operators.recount import recount, recount_coverage

    rows = bridge.read(spark, sf_dir, "conversations").select(
        F.col("role"),
        F.when(F.col("turn") != 0, F.col("text")).alias("content"),
        (F.col("role") == "system").alias("opaque"),
        F.length("text").cast("bigint").alias("raw_tokens"),
        F.lit("estimated").alias("size_kind"),
    )
    counted = recount(rows, lambda text: F.size(F.split(text, " ")).cast("bigint"))
    return recount_coverage(counted)


# --- instructions ------------------------------------------------------------


@query(
    "instruction_drift",
    q(
        EVT,
        """SELECT session_id, mechanism, label, p_turn AS from_turn, turn AS to_turn, p_len AS from_char_len, char_len AS to_char_len, seq FROM (SELECT *, lag(turn) OVER w AS p_turn, lag(char_len) OVER w AS p_len, lag(seq) OVER w AS p_seq FROM evt
 WHERE kind='context_injection' AND mechanism IN ('base_instructions','nested_memory','skill','dynamic_skill') WINDOW w AS (PARTITION BY session_id, mechanism, label ORDER BY seq)) WHERE p_seq IS NOT NULL AND p_len<>char_len""",
    ),
)
def instruction_drift(spark, sf_dir):
    return instructions.instruction_drift(lake.linear_events(spark, sf_dir)).drop("agent")


@query(
    "instruction_file_status",
    """SELECT doc_id AS line_no, CASE WHEN doc_id%17=0 THEN 'recordedBodyUnavailable' WHEN doc_id%11=0 THEN 'unsafePath' WHEN doc_id%7=0 THEN 'missing' WHEN doc_id%19=0 THEN 'notRegular' WHEN doc_id%23=0 THEN 'tooLarge' WHEN doc_id%29=0 THEN 'unreadable'
 WHEN doc_id%5=0 THEN 'changed' ELSE 'matching' END AS status, CASE WHEN doc_id%11=0 THEN 'C:con/x' ELSE '/repo/d/'||CAST(doc_id AS VARCHAR)||'.md' END AS path FROM documents""",
)
def instruction_file_status(spark, sf_dir):
    docs = bridge.read(spark, sf_dir, "documents")
    d = F.col("doc_id")
    name = F.concat(d.cast("string"), F.lit(".md"))
    recorded = docs.select(
        F.lit("claude-code").alias("agent"),
        F.col("lang").alias("session_id"),
        d.alias("line_no"),
        F.lit(1).alias("turn"),
        F.when(d % 11 == 0, "C:con/x").when(d % 2 == 0, F.concat(F.lit("d/"), name)).otherwise(F.concat(F.lit("/repo/d/"), name)).alias("label"),
        F.when(d % 17 != 0, F.sha2("text", 256)).alias("fp"),
        F.length("text").cast("bigint").alias("char_len"),
        F.lit("/repo").alias("root"),
    )
    files = docs.where(d % 7 != 0).select(
        F.concat(F.lit("/repo/d/"), name).alias("path"),
        (d % 19 != 0).alias("regular"),
        F.when(d % 23 == 0, 5 * 1024 * 1024).otherwise(F.octet_length("text")).alias("bytes"),
        F.when(d % 29 != 0, F.sha2(F.when(d % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256)).alias("digest"),
        F.length("text").cast("bigint").alias("chars"),
    )
    return instructions.compare_files(recorded, files, max_bytes=4 * 1024 * 1024).select("line_no", "status", "path")


@query(
    "instruction_files_read",
    """SELECT CAST(conv_id AS VARCHAR) AS folder, TRUE AS regular, CAST(strlen(body) AS BIGINT) AS bytes, sha256(body) AS digest, length(body) AS chars
 FROM (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn)||chr(10) AS body FROM conversations GROUP BY 1)""",
)
def instruction_files_read(spark, sf_dir):
    """Every conversation written as a file of the shared folder; size and digest of the files."""
    root = f"{ensure_checkpoint_dir(spark)}/notes-{uuid.uuid4().hex}"
    (
        bridge.read(spark, sf_dir, "conversations")
        .select(F.col("conv_id").alias("conv"), "turn", F.col("text").alias("value"))
        .repartition("conv")
        .sortWithinPartitions("conv", "turn")
        .select("conv", "value")
        .write.partitionBy("conv")
        .text(root, lineSep="\n")
    )
    files = instructions.read_instruction_files(spark, root, glob="*.txt")
    return files.select(F.regexp_extract("path", "conv=([^/]+)", 1).alias("folder"), "regular", "bytes", "digest", "chars")


# --- transcripts -------------------------------------------------------------


@query(
    "transcript_page",
    q(
        EVT,
        """,
vis AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq)-1 AS idx FROM evt WHERE occ OR kind='compacted')
SELECT session_id, idx AS index, line_no, turn, CASE WHEN kind='message' THEN role WHEN kind='reasoning' THEN 'reasoning' WHEN kind='tool_call' THEN 'toolCall' WHEN kind='tool_result' THEN 'toolResult' WHEN kind='compacted' THEN 'compaction' ELSE 'injection' END AS entry_kind,
 CASE WHEN kind='reasoning' THEN CASE WHEN redacted THEN 'recorded without its text' END WHEN kind='tool_call' THEN tool||CASE WHEN target IS NULL THEN '' ELSE ' · '||target END WHEN kind='tool_result' THEN 'call '||call_id WHEN kind='context_injection' THEN label WHEN kind='compacted' THEN trig END AS entry_label,
 coalesce(preview,'') AS text, TRUE AS unavailable, coalesce(is_error,FALSE) AS error FROM vis WHERE idx BETWEEN 10 AND 19""",
    ),
)
def transcript_page(spark, sf_dir):
    numbered = transcript.visible(lake.linear_events(spark, sf_dir)).withColumn("text", F.lit(None).cast("string"))
    return transcript.page(numbered, 10, 10).drop("agent", "truncated")


@query(
    "transcript_page_texts",
    q(
        LL,
        """,
lf AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq)-1 AS idx, repeat('x',CAST(size AS INTEGER)) AS f FROM ll WHERE w IN ('comp','call','result','msg','think','tools','meta')),
lx AS (SELECT *, CASE w WHEN 'comp' THEN 'm' WHEN 'call' THEN '{"command":["run","f'||CAST(k%6 AS VARCHAR)||'.py"],"pad":"'||f||'"}' WHEN 'msg' THEN 'p'||CAST(k AS VARCHAR)||chr(10)||f
  WHEN 'meta' THEN f WHEN 'think' THEN nullif(f||CASE WHEN k%2=0 THEN chr(10)||'[encrypted reasoning]' ELSE '' END,'') WHEN 'result' THEN CASE WHEN k%5=0 THEN '[inline image]'||chr(10)||'t'||CAST(k AS VARCHAR) ELSE nullif(f,'') END END AS text FROM lf WHERE idx BETWEEN 10 AND 19)
SELECT session_id, idx AS index, CASE WHEN length(text)>2000 THEN left(text,2000)||'…' ELSE coalesce(text,'') END AS text, coalesce(length(text)>2000,FALSE) AS truncated, text IS NULL AS unavailable,
  CASE WHEN w='msg' THEN 'p'||CAST(k AS VARCHAR)||'/'||CASE WHEN size>1000 THEN left(f,1000)||'…' ELSE f END END AS part_texts,
  CASE WHEN w='msg' THEN 1+length(CAST(k AS VARCHAR))+size END AS part_chars, w='msg' AND size>1000 AS part_truncated FROM lx""",
    ),
)
def transcript_page_texts(spark, sf_dir):
    """Entries 10 to 19 of every log with their texts; a message's two blocks share the budget."""
    keys = ["session_id", "seq"]
    texts = bridge.linear_lines(spark, sf_dir).select(
        "session_id",
        (F.col("line_no") - 1).alias("seq"),
        transcript.linear_text(F.col("raw")).alias("text"),
        transcript.linear_block_roles(F.col("raw")).alias("blocks"),
    )
    events = linear_parsed(spark, sf_dir).drop("content").withColumn("turn", F.lit(None).cast("bigint"))
    # Number first: only the page's records are joined to their texts.
    shown = transcript.visible(events).where(F.col("index").between(10, 19))
    page = transcript.page(shown.join(texts, keys, "left"), 10, 10)
    parts = F.when(F.size("parts") > 0, F.col("parts"))
    return page.select(
        "session_id", "index", "text", "truncated", "unavailable",
        F.array_join(parts["text"], "/").alias("part_texts"),
        F.aggregate(parts["chars"], F.lit(0).cast("bigint"), lambda a, b: a + b).alias("part_chars"),
        F.exists(F.coalesce("parts", F.array()), lambda p: p["truncated"]).alias("part_truncated"),
    )


@query(
    "message_block_roles",
    """SELECT doc_id, n, CASE WHEN doc_id%4=0 THEN 'assistant' WHEN n=0 AND doc_id%3=0 THEN 'developer' ELSE 'user' END AS role, sha256(CASE WHEN n=0 AND doc_id%3=0 THEN '<environment_context>'||text ELSE text END) AS fp
 FROM (SELECT doc_id, 'a'||text AS text, unnest([0,1]) AS n FROM documents)""",
)
def message_block_roles(spark, sf_dir):
    """Two blocks a message: an injected first block is not the user's word."""
    d = F.col("doc_id")
    text = F.concat(F.lit("a"), F.col("text"))
    block = lambda t: F.struct(F.lit("input_text").alias("type"), t.alias("text"))
    first = F.when(d % 3 == 0, F.concat(F.lit("<environment_context>"), text)).otherwise(text)
    message = F.struct(
        F.lit("message").alias("type"),
        F.when(d % 4 == 0, "assistant").otherwise("user").alias("role"),
        F.array(block(first), block(text)).alias("content"),
    )
    raw = F.to_json(F.struct(F.lit("response_item").alias("type"), message.alias("payload")))
    docs = bridge.read_spread(spark, sf_dir, "documents")
    blocks = docs.select("doc_id", F.posexplode(transcript.linear_block_roles(raw)).alias("n", "b"))
    return blocks.select("doc_id", "n", "b.role", F.sha2("b.text", 256).alias("fp"))


@query(
    "transcript_text_graph",
    """
WITH c AS (SELECT *, conv_id%10=0 AND turn%3=2 AS broken, conv_id%10=5 AND turn%3=2 AS future, conv_id%5=1 AS thinks, turn%4=1 AS calls FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS session_id, turn+1 AS line_no, CASE WHEN broken OR future THEN NULL WHEN role='assistant' THEN CASE WHEN thinks THEN '[thinking, recorded without its text]' ELSE text END||
  CASE WHEN calls THEN chr(10)||'{"file_path":"src/a'||CAST(turn AS VARCHAR)||'.py","n":'||CAST(conv_id AS VARCHAR)||'}' WHEN thinks THEN '' ELSE chr(10)||'tail' END ELSE text END AS text FROM c
""",
)
def transcript_text_graph(spark, sf_dir):
    return bridge.graph_lines(spark, sf_dir).select(
        "session_id", "line_no", transcript.graph_text(F.col("raw")).alias("text")
    )


@lake.table
def linear_text_digests(spark, sf_dir):
    """One row a record, NULL without text; a filter on the text would move in front of the rows' dealing out."""
    text = transcript.linear_text(F.col("raw"))
    return bridge.linear_lines(spark, sf_dir).select((F.col("line_no") - 1).alias("event_id"), F.sha2(text, 256).alias("fp"))


@query(
    "transcript_text_linear",
    """
WITH l0 AS (SELECT *, CAST(props->>'$.k' AS BIGINT) AS k, CAST(round(value*10) AS BIGINT) AS size FROM events),
l AS (SELECT *, repeat('x',CAST(size AS INTEGER)) AS f, CASE event_type WHEN 'purchase' THEN 'usage' WHEN 'signup' THEN 'comp' WHEN 'click' THEN 'call' WHEN 'error' THEN CASE WHEN k%10=9 THEN 'notice' ELSE 'result' END
  ELSE CASE k%7 WHEN 1 THEN 'msg' WHEN 2 THEN 'msg' WHEN 3 THEN 'think' WHEN 5 THEN 'meta' ELSE 'other' END END AS w FROM l0)
SELECT event_id, sha256(CASE w WHEN 'comp' THEN 'm' WHEN 'call' THEN '{"command":["run","f'||CAST(k%6 AS VARCHAR)||'.py"],"pad":"'||f||'"}' WHEN 'msg' THEN 'p'||CAST(k AS VARCHAR)||chr(10)||f
  WHEN 'meta' THEN f WHEN 'think' THEN f||CASE WHEN k%2=0 THEN chr(10)||'[encrypted reasoning]' ELSE '' END WHEN 'result' THEN CASE WHEN k%5=0 THEN '[inline image]'||chr(10)||'t'||CAST(k AS VARCHAR) ELSE f END END) AS fp
FROM l WHERE w IN ('comp','call','msg','meta') OR (w='result' AND (k%5=0 OR size>0)) OR (w='think' AND (size>0 OR k%2=0))
""",
)
def transcript_text_linear(spark, sf_dir):
    return linear_text_digests(spark, sf_dir).where(F.col("fp").isNotNull())


@query(
    "event_timeline",
    q(EVT, "SELECT session_id, seq, line_no, kind, raw_type, turn, char_len, n FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n FROM evt) WHERE n<=60"),
)
def event_timeline(spark, sf_dir):
    return transcript.timeline(lake.linear_events(spark, sf_dir)).drop("agent")


@query(
    "session_card",
    q(
        EVT,
        """,
f AS (SELECT session_id, count(*) AS event_count, count(*) FILTER (WHERE kind='unrecognised') AS unrecognised_events, count(*) FILTER (WHERE kind='compacted' AND turn IS NULL) AS unplaced_compactions,
   arg_min(u_window, seq) FILTER (WHERE u_window IS NOT NULL) AS mw, arg_min(model, seq) FILTER (WHERE kind='turn_started' AND model IS NOT NULL) AS mm FROM evt GROUP BY 1),
t AS (SELECT session_id, count(*) AS turn_count, CAST(coalesce(sum(u_out),0) AS BIGINT) AS total_output_tokens, count(*) FILTER (WHERE model IS NULL) AS unattributed_model_turns FROM turns GROUP BY 1),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY prompt_tokens DESC, turn) AS rn FROM turns WHERE prompt_tokens IS NOT NULL) WHERE rn=1)
SELECT f.session_id, event_count, turn_count, total_output_tokens, p.turn AS peak_turn, p.prompt_tokens AS peak_prompt_tokens, coalesce(p.u_window, CASE WHEN p.model IS NULL OR p.model=f.mm THEN f.mw END) AS context_window,
 round(1.0-unrecognised_events*1.0/event_count,6) AS fidelity, unrecognised_events, unplaced_compactions, unattributed_model_turns FROM f JOIN t ON t.session_id=f.session_id LEFT JOIN p ON p.session_id=f.session_id""",
    ),
)
def session_card(spark, sf_dir):
    from tokenloom.operators.session_card import session_cards

    return session_cards(
        facts(spark, sf_dir), lake.linear_events(spark, sf_dir), lake.linear_turn_table(spark, sf_dir)
    ).withColumn("fidelity", r6("fidelity"))


# --- sinks -------------------------------------------------------------------


@query(
    "export_records",
    q(
        CITEMS,
        """SELECT session_id, turn, part, type, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS records FROM (
 SELECT session_id, turn, 1 AS part, 'turn' AS type, total AS tokens FROM csnap UNION ALL SELECT session_id, turn, 2, 'item', tokens FROM citems UNION ALL SELECT session_id, turn, 3, 'item', residual FROM csnap
 UNION ALL SELECT CAST(conv_id AS VARCHAR), 0, 0, 'session', NULL FROM conversations GROUP BY conv_id) GROUP BY ALL""",
    ),
)
def export_records(spark, sf_dir):
    items, snaps = peak_items(spark, sf_dir)
    log = lake.conversation_log(spark, sf_dir)
    sessions = log.groupBy(*SESSION).agg(
        F.max("turn").alias("turns"), F.count(F.lit(1)).alias("events")
    ).select(
        "*", F.lit("/logs/x").alias("path"), F.lit(None).cast("string").alias("project"), F.lit(None).cast("string").alias("model"),
        F.lit(1.0).alias("fidelity"),
    )
    records = export.export_records(sessions, snaps, items)
    value = lambda p: F.get_json_object("value", p)
    tokens = F.coalesce(value("$.tokens"), value("$.total_tokens")).cast("bigint")
    return records.groupBy("session_id", "turn", "part", value("$.type").alias("type")).agg(
        F.sum(tokens).alias("tokens"), F.count(F.lit(1)).alias("records")
    )


@lake.table
def archived_lines(spark, sf_dir):
    located = bridge.linear_lines(spark, sf_dir).withColumn("agent", F.lit("codex"))
    planted = F.when(
        F.col("line_no") % 25 == 0, F.concat(F.left("raw", F.length("raw") - 1), F.lit(',"api_key":"abcd1234efgh5678"}'))
    ).otherwise(F.col("raw"))
    return archive.copy_lines(located.withColumn("raw", planted))


@query(
    "archive_manifest",
    "SELECT CAST(user_id AS VARCHAR) AS session_id, count(*) AS records, count(*) FILTER (WHERE (event_id+1)%25=0) AS redacted_records, count(*) FILTER (WHERE (event_id+1)%25=0) AS redacted_values, CAST(count(*) FILTER (WHERE (event_id+1)%25=0)*(length('[REDACTED:environment-secret]')-16) AS BIGINT) AS grown_bytes, count(*) FILTER (WHERE (event_id+1)%25=0)=0 AS same_digest FROM events GROUP BY 1",
)
def archive_manifest(spark, sf_dir):
    entries = archive.manifest_entries(archived_lines(spark, sf_dir), "redacted", F.lit("2026-01-01").cast("timestamp"))
    return entries.select(
        "session_id", "records", "redacted_records", "redacted_values",
        (F.col("archived_bytes") - F.col("source_bytes")).alias("grown_bytes"),
        (F.col("source_digest") == F.col("archived_digest")).alias("same_digest"),
    )


def manifest(spark, sf_dir):
    """Manifest lines from orders: each order is one archiving of its customer's session."""
    o = bridge.read(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    line = F.to_json(
        F.struct(
            F.lit("codex").alias("agent"),
            F.col("o_custkey").cast("string").alias("session_id"),
            F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("archived_at"),
            F.sha1(key.cast("string")).alias("archived_digest"),
            F.sha1(F.concat(F.lit("s"), key.cast("string"))).alias("source_digest"),
        )
    )
    return o.select(key.alias("seq"), F.when(key % 7 == 0, F.left(line, F.lit(20))).otherwise(line).alias("value"))


MAN = """
m AS (SELECT CAST(o_custkey AS VARCHAR) AS session_id, o_orderkey AS seq, o_orderdate AS archived_at FROM orders WHERE o_orderkey%7<>0),
latest AS (SELECT session_id, max(seq) AS seq, arg_max(archived_at, seq) AS archived_at FROM m GROUP BY 1)
"""


@query("archive_latest_entries", q(MAN, "SELECT session_id, seq, archived_at FROM latest"))
def archive_latest_entries(spark, sf_dir):
    latest = archive.latest_entries(archive.read_manifest(manifest(spark, sf_dir)))
    return latest.select("session_id", "seq", "archived_at")


@query("archive_listing", q(MAN, "SELECT session_id, archived_at FROM latest ORDER BY archived_at DESC, session_id LIMIT 100"))
def archive_listing(spark, sf_dir):
    latest = archive.latest_entries(archive.read_manifest(manifest(spark, sf_dir)))
    return archive.list_archive(latest).limit(100).select("session_id", "archived_at")


@query(
    "archive_verification",
    q(
        MAN,
        """SELECT session_id, CASE WHEN seq%5=0 THEN 'archive-damaged' WHEN seq%3=0 THEN 'source-gone' WHEN seq%4=0 THEN 'source-changed' ELSE 'intact' END AS integrity, seq%5<>0 AS copy_is_sound, seq%5=0 OR (seq%3<>0 AND seq%4=0) AS rebuildable FROM latest""",
    ),
)
def archive_verification(spark, sf_dir):
    latest = archive.latest_entries(archive.read_manifest(manifest(spark, sf_dir)))
    stored = latest.select(*SESSION, F.when(F.col("seq") % 5 != 0, F.col("archived_digest")).otherwise("x").alias("digest"))
    source = latest.where(F.col("seq") % 3 != 0).select(
        *SESSION, F.when(F.col("seq") % 4 == 0, "y").otherwise(F.col("source_digest")).alias("digest")
    )
    return archive.verify(latest, stored, source).drop("agent")


def feed_records(spark, sf_dir):
    o = bridge.read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("detected_at"))


@query(
    "feed_retention",
    "SELECT o_orderkey AS id FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01' - INTERVAL 30 DAY ORDER BY o_orderkey DESC LIMIT 2000",
)
def feed_retention(spark, sf_dir):
    return feed.prune(feed_records(spark, sf_dir), F.lit("1998-06-01").cast("timestamp"), days=30, newest=2_000).select("id")


@query("feed_page", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey<500 ORDER BY 1 DESC LIMIT 50")
def feed_page(spark, sf_dir):
    return feed.feed_page(feed_records(spark, sf_dir), 500).select("id")


@query(
    "feed_marks",
    """
WITH r AS (SELECT o_orderkey AS id FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01' - INTERVAL 30 DAY ORDER BY o_orderkey DESC LIMIT 2000),
m AS (SELECT o_orderkey AS id, o_orderdate AS at, o_orderkey%2=0 AS dismiss FROM orders WHERE o_orderkey%3=0 AND o_orderkey%100<>0), a AS (SELECT o_orderkey AS up_to, o_orderdate AS at FROM orders WHERE o_orderkey%2500=0)
SELECT r.id, least((SELECT min(m.at) FROM m WHERE m.id=r.id AND NOT dismiss), (SELECT min(a.at) FROM a WHERE r.id<=a.up_to)) AS read_at, (SELECT min(m.at) FROM m WHERE m.id=r.id AND dismiss) AS dismissed_at FROM r
""",
)
def feed_marks(spark, sf_dir):
    o = bridge.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("timestamp").alias("at"))
    one = o.where((F.col("k") % 3 == 0) & (F.col("k") % 100 != 0)).select(
        F.col("k").alias("id"), F.lit(None).cast("bigint").alias("up_to_id"), F.when(F.col("k") % 2 == 0, "dismiss").otherwise("read").alias("action"), "at"
    )
    every = o.where(F.col("k") % 2500 == 0).select(
        F.lit(None).cast("bigint").alias("id"), F.col("k").alias("up_to_id"), F.lit("read").alias("action"), "at"
    )
    visible = feed.prune(feed_records(spark, sf_dir), F.lit("1998-06-01").cast("timestamp"), days=30, newest=2_000)
    return feed.with_state(visible, one.unionByName(every)).select("id", "read_at", "dismissed_at")
