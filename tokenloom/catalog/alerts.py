"""Alert rules in batch and as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tokenloom import bridge
from tokenloom.catalog import lake
from tokenloom.catalog.context import peak_items
from tokenloom.catalog.cost import priced
from tokenloom.catalog.content import SIZED, document_items, document_snaps, sized_items
from tokenloom.catalog.registry import query
from tokenloom.catalog.residual import STEPS, residual_points
from tokenloom.catalog.secrets import planted
from tokenloom.catalog.sql import CITEMS, EVT, REQ, priced_sql, q
from tokenloom.functions import secrets
from tokenloom.operators import alerts, composition as comp, cost, instructions, residual
from tokenloom.operators.reconstruct import name_results
from tokenloom.schema import SESSION
from tokenloom.session import ensure_checkpoint_dir
from tokenloom.sinks import feed
from tokenloom.streaming import monitor

S = alerts.AlertSettings(spike_tokens=150_000, cost_budget_micros=12_000)


@lake.table
def watched_events(spark, sf_dir):
    return name_results(lake.linear_events(spark, sf_dir))


@lake.table
def watched_turns(spark, sf_dir):
    """Turns with the window an alert uses: the turn's own, else the first one known by then."""
    turns = lake.linear_turn_table(spark, sf_dir).select(
        *SESSION, "turn", "prompt_tokens", "anchor_seq", F.col("usage.context_window").alias("own")
    )
    first = turns.where(F.col("own").isNotNull()).groupBy(*SESSION).agg(
        F.min_by("own", "turn").alias("first_window"), F.min("turn").alias("since")
    )
    return turns.join(first, SESSION, "left").select(
        *SESSION,
        "turn",
        "prompt_tokens",
        "anchor_seq",
        F.coalesce("own", F.when(F.col("since") <= F.col("turn"), F.col("first_window"))).alias("window"),
    )


PRESSURE = (
    EVT
    + """,
fw AS (SELECT session_id, arg_min(u_window, turn) AS w, min(turn) AS since FROM turns WHERE u_window IS NOT NULL GROUP BY 1),
um AS (SELECT t.session_id, t.turn, t.anchor_seq, t.prompt_tokens, t.prompt_tokens*1.0/coalesce(t.u_window, CASE WHEN f.since<=t.turn THEN f.w END) AS v, row_number() OVER (PARTITION BY t.session_id ORDER BY t.turn) AS i
   FROM turns t LEFT JOIN fw f ON f.session_id=t.session_id WHERE t.prompt_tokens IS NOT NULL AND coalesce(t.u_window, CASE WHEN f.since<=t.turn THEN f.w END)>0),
bands AS (WITH RECURSIVE b AS (
   SELECT session_id, i, turn, anchor_seq, prompt_tokens, 0 AS prev, CASE WHEN v>=0.9 THEN 2 WHEN v>=0.75 THEN 1 ELSE 0 END AS band FROM um WHERE i=1
   UNION ALL SELECT u.session_id, u.i, u.turn, u.anchor_seq, u.prompt_tokens, b.band, CASE WHEN u.v>=0.9 OR (b.band=2 AND u.v>=0.85) THEN 2 WHEN u.v>=0.75 OR (b.band=1 AND u.v>=0.7) THEN 1 ELSE 0 END
     FROM b JOIN um u ON u.session_id=b.session_id AND u.i=b.i+1) SELECT * FROM b),
calls AS (SELECT e.session_id, e.seq, c.tool, c.target FROM ev e ASOF JOIN (SELECT session_id, call_id, seq, tool, target FROM ev WHERE kind='tool_call' AND call_id IS NOT NULL) c
   ON c.session_id=e.session_id AND c.call_id=e.call_id AND e.seq>c.seq WHERE e.kind='tool_result'),
res AS (SELECT e.session_id, e.seq, e.line_no, e.turn, e.is_error, c.tool, CASE WHEN c.tool IS NULL THEN 'tool' ELSE c.tool||coalesce(chr(1)||c.target,'') END AS key, row_number() OVER (PARTITION BY e.session_id ORDER BY e.seq) AS n
   FROM evt e LEFT JOIN calls c ON c.session_id=e.session_id AND c.seq=e.seq WHERE e.kind='tool_result'),
isl AS (SELECT *, sum(CASE WHEN is_error AND NOT coalesce(pe AND pk=key, FALSE) THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY n) AS grp FROM (SELECT *, lag(is_error) OVER w AS pe, lag(key) OVER w AS pk FROM res WINDOW w AS (PARTITION BY session_id ORDER BY n))),
strk AS (SELECT *, row_number() OVER (PARTITION BY session_id, grp ORDER BY n) AS streak FROM isl WHERE is_error),
al AS (
 SELECT session_id, 'context_pressure' AS rule, CASE WHEN band=2 THEN 'critical' ELSE 'warning' END AS severity, turn, CAST(NULL AS BIGINT) AS line_no, anchor_seq AS seq, 'pressure:'||session_id||':'||CAST(turn AS VARCHAR) AS dedupe_key, prompt_tokens AS amount FROM bands WHERE band>prev
 UNION ALL SELECT session_id, 'prompt_spike', 'warning', turn, NULL, anchor_seq, 'spike:'||session_id||':'||CAST(turn AS VARCHAR), g FROM (SELECT session_id, turn, anchor_seq, prompt_tokens-lag(prompt_tokens) OVER (PARTITION BY session_id ORDER BY turn) AS g FROM turns) WHERE g>=150000
 UNION ALL SELECT session_id, 'tool_error_streak', 'warning', turn, line_no, seq, 'tool-errors:'||session_id||':'||CAST(seq AS VARCHAR)||':0', 3 FROM strk WHERE streak=3
 UNION ALL SELECT session_id, 'compaction', 'info', turn, line_no, seq, 'compaction:'||session_id||':'||CAST(line_no AS VARCHAR), CASE WHEN tok_before IS NOT NULL AND tok_after IS NOT NULL THEN greatest(tok_before-tok_after,0) END FROM evt WHERE kind='compacted'
 UNION ALL SELECT session_id, 'format_drift', 'warning', NULL, NULL, min(seq), 'format:codex:'||raw_type, count(*) FROM ev WHERE kind='unrecognised' GROUP BY session_id, raw_type)
"""
)


@query("alert_pressure_bands", q(PRESSURE, "SELECT session_id, turn, prev AS previous_band, band FROM bands"))
def alert_pressure_bands(spark, sf_dir):
    """Hysteresis from look-backs; the oracle folds turn by turn."""
    return alerts.pressure_bands(watched_turns(spark, sf_dir), S).select("session_id", "turn", "previous_band", "band")


@query(
    "alert_error_streaks",
    q(PRESSURE, "SELECT session_id, line_no, amount FROM al WHERE rule='tool_error_streak'"),
)
def alert_error_streaks(spark, sf_dir):
    return alerts.tool_error_streak(watched_events(spark, sf_dir), S).select("session_id", "line_no", "amount")


@query("alert_candidates", q(PRESSURE, "SELECT * FROM al"))
def alert_candidates(spark, sf_dir):
    out = alerts.evaluate(watched_events(spark, sf_dir), watched_turns(spark, sf_dir), S)
    return out.drop("agent", "detail")


KEYED = (
    PRESSURE
    + """,
fk AS (SELECT CASE WHEN rule='format_drift' THEN 'v2:codex:global:' ELSE 'v2:codex:'||CAST(strlen(session_id) AS VARCHAR)||':'||session_id||':' END||dedupe_key AS dedupe_key, rule, session_id, seq FROM al)
"""
)


@query("alert_feed_once", q(KEYED, "SELECT dedupe_key, max(rule) AS rule, count(*) AS candidates FROM fk GROUP BY 1"))
def alert_feed_once(spark, sf_dir):
    """Feed keys: format findings are shared by all sessions of an agent."""
    out = feed.qualify(alerts.evaluate(watched_events(spark, sf_dir), watched_turns(spark, sf_dir), S))
    return out.groupBy("dedupe_key").agg(F.max("rule").alias("rule"), F.count(F.lit(1)).alias("candidates"))


@query("alert_unseen", q(KEYED, "SELECT dedupe_key FROM fk WHERE rule<>'compaction' GROUP BY 1"))
def alert_unseen(spark, sf_dir):
    """Findings whose keys were written before stay out, even after the feed was cleared."""
    out = feed.qualify(alerts.evaluate(watched_events(spark, sf_dir), watched_turns(spark, sf_dir), S))
    seen = out.where(F.col("rule") == "compaction").select("dedupe_key")
    return feed.unseen(out, seen).select("dedupe_key")


@query("feed_numbering", q(KEYED, "SELECT row_number() OVER () AS id, 5 AS base FROM (SELECT DISTINCT dedupe_key FROM fk)"))
def feed_numbering(spark, sf_dir):
    """New records get consecutive ids."""
    out = feed.qualify(alerts.evaluate(watched_events(spark, sf_dir), watched_turns(spark, sf_dir), S))
    fresh = feed.unseen(out, out.limit(0))
    numbered = feed.number(fresh, 5, F.lit("2026-01-01").cast("timestamp"), False)
    return numbered.select((F.col("id") - 5).alias("id"), F.lit(5).alias("base"))


def polled_feed(spark, source, settings):
    """The feed after three polls over growing files."""
    root = f"{ensure_checkpoint_dir(spark)}/monitor-{uuid.uuid4().hex}"
    last = source.agg(F.max("seq").alias("m")).first()["m"]
    for part in range(3):
        lo, hi = last * part // 3, last * (part + 1) // 3
        chunk = source.where((F.col("seq") > lo) & (F.col("seq") <= hi) if part else F.col("seq") <= hi)
        chunk.write.mode("append").parquet(f"{root}/events")
        run = monitor.run_monitor(spark, f"{root}/events", f"{root}/feed", f"{root}/state", settings)
        run.awaitTermination()
        if run.exception():
            raise run.exception()
    return monitor.read_feed(spark, f"{root}/feed")


#: Rules that look into the prompt, the records' text or the prices.
DEEP = [
    "large_contributor", "secret_exposure", "duplicate_context", "low_entropy_content", "residual_step",
    "instruction_drift", "cost_budget",
]


@query(
    "stream_alert_feed",
    q(KEYED, "SELECT dedupe_key, max(rule) AS rule, min(seq) AS seq FROM fk GROUP BY 1"),
)
def stream_alert_feed(spark, sf_dir):
    """The rules over log records, polled three times; the oracle is the batch result."""
    source = monitor.monitor_input(bridge.log_events(spark, sf_dir))
    return polled_feed(spark, source, S.without(*DEEP)).groupBy("dedupe_key").agg(
        F.max("rule").alias("rule"), F.min("seq").alias("seq")
    )


WATCH = alerts.AlertSettings(
    spike_tokens=150_000, contributor_tokens=300, duplicate_tokens=200, low_entropy_tokens=150, cost_budget_micros=12_000
)


def priced_events(spark, sf_dir):
    """``events`` as a log with coarse sizes, contents named by size, planted credentials, sizes and prices."""
    k = bridge.read(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.get_json_object("props", "$.k").cast("bigint").alias("k")
    )
    log = bridge.log_events(spark, sf_dir).join(k, "seq")
    k, held = F.col("k"), F.col("char_len").isNotNull()
    size = (F.floor(F.col("char_len") / 500) * 500 + 500).cast("bigint")
    prices = F.array(*[(k * n + 1).cast("bigint") for n in (5, 3, 2, 1)])
    return log.withColumns(
        {
            "char_len": size,
            "fp": F.when(held & (k % 3 != 0), F.concat(F.lit("f"), size.cast("string"))),
            "original_bytes": size * 10,
            "compressed_bytes": F.floor(size * (k % 97 + 3) / 10),
            "secret_kinds": F.when(held & (k % 50 == 7), F.array(F.lit("aws-access-key-id"))),
            "secret_counts": F.when(held & (k % 50 == 7), F.array(1 + k % 3)),
            "micros": F.when(k % 31 != 0, k * 9),
            "current_micros": F.when(k % 31 != 0, prices),
        }
    )


WATCHED = (
    KEYED
    + """,
wi AS (SELECT e.*, CASE WHEN occ THEN char_len//500*500+500 END AS size FROM evt e),
it AS (SELECT *, CAST(ceil(CASE WHEN kind='compacted' THEN byte_len ELSE size END/CAST(3.8 AS DOUBLE)) AS BIGINT) AS raw,
         CASE WHEN kind='compacted' THEN 'codex:compaction:' ELSE 'codex:' END||CAST(line_no AS VARCHAR) AS item_id,
         CASE WHEN occ AND k%3<>0 THEN 'f'||CAST(size AS VARCHAR) END AS fp,
         CASE WHEN occ AND size*10>=4096 THEN CAST(size*(k%97+3)//10 AS DOUBLE)/(size*10) END AS ratio FROM wi WHERE occ OR kind='compacted'),
mb AS (SELECT t.turn AS t, t.prompt_tokens, i.* FROM turns t JOIN it i ON i.session_id=t.session_id AND i.seq<t.cutoff_seq
   AND CASE WHEN i.kind='compacted' THEN i.seq=t.comp_seq ELSE t.comp_seq IS NULL OR i.seq>t.comp_seq OR i.mechanism='base_instructions' END),
tk0 AS (SELECT *, CAST(sum(raw) OVER (PARTITION BY session_id, t) AS BIGINT) AS est FROM mb),
tk AS (SELECT *, CASE WHEN est>prompt_tokens THEN raw*prompt_tokens//est ELSE raw END AS tokens, coalesce(prompt_tokens, est) AS total FROM tk0),
big AS (SELECT *, row_number() OVER (PARTITION BY session_id, t ORDER BY tokens DESC, seq) AS rn FROM tk),
dup AS (SELECT session_id, t, fp, sum(tokens)-arg_min(tokens, seq) AS rep FROM tk WHERE fp IS NOT NULL GROUP BY ALL HAVING count(*)>1),
inj AS (SELECT *, lag(size) OVER w AS p_size FROM wi WHERE kind='context_injection' AND mechanism IN ('base_instructions','nested_memory','skill','dynamic_skill')
   WINDOW w AS (PARTITION BY session_id, mechanism, label ORDER BY seq)),
pay AS (SELECT session_id, turn, sum(CASE WHEN k%31<>0 THEN k*9 ELSE 0 END) OVER w AS obs, count(*) FILTER (WHERE k%31=0) OVER w AS unpriced, count(*) OVER w AS n,
   sum(k*5+1) OVER w AS c1, sum(k*3+1) OVER w AS c2, sum(k*2+1) OVER w AS c3, sum(k+1) OVER w AS c4 FROM turns WINDOW w AS (PARTITION BY session_id ORDER BY turn)),
owed AS (SELECT session_id, turn, obs + CASE WHEN unpriced=0 THEN 10*(c1//n+c2//n+c3//n+c4//n) ELSE 0 END AS cost FROM pay),
deep AS (
 SELECT session_id, 'large_contributor' AS rule, seq, 'contributor:'||session_id||':'||CAST(t AS VARCHAR)||':'||item_id AS dedupe_key, tokens AS amount FROM big WHERE rn<=20 AND (tokens>=300 OR tokens*1.0/greatest(total,1)>=0.25)
 UNION ALL SELECT session_id, 'duplicate_context', t, 'duplicate:'||session_id||':'||CAST(t AS VARCHAR)||':'||fp, rep FROM dup WHERE rep>=200
 UNION ALL SELECT session_id, 'low_entropy_content', seq, 'entropy:'||session_id||':'||CAST(t AS VARCHAR)||':'||item_id, CAST(round(tokens*greatest(0, 1-ratio)) AS BIGINT) FROM tk WHERE ratio<=0.75 AND round(tokens*greatest(0, 1-ratio))>=150
 UNION ALL SELECT session_id, 'secret_exposure', line_no, 'secret:'||session_id||':'||CAST(line_no AS VARCHAR)||':aws-access-key-id', 1+k%3 FROM wi WHERE occ AND k%50=7
 UNION ALL SELECT session_id, 'instruction_drift', seq, 'instructions:'||session_id||':'||mechanism||':'||CAST(turn AS VARCHAR), size-p_size FROM inj WHERE p_size<>size AND turn IS NOT NULL
 UNION ALL SELECT session_id, 'cost_budget', 0, 'cost:'||session_id||':12000', arg_min(cost, turn) FROM owed WHERE cost>=12000 GROUP BY session_id),
every AS (SELECT rule, seq, dedupe_key, amount FROM deep UNION ALL SELECT rule, seq, dedupe_key, amount FROM al WHERE rule<>'format_drift')
"""
)


@query(
    "stream_all_rules",
    q(WATCHED, "SELECT dedupe_key, max(rule) AS rule, min(seq) AS seq, arg_min(amount, seq) AS amount FROM every GROUP BY 1"),
)
def stream_all_rules(spark, sf_dir):
    """Ten rules in the stream, turn by turn; the oracle lists every prompt of every turn.

    Findings of drifting formats are one per agent, so the feed's first count of them depends on the polls;
    ``stream_alert_feed`` compares their keys.
    """
    found = polled_feed(spark, monitor.monitor_input(priced_events(spark, sf_dir)), WATCH.without("format_drift"))
    own = F.concat(F.lit("v2:codex:"), F.octet_length("session_id").cast("string"), F.lit(":"), F.col("session_id"), F.lit(":"))
    return found.select(F.substr("dedupe_key", F.length(own) + 1).alias("dedupe_key"), "rule", "seq", "amount")


# --- rules over prepared inputs ----------------------------------------------


@query(
    "alert_large_contributors",
    q(CITEMS, "SELECT session_id, turn, 'contributor:'||session_id||':'||CAST(turn AS VARCHAR)||':codex:'||CAST(line_no AS VARCHAR) AS dedupe_key, CAST(tokens AS BIGINT) AS amount FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY tokens DESC, seq) AS rn FROM citems) WHERE rn<=20 AND (tokens>=20000 OR tokens*1.0/greatest(total,1)>=0.25)"),
)
def alert_large_contributors(spark, sf_dir):
    top = comp.largest_contributors(*peak_items(spark, sf_dir), 20)
    return alerts.large_contributor(top, S).select("session_id", "turn", "dedupe_key", "amount")


@query(
    "alert_duplicate_context",
    """
WITH d AS (SELECT lang AS session_id, CAST(substr(source,4) AS BIGINT)+1 AS turn, doc_id, CAST(ceil(length(text)/CAST(3.6 AS DOUBLE)) AS BIGINT) AS tokens, sha256(text) AS fp FROM documents WHERE doc_id%13<>0)
SELECT session_id, turn, 'duplicate:'||session_id||':'||CAST(turn AS VARCHAR)||':'||fp AS dedupe_key, CAST(sum(tokens)-arg_min(tokens,doc_id) AS BIGINT) AS amount FROM d GROUP BY session_id, turn, fp HAVING count(*)>1 AND sum(tokens)-arg_min(tokens,doc_id)>=10
""",
)
def alert_duplicate_context(spark, sf_dir):
    groups = comp.duplicate_groups(document_items(spark, sf_dir), document_snaps(spark, sf_dir))
    low = alerts.AlertSettings(duplicate_tokens=10)
    return alerts.duplicate_context(groups, low).select("session_id", "turn", "dedupe_key", "amount")


@query("alert_low_entropy")
def alert_low_entropy(spark, sf_dir):
    """Depends on DEFLATE sizes, which SQL cannot compute."""
    found = comp.low_information(document_items(spark, sf_dir), document_snaps(spark, sf_dir))
    return alerts.low_entropy_content(found, alerts.AlertSettings(low_entropy_tokens=500)).select(
        "session_id", "turn", "dedupe_key", "amount", "detail"
    )


@query(
    "alert_low_entropy_given_sizes",
    q(
        SIZED,
        "SELECT session_id, turn, 'entropy:'||session_id||':'||CAST(turn AS VARCHAR)||':'||item_id AS dedupe_key, waste AS amount FROM low WHERE waste>=500",
    ),
)
def alert_low_entropy_given_sizes(spark, sf_dir):
    """The rule over sizes that the table gives."""
    found = comp.low_information(sized_items(spark, sf_dir), document_snaps(spark, sf_dir))
    return alerts.low_entropy_content(found, alerts.AlertSettings(low_entropy_tokens=500)).select(
        "session_id", "turn", "dedupe_key", "amount"
    )


@query(
    "alert_secret_exposure",
    r"""
WITH pl AS (SELECT doc_id, lang, text || CASE WHEN doc_id%50=0 THEN ' id AKIA'||upper(substr(md5(CAST(doc_id AS VARCHAR)),1,16))||' end' ELSE '' END AS text FROM documents)
SELECT doc_id AS line_no, 'critical' AS severity, 'secret:'||lang||':'||CAST(doc_id AS VARCHAR)||':aws-access-key-id' AS dedupe_key FROM pl WHERE regexp_matches(text,'\b(?:AKIA|ASIA)[0-9A-Z]{16}\b')
""",
)
def alert_secret_exposure(spark, sf_dir):
    langs = bridge.read(spark, sf_dir, "documents").select("doc_id", "lang")
    found = planted(spark, sf_dir).select("doc_id", F.explode(secrets.scan(F.col("text"))).alias("f")).join(langs, "doc_id")
    severity = F.create_map(*[F.lit(x) for pair in secrets.SEVERITY.items() for x in pair])
    shaped = found.where(F.col("f.kind") == "aws-access-key-id").select(
        F.lit("codex").alias("agent"), F.col("lang").alias("session_id"), F.col("doc_id").alias("line_no"), F.lit(1).alias("turn"),
        F.col("f.kind").alias("kind"), F.col("f.occurrences").alias("occurrences"), severity[F.col("f.kind")].alias("severity"),
    )
    return alerts.secret_exposure(shaped, S).select("line_no", "severity", "dedupe_key")


@query(
    "alert_residual_steps",
    q(STEPS, "SELECT session_id, kt AS turn, 'residual:'||session_id||':'||CAST(kt AS VARCHAR) AS dedupe_key, kg AS amount FROM fold WHERE abs(kg)>=5000"),
)
def alert_residual_steps(spark, sf_dir):
    steps = residual.residual_steps(residual_points(spark, sf_dir))
    return alerts.residual_step(steps, S).select("session_id", "turn", "dedupe_key", "amount")


@query(
    "alert_instruction_drift",
    q(
        EVT,
        """SELECT session_id, turn, 'instructions:'||session_id||':'||mechanism||':'||CAST(turn AS VARCHAR) AS dedupe_key, char_len-p_len AS amount FROM (SELECT *, lag(char_len) OVER w AS p_len, lag(seq) OVER w AS p_seq FROM evt
 WHERE kind='context_injection' AND mechanism IN ('base_instructions','nested_memory','skill','dynamic_skill') WINDOW w AS (PARTITION BY session_id, mechanism, label ORDER BY seq)) WHERE p_seq IS NOT NULL AND p_len<>char_len AND turn>3""",
    ),
)
def alert_instruction_drift(spark, sf_dir):
    changes = instructions.instruction_drift(lake.linear_events(spark, sf_dir))
    return alerts.instruction_change(changes, S, F.lit(3)).select("session_id", "turn", "dedupe_key", "amount")


@query(
    "alert_cost_budget",
    q(
        REQ + "," + priced_sql("p"),
        """SELECT agent, session_id, 'cost:'||session_id||':12000' AS dedupe_key, CAST(sum(ci+cread+cw+co) AS BIGINT) AS amount FROM p GROUP BY 1,2 HAVING sum(ci+cread+cw+co)>=12000""",
    ),
)
def alert_cost_budget(spark, sf_dir):
    costs = cost.session_costs(priced(spark, sf_dir)).select(
        *SESSION, F.col("total_micros").alias("observed_micros"), F.lit(None).cast("bigint").alias("projected_total_micros")
    )
    return alerts.cost_budget(costs, S).select("agent", "session_id", "dedupe_key", "amount")
