"""Comparisons of prompts and lifecycles of items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom import bridge
from tokenloom.catalog import lake
from tokenloom.catalog.graph import graph_base_table, graph_forest
from tokenloom.catalog.registry import query
from tokenloom.catalog.sql import CONV, EVT, GWALK, conv_items, q
from tokenloom.functions.usage import estimate_tokens
from tokenloom.operators import composition as comp
from tokenloom.operators import diff, lifecycle
from tokenloom.operators.calibrate import calibrate
from tokenloom.operators.chains import presence_changes
from tokenloom.operators.compaction_diff import compaction_diffs, multiset_match
from tokenloom.operators.reconstruct import linear_members, promote_current_prompt
from tokenloom.schema import SESSION
from tokenloom.session import stage

LEFT = diff.Instrument("heuristic:chars/3.6", 3.6)
RIGHT = diff.Instrument("heuristic:chars/3.8", 3.8)
SKEW = diff.comparability(LEFT, RIGHT).skew


def side(spark, sf_dir, first: bool, ratio: float):
    """Calibrated items of each conversation's first or last measured turn."""
    turns = lake.conversation_turns(spark, sf_dir).where(F.col("prompt_tokens").isNotNull())
    pick = (F.min if first else F.max)("turn").alias("turn")
    chosen = turns.join(turns.groupBy(*SESSION).agg(pick), [*SESSION, "turn"], "left_semi")
    items = promote_current_prompt(linear_members(lake.conversation_items(spark, sf_dir), chosen))
    items = items.withColumn("raw_tokens", estimate_tokens(F.col("char_len"), ratio)).withColumn(
        "size_kind", F.lit("estimated")
    )
    return calibrate(stage(items), stage(chosen))


@lake.table
def left_items(spark, sf_dir):
    return side(spark, sf_dir, True, 3.6)[0]


@lake.table
def left_snaps(spark, sf_dir):
    return side(spark, sf_dir, True, 3.6)[1]


@lake.table
def right_items(spark, sf_dir):
    return side(spark, sf_dir, False, 3.8)[0]


@lake.table
def right_snaps(spark, sf_dir):
    return side(spark, sf_dir, False, 3.8)[1]


SIDES = CONV + "," + conv_items("l", "turn", "3.6") + "," + conv_items("r", "turn DESC", "3.8")
BOUND = "CAST(ceil(greatest({0},{1})*abs(CAST(3.6 AS DOUBLE)/CAST(3.8 AS DOUBLE)-1)) AS BIGINT)"


@query(
    "diff_by_category",
    q(
        SIDES,
        f"""SELECT session_id, category, lt AS left_tokens, ln AS left_item_count, rt AS right_tokens, rn AS right_item_count, rt-lt AS delta, rn-ln AS item_delta,
 b AS instrument_bound, abs(rt-lt)>b AS meaningful FROM (SELECT d.*, CASE WHEN category='unattributed' THEN {BOUND.format("ls.accounted", "rs.accounted")} ELSE {BOUND.format("lt", "rt")} END AS b
 FROM (SELECT coalesce(l_c.session_id,r_c.session_id) AS session_id, coalesce(l_c.category,r_c.category) AS category, coalesce(l_c.tokens,0) AS lt, coalesce(l_c.n,0) AS ln,
   coalesce(r_c.tokens,0) AS rt, coalesce(r_c.n,0) AS rn FROM l_c FULL OUTER JOIN r_c ON l_c.session_id=r_c.session_id AND l_c.category=r_c.category) d
 JOIN l_s ls ON ls.session_id=d.session_id JOIN r_s rs ON rs.session_id=d.session_id)""",
    ),
)
def diff_by_category(spark, sf_dir):
    li, ls, ri, rs = (t(spark, sf_dir) for t in (left_items, left_snaps, right_items, right_snaps))
    return diff.category_delta(comp.by_category(li, ls), comp.by_category(ri, rs), ls, rs, SESSION, SKEW).drop("agent")


@query(
    "diff_by_item",
    q(
        SIDES,
        f"""SELECT session_id, item_id, change, category, lt AS left_tokens, rt AS right_tokens, rt-lt AS token_delta,
 coalesce(abs(rt-lt)>{BOUND.format("lt", "rt")}, FALSE) AS meaningful FROM (
 SELECT coalesce(l.session_id,r.session_id) AS session_id, 'codex:'||CAST(coalesce(l.line_no,r.line_no) AS VARCHAR) AS item_id,
  CASE WHEN l.seq IS NULL THEN 'gained' WHEN r.seq IS NULL THEN 'removed' ELSE 'retained' END AS change, coalesce(r.category,l.category) AS category, l.tokens AS lt, r.tokens AS rt
 FROM l FULL OUTER JOIN r ON l.session_id=r.session_id AND l.seq=r.seq)""",
    ),
)
def diff_by_item(spark, sf_dir):
    out = diff.item_delta(left_items(spark, sf_dir), right_items(spark, sf_dir), SESSION, SKEW)
    return out.drop("agent", "label", "confidence")


# --- tools: first and last turn of the event sessions ------------------------

TOOLS = (
    EVT
    + """,
pick AS (SELECT session_id, min(turn) AS a, max(turn) AS b FROM turns GROUP BY 1),
named AS (SELECT e.*, CASE WHEN kind='tool_result' THEN coalesce((SELECT c.tool FROM ev c WHERE c.session_id=e.session_id AND c.kind='tool_call' AND c.call_id=e.call_id AND c.seq<e.seq ORDER BY c.seq DESC LIMIT 1), e.call_id, 'tool') ELSE e.tool END AS tname
   FROM ev e WHERE kind IN ('tool_call','tool_result')),
held AS (SELECT t.session_id, t.turn=p.a AS is_l, t.turn=p.b AS is_r, n.tname, CAST(ceil(n.char_len/CAST(3.8 AS DOUBLE)) AS BIGINT) AS tokens FROM turns t JOIN pick p ON p.session_id=t.session_id AND t.turn IN (p.a,p.b)
   JOIN named n ON n.session_id=t.session_id AND n.seq<t.cutoff_seq AND (t.comp_seq IS NULL OR n.seq>t.comp_seq))
"""
)


@query(
    "diff_by_tool",
    q(
        TOOLS,
        """SELECT session_id, tname AS tool, count(*) FILTER (WHERE is_l) AS left_calls, CAST(coalesce(sum(tokens) FILTER (WHERE is_l),0) AS BIGINT) AS left_tokens,
 count(*) FILTER (WHERE is_r) AS right_calls, CAST(coalesce(sum(tokens) FILTER (WHERE is_r),0) AS BIGINT) AS right_tokens FROM held GROUP BY 1,2""",
    ),
)
def diff_by_tool(spark, sf_dir):
    turns = lake.linear_turn_table(spark, sf_dir)
    ends = turns.groupBy(*SESSION).agg(F.min("turn").alias("a"), F.max("turn").alias("b"))
    marked = turns.join(ends, SESSION)
    pool = lake.linear_items(spark, sf_dir).where(F.col("source_kind") == "tool")

    def sized(which):
        held = linear_members(pool, marked.where(F.col("turn") == F.col(which)))
        return held.withColumn("tokens", estimate_tokens(F.col("char_len"), 3.8))

    return diff.tool_delta(sized("a"), sized("b"), SESSION, 0.0).select(
        "session_id", "tool", "left_calls", "left_tokens", "right_calls", "right_tokens"
    )


# --- multiset match ----------------------------------------------------------


@query(
    "multiset_match_documents",
    """
WITH d AS (SELECT lang, CAST(substr(source,4) AS BIGINT)%2 AS h, doc_id AS idx, sha256(text) AS fp FROM documents),
a AS (SELECT *, row_number() OVER (PARTITION BY lang, fp ORDER BY idx) AS c FROM d WHERE h=0),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, fp ORDER BY idx) AS c FROM d WHERE h=1)
SELECT coalesce(a.lang,b.lang) AS lang, coalesce(a.fp,b.fp) AS fp, a.idx AS history_index, b.idx AS replacement_index,
 CASE WHEN a.idx IS NULL THEN 'added' WHEN b.idx IS NULL THEN 'dropped' ELSE 'preserved' END AS disposition
FROM a FULL OUTER JOIN b ON a.lang=b.lang AND a.fp=b.fp AND a.c=b.c
""",
)
def multiset_match_documents(spark, sf_dir):
    docs = bridge.read(spark, sf_dir, "documents").select(
        "lang",
        (F.substring("source", 4, 10).cast("bigint") % 2).alias("h"),
        F.col("doc_id").alias("idx"),
        F.sha2("text", 256).alias("fp"),
    )
    even, odd = docs.where("h = 0").drop("h"), docs.where("h = 1").drop("h")
    return multiset_match(even, odd, ["lang"])


COMPDIFF = (
    EVT
    + """,
comp AS (SELECT session_id, seq, k, CASE WHEN k%2=0 THEN NULL ELSE 'missing-replacement-history' END AS problem,
   lag(seq) OVER w AS prev_seq, lag(CASE WHEN k%2=0 THEN 0 ELSE 1 END) OVER w AS prev_bad FROM ev WHERE kind='compacted' WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
resp AS (SELECT session_id, seq, 'x'||CAST(char_len%12 AS VARCHAR) AS fp FROM ev WHERE occ),
stat AS (SELECT *, coalesce(problem, CASE WHEN prev_bad=1 THEN 'unknown-preceding-history' END) AS unavailable FROM comp),
repl AS (SELECT c.session_id, c.seq AS comp_seq, i AS idx, 'x'||CAST((c.k+i)%12 AS VARCHAR) AS fp FROM comp c CROSS JOIN range(6) r(i) WHERE c.problem IS NULL),
hist0 AS (SELECT s.session_id, s.seq AS comp_seq, 0 AS part, r.idx AS pos, r.fp FROM stat s JOIN repl r ON r.session_id=s.session_id AND r.comp_seq=s.prev_seq WHERE s.unavailable IS NULL
   UNION ALL SELECT s.session_id, s.seq, 1, r.seq, r.fp FROM stat s JOIN resp r ON r.session_id=s.session_id AND r.seq<s.seq AND r.seq>coalesce(s.prev_seq,-1) WHERE s.unavailable IS NULL),
hist AS (SELECT *, row_number() OVER (PARTITION BY session_id, comp_seq ORDER BY part, pos)-1 AS idx FROM hist0),
hn AS (SELECT *, row_number() OVER (PARTITION BY session_id, comp_seq, fp ORDER BY idx) AS c FROM hist),
rn AS (SELECT r.*, row_number() OVER (PARTITION BY r.session_id, r.comp_seq, r.fp ORDER BY r.idx) AS c FROM repl r JOIN stat s ON s.session_id=r.session_id AND s.seq=r.comp_seq AND s.unavailable IS NULL)
"""
)


@lake.table
def compaction_inputs(spark, sf_dir):
    """Compactions of the event sessions with a replacement derived from k."""
    events = lake.linear_events(spark, sf_dir).where(F.col("kind") == "compacted")
    k = F.floor(F.col("compaction.duration_ms") / 11).cast("bigint")
    ok = F.col("compaction.replacement_recorded")
    return events.select(
        *SESSION,
        "seq",
        F.when(~ok, "missing-replacement-history").alias("problem"),
        F.when(
            ok,
            F.transform(
                F.sequence(F.lit(0), F.lit(5)),
                lambda i: F.struct(F.concat(F.lit("x"), ((k + i) % 12).cast("string")).alias("fp")),
            ),
        ).alias("replacement"),
    )


def diffs(spark, sf_dir):
    responses = (
        lake.linear_events(spark, sf_dir)
        .where(F.col("char_len").isNotNull())
        .select(
            *SESSION,
            "seq",
            F.concat(F.lit("x"), (F.col("char_len") % 12).cast("string")).alias("fp"),
            F.lit(None).cast("string").alias("problem"),
        )
    )
    return compaction_diffs(responses, compaction_inputs(spark, sf_dir))


@query("compaction_status", q(COMPDIFF, "SELECT session_id, seq AS comp_seq, unavailable FROM stat"))
def compaction_status(spark, sf_dir):
    return diffs(spark, sf_dir)[0].drop("agent")


@query(
    "compaction_diff_items",
    q(
        COMPDIFF,
        """SELECT coalesce(h.session_id,r.session_id) AS session_id, coalesce(h.comp_seq,r.comp_seq) AS comp_seq, coalesce(h.fp,r.fp) AS fp, h.idx AS history_index, r.idx AS replacement_index,
 CASE WHEN h.idx IS NULL THEN 'added' WHEN r.idx IS NULL THEN 'dropped' ELSE 'preserved' END AS disposition
 FROM hn h FULL OUTER JOIN rn r ON h.session_id=r.session_id AND h.comp_seq=r.comp_seq AND h.fp=r.fp AND h.c=r.c""",
    ),
)
def compaction_diff_items(spark, sf_dir):
    return diffs(spark, sf_dir)[1].drop("agent")


# --- lifecycles --------------------------------------------------------------

LIFE = (
    GWALK
    + """,
scan AS (SELECT t.session_id, t.turn, a.side, TRUE AS readable, c.seq AS comp FROM gturns t JOIN gv a ON a.session_id=t.session_id AND a.seq=t.anchor_seq
   LEFT JOIN (SELECT session_id, turn, seq FROM walk WHERE kind='compacted') c ON c.session_id=t.session_id AND c.turn=t.turn),
sn AS (SELECT *, row_number() OVER w AS ord, lead(turn) OVER w AS n_turn, lead(readable) OVER w AS n_readable, lead(CASE WHEN readable THEN comp END) OVER w AS n_comp,
   sum(CASE WHEN readable THEN 0 ELSE 1 END) OVER w AS unread FROM scan WINDOW w AS (PARTITION BY session_id, side ORDER BY turn)),
pres AS (SELECT m.session_id, 'claude:'||CAST(m.seq+1 AS VARCHAR) AS item_id, m.seq, m.turn, s.side, s.ord - row_number() OVER (PARTITION BY m.session_id, m.seq ORDER BY m.turn) AS island
   FROM members m JOIN sn s ON s.session_id=m.session_id AND s.turn=m.turn WHERE s.readable),
runs AS (SELECT session_id, item_id, seq, side, min(turn) AS from_turn, max(turn) AS to_turn, count(*) AS turns FROM pres GROUP BY session_id, item_id, seq, side, island)
"""
)


def graph_scans(bases):
    """Each turn of the graph sessions: its thread, whether its chain could be read, its compaction."""
    return lifecycle.number_scans(
        bases.select(
            *SESSION,
            "turn",
            "side",
            F.col("available").alias("readable"),
            F.when(F.col("available"), F.col("compaction_seq")).alias("compaction_line"),
        )
    )


@lake.table
def graph_scan_table(spark, sf_dir):
    return graph_scans(graph_base_table(spark, sf_dir))


def stretches(spark, sf_dir, bases):
    """Stretches of turns that hold each record, from the interval numbers of the forest."""
    nodes, tables = graph_forest(spark, sf_dir)
    changes = presence_changes(nodes, tables, lifecycle.thread_order(bases))
    lines = lake.graph_log(spark, sf_dir).select(*SESSION, "seq", "line_no")
    named = changes.join(lines, [*SESSION, "seq"])
    named = named.withColumn("item_id", F.concat(F.lit("claude:"), F.col("line_no").cast("string")))
    return lifecycle.change_runs(named.drop("seq", "line_no"))


@lake.table
def graph_runs(spark, sf_dir):
    return stretches(spark, sf_dir, graph_base_table(spark, sf_dir))


@query("lifecycle_runs", q(LIFE, "SELECT session_id, item_id, from_turn, to_turn, turns FROM runs"))
def lifecycle_runs(spark, sf_dir):
    return graph_runs(spark, sf_dir).drop("agent", "side")


ITEMS = """SELECT r.session_id, r.item_id, r.first_present, r.last_present, r.turns_present, r.runs, s.n_turn IS NULL AS still_present,
 CASE WHEN s.n_turn IS NOT NULL AND s.n_readable THEN CASE WHEN s.n_comp IS NOT NULL AND s.n_comp IS DISTINCT FROM s.comp THEN 'compaction' ELSE 'branch-diverged' END END AS departure,
 s.n_turn AS departure_turn, CAST(s.unread - f.unread + CASE WHEN s.n_readable THEN 0 WHEN s.n_turn IS NULL THEN 0 ELSE 1 END AS BIGINT) AS unknown_turns, coalesce(g.turn<>r.first_present, FALSE) AS first_seen_disagrees
 FROM (SELECT session_id, item_id, seq, side, min(from_turn) AS first_present, max(to_turn) AS last_present, CAST(sum(turns) AS BIGINT) AS turns_present, count(*) AS runs FROM runs GROUP BY 1,2,3,4) r
 JOIN sn s ON s.session_id=r.session_id AND s.side=r.side AND s.turn=r.last_present
 JOIN sn f ON f.session_id=r.session_id AND f.side=r.side AND f.turn=r.first_present JOIN gt g ON g.session_id=r.session_id AND g.seq=r.seq"""


def _recorded(spark, sf_dir):
    return lake.graph_log(spark, sf_dir).select(
        *SESSION, F.concat(F.lit("claude:"), F.col("line_no").cast("string")).alias("item_id"), F.col("turn").alias("first_seen_turn")
    )


@query("lifecycle_items", q(LIFE, ITEMS))
def lifecycle_items(spark, sf_dir):
    return lifecycle.lifecycles(graph_runs(spark, sf_dir), graph_scan_table(spark, sf_dir), _recorded(spark, sf_dir)).drop("agent")


@query("lifecycle_items_unreadable", q(LIFE.replace("TRUE AS readable", "t.turn%7<>3 AS readable"), ITEMS))
def lifecycle_items_unreadable(spark, sf_dir):
    """The same where every seventh turn of a session could not be read: stretches break, causes are unknown."""
    lost = F.col("turn") % 7 == 3
    bases = graph_base_table(spark, sf_dir).select(
        *SESSION, "turn", "side", (F.col("available") & ~lost).alias("available"),
        *[F.when(~lost, F.col(c)).alias(c) for c in ("compaction_seq", "base", "base_entry")],
    )
    bases = stage(bases)
    runs = stage(stretches(spark, sf_dir, bases))
    return lifecycle.lifecycles(runs, graph_scans(bases), _recorded(spark, sf_dir)).drop("agent")


@query(
    "lifecycle_linear",
    q(
        EVT,
        """,
it AS (SELECT session_id, seq, CASE WHEN kind='compacted' THEN 'codex:compaction:' ELSE 'codex:' END||CAST(line_no AS VARCHAR) AS item_id, kind, mechanism, turn AS first_seen FROM evt WHERE occ OR kind='compacted'),
pr AS (SELECT i.*, t.turn AS held, (SELECT max(turn) FROM turns x WHERE x.session_id=t.session_id) AS last_turn FROM it i JOIN turns t ON t.session_id=i.session_id AND i.seq<t.cutoff_seq
   AND CASE WHEN i.kind='compacted' THEN i.seq=t.comp_seq ELSE t.comp_seq IS NULL OR i.seq>t.comp_seq OR i.mechanism IS NOT DISTINCT FROM 'base_instructions' END)
SELECT session_id, item_id, min(held) AS first_present, max(held) AS last_present, count(*) AS turns_present, max(held)=max(last_turn) AS still_present,
 CASE WHEN max(held)<max(last_turn) THEN 'compaction' END AS departure, coalesce(max(first_seen)<>min(held),FALSE) AS first_seen_disagrees FROM pr GROUP BY 1,2
""",
    ),
)
def lifecycle_linear(spark, sf_dir):
    """Spans from two scans; the oracle lists every (turn, item) pair."""
    return lifecycle.linear_spans(
        lake.linear_events(spark, sf_dir), lake.linear_turn_table(spark, sf_dir), lake.linear_items(spark, sf_dir)
    ).drop("agent", "label")


@query(
    "resolve_item_by_label",
    q(
        EVT,
        """,
it AS (SELECT session_id, seq, line_no, tool||CASE WHEN target IS NULL THEN '' ELSE ' '||target END AS label FROM ev WHERE kind='tool_call'),
pr AS (SELECT i.*, t.turn AS held FROM it i JOIN turns t ON t.session_id=i.session_id AND i.seq<t.cutoff_seq AND (t.comp_seq IS NULL OR i.seq>t.comp_seq))
SELECT session_id, 'codex:'||CAST(line_no AS VARCHAR) AS item_id, label, count(*) AS turns_present FROM pr WHERE lower(label) LIKE '%read f1.py%' GROUP BY ALL
""",
    ),
)
def resolve_item_by_label(spark, sf_dir):
    spans = lifecycle.linear_spans(
        lake.linear_events(spark, sf_dir),
        lake.linear_turn_table(spark, sf_dir),
        lake.linear_items(spark, sf_dir).where(F.col("category") == "tool-calls"),
    )
    return lifecycle.resolve_item(spans, " READ f1.py ").select("session_id", "item_id", "label", "turns_present")
