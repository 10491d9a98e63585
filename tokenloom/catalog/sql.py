"""SQL building blocks for the oracles: the bridges written for DuckDB.

They repeat the *mapping* of the driver's tables, nothing of the operators; the
oracles then use plain windows and joins.
"""

from __future__ import annotations

EV = """
ev0 AS (SELECT *, CAST(props->>'$.k' AS BIGINT) AS k, CAST(round(value*10) AS BIGINT) AS size,
               CAST(round(value*1000) AS BIGINT) AS big FROM events),
ev1 AS (SELECT *, CASE event_type WHEN 'purchase' THEN 'token_report' WHEN 'signup' THEN 'compacted'
          WHEN 'click' THEN 'tool_call'
          WHEN 'error' THEN CASE WHEN k%10=9 THEN 'unrecognised' ELSE 'tool_result' END
          ELSE CASE k%5 WHEN 0 THEN 'turn_started' WHEN 1 THEN 'message' WHEN 2 THEN 'message'
                        WHEN 3 THEN 'reasoning' ELSE 'context_injection' END END AS kind FROM ev0),
ev AS (SELECT 'codex' AS agent, CAST(user_id AS VARCHAR) AS session_id, event_id AS seq, event_id+1 AS line_no,
         event_id*8192 AS byte_offset, size+100 AS byte_len, CASE WHEN k%23<>0 THEN ts END AS ts, kind, k,
         CASE WHEN kind='unrecognised' THEN 'future_'||CAST(k AS VARCHAR) ELSE kind END AS raw_type,
         CASE WHEN kind='message' THEN CASE WHEN k%5=1 THEN 'user' ELSE 'assistant' END END AS role,
         CASE WHEN kind='message' THEN 'p'||CAST(k AS VARCHAR) END AS preview,
         CASE WHEN kind IN ('message','reasoning','tool_call','tool_result','context_injection') THEN size END AS char_len,
         CASE WHEN kind='reasoning' THEN k%2=0 END AS redacted,
         CASE WHEN kind='tool_call' THEN CASE k%4 WHEN 0 THEN 'shell' WHEN 1 THEN 'read' WHEN 2 THEN 'edit' ELSE 'search' END END AS tool,
         CASE WHEN kind IN ('tool_call','tool_result') AND k%19<>0 THEN 'c'||CAST(k%20 AS VARCHAR) END AS call_id,
         CASE WHEN kind='tool_call' AND k%3<>0 THEN 'f'||CAST(k%6 AS VARCHAR)||'.py' END AS target,
         CASE WHEN kind='tool_result' THEN k%2=0 END AS is_error,
         CASE WHEN kind='context_injection' THEN CASE (k//5)%5 WHEN 0 THEN 'base_instructions' WHEN 1 THEN 'nested_memory'
              WHEN 2 THEN 'skill' WHEN 3 THEN 'context_compaction' ELSE 'additional_tools' END END AS mechanism,
         CASE WHEN kind='context_injection' THEN 'dir/l'||CAST(k%3 AS VARCHAR) END AS label,
         CASE WHEN kind='compacted' THEN CASE WHEN k%2=0 THEN 'auto' ELSE 'manual' END END AS trig,
         CASE WHEN kind='compacted' AND k%3<>0 THEN k*1000 END AS tok_before,
         CASE WHEN kind='compacted' AND k%7<>0 THEN k*300+9000 END AS tok_after,
         CASE WHEN kind='token_report' AND k%17<>0 THEN big - CASE WHEN k%7<>0 AND k*900<=big THEN k*900 ELSE 0 END END AS u_input,
         CASE WHEN kind='token_report' AND k%17<>0 AND k%7<>0 AND k*900<=big THEN k*900 END AS u_read,
         CASE WHEN kind='token_report' AND k%29<>0 THEN k*7+1 END AS u_out,
         CASE WHEN kind='token_report' THEN k%5 END AS u_reason,
         CASE WHEN kind='token_report' AND k%3<>0 THEN 250000+k*1000 END AS u_window,
         CASE WHEN kind='token_report' THEN CASE WHEN k%31=0 THEN 3 ELSE 1 END END AS u_calls,
         CASE WHEN kind='turn_started' AND k%4<>0 THEN 'model-'||CAST(k%3 AS VARCHAR) END AS model,
         CASE WHEN kind IN ('message','reasoning','tool_call','tool_result','context_injection') THEN TRUE ELSE FALSE END AS occ
       FROM ev1)
"""

#: Turn numbers and the facts of each turn, on EV.
EVT = (
    EV
    + """,
evn AS (SELECT *, count(*) FILTER (WHERE kind='token_report') OVER (PARTITION BY session_id ORDER BY seq
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - CASE WHEN kind='token_report' THEN 1 ELSE 0 END AS before_n,
          count(*) FILTER (WHERE kind='token_report') OVER (PARTITION BY session_id) AS all_n,
          max(CASE WHEN kind='turn_started' THEN seq END) OVER (PARTITION BY session_id ORDER BY seq
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS start_seq
        FROM ev),
evt AS (SELECT *, CASE WHEN before_n < all_n THEN before_n+1 END AS turn FROM evn),
resets AS (SELECT session_id, turn, max(seq) AS reset_seq FROM evt
           WHERE kind IN ('turn_started','compacted') OR (kind='message' AND role='user') GROUP BY ALL),
rstart AS (SELECT e.session_id, e.turn, min(e.seq) AS response_start_seq FROM evt e
           LEFT JOIN resets r ON r.session_id=e.session_id AND r.turn=e.turn
           WHERE e.turn IS NOT NULL AND (e.kind IN ('reasoning','tool_call') OR (e.kind='message' AND e.role='assistant'))
             AND e.seq > coalesce(r.reset_seq,-1) GROUP BY ALL),
turns0 AS (SELECT e.agent, e.session_id, e.turn, e.ts, m.model, e.seq AS anchor_seq, s.response_start_seq,
            coalesce(s.response_start_seq, e.seq) AS cutoff_seq,
            e.u_input, e.u_read, e.u_out, e.u_reason, e.u_window, e.u_calls, e.k,
            nullif(coalesce(e.u_input,0)+coalesce(e.u_read,0),0) AS prompt_tokens
          FROM evt e LEFT JOIN rstart s ON s.session_id=e.session_id AND s.turn=e.turn
          LEFT JOIN ev m ON m.session_id=e.session_id AND m.seq=e.start_seq
          WHERE e.kind='token_report'),
turns AS (SELECT t.*, (SELECT max(c.seq) FROM ev c WHERE c.session_id=t.session_id AND c.kind='compacted'
                       AND c.seq < t.cutoff_seq) AS comp_seq FROM turns0 t)
"""
)

CONV = """
cmsg AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn*2 AS seq, turn*2+1 AS line_no, role, text,
                left(text,160) AS preview, length(text) AS char_len, conv_id, turn AS t FROM conversations),
crep AS (SELECT session_id, seq+1 AS seq, (conv_id*37 + t*211)%900 AS prompt0,
                row_number() OVER (PARTITION BY session_id ORDER BY seq) AS turn, seq AS a_seq FROM cmsg WHERE role='assistant'),
cresets AS (SELECT r.session_id, r.turn, max(m.seq) AS reset_seq FROM crep r JOIN cmsg m ON m.session_id=r.session_id
              AND m.seq<r.seq AND m.role<>'assistant' GROUP BY ALL),
cprev AS (SELECT r.*, coalesce(lag(r.seq) OVER (PARTITION BY r.session_id ORDER BY r.seq),-1) AS prev_rep FROM crep r),
cturn AS (SELECT p.session_id, p.turn, p.seq AS anchor_seq, nullif(p.prompt0,0) AS prompt_tokens,
             coalesce((SELECT min(m.seq) FROM cmsg m WHERE m.session_id=p.session_id AND m.role='assistant'
                 AND m.seq>p.prev_rep AND m.seq<p.seq AND m.seq>coalesce(s.reset_seq,-1)), p.seq) AS cutoff_seq
          FROM cprev p LEFT JOIN cresets s ON s.session_id=p.session_id AND s.turn=p.turn)
"""

#: Items of the peak turn of every conversation, calibrated.
CITEMS = (
    CONV
    + """,
cpeak AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY prompt_tokens DESC, turn) AS rn
            FROM cturn WHERE prompt_tokens IS NOT NULL) WHERE rn=1),
craw AS (SELECT m.*, p.turn, p.prompt_tokens AS total, CAST(ceil(m.char_len/3.8) AS BIGINT) AS raw_tokens,
            CASE WHEN m.role='user' AND m.seq=max(CASE WHEN m.role='user' THEN m.seq END) OVER (PARTITION BY m.session_id) THEN 'current-prompt'
                 WHEN m.role='user' THEN 'user-messages' WHEN m.role='assistant' THEN 'assistant-messages'
                 ELSE 'developer-instructions' END AS category,
            CASE WHEN m.role='user' THEN 'user' WHEN m.role='assistant' THEN 'model' ELSE 'harness' END AS source_kind
         FROM cpeak p JOIN cmsg m ON m.session_id=p.session_id AND m.seq<p.cutoff_seq),
citems AS (SELECT *, CASE WHEN est>total THEN raw_tokens*total//est ELSE raw_tokens END AS tokens FROM
            (SELECT *, sum(raw_tokens) OVER (PARTITION BY session_id) AS est FROM craw)),
csnap AS (SELECT p.session_id, p.turn, p.prompt_tokens AS total, CAST(coalesce(sum(i.tokens),0) AS BIGINT) AS accounted,
             CAST(p.prompt_tokens-coalesce(sum(i.tokens),0) AS BIGINT) AS residual, count(i.seq) AS item_count
          FROM cpeak p LEFT JOIN citems i ON i.session_id=p.session_id GROUP BY p.session_id, p.turn, p.prompt_tokens)
"""
)

GV = """
gv0 AS (SELECT *, CAST(props->>'$.k' AS BIGINT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
gv AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS seq, ts, k, n, n-1-k%3 AS parent_n, k%13=0 AS side,
   CAST(round(value*10) AS BIGINT) AS size, event_type='purchase' AS asst, event_type='purchase' AND k%9<>0 AS has_usage,
   CASE WHEN event_type='signup' THEN CASE WHEN k%8=0 THEN 'compacted' ELSE 'session_event' END
        WHEN event_type='purchase' THEN 'message' WHEN event_type='view' THEN 'message' WHEN event_type='error' THEN 'tool_result' ELSE 'context_injection' END AS kind,
   CASE WHEN event_type='purchase' THEN 'r'||CAST(n//3 AS VARCHAR) END AS request_id,
   CASE WHEN k%6<>0 THEN 'model-a' END AS model,
   nullif(CASE WHEN k%17<>0 THEN k+1 ELSE 0 END + CASE WHEN k%5<>0 THEN k*30 ELSE 0 END + CAST(round(value*1000) AS BIGINT),0) AS prompt_tokens
  FROM gv0),
gu AS (SELECT *, CASE WHEN request_id = lag(request_id) OVER (PARTITION BY session_id ORDER BY seq) THEN 0 ELSE 1 END AS opens FROM gv WHERE has_usage),
gun AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY session_id ORDER BY seq) AS BIGINT) AS turn FROM gu),
gt AS (SELECT g.*, u.turn, u.opens AS n_opens, u.request_id AS n_req, u.seq AS n_seq FROM gv g ASOF LEFT JOIN gun u
        ON g.session_id=u.session_id AND g.seq<=u.seq),
gturns AS (SELECT o.session_id, o.turn, o.ts, o.model, o.prompt_tokens, a.anchor_seq, r.response_start_seq FROM gun o
   JOIN (SELECT session_id, turn, max(seq) AS anchor_seq FROM gun GROUP BY ALL) a ON a.session_id=o.session_id AND a.turn=o.turn
   JOIN (SELECT session_id, turn, min(seq) AS response_start_seq FROM gt WHERE n_opens=1 AND asst AND (seq=n_seq OR request_id=n_req) GROUP BY ALL) r
     ON r.session_id=o.session_id AND r.turn=o.turn
   WHERE o.opens=1)
"""

#: The ancestor chain of every request, walked record by record.
GWALK = (
    GV
    + """,
walk AS (
  WITH RECURSIVE w AS (
    SELECT t.session_id, t.turn, g.seq, g.n, g.parent_n, g.kind, 0 AS dist FROM gturns t JOIN gv g ON g.session_id=t.session_id AND g.seq=t.anchor_seq
    UNION ALL
    SELECT w.session_id, w.turn, p.seq, p.n, p.parent_n, p.kind, w.dist+1 FROM w JOIN gv p ON p.session_id=w.session_id AND p.n=w.parent_n
      WHERE w.kind<>'compacted')
  SELECT * FROM w),
chain AS (SELECT w.session_id, w.turn, w.seq, w.dist, g.size, g.kind, g.asst, g.turn AS own_turn, t.response_start_seq
   FROM walk w JOIN gturns t ON t.session_id=w.session_id AND t.turn=w.turn JOIN gt g ON g.session_id=w.session_id AND g.seq=w.seq
   JOIN gv a ON a.session_id=t.session_id AND a.seq=t.anchor_seq WHERE w.kind<>'compacted' AND g.side=a.side),
tops AS (SELECT session_id, turn, max(dist) AS top FROM chain WHERE asst AND own_turn=turn AND seq>=response_start_seq GROUP BY ALL),
members AS (SELECT c.session_id, c.turn, c.seq, c.dist, c.size, c.kind FROM chain c LEFT JOIN tops o ON o.session_id=c.session_id AND o.turn=c.turn
   WHERE c.dist > coalesce(o.top,-1) AND c.kind IN ('message','tool_result','context_injection'))
"""
)


def q(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body.strip()}"


#: Requests from orders, prices from nation, contract prefixes from region.
REQ = """
ln AS (SELECT l_orderkey, sum(CASE WHEN l_returnflag='A' THEN CAST(round(l_quantity) AS BIGINT) END) AS qa,
   sum(CASE WHEN l_returnflag='R' THEN CAST(round(l_quantity) AS BIGINT) END) AS qr, sum(CASE WHEN l_returnflag='N' THEN CAST(round(l_quantity) AS BIGINT) END) AS qn,
   count(*) AS lines FROM lineitem GROUP BY 1),
req AS (SELECT CASE WHEN o_custkey%2=0 THEN 'claude-code' ELSE 'codex' END AS agent, CAST(o_custkey AS VARCHAR) AS session_id, o_orderkey AS turn,
   CASE WHEN o_orderkey%29<>0 THEN o_orderdate END AS ts, CASE WHEN o_orderkey%37<>0 THEN o_orderpriority END AS model,
   CAST(CASE WHEN o_orderkey%31<>0 THEN coalesce(qa,0)*100 END AS BIGINT) AS i, CAST(CASE WHEN o_orderkey%23<>0 THEN coalesce(qr,0)*100 END AS BIGINT) AS r,
   CAST(CASE WHEN o_orderkey%19<>0 THEN coalesce(qn,0)*10 END AS BIGINT) AS w, lines*50 AS o, CASE WHEN o_orderkey%41=0 THEN 2 ELSE 1 END AS calls
   FROM orders JOIN ln ON l_orderkey=o_orderkey),
px AS (SELECT CAST(n_nationkey AS BIGINT) AS n, n_nationkey//5 AS rev, TIMESTAMP '1994-03-01 06:00:00' + INTERVAL (CAST(n_nationkey//5*700 AS INTEGER)) DAY AS recorded_at,
   CASE n_nationkey%5 WHEN 0 THEN '1-urgent' WHEN 1 THEN '2-high' WHEN 2 THEN '3-medium' WHEN 3 THEN '4-not specified' ELSE '5-low' END AS model,
   CASE WHEN n_nationkey%12=11 THEN 'embedding' ELSE 'chat' END AS mode,
   3000000+CAST(n_nationkey AS BIGINT)*10000 AS pi, 15000000+CAST(n_nationkey AS BIGINT)*50000 AS po,
   CASE WHEN n_nationkey%7<>0 THEN 300000+CAST(n_nationkey AS BIGINT)*1000 END AS pr, 3750000+CAST(n_nationkey AS BIGINT)*12500 AS pw,
   CASE WHEN n_nationkey%2=0 THEN 6000000+CAST(n_nationkey AS BIGINT)*10000 END AS pi2, CASE WHEN n_nationkey%4=0 THEN 9000000+CAST(n_nationkey AS BIGINT)*10000 END AS pi6 FROM nation),
cr AS (SELECT CAST(r_regionkey AS BIGINT) AS k, CASE r_regionkey WHEN 0 THEN '2' WHEN 1 THEN '2-h' WHEN 2 THEN '2-hi' WHEN 3 THEN '4-not' ELSE '9' END AS prefix FROM region)
"""


def priced_sql(name: str, source: str = "req", contract: bool = False, at: str = "q.ts", now: str = "1999-06-01") -> str:
    """CTE ``name``: every request of ``source`` with its costs or its reason."""
    own = "c.k IS NOT NULL" if contract else "FALSE"
    k = "c.k" if contract else "NULL"
    join = (
        "LEFT JOIN (SELECT session_id, turn, k FROM (SELECT q.session_id, q.turn, cr.k, row_number() OVER (PARTITION BY q.session_id, q.turn "
        f"ORDER BY length(cr.prefix) DESC) AS rn FROM {source} q JOIN cr ON starts_with(lower(q.model), cr.prefix)) WHERE rn=1) c "
        "ON c.session_id=q.session_id AND c.turn=q.turn"
        if contract
        else ""
    )
    return f"""
{name}_rev AS (SELECT q.session_id, q.turn, max(p.rev) AS rev FROM {source} q JOIN (SELECT DISTINCT rev, recorded_at FROM px) p
   ON p.recorded_at <= coalesce({at}, TIMESTAMP '{now}') AND p.recorded_at <= TIMESTAMP '{now}' AND coalesce({at}, TIMESTAMP '{now}') <= TIMESTAMP '{now}' GROUP BY ALL),
{name}_p AS (SELECT q.*, v.rev, p.mode, CASE WHEN p.pi6 IS NOT NULL AND coalesce(i,0)+coalesce(r,0)+coalesce(w,0)>6000 THEN p.pi6
      WHEN p.pi2 IS NOT NULL AND coalesce(i,0)+coalesce(r,0)+coalesce(w,0)>2000 THEN p.pi2 ELSE p.pi END AS pi, p.po, p.pr, p.pw, {own} AS own, {k} AS ck, p.n AS pn
   FROM {source} q LEFT JOIN {name}_rev v ON v.session_id=q.session_id AND v.turn=q.turn LEFT JOIN px p ON p.rev=v.rev AND p.model=lower(q.model) {join}),
{name}_r AS (SELECT *, CASE WHEN model IS NULL THEN 'model' WHEN i IS NULL OR o IS NULL THEN 'usage'
     WHEN r IS NULL OR (agent='claude-code' AND w IS NULL) THEN 'split' WHEN calls>1 THEN 'calls' WHEN own THEN NULL
     WHEN {at.replace("q.", "")} > TIMESTAMP '{now}' THEN 'future' WHEN rev IS NULL THEN 'revision' WHEN pn IS NULL THEN 'match' WHEN mode NOT IN ('chat','completion') THEN 'mode'
     WHEN pr IS NULL AND r>0 THEN 'rate' END AS reason FROM {name}_p),
{name} AS (SELECT *, CASE WHEN reason IS NULL THEN i*CASE WHEN own THEN 1000000+ck*1000 ELSE pi END//1000000 END AS ci,
     CASE WHEN reason IS NULL THEN coalesce(r,0)*CASE WHEN own THEN 100000+ck*1000 ELSE coalesce(pr,0) END//1000000 END AS cread,
     CASE WHEN reason IS NULL THEN coalesce(w,0)*CASE WHEN own THEN 1250000+ck*1000 ELSE pw END//1000000 END AS cw,
     CASE WHEN reason IS NULL THEN o*CASE WHEN own THEN 5000000+ck*1000 ELSE po END//1000000 END AS co FROM {name}_r)
"""


def conv_items(name: str, choose: str, ratio: str = "3.8") -> str:
    """CTEs ``name`` (calibrated items) and ``name_s`` (snapshots) of one chosen turn per conversation."""
    return f"""
{name}_t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY {choose}) AS rn FROM cturn WHERE prompt_tokens IS NOT NULL) WHERE rn=1),
{name}_r AS (SELECT m.*, p.turn, p.prompt_tokens AS total, CAST(ceil(m.char_len/CAST({ratio} AS DOUBLE)) AS BIGINT) AS raw_tokens,
   CASE WHEN m.role='user' AND m.seq=max(CASE WHEN m.role='user' THEN m.seq END) OVER (PARTITION BY m.session_id) THEN 'current-prompt'
        WHEN m.role='user' THEN 'user-messages' WHEN m.role='assistant' THEN 'assistant-messages' ELSE 'developer-instructions' END AS category
   FROM {name}_t p JOIN cmsg m ON m.session_id=p.session_id AND m.seq<p.cutoff_seq),
{name} AS (SELECT *, CAST(CASE WHEN est>total THEN raw_tokens*total//est ELSE raw_tokens END AS BIGINT) AS tokens FROM (SELECT *, sum(raw_tokens) OVER (PARTITION BY session_id) AS est FROM {name}_r)),
{name}_s AS (SELECT p.session_id, p.turn, p.prompt_tokens AS total, CAST(coalesce(sum(i.tokens),0) AS BIGINT) AS accounted, CAST(p.prompt_tokens-coalesce(sum(i.tokens),0) AS BIGINT) AS residual
   FROM {name}_t p LEFT JOIN {name} i ON i.session_id=p.session_id GROUP BY p.session_id, p.turn, p.prompt_tokens),
{name}_c AS (SELECT session_id, category, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS n FROM {name} GROUP BY 1,2
   UNION ALL SELECT session_id, 'unattributed', residual, 1 FROM {name}_s WHERE residual>0)
"""
