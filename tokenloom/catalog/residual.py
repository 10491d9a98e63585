"""Ratio fit and the unlogged remainder."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom.catalog import lake
from tokenloom.catalog.lake import r6
from tokenloom.catalog.registry import query
from tokenloom.catalog.sql import EVT, q
from tokenloom.operators import residual

# The observed prompt of a turn in these queries: a fixed function of what was
# logged, a base that jumps with the day of the turn, and noise from the output.
SAMPLES = (
    EVT
    + """,
szs AS (SELECT t.session_id, t.turn, t.k, t.anchor_seq,
 CAST(coalesce(sum(e.char_len) FILTER (WHERE e.occ AND (e.mechanism IS NOT DISTINCT FROM 'base_instructions' OR t.comp_seq IS NULL OR e.seq>t.comp_seq)),0)
   + coalesce(max(CASE WHEN e.seq=t.comp_seq THEN e.byte_len END),0) AS BIGINT) AS chars,
 count(e.seq) FILTER (WHERE e.occ AND (e.mechanism IS NOT DISTINCT FROM 'base_instructions' OR t.comp_seq IS NULL OR e.seq>t.comp_seq))
   + CASE WHEN max(t.comp_seq) IS NULL THEN 0 ELSE 1 END AS depth
 FROM turns t LEFT JOIN ev e ON e.session_id=t.session_id AND e.seq<t.cutoff_seq GROUP BY t.session_id, t.turn, t.k, t.anchor_seq),
samples AS (SELECT session_id, turn, chars, depth, chars*10//36 + 1500 + (turn//7)*9000 + k%13 - CASE WHEN k%41=0 THEN 40000 ELSE 0 END AS tokens0 FROM szs),
smp AS (SELECT session_id, turn, chars, depth, tokens0 AS tokens FROM samples WHERE tokens0>0),
pairs AS (SELECT * FROM (SELECT session_id, turn, chars-lag(chars) OVER w AS dc, tokens-lag(tokens) OVER w AS dt, depth-lag(depth) OVER w AS dd
   FROM smp WINDOW w AS (PARTITION BY session_id ORDER BY turn)) WHERE dd>=0 AND dc>=500 AND dt>=50),
rat AS (SELECT session_id, CAST(dc AS DOUBLE)/dt AS ratio FROM pairs WHERE CAST(dc AS DOUBLE)/dt BETWEEN 0.5 AND 20),
lst AS (SELECT session_id, list_sort(list(ratio)) AS l, count(*) AS n FROM rat GROUP BY 1 HAVING count(*)>=5),
fit0 AS (SELECT session_id, n AS pairs_used, (l[(n-1)//2+1]+l[n//2+1])/2 AS cpt,
   l[CAST(round((n-1)*0.75) AS BIGINT)+1]/l[CAST(round((n-1)*0.25) AS BIGINT)+1] AS dispersion FROM lst),
ovl AS (SELECT s.session_id, list_sort(list(s.tokens - s.chars/f.cpt)) AS l, count(*) AS n FROM smp s JOIN fit0 f ON f.session_id=s.session_id GROUP BY 1),
fit AS (SELECT f.*, CASE WHEN (l[(n-1)//2+1]+l[n//2+1])/2>0 THEN CAST(floor((l[(n-1)//2+1]+l[n//2+1])/2) AS BIGINT) END AS unlogged_overhead
   FROM fit0 f JOIN ovl o ON o.session_id=f.session_id),
series AS (SELECT s.session_id, s.turn, s.tokens AS prompt_tokens, CAST(floor(s.chars/f.cpt) AS BIGINT) AS accounted,
   CASE WHEN s.tokens - s.chars/f.cpt > 0 THEN CAST(floor(s.tokens - s.chars/f.cpt) AS BIGINT) END AS unlogged, s.depth AS items
   FROM smp s JOIN fit f ON f.session_id=s.session_id)
"""
)


def samples(spark, sf_dir):
    turns = lake.linear_turn_table(spark, sf_dir)
    k = _report_k(spark, sf_dir)
    tokens = (
        F.floor(F.col("context_chars") * 10 / 36).cast("bigint")
        + 1500
        + F.floor(F.col("turn") / 7).cast("bigint") * 9000
        + F.col("k") % 13
        - F.when(F.col("k") % 41 == 0, 40000).otherwise(0)
    )
    return (
        turns.join(k, "anchor_seq")
        .select(
            "agent",
            "session_id",
            "turn",
            F.col("context_chars").alias("chars"),
            tokens.alias("tokens"),
            F.col("context_items").alias("depth"),
        )
        .where(F.col("tokens") > 0)
    )


def _report_k(spark, sf_dir):
    from tokenloom import bridge

    return bridge.read(spark, sf_dir, "events").select(
        F.col("event_id").alias("anchor_seq"), F.get_json_object("props", "$.k").cast("bigint").alias("k")
    )


@lake.table
def residual_samples(spark, sf_dir):
    return samples(spark, sf_dir)


@lake.table
def session_ratio(spark, sf_dir):
    return residual.fit_ratio(residual_samples(spark, sf_dir))


@lake.table
def residual_points(spark, sf_dir):
    return residual.residual_series(residual_samples(spark, sf_dir), session_ratio(spark, sf_dir))


@query(
    "ratio_fit",
    q(
        SAMPLES,
        "SELECT session_id, round(cpt,6) AS chars_per_token, pairs_used, round(dispersion,6) AS dispersion, unlogged_overhead FROM fit",
    ),
)
def ratio_fit(spark, sf_dir):
    return session_ratio(spark, sf_dir).select(
        "session_id", r6("chars_per_token"), "pairs_used", r6("dispersion"), "unlogged_overhead"
    )


@query("residual_series", q(SAMPLES, "SELECT * FROM series"))
def residual_series(spark, sf_dir):
    return residual_points(spark, sf_dir).drop("agent")


#: The steps, merged one by one; the last of each run counts.
STEPS = (
    SAMPLES
    + """,
kn AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY session_id) AS c FROM series WHERE unlogged IS NOT NULL),
med AS (SELECT session_id, turn, n, c, list_sort(list(unlogged) OVER (PARTITION BY session_id ORDER BY n ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))[3] AS b,
   list_sort(list(unlogged) OVER (PARTITION BY session_id ORDER BY n ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))[3] AS a FROM kn),
st AS (SELECT session_id, turn, b, a, a-b AS g, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS i FROM med WHERE n>5 AND n<=c-4 AND abs(a-b)>=5000),
fold AS (
  WITH RECURSIVE f AS (
    SELECT session_id, i, turn AS kt, b AS kb, a AS ka, g AS kg, 1 AS kid FROM st WHERE i=1
    UNION ALL
    SELECT s.session_id, s.i,
      CASE WHEN s.turn-f.kt<=5 AND sign(s.g)=sign(f.kg) AND abs(s.g)<=abs(f.kg) THEN f.kt ELSE s.turn END,
      CASE WHEN s.turn-f.kt<=5 AND sign(s.g)=sign(f.kg) AND abs(s.g)<=abs(f.kg) THEN f.kb ELSE s.b END,
      CASE WHEN s.turn-f.kt<=5 AND sign(s.g)=sign(f.kg) AND abs(s.g)<=abs(f.kg) THEN f.ka ELSE s.a END,
      CASE WHEN s.turn-f.kt<=5 AND sign(s.g)=sign(f.kg) AND abs(s.g)<=abs(f.kg) THEN f.kg ELSE s.g END,
      CASE WHEN s.turn-f.kt<=5 AND sign(s.g)=sign(f.kg) THEN f.kid ELSE f.kid+1 END
    FROM f JOIN st s ON s.session_id=f.session_id AND s.i=f.i+1)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, kid ORDER BY i DESC) AS rn FROM f) WHERE rn=1)
"""
)


@query(
    "residual_steps",
    q(
        STEPS,
        """
SELECT f.session_id, kt AS turn, kb AS from_tokens, ka AS to_tokens, kg AS growth,
  EXISTS (SELECT 1 FROM evt e WHERE e.session_id=f.session_id AND e.kind='compacted' AND e.turn IS NOT NULL AND abs(e.turn-f.kt)<=5) AS near_compaction
FROM fold f
""",
    ),
)
def residual_steps(spark, sf_dir):
    steps = residual.residual_steps(residual_points(spark, sf_dir))
    return residual.near_compaction(steps, lake.linear_events(spark, sf_dir)).drop("agent")
