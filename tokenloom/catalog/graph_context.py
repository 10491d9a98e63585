"""Composition of prompts of graph logs, by interval tests on the forest of records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom.catalog import lake
from tokenloom.catalog.context import FILTERS
from tokenloom.catalog.graph import graph_base_table, graph_forest
from tokenloom.catalog.lake import r6
from tokenloom.catalog.registry import query
from tokenloom.catalog.sql import GWALK, q
from tokenloom.functions.usage import estimate_tokens
from tokenloom.operators import chains
from tokenloom.operators import composition as comp
from tokenloom.operators.calibrate import calibrate
from tokenloom.operators.reconstruct import item_pool, name_results, promote_current_prompt
from tokenloom.schema import RATIO_CODE, SESSION

#: Items of the peak request of every graph session, calibrated; the oracle walks the chains.
GITEMS = (
    GWALK
    + """,
gcat AS (SELECT session_id, seq, size, CASE WHEN kind='message' AND asst THEN 'assistant-messages' WHEN kind='message' THEN 'user-messages'
    WHEN kind='tool_result' THEN 'tool-outputs' WHEN k%2=0 THEN 'repository-instructions' ELSE 'developer-instructions' END AS category,
    CASE WHEN kind='message' AND asst THEN 'model' WHEN kind='message' THEN 'user' WHEN kind='tool_result' THEN 'tool'
    WHEN k%2=0 THEN 'instruction-file' ELSE 'harness' END AS source_kind FROM gv WHERE kind IN ('message','tool_result','context_injection')),
gpeak AS (SELECT * FROM gturns WHERE prompt_tokens IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY prompt_tokens DESC, turn)=1),
gheld AS (SELECT c.*, p.turn, p.prompt_tokens AS total, CAST(ceil(c.size/CAST(3.1 AS DOUBLE)) AS BIGINT) AS raw_tokens,
    max(CASE WHEN c.category='user-messages' THEN c.seq END) OVER (PARTITION BY c.session_id) AS prompt_seq
    FROM gpeak p JOIN members m ON m.session_id=p.session_id AND m.turn=p.turn JOIN gcat c ON c.session_id=m.session_id AND c.seq=m.seq),
gitems AS (SELECT * EXCLUDE (category), CASE WHEN seq=prompt_seq THEN 'current-prompt' ELSE category END AS category,
    CASE WHEN est>total THEN raw_tokens*total//est ELSE raw_tokens END AS tokens
    FROM (SELECT *, sum(raw_tokens) OVER (PARTITION BY session_id) AS est FROM gheld)),
gsnap AS (SELECT p.session_id, p.turn, p.prompt_tokens AS total, CAST(coalesce(sum(i.tokens),0) AS BIGINT) AS accounted,
    CAST(p.prompt_tokens-coalesce(sum(i.tokens),0) AS BIGINT) AS residual, count(i.seq) AS item_count,
    CASE WHEN max(i.est)>p.prompt_tokens AND sum(raw_tokens)>0 THEN round(sum(i.tokens)*1.0/sum(raw_tokens),6) END AS scale
    FROM gpeak p LEFT JOIN gitems i ON i.session_id=p.session_id GROUP BY p.session_id, p.turn, p.prompt_tokens)
"""
)


@lake.table
def graph_items(spark, sf_dir):
    return item_pool(name_results(lake.graph_log(spark, sf_dir)))


@lake.table
def graph_peaks(spark, sf_dir):
    turns = lake.graph_turn_table(spark, sf_dir)
    return turns.join(comp.peak_turns(turns).select(*SESSION, "turn"), [*SESSION, "turn"], "left_semi")


@lake.table
def graph_peak_raw(spark, sf_dir):
    wanted = graph_base_table(spark, sf_dir).join(
        graph_peaks(spark, sf_dir).select(*SESSION, "turn"), [*SESSION, "turn"], "left_semi"
    )
    held = chains.members_at(graph_forest(spark, sf_dir)[0], wanted, graph_items(spark, sf_dir))
    return promote_current_prompt(held).withColumn(
        "raw_tokens", estimate_tokens(F.col("char_len"), RATIO_CODE)
    ).withColumn("size_kind", F.lit("estimated"))


def peak_items(spark, sf_dir):
    return calibrate(graph_peak_raw(spark, sf_dir), graph_peaks(spark, sf_dir))


@query(
    "context_composition_graph",
    q(
        GITEMS,
        """
SELECT session_id, CAST(turn AS BIGINT) AS turn, category, CAST(tokens AS BIGINT) AS tokens, item_count,
       round(tokens/greatest(total,1),6) AS share, confidence FROM (
 SELECT session_id, turn, category, sum(tokens) AS tokens, count(*) AS item_count, max(total) AS total, 'estimated' AS confidence FROM gitems GROUP BY ALL
 UNION ALL
 SELECT session_id, turn, 'unattributed', residual, 1, total, 'derived' FROM gsnap WHERE residual>0)
""",
    ),
)
def context_composition_graph(spark, sf_dir):
    return comp.by_category(*peak_items(spark, sf_dir)).select(
        "session_id", "turn", "category", "tokens", "item_count", r6("share"), "confidence"
    )


@query(
    "context_snapshots_graph",
    q(
        GITEMS,
        """
SELECT session_id, CAST(turn AS BIGINT) AS turn, CAST(total AS BIGINT) AS total, accounted, residual, item_count,
       total>0 AND residual*1.0/total >= 0.005 AS residual_meaningful, scale AS calibration_scale FROM gsnap
""",
    ),
)
def context_snapshots_graph(spark, sf_dir):
    _, snaps = peak_items(spark, sf_dir)
    return snaps.select(
        "session_id", "turn", "total", "accounted", "residual", "item_count", "residual_meaningful", r6("calibration_scale")
    )


@query(
    "context_filtered_graph",
    q(
        GITEMS,
        """,
m AS (SELECT 'user' AS f, * FROM gitems WHERE source_kind='user' AND tokens>=20
      UNION ALL SELECT 'model', * FROM gitems WHERE source_kind='model' AND category='assistant-messages')
SELECT f.f AS filter, s.session_id, CAST(count(m.seq) AS BIGINT) AS matched_items, max(s.item_count) AS total_items,
   CAST(coalesce(sum(m.tokens),0) + CASE WHEN f.f='rest' AND s.residual>=50 THEN s.residual ELSE 0 END AS BIGINT) AS matched_tokens,
   round((coalesce(sum(m.tokens),0) + CASE WHEN f.f='rest' AND s.residual>=50 THEN s.residual ELSE 0 END)/greatest(s.total,1),6) AS share_of_total,
   f.f='rest' AND s.residual>=50 AS residual_included
FROM gsnap s CROSS JOIN (VALUES ('user'),('model'),('rest'),('sure')) f(f)
LEFT JOIN m ON m.session_id=s.session_id AND m.f=f.f GROUP BY f.f, s.session_id, s.residual, s.total
""",
    ),
)
def context_filtered_graph(spark, sf_dir):
    items, snaps = peak_items(spark, sf_dir)
    out = None
    for name, keep in FILTERS.items():
        part = comp.view_header(items, snaps, keep).select(
            F.lit(name).alias("filter"), "session_id", "matched_items", "total_items", "matched_tokens",
            r6("share_of_total"), "residual_included",
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "context_values_graph",
    q(
        GITEMS,
        """
SELECT session_id, facet, value, CAST(sum(tokens) AS BIGINT) AS tokens FROM (
  SELECT session_id, 'category' AS facet, category AS value, tokens FROM gitems
  UNION ALL SELECT session_id, 'source', source_kind, tokens FROM gitems
  UNION ALL SELECT session_id, 'confidence', 'estimated', tokens FROM gitems) GROUP BY ALL
""",
    ),
)
def context_values_graph(spark, sf_dir):
    return comp.available_values(peak_items(spark, sf_dir)[0]).select("session_id", "facet", "value", "tokens")


@query(
    "context_largest_graph",
    q(
        GITEMS,
        """
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY tokens DESC, seq) AS rank, 'claude:'||CAST(seq+1 AS VARCHAR) AS item_id,
   category, CAST(tokens AS BIGINT) AS tokens, round(tokens/greatest(total,1),6) AS share FROM gitems
 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY tokens DESC, seq)<=15
""",
    ),
)
def context_largest_graph(spark, sf_dir):
    top = comp.largest_contributors(*peak_items(spark, sf_dir))
    return top.select("session_id", F.col("rank").cast("bigint").alias("rank"), "item_id", "category", "tokens", r6("share"))


@query(
    "context_categories_graph",
    q(
        GITEMS,
        """
SELECT m.session_id, m.turn, c.category, CAST(sum(c.size) AS BIGINT) AS chars, count(*) AS items
 FROM members m JOIN gcat c ON c.session_id=m.session_id AND c.seq=m.seq GROUP BY ALL
""",
    ),
)
def context_categories_graph(spark, sf_dir):
    """What every prompt of every graph session holds by category, from running sums over the forest."""
    sums = chains.category_sums(
        graph_forest(spark, sf_dir)[0], graph_base_table(spark, sf_dir), graph_items(spark, sf_dir)
    )
    return sums.select("session_id", "turn", "category", "chars", "items")
