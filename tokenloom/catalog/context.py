"""Composition of prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.catalog import lake
from tokenloom.catalog.lake import r6
from tokenloom.catalog.registry import query
from tokenloom.catalog.sql import CITEMS, q
from tokenloom.functions.usage import estimate_tokens
from tokenloom.operators import composition as comp
from tokenloom.operators.calibrate import calibrate, unbalanced
from tokenloom.operators.composition import ItemFilter
from tokenloom.operators.reconstruct import linear_members, promote_current_prompt
from tokenloom.schema import RATIO_LINEAR_AGENT, SESSION


def estimated(items: DataFrame) -> DataFrame:
    return promote_current_prompt(items).withColumn(
        "raw_tokens", estimate_tokens(F.col("char_len"), RATIO_LINEAR_AGENT)
    ).withColumn("size_kind", F.lit("estimated"))


@lake.table
def conversation_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = lake.conversation_turns(spark, sf_dir)
    return turns.join(comp.peak_turns(turns).select(*SESSION, "turn"), [*SESSION, "turn"], "left_semi")


@lake.table
def conversation_peak_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = linear_members(lake.conversation_items(spark, sf_dir), conversation_peaks(spark, sf_dir))
    return estimated(members)


def peak_items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Calibrated items and snapshot of each conversation's largest prompt."""
    return calibrate(conversation_peak_raw(spark, sf_dir), conversation_peaks(spark, sf_dir))


@query(
    "context_composition_peak",
    q(
        CITEMS,
        """
SELECT session_id, CAST(turn AS BIGINT) AS turn, category, CAST(tokens AS BIGINT) AS tokens, item_count,
       round(tokens/greatest(total,1),6) AS share, confidence FROM (
 SELECT i.session_id, i.turn, category, sum(tokens) AS tokens, count(*) AS item_count, max(total) AS total, 'estimated' AS confidence
   FROM citems i GROUP BY ALL
 UNION ALL
 SELECT session_id, turn, 'unattributed', residual, 1, total, 'derived' FROM csnap WHERE residual>0)
""",
    ),
)
def context_composition_peak(spark, sf_dir):
    items, snaps = peak_items(spark, sf_dir)
    return comp.by_category(items, snaps).select(
        "session_id", "turn", "category", "tokens", "item_count", r6("share"), "confidence"
    )


@query(
    "context_balance_check",
    "SELECT CAST(NULL AS VARCHAR) AS session_id, CAST(NULL AS BIGINT) AS turn FROM region WHERE FALSE",
)
def context_balance_check(spark, sf_dir):
    """Items and remainder must add up to the total in every prompt: no rows."""
    return unbalanced(*peak_items(spark, sf_dir)).select("session_id", "turn")


@query(
    "context_snapshots",
    q(
        CITEMS,
        """
SELECT s.session_id, CAST(s.turn AS BIGINT) AS turn, CAST(total AS BIGINT) AS total, accounted, residual, item_count,
       total>0 AND residual*1.0/total >= 0.005 AS residual_meaningful, round(c.scale,6) AS calibration_scale
FROM csnap s LEFT JOIN (SELECT session_id, sum(tokens)*1.0/sum(raw_tokens) AS scale FROM citems WHERE est>total GROUP BY 1
     HAVING sum(raw_tokens)>0) c ON c.session_id=s.session_id
""",
    ),
)
def context_snapshots(spark, sf_dir):
    _, snaps = peak_items(spark, sf_dir)
    return snaps.select(
        "session_id", "turn", "total", "accounted", "residual", "item_count", "residual_meaningful", r6("calibration_scale")
    )


FILTERS = {
    "user": ItemFilter.parse(source="user", min_tokens=20),
    "model": ItemFilter.parse(source="model", category="assistant_messages", min_confidence="estimated"),
    "rest": ItemFilter.parse(category="unattributed", min_tokens=50),
    "sure": ItemFilter.parse(category="unattributed", min_confidence="observed"),
}


@query(
    "context_filtered_header",
    q(
        CITEMS,
        """,
m AS (SELECT 'user' AS f, * FROM citems WHERE source_kind='user' AND tokens>=20
      UNION ALL SELECT 'model', * FROM citems WHERE source_kind='model' AND category='assistant-messages')
SELECT f.f AS filter, s.session_id, CAST(count(m.seq) AS BIGINT) AS matched_items, max(s.item_count) AS total_items,
   CAST(coalesce(sum(m.tokens),0) + CASE WHEN f.f='rest' AND s.residual>=50 THEN s.residual ELSE 0 END AS BIGINT) AS matched_tokens,
   round((coalesce(sum(m.tokens),0) + CASE WHEN f.f='rest' AND s.residual>=50 THEN s.residual ELSE 0 END)/greatest(s.total,1),6) AS share_of_total,
   f.f='rest' AND s.residual>=50 AS residual_included
FROM csnap s CROSS JOIN (VALUES ('user'),('model'),('rest'),('sure')) f(f)
LEFT JOIN m ON m.session_id=s.session_id AND m.f=f.f GROUP BY f.f, s.session_id, s.residual, s.total
""",
    ),
)
def context_filtered_header(spark, sf_dir):
    items, snaps = peak_items(spark, sf_dir)
    out = None
    for name, keep in FILTERS.items():
        part = comp.view_header(items, snaps, keep).select(
            F.lit(name).alias("filter"),
            "session_id",
            "matched_items",
            "total_items",
            "matched_tokens",
            r6("share_of_total"),
            "residual_included",
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "context_available_values",
    q(
        CITEMS,
        """
SELECT session_id, facet, value, CAST(sum(tokens) AS BIGINT) AS tokens FROM (
  SELECT session_id, 'category' AS facet, category AS value, tokens FROM citems
  UNION ALL SELECT session_id, 'source', source_kind, tokens FROM citems
  UNION ALL SELECT session_id, 'confidence', 'estimated', tokens FROM citems) GROUP BY ALL
""",
    ),
)
def context_available_values(spark, sf_dir):
    items, _ = peak_items(spark, sf_dir)
    return comp.available_values(items).select("session_id", "facet", "value", "tokens")


@query(
    "context_largest",
    q(
        CITEMS,
        """
SELECT session_id, rank, 'codex:'||CAST(line_no AS VARCHAR) AS item_id, category, CAST(tokens AS BIGINT) AS tokens,
   round(tokens/greatest(total,1),6) AS share,
   CASE WHEN preview='' OR role='system' THEN '' ELSE ': '||preview END AS label_tail FROM (
 SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY tokens DESC, seq) AS rank FROM citems) WHERE rank<=3
""",
    ),
)
def context_largest(spark, sf_dir):
    items, snaps = peak_items(spark, sf_dir)
    top = comp.largest_contributors(items, snaps, 3)
    return top.select(
        "session_id",
        F.col("rank").cast("bigint").alias("rank"),
        "item_id",
        "category",
        "tokens",
        r6("share"),
        F.regexp_replace("label", r"^(User message|Assistant message|Developer instructions)", "").alias("label_tail"),
    )
