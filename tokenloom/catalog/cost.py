"""Prices, costs, what-ifs and cache use."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tokenloom import bridge
from tokenloom.catalog import lake
from tokenloom.catalog.lake import r6
from tokenloom.catalog.registry import query
from tokenloom.catalog.sql import REQ, priced_sql, q
from tokenloom.operators import cost
from tokenloom.operators.corpus import costliest_sessions
from tokenloom.sources.pricing import price_catalog

NOW = dt.datetime(1999, 6, 1, tzinfo=dt.timezone.utc)


@lake.table
def requests(spark, sf_dir):
    return bridge.order_requests(spark, sf_dir)


@lake.table
def catalog(spark, sf_dir):
    return price_catalog(*bridge.price_snapshots(spark, sf_dir))


@query(
    "price_catalog_load",
    q(
        REQ,
        """SELECT sha1('rev'||CAST(rev AS VARCHAR)) AS sha, model, recorded_at, mode, pi AS input_rate, po AS output_rate, pr AS cache_read_rate, pw AS cache_write_rate,
 CASE WHEN pi2 IS NULL THEN '' ELSE '2000:'||CAST(pi2 AS VARCHAR)||CASE WHEN pi6 IS NULL THEN '' ELSE ',6000:'||CAST(pi6 AS VARCHAR) END END AS input_tiers FROM px""",
    ),
)
def price_catalog_load(spark, sf_dir):
    tiers = F.array_join(
        F.transform(
            F.array_sort("input_tiers"),
            lambda t: F.concat(t["threshold"].cast("string"), F.lit(":"), t["rate"].cast("string")),
        ),
        ",",
    )
    return catalog(spark, sf_dir).select(
        "sha", "model", "recorded_at", "mode", "input_rate", "output_rate", "cache_read_rate", "cache_write_rate",
        tiers.alias("input_tiers"),
    )


TURN_COLS = [
    "session_id", "turn", "reason", "input_micros", "cache_read_micros", "cache_write_micros", "output_micros", "total_micros",
]
TURN_SQL = """SELECT session_id, turn, reason, CAST(ci AS BIGINT) AS input_micros, CAST(cread AS BIGINT) AS cache_read_micros, CAST(cw AS BIGINT) AS cache_write_micros,
 CAST(co AS BIGINT) AS output_micros, CAST(ci+cread+cw+co AS BIGINT) AS total_micros FROM p"""


@lake.table
def priced(spark, sf_dir):
    return cost.price_turns(requests(spark, sf_dir), catalog(spark, sf_dir), NOW)


@query("turn_costs", q(REQ + "," + priced_sql("p"), TURN_SQL))
def turn_costs(spark, sf_dir):
    return priced(spark, sf_dir).select(*TURN_COLS)


@query("turn_costs_contract", q(REQ + "," + priced_sql("p", contract=True), TURN_SQL))
def turn_costs_contract(spark, sf_dir):
    rates = bridge.contract_rates(spark, sf_dir)
    return cost.price_turns(requests(spark, sf_dir), catalog(spark, sf_dir), NOW, overrides=rates).select(*TURN_COLS)


SESSION_SUMS = """CAST(coalesce(sum(ci+cread+cw+co),0) AS BIGINT)"""


@query(
    "session_costs",
    q(
        REQ + "," + priced_sql("p"),
        f"""SELECT agent, session_id, CAST(coalesce(sum(i) FILTER (WHERE reason IS NULL),0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(ci),0) AS BIGINT) AS input_micros,
 CAST(coalesce(sum(co),0) AS BIGINT) AS output_micros, {SESSION_SUMS} AS total_micros, count(*) FILTER (WHERE reason IS NULL) AS priced_turns,
 count(*) FILTER (WHERE reason IS NOT NULL) AS unpriced_turns, count(DISTINCT rev) FILTER (WHERE reason IS NULL) AS pricing_versions FROM p GROUP BY 1,2""",
    ),
)
def session_costs(spark, sf_dir):
    return cost.session_costs(priced(spark, sf_dir)).select(
        "agent", "session_id", "input_tokens", "input_micros", "output_micros", "total_micros", "priced_turns",
        "unpriced_turns", "pricing_versions",
    )


@query("unpriced_reasons", q(REQ + "," + priced_sql("p"), "SELECT agent, reason, count(*) AS turns FROM p WHERE reason IS NOT NULL GROUP BY 1,2"))
def unpriced_reasons(spark, sf_dir):
    return cost.unpriced_reasons(priced(spark, sf_dir))


@query(
    "corpus_costliest_sessions",
    q(REQ + "," + priced_sql("p"), f"SELECT agent, session_id, {SESSION_SUMS} AS total_micros FROM p GROUP BY 1,2 HAVING {SESSION_SUMS}>0 ORDER BY 3 DESC, 1, 2 LIMIT 12"),
)
def corpus_costliest_sessions(spark, sf_dir):
    return costliest_sessions(cost.session_costs(priced(spark, sf_dir))).select("agent", "session_id", "total_micros")


@query(
    "cost_what_if",
    q(
        REQ
        + ", req2 AS (SELECT * REPLACE ('3-MEDIUM' AS model, least(i,1500) AS i, least(o,120) AS o) FROM req),"
        + priced_sql("p")
        + ","
        + priced_sql("h", source="req2"),
        f"""SELECT b.agent, b.session_id, b.t AS baseline_micros, h.t AS hypothetical_micros, greatest(b.t-h.t,0) AS savings_micros FROM
 (SELECT agent, session_id, {SESSION_SUMS} AS t FROM p GROUP BY 1,2) b JOIN (SELECT agent, session_id, {SESSION_SUMS} AS t FROM h GROUP BY 1,2) h
 ON h.session_id=b.session_id AND h.agent=b.agent""",
    ),
)
def cost_what_if(spark, sf_dir):
    scenario = cost.Scenario(model_override="3-MEDIUM", cap_input_tokens=1500, cap_output_tokens=120)
    hypothetical = cost.price_turns(requests(spark, sf_dir), catalog(spark, sf_dir), NOW, scenario)
    return cost.compare_scenario(cost.session_costs(priced(spark, sf_dir)), cost.session_costs(hypothetical))


@query(
    "cost_forecast",
    q(
        REQ
        + ", rq AS (SELECT * FROM req WHERE model IS NOT NULL), rqn AS (SELECT * REPLACE (CAST(NULL AS TIMESTAMP) AS ts) FROM rq),"
        + priced_sql("p", source="rq")
        + ","
        + priced_sql("f", source="rqn"),
        f"""SELECT a.agent, a.session_id, a.t AS observed_micros, b.ai AS avg_input_tokens, b.pt AS per_turn_micros, b.pt*10 AS projected_additional_micros, a.t+b.pt*10 AS projected_total_micros
FROM (SELECT agent, session_id, {SESSION_SUMS} AS t FROM p GROUP BY 1,2 HAVING count(*) FILTER (WHERE reason IS NOT NULL)=0) a
JOIN (SELECT agent, session_id, CAST(sum(i)//count(*) AS BIGINT) AS ai, CAST(sum(ci)//count(*)+sum(cread)//count(*)+sum(cw)//count(*)+sum(co)//count(*) AS BIGINT) AS pt FROM f GROUP BY 1,2
  HAVING count(*) FILTER (WHERE reason IS NOT NULL)=0) b ON a.session_id=b.session_id AND a.agent=b.agent""",
    ),
)
def cost_forecast(spark, sf_dir):
    named = requests(spark, sf_dir).where(F.col("model").isNotNull())
    prices = catalog(spark, sf_dir)
    now_priced = cost.price_turns(cost.without_time(named), prices, NOW)
    return cost.forecast(cost.price_turns(named, prices, NOW), now_priced, 10).select(
        "agent", "session_id", "observed_micros", "avg_input_tokens", "per_turn_micros",
        "projected_additional_micros", "projected_total_micros",
    )


@query(
    "cache_usage",
    q(
        REQ,
        """,
z AS (SELECT *, i IS NOT NULL AND r IS NOT NULL AND coalesce(i,0)+coalesce(r,0)+coalesce(w,0)>0 AND (agent='codex' OR w IS NOT NULL) AS ok FROM req)
SELECT agent, session_id, CAST(sum(CASE WHEN agent<>'codex' OR r IS NOT NULL THEN i END) AS BIGINT) AS fresh_input_tokens, CAST(sum(r) AS BIGINT) AS cache_read_tokens,
 CAST(sum(w) AS BIGINT) AS cache_write_tokens, count(*) FILTER (WHERE ok) AS complete_turns, count(*) AS total_turns, count(*) FILTER (WHERE calls>1) AS multi_call_turns,
 round(sum(r) FILTER (WHERE ok)*1.0/nullif(sum(i+r+coalesce(w,0)) FILTER (WHERE ok),0),6) AS cache_read_share FROM z GROUP BY 1,2
""",
    ),
)
def cache_usage(spark, sf_dir):
    return cost.cache_usage(requests(spark, sf_dir)).withColumn("cache_read_share", r6("cache_read_share"))
