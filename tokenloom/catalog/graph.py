"""Graph logs: turns, ancestor chains and what they add up to."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom.catalog import lake
from tokenloom.catalog.registry import query
from tokenloom.catalog.sql import GV, GWALK, q
from tokenloom.operators import chains
from tokenloom.session import stage


@query("turns_graph", q(GV, "SELECT session_id, turn, ts, model, prompt_tokens, anchor_seq, response_start_seq FROM gturns"))
def turns_graph(spark, sf_dir):
    return lake.graph_turn_table(spark, sf_dir).select(
        "session_id", "turn", "ts", "model", "prompt_tokens", "anchor_seq", "response_start_seq"
    )


@query("turn_of_event_graph", q(GV, "SELECT session_id, seq, turn FROM gt"))
def turn_of_event_graph(spark, sf_dir):
    return lake.graph_log(spark, sf_dir).select("session_id", "seq", "turn")


@query(
    "event_parent_link",
    q(GV, "SELECT g.session_id, g.seq, p.seq AS parent_seq FROM gv g LEFT JOIN gv p ON p.session_id=g.session_id AND p.n=g.parent_n"),
)
def event_parent_link(spark, sf_dir):
    return lake.graph_log(spark, sf_dir).select("session_id", "seq", "parent_seq")


@lake.table
def graph_member_table(spark, sf_dir):
    return chains.graph_members(lake.graph_log(spark, sf_dir), lake.graph_turn_table(spark, sf_dir))


_FORESTS: dict[tuple[str, str], tuple] = {}


def graph_forest(spark, sf_dir):
    """The numbered node table and its jump tables, made once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FORESTS:
        nodes, tables = chains.numbered_nodes(lake.graph_log(spark, sf_dir))
        _FORESTS[key] = (stage(nodes), tables)
    return _FORESTS[key]


@lake.table
def graph_base_table(spark, sf_dir):
    return chains.turn_bases(graph_forest(spark, sf_dir)[0], lake.graph_turn_table(spark, sf_dir))


@lake.table
def graph_size_table(spark, sf_dir):
    return chains.base_sizes(graph_forest(spark, sf_dir)[0], graph_base_table(spark, sf_dir))


@query("chain_members", q(GWALK, "SELECT session_id, turn, seq, CAST(dist AS BIGINT) AS distance FROM members"))
def chain_members(spark, sf_dir):
    return graph_member_table(spark, sf_dir).select("session_id", "turn", "seq", "distance")


@query(
    "chain_sizes",
    q(
        GWALK,
        """
SELECT t.session_id, t.turn, CAST(coalesce(sum(m.size),0) AS BIGINT) AS context_chars, count(m.seq) AS context_items,
  max(c.seq) AS compaction_seq FROM gturns t
LEFT JOIN members m ON m.session_id=t.session_id AND m.turn=t.turn
LEFT JOIN (SELECT session_id, turn, seq FROM walk WHERE kind='compacted') c ON c.session_id=t.session_id AND c.turn=t.turn
GROUP BY t.session_id, t.turn
""",
    ),
)
def chain_sizes(spark, sf_dir):
    """Totals by pointer doubling; the oracle walks every chain."""
    return graph_size_table(spark, sf_dir).select(
        "session_id", "turn", "context_chars", "context_items", "compaction_seq"
    )


@query(
    "chain_sizes_agree",
    "SELECT CAST(NULL AS VARCHAR) AS session_id, CAST(NULL AS BIGINT) AS turn FROM region WHERE FALSE",
)
def chain_sizes_agree(spark, sf_dir):
    """Turns whose doubled total differs from the sum over listed members: none."""
    listed = (
        graph_member_table(spark, sf_dir)
        .groupBy("session_id", "turn")
        .agg(F.sum("chars").alias("c"), F.count(F.lit(1)).alias("n"))
    )
    return (
        graph_size_table(spark, sf_dir)
        .join(listed, ["session_id", "turn"], "left")
        .where(
            (F.col("context_chars") != F.coalesce("c", F.lit(0)))
            | (F.col("context_items") != F.coalesce("n", F.lit(0)))
        )
        .select("session_id", "turn")
    )
