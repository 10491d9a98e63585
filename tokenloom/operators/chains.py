"""Reconstruction of graph logs: the ancestor chain of a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.operators.turns import occupies_context
from tokenloom.plans.dag import ancestor_totals, chain_members, jump_tables
from tokenloom.plans.forest import intervals, path_sums, way_up, within
from tokenloom.schema import SESSION
from tokenloom.session import cut


def link_parents(events: DataFrame) -> DataFrame:
    """Add ``parent_seq``: the last record that carries the parent's uuid."""
    by_uuid = (
        events.where(F.col("uuid").isNotNull())
        .groupBy(*SESSION, F.col("uuid").alias("parent_uuid"))
        .agg(F.max("seq").alias("parent_seq"))
    )
    return events.join(by_uuid, [*SESSION, "parent_uuid"], "left")


def _side() -> Column:
    return F.coalesce(F.col("is_sidechain"), F.lit(False))


def chain_nodes(linked: DataFrame) -> DataFrame:
    """The node table: a compaction ends every walk that reaches it."""
    return linked.select(
        *SESSION,
        F.col("seq").alias("node"),
        F.col("parent_seq").alias("parent"),
        (F.col("kind") == "compacted").alias("stop"),
        "turn",
        _side().alias("side"),
        (occupies_context()).alias("occupies"),
        (F.col("raw_type") == "assistant").alias("is_response"),
        F.coalesce("char_len", F.lit(0)).cast("bigint").alias("chars"),
    )


def chain_totals(nodes: DataFrame) -> DataFrame:
    """Characters and items of the whole chain of every node, per thread side."""
    counted = F.col("occupies")
    side = F.col("side")
    return ancestor_totals(
        nodes,
        SESSION,
        {
            "main_chars": F.when(counted & ~side, F.col("chars")),
            "main_items": F.when(counted & ~side, 1),
            "side_chars": F.when(counted & side, F.col("chars")),
            "side_items": F.when(counted & side, 1),
        },
    )


def graph_members(linked: DataFrame, turns: DataFrame) -> DataFrame:
    """(turn, record) pairs of the requested turns: exactly what each request carried.

    Columns: session, ``turn``, ``seq``, ``distance``.  The request's own
    response is cut off, other-thread records are stepped over, and turns
    whose chain is circular have no rows (see
    :func:`unavailable_turns`).
    """
    nodes = cut(chain_nodes(linked))
    resolved = chain_totals(nodes).where("resolved").select(*SESSION, "node")
    anchors = turns.select(*SESSION, F.col("turn").alias("want"), F.col("anchor_seq").alias("node"), "response_start_seq")
    starts = anchors.join(resolved, [*SESSION, "node"])
    tables = jump_tables(nodes, SESSION)
    reached = chain_members(starts, SESSION, ["want", "response_start_seq"], tables)
    seen = reached.join(nodes, [*SESSION, "node"])
    anchor_side = (
        starts.join(nodes.select(*SESSION, "node", F.col("side").alias("want_side")), [*SESSION, "node"])
        .select(*SESSION, "want", "want_side")
    )
    seen = seen.join(anchor_side, [*SESSION, "want"]).where(
        ~F.col("stop") & (F.col("side") == F.col("want_side"))
    )
    own = (
        F.col("is_response")
        & (F.col("turn") == F.col("want"))
        & (F.col("node") >= F.col("response_start_seq"))
    )
    tops = seen.where(own).groupBy(*SESSION, "want").agg(F.max("distance").alias("top"))
    return (
        seen.join(tops, [*SESSION, "want"], "left")
        .where(F.col("distance") > F.coalesce("top", F.lit(-1)))
        .where("occupies")
        .select(*SESSION, F.col("want").alias("turn"), F.col("node").alias("seq"), "distance", "chars")
    )


def numbered_nodes(linked: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The node table with chain totals and interval numbers, and its jump tables.

    A compaction is the root of what follows it.  Nodes on or below a circle have
    ``resolved = false`` and no numbers.
    """
    nodes = cut(chain_nodes(linked))
    known = cut(nodes.join(chain_totals(nodes), [*SESSION, "node"]))
    forest = known.where("resolved").select(
        *SESSION, "node", F.when(~F.col("stop"), F.col("parent")).alias("parent"), F.lit(False).alias("stop")
    )
    forest = cut(forest)
    tables = jump_tables(forest, SESSION)
    return cut(known.join(intervals(forest, SESSION, tables), [*SESSION, "node"], "left")), tables


def turn_bases(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """Where each request's chain begins: the record just above its own response.

    Own records are those of the turn on the anchor's chain and thread, from the start of
    the response on; the topmost of them is cut off with all below.  Without any the
    chain begins at the anchor itself.  Columns: session, ``turn``, ``side``,
    ``available``, ``compaction_seq``, ``base`` and ``base_entry`` (NULL: nothing held).
    """
    at = nodes.select(
        *SESSION,
        F.col("node").alias("anchor_seq"),
        F.col("side").alias("anchor_side"),
        F.col("entry").alias("anchor_entry"),
        F.col("resolved").alias("available"),
        F.col("stop_at").alias("compaction_seq"),
    )
    placed = turns.select(*SESSION, "turn", "anchor_seq", "response_start_seq").join(at, [*SESSION, "anchor_seq"])
    placed = cut(placed)
    own = nodes.where("is_response and not stop").join(placed, [*SESSION, "turn"])
    own = own.where(
        (F.col("node") >= F.col("response_start_seq"))
        & (F.col("side") == F.col("anchor_side"))
        & within(F.col("anchor_entry"), F.col("entry"), F.col("end"))
    )
    tops = own.groupBy(*SESSION, "turn").agg(F.min_by(F.struct("parent"), "depth").alias("top"))
    start = F.when(F.col("top").isNotNull(), F.col("top.parent")).otherwise(F.col("anchor_seq"))
    based = placed.join(tops, [*SESSION, "turn"], "left").withColumn("base", F.when(F.col("available"), start))
    entries = nodes.select(*SESSION, F.col("node").alias("base"), F.col("entry").alias("base_entry"))
    return based.join(entries, [*SESSION, "base"], "left").select(
        *SESSION, "turn", F.col("anchor_side").alias("side"), "available", "compaction_seq", "base", "base_entry"
    )


def base_sizes(nodes: DataFrame, bases: DataFrame) -> DataFrame:
    """Prompt size of every turn without listing its records: the chain total of its base."""
    totals = nodes.select(
        *SESSION, F.col("node").alias("base"), "main_chars", "main_items", "side_chars", "side_items"
    )
    zero = F.lit(0).cast("bigint")
    pick = lambda kind: F.coalesce(
        F.when(F.col("side"), F.col(f"side_{kind}")).otherwise(F.col(f"main_{kind}")), zero
    )
    return bases.join(totals, [*SESSION, "base"], "left").select(
        *SESSION,
        "turn",
        "available",
        F.when(F.col("available"), pick("chars")).alias("context_chars"),
        F.when(F.col("available"), pick("items")).alias("context_items"),
        F.when(F.col("available"), F.col("compaction_seq")).alias("compaction_seq"),
    )


def graph_context_sizes(linked: DataFrame, turns: DataFrame) -> DataFrame:
    """Prompt sizes of the given turns of a log."""
    nodes, _ = numbered_nodes(linked)
    return base_sizes(nodes, turn_bases(nodes, turns))


def members_at(nodes: DataFrame, bases: DataFrame, pool: DataFrame) -> DataFrame:
    """Items of the prompts of some turns, by the interval test alone.

    One row per turn and item, so pass only the turns wanted; the join is on the session,
    with as many partners for a record as its session has wanted turns.
    """
    wanted = bases.select(*SESSION, "turn", F.col("side").alias("turn_side"), "base_entry").where("base_entry is not null")
    held = nodes.where("occupies and not stop and entry is not null").drop("turn").join(wanted, SESSION)
    held = held.where(within(F.col("base_entry"), F.col("entry"), F.col("end")) & (F.col("side") == F.col("turn_side")))
    return pool.join(held.select(*SESSION, F.col("node").alias("seq"), "turn"), [*SESSION, "seq"])


def category_sums(nodes: DataFrame, bases: DataFrame, pool: DataFrame) -> DataFrame:
    """Characters and items of each category in the prompt of *every* turn, without listing prompts."""
    places = nodes.where("occupies and not stop and entry is not null").select(
        *SESSION, "side", F.col("node").alias("seq"), "entry", "end"
    )
    weights = pool.join(places, [*SESSION, "seq"]).select(
        *SESSION, "side", "category", "entry", "end", F.col("char_len").alias("chars"), F.lit(1).cast("bigint").alias("items")
    )
    points = bases.select(*SESSION, "side", "turn", F.col("base_entry").alias("entry"))
    return path_sums(weights, points, [*SESSION, "side"], "category", ["chars", "items"]).where("items > 0")


def presence_changes(nodes: DataFrame, tables: list[DataFrame], ordered: DataFrame) -> DataFrame:
    """When each record enters a prompt and when it is held last, without listing prompts.

    ``ordered`` has session, ``side``, ``turn``, ``ordinal``, ``base``, ``base_entry`` and the
    ``base_entry`` of the thread's neighbouring turns as ``before`` and ``after``.  What two
    prompts of a thread share is the chain of the node where their chains meet, so
    records enter on the way from a turn's base up to where the turn before joins, and
    leave on the way up to where the turn after does.  Returns session, ``seq``, ``side``,
    ``turn``, ``ordinal``, ``enters``: as many rows as stretches have ends.
    """
    label = ["turn", "ordinal", "side", "enters"]
    ends = [
        ordered.where("base is not null").select(
            *SESSION, "turn", "ordinal", "side", F.col("base").alias("node"), F.col(c).alias("other"), F.lit(e).alias("enters")
        )
        for c, e in (("before", True), ("after", False))
    ]
    numbers = nodes.where("entry is not null")
    reached = way_up(ends[0].unionByName(ends[1]), SESSION, label, tables, numbers)
    held = nodes.where("occupies and not stop").select(*SESSION, "node", F.col("side").alias("own_side"))
    return (
        reached.join(held, [*SESSION, "node"])
        .where(F.col("side") == F.col("own_side"))
        .select(*SESSION, F.col("node").alias("seq"), *label)
    )


def unavailable_turns(sizes: DataFrame) -> DataFrame:
    """Turns whose parent chain is circular."""
    return sizes.where(~F.col("available")).select(*SESSION, "turn")
