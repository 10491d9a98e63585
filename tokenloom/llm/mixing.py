"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree.

Every source is cut into blocks of about equal size by a hash of its documents, and
its target is an exact quota of blocks: whole passes over the source, then a part of
one more.  The blocks of all sources are split over the output shards by a binary
tree.  A node holds a number of blocks of each source; its left child draws its half
without replacement, source after source, each count from the hypergeometric
distribution of what is left.  A leaf is a shard with exact counts of each source; it
takes the next so many blocks in the permuted order of the source, so shards are
disjoint, and orders its documents by a hash.

Block counts and the tree are small tables (sources x shards); documents are only
joined to their block.  Everything is column expressions.

Results for odd input: NULL text has size 0 and is taken 0 words; NULL is a source of
its own, the last; sources without words get the target 0; rows that repeat an id go
to the same block and are taken alike; rows without id are mixed like others; an
empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import WORD
from tokenloom.session import stage

#: Words of a block, and how often a source may be repeated.
BLOCK_WORDS, CAP = 20_000, 3
#: Words of a shard, so the number of shards grows with the mix.
SHARD_WORDS = 1_000_000


def sized(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size)``; sizes count words."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """``(source, source_size, target)``: shares by weight, none above ``cap`` times its size.

    Resharing what is cut off until nobody is above is filling vessels to one level:
    in order of ``size / weight``, a source is cut off if the level that the rest would
    share is above its own brim.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = total.withColumn("weight", F.get(cycle, (rank - 1) % len(weights)))
    brim = cap * F.col("source_size") / F.col("weight")
    fill = Window.orderBy("brim", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    onwards = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (
        F.sum("source_size").over(Window.partitionBy()) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    ) / F.sum("weight").over(onwards)
    levelled = weighed.withColumn("brim", brim).withColumn("level", level).withColumn("place", F.row_number().over(fill))
    # The first source whose brim is not below its level sets the level for all after it.
    open_level = F.min(F.when(F.col("level") <= F.col("brim"), F.struct("place", "level"))).over(Window.partitionBy())
    levelled = levelled.withColumn("open", open_level)
    share = F.when(F.col("place") < F.col("open.place"), cap * F.col("source_size").cast("double")).otherwise(
        F.col("open.level") * F.col("weight")
    )
    return levelled.select("source", "source_size", share.alias("target"))


def _log_choose(n: Column, k: Column) -> Column:
    return _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)


def _log_factorial(n: Column) -> Column:
    """Stirling's series at ``n + 8``, divided back; exact to about 1e-12."""
    x = n.cast("double") + 8
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x)
    product = F.lit(0.0)
    for i in range(1, 9):
        product = product + F.log(n.cast("double") + i)
    return series - product


def _draw(total: Column, kind: Column, drawn: Column, chance: Column) -> Column:
    """Hypergeometric quantile: how many of ``kind`` are among ``drawn`` of ``total``."""
    low, high = F.greatest(F.lit(0).cast("long"), drawn + kind - total), F.least(drawn, kind)
    mean = drawn * kind / F.greatest(total, F.lit(1))
    # All of the mass a double can tell lies within twelve deviations of the mean.
    wide = 12 * F.sqrt(mean * (1 - kind / F.greatest(total, F.lit(1))) + 1) + 12
    first = F.greatest(low, F.floor(mean - wide)).cast("long")
    last = F.greatest(first, F.least(high, F.ceil(mean + wide))).cast("long")
    start = F.struct(first.alias("x"), F.lit(0.0).cast("double").alias("sum"))
    step = lambda s, x: F.struct(
        F.when(s["sum"] < chance, x).otherwise(s["x"]).alias("x"),
        (
            s["sum"]
            + F.exp(_log_choose(kind, x) + _log_choose(total - kind, drawn - x) - _log_choose(total, drawn))
        ).alias("sum"),
    )
    return F.aggregate(F.sequence(first, last), start, step, lambda s: s["x"])


def split_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """``(shard, source, blocks)``: exact counts; ``quotas`` is ``(source, quota)``.

    A level turns each node into two.  Sources of a node are drawn one after another:
    how many of this source fall to the left among those that are left to draw.
    """
    node = quotas.agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("source", F.lit("")).alias("name"), "source", "quota"))).alias(
            "held"
        )
    ).select(F.lit(0).alias("shard"), F.lit(shards).alias("leaves"), "held")
    for _ in range(max(0, math.ceil(math.log2(shards)))):
        total = F.aggregate("held", F.lit(0).cast("long"), lambda s, h: s + h["quota"])
        left_leaves = F.floor(F.col("leaves") / 2).cast("int")
        node = node.withColumn("total", total).withColumn("left_leaves", left_leaves)
        node = node.withColumn(
            "drawn", F.round(F.col("total") * F.col("left_leaves") / F.col("leaves")).cast("long")
        )
        start = F.struct(
            F.col("total").alias("total"),
            F.col("drawn").alias("drawn"),
            F.array().cast("array<bigint>").alias("taken"),
        )

        def take(state: Column, held: Column) -> Column:
            word = F.xxhash64(F.lit(seed), F.col("shard"), F.col("leaves"), held["source"])
            chance = F.shiftrightunsigned(word, 11) / float(1 << 53)
            x = _draw(state["total"], held["quota"], state["drawn"], chance)
            return F.struct(
                (state["total"] - held["quota"]).alias("total"),
                (state["drawn"] - x).alias("drawn"),
                F.concat(state["taken"], F.array(x)).alias("taken"),
            )

        taken = F.aggregate("held", start, take, lambda s: s["taken"])
        node = stage(node.withColumn("taken", taken))
        held = lambda count: F.transform(
            F.arrays_zip("held", "taken"),
            lambda z: F.struct(z["held"]["name"].alias("name"), z["held"]["source"].alias("source"), count(z).alias("quota")),
        )
        left = F.struct(F.col("shard"), F.col("left_leaves").alias("leaves"), held(lambda z: z["taken"]).alias("held"))
        right = F.struct(
            (F.col("shard") + F.col("left_leaves")).alias("shard"),
            (F.col("leaves") - F.col("left_leaves")).alias("leaves"),
            held(lambda z: z["held"]["quota"] - z["taken"]).alias("held"),
        )
        both = F.explode(F.filter(F.array(left, right), lambda n: n["leaves"] > 0)).alias("n")
        node = node.select(both).select("n.*")
    return node.select("shard", F.explode("held").alias("h")).select(
        "shard", F.col("h.source").alias("source"), F.col("h.quota").alias("blocks")
    )


def mix_sources(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 1) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken, block, rank)`` of every document."""
    sizes = stage(sized(docs))
    goal = stage(targets(sizes))
    goal = goal.withColumn("n_blocks", F.greatest(F.ceil(F.col("source_size") / block_words), F.lit(1)).cast("long"))
    goal = goal.withColumn(
        "passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    ).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    order = F.xxhash64(F.lit(seed), "doc_id", "size")
    dealt = (
        sizes.join(goal, sizes["source"].eqNullSafe(goal["source"]))
        .drop(goal["source"])
        .withColumn("order", order)
        .withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "order"), F.col("n_blocks")))
    )
    # Blocks of a source in permuted order: what one more pass has taken before each of them.
    blocks = dealt.groupBy("source", "block").agg(F.sum("size").alias("block_size"), F.first("rest").alias("rest"))
    turn = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 2), "source", "block"), "block")
    blocks = blocks.withColumn("rank", F.row_number().over(turn)).withColumn(
        "before", F.sum("block_size").over(turn) - F.col("block_size")
    )
    blocks = stage(blocks.withColumn("state", F.when(F.col("before") >= F.col("rest"), 0).when(
        F.col("before") + F.col("block_size") <= F.col("rest"), 2).otherwise(1)))
    placed = dealt.join(
        blocks.select(F.col("source").alias("s"), F.col("block").alias("b"), "rank", "before", "state"),
        dealt["source"].eqNullSafe(F.col("s")) & (dealt["block"] == F.col("b")),
    ).drop("s", "b")
    # One block of a source is taken in part: its documents in order until the target is met.
    inside = Window.partitionBy("source", "block").orderBy("order", "doc_id", "size")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    cut = placed.where("state = 1").withColumn("done", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.round(F.col("rest")).cast("long") - F.col("before") - F.col("done")))
    whole = F.when(F.col("state") == 2, F.col("size")).otherwise(0)
    keep = ("doc_id", "source", "size", "source_size", "target", "block", "rank", "passes", "order")
    taken = (F.col("passes") * F.col("size") + F.col("extra")).cast("long")
    return (
        cut.select(*keep, part.alias("extra"))
        .union(placed.where("state != 1").select(*keep, whole.alias("extra")))
        .withColumn("taken", taken)
        .drop("extra")
    )


def shard_quotas(mixed: DataFrame, shards: int, seed: int = 1) -> DataFrame:
    """``(shard, source, first, last)``: which draws of a source's permuted blocks a shard takes.

    A source is drawn block by block, pass after pass; a draw is a number from 1 on.
    """
    extra = F.col("taken") > F.col("passes") * F.col("size")
    last_rank = F.coalesce(F.max(F.when(extra, F.col("rank"))), F.lit(0))
    quotas = mixed.groupBy("source").agg((F.max("passes") * F.max("rank") + last_rank).cast("long").alias("quota"))
    quotas = stage(quotas)
    counts = split_tree(quotas, shards, seed)
    by_shard = Window.partitionBy("source").orderBy("shard")
    last = F.sum("blocks").over(by_shard)
    return counts.select("shard", "source", (last - F.col("blocks") + 1).alias("first"), last.alias("last"))


def block_draws(mixed: DataFrame, shards: int, seed: int = 1) -> DataFrame:
    """``(source, rank, drawn)``: pass and shard of every draw of a block, in the order of the passes."""
    blocks = mixed.groupBy(F.col("source").alias("s")).agg(F.max("rank").alias("n_blocks"))
    quotas = shard_quotas(mixed, shards, seed).where("last >= first")
    draws = quotas.select("source", "shard", F.explode(F.sequence("first", "last")).alias("draw"))
    draws = draws.join(stage(blocks), draws["source"].eqNullSafe(F.col("s"))).drop("s")
    lap = F.floor((F.col("draw") - 1) / F.col("n_blocks")).cast("int")
    draws = draws.select("source", "shard", "n_blocks", "draw", lap.alias("pass"))
    draws = draws.withColumn("rank", F.col("draw") - F.col("pass") * F.col("n_blocks"))
    return draws.groupBy("source", "rank").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("drawn"))


def deal(mixed: DataFrame, shards: int, seed: int = 1) -> DataFrame:
    """``mixed`` with ``draws``, that is shard, place in it and words of each time a document is drawn.

    ``taken`` is the sum of the words of the draws.
    """
    drawn = stage(block_draws(mixed, shards, seed)).select(
        F.col("source").alias("s"), F.col("rank").alias("r"), "drawn"
    )
    placed = mixed.join(drawn, mixed["source"].eqNullSafe(F.col("s")) & (mixed["rank"] == F.col("r")), "left")
    extra = F.col("taken") - F.col("passes") * F.col("size")
    draw = lambda d: F.struct(
        d["shard"].alias("shard"),
        F.xxhash64(F.lit(seed + 3), "order", d["pass"]).alias("place"),
        F.when(d["pass"] < F.col("passes"), F.col("size")).otherwise(extra).cast("long").alias("words"),
    )
    none = F.array().cast("array<struct<shard:int,place:bigint,words:bigint>>")
    draws = F.coalesce(F.filter(F.transform("drawn", draw), lambda d: d["words"] > 0), none)
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda s, d: s + d["words"])
    return placed.withColumn("draws", draws).withColumn("taken", taken).select(*mixed.columns, "draws")


def deal_sources(
    docs: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = 1
) -> DataFrame:
    """The mix of :func:`mix_sources`, dealt to as many shards as its words need."""
    mixed = stage(mix_sources(docs, block_words, seed))
    words = mixed.agg(F.coalesce(F.sum("taken"), F.lit(0)).alias("n")).first()["n"]
    return deal(mixed, max(1, math.ceil(words / shard_words)), seed)


def shard_of(mixed: DataFrame, shards: int, seed: int = 1) -> DataFrame:
    """The draws of every document: ``(doc_id, source, shard, place, words)``, one row for each time it is taken."""
    return deal(mixed, shards, seed).select("doc_id", "source", F.inline("draws"))
