"""Prefix trie of conversations: balanced parentheses per shard, shared spines merged.

The shared first turns of conversations could be processed once; the trie says where and
what that saves.  A node is a distinct sequence of first turns; it is named by its depth
and by 128 bits over its turns and their places, a running XOR, so that a conversation
of any length is numbered in blocks and no prefix is ever spelled out.

1. *Nodes* are counted by plain grouping: members, smallest member, children.
2. A node whose members all go on the same way is passed through; the others are
   *tails*.  Each chain of nodes ends in one tail.  A path with ``k`` tails needs ``k``
   other conversations that leave it at different depths, so paths are lists of at most
   about ``sqrt(2 * turns)`` tails, however long the conversations are.
3. Distinct paths are sorted by the names of their tails, cut into *shards*, and each
   shard's tree is written as balanced parentheses.  Range min-max blocks over the
   excess find the parenthesis that closes a node, which delimits its subtree; rank over
   leaf pairs counts leaves, and a cumulative array of the chains' savings is
   subtracted at both ends.
4. A node at the edge of a shard (its spine) goes on in others.  Every chain counts in
   one shard only, the one that holds the path of its smallest member, so partial sums of
   the same tail add up to the whole.

Results for odd input: rows without ``conv_id`` are left out; NULL role or text is
empty; turns go by turn number, NULL first, equal ones by a digest of role and text;
repeated rows are repeated turns; a conversation that loses all its turns in
:func:`rebuild` is a member of the root; an empty table gives no rows.  Members that end
at one node are hashed in one stream, in order, from packed runs of ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenloom.plans.scan import next_known, running, running_sum
from tokenloom.session import stage

#: Turns of one conversation in one window, and joined under one key.
BLOCK = 1_024
#: Paths of one tree of parentheses, and ids in one packed run.
SHARD, RUN = 65_536, 4_096
#: Parentheses of one block of the range min-max tree.
PARENS = 64


class Parentheses:
    """A sequence of +1 (open) and -1 (close) with its excess in range min-max blocks."""

    def __init__(self, steps: np.ndarray):
        self.steps = steps
        self.excess = np.cumsum(steps, dtype=np.int64)
        blocks = max(1, -(-len(steps) // PARENS))
        width = 1 << (blocks - 1).bit_length()
        padded = np.full(width * PARENS, np.iinfo(np.int64).max)
        padded[: len(steps)] = self.excess
        self.width = width
        # A heap: node 1 covers everything, the blocks are the nodes from ``width`` on.
        self.low = np.empty(2 * width, np.int64)
        self.low[width:] = padded.reshape(width, PARENS).min(axis=1)
        for level in range(width.bit_length() - 1, 0, -1):
            half = 1 << (level - 1)
            self.low[half : 2 * half] = np.minimum(self.low[2 * half : 4 * half : 2], self.low[2 * half + 1 : 4 * half : 2])

    def _in_block(self, start: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """First place from ``start`` to the end of its block where the excess is at most ``goal``, else -1."""
        found = np.full(len(start), -1, np.int64)
        ends = np.minimum((start // PARENS + 1) * PARENS, len(self.steps))
        live, at = np.arange(len(start)), start.copy()
        while len(live):
            inside = at < ends[live]
            live, at = live[inside], at[inside]
            hit = self.excess[at] <= goal[live]
            found[live[hit]] = at[hit]
            live, at = live[~hit], at[~hit] + 1
        return found

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        """The place of the parenthesis that closes each of ``opens``."""
        goal = self.excess[opens] - 1
        found = self._in_block(opens + 1, goal)
        # A parenthesis that ends a block starts its search in the next one.
        left = np.flatnonzero(found < 0)
        node = opens[left] // PARENS + self.width
        climbing = np.arange(len(left))
        while len(climbing):
            n = node[climbing]
            right = n | 1
            here = (n % 2 == 0) & (self.low[right] <= goal[left[climbing]])
            node[climbing] = np.where(here, right, n >> 1)
            climbing = climbing[~here]
        while (node < self.width).any():
            inner = node < self.width
            first = 2 * node[inner]
            node[inner] = np.where(self.low[first] <= goal[left[inner]], first, first + 1)
        found[left] = self._in_block((node - self.width) * PARENS, goal[left])
        return found


def subtree_sums(lengths: np.ndarray, names: np.ndarray, weight: np.ndarray, leaf: np.ndarray):
    """Sums over the subtrees of the trie of some sorted paths.

    Path ``i`` has ``lengths[i]`` tails; ``names`` (two numbers a tail), ``weight`` and
    ``leaf`` are laid one path after another, with the weight of a tail only where it
    counts and ``leaf`` at the end of paths that nothing goes on from.  Returns the place
    of each node's first tail, and its leaves and its summed weight.
    """
    starts = np.cumsum(lengths) - lengths
    path = np.repeat(np.arange(len(lengths)), lengths)
    level = np.arange(len(names)) - starts[path]
    before = path - 1
    known = (path > 0) & (level < lengths[before])
    twin = np.where(known, starts[before] + level, 0)
    known &= (names == names[twin]).all(axis=1)
    # Tails up to the first that differs from the path before are shared with it.
    shared = np.minimum.reduceat(np.where(known, lengths[path], level), starts)
    fresh = level >= shared[path]
    # Closes of the path before, then opens of this one.
    closes = np.concatenate(([0], lengths[:-1] - shared[1:], lengths[-1:]))
    opens = np.append(lengths - shared, 0)
    steps = np.repeat(np.tile(np.array([-1, 1], np.int8), len(opens)), np.stack((closes, opens), 1).ravel())
    tree = Parentheses(steps)
    place = np.flatnonzero(steps == 1)
    # Nodes are numbered in the order of their opens; tails of later paths find theirs level by level.
    by_level = np.lexsort((path, level))
    opened = np.maximum.accumulate(np.where(fresh[by_level], np.arange(len(names)), 0))
    node = np.empty(len(names), np.int64)
    node[by_level] = (np.cumsum(fresh) - 1)[by_level][opened]
    gain = np.zeros(len(place), np.int64)
    np.add.at(gain, node, weight)
    true_leaf = np.zeros(len(place), bool)
    true_leaf[node[leaf]] = True
    end = tree.findclose(place)
    size = (end - place + 1) // 2
    own = np.arange(len(place))
    pairs = np.concatenate(([0], np.cumsum(true_leaf & (end == place + 1))))
    gains = np.concatenate(([0], np.cumsum(gain)))
    return np.flatnonzero(fresh), node, pairs[own + size] - pairs[own], gains[own + size] - gains[own]


def _digest(role: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)


def turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, place, turn_key, length)``: turns numbered from 0 and known by a digest."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        "conv_id", "turn", _digest(role, text).alias("turn_key"), F.length(text).cast("long").alias("length")
    )
    # Sorted over all partitions, a row's number says its place; a long conversation lies in several.
    rows = rows.repartitionByRange(*[F.asc_nulls_first(c) for c in ("conv_id", "turn", "turn_key")])
    rows = rows.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "turn_key")
    rows = stage(rows.select("conv_id", "turn_key", "length", F.monotonically_increasing_id().alias("row")))
    blocks = F.shiftright("row", BLOCK.bit_length() - 1)
    numbered = running(rows, ["conv_id"], "row", {"place": running_sum(F.lit(1).cast("long"))}, blocks)
    return numbered.select("conv_id", "place", "turn_key", "length")


def _cell(place: Column) -> Column:
    return F.floor(place / BLOCK).cast("long")


def rebuild(turns: DataFrame, base: Column, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first ``head`` turns are those of the conversation ``base``.

    ``base`` and ``head`` (at most ``most``) are expressions over ``conv_id``.  Returns the
    rebuilt turns and ``(conv_id, depth)`` of all conversations, turnless ones too.
    """
    turns = stage(turns)
    known = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    known = known.select("conv_id", "n", base.alias("base"), head.cast("long").alias("head"))
    lent = turns.where(F.col("place") < most).join(
        known.select(F.col("base").alias("conv_id")).distinct(), "conv_id", "left_semi"
    )
    lent = lent.groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("place", "turn_key", "length"))).alias("lent")
    )
    taken = F.slice(F.coalesce("lent", F.array()), F.lit(1), F.col("head").cast("int"))
    known = known.join(lent, "base", "left").withColumn("lent", taken)
    known = stage(known.withColumn("got", F.size("lent").cast("long")))
    first = known.select("conv_id", F.explode("lent").alias("t")).select("conv_id", "t.place", "t.turn_key", "t.length")
    # How far own turns move, once for each stretch of a conversation.
    cells = F.explode(F.sequence(F.lit(0).cast("long"), _cell(F.col("n")))).alias("cell")
    shift = known.select("conv_id", cells, (F.col("got") - F.col("head")).alias("by"))
    own = turns.where(F.col("place") >= head).withColumn("cell", _cell(F.col("place"))).join(shift, ["conv_id", "cell"])
    own = own.select("conv_id", (F.col("place") + F.col("by")).alias("place"), "turn_key", "length")
    depth = F.col("got") + F.greatest(F.col("n") - F.col("head"), F.lit(0))
    return first.unionByName(own), known.select("conv_id", depth.alias("depth"))


def _named(rows: DataFrame) -> DataFrame:
    """Turns with the name ``(x, y)`` of their node and ``(px, py)`` of its parent."""
    rows = rows.withColumn("fx", F.xxhash64("turn_key", "place")).withColumn(
        "fy", F.xxhash64(F.lit("second"), "place", "turn_key")
    )
    rows = rows.withColumn("cell", _cell(F.col("place")))
    so_far = Window.partitionBy("conv_id", "cell").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    inner = rows.select("*", *[F.bit_xor(f"f{c}").over(so_far).alias(f"i{c}") for c in "xy"])
    totals = rows.groupBy("conv_id", "cell").agg(*[F.bit_xor(f"f{c}").alias(f"t{c}") for c in "xy"])
    earlier = Window.partitionBy("conv_id").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        "conv_id", "cell", *[F.coalesce(F.bit_xor(f"t{c}").over(earlier), F.lit(0)).alias(f"c{c}") for c in "xy"]
    )
    named = inner.join(carried, ["conv_id", "cell"])
    for c in "xy":
        named = named.withColumn(c, F.col(f"i{c}").bitwiseXOR(F.col(f"c{c}")))
        named = named.withColumn(f"p{c}", F.col(c).bitwiseXOR(F.col(f"f{c}")))
    return named.select("conv_id", (F.col("place") + 1).alias("depth"), "x", "y", "px", "py", "length")


NODE = ["depth", "x", "y"]


def _nodes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """All nodes: owner (smallest member), members, children, savings, and whether they are tails."""
    zero = F.lit(0).cast("long")
    inner = rows.groupBy(*NODE).agg(
        F.min("conv_id").alias("owner"), F.count("*").alias("members"),
        F.min("px").alias("px"), F.min("py").alias("py"), F.min("length").alias("length"),
    )
    root = convs.agg(F.min("conv_id").alias("owner"), F.count("*").alias("members")).where("members > 0")
    root = root.select(
        zero.alias("depth"), zero.alias("x"), zero.alias("y"), "owner", "members",
        F.lit(None).cast("long").alias("px"), F.lit(None).cast("long").alias("py"), zero.alias("length"),
    )
    nodes = stage(inner.unionByName(root))
    below = nodes.where("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")
    )
    below = below.agg(F.count("*").alias("children"), F.sum("members").alias("go_on"))
    nodes = nodes.drop("px", "py").join(below, NODE, "left").withColumn("children", F.coalesce("children", zero))
    passed = (F.col("children") == 1) & (F.col("go_on") == F.col("members"))
    gain = (F.col("members") - 1) * F.col("length")
    return nodes.select(*NODE, "owner", "members", "children", gain.alias("gain"), (~passed).alias("tail"))


def _ends_digest(ends: DataFrame) -> DataFrame:
    """For each node where conversations end, the SHA-256 of their sorted ids joined by commas."""
    place = [*NODE, "conv_id"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.stack([c.to_numpy() for c in batch.columns], 1)
            new = np.flatnonzero((keys[1:, :3] != keys[:-1, :3]).any(axis=1)) + 1 if len(keys) else []
            cuts = np.unique(np.concatenate((new, np.arange(0, len(keys), RUN)))).astype(int).tolist()
            texts = keys[:, 3].astype(str).tolist()
            runs = [",".join(texts[a:b]) for a, b in zip(cuts, [*cuts[1:], len(keys)])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[cuts, i]) for i in range(4)] + [pa.array(runs, pa.string())], names=[*place, "ids"]
            )

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, sha = None, None
        for batch in batches:
            out = []
            keys = zip(*(batch[c].tolist() for c in NODE))
            for key, ids in zip(keys, batch["ids"]):
                if key == held:
                    sha.update(b"," + ids.encode())
                    continue
                if held is not None:
                    out.append((*held, sha.hexdigest()))
                held, sha = key, hashlib.sha256(ids.encode())
            yield pd.DataFrame(out, columns=[*NODE, "ends"])
        if held is not None:
            yield pd.DataFrame([(*held, sha.hexdigest())], columns=[*NODE, "ends"])

    packed = ends.select(*place).repartitionByRange(*place).sortWithinPartitions(*place)
    packed = packed.mapInArrow(pack, "depth long, x long, y long, conv_id long, ids string")
    packed = packed.repartition(*NODE).sortWithinPartitions(*place)
    return packed.mapInPandas(digest, "depth long, x long, y long, ends string")


def _paths(rows: DataFrame, tails: DataFrame, ends: DataFrame) -> DataFrame:
    """One row a distinct path: its smallest conversation and the lists of its tails."""
    ours = ends.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id")).select("conv_id")
    met = rows.select(*NODE, "conv_id").join(tails.where("depth > 0"), NODE).join(ours, "conv_id", "left_semi")
    # The root is on every path, if it is a tail at all.
    top = tails.where("depth = 0").first()
    on_all = ours.select(*[F.lit(top[c]).alias(c) if c != "conv_id" else F.col(c) for c in met.columns]) if top else None
    met = met.unionByName(on_all) if top else met
    fields = ["depth", "x", "y", "owner", "sum", "children"]
    lists = met.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("path"))
    return lists.select("conv_id", *[F.col(f"path.{f}").alias(f) for f in fields])


def _merged(paths: DataFrame) -> DataFrame:
    """``(owner, tail, leaves, saved, top, sum, above)`` of every tail, from partial sums of all shards."""

    def work(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(rows).combine_chunks()
        flat = {n: whole[n].combine_chunks() for n in whole.column_names}
        conv = flat.pop("conv_id").to_numpy()
        lengths = np.diff(flat["depth"].offsets.to_numpy())
        flat = {n: c.flatten().to_numpy() for n, c in flat.items()}
        path = np.repeat(np.arange(len(conv)), lengths)
        mine = flat["owner"] == conv[path]
        first = np.zeros(len(path), bool)
        first[np.cumsum(lengths) - lengths] = True
        prior = {n: np.where(first, 0, np.roll(c, 1)) for n, c in flat.items()}
        start = np.where(~first & (prior["owner"] == conv[path]), prior["sum"], 0)
        weight = np.where(mine, flat["sum"] - start, 0)
        at, node, leaves, saved = subtree_sums(
            lengths, np.stack((flat["x"], flat["y"]), 1), weight, flat["children"] == 0
        )
        # What lies under the chain itself: the own weight is taken off where it was added.
        own = np.zeros(len(at), np.int64)
        np.add.at(own, node, weight)
        top = np.where(first[at], 0, prior["depth"][at] + 1)
        above = pa.array(np.where(first[at], 0, prior["owner"][at]), mask=first[at])
        return pa.RecordBatch.from_arrays(
            [pa.array(c) for c in (flat["owner"][at], flat["depth"][at], leaves, saved - own, top, flat["sum"][at])] + [above],
            names=["owner", "tail_depth", "leaves", "below", "top", "sum", "above"],
        )

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= SHARD:
                yield work(held)
                held = []
        if sum(b.num_rows for b in held):
            yield work(held)

    names = paths.columns
    sharded = paths.withColumn("key", F.arrays_zip("x", "y")).repartitionByRange("key").sortWithinPartitions("key").select(*names)
    parts = sharded.mapInArrow(
        shard, "owner long, tail_depth long, leaves long, below long, top long, sum long, above long"
    )
    # The same tail of several shards: sums add up, the rest is equal.
    return parts.groupBy("owner", "tail_depth").agg(
        F.sum("leaves").alias("leaves"), F.sum("below").alias("below"),
        F.max("top").alias("top"), F.max("sum").alias("sum"), F.max("above").alias("above"),
    )


def trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """One row a node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``rows`` has ``conv_id, place, turn_key, length`` with places from 0 without gaps;
    ``convs`` has ``conv_id, depth`` of all conversations.
    """
    rows, convs = stage(_named(rows)), stage(convs)
    zero = F.lit(0).cast("long")
    nodes = _nodes(rows, convs)
    # Along the nodes of one owner: savings so far, and the next tail.
    nodes = stage(
        running(
            nodes,
            ["owner"],
            "depth",
            {"sum": running_sum(F.col("gain"), inclusive=True), "tail_depth": next_known(F.when(F.col("tail"), F.col("depth")))},
            _cell(F.col("depth")),
        )
    )
    last = rows.join(convs, ["conv_id", "depth"], "left_semi").select("conv_id", *NODE)
    none = convs.where("depth = 0").select("conv_id", "depth", zero.alias("x"), zero.alias("y"))
    ends = stage(last.unionByName(none))
    tails = nodes.where("tail").select(*NODE, "owner", "sum", "children")
    found = stage(_merged(_paths(rows, tails, ends)))
    stretches = F.explode(F.sequence(_cell(F.col("top")), _cell(F.col("tail_depth"))))
    found = found.withColumnRenamed("sum", "tail_sum").withColumn("cell", stretches)
    whole = nodes.withColumn("cell", _cell(F.col("depth"))).join(found, ["owner", "tail_depth", "cell"])
    whole = whole.join(_ends_digest(ends), NODE, "left")
    parent = F.when(F.col("depth") > 0, F.when(F.col("depth") == F.col("top"), F.col("above")).otherwise(F.col("owner")))
    return whole.select(
        F.col("owner").alias("conv_id"),
        "depth",
        parent.alias("parent_conv_id"),
        F.col("members").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("below") + F.col("tail_sum") - F.col("sum") + F.col("gain")).alias("saved_tokens"),
        F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
