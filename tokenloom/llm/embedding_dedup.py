"""Embedding near-dedup by Euclidean p-stable hashing.

Vectors are scaled to length one, where a cosine of at least ``c`` is a distance of at
most ``sqrt(2 - 2c)``.  A table hashes a vector by ``PROJECTIONS`` random Gaussian
projections, shifted and cut into steps of ``STEP``; vectors that agree in all of them
meet in a bucket and are compared exactly.  With the numbers below two vectors just at
0.95 share at least one of 60 buckets with probability 0.95 or more, random ones in 64
dimensions one table in several million.

Equal vectors are folded to one first, so copies cost nothing.  Buckets of more than
``TILE`` vectors are cut into tiles, and each pair of tiles is a task's work of its own.
A task sends no pairs: for every vector how many others it is linked with, counting a
pair only in the first table that it shares, and the links that join its groups.

Results for odd input: vectors that are NULL, zero, or hold NULL or non-finite numbers
link with nothing and are their own component; vectors of another length link only
among their own length; rows that repeat an id are linked vectors of one component;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import mix
from tokenloom.llm.components import components
from tokenloom.session import stage

TABLES, PROJECTIONS, STEP, SEED = 60, 22, 2.0, 7
TILE = 2048


class Hasher:
    """Bucket numbers of unit vectors in all tables; the projections follow from the seed."""

    def __init__(self, tables: int, projections: int, step: float):
        self.tables, self.projections, self.step = tables, projections, step
        self._made: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __call__(self, units: np.ndarray) -> np.ndarray:
        size = units.shape[1]
        if size not in self._made:
            rng = np.random.default_rng((SEED, size))
            n = self.tables * self.projections
            self._made[size] = rng.standard_normal((size, n)), rng.uniform(0, self.step, n)
        lines, shift = self._made[size]
        cells = np.floor((units @ lines + shift) / self.step).astype(np.int64).view(np.uint64)
        cells = cells.reshape(len(units), self.tables, self.projections)
        key = np.full((len(units), self.tables), size, np.uint64) + np.arange(self.tables, dtype=np.uint64)
        for i in range(self.projections):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, i])
        return key.view(np.int64)


def _units(vectors) -> np.ndarray:
    rows = np.stack([np.asarray(v, np.float64) for v in vectors])
    # Scaled by the largest part first, so that no square over- or underflows.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each node's group in a small graph."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def neighbours(kinds: DataFrame, cosine: float, hasher: Hasher) -> DataFrame:
    """Of distinct vectors ``(rep, embedding, copies)``: rows ``(node, other, n)``.

    ``n`` is how many vectors (copies counted) ``node`` is linked with in one tile; it is
    0 in rows that are joining links ``node - other``.  No value is NULL, since a column
    with NULLs would go through doubles, which round large numbers.
    """

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby(batch["embedding"].map(len)):
                keys = hasher(_units(part["embedding"]))
                yield pd.DataFrame(
                    {
                        "key": keys.ravel(),
                        "slot": np.tile(np.arange(hasher.tables, dtype=np.int32), len(part)),
                        "rep": np.repeat(part["rep"].to_numpy(), hasher.tables),
                    }
                )

    signed = stage(kinds.select("rep", "embedding").mapInPandas(sign, "key long, slot int, rep long"))
    full = signed.groupBy("key", "slot").count().where("count > 1")
    full = stage(full.withColumn("tiles", F.ceil(F.col("count") / TILE).cast("int")))
    members = signed.join(full, ["key", "slot"]).withColumn(
        "tile", F.pmod(F.xxhash64("rep", "key"), F.col("tiles")).cast("int")
    )
    # A tile of a bucket of n tiles meets all n: as the left one of later tiles and the right one of earlier ones.
    pairs = members.select(
        "key", "slot", "rep", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("with")
    ).select("key", "slot", "rep", "tile", F.least("tile", "with").alias("i"), F.greatest("tile", "with").alias("j"))
    ready = pairs.join(kinds, "rep").repartition("key", "slot", "i", "j").sortWithinPartitions("key", "slot", "i", "j")

    def work(slot: int, ids, weight, units, at_left, at_right) -> tuple[np.ndarray, ...]:
        close = np.zeros((len(ids), len(ids)), bool)
        close[np.ix_(at_left, at_right)] = units[at_left] @ units[at_right].T >= cosine
        a, b = np.nonzero(np.triu(close | close.T, 1))
        if not len(a):
            return ()
        keys = hasher(units)[:, :slot]
        fresh = ~(keys[a] == keys[b]).any(axis=1) if slot else np.ones(len(a), bool)
        count = np.bincount(a[fresh], weight[b[fresh]], len(ids)) + np.bincount(b[fresh], weight[a[fresh]], len(ids))
        root = _roots(len(ids), a, b)
        some, moved = np.flatnonzero(count), np.flatnonzero(root != np.arange(len(ids)))
        counts = np.stack((ids[some], ids[some], count[some].astype(np.int64)))
        return counts, np.stack((ids[moved], ids[root[moved]], np.zeros(len(moved), np.int64)))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, names = None, ["key", "slot", "i", "j"]
        for batch in batches:
            rows = batch if kept is None else pd.concat([kept, batch])
            last = (rows[names] == rows[names].iloc[-1]).all(axis=1)
            kept, rows = rows[last], rows[~last]
            yield frame(rows, names)
        if kept is not None:
            yield frame(kept, names)

    def frame(rows: pd.DataFrame, names: list[str]) -> pd.DataFrame:
        out = [np.empty((3, 0), np.int64)]
        group = rows[names].to_numpy(np.int64)
        heads = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]).any(axis=1)))) if len(rows) else []
        ids, weight, tile = (rows[c].to_numpy() for c in ("rep", "copies", "tile"))
        vectors = rows["embedding"].to_numpy()
        for x, y in zip(heads, np.append(heads[1:], len(rows))):
            if y - x > 1:
                _, slot, i, j = group[x].tolist()
                part = slice(x, y)
                out += work(slot, ids[part], weight[part], _units(vectors[part]), tile[part] == i, tile[part] == j)
        return pd.DataFrame(np.concatenate(out, axis=1).T, columns=["node", "other", "n"])

    return ready.mapInPandas(compare, "node long, other long, n long")


def link(vectors: DataFrame, cosine: float = 0.95, tables: int = TABLES) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row with an id."""
    rows = vectors.where("vec_id is not null").select("vec_id", "embedding")
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = good & F.exists("embedding", lambda x: x != 0)
    kinds = rows.where(usable).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    # One id may stand for several vectors; those are kept apart by a number of their own.
    kinds = stage(kinds.withColumn("kind", F.xxhash64("embedding")))
    numbered = kinds.select(F.col("kind").alias("rep"), "embedding", "copies")
    found = stage(neighbours(numbered, cosine, Hasher(tables, PROJECTIONS, STEP)))
    counts = found.where("n > 0").groupBy("node").agg(F.sum("n").alias("near"))
    member = rows.where(usable).join(kinds, "embedding").select("vec_id", "kind", "copies")
    member = stage(member.join(stage(counts), member["kind"] == F.col("node"), "left"))
    names = kinds.select("kind", "rep")
    joins = found.where("n = 0").select("node", "other")
    a, b = names.toDF("node", "a"), names.toDF("other", "b")
    links = joins.join(a, "node").join(b, "other").select("a", "b")
    same = member.join(names, "kind").where("vec_id != rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    groups = components(links.union(same))
    linked = member.groupBy("vec_id").agg(
        F.max(F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links")
    )
    out = rows.select("vec_id").join(linked, "vec_id", "left").join(
        stage(groups.withColumnRenamed("node", "vec_id")), "vec_id", "left"
    )
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (component == F.col("vec_id")).alias("kept"),
    )
