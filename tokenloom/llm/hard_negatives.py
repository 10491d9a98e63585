"""Hard-negative mining with exact integer scores from a residue-number-system product.

Components are cut to integers, ``floor(scale * x)``.  A block of rows and a slice of
anchors are reduced modulo several small primes, the residue matrices are multiplied in
float32 (every partial sum stays below 2**24, so each product is exact), and the signed
inner products are put together again by Chinese remaindering with balanced mixed-radix
digits.  How many primes are taken follows from the lengths of the vectors, so a score
is exact whatever the scale.

Two passes over the rows.  The first keeps, for each anchor, the best rows of its own
label in each block; their ranks over all blocks give the positives.  Every positive
then opens a window of scores, and the second pass keeps, for each window, the best rows
of other labels in each block.  Rows are dealt to blocks of about ``BLOCK`` rows by hash,
whatever their label; the anchors travel to the blocks, so rows are shuffled once a pass.
A task holds one block and one Arrow batch of anchors.

Results for odd input: rows without id, label or vector and rows with a NULL or
non-finite component (or one that is not finite when scaled) take no part; vectors meet
only vectors of their own length; an empty vector scores 0; rows that repeat an id are
rows of their own, and each of them that is an anchor gives its own result rows; ties go
to the smaller id; scores beyond 64 bits count as the largest (or smallest) long; a
positive with a negative score has an empty window; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenloom.session import stage

BLOCK = 8_192
#: Anchors multiplied with a block at once.
SLICE = 256
#: Largest sum of float32 products that is still exact.
EXACT = 1 << 24
_LOWEST = np.iinfo(np.int64).min


def small_primes(limit: int = 256) -> list[int]:
    """Odd primes below ``limit``, largest first."""
    return [p for p in range(limit - 1, 2, -1) if all(p % q for q in range(2, int(p**0.5) + 1))]


def moduli(bound: float) -> list[int]:
    """So many primes that signed values up to ``bound`` differ in some residue."""
    out, product = [], 1
    for p in small_primes():
        out.append(p)
        product *= p
        if product > 2 * int(bound) + 2:
            return out
    raise OverflowError("the vectors are too long for the primes below 256")


def _balanced(x: np.ndarray, p: int) -> np.ndarray:
    """Residues of whole numbers in ``[-(p - 1) / 2, (p - 1) / 2]``."""
    r = np.fmod(x, p)
    r -= p * (r > p // 2)
    r += p * (r < -(p // 2))
    return r


def _product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """``a @ b.T`` modulo ``p``, balanced, of balanced float32 residues."""
    depth = (EXACT - 1) // (p // 2) ** 2 - 1
    total = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, a.shape[1], depth):
        total = _balanced(total + a[:, at : at + depth] @ b[:, at : at + depth].T, np.float32(p))
    return total.astype(np.int32)


class Residues:
    """The residues of one integer matrix, made once for each prime that is asked for."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.length = float(np.sqrt((rows * rows).sum(axis=1)).max()) if rows.size else 0.0
        self._made: dict[int, np.ndarray] = {}

    def __getitem__(self, p: int) -> np.ndarray:
        if p not in self._made:
            self._made[p] = _balanced(self.rows, p).astype(np.float32)
        return self._made[p]


def inner_products(a: Residues, b: Residues) -> np.ndarray:
    """Exact inner products of all rows of two integer matrices, as int64 (saturated)."""
    bound = a.length * b.length * (1 + 1e-9) + 1
    primes = moduli(bound)
    digits: list[np.ndarray] = []
    value = np.zeros((len(a.rows), len(b.rows)), np.int64)
    radix, about = 1, np.zeros(value.shape) if bound >= 2**62 else None
    for k, p in enumerate(primes):
        digit = _product(a[p], b[p], p)
        for q, known in zip(primes[:k], digits):
            digit = _balanced((digit - known) * pow(q, -1, p), p)
        digits.append(digit)
        # The value fits into 64 bits (else ``about`` tells), so wrapping on the way does no harm.
        value += digit * np.array(radix % (1 << 64), np.uint64).view(np.int64)
        if about is not None:
            about += digit * float(radix)
        radix *= p
    if about is not None:
        top = np.iinfo(np.int64).max
        over = (np.abs(about) > 9.3e18) | (np.abs(about) > 9.2e18) & ((about > 0) != (value > 0))
        value = np.where(over, np.where(about > 0, top, -top), value)
    return value


def _keys(scores: np.ndarray) -> np.ndarray:
    """Distinct numbers in each row of ``scores``: larger for higher scores, then for earlier columns."""
    n = scores.shape[1]
    if not scores.size or max(abs(int(scores.max())), abs(int(scores.min()))) < (1 << 61) // (n + 1):
        return scores * n - np.arange(n)
    order = np.argsort(-scores, axis=1, kind="stable")
    keys = np.empty_like(scores)
    np.put_along_axis(keys, order, np.broadcast_to(np.arange(n, 0, -1), scores.shape), axis=1)
    return keys


def _best(keys: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` largest allowed keys of each row (all, if fewer)."""
    keys = np.where(allowed, keys, _LOWEST)
    n = keys.shape[1]
    cols = np.argpartition(keys, n - k, axis=1)[:, n - k :] if k < n else np.broadcast_to(np.arange(n), keys.shape)
    rows, at = np.nonzero(np.take_along_axis(keys, cols, 1) != _LOWEST)
    return rows, cols[rows, at]


def _matrix(column: pa.Array, scale: int) -> np.ndarray:
    """A list column of equally long vectors as whole numbers."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(values * scale).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """``(row, vec_id, label, size, embedding)`` of the rows that take part, written once."""
    fine = F.forall(
        "embedding", lambda x: F.coalesce(F.abs(x.cast("double") * scale) < float("inf"), F.lit(False)) & ~F.isnan(x)
    )
    rows = vectors.where("vec_id is not null and label is not null and embedding is not null").where(fine)
    return stage(
        rows.select(
            F.monotonically_increasing_id().alias("row"),
            "vec_id",
            F.col("label").cast("long").alias("label"),
            F.size("embedding").alias("size"),
            "embedding",
        )
    )


def _against(rows: DataFrame, anchors: DataFrame, blocks: int, fold, schema: str, scale: int) -> DataFrame:
    """``fold(block, slice)`` for every block of rows and every batch of anchors of the same length.

    Both go by block and length; within them the rows come first, in the order of their ids.
    """
    empty = F.array().cast("array<long>")
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    names = ["row", "vec_id", "label", "embedding"]
    at_home = rows.select(block.alias("block"), "size", F.lit(0).alias("kind"), *names, empty.alias("low"), empty.alias("high"))
    sent = anchors.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        "size", F.lit(1).alias("kind"), *names, "low", "high",
    )
    both = at_home.unionByName(sent).repartition("block", "size")
    both = both.sortWithinPartitions("block", "size", "kind", "vec_id", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, residues = None, [], None
        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names}
            heads = np.stack([columns[n].to_numpy() for n in ("block", "size", "kind")], 1)
            cuts = np.flatnonzero((heads[1:] != heads[:-1]).any(axis=1)) + 1 if len(heads) else []
            for x, y in zip([0, *cuts], [*cuts, len(heads)] if len(heads) else []):
                b, size, kind = heads[x].tolist()
                if place != (b, size):
                    place, held, residues = (b, size), [], None
                part = {n: c.slice(x, y - x) for n, c in columns.items()}
                ids = {n: part[n].to_numpy() for n in ("row", "vec_id", "label")}
                ids["matrix"] = _matrix(part["embedding"], scale).reshape(y - x, size)
                if not kind:
                    held.append(ids)
                    continue
                if not held:
                    continue
                if residues is None:
                    home = {n: np.concatenate([h[n] for h in held]) for n in held[0]}
                    residues = Residues(home.pop("matrix"))
                for i in range(0, y - x, SLICE):
                    some = {n: v[i : i + SLICE] for n, v in ids.items()}
                    some |= {n: part[n].slice(i, SLICE) for n in ("low", "high")}
                    scores = inner_products(Residues(some.pop("matrix")), residues)
                    yield from fold(home, some, scores)

    return both.mapInArrow(run, schema)


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The ``k`` best rows of each group, numbered from 1."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame,
    anchor: Column | None = None,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    block: int = BLOCK,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``vectors`` has ``vec_id``, ``label`` and ``embedding``; ``anchor`` tells the anchors
    (default: every row whose id is divisible by 100).  An anchor's positives are its
    first ``positives`` other rows of the same label; a negative has another label and a
    score of at least ``low`` and at most ``high`` per cent of the positive's.
    """
    rows = usable(vectors, scale)
    blocks = max(1, -(-rows.count() // block))
    none = F.lit(None).cast("array<long>")
    chosen = rows.where(F.col("vec_id") % 100 == 0 if anchor is None else anchor)
    chosen = chosen.withColumn("low", none).withColumn("high", none)

    def same(home, some, scores):
        allowed = (some["label"][:, None] == home["label"]) & (some["row"][:, None] != home["row"])
        a, b = _best(_keys(scores), allowed, positives)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some["row"][a]), pa.array(some["vec_id"][a]), pa.array(home["row"][b])]
            + [pa.array(home["vec_id"][b]), pa.array(scores[a, b])],
            names=["anchor", "anchor_id", "row", "vec_id", "score"],
        )

    schema = "anchor long, anchor_id long, row long, vec_id long, score long"
    near = _against(rows, chosen, blocks, same, schema, scale)
    near = stage(_first(near, ["anchor"], positives).where("score >= 0"))
    # Whole scores n with low * p <= 100 * n <= high * p.
    wide = F.col("score").cast("decimal(38,0)")
    start, stop = F.ceil(wide * low / 100), F.floor(wide * high / 100)
    windows = near.groupBy("anchor").agg(
        F.sort_array(F.collect_list(F.struct("rank", start.cast("long").alias("l"), stop.cast("long").alias("h")))).alias("w")
    )
    windows = windows.select(F.col("anchor").alias("row"), F.col("w.l").alias("low"), F.col("w.h").alias("high"))
    windowed = chosen.drop("low", "high").join(windows, "row")

    def other(home, some, scores):
        keys, differs = _keys(scores), some["label"][:, None] != home["label"]
        sizes = np.diff(some["low"].offsets.to_numpy())
        lows, highs = (some[n].flatten().to_numpy() for n in ("low", "high"))
        begins = np.cumsum(sizes) - sizes
        for j in range(int(sizes.max(initial=0))):
            has = np.flatnonzero(sizes > j)
            at, s = begins[has] + j, scores[has]
            allowed = differs[has] & (s >= lows[at][:, None]) & (s <= highs[at][:, None])
            a, b = _best(keys[has], allowed, negatives)
            yield pa.RecordBatch.from_arrays(
                [pa.array(some["row"][has][a]), pa.array(np.full(len(a), j + 1, np.int32)), pa.array(home["row"][b])]
                + [pa.array(home["vec_id"][b]), pa.array(s[a, b])],
                names=["anchor", "positive", "row", "vec_id", "score"],
            )

    schema = "anchor long, positive int, row long, vec_id long, score long"
    far = _first(_against(rows, windowed, blocks, other, schema, scale), ["anchor", "positive"], negatives)
    far = far.select(
        "anchor", "positive", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    named = near.select(
        "anchor", "anchor_id", F.col("rank").alias("positive"), F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score"),
    )
    return far.join(named, ["anchor", "positive"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
