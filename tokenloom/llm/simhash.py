"""SimHash near-duplicate groups by pigeonring filtering.

Every document's word shingles vote on the bits of a fingerprint.  Equal
fingerprints are folded to one representative first, so a group of copies, however
large, costs one row.  Distinct fingerprints are cut into a ring of segments.  If
two differ in at most ``t`` of the bits, then from some segment on every chain of
``l`` consecutive segments differs in at most ``l * t / m`` bits (pigeonring); that
chain is what the candidate keys spell out and what the join tests before it counts
all differing bits.

:func:`ring_keys` is exact: with more segments than differing bits the first segment
of such a chain is equal, and of the next segment at least one of ``budget + 1`` parts
is equal.

Near copies by the similarity of shingle sets (:func:`near_duplicates`) meet by the same
chains first, and every candidate is compared shingle by shingle before it links.  Many
near copies differ in so many bits that no chain is selective; what the chains have not
joined meets where it shares a band of MinHash values.

Results for odd input: NULL or blank text has no shingle and the fingerprint zero,
which links like any other; fewer words than a shingle make one shingle of all of
them; rows that repeat an id are rows of one node and each gets a result row; a row
without id is no document and is left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import LOWER, encode, mix, short_batches
from tokenloom.llm.components import components
from tokenloom.plans.skew import broadcast_if_small
from tokenloom.session import stage


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``width`` lower-cased words, in order, repeats included."""
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    width = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[s:e], 42) for s, e in zip(starts, (ends[width - 1 :] - 1).tolist())),
        np.uint64,
        len(words) - width + 1,
    )


def vote(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """``lanes`` 64-bit words; a bit is set when more than half of the hashes set it."""
    out = np.zeros(lanes, np.uint64)
    for lane in range(lanes if len(hashes) else 0):
        h = hashes if lane == 0 else mix(hashes + np.uint64(lane * 0x9E3779B97F4A7C15 % (1 << 64)))
        votes = np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.uint32)
        out[lane] = np.packbits(votes * 2 > len(h), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, width: int, lanes: int = 1) -> DataFrame:
    """``(doc_id, f0 .. f<lanes-1>)`` of every document with an id."""
    names = [f"f{i}" for i in range(lanes)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [vote(shingle_hashes(t, width), lanes) for t in encode(batch["text"])]
            prints = np.array(rows, np.uint64).reshape(-1, lanes).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], **{n: prints[:, i] for i, n in enumerate(names)}})

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in names)
    return short_batches(docs).select("doc_id", "text").where("doc_id is not null").mapInPandas(run, schema)


def _bits(value: Column, start: int, width: int) -> Column:
    """``width`` bits of a 64-bit word from ``start`` on, as a non-negative long."""
    return F.shiftrightunsigned(value, start).bitwiseAND(F.lit((1 << width) - 1))


def ring_keys(value: Column, max_bits: int) -> Column:
    """Exact candidate keys of a 64-bit word for pairs that differ in at most ``max_bits`` bits.

    The ring has ``max_bits + 1`` segments, so some chain starts with an equal
    segment and its first two segments differ in at most ``2 * max_bits / m`` bits.
    """
    m = max_bits + 1
    cuts = [64 * i // m for i in range(m + 1)]
    parts = 2 * max_bits // m + 1
    keys = []
    for i in range(m):
        n = (i + 1) % m
        first = _bits(value, cuts[i], cuts[i + 1] - cuts[i])
        span = cuts[n + 1] - cuts[n]
        for p in range(parts if m > 1 else 1):
            low, high = span * p // parts, span * (p + 1) // parts
            keys.append(
                F.xxhash64(F.lit(i), F.lit(p), first, _bits(value, cuts[n] + low, high - low)) if m > 1 else value
            )
    return F.array(*keys)


def _words(names: list[str]) -> list[tuple[Column, Column]]:
    """Words of ``p`` of both sides of a join."""
    return [(F.col(f"a.p.{n}"), F.col(f"b.p.{n}")) for n in names]


def _differ(names: list[str]) -> Column:
    """How many bits differ."""
    total = F.lit(0)
    for a, b in _words(names):
        total = total + F.bit_count(a.bitwiseXOR(b))
    return total


def _lanes_differ(names: list[str]) -> Column:
    """How many of the four-bit lanes differ: their bits are gathered in the lowest one."""
    total = F.lit(0)
    for a, b in _words(names):
        x = a.bitwiseXOR(b)
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return total


#: Leaders that a bucket has before its groups are compared with each other.
LEADERS = 2


def _links(
    keyed: DataFrame,
    close: Column,
    hot: int,
    real: Callable[[DataFrame], DataFrame] | None = None,
    bands: DataFrame | None = None,
    known: DataFrame | None = None,
) -> DataFrame:
    """Links that join the same groups as all close pairs that share a key.

    ``keyed`` is ``(key, rep, p)``; ``close`` tells by ``a.p`` and ``b.p`` which pairs may be
    links, and of the pairs found only those that ``real`` keeps are.  With ``bands``, all
    ``keys`` of every ``rep``, ``p`` holds the ``band`` of the key, and groups are compared in
    the first band that two sets share.  ``known`` are links found before: what they join is
    not compared again.

    A bucket of at most ``hot`` fingerprints is compared pair by pair.  In a larger one
    every member is first compared with ``LEADERS`` leaders, each time only across groups:
    the member that shares most keys, which is the text that the others were made from
    where there is one, then of those outside the largest group.  Then only members outside the bucket's largest group so far are
    compared with the rest, and only across groups.  A bucket of near copies thus costs
    about its size, and no link between two groups is lost.
    """
    real = real or (lambda pairs: pairs)
    pair = (F.col("a.rep").alias("a"), F.col("b.rep").alias("b"))
    links, warm = known, keyed
    if hot > 1:
        large = stage(keyed.groupBy("key").count().where(F.col("count") > hot).select("key"))
        cold = keyed.join(large, "key", "left_anti")
        near = cold.alias("a").join(
            cold.alias("b"),
            (F.col("a.key") == F.col("b.key")) & (F.col("a.rep") < F.col("b.rep")) & close,
        ).select(*pair)
        near = stage(real(near.distinct()))
        links = near if links is None else links.union(near)
        warm = stage(keyed.join(large, "key", "left_semi"))
    if links is None:
        links = keyed.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    held = warm.count()
    if not held:
        return links
    shares = warm.select("key", "rep").join(stage(warm.groupBy("key").count(), held), "key")
    shares = stage(shares.groupBy("rep").agg(F.sum("count").alias("shares")), held)
    turn = F.xxhash64("key", "rep")
    across = (F.col("a.key") == F.col("b.key")) & (F.col("a.c") != F.col("b.c")) & close
    found = stage(components(links))
    for step in range(LEADERS + 1):
        placed = warm.join(found, warm["rep"] == found["node"], "left").select(
            "key", "rep", "p", F.coalesce("component", "rep").alias("c")
        )
        # What is one group needs nothing more, nor do two members that have met.
        apart = placed.groupBy("key").agg(F.count("*").alias("n"), F.min("c").alias("low"), F.max("c").alias("high"))
        apart = apart.where((F.col("low") < F.col("high")) & (F.col("n") > (2 if step else 1))).select("key")
        placed = stage(placed.join(apart, "key", "left_semi"), held)
        held = placed.count()
        if not held:
            return links
        warm = placed.drop("c")
        if step < LEADERS:
            choice = (_minor(placed) if step else placed).join(shares, "rep")
            best = F.max_by(F.struct("rep", "p", "c"), F.struct("shares", turn))
            leader = stage(choice.groupBy("key").agg(best.alias("l")).select("key", "l.rep", "l.p", "l.c"), held)
            more = placed.alias("a").join(leader.alias("b"), across)
        else:
            if bands is not None:
                placed = stage(placed.join(bands, "rep"))
                earlier = [F.slice(f"{x}.keys", F.lit(1), F.col("a.p.band")) for x in "ab"]
                across = across & ~F.exists(F.zip_with(*earlier, lambda x, y: x == y), lambda same: same)
            more = stage(_minor(placed)).alias("a").join(placed.alias("b"), across)
        more = stage(real(more.select(*pair).distinct()))
        if step < LEADERS and not more.isEmpty():
            found = stage(components(links.union(more)))
        links = links.union(more)
    return links


def _minor(placed: DataFrame) -> DataFrame:
    """The members outside their bucket's largest group."""
    most = placed.groupBy("key", "c").count().groupBy("key").agg(F.max_by("c", F.struct("count", "c")).alias("most"))
    return placed.join(stage(most, placed.count()), "key").where("c != most").drop("most")


def groups(prints: DataFrame, max_bits: int, hot: int = 256) -> DataFrame:
    """``(doc_id, f0 .., component_id)``: documents linked through fingerprints that differ in few bits."""
    names = [c for c in prints.columns if c != "doc_id"]
    prints = stage(prints)
    kinds = stage(prints.groupBy(*names).agg(F.min("doc_id").alias("rep")))
    keys = ring_keys(F.col(names[0]), max_bits)
    keyed = kinds.select(F.explode(keys).alias("key"), "rep", F.struct(*names).alias("p"))
    found = components(_links(keyed, _differ(names) <= max_bits, hot))
    named = kinds.join(found, kinds["rep"] == found["node"], "left").select(
        *names, F.coalesce("component", "rep").alias("component_id")
    )
    return prints.join(stage(named), names).select("doc_id", *names, "component_id")


#: Fingerprints of five-word shingles that differ in at most so many bits meet before bands are compared.
NEAR_BITS = 2
#: MinHash bands and values of a band: a pair at 0.8 shares a band with a chance of 0.99994.
BANDS, DEEP = 32, 6
#: Of each value four bits are kept, one lane of a sketch.  Candidates share a band; of the other
#: 186 lanes a pair at 0.8 differs in 35 on average and in more than 56 with a chance of 0.0001.
SKETCH_LANES = 56
_SKETCH = [f"b{i}" for i in range(BANDS * DEEP // 16)]
#: A bit for every 512th of the shingles, set where their number is odd.  Two sets that differ in
#: so many shingles differ in no more of these bits, so the test by them passes over no real pair.
_PARITY = [f"o{i}" for i in range(8)]

_TURNS = np.random.default_rng(17).integers(0, 1 << 63, BANDS * DEEP, np.uint64) * np.uint64(2) + np.uint64(1)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The smallest of the hashes under each of ``BANDS * DEEP`` orders."""
    low = np.full(len(_TURNS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(low, np.multiply.outer(_TURNS, hashes[at : at + 1024]).min(axis=1), out=low)
    return low


def parities(shingles: np.ndarray) -> np.ndarray:
    """Whether the number of shingles in each of the ``_PARITY`` classes is odd, 64 to a word."""
    size = 64 * len(_PARITY)
    count = np.bincount((mix(shingles) % np.uint64(size)).astype(np.int64), minlength=size)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").view(np.int64)


def may_be_similar(similarity: float) -> Column:
    """Whether two sets can be as similar as that: so similar ones differ in a bounded part of their shingles."""
    most = (F.col("a.p.n") + F.col("b.p.n")) * F.lit((1 - similarity) / (1 + similarity)) + F.lit(1e-6)
    return _differ(_PARITY) <= most


def _set_id(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), 42)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """``(doc_id, set_id, n, f0, b0 .. b11, o0 .. o7, keys)`` of every document with an id: its shingle
    set, that set's size and fingerprint, four bits of each minimum, the parities, and a key of
    every band; no key without words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, sizes, prints, bits, odd, keys = [], [], [], [], [], []
            for text in encode(batch["text"]):
                shingles = np.unique(shingle_hashes(text, width))
                sizes.append(len(shingles))
                prints.append(vote(shingles, 1)[0])
                odd.append(parities(shingles))
                low = minima(shingles)
                ids.append(_set_id(shingles))
                lanes = (mix(low) & np.uint64(15)).astype(np.uint8)
                bits.append((lanes[0::2] | lanes[1::2] << 4).view(np.int64))
                key = np.arange(BANDS, dtype=np.uint64)
                for values in low.reshape(BANDS, DEEP).T:
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + values)
                keys.append(key.view(np.int64) if len(shingles) else key[:0].view(np.int64))
            bits = np.array(bits, np.int64).reshape(-1, len(_SKETCH))
            out = {"doc_id": batch["doc_id"].to_numpy(), "set_id": np.array(ids, np.uint64).view(np.int64)}
            out |= {"n": np.array(sizes, np.int64), "f0": np.array(prints, np.uint64).view(np.int64)}
            out |= {n: bits[:, i] for i, n in enumerate(_SKETCH)}
            odd = np.array(odd, np.int64).reshape(-1, len(_PARITY))
            yield pd.DataFrame({**out, **{n: odd[:, i] for i, n in enumerate(_PARITY)}, "keys": keys})

    names = ["doc_id", "set_id", "n", "f0", *_SKETCH, *_PARITY]
    schema = ", ".join(f"{n} long" for n in names) + ", keys array<long>"
    return short_batches(docs).select("doc_id", "text").where("doc_id is not null").mapInPandas(run, schema)


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """``(set_id, shingles)``: the distinct shingle sets of some documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, width)) for t in encode(batch["text"])]
            ids = np.array([_set_id(s) for s in sets], np.uint64).view(np.int64)
            yield pd.DataFrame({"set_id": ids, "shingles": [s.view(np.int64) for s in sets]})

    found = short_batches(docs).select("text").mapInPandas(run, "set_id long, shingles array<long>")
    return found.groupBy("set_id").agg(F.first("shingles").alias("shingles"))


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` of sets whose Jaccard similarity is at least ``similarity``."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("y"))
    # An array of one keeps the intersection from being made twice.
    common = F.explode(F.array(F.size(F.array_intersect("x", "y")))).alias("n")
    sized = pairs.join(left, "a").join(right, "b").select("a", "b", F.size("x").alias("i"), F.size("y").alias("j"), common)
    return sized.where(F.col("n") / (F.col("i") + F.col("j") - F.col("n")) >= similarity).select("a", "b")


def _shared(keyed: DataFrame) -> DataFrame:
    """The rows whose key is not theirs alone."""
    shared = stage(keyed.groupBy("key").count().where("count > 1").select("key"))
    return keyed.join(shared, "key", "left_semi")


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, hot: int = 1) -> DataFrame:
    """``(doc_id, component_id)``: documents linked at a Jaccard similarity of their shingle sets.

    Equal sets are folded.  Sets whose fingerprints differ in at most ``NEAR_BITS`` bits meet
    first, through pigeonring chains as in :func:`groups`.  What these links have not joined
    meets where it shares one of ``BANDS`` bands of MinHash values, so a pair at 0.8 is
    missed with a chance of less than 0.0001, one at 0.9 of 1e-10.  The sets of documents
    that meet are built, and a candidate links only if its exact similarity is high enough,
    so nothing below it is linked directly.  In every bucket leaders are compared first, so
    a group of near copies costs its size.
    """
    prints = stage(sketches(docs, width))
    first = [F.first(c).alias(c) for c in ("n", "f0", *_SKETCH, *_PARITY, "keys")]
    kinds = stage(prints.groupBy("set_id").agg(F.min("doc_id").alias("rep"), *first))
    chains = F.explode(ring_keys(F.col("f0"), NEAR_BITS)).alias("key")
    ring = _shared(kinds.where(F.size("keys") > 0).select(chains, F.col("set_id").alias("rep"), F.struct("f0", "n", *_PARITY).alias("p")))
    ring = stage(ring)
    keyed = _shared(kinds.select(F.posexplode("keys").alias("band", "key"), F.col("set_id").alias("rep")))
    # Only sets that share a band need their sketch.
    sketched = kinds.select(F.col("set_id").alias("rep"), "n", *_SKETCH, *_PARITY)
    keyed = stage(keyed.join(sketched, "rep").select("key", "rep", F.struct("n", *_SKETCH, *_PARITY, "band").alias("p")))
    bands = kinds.select(F.col("set_id").alias("rep"), "keys")
    nodes = ring.select(F.col("rep").alias("set_id")).union(keyed.select("rep")).distinct()
    wanted = stage(kinds.join(nodes, "set_id", "left_semi").select(F.col("rep").alias("doc_id")).distinct())
    sets = stage(shingle_sets(docs.join(broadcast_if_small(wanted), "doc_id", "left_semi"), width))
    real = lambda pairs: _similar(pairs, sets, similarity)
    can = may_be_similar(similarity)
    links = _links(ring, (_differ(["f0"]) <= NEAR_BITS) & can, hot, real)
    found = components(_links(keyed, (_lanes_differ(_SKETCH) <= SKETCH_LANES) & can, hot, real, bands, links))
    placed = stage(
        kinds.join(found, kinds["set_id"] == found["node"], "left").select(
            "set_id", "rep", F.coalesce("component", "set_id").alias("c")
        )
    )
    least = stage(placed.groupBy("c").agg(F.min("rep").alias("component_id")))
    named = stage(placed.join(least, "c").select("set_id", "component_id"))
    return prints.join(named, "set_id").select("doc_id", "component_id")


def keep_first(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents that are the smallest id of their group; rows without id stay.

    Of rows that repeat one id all are kept: they are one document to this operator.
    """
    found = near_duplicates(docs, width, similarity)
    dropped = stage(found.where("doc_id != component_id").select("doc_id").distinct())
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def linked(docs: DataFrame) -> DataFrame:
    """Fingerprints of three-word shingles, linked at two or fewer differing bits."""
    found = groups(fingerprints(docs, 3), 2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")
