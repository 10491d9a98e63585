"""Benchmark decontamination by q-gram lemma filtering.

Both sides are lower-cased, with one blank for every run of blanks.  An item of ``n``
bytes that occurs in a text with at most ``k`` edits shares at least
``n + 1 - q * (k + 1)`` of its q-grams with it, on diagonals (place in the text minus
place in the item) that lie within ``k`` of each other.  So shared q-grams are counted
in overlapping bands of ``2 * (k + 1)`` diagonals, bands below the bound are dropped,
and the rest is verified by an alignment confined to the band.

The benchmark is a stated query set: it is taken in blocks of at most ``BLOCK`` bytes,
each block is sent to all tasks and all documents are read against it.

Results for odd input: NULL and blank texts match nothing; items of fewer than ``q``
bytes are too short to be evidence and match nothing; repeated items and rows are
reported each; rows without id are read like others; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import gram_hashes, only_where, short_batches

#: Bytes of benchmark text that go to the tasks at once.
BLOCK = 8 << 20
#: Length of a gram in bytes and edits allowed for each byte of an item.
GRAM, RATE = 12, 0.06

_SLOTS = 22


def normal(text: str | None) -> bytes:
    return b"" if text is None else " ".join(text.lower().split()).encode("utf-8", "replace")


def grams(data: np.ndarray, q: int) -> np.ndarray:
    return gram_hashes(data.astype(np.uint64) + np.uint64(1), q)


@dataclass
class Index:
    """Grams of one block of items, sorted by hash, with item number and place."""

    ids: list
    texts: list[bytes]
    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray
    budget: np.ndarray
    need: np.ndarray
    seen: np.ndarray

    @classmethod
    def of(cls, rows: list, q: int, rate: float) -> Index | None:
        items = [(i, t) for i, t in ((r["item_id"], normal(r["text"])) for r in rows) if len(t) >= q]
        if not items:
            return None
        sizes = np.array([len(t) for _, t in items])
        budget = np.minimum((sizes * rate).astype(np.int64), (sizes - q) // q)
        hashes = [grams(np.frombuffer(t, np.uint8), q) for _, t in items]
        item = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes])
        flat = np.concatenate(hashes)
        order = np.argsort(flat, kind="stable")
        seen = np.zeros(1 << _SLOTS, bool)
        seen[flat >> np.uint64(64 - _SLOTS)] = True
        return cls(
            [i for i, _ in items], [t for _, t in items], flat[order], item[order], place[order],
            budget, sizes + 1 - q * (budget + 1), seen,
        )


def align(item: bytes, text: bytes, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """Fewest edits of ``item`` against a part of ``text`` on the diagonals ``low .. high``, and that part.

    Row ``i`` holds the cells of item byte ``i``; cell ``c`` stands at place ``i + low + c`` of the text.
    """
    at = text.find(item, max(0, low), max(0, high + len(item)))
    if at >= 0:
        return 0, at, at + len(item)
    width = high - low + 1
    far = len(item) + len(text) + 1
    cells = np.arange(width)
    data = np.frombuffer(text, np.uint8)
    place = low + cells
    cost = np.where((place >= 0) & (place <= len(text)), 0, far)
    origin = place.copy()
    for i, byte in enumerate(item, 1):
        place = i + low + cells
        inside = (place >= 0) & (place <= len(text))
        before = np.clip(place - 1, 0, max(len(text) - 1, 0))
        same = (place >= 1) & inside & (data[before] == byte) if len(text) else np.zeros(width, bool)
        step = np.where((place >= 1) & inside, cost + ~same, far)
        down = np.append(cost[1:], far) + 1
        pick = down < step
        new = np.where(inside, np.where(pick, down, step), far)
        start = np.where(pick, np.append(origin[1:], 0), origin)
        # Moves along the row: the best cell to the left plus the distance to it.
        slope = np.minimum.accumulate((new - cells) * (width + 1) + cells)
        source = slope % (width + 1)
        cost, origin = (slope - source) // (width + 1) + cells, start[source]
        cost = np.where(inside, np.minimum(cost, far), far)
        if cost.min() > budget:
            return None
    best = int(cost.argmin())
    return (int(cost[best]), int(origin[best]), int(len(item) + low + best)) if cost[best] <= budget else None


#: Pairs of equal grams, one of the text and one of an item, that are counted at once.
PAIRS = 1 << 20


def _bands(index: Index, hits: np.ndarray, first: np.ndarray, count: np.ndarray, shift: int, span: int):
    """Numbers of the bands that hold equal grams and how many pairs each holds, a slice of pairs at a time."""
    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    total, at = np.cumsum(count), 0
    while at < len(hits):
        done = int(total[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(total, done + PAIRS, "right")))
        n = count[at:stop]
        row = np.repeat(first[at:stop], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item = index.item[row]
        # Diagonals are shifted by the text's length so that bands number from 0.
        band = (np.repeat(hits[at:stop], n) - index.place[row] + shift) // (index.budget[item] + 1)
        part, found = np.unique(item * span + band, return_counts=True)
        keys, back = np.unique(np.concatenate((keys, part)), return_inverse=True)
        counts = np.bincount(back, np.concatenate((counts, found)), len(keys)).astype(np.int64)
        at = stop
    # A band reaches over two steps: its own and the next.
    both, back = np.unique(np.concatenate((keys, keys - 1)), return_inverse=True)
    counts = np.bincount(back, np.concatenate((counts, counts)), len(both)).astype(np.int64)
    return both[both >= 0], counts[both >= 0]


def search(data: bytes, index: Index, q: int) -> list[tuple]:
    """``(item id, edits, begin, end)`` of the best occurrence of every item in a normalised text."""
    hashes = grams(np.frombuffer(data, np.uint8), q)
    hits = np.flatnonzero(index.seen[hashes >> np.uint64(64 - _SLOTS)])
    first = np.searchsorted(index.hashes, hashes[hits], "left")
    count = np.searchsorted(index.hashes, hashes[hits], "right") - first
    if not count.any():
        return []
    shift = max(len(t) for t in index.texts)
    span = (len(data) + 2 * shift) + 2
    key, found = _bands(index, hits, first, count, shift, span)
    kept = key[found >= index.need[key // span]]
    best: dict[int, tuple] = {}
    for k in kept.tolist():
        number, band_no = divmod(k, span)
        budget = int(index.budget[number])
        low = band_no * (budget + 1) - shift
        # The band reaches over two steps; an occurrence may begin up to its budget beside its grams.
        hit = align(index.texts[number], data, low - budget, low + 2 * (budget + 1) - 1 + budget, budget)
        if hit and (number not in best or hit < best[number]):
            best[number] = hit
    return [(index.ids[n], *best[n]) for n in sorted(best)]


def _blocks(benchmark: DataFrame, q: int, rate: float) -> Iterator[Broadcast]:
    """The benchmark in blocks of about ``BLOCK`` bytes, each sent to the executors."""
    items = benchmark.select("item_id", "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-size // BLOCK))
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        index = Index.of(rows, q, rate)
        if index is not None:
            yield benchmark.sparkSession.sparkContext.broadcast(index)


def leaks(docs: DataFrame, benchmark: DataFrame, q: int = GRAM, rate: float = RATE) -> DataFrame:
    """``(doc_id, item_id, edits, begin, end)``: items that occur in texts; places are bytes of the normal form."""
    made = ["item_id", "edits", "begin", "end"]
    schema = "doc_id long, " + ", ".join(f"{n} long" for n in made)
    rows, out = short_batches(docs).select("doc_id", "text"), None
    for shared in _blocks(benchmark, q, rate):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column("text").to_pylist()
                found = [(i, *hit) for i, text in enumerate(texts) for hit in search(normal(text), shared.value, q)]
                row, *rest = zip(*found) if found else ([],) * 5
                ids = batch.column("doc_id").take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in rest)], names=["doc_id", *made])

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, q: int = GRAM, rate: float = RATE) -> DataFrame:
    """The documents in which no benchmark item occurs; every row is judged by its own text."""
    left = short_batches(docs)
    for shared in _blocks(benchmark, q, rate):
        left = only_where(left, lambda texts, shared=shared: [not search(normal(t), shared.value, q) for t in texts])
    return left
