"""Windows that recur in a corpus, found through content-chosen anchors.

A window of ``size`` symbols (words or bytes) always holds an *anchor*: the run of
``gram`` symbols with the smallest hash in it.  Equal windows have equal anchors at
equal offsets, so only anchors that recur need a closer look, and each of them
stands for all windows around it.  The job is one plan of five steps:

1. documents are dealt to *chunks* of bounded text, and each chunk sends the distinct
   hashes of its anchors, packed by hash bucket;
2. a bucket finds the hashes that recur and answers with two bits for each;
3. a chunk sends the distinct surroundings of its recurring anchors with their first
   occurrence, again packed and split into groups by the anchor;
4. a group finds for each surrounding which of its windows occur earlier elsewhere
   (this step differs between the operators: a suffix tree or a merge of runs) and
   answers with one bit a window;
5. a chunk marks what the answers cover.

Hot anchors do not meet in one task.  A chunk folds its own copies before it sends
anything, so copies cost one record a chunk.  Anchors with more than ``HOT`` different
surroundings or so get a longer prefix: their windows are sent one by one under the
window itself, where again only equal ones meet.  All three uses of the documents
share one shuffle of the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import encode, gram_hashes, mix, text_bytes

U64 = np.uint64
_STEP = U64(0x9E3779B97F4A7C15)
_NONE = U64(0xFFFFFFFFFFFFFFFF)

#: Text of a chunk and of a block that is worked on at a time, in bytes.
CHUNK, BLOCK, SLICE = 4 << 20, 1 << 20, 1 << 18
#: Text whose anchors make one group: bounds what steps 2 and 4 hold.
GROUP = 2 << 20
#: Chunks and copies an anchor may be seen in before its windows go by their own key.
HOT = 4096


@dataclass(frozen=True)
class Rule:
    """Window and anchor length, their unit, and whether an earlier place in one document counts."""

    size: int
    gram: int
    words: bool
    by_position: bool

    @property
    def reach(self) -> int:
        return self.size - self.gram


def _byte_table() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * _STEP)


_TABLE = _byte_table()
#: Half as wide, for choosing anchors among bytes.
_SHORT = (_TABLE >> U64(32)).astype(np.uint32)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in UTF-8 bytes (blanks are ASCII, so bytes do)."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
    return edge[0::2], edge[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, from sums over their bytes; spans are taken a slice at a time."""
    out = np.empty(len(starts), U64)
    at, cuts = 0, np.cumsum(ends - starts)
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(cuts, (cuts[at - 1] if at else 0) + SLICE, "right")))
        begin, size = starts[at:stop], ends[at:stop] - starts[at:stop]
        heads = np.cumsum(size) - size
        offset = np.arange(int(size.sum())) - np.repeat(heads, size)
        place = mix(np.arange(1, int(size.max()) + 1, dtype=U64) * U64(0xD6E8FEB86659FD93))
        terms = mix(_TABLE[data[np.repeat(begin, size) + offset]] + place[offset])
        out[at:stop] = mix(np.add.reduceat(terms, heads) + size.astype(U64) * _STEP)
        at = stop
    return out


def _slide(values: np.ndarray, width: int, best) -> np.ndarray:
    """Smallest or largest of every ``width`` consecutive values, by doubling."""
    span, out = 1, values
    while span < width:
        step = min(span, width - span)
        out = best(out[: len(out) - step], out[step:])
        span += step
    return out


@dataclass
class Block:
    """Consecutive documents as one array of symbols; ``ends[i]`` is where document ``i`` stops."""

    first: int
    words: np.ndarray | None
    ends: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    anchors: np.ndarray
    hashes: np.ndarray
    doc: np.ndarray
    left: np.ndarray
    right: np.ndarray

    @property
    def size(self) -> int:
        return len(self.data) if self.words is None else len(self.words)

    @cached_property
    def symbols(self) -> np.ndarray:
        """64-bit symbols; those of bytes are made when a step asks for them."""
        return _TABLE[self.data] if self.words is None else self.words


def blocks(texts: list[bytes], rule: Rule) -> Iterator[Block]:
    at = 0
    while at < len(texts):
        stop, held = at, 0
        while stop < len(texts) and (stop == at or held + len(texts[stop]) <= BLOCK):
            held += len(texts[stop]) + 1
            stop += 1
        yield _block(texts[at:stop], at, rule)
        at = stop


def _tails(ends: np.ndarray, span: int, n: int) -> np.ndarray:
    """The first ``n`` places, as far as ``span`` symbols from there on leave their document."""
    at = (ends[:, None] - np.arange(1, span)).ravel()
    return at[(at >= 0) & (at < n)]


def _names(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the ``size`` bytes at some places, eight bytes at a time."""
    rows = np.zeros((len(at), -(-size // 8) * 8), np.uint8)
    rows[:, :size] = np.lib.stride_tricks.sliding_window_view(data, size)[at]
    out = np.zeros(len(at), U64)
    for part in rows.view("<u8").T:
        out = mix(out * _STEP + part + U64(1))
    return out


def _block(texts: list[bytes], first: int, rule: Rule) -> Block:
    glue = b" " if rule.words else b""
    data = np.frombuffer(glue.join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + len(glue)
    limits = np.cumsum(sizes)
    starts = stops = np.empty(0, np.int64)
    words, ends = None, limits
    if rule.words:
        starts, stops = word_spans(data)
        words = word_hashes(data, starts, stops)
        ends = np.searchsorted(starts, limits - 1, "left")
    begins = np.concatenate(([0], ends[:-1]))
    anchors, hashes = np.empty(0, np.int64), np.empty(0, U64)
    if (len(data) if words is None else len(words)) >= rule.size:
        if rule.words:
            # The hash that names an anchor also chooses it.
            order = gram_hashes(words, rule.gram)
        else:
            # Any hash of the bytes chooses anchors that do not depend on what is around
            # a window; half the width does, since a tie only gives one anchor more.
            order = gram_hashes(_SHORT[data], rule.gram)
            order >>= np.uint32(1)
            order += np.uint32(1)
        kind = order.dtype.type
        none = kind(np.iinfo(kind).max)
        if rule.words:
            order[order == none] -= kind(1)
        order[_tails(ends, rule.gram, len(order))] = none
        low = _slide(order, rule.reach + 1, np.minimum)
        low[_tails(ends, rule.size, len(low))] = 0
        pad = np.zeros(rule.reach, kind)
        high = _slide(np.concatenate((pad, low, pad)), rule.reach + 1, np.maximum)
        anchors = np.flatnonzero((order == high) & (order > 0))
        hashes = order[anchors] if rule.words else _names(data, anchors, rule.gram)
    doc = np.searchsorted(ends, anchors, "right")
    left = np.minimum(anchors - begins[doc], rule.reach)
    right = np.minimum(ends[doc] - anchors, rule.size)
    return Block(first, words, ends, data, starts, stops, anchors, hashes, doc, left, right)


_PACK = zstandard.ZstdCompressor(level=1)
_OPEN = zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; lengths and types stand in front."""
    head = ";".join(f"{a.dtype.str},{a.size}" for a in arrays).encode()
    return _PACK.compress(len(head).to_bytes(4, "little") + head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(value: bytes) -> list[np.ndarray]:
    raw = _OPEN.decompress(value)
    size = int.from_bytes(raw[:4], "little")
    out, at = [], 4 + size
    for part in raw[4:at].decode().split(";"):
        kind, n = part.split(",")
        kind = np.dtype(kind)
        out.append(np.frombuffer(raw, kind, int(n), at))
        at += int(n) * kind.itemsize
    return out


def _split(keys: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the keys by their group, the groups and where each begins (with the end)."""
    group = (keys >> U64(32)) * U64(groups) >> U64(32)
    order = np.argsort(group, kind="stable")
    names, begins = np.unique(group[order], return_index=True)
    return order, names, np.append(begins, len(keys))


def anchor_census(parts: list[Block], ids: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchor hashes of a chunk and in how many documents (or places) each is, at most 255."""
    found = []
    for b in parts:
        if rule.by_position:
            found.append(np.stack((b.hashes, b.anchors.astype(U64) + (U64(b.first) << U64(40))), 1))
        else:
            found.append(np.stack((b.hashes, ids[b.first + b.doc].astype(U64)), 1))
    if not found:
        return np.empty(0, U64), np.empty(0, np.uint8)
    pairs = np.concatenate(found)
    # Blocks and documents come in order, so a stable sort by hash leaves the places in order too.
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs[1:] != pairs[:-1]).any(1)
    names, counts = np.unique(pairs[new, 0], return_counts=True)
    return names, np.minimum(counts, 255).astype(np.uint8)


def anchor_names(parts: list[Block]) -> np.ndarray:
    """The distinct anchor hashes of a chunk, in the order of :func:`anchor_census`."""
    if not parts:
        return np.empty(0, U64)
    names = np.sort(np.concatenate([b.hashes for b in parts]))
    return names[np.concatenate(([True], names[1:] != names[:-1]))] if len(names) else names


def _context(b: Block, rule: Rule, pick: np.ndarray) -> np.ndarray:
    """64-bit identity of left and right surroundings of some anchors, with their lengths."""
    p, l, r = b.anchors[pick], b.left[pick], b.right[pick]
    sums = np.concatenate(([U64(0)], np.cumsum(b.symbols * _power(len(b.symbols)))))
    part = (sums[p + r] - sums[p - l]) * _inverse(len(b.symbols))[p - l]
    return mix(part + mix((l.astype(U64) << U64(32)) + r.astype(U64)))


_POWERS: dict[int, np.ndarray] = {}


def _grow(base: int, n: int) -> np.ndarray:
    """Powers of an odd number modulo 2**64, kept between blocks."""
    kept = _POWERS.get(base)
    if kept is None or len(kept) < n + 1:
        size = max(1 << 16, 1 << (n + 1).bit_length())
        kept = np.ones(size, U64)
        kept[1:] = U64(base)
        kept = np.cumprod(kept)
        _POWERS[base] = kept
    return kept


_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _power(n: int) -> np.ndarray:
    return _grow(_BASE, n)[:n]


def _inverse(n: int) -> np.ndarray:
    return _grow(_BACK, n)


@dataclass
class Found:
    """What a chunk sends in step 3, in an order that step 5 can make again.

    ``owner`` is the place of a record's first occurrence: id and position (0 where
    only documents count).  ``uses`` lists per block the anchors (or window starts),
    the record of each and whether it is the first occurrence itself.
    """

    keys: np.ndarray
    owner: np.ndarray
    position: np.ndarray
    order: np.ndarray
    body: Callable[[np.ndarray], tuple[np.ndarray, ...]]
    uses: list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def _fold(names: list[np.ndarray], ids: list[np.ndarray], places: list[np.ndarray]):
    """Distinct names, row of the first place of each, and per part the name number and first flag."""
    name, doc, place = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (names, ids, places))
    order = np.lexsort((place, doc, name))
    new = np.ones(len(order), bool)
    new[1:] = name[order][1:] != name[order][:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    first = order[new]
    own = (doc == doc[first][number]) & (place == place[first][number]) if len(order) else np.empty(0, bool)
    cuts = np.cumsum([len(x) for x in names])[:-1]
    return first, np.split(number, cuts), np.split(own, cuts)


def surroundings(parts: list[Block], ids: np.ndarray, flags: list[np.ndarray], rule: Rule) -> Found:
    """Distinct surroundings of the anchors flagged 1."""
    picks = [np.flatnonzero(f == 1) for f in flags]
    names = [_context(b, rule, k) for b, k in zip(parts, picks)]
    docs = [ids[b.first + b.doc[k]] for b, k in zip(parts, picks)]
    places = [_place(b, b.anchors[k], rule) for b, k in zip(parts, picks)]
    first, number, own = _fold(names, docs, places)
    block = np.repeat(np.arange(len(parts)), [len(k) for k in picks])
    pick = np.concatenate(picks) if picks else np.empty(0, np.int64)
    keys = np.concatenate([b.hashes[k] for b, k in zip(parts, picks)]) if picks else np.empty(0, U64)
    owner = np.concatenate(docs) if docs else np.empty(0, np.int64)
    place = np.concatenate(places) if places else np.empty(0, np.int64)

    whole: list = []

    def around() -> tuple:
        if not whole:
            whole.extend(
                _words_around(parts, block, pick, first) if rule.words else _bytes_around(parts, block, pick, first, rule)
            )
        return tuple(whole)

    def body(rows: np.ndarray) -> tuple[np.ndarray, ...]:
        if rule.words:
            l, texts = around()
            texts = [texts[i] for i in rows.tolist()]
            sizes = np.array([len(t) + 1 for t in texts], np.int32)
            return l[rows], sizes, np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        l, r, left, right = around()
        return l[rows], r[rows], left[rows].ravel(), *front_code(right[rows])

    uses = [(b.anchors[k], n, o) for b, k, n, o in zip(parts, picks, number, own)]
    order = np.arange(len(first))
    if not rule.words and len(first):
        order = np.argsort(around()[3].view(f"S{rule.size}").ravel(), kind="stable")
    return Found(keys[first], owner[first], place[first], order, body, uses)


def _place(b: Block, at: np.ndarray, rule: Rule) -> np.ndarray:
    begins = np.concatenate(([0], b.ends[:-1]))
    return at - begins[np.searchsorted(b.ends, at, "right")] if rule.by_position else np.zeros(len(at), np.int64)


def _bytes_around(parts, block, pick, rows, rule: Rule) -> tuple[np.ndarray, ...]:
    """Left and right lengths, left bytes (nearest first) and right bytes, zero filled."""
    n = len(rows)
    left, right = np.empty((n, rule.reach), np.uint8), np.empty((n, rule.size), np.uint8)
    l, r = np.empty(n, np.uint8), np.empty(n, np.uint8)
    view = np.lib.stride_tricks.sliding_window_view
    for i in np.unique(block[rows]):
        at = np.flatnonzero(block[rows] == i)
        b, k = parts[i], pick[rows[at]]
        p, l[at], r[at] = b.anchors[k], b.left[k], b.right[k]
        filled = np.concatenate((np.zeros(rule.reach, np.uint8), b.data, np.zeros(rule.size, np.uint8)))
        near = view(filled, rule.reach)[p][:, ::-1]
        left[at] = near * (np.arange(rule.reach) < b.left[k][:, None])
        right[at] = view(filled, rule.size)[p + rule.reach] * (np.arange(rule.size) < b.right[k][:, None])
    return l, r, left, right


def _words_around(parts, block, pick, rows) -> tuple[np.ndarray, list[bytes]]:
    """Left lengths in words and the words themselves, as they stand in the text."""
    l, texts = np.zeros(len(rows), np.uint8), [b""] * len(rows)
    for i in np.unique(block[rows]):
        b = parts[i]
        raw = b.data.tobytes()
        at = np.flatnonzero(block[rows] == i)
        k = pick[rows[at]]
        p = b.anchors[k]
        l[at] = b.left[k]
        low, high = b.starts[p - b.left[k]].tolist(), b.stops[p + b.right[k] - 1].tolist()
        for j, x, y in zip(at.tolist(), low, high):
            texts[j] = raw[x:y]
    return l, texts


def shared_prefixes(rows: np.ndarray) -> np.ndarray:
    """Bytes each row of a sorted matrix shares with the row before it."""
    same = np.cumprod(rows[1:] == rows[:-1], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    return np.concatenate(([0], same)) if len(rows) else np.empty(0, np.int64)


def front_code(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    common = shared_prefixes(rows)
    return common.astype(np.uint8), rows[np.arange(rows.shape[1]) >= common[:, None]]


def hot_windows(parts: list[Block], ids: np.ndarray, flags: list[np.ndarray], rule: Rule) -> Found:
    """Distinct windows around the anchors flagged 2."""
    starts = []
    for b, f in zip(parts, flags):
        k = np.flatnonzero(f == 2)
        seen = np.zeros(b.size + 1, bool)
        for d in range(rule.reach + 1):
            seen[(b.anchors[k] - d)[(b.left[k] >= d) & (b.right[k] >= rule.size - d)]] = True
        starts.append(np.flatnonzero(seen))
    names = [gram_hashes(b.symbols, rule.size)[s] if len(s) else np.empty(0, U64) for b, s in zip(parts, starts)]
    docs = [ids[b.first + np.searchsorted(b.ends, s, "right")] for b, s in zip(parts, starts)]
    places = [_place(b, s, rule) for b, s in zip(parts, starts)]
    first, number, own = _fold(names, docs, places)
    name = np.concatenate(names) if names else np.empty(0, U64)
    doc = np.concatenate(docs) if docs else np.empty(0, np.int64)
    place = np.concatenate(places) if places else np.empty(0, np.int64)
    uses = list(zip(starts, number, own))
    return Found(name[first], doc[first], place[first], np.arange(len(first)), lambda rows: (), uses)


def earlier(key: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Whether another row of the same key has a smaller rank."""
    out = np.zeros(len(key), bool)
    if len(key):
        order = np.argsort(key, kind="stable")
        heads = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
        least = np.minimum.reduceat(rank[order], heads)
        out[order] = rank[order] > np.repeat(least, np.diff(np.append(heads, len(key))))
    return out


def ranks(owner: np.ndarray, position: np.ndarray) -> np.ndarray:
    order = np.lexsort((position, owner))
    new = np.ones(len(order), bool)
    new[1:] = (owner[order][1:] != owner[order][:-1]) | (position[order][1:] != position[order][:-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def covered_windows(
    common: np.ndarray, left: np.ndarray, lefts: np.ndarray, rights: np.ndarray, rank: np.ndarray, rule: Rule
) -> np.ndarray:
    """One bit for each window around the anchors of sorted records: it occurs earlier in another record.

    ``common[i]`` is how many symbols of its right side record ``i`` shares with the one
    before it, so records that share ``t`` symbols are runs of ``common >= t``: the leaves
    under one node of their suffix tree.  ``left`` holds the symbols to the left, nearest
    first; windows that begin ``d`` symbols early also need ``d`` of those to be equal.
    """
    n = len(rank)
    bits = np.zeros(n, U64)
    side = np.zeros(n, U64)
    for d in range(rule.reach + 1):
        if d:
            side = mix(side * _STEP + left[:, d - 1].astype(U64))
        t = rule.size - d
        node = np.cumsum(common < t)
        shared = np.bincount(node, minlength=1)[node] > 1 if n else np.empty(0, bool)
        rows = np.flatnonzero(shared & (lefts >= d) & (rights >= t))
        gone = earlier(mix(node[rows].astype(U64) * _STEP + side[rows]), rank[rows])
        bits[rows[gone]] |= U64(1) << U64(d)
    return bits


Resolve = Callable[[list[list[np.ndarray]], Rule], list[np.ndarray]]


def mark(docs: DataFrame, rule: Rule, resolve: Resolve, finish, schema: str) -> DataFrame:
    """Runs the five steps; ``finish(texts, ids, parts, removed)`` yields a chunk's result frame."""
    total = text_bytes(docs)
    chunks, groups = max(1, -(-total // CHUNK)), max(1, -(-total // GROUP))
    dealt = docs.where("doc_id is not null").select(
        F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).alias("chunk"), "doc_id", "text"
    )

    def load(frame: pd.DataFrame):
        frame = frame.sort_values("doc_id", kind="stable")
        return encode(frame["text"]), frame["doc_id"].to_numpy(np.int64)

    def census(frame: pd.DataFrame) -> pd.DataFrame:
        texts, ids = load(frame)
        names, counts = anchor_census(list(blocks(texts, rule)), ids, rule)
        order, found, begins = _split(names, groups)
        rows = [
            (int(g), int(frame["chunk"].iloc[0]), pack(names[order[x:y]], counts[order[x:y]]))
            for g, x, y in zip(found, begins, begins[1:])
        ]
        return pd.DataFrame(rows, columns=["group", "chunk", "body"])

    def recur(frame: pd.DataFrame) -> pd.DataFrame:
        sent = [unpack(x) for x in frame["body"]]
        names, counts = np.concatenate([s[0] for s in sent]), np.concatenate([s[1] for s in sent])
        _, number = np.unique(names, return_inverse=True)
        total = np.bincount(number, counts)[number]
        answer = (total > 1).astype(np.uint8) + (total > HOT)
        cuts = np.cumsum([len(s[0]) for s in sent])[:-1]
        bodies = [pack(x.astype(np.uint8)) for x in np.split(answer, cuts)]
        return pd.DataFrame({"group": frame["group"], "chunk": frame["chunk"], "body": bodies})

    def flagged(parts, names, state):
        return [state[np.searchsorted(names, b.hashes)] if len(names) else np.empty(0, np.uint8) for b in parts]

    def send(frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame(columns=["group", "chunk", "body"])
        chunk = int(frame["chunk"].iloc[0])
        texts, ids = load(frame)
        parts = list(blocks(texts, rule))
        names = anchor_names(parts)
        state = np.zeros(len(names), np.uint8)
        order, found, begins = _split(names, groups)
        back = dict(zip(answers["group"], answers["body"]))
        for g, x, y in zip(found, begins, begins[1:]):
            state[order[x:y]] = unpack(back[int(g)])[0]
        flags = flagged(parts, names, state)
        rows = [(-1 - chunk, chunk, pack(state))]
        for kind, sent in enumerate((surroundings(parts, ids, flags, rule), hot_windows(parts, ids, flags, rule))):
            keys = sent.keys[sent.order]
            order, found, begins = _split(keys, groups)
            for g, x, y in zip(found, begins, begins[1:]):
                r = sent.order[order[x:y]]
                body = pack(sent.keys[r], sent.owner[r], sent.position[r].astype(np.int32), *sent.body(r))
                rows.append((2 * int(g) + kind, chunk, body))
        return pd.DataFrame(rows, columns=["group", "chunk", "body"])

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        group = int(frame["group"].iloc[0])
        if group < 0:
            return frame[["group", "chunk", "body"]]
        frame = frame.sort_values("chunk")
        sent = [unpack(x) for x in frame["body"]]
        if group % 2:
            key = np.concatenate([s[0] for s in sent])
            rank = ranks(np.concatenate([s[1] for s in sent]), np.concatenate([s[2] for s in sent]))
            cuts = np.cumsum([len(s[0]) for s in sent])[:-1]
            answers = np.split(earlier(key, rank).astype(U64), cuts)
        else:
            answers = resolve(sent, rule)
        return pd.DataFrame({"group": frame["group"], "chunk": frame["chunk"], "body": [pack(x) for x in answers]})

    def apply(frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return finish([], np.empty(0, np.int64), [], [])
        texts, ids = load(frame)
        parts = list(blocks(texts, rule))
        names = anchor_names(parts)
        back = dict(zip(answers["group"], answers["body"]))
        state = unpack(back[-1 - int(frame["chunk"].iloc[0])])[0]
        flags = flagged(parts, names, state)
        cold, hot = surroundings(parts, ids, flags, rule), hot_windows(parts, ids, flags, rule)
        bits = []
        for kind, sent in enumerate((cold, hot)):
            out = np.zeros(len(sent.keys), U64)
            order, found, begins = _split(sent.keys[sent.order], groups)
            for g, x, y in zip(found, begins, begins[1:]):
                out[sent.order[order[x:y]]] = unpack(back[2 * int(g) + kind])[0]
            bits.append(out)
        removed = []
        for i, (b, f) in enumerate(zip(parts, flags)):
            start = np.zeros(b.size + 1, np.int32)
            at, number, own = cold.uses[i]
            k = np.flatnonzero(f == 1)
            mine = np.where(own, bits[0][number], _NONE)
            for d in range(rule.reach + 1):
                hit = ((mine >> U64(d)) & U64(1) > 0) & (b.left[k] >= d) & (b.right[k] >= rule.size - d)
                start[at[hit] - d] = 1
            at, number, own = hot.uses[i]
            start[at[~own | (bits[1][number] > 0)]] = 1
            begun = np.cumsum(start, dtype=np.int32)
            open_at = begun.copy()
            open_at[rule.size :] -= begun[: -rule.size]
            removed.append(open_at[: b.size] > 0)
        return finish(texts, ids, parts, removed)

    wire = "group long, chunk long, body binary"
    first = dealt.groupBy("chunk").applyInPandas(census, wire)
    answers = first.groupBy("group").applyInPandas(recur, wire)
    second = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(send, wire)
    settled = second.groupBy("group").applyInPandas(settle, wire)
    return dealt.groupBy("chunk").cogroup(settled.groupBy("chunk")).applyInPandas(apply, schema)
