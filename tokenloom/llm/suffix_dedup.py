"""Suffix-array dedup over bytes: a distributed merge sort that knows common prefixes.

Suffixes around recurring anchors (:mod:`tokenloom.llm.repeats`) are sorted in their
chunk and sent as a front-coded run: how many bytes a suffix shares with the one
before it, and the rest of it.  A group merges its runs with a loser tree that keeps,
for every waiting suffix, how much it shares with the last one put out; only suffixes
that share equally much are compared, and only from there on.  The merge gives the
sorted suffixes together with their common prefix lengths, from which the 50-byte
strings that also start in an earlier document are read off.

Results for odd input: NULL text is empty; a text shorter than a string keeps
everything; strings repeated inside one document stay; rows that repeat an id are one
document to each other; rows without id are left out; an empty table gives no rows.
A document has to fit into a task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tokenloom.llm import repeats
from tokenloom.llm.repeats import Rule


def front_decode(common: np.ndarray, tails: np.ndarray, size: int) -> np.ndarray:
    rows = np.zeros((len(common), size), np.uint8)
    at = np.arange(size) >= common.astype(np.int64)[:, None]
    rows[at] = tails
    # The last row that wrote a column of its own is where its value comes from.
    source = np.maximum.accumulate(np.where(at, np.arange(len(common))[:, None], 0), axis=0)
    return rows[source, np.arange(size)]


def merge_runs(runs: list[tuple[bytes | list[bytes], list[int]]], size: int) -> tuple[list[int], list[int], list[int]]:
    """Run and row of every suffix in sorted order, and what it shares with the one before.

    ``runs`` holds sorted fixed-size strings (joined or as a list) with their common prefix
    lengths; a string is cut out only when its turn comes.
    """
    runs = [(r if isinstance(r, bytes) else b"".join(r), c) for r, c in runs]
    width = 1
    while width < len(runs):
        width *= 2
    end = b"\xff" * size + b"\xff"
    heads = [r[0][:size] or end for r in runs] + [end] * (width - len(runs))
    shares = [0] * width
    losers = [-1] * width
    at = [0] * width

    def play(new: int, node: int) -> int:
        while node:
            old = losers[node]
            if old < 0:
                losers[node] = new
                return -1
            x, y = shares[new], shares[old]
            if x < y:
                losers[node], new = new, old
            elif x == y:
                a, b = heads[new], heads[old]
                if a != b:
                    low, high = (new, old) if a < b else (old, new)
                    n = min(len(a), len(b))
                    gap = int.from_bytes(a[x:n], "big") ^ int.from_bytes(b[x:n], "big")
                    shares[high] = n - (gap.bit_length() + 7) // 8
                else:
                    low, high = (new, old) if new < old else (old, new)
                    shares[high] = size
                losers[node], new = high, low
            node //= 2
        return new

    winner = -1
    for i in range(width):
        passed = play(i, (i + width) // 2)
        winner = passed if passed >= 0 else winner
    out_run, out_row, out_common = [], [], []
    total = sum(len(r[1]) for r in runs)
    if width == 1:
        winner = 0
    while len(out_run) < total:
        row = at[winner]
        out_run.append(winner)
        out_row.append(row)
        out_common.append(shares[winner])
        at[winner] = row = row + 1
        raw, common = runs[winner]
        if row < len(common):
            heads[winner], shares[winner] = raw[row * size : (row + 1) * size], common[row]
        else:
            heads[winner], shares[winner] = end, 0
        winner = play(winner, (winner + width) // 2)
    return out_run, out_row, out_common


def _merge(sent: list[list[np.ndarray]], rule: Rule) -> list[np.ndarray]:
    """Answers of one group: a bit for each string that an earlier document also has."""
    sizes = [len(s[0]) for s in sent]
    runs = [(front_decode(s[6], s[7], rule.size).tobytes(), s[6].tolist()) for s in sent]
    run, row, common = merge_runs(runs, rule.size)
    del runs
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    order = begins[np.array(run, np.int64)] + np.array(row, np.int64)
    lefts, rights = (np.concatenate([s[i] for s in sent]) for i in (3, 4))
    left = np.concatenate([s[5].reshape(-1, rule.reach) for s in sent])
    owner = np.concatenate([s[1] for s in sent])
    rank = repeats.ranks(owner, np.zeros(len(owner), np.int64))
    bits = np.empty(len(order), np.uint64)
    bits[order] = repeats.covered_windows(
        np.array(common, np.int64), left[order], lefts[order], rights[order], rank[order], rule
    )
    return np.split(bits, np.cumsum(sizes)[:-1])


def remove_repeats(docs: DataFrame, size: int = 50, texts: bool = False) -> DataFrame:
    """Bytes of each document without those of strings that also start in an earlier document.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, with ``texts``, ``kept``.
    """
    rule = Rule(size, max(1, size * 8 // 25), words=False, by_position=False)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts

    def finish(texts_in, ids, parts, removed) -> pd.DataFrame:
        rows = []
        for b, gone in zip(parts, removed):
            begin = 0
            for i, end in enumerate(b.ends.tolist()):
                cut, raw = gone[begin:end], texts_in[b.first + i]
                n = int(cut.sum())
                spans = int(cut[0]) + int((cut[1:] & ~cut[:-1]).sum()) if n else 0
                kept = b.data[begin:end][~cut].tobytes() if n else raw
                row = (int(ids[b.first + i]), len(raw), n, spans, hashlib.sha256(kept).hexdigest())
                rows.append(row + ((kept,) if texts else ()))
                begin = end
        return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return repeats.mark(docs, rule, _merge, finish, schema)
