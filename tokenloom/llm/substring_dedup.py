"""Substring dedup over words: prefix-partitioned suffix trees.

The suffixes that can take part in a repeat are those around anchors that recur
(:mod:`tokenloom.llm.repeats`).  Their prefixes split them into groups of bounded
size: five words by default, the whole window where that prefix is hot.  In a group
the suffixes are sorted, and their common prefix lengths are the suffix tree: leaves
that share ``t`` words are a run.  A node at least as deep as what is left of a
window, whose leaves also agree to the left, is a maximal repeat of 20 words or more;
all its leaves but the earliest are removed.

Results for odd input: NULL text has no words and keeps the empty text; a document
shorter than a window keeps everything; rows that repeat an id and a text are judged
alike, as the same place (none removes the other); rows without id are left out; an
empty table gives no rows.  A document has to fit into a task.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tokenloom.llm import repeats
from tokenloom.llm.repeats import Rule


def _tree(sent: list[list[np.ndarray]], rule: Rule) -> list[np.ndarray]:
    """Answers of one prefix group: a bit for each window that an earlier record also has."""
    sizes = np.concatenate([s[4] for s in sent])
    data = np.concatenate([s[5] for s in sent])
    starts, stops = repeats.word_spans(data)
    symbols = repeats.word_hashes(data, starts, stops)
    limits = np.searchsorted(starts, np.cumsum(sizes), "left")
    begins = np.concatenate(([0], limits[:-1]))
    lefts = np.concatenate([s[3] for s in sent]).astype(np.int64)
    rights = limits - begins - lefts
    anchor = begins + lefts
    pad = np.append(symbols, np.uint64(0))
    near = anchor[:, None] - 1 - np.arange(rule.reach)
    left = np.where(np.arange(rule.reach) < lefts[:, None], pad[np.maximum(near, 0)], np.uint64(0))
    on = anchor[:, None] + np.arange(rule.size)
    right = np.where(np.arange(rule.size) < rights[:, None], pad[np.minimum(on, len(symbols))], np.uint64(0))
    order = np.lexsort(right.T[::-1])
    leaves = right[order]
    same = np.cumprod(leaves[1:] == leaves[:-1], axis=1).sum(axis=1)
    common = np.concatenate(([0], same)) if len(order) else same
    rank = repeats.ranks(np.concatenate([s[1] for s in sent]), np.concatenate([s[2] for s in sent]))
    bits = np.empty(len(order), np.uint64)
    bits[order] = repeats.covered_windows(common, left[order], lefts[order], rights[order], rank[order], rule)
    return np.split(bits, np.cumsum([len(s[0]) for s in sent])[:-1])


def remove_repeats(docs: DataFrame, size: int = 20, texts: bool = False) -> DataFrame:
    """Words of each document without those covered by a window that starts earlier elsewhere.

    Returns ``doc_id, n_words, n_removed, kept_sha256`` and, with ``texts``, ``kept_text``.
    """
    rule = Rule(size, max(1, size // 4), words=True, by_position=True)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts

    def finish(texts_in, ids, parts, removed) -> pd.DataFrame:
        rows = []
        for b, gone in zip(parts, removed):
            begin = 0
            for i, end in enumerate(b.ends.tolist()):
                words = texts_in[b.first + i].split()
                cut = gone[begin:end]
                kept = b" ".join(compress(words, (~cut).tolist()) if cut.any() else words)
                row = (int(ids[b.first + i]), len(words), int(cut.sum()), hashlib.sha256(kept).hexdigest())
                rows.append(row + ((kept.decode("utf-8", "replace"),) if texts else ()))
                begin = end
        return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return repeats.mark(docs, rule, _tree, finish, schema)
