"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; the other side is unlabelled text that
holds toxic documents in a share ``prior``.  The risk of a classifier ``f`` is

    prior * mean_P loss(f) + max(0, mean_U loss(-f) - prior * mean_P loss(-f))

where the second term estimates the loss on clean text from unlabelled text and is
held at zero or above, or else the model would fit single unlabelled rows.  With the
logistic loss the score ``sigmoid(f)`` is a probability.

A document is the set of its lower-cased words without marks around them, hashed to
``2 ** BITS`` numbers.  The classifier is linear in the ``FEATURES`` numbers whose
share among positives exceeds that among unlabelled rows by most deviations; a penalty
moves weights without use to zero.  At most ``ROWS`` labelled and ``UNLABELLED`` other
rows outside the held fold are read to fit; the unlabelled side holds the others and the
labelled rows with their labels taken off, and the prior is the share of label 1.  The
labels then only set slope and shift of the score (:func:`calibrate`).  All documents
are scored, whole.

Results for odd input: NULL and empty texts have no words and get the score of the
bias; rows without id are scored and count as held out; without a positive row every
score is 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import beside, encode
from tokenloom.llm.learning import adam, fold, sample, sigmoid
from tokenloom.llm.repeats import word_hashes, word_spans

FOLDS, HELD = 3, 1
ROWS, UNLABELLED, FEATURES, BITS = 10_000, 10_000, 256, 20
THRESHOLD = 0.7

#: Bytes that belong to a word's core: letters, digits and everything outside ASCII.
_CORE = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
_BLANK = np.where(_CORE, _FOLDED, 32).astype(np.uint8)


def word_numbers(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words of some texts, and the text each is in."""
    data = _BLANK[np.frombuffer(b" ".join(texts), np.uint8)]
    starts, stops = word_spans(data)
    limits = np.cumsum([len(t) + 1 for t in texts])
    numbers = (word_hashes(data, starts, stops) >> np.uint64(64 - BITS)).astype(np.int64)
    return numbers, np.searchsorted(limits, starts, "right")


def fit(sets: list[np.ndarray], positive: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Chosen numbers, their weights and the bias, from word sets of positives and of unlabelled rows."""
    n_p, n_u = int(positive.sum()), int((~positive).sum())
    flat = np.concatenate(sets)
    owner = np.repeat(positive, [len(s) for s in sets])
    names, number = np.unique(flat, return_inverse=True)
    in_p = np.bincount(number, owner, len(names))
    in_u = np.bincount(number, ~owner, len(names))
    share = (in_p + in_u) / (n_p + n_u)
    gap = (in_p / n_p - in_u / n_u) / np.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u) + 1e-12)
    chosen = np.sort(names[np.lexsort((names, -gap))[:FEATURES]])
    rows = np.zeros((len(sets), len(chosen)), np.float32)
    at = np.minimum(np.searchsorted(chosen, flat), len(chosen) - 1)
    hit = chosen[at] == flat
    rows[np.repeat(np.arange(len(sets)), [len(s) for s in sets])[hit], at[hit]] = 1
    p, u = rows[positive], rows[~positive]

    def gradient(parameters):
        weights, bias = parameters
        fp, fu = p @ weights + bias, u @ weights + bias
        zp, zu = sigmoid(fp), sigmoid(fu)
        # Slopes of the three means of the logistic loss with respect to f.
        slope_p, slope_u = prior * (zp - 1) / n_p, np.zeros(n_u)
        if np.logaddexp(0, fu).mean() > prior * np.logaddexp(0, fp).mean():
            slope_p, slope_u = slope_p - prior * zp / n_p, zu / n_u
        # Held at zero, the estimate of the loss on clean text has no slope; the positives' own stays.
        return [
            p.T @ slope_p + u.T @ slope_u + 1e-5 * np.sign(weights) + 1e-5 * weights,
            np.array(slope_p.sum() + slope_u.sum()),
        ]

    start = [np.zeros(len(chosen)), np.array(np.log(prior / (1 - prior)))]
    weights, bias = adam(start, gradient, 600, 0.05)
    return chosen, weights, float(bias)


def calibrate(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make ``sigmoid(slope * margin + shift)`` fit labels; drawn towards 1 and 0."""

    def gradient(parameters):
        slope, shift = parameters
        off = (sigmoid(slope * margin + shift) - label) / len(label)
        return [np.array((off * margin).sum() + 1e-3 * (slope - 1)), np.array(off.sum() + 1e-3 * shift)]

    slope, shift = adam([np.array(1.0), np.array(0.0)], gradient, 300, 0.05)
    return max(float(slope), 0.1), float(shift)


def _unlabelled(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """``(doc_id, text)`` of at most ``bound`` documents outside the held fold that have no label, by hash order."""
    ids = docs.select("doc_id").where(fold("doc_id", FOLDS) != HELD).distinct()
    ids = ids.join(labels.where("toxic is not null").select("doc_id").distinct(), "doc_id", "left_anti")
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """The model, fitted on the driver from the word sets of two bounded samples."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            numbers, owner = word_numbers(encode(batch["text"]))
            pairs = np.unique(np.stack((owner, numbers), 1), axis=0)
            cuts = np.searchsorted(pairs[:, 0], np.arange(1, len(batch)))
            held = [x[:, 1].astype(np.int32).tobytes() for x in np.split(pairs, cuts)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "words": held})

    chosen = sample(docs, labels, "toxic", FOLDS, HELD, ROWS).select("doc_id", "text", "label")
    others = _unlabelled(docs, labels, UNLABELLED).withColumn("label", F.lit(-1))
    rows = chosen.unionByName(others).mapInPandas(sets, "doc_id long, label int, words binary").toPandas()
    # Rows that repeat an id are told apart by their words.
    rows = rows.sort_values(["doc_id", "words"], kind="stable")
    label = rows["label"].to_numpy()
    if not (label == 1).any():
        return np.empty(0, np.int64), np.empty(0), -np.inf
    words = [np.frombuffer(w, np.int32).astype(np.int64) for w in rows["words"]]
    # The unlabelled side: documents without label, and the labelled ones with theirs taken off.
    both = [w for w, y in zip(words, label) if y == 1] + words
    positive = np.arange(len(both)) < (label == 1).sum()
    prior = float(np.clip(label[label >= 0].mean(), 1e-3, 0.999))
    numbers, weights, bias = fit(both, positive, prior)
    table = np.zeros(1 << BITS)
    table[numbers] = weights
    margin = np.array([table[w].sum() for w, y in zip(words, label) if y >= 0]) + bias
    slope, shift = calibrate(margin, label[label >= 0])
    return numbers, weights * slope, bias * slope + shift


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document."""
    chosen, weights, bias = train(docs, labels)
    table = np.zeros(1 << BITS, np.float64)
    table[chosen] = weights

    def work(texts: list) -> list:
        numbers, owner = word_numbers(encode(texts))
        useful = np.flatnonzero(table[numbers])
        pairs = np.unique(np.stack((owner[useful], numbers[useful]), 1), axis=0)
        return [sigmoid(np.bincount(pairs[:, 0], table[pairs[:, 1]], len(texts)) + bias)]

    held = F.coalesce(fold("doc_id", FOLDS) == HELD, F.lit(True)).alias("held_out")
    scored = beside(docs.select("doc_id", held, "text"), work, "score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
