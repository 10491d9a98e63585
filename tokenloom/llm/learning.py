"""What the two classifiers share: folds, bounded samples of labelled rows, numpy training."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; NULL for rows without id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, bound: int) -> DataFrame:
    """``(doc_id, text, label)`` of at most ``bound`` labelled rows outside the held fold, by hash order.

    Only labels 0 and 1 count; an id that is labelled both ways is not used.  Only ids
    are ordered, and only the chosen ones are joined to their texts.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label"))
    rows = rows.where((fold("doc_id", folds) != held) & F.col("label").isin(0, 1))
    rows = rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most"))
    rows = rows.where("label = most").select("doc_id", "label")
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def adam(parameters: list[np.ndarray], gradient, rounds: int, rate: float) -> list[np.ndarray]:
    """Full-batch Adam; ``gradient(parameters)`` returns one array per parameter."""
    first = [np.zeros_like(p) for p in parameters]
    second = [np.zeros_like(p) for p in parameters]
    for t in range(1, rounds + 1):
        for i, g in enumerate(gradient(parameters)):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            step = first[i] / (1 - 0.9**t) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
            parameters[i] = parameters[i] - rate * step
    return parameters


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))
