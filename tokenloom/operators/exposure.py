"""Where credential-shaped text entered the context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions import secrets
from tokenloom.operators.turns import occupies_context
from tokenloom.plans.skew import top_k_per_group
from tokenloom.schema import SESSION


def kinds_found(texts: DataFrame, text: str) -> DataFrame:
    """One row per row of ``texts`` and kind found in its column ``text``, as ``f``; the text itself is dropped.

    A plain ``explode`` would be preceded by a filter that scans every text once more.
    """
    rest = [c for c in texts.columns if c != text]
    return texts.select(*rest, F.explode_outer(secrets.scan(F.col(text))).alias("f")).where(F.col("f").isNotNull())


def findings(events: DataFrame) -> DataFrame:
    """(kind, occurrences) per record, with turn, line and record type; never a value.

    ``events`` carry ``raw``; only records that reach the model are scanned, in
    decoded form, because an escape in front of a key hides where the key begins.
    """
    severity = F.create_map(*[F.lit(x) for pair in secrets.SEVERITY.items() for x in pair])
    # The decoded text is a column of its own, so the rules share it.
    texts = events.where(occupies_context()).select(
        *SESSION, "line_no", "turn", "raw_type", secrets.record_text(F.col("raw")).alias("__text")
    )
    found = kinds_found(texts, "__text")
    return found.select(
        *SESSION,
        "line_no",
        "turn",
        F.col("raw_type").alias("event_type"),
        F.col("f.kind").alias("kind"),
        F.col("f.occurrences").alias("occurrences"),
        severity[F.col("f.kind")].alias("severity"),
    )


def scan_counts(events: DataFrame) -> DataFrame:
    """Records scanned and records whose text was not available, per session."""
    return events.where(occupies_context()).groupBy(*SESSION).agg(
        F.count("raw").alias("scanned_records"),
        F.count_if(F.col("raw").isNull()).alias("unreadable_records"),
    )


def first_findings(found: DataFrame, k: int = 12) -> DataFrame:
    """The first ``k`` findings of every session in log order."""
    return top_k_per_group(found, SESSION, [F.col("line_no"), F.col("kind")], k, spread=F.col("line_no"))
