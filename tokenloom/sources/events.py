"""Bring rows into the event schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.schema import EVENTS


def conform(df: DataFrame) -> DataFrame:
    """Event columns in schema order, NULL where absent; other columns come first."""
    known = set(EVENTS.fieldNames())
    return df.select(
        *[c for c in df.columns if c not in known],
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in EVENTS.fields
        ],
    )
