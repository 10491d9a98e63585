"""What a compaction kept, dropped and added, item by item."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.plans.scan import last_known, next_known, running, running_count
from tokenloom.schema import SESSION

#: Why a compaction cannot be compared.
UNAVAILABLE = [
    "oversized-raw-line",
    "unavailable-raw-line",
    "malformed-raw-line",
    "missing-replacement-history",
    "malformed-preceding-item",
    "unknown-preceding-history",
]


def multiset_match(
    history: DataFrame, replacement: DataFrame, keys: Sequence[str], identity: str = "fp"
) -> DataFrame:
    """Pair equal items first come, first served; the rest is dropped or added.

    Both sides carry ``idx``, the position inside ``keys``.  The n-th copy on one
    side meets the n-th copy on the other, so the match is an equality join;
    copies are numbered by block scans, so one content copied millions of times
    does not land in one task.
    """
    group = [*keys, identity]
    number = {"copy": running_count(F.lit(True), inclusive=True)}
    h = running(history, group, "idx", number).select(*group, "copy", F.col("idx").alias("history_index"))
    r = running(replacement, group, "idx", number).select(*group, "copy", F.col("idx").alias("replacement_index"))
    return h.join(r, [*group, "copy"], "full_outer").select(
        *group,
        "history_index",
        "replacement_index",
        F.when(F.col("history_index").isNull(), "added")
        .when(F.col("replacement_index").isNull(), "dropped")
        .otherwise("preserved")
        .alias("disposition"),
    )


def compaction_diffs(responses: DataFrame, compactions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(status per compaction, items)`` for straight logs.

    ``responses``: one row per response item with ``seq``, ``fp`` and
    ``problem`` (why it cannot be resolved, else NULL).  ``compactions``: one
    row per compaction with ``seq``, ``problem`` and ``replacement``, an array of
    structs with a field ``fp``.

    The history of a compaction is the previous replacement followed by the
    response items since.  A compaction without a usable replacement leaves the
    next one without known history.
    """
    chained = running(
        compactions,
        SESSION,
        "seq",
        {"prev": last_known(F.struct(F.col("seq").alias("seq"), F.col("problem").alias("problem")))},
    )
    # Each response item belongs to the next compaction after it.
    marks = compactions.select(*SESSION, "seq", F.lit(True).alias("is_comp"))
    lines = responses.select(*SESSION, "seq", "fp", F.col("problem").alias("item_problem"), F.lit(False).alias("is_comp"))
    both = lines.unionByName(marks, allowMissingColumns=True)
    placed = running(
        both, SESSION, "seq", {"comp_seq": next_known(F.when(F.col("is_comp"), F.col("seq")), inclusive=False)}
    ).where(~F.col("is_comp") & F.col("comp_seq").isNotNull())
    broken = placed.groupBy(*SESSION, F.col("comp_seq").alias("seq")).agg(
        F.min_by("item_problem", F.when(F.col("item_problem").isNotNull(), F.col("seq"))).alias("item_problem")
    )
    status = (
        chained.join(broken, [*SESSION, "seq"], "left")
        .withColumn(
            "unavailable",
            F.coalesce(
                "problem",
                F.when(F.col("prev.problem").isNotNull(), "unknown-preceding-history"),
                "item_problem",
            ),
        )
        .select(*SESSION, F.col("seq").alias("comp_seq"), F.col("prev.seq").alias("prev_seq"), "unavailable", "replacement")
    )
    usable = status.where(F.col("unavailable").isNull())
    replaced = usable.select(*SESSION, "comp_seq", F.posexplode("replacement").alias("idx", "r")).select(
        *SESSION, "comp_seq", F.col("idx").cast("bigint").alias("idx"), "r.fp"
    )
    inherited = (
        usable.where(F.col("prev_seq").isNotNull())
        .select(*SESSION, "comp_seq", F.col("prev_seq").alias("seq"))
        .join(compactions.select(*SESSION, "seq", "replacement"), [*SESSION, "seq"])
        .select(*SESSION, "comp_seq", F.posexplode("replacement").alias("idx", "r"))
        .select(*SESSION, "comp_seq", F.col("idx").cast("bigint").alias("at"), F.col("r.fp").alias("fp"), F.lit(0).alias("part"))
    )
    since = placed.join(usable.select(*SESSION, "comp_seq"), [*SESSION, "comp_seq"]).select(
        *SESSION, "comp_seq", F.col("seq").alias("at"), "fp", F.lit(1).alias("part")
    )
    sizes = inherited.groupBy(*SESSION, "comp_seq").agg(F.count(F.lit(1)).alias("before"))
    numbered = running(since, [*SESSION, "comp_seq"], "at", {"n": running_count(F.lit(True))})
    history = inherited.select(*SESSION, "comp_seq", "fp", F.col("at").alias("idx")).unionByName(
        numbered.join(sizes, [*SESSION, "comp_seq"], "left").select(
            *SESSION, "comp_seq", "fp", (F.coalesce("before", F.lit(0)) + F.col("n")).alias("idx")
        )
    )
    items = multiset_match(history, replaced, [*SESSION, "comp_seq"])
    return status.drop("replacement", "prev_seq"), items
