"""The normalised tables the queries share: ingested once per session and data folder.

This is the deployment shape: an ingest job writes events and turns, queries
read the tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom import bridge
from tokenloom.operators.chains import link_parents
from tokenloom.operators.reconstruct import item_pool, name_results
from tokenloom.operators.turns import (
    assign_graph_turns,
    assign_linear_turns,
    graph_turns,
    linear_context_sizes,
    linear_turns,
)
from tokenloom.schema import RATIO_LINEAR_AGENT
from tokenloom.session import stage

_TABLES: dict[tuple[str, str, str], DataFrame] = {}

Builder = Callable[[SparkSession, str], DataFrame]


def table(build: Builder) -> Builder:
    """Write the built table on first use; afterwards read the written one."""

    @wraps(build)
    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, build.__name__)
        if key not in _TABLES:
            _TABLES[key] = stage(build(spark, sf_dir))
        return _TABLES[key]

    return get


@table
def linear_events(spark, sf_dir):
    return assign_linear_turns(bridge.log_events(spark, sf_dir), RATIO_LINEAR_AGENT)


@table
def linear_turn_table(spark, sf_dir):
    assigned = linear_events(spark, sf_dir)
    return linear_context_sizes(assigned, linear_turns(assigned))


@table
def linear_items(spark, sf_dir):
    return item_pool(name_results(linear_events(spark, sf_dir)))


@table
def graph_log(spark, sf_dir):
    return link_parents(assign_graph_turns(bridge.graph_events(spark, sf_dir)))


@table
def graph_turn_table(spark, sf_dir):
    return graph_turns(graph_log(spark, sf_dir))


@table
def conversation_log(spark, sf_dir):
    return assign_linear_turns(bridge.conversation_events(spark, sf_dir).drop("content"), RATIO_LINEAR_AGENT)


@table
def conversation_turns(spark, sf_dir):
    return linear_turns(conversation_log(spark, sf_dir))


@table
def conversation_items(spark, sf_dir):
    return item_pool(name_results(conversation_log(spark, sf_dir)))


def r6(column: str | F.Column, name: str | None = None):
    """Round a ratio to six places for comparison."""
    col = F.col(column) if isinstance(column, str) else column
    return F.round(col, 6).alias(name or column)
