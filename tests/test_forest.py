"""Interval numbers, ways up, chain sums and stretches against walks over random forests."""

import random

import pytest
from pyspark.sql import functions as F

from tokenloom.operators import chains, lifecycle
from tokenloom.plans.dag import jump_tables
from tokenloom.plans.forest import intervals, path_sums, way_up

FOREST = "agent string, session_id string, node bigint, parent bigint, stop boolean"


def forest(seed, size, bushy):
    """Parents of ``size`` nodes; a third of the forests hang nodes below later ones."""
    rng, order = random.Random(seed), list(range(size))
    if seed % 3 == 0:
        rng.shuffle(order)
    parents = {}
    for i, node in enumerate(order):
        near = order[max(0, i - (size if bushy else 2)) : i]
        parents[node] = rng.choice(near) if near and rng.random() > 0.05 else None
    return parents


def chain(parents, node):
    out = []
    while node is not None:
        out.append(node)
        node = parents[node]
    return out


def frames(spark, parents):
    rows = [("claude-code", "s", n, p, False) for n, p in parents.items()]
    nodes = spark.createDataFrame(rows, FOREST).repartition(3)
    tables = jump_tables(nodes, ["agent", "session_id"])
    return nodes, tables, intervals(nodes, ["agent", "session_id"], tables)


KEYS = ["agent", "session_id"]


@pytest.mark.parametrize("seed, size, bushy", [(1, 40, True), (3, 40, True), (2, 60, False), (5, 1, True), (6, 30, False)])
def test_an_ancestor_is_an_interval(spark, seed, size, bushy):
    parents = forest(seed, size, bushy)
    nodes, tables, numbers = frames(spark, parents)
    at = {r["node"]: (r["entry"], r["end"]) for r in numbers.collect()}
    assert sorted(e for e, _ in at.values()) == list(range(size))
    for x in parents:
        below = {y for y in parents if at[x][0] <= at[y][0] < at[x][1]}
        assert below == {y for y in parents if x in chain(parents, y)}
    # Ways up stop below the first node that holds the other one.
    rng = random.Random(seed)
    pairs = [(i, rng.randrange(size), rng.choice([None, rng.randrange(size)])) for i in range(25)]
    starts = [("claude-code", "s", i, a, None if b is None else at[b][0]) for i, a, b in pairs]
    starts = spark.createDataFrame(starts, "agent string, session_id string, i bigint, node bigint, other bigint")
    got = {}
    for r in way_up(starts, KEYS, ["i"], tables, numbers).collect():
        got.setdefault(r["i"], []).append(r["node"])
    for i, a, b in pairs:
        shared = set() if b is None else set(chain(parents, b))
        assert sorted(got.get(i, [])) == sorted(set(chain(parents, a)) - shared)


def test_sums_over_chains(spark):
    parents = forest(9, 50, True)
    nodes, _, numbers = frames(spark, parents)
    weights = numbers.withColumn("g", F.when(F.col("node") % 3 == 0, "a").otherwise("b")).withColumn("w", F.col("node") * 7 + 1)
    points = numbers.select(*KEYS, F.col("node").alias("at"), "entry")
    got = {(r["at"], r["g"]): r["w"] for r in path_sums(weights, points, KEYS, "g", ["w"]).collect()}
    for n in parents:
        for g in "ab":
            want = sum(x * 7 + 1 for x in chain(parents, n) if (x % 3 == 0) == (g == "a"))
            assert got[n, g] == want


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_stretches_equal_listed_prompts(spark, seed):
    """Two threads, stop nodes, turns that hold nothing, and chains that are walked back."""
    rng, size = random.Random(seed), 45
    parents = forest(seed, size, seed % 2 == 0)
    stop = {n for n in parents if rng.random() < 0.06}
    side = {n: rng.random() < 0.2 for n in parents}
    occupies = {n: rng.random() < 0.8 for n in parents}
    rows = [("claude-code", "s", n, None if n in stop else p, False) for n, p in parents.items()]
    cut_off = {r[2]: r[3] for r in rows}
    nodes = spark.createDataFrame(rows, FOREST)
    tables = jump_tables(nodes, KEYS)
    numbers = intervals(nodes, KEYS, tables)
    facts = spark.createDataFrame([(n, side[n], occupies[n], n in stop) for n in parents], "node bigint, side boolean, occupies boolean, stop boolean")
    full = numbers.join(facts, "node")
    at = {r["node"]: r["entry"] for r in numbers.collect()}
    turns = [(t, rng.random() < 0.3, rng.choice([None, *[rng.randrange(size) for _ in range(5)]])) for t in range(1, 31)]
    bases = [("claude-code", "s", s, t, b, None if b is None else at[b]) for t, s, b in turns]
    bases = spark.createDataFrame(bases, "agent string, session_id string, side boolean, turn bigint, base bigint, base_entry bigint")
    changes = chains.presence_changes(full, tables, lifecycle.thread_order(bases))
    changes = changes.withColumnRenamed("seq", "item_id").withColumn("item_id", F.col("item_id").cast("string"))
    got = sorted((int(r["item_id"]), r["from_turn"], r["to_turn"], r["turns"]) for r in lifecycle.change_runs(changes).collect())
    want = []
    for thread in (False, True):
        order = [(t, set(chain(cut_off, b)) if b is not None else set()) for t, s, b in turns if s == thread]
        for n in parents:
            if not occupies[n] or n in stop or side[n] != thread:
                continue
            run = []
            for t, held in [*order, (None, set())]:
                if n in held:
                    run.append(t)
                elif run:
                    want.append((n, run[0], run[-1], len(run)))
                    run = []
    assert got == sorted(want) and len(want) > 10
