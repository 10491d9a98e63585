"""Scans, order statistics, chains and digests against plain Python."""

import datetime as dt
import random
import statistics

from pyspark.sql import functions as F

from tokenloom.operators.cost import as_of_revision
from tokenloom.operators.reconstruct import linear_members
from tokenloom.plans.dag import ancestor_totals, chain_members, jump_tables
from tokenloom.plans.digest import ordered_digest
from tokenloom.plans.hops import on_path
from tokenloom.plans.quantile import median_ranks, nearest_rank, ranked_values
from tokenloom.plans.scan import (
    dense_number,
    last_known,
    neighbour_window,
    next_known,
    running,
    running_max,
    running_sum,
    with_neighbours,
)
from tokenloom.plans.skew import broadcast_if_small, top_k_per_group
from tokenloom.sinks import feed


def test_running_measures_cross_blocks(spark):
    rng = random.Random(1)
    rows = [(k, i * 2 + rng.randint(0, 1), rng.choice([None, rng.randint(0, 9)])) for k in "ab" for i in range(60)]
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint")
    out = running(
        df,
        ["k"],
        "i",
        {
            "s": running_sum(F.col("v")),
            "m": running_max(F.col("v"), inclusive=True),
            "l": last_known(F.col("v")),
            "n": next_known(F.col("v"), inclusive=False),
        },
    ).collect()
    got = {(r.k, r.i): r for r in out}
    for key in "ab":
        seq = sorted(r for r in rows if r[0] == key)
        for at, (_, i, v) in enumerate(seq):
            before = [x[2] for x in seq[:at] if x[2] is not None]
            after = [x[2] for x in seq[at + 1 :] if x[2] is not None]
            r = got[key, i]
            assert r.s == sum(before)
            assert r.l == (before[-1] if before else None)
            assert r.n == (after[0] if after else None)
            upto = before + ([v] if v is not None else [])
            assert r.m == (max(upto) if upto else None)


def test_bounded_frames_are_complete_at_block_edges(spark):
    df = dense_number(spark.range(40).select(F.lit("a").alias("k"), (F.col("id") * 3).alias("i")), ["k"], "i")
    frame = neighbour_window(["k"], "n")
    out = with_neighbours(
        df, ["k"], "n", 5, 4, {"back": F.sum("n").over(frame.rowsBetween(-5, -1)), "ahead": F.sum("n").over(frame.rowsBetween(0, 4))}
    ).collect()
    assert len(out) == 40
    for r in out:
        assert (r.back or 0) == sum(x for x in range(r.n - 5, r.n) if x >= 1)
        assert r.ahead == sum(x for x in range(r.n, r.n + 5) if x <= 40)


def test_order_statistics_match_sorting(spark):
    rng = random.Random(2)
    values = [round(rng.choice([1.5, rng.uniform(0.5, 20)]), 3) for _ in range(101)]
    df = spark.createDataFrame([("a", v) for v in values], "k string, v double")
    r = ranked_values(
        df, ["k"], "v", {**median_ranks("m"), "p75": nearest_rank(0.75)}, bucket=F.floor(F.col("v"))
    ).first()
    assert (r.m_low + r.m_high) / 2 == statistics.median(values)
    assert r.p75 == sorted(values)[75]


def nodes(spark, parents, stops=()):
    rows = [("s", i, p, i in stops) for i, p in parents.items()]
    return spark.createDataFrame(rows, "k string, node bigint, parent bigint, stop boolean")


def test_chain_totals_and_members(spark):
    rng = random.Random(3)
    parents = {i: (None if i == 0 or rng.random() < 0.05 else rng.randint(max(0, i - 4), i - 1)) for i in range(80)}
    stops = {17, 40}
    df = nodes(spark, parents, stops)
    got = {r.node: r for r in ancestor_totals(df, ["k"], {"total": F.col("node")}).collect()}
    starts = df.select("k", F.col("node").alias("label"), "node")
    members = {}
    for r in chain_members(starts, ["k"], ["label"], jump_tables(df, ["k"])).collect():
        members.setdefault(r.label, {})[r.distance] = r.node
    for node in parents:
        walk, at = [], node
        while at is not None:
            walk.append(at)
            at = None if at in stops else parents[at]
        assert got[node].resolved
        assert got[node].total == sum(x for x in walk if x not in stops)
        assert got[node].depth == len(walk)
        assert got[node].stop_at == next((x for x in walk if x in stops), None)
        assert [members[node][d] for d in range(len(walk))] == walk


def test_only_circles_are_unresolved(spark):
    parents = {0: 2, 1: 0, 2: 1, 3: 2, 4: None, 5: 4}
    got = {r.node: r.resolved for r in ancestor_totals(nodes(spark, parents), ["k"], {}).collect()}
    assert got == {0: False, 1: False, 2: False, 3: False, 4: True, 5: True}


def test_chains_may_have_any_length(spark):
    size = 100_003
    n = F.col("id")
    line = spark.range(size).select(
        F.lit("a").alias("k"), n.alias("node"), F.when(n > 0, n - 1).alias("parent"), F.lit(False).alias("stop")
    )
    got = ancestor_totals(line, ["k"], {"n": F.lit(1)}).agg(F.bool_and("resolved"), F.max("depth"), F.sum("n")).first()
    assert tuple(got) == (True, size, size * (size + 1) // 2)


def test_star_of_one_hot_parent(spark):
    parents = {0: None, **{i: 0 for i in range(1, 300)}}
    got = ancestor_totals(nodes(spark, parents), ["k"], {"n": F.lit(1)}).agg(F.sum("n")).first()[0]
    assert got == 1 + 2 * 299


def test_top_k_of_a_hot_group(spark):
    df = spark.range(1000).select(F.lit("hot").alias("k"), F.col("id"), (F.col("id") % 97).alias("v"))
    top = top_k_per_group(df, ["k"], [F.col("v").desc(), F.col("id")], 5, spread=F.col("id"))
    want = sorted(((i % 97, i) for i in range(1000)), key=lambda x: (-x[0], x[1]))[:5]
    assert [(r.v, r.id) for r in top.orderBy("rank").collect()] == want


def test_broadcast_only_below_the_limit(spark):
    small, big = broadcast_if_small(spark.range(5), 10), broadcast_if_small(spark.range(50), 10)
    assert "broadcast" in small._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in big._jdf.queryExecution().logical().toString().lower()


def test_ordered_digest_sees_order_and_content(spark):
    def digest(values):
        rows = [("s", i + 1, v) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, "k string, at bigint, d string").repartition(3)
        return ordered_digest(df, ["k"], "at", "d", "x").first().x

    a = [str(i) for i in range(5000)]
    swapped = a[:4095] + [a[4096], a[4095]] + a[4097:]
    assert digest(a) == digest(list(a)) != digest(swapped)
    assert digest(a) != digest(a[:-1])


def test_paths_of_hops_cross_blocks(spark):
    rng = random.Random(9)
    seqs = {k: [rng.randint(1, 4) if rng.random() < 0.98 else None for _ in range(n)] for k, n in [("a", 1), ("b", 70), ("c", 300)]}
    seqs["d"] = [4] * 200
    rows = [(k, i + 1, h) for k, hops in seqs.items() for i, h in enumerate(hops)]
    got = on_path(spark.createDataFrame(rows, "k string, n bigint, hop int"), ["k"], "n", "hop", 4, bits=2).collect()
    for k, hops in seqs.items():
        want, at = [], 0
        while at is not None and at < len(hops):
            want.append(at + 1)
            at = None if hops[at] is None else at + hops[at]
        assert sorted(r.n for r in got if r.k == k) == want


def test_items_meet_the_turns_that_hold_them(spark):
    rng = random.Random(4)
    kinds = ["user", "model", "system-prompt", "compaction-summary", None]
    items = [("x", s, f"i{q}", q, rng.choice(kinds)) for s in "ab" for q in range(60)]
    turns = []
    for s in "ab":
        for t in range(12):
            comp = rng.choice([None, rng.randint(0, 55)])
            turns.append(("x", s, t, None if t == 11 else rng.randint(0, 62), comp))
    pool = spark.createDataFrame(items, "agent string, session_id string, item_id string, seq bigint, source_kind string")
    asked = spark.createDataFrame(turns, "agent string, session_id string, turn bigint, cutoff_seq bigint, comp_seq bigint")
    got = sorted((r.session_id, r.turn, r.seq) for r in linear_members(pool, asked, width=7).collect())
    want = []
    for _, s, t, cutoff, comp in turns:
        for _, s2, _, q, kind in items:
            if s2 == s and cutoff is not None and q < cutoff:
                if q == comp if kind == "compaction-summary" else comp is None or q > comp or kind == "system-prompt":
                    want.append((s, t, q))
    assert got == sorted(want) and got


def test_marks_cover_records_across_blocks(spark):
    rng = random.Random(8)
    spark.conf.set("tokenloom.scan.blockRows", "5")
    try:
        day = dt.datetime(2026, 1, 1)
        marks = [
            (rng.choice([None, rng.randint(1, 40)]), rng.randint(0, 45), rng.choice(["read", "dismiss"]), day + dt.timedelta(hours=i))
            for i in rng.sample(range(50), 14)
        ]
        records = spark.range(1, 41).select("id")
        got = feed.with_state(records, spark.createDataFrame(marks, "id bigint, up_to_id bigint, action string, at timestamp")).collect()
    finally:
        spark.conf.unset("tokenloom.scan.blockRows")
    assert len(got) == 40
    for r in got:
        reads = [at for i, up, act, at in marks if act == "read" and (i == r.id or i is None and up >= r.id)]
        gone = [at for i, up, act, at in marks if act == "dismiss" and i == r.id]
        assert (r.read_at, r.dismissed_at) == (min(reads, default=None), min(gone, default=None))


def test_prices_in_force_across_days(spark):
    day = dt.datetime(2026, 1, 1)
    rng = random.Random(2)
    revisions = [(f"v{i:02d}", day + dt.timedelta(hours=rng.choice([0, 5, 30, 31, 80, 200]))) for i in range(12)]
    now = day + dt.timedelta(hours=150)
    asked = [(i, None if i % 9 == 0 else day + dt.timedelta(hours=i - 5)) for i in range(170)]
    got = as_of_revision(
        spark.createDataFrame(asked, "i bigint, ts timestamp"), spark.createDataFrame(revisions, "sha string, recorded_at timestamp"), now
    ).collect()
    assert len(got) == len(asked)
    for r in got:
        at = r.ts or now
        known = [(rec, sha) for sha, rec in revisions if rec <= at and rec <= now]
        assert r.sha == (max(known)[1] if known and at <= now else None)
