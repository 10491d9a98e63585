"""Hard-negative mining against all pairs in Python's whole numbers."""

import math

import numpy as np
import pytest

from tokenloom.llm import hard_negatives as hard

ROWS = "vec_id long, label int, embedding array<double>, row string, score long"


def brute(rows, scale=256):
    fine = []
    for vec_id, label, vector in rows:
        if None not in (vec_id, label, vector) and all(x is not None and math.isfinite(x) for x in vector):
            fine.append((vec_id, label, [math.floor(scale * x) for x in vector]))
    out = []
    for i, (anchor, label, vector) in enumerate(fine):
        if anchor % 100:
            continue
        scored = [
            (-sum(map(lambda x, y: x * y, vector, v)), other, l == label)
            for j, (other, l, v) in enumerate(fine)
            if j != i and len(v) == len(vector)
        ]
        scored.sort()
        for p, positive, _ in [s for s in scored if s[2]][:5]:
            window = [s for s in scored if not s[2] and 30 * -p <= 100 * -s[0] <= 90 * -p][:10]
            out += [(anchor, positive, k + 1, s[1], -p, -s[0]) for k, s in enumerate(window)]
    return sorted(out)


def vectors(seed, n, size, copies=0):
    rng = np.random.default_rng(seed)
    rows = [(i * 5, int(rng.integers(0, 4)), (rng.normal(size=size) * 0.3 + 0.2).tolist()) for i in range(n)]
    rows += [(1000 + i, 1 + i % 2, rows[0][2]) for i in range(copies)]
    return rows


ODD = [
    (None, 1, [1.0, 2.0, 0.5]), (100, None, [1.0, 2.0, 0.5]), (200, 1, None), (300, 2, [1.0, None, 1.0]),
    (400, 2, [1.0, float("nan"), 1.0]), (500, 2, [float("inf"), 1.0, 1.0]), (600, 2, []), (601, 2, []), (602, 3, []),
    (700, 1, [1.0, 2.0]), (701, 1, [1.0, 1.5]), (702, 2, [0.5, 1.0]), (100, 1, [1.0, 2.0, 0.5]), (100, 1, [1.0, 2.0, 0.5]),
    (2**53 + 1, 2, [0.5, 1.0, 0.3]), (2**53 + 3, 2, [0.4, 1.0, 0.3]), (800, 1, [0.0, 0.0, 0.0]),
]


@pytest.mark.parametrize("block", [8192, 7])
@pytest.mark.parametrize(
    "rows", [vectors(1, 120, 6), vectors(2, 60, 6, copies=80), ODD + vectors(3, 40, 3), ODD, []], ids=["plain", "ties", "odd", "few", "empty"]
)
def test_mining_equals_all_pairs(spark, rows, block):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS).repartition(3)
    assert sorted(map(tuple, hard.mine(frame, block=block).collect())) == brute(rows)


@pytest.mark.parametrize("scale, size", [(300, 64), (1e6, 7), (2.0**31, 64), (1e15, 5), (200, 3000), (1e30, 3)])
def test_products_are_exact_or_saturated(scale, size):
    rng = np.random.default_rng(size)
    a, b = (np.floor(rng.normal(size=(n, size)) * scale) for n in (9, 14))
    top = 2**63 - 1
    want = [[max(-top, min(top, sum(int(x) * int(y) for x, y in zip(r, s)))) for s in b] for r in a]
    assert hard.inner_products(hard.Residues(a), hard.Residues(b)).tolist() == want


def test_float32_sums_stay_exact_for_every_prime():
    for p in hard.small_primes():
        depth = (hard.EXACT - 1) // (p // 2) ** 2 - 1
        assert depth >= 1 and depth * (p // 2) ** 2 + p // 2 < hard.EXACT


def test_large_scores_keep_their_order(spark):
    rows = [(0, 1, [3e8, 1.0]), (1, 1, [2.9e8, 0.0]), (2, 2, [2e8, 5.0]), (3, 2, [2e8, 4.0]), (4, 2, [2.8e8, 1.0])]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS)
    got = sorted(map(tuple, hard.mine(frame, scale=1).collect()))
    assert got == brute(rows, 1) and [r[3] for r in got] == [2, 3]
