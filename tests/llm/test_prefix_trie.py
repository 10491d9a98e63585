"""The prefix trie against a dictionary of all prefixes."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import prefix_trie as trie

TURNS = "conv_id long, turn long, role string, text string, depth long, owner string, place long"


def run(frame):
    base = F.col("conv_id") - F.col("conv_id") % 100
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    rows = trie.trie(*trie.rebuild(trie.turns(frame), base, head, 5)).collect()
    return sorted(tuple(-1 if x is None else x for x in r) for r in rows)


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for conv, turns in own.items():
        head = zlib.crc32(str(conv).encode()) % 6
        rebuilt[conv] = own.get(conv - int(math.fmod(conv, 100)), [])[:head] + turns[head:]
    members = defaultdict(list)
    for conv in sorted(rebuilt):
        for d in range(len(rebuilt[conv]) + 1):
            members[tuple(rebuilt[conv][:d])].append(conv)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, at in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(at) - 1) * len(node[-1][1]) if node else 0
    out = []
    for node, at in members.items():
        ends = ",".join(str(c) for c in at if len(rebuilt[c]) == len(node))
        parent = members[node[:-1]][0] if node else -1
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((at[0], len(node), parent, len(at), children[node], leaves[node], saved[node], digest))
    return sorted(out)


def story(seed, size, long=0):
    rng, rows = random.Random(seed), []
    for _ in range(size):
        conv = rng.choice([rng.randint(-250, 250), rng.randint(0, 30), 100 * rng.randint(0, 3), 2**53 + rng.randint(0, 3)])
        for t in range(rng.randint(1, 7)):
            text = rng.choice(["x", "yé", "zzz", None, "", "w" * 3000])
            rows.append((conv, rng.choice([t, t, None]), rng.choice(["u", "a", None]), text))
    rows += [(c, t, "u", "x") for t in range(long) for c in (7, 8)]
    return rows + [(None, 1, "a", "b")] + rows[:3]


@pytest.mark.parametrize("block, shard", [(1024, 65_536), (4, 3)])
@pytest.mark.parametrize(
    "rows",
    [story(1, 60), story(2, 150, 40), [], [(5, 0, "u", "a")], [(None, 1, "u", "a")], [(c, 0, "u", "a") for c in range(150)]],
    ids=["few", "long", "empty", "one", "no id", "copies"],
)
def test_trie_equals_all_prefixes(spark, monkeypatch, rows, block, shard):
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "SHARD", shard)
    monkeypatch.setattr(trie, "RUN", shard)
    frame = spark.createDataFrame([(*r, 1, "o", 2) for r in rows], TURNS).repartition(5)
    assert run(frame) == brute(rows)


@pytest.mark.parametrize("nodes", [1, 5, 100, 3000])
def test_findclose(nodes):
    rng, steps, depth, opened, stack, want = random.Random(nodes), [], 0, 0, [], {}
    while len(steps) < 2 * nodes:
        up = opened < nodes and (not depth or rng.random() < 0.55)
        steps.append(1 if up else -1)
        depth, opened = depth + steps[-1], opened + up
        if up:
            stack.append(len(steps) - 1)
        else:
            want[stack.pop()] = len(steps) - 1
    steps = np.array(steps, np.int8)
    opens = np.flatnonzero(steps == 1)
    assert trie.Parentheses(steps).findclose(opens).tolist() == [want[i] for i in opens.tolist()]


def test_a_long_way_down_is_one_path():
    lengths = np.array([5000, 1])
    names = np.concatenate((np.arange(5000), [0]))[:, None].repeat(2, 1)
    leaf = np.arange(5001) == 4999
    at, _, leaves, saved = trie.subtree_sums(lengths, names, np.ones(5001, np.int64), leaf)
    assert len(at) == 5000 and (leaves == 1).all()
    assert saved[0] == 5001 and saved[1] == 4999 and saved[-1] == 1
