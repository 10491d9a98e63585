"""Prompts and costs kept by the monitor against lists of every prompt."""

import random

from tokenloom.operators.alerts import AlertSettings
from tokenloom.streaming import monitor
from tokenloom.streaming.prompt import Item, Prompt, Spend
from test_rules import monitor_rows

LOW = AlertSettings(contributor_tokens=60, duplicate_tokens=50, low_entropy_tokens=40)


def log(seed, n=400):
    rng = random.Random(seed)
    for seq in range(n):
        kind, role = rng.choice(
            [("message", "user"), ("message", "assistant"), ("reasoning", None), ("tool_call", None), ("tool_result", None)] * 3
            + [("token_report", None)] * 4 + [("compacted", None), ("context_injection", None), ("turn_started", None)]
        )
        item = None
        if kind not in ("token_report", "turn_started"):
            place = "summary" if kind == "compacted" else rng.choice(["system", "plain"]) if kind == "context_injection" else "plain"
            raw = 10 * rng.randint(1, 12)
            fp = f"f{raw}" if place != "summary" and rng.random() < 0.7 else None
            item = Item(seq, f"i{seq}", None, raw, place, fp, rng.choice([None, 0.1, 0.7]))
        yield seq, kind, role, item, rng.choice([None, 150, 400, 2000])


def listed(rows, s):
    """Findings of every turn from the list of its items."""
    out, done, start = [], [], 0
    for at, (seq, kind, _, _, observed) in enumerate(rows):
        if kind != "token_report":
            continue
        opened, held = None, []
        for q, k, role, _, _ in rows[start:at]:
            if k in ("turn_started", "compacted") or (k, role) == ("message", "user"):
                opened = None
            elif opened is None and (k in ("reasoning", "tool_call") or (k, role) == ("message", "assistant")):
                opened = q
        cutoff = seq if opened is None else opened
        before = [r[3] for r in rows[:at] if r[3] is not None and r[0] < cutoff]
        last = max((i.seq for i in before if i.kind == "summary"), default=-1)
        held = [i for i in before if i.kind == "system" or i.seq > last or i.seq == last]
        est = sum(i.raw for i in held)
        total = est if observed is None else observed
        tokens = {i.seq: i.raw * total // est if est > total else i.raw for i in held}
        top = sorted(held, key=lambda i: (-tokens[i.seq], i.seq))[:20]
        out += [
            (seq, "large_contributor", i.item_id, tokens[i.seq])
            for i in top
            if tokens[i.seq] >= s.contributor_tokens or tokens[i.seq] / max(total, 1) >= s.contributor_share
        ]
        for fp in {i.fp for i in held if i.fp}:
            same = [tokens[i.seq] for i in held if i.fp == fp]
            if len(same) > 1 and sum(same[1:]) >= s.duplicate_tokens:
                out.append((seq, "duplicate_context", fp, sum(same[1:])))
        for i in held:
            waste = 0 if i.packed is None else int(tokens[i.seq] * (1 - i.packed) + 0.5)
            if i.packed is not None and waste >= s.low_entropy_tokens:
                out.append((seq, "low_entropy_content", i.item_id, waste))
        start = at + 1
    return sorted(out)


def test_prompt_sums_equal_listed_prompts():
    rules = set()
    for seed in range(12):
        rows = list(log(seed))
        prompt, got = Prompt(LOW), []
        for seq, kind, role, item, observed in rows:
            if kind == "token_report":
                got += [(seq, rule, key, amount) for rule, _, key, amount, _ in prompt.close(seq, observed)]
            else:
                prompt.record(kind, role, seq, item)
        assert sorted(got) == listed(rows, LOW)
        rules |= {g[1] for g in got}
    assert len(rules) == 3


def test_expected_cost():
    spend = Spend()
    assert spend.expected(10) == 0
    spend.add(100, [7, 2])
    spend.add(50, [8, 3])
    assert spend.expected(10) == 150 + 10 * (15 // 2 + 5 // 2)
    spend.add(None, None)
    assert spend.expected(10) == 150


def test_findings_do_not_depend_on_polls(spark, tmp_path):
    """One row a poll, all rows at once: the same feed; a change waits for the report that ends its turn."""
    base = dict(agent="codex", session_id="s", path="/l/1", window=None)
    ev = lambda seq, kind, **more: {**base, "seq": seq, "line_no": seq + 1, "kind": kind, "raw_type": kind, **more}
    body = lambda seq, raw, **more: ev(seq, "tool_result", item_id=f"codex:{seq + 1}", raw_tokens=raw, fp=f"f{raw}", **more)
    inject = lambda seq, size: ev(
        seq, "context_injection", mechanism="base_instructions", label="a/b.md", char_len=size, item_id=f"codex:{seq + 1}", raw_tokens=5
    )
    report = lambda seq, size: ev(seq, "token_report", prompt_tokens=size, micros=30, current_micros=[3, 1])
    rows = [
        inject(0, 50), body(1, 70, secret_kinds=["aws-access-key-id"], secret_counts=[2]), report(2, 500),
        inject(3, 90), body(4, 70), report(5, 500), ev(6, "compacted", item_id="codex:compaction:7", raw_tokens=9),
        body(7, 80, packed=0.25), report(8, None), inject(9, 95),
    ]
    settings = AlertSettings(contributor_tokens=60, duplicate_tokens=50, low_entropy_tokens=40, cost_budget_micros=105)
    feeds = []
    for name, polls in [("once", [rows]), ("pieces", [rows[:2], rows[2:4], rows[4:5], rows[5:8], rows[8:]])]:
        folder = lambda n: str(tmp_path / name / n)  # noqa: B023, E731
        for poll in polls:
            monitor_rows(spark, poll).coalesce(1).write.mode("append").parquet(folder("events"))
            run = monitor.run_monitor(spark, folder("events"), folder("feed"), folder("state"), settings)
            run.awaitTermination()
            assert run.exception() is None
        found = monitor.read_feed(spark, folder("feed")).where("rule <> 'compaction'").collect()
        feeds.append(sorted((r.rule, r.dedupe_key.split(":", 4)[4], r.amount) for r in found))
    assert feeds[0] == feeds[1]
    assert {f[0] for f in feeds[0]} == {
        "cost_budget", "duplicate_context", "instruction_drift", "large_contributor", "low_entropy_content", "secret_exposure"
    }
    assert ("instruction_drift", "instructions:s:base_instructions:2", 40) in feeds[0]
    assert not any("base_instructions:4" in f[1] for f in feeds[0])
