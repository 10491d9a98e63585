"""What the open prompt of one straight-log session holds, as far as alert rules need it.

A prompt is known by sums: the tokens of its items, its copies per content, and the few
items that could be reported.  Records enter in log order; those behind the start of a
response wait for the next turn, and a compaction leaves the system prompts and its own
summary.  Everything here is bounded by what one prompt holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

from tokenloom.operators.alerts import AlertSettings

#: Largest items of a prompt that are looked at.
TOP = 20


class Item(NamedTuple):
    """One record in the prompt; ``packed`` is its compression ratio where that is low."""

    seq: int
    item_id: str
    label: str | None
    raw: int
    kind: str
    fp: str | None
    packed: float | None


#: An :class:`Item` as a row of list state; ``kind`` is ``system``, ``summary`` or ``plain``.
ITEM_STATE = "seq bigint, item_id string, label string, raw bigint, kind string, fp string, packed double"
#: Copies of one content, which all have the same size.
COPY_STATE = "copies bigint, raw bigint"


class Prompt:
    """Items of the open prompt; :meth:`close` yields what a finished turn shows."""

    def __init__(self, settings: AlertSettings, raw: int = 0, opened: int | None = None):
        self.settings = settings
        self.raw, self.opened = raw, opened
        self.tail: list[Item] = []
        self.system: list[Item] = []
        self.large: list[Item] = []
        self.poor: list[Item] = []
        self.copies: dict[str, tuple[int, int]] = {}
        #: Contents whose number of copies changed, and whether older ones are gone.
        self.touched: set[str] = set()
        self.emptied = False

    def record(self, kind: str, role: str | None, seq: int, item: Item | None) -> None:
        """Take one record of the open turn."""
        user = kind == "message" and role == "user"
        if user or kind in ("turn_started", "compacted"):
            self.opened = None
        elif self.opened is None and (kind in ("reasoning", "tool_call") or (kind == "message" and role == "assistant")):
            self.opened = seq
        if item is not None:
            self.tail.append(item)

    def close(self, seq: int, observed: int | None) -> Iterator[tuple[str, Item | None, str, int, str | None]]:
        """``(rule, item, key, amount, detail)`` of the turn that the report at ``seq`` ends."""
        cutoff = seq if self.opened is None else self.opened
        self.opened = None
        for item in self.tail:
            if item.seq < cutoff:
                self._take(item)
        self.tail = [item for item in self.tail if item.seq >= cutoff]
        s, est = self.settings, self.raw
        total = est if observed is None else observed
        scaled = lambda raw: raw * total // est if est > total else raw
        ranked = sorted(((scaled(i.raw), i) for i in self.large), key=lambda x: (-x[0], x[1].seq))
        for tokens, item in ranked[:TOP]:
            if tokens >= s.contributor_tokens or tokens / max(total, 1) >= s.contributor_share:
                yield "large_contributor", item, item.item_id, tokens, short_name(item.label)
        for fp, (copies, raw) in self.copies.items():
            repeated = (copies - 1) * scaled(raw)
            if copies > 1 and repeated >= s.duplicate_tokens:
                yield "duplicate_context", None, fp, repeated, str(copies)
        for item in self.poor:
            waste = math.floor(scaled(item.raw) * max(0.0, 1 - item.packed) + 0.5)
            if waste >= s.low_entropy_tokens:
                yield "low_entropy_content", item, item.item_id, waste, short_name(item.label)

    def _take(self, item: Item) -> None:
        if item.kind == "summary":
            self.raw, self.large, self.poor, self.copies = 0, [], [], {}
            self.touched, self.emptied = set(), True
            for kept in self.system:
                self._add(kept)
        elif item.kind == "system":
            self.system.append(item)
        self._add(item)

    def _add(self, item: Item) -> None:
        self.raw += item.raw
        if item.fp is not None:
            self.copies[item.fp] = (self.copies.get(item.fp, (0, 0))[0] + 1, item.raw)
            self.touched.add(item.fp)
        # Scaling only shrinks an item, so one below the bound is never reported for its waste.
        if item.packed is not None and item.raw * (1 - item.packed) + 1 >= self.settings.low_entropy_tokens:
            self.poor.append(item)
        # Beyond the largest ones, only items that are large by themselves can be reported.
        self.large.append(item)
        if len(self.large) > 2 * TOP:
            self.large.sort(key=lambda i: (-i.raw, i.seq))
            self.large[TOP:] = [i for i in self.large[TOP:] if i.raw >= self.settings.contributor_tokens]


def short_name(label: str | None) -> str | None:
    return None if label is None else label.replace("\\", "/").rsplit("/", 1)[-1]


class Spend:
    """Cost of a session so far, and what it comes to after some more turns like these."""

    def __init__(self, observed: int = 0, unpriced: int = 0, turns: int = 0, over: bool = False, sums: list[int] | None = None):
        self.observed, self.unpriced, self.turns = observed, unpriced, turns
        #: Whether the budget was crossed before; a session is reported once.
        self.over = over
        #: Micros per category at current prices.
        self.sums = sums or []

    def add(self, micros: int | None, current: list[int] | None) -> None:
        if micros is None or current is None:
            self.unpriced += 1
        self.observed += micros or 0
        if current is not None:
            self.turns += 1
            self.sums = [a + b for a, b in zip(self.sums or [0] * len(current), current)]

    def expected(self, more_turns: int) -> int:
        """The projected cost; the observed one while a turn has no price."""
        if self.unpriced or not self.turns:
            return self.observed
        return self.observed + more_turns * sum(x // self.turns for x in self.sums)
