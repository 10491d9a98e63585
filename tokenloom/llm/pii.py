"""Personal data: base patterns and a semi-Markov conditional random field.

*Base spans* are what four patterns with their checks find (:func:`base_spans`); they
always stay.  *The field* adds spans that the patterns miss, such as a card number with
a wrong digit, a phone number without ``+`` or an address spelled with "at" and "dot".

A text is looked at only around triggers (digits, ``@``, "at" in brackets, before a word
and "dot", or before a word with a dot inside; in any case, with any blanks), cut into
tokens.  A segment of at most ``LONGEST`` tokens is scored as a whole, for each type, by
features of the whole span: its shape, digits, checks and neighbours.  Everything
else is a segment of one token without type.  The dynamic program over bounded segments
chooses boundaries and types together, in time proportional to the text.

The weights are fitted on the driver by maximum likelihood on at most ``ROWS`` base
spans with their surroundings, taken by hash order, each once as it is and once
damaged in a way that the patterns do not see; look-alikes (hex keys, versions, dates,
prices, numbers of other lengths) stand beside them without a type.

Results for odd input: NULL is the empty text and has no spans; rows without id and
rows that repeat an id each get a row; without base spans to learn from the field adds
nothing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from random import Random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import beside, short_batches
from tokenloom.llm.learning import adam

KINDS = ("email", "ip", "card", "phone")
ROWS, LONGEST, AROUND = 400, 24, 3

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A spelled-out host is part of its trigger, so that a stretch never ends inside of it.
_HOST = r"\S{1,255}(?:\s+dot\s+\S{1,255})+"
_BARE = rf"\sat\s+(?:{_HOST}|(?=[^\s.]{{1,255}}\.[^\s.]))"
_TRIGGER = re.compile(rf"(?i:[0-9@]|[(\[{{]\s*at\s*[)\]}}](?:\s*{_HOST})?|{_BARE})")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    """Each ``@`` with the longest run before it; walking back from the mark is linear in the text."""
    end = 0
    for at in re.finditer("@", text):
        if at.start() < end:
            continue
        start = at.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at.start()) if start < at.start() else None
        if found:
            end = found.end()
            yield start, end, "email"


def _addresses(text: str) -> Iterator[Span]:
    """Of every maximal run of dotted numbers, four at a time."""
    for run in _DOTTED.finditer(text):
        parts = run.group().split(".")
        at = run.start()
        for i in range(0, len(parts) - 3, 4):
            four = ".".join(parts[i : i + 4])
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts[i : i + 4]):
                yield at, at + len(four), "ip"
            at += len(four) + 1


def base_spans(text: str) -> list[Span]:
    """``(start, end, kind)`` by start, then kind as listed; ends are exclusive."""
    found = list(_emails(text)) if "@" in text else []
    if any(c.isdigit() for c in text):
        found += _addresses(text)
        for kind, pattern, low, high in (("card", _CARD, 12, 19), ("phone", _PHONE, 9, 15)):
            for m in pattern.finditer(text):
                n = sum("0" <= c <= "9" for c in m.group())
                if low <= n <= high and (kind != "card" or luhn(_digits(m.group()))):
                    found.append((m.start(), m.end(), kind))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


# ---------------------------------------------------------------- segments and their features

_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.DOTALL)


def regions(text: str) -> Iterator[tuple[int, list[str]]]:
    """Start and tokens of the stretches around triggers; stretches that touch are one."""
    begin = end = -1
    for m in _TRIGGER.finditer(text):
        low, high = _reach(text, m.start(), m.end())
        if low > end:
            if end >= 0:
                yield begin, _TOKEN.findall(text[begin:end])
            begin = low
        end = max(end, high)
    if end >= 0:
        yield begin, _TOKEN.findall(text[begin:end])


def _reach(text: str, low: int, high: int, words: int = AROUND) -> tuple[int, int]:
    """A few blanks to each side, at most 64 characters; the rest of a longer word is no context."""
    left, right = low, high
    gaps = 0
    while left > 0 and low - left < 64 and gaps < words:
        left -= 1
        gaps += text[left].isspace()
    gaps = 0
    while right < len(text) and right - high < 64 and gaps < words:
        gaps += text[right].isspace()
        right += 1
    return left, right


def _shape(token: str) -> str:
    if token[0].isdigit():
        return f"9{min(len(token), 6)}"
    if token[0].isalpha():
        return "at" if token.lower() == "at" else "dot" if token.lower() == "dot" else "a"
    return " " if token.isspace() else token


_SPELLED = frozenset(["at", "dot", *"()[]{}"])


def features(tokens: list[str], shapes: list[str], i: int, j: int) -> tuple[str, ...]:
    """Features of the tokens ``i .. j - 1`` as one segment; () where a segment cannot be an entity."""
    first, last = tokens[i], tokens[j - 1]
    if first.isspace() or last.isspace() or not (first[0].isalnum() or first in "+("):
        return ()
    inside = tokens[i:j]
    number = "".join(t for t in inside if t[0].isdigit())
    marks = "".join(sorted({s for s in shapes[i:j] if s[0] not in "9a"}))
    before, after = shapes[i - 1] if i else "", shapes[j] if j < len(shapes) else ""
    shape = "".join("a" if s == "a" else s[0] if s[0] == "9" else s for s in shapes[i:j])
    size = len(number)
    letters = sum(s == "a" for s in shapes[i:j])
    ats = sum(s in ("at", "@") for s in shapes[i:j])
    dots = sum(s in ("dot", ".") for s in shapes[i:j])
    # Blanks that do not stand beside a spelled-out mark.
    loose = sum(s == " " and not {shapes[k - 1], shapes[k + 1]} & _SPELLED for k, s in enumerate(shapes[i:j], i))
    return (
        f"shape={shape}",
        f"size={size}/{letters > 0}",
        f"marks={marks}/{letters > 0}",
        f"size+marks={size}/{marks}/{letters > 0}",
        f"first={shapes[i][0]}/{shapes[j - 1][0]}",
        f"before={before[:1]}/{letters > 0}",
        f"after={after[:1]}/{letters > 0}",
        f"luhn={size > 11 and luhn(number)}",
        f"long={max((len(t) for t in inside if t[0].isdigit()), default=0)}",
        f"tokens={j - i}",
        f"mail={min(ats, 2)}/{min(dots, 1)}/{min(loose, 2)}",
        f"loose={min(loose, 3)}/{letters > 0}",
    )


class Field:
    """Weights by type and feature; ``spans`` decodes a text."""

    def __init__(self, names: dict[str, int], weights: np.ndarray):
        self.names, self.weights = names, weights

    def scores(self, tokens: list[str]) -> dict[tuple[int, int], np.ndarray]:
        """Score of every segment for all types; a segment without any known feature has none."""
        shapes = [_shape(t) for t in tokens]
        out = {}
        for i in range(len(tokens)):
            for j in range(i + 1, min(i + LONGEST, len(tokens)) + 1):
                found = [self.names[f] for f in features(tokens, shapes, i, j) if f in self.names]
                if found:
                    out[i, j] = self.weights[:, found].sum(axis=1)
        return out

    def spans(self, text: str) -> list[Span]:
        found = []
        for start, tokens in regions(text) if len(self.names) else ():
            offsets = np.concatenate(([0], np.cumsum([len(t) for t in tokens]))) + start
            for i, j, kind in decode(len(tokens), self.scores(tokens)):
                found.append((int(offsets[i]), int(offsets[j]), KINDS[kind]))
        return found


def decode(n: int, scores: dict[tuple[int, int], np.ndarray]) -> list[tuple[int, int, int]]:
    """Best segmentation; a token outside of entities scores 0."""
    best, back = np.zeros(n + 1), [(0, -1)] * (n + 1)
    ends: list[list] = [[] for _ in range(n + 1)]
    for (i, j), score in scores.items():
        kind = int(score.argmax())
        if score[kind] > 0:
            ends[j].append((i, kind, score[kind]))
    for j in range(1, n + 1):
        best[j], back[j] = best[j - 1], (j - 1, -1)
        for i, kind, score in ends[j]:
            if best[i] + score > best[j]:
                best[j], back[j] = best[i] + score, (i, kind)
    out, j = [], n
    while j:
        i, kind = back[j]
        if kind >= 0:
            out.append((i, j, kind))
        j = i
    return out[::-1]


# ---------------------------------------------------------------- fitting


def damaged(kind: str, value: str, rng: Random) -> str:
    """The same kind of data as people also write it, out of the patterns' reach."""
    if kind == "email":
        local, _, domain = value.partition("@")
        at, dot = rng.choice([(" at ", " dot "), ("(at)", "."), (" (at) ", "."), ("[at]", "[dot]")])
        return local + at + domain.replace(".", dot)
    if kind == "ip":
        return ".".join(value.split(".")[:3]) + rng.choice([".*", ".xxx"])
    digits = _digits(value)
    if kind == "card":
        wrong = digits[:-1] + str((int(digits[-1]) + rng.randint(1, 9)) % 10)
        joint = rng.choice(["", " ", "-"])
        return joint.join(wrong[i : i + 4] for i in range(0, len(wrong), 4))
    return rng.choice(["({}) {}-{}", "{}-{}-{}", "{} {} {}"]).format(digits[-10:-7], digits[-7:-4], digits[-4:])


def look_alike(rng: Random) -> str:
    n = lambda k: "".join(str(rng.randint(0, 9)) for _ in range(k))
    return rng.choice(
        [
            'token = "' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"',
            f"v{rng.randint(0, 9)}.{rng.randint(0, 30)}.{rng.randint(0, 30)}",
            f"20{n(2)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}",
            f"{rng.randint(1, 999)}.{n(2)}",
            n(rng.choice([1, 2, 3, 4, 5, 6, 7, 8])),
            f"version {rng.randint(1, 9)}.0",
            f"{rng.randint(1, 31)}/{rng.randint(1, 12)}/20{n(2)}",
            f"at {rng.randint(1, 12)}:{n(2)}",
        ]
    )


def _inside(grid: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Log sums over all segmentations that end at, and that begin at, each token."""
    ahead, behind = np.zeros(n + 1), np.zeros(n + 1)
    for j in range(1, n + 1):
        low = max(0, j - LONGEST)
        terms = np.append(ahead[low:j] + grid[np.arange(low, j), j - np.arange(low, j)], ahead[j - 1])
        ahead[j] = np.logaddexp.reduce(terms)
    for i in range(n - 1, -1, -1):
        high = min(n, i + LONGEST)
        behind[i] = np.logaddexp.reduce(np.append(behind[i + 1 : high + 1] + grid[i, 1 : high - i + 1], behind[i + 1]))
    return ahead, behind


def fit(examples: list[tuple[list[str], set[tuple[int, int, int]]]], rounds: int = 40) -> Field:
    """Maximum likelihood with a ridge; ``examples`` are tokens and their true segments."""
    names: dict[str, int] = {}
    rows, cols, where, gold = [], [], [], []
    segment = 0
    for e, (tokens, truth) in enumerate(examples):
        shapes = [_shape(t) for t in tokens]
        for i in range(len(tokens)):
            for j in range(i + 1, min(i + LONGEST, len(tokens)) + 1):
                found = features(tokens, shapes, i, j)
                if not found:
                    continue
                for f in found:
                    rows.append(segment)
                    cols.append(names.setdefault(f, len(names)))
                where.append((e, i, j))
                gold.append(next((k for a, b, k in truth if (a, b) == (i, j)), -1))
                segment += 1
    if not where:
        return Field({}, np.zeros((len(KINDS), 0)))
    width = len(rows) // segment
    cols = np.array(cols).reshape(segment, width)
    where, gold = np.array(where), np.array(gold)
    cuts = np.searchsorted(where[:, 0], np.arange(len(examples) + 1))
    hit = np.zeros((len(KINDS), segment))
    hit[gold[gold >= 0], np.flatnonzero(gold >= 0)] = 1

    def gradient(parameters):
        weights = parameters[0]
        score = weights[:, cols].sum(axis=2)
        total = np.logaddexp.reduce(score, axis=0)
        chance = np.zeros((len(KINDS), segment))
        for e, (tokens, _) in enumerate(examples):
            part = slice(cuts[e], cuts[e + 1])
            i, j = where[part, 1], where[part, 2]
            grid = np.full((len(tokens) + 1, LONGEST + 1), -np.inf)
            grid[i, j - i] = total[part]
            ahead, behind = _inside(grid, len(tokens))
            chance[:, part] = np.exp(score[:, part] + ahead[i] + behind[j] - ahead[-1])
        slope = chance - hit
        out = np.zeros_like(weights)
        for k in range(len(KINDS)):
            out[k] = np.bincount(cols.ravel(), np.repeat(slope[k], width), weights.shape[1])
        return [out / len(examples) + 1e-3 * weights]

    weights = adam([np.full((len(KINDS), len(names)), -0.2)], gradient, rounds, 0.3)[0]
    return Field(names, weights)


def train(docs: DataFrame, rows: int = ROWS) -> Field:
    """Fits the field on base spans of the corpus, a bounded number by hash order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                spans = base_spans(text or "")
                for n, (start, end, kind) in enumerate(spans):
                    low, high = _reach(text, start, end)
                    if end - start < 64 and all(s[1] <= low or s[0] >= high for s in spans if s != spans[n]):
                        out.append((kind, text[low:start], text[start:end], text[end:high]))
            yield pd.DataFrame(out, columns=["kind", "left", "value", "right"])

    found = short_batches(docs).select("text").mapInPandas(run, "kind string, left string, value string, right string").distinct()
    order = F.xxhash64("value", "left", "right", "kind")
    found = found.orderBy(order, "kind", "left", "value", "right").limit(rows).collect()
    rng = Random(5)
    examples = []
    for row in found:
        for value in (row["value"], damaged(row["kind"], row["value"], rng)):
            examples.append(_example(row["left"], value, row["right"], KINDS.index(row["kind"])))
        examples.append(_example(row["left"], look_alike(rng), row["right"], None))
    return fit([e for e in examples if e])


def _example(left: str, value: str, right: str, kind: int | None):
    if (left and left[-1].isalnum() and value[0].isalnum()) or (right and right[0].isalnum() and value[-1].isalnum()):
        left, right = left + " ", " " + right
    tokens = [_TOKEN.findall(x) for x in (left, value, right)]
    flat = tokens[0] + tokens[1] + tokens[2]
    if kind is not None and len(tokens[1]) > LONGEST:
        return None
    begin = len(tokens[0])
    truth = set() if kind is None else {(begin, begin + len(tokens[1]), kind)}
    return flat, truth


# ---------------------------------------------------------------- operator


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and those with what the field adds beside them."""
    base = base_spans(text)
    if not _TRIGGER.search(text):
        return base, base
    added = []
    covered = sorted((s[0], s[1]) for s in base)
    ends = np.maximum.accumulate([e for _, e in covered]) if covered else np.empty(0)
    starts = np.array([s for s, _ in covered])
    for start, end, kind in field.spans(text):
        k = int(np.searchsorted(starts, end, "left")) if covered else 0
        if not k or ends[k - 1] <= start:
            added.append((start, end, kind))
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``doc_id``, counts and digest of base spans, and all spans of every document."""
    field = train(docs) if field is None else field

    def work(texts: list) -> list:
        rows = []
        for text in texts:
            base, spans = all_spans(text or "", field)
            count = [sum(s[2] == k for s in base) for k in KINDS]
            rows.append((*count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        kinds = [pa.int64()] * len(KINDS) + [pa.string()] * 2
        return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]

    made = ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return beside(short_batches(docs).select("doc_id", "text"), work, made)


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; overlapping spans are replaced as one, named by the first."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out.append(text[at:start] + f"[{kind.upper()}]")
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """The rows with spans masked in ``text`` and ``n_chars`` (where there is one) counted anew."""
    field = train(docs)

    def work(texts: list) -> list:
        return [pa.array([None if t is None else masked(t, all_spans(t, field)[1]) for t in texts], pa.string())]

    out = beside(short_batches(docs), work, "text string").select(*docs.columns)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        counted = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text"))
        out = out.withColumn("n_chars", counted.cast(kind))
    return out
