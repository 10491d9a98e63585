"""Quality classifier: random-indexing word vectors, pooled, and a two-layer numpy network.

*Random indexing.*  Every distinct word (its bytes, by a 64-bit hash) that stands at least
``LEAST`` times in *all* documents has a vector of ``SIZE`` numbers: the mean, over its
occurrences, of the sparse random vectors (-1, 0 and 1) of its contexts, that is of the
words beside it and of their and its own spelling.  Counts and sums are whole numbers, summed
by Spark per word, so the table grows with the vocabulary and does not depend on partitions.
A rarer word has nothing to average: each occurrence is told by its own contexts.

*Pooling.*  A document is the mean and the mean square of its words' vectors.  The vectors
of at most ``HOT`` most frequent words travel to the tasks that read texts; all other words
meet the table of vectors in a join, where no word is hot any more.  Equal texts are pooled
once; a text is named by 128 bits of it.

*Network.*  Standardised pools, a layer of ``HIDDEN`` units, one output; fitted on the
driver on at most ``ROWS`` labelled rows outside the held fold.  A fifth of them is kept
back to choose the temperature that makes the probabilities fit best.

Results for odd input: NULL and empty texts have the pool zero and are scored like others;
rows without id are scored and count as held out; with labels of one kind only, or none,
every score is the share of label 1 (0.5 without labels); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import encode, mix, short_batches
from tokenloom.llm.learning import adam, fold, sample, sigmoid
from tokenloom.llm.repeats import word_hashes, word_spans
from tokenloom.plans.skew import broadcast_if_small
from tokenloom.session import stage

FOLDS, HELD = 5, 0
ROWS, SIZE, HIDDEN = 20_000, 16, 24
THRESHOLD = 0.3
#: Occurrences from which on a word has a vector of its own, and words that travel to the tasks at most.
LEAST, HOT = 64, 1 << 18
#: Random vectors of neighbouring words, and as many of spellings.
CONTEXTS = 1 << 13
#: Vectors are kept as whole numbers, in parts of this size.
SCALE = 1024
#: Places of the bitmap that tells tasks which words have a vector, as a power of two.
BITS = 25

_U = np.uint64
_SUMS = [f"v{i}" for i in range(SIZE)]
#: Four parts of a vector, 16 bits each, are one long of the table of vectors.
_PACKED = [f"p{i}" for i in range(SIZE // 4)]

#: Kinds of bytes: 0 other marks, 1 lower case, 2 upper case, 3 digit, 4 outside ASCII.
_KIND = np.array(
    [4 if b > 127 else 3 if 48 <= b < 58 else 2 if 65 <= b < 91 else 1 if 97 <= b < 123 else 0 for b in range(256)]
)


def _index_vectors() -> np.ndarray:
    """Random vectors of the contexts: four places of plus or minus one for each."""
    rng = np.random.default_rng(11)
    out = np.zeros((2 * CONTEXTS, SIZE), np.int8)
    places = np.argsort(rng.random((len(out), SIZE)), axis=1)[:, :4]
    np.put_along_axis(out, places, rng.choice([-1, 1], places.shape).astype(np.int8), axis=1)
    return out


_INDEX = _index_vectors()


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and spelling number (case, first and last bytes, length) of every word of some texts, and its text."""
    data = np.frombuffer(b" ".join(texts), np.uint8)
    starts, stops = word_spans(data)
    limits = np.cumsum([len(t) + 1 for t in texts])
    last = stops - 1
    second, before = np.minimum(starts + 1, last), np.maximum(last - 1, starts)
    mark = np.where(_KIND[data] == 0, data, _KIND[data])
    spelling = mark[starts].astype(_U)
    for part in (mark[second], mark[last], mark[before], np.minimum((stops - starts) // 4, 5)):
        spelling = spelling * _U(257) + part.astype(_U)
    spelling = (mix(spelling) >> _U(64 - CONTEXTS.bit_length() + 1)).astype(np.int64)
    return word_hashes(data, starts, stops), spelling, np.searchsorted(limits, starts, "right")


def contexts(word: np.ndarray, spelling: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of the random vectors of the contexts of the words in the places ``at``."""
    out = _INDEX[CONTEXTS + spelling[at]].astype(np.int16)
    shift = _U(64 - CONTEXTS.bit_length() + 1)
    for step in (-1, 1):
        near = np.clip(at + step, 0, max(len(word) - 1, 0))
        beside = (near != at) & (owner[near] == owner[at])
        both = _INDEX[(word[near] >> shift).astype(np.int64)] + _INDEX[CONTEXTS + spelling[near]]
        out += both * beside[:, None]
    return out


def _slices(texts: list[bytes], size: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about a bounded size together, and the number of the first one."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= size:
            yield first, texts[first : i + 1]
            first, held = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def _heads(ordered: np.ndarray) -> np.ndarray:
    """Where the runs of equal values start."""
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.empty(0, int)


def _marked(bitmap: np.ndarray, word: np.ndarray) -> np.ndarray:
    place = word >> _U(64 - BITS)
    return (bitmap[(place >> _U(6)).astype(np.int64)] >> (place & _U(63)) & _U(1)).astype(bool)


def frequent(docs: DataFrame, least: int) -> np.ndarray:
    """A bitmap of fixed size in which every word that stands at least ``least`` times is marked.

    Words are counted by half of their hash.  Others may be marked too; they then have
    vectors of their own like the rest.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, texts in _slices(encode(batch["text"])):
                half, n = np.unique(words_of(texts)[0] >> _U(32), return_counts=True)
                yield pd.DataFrame({"half": half.astype(np.int64), "n": n})

    counts = short_batches(docs).select("text").mapInPandas(run, "half long, n long")
    counts = counts.groupBy("half").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    place = counts.select(F.shiftright("half", 32 - BITS).alias("place"))
    marks = place.groupBy(F.shiftright("place", 6).alias("at")).agg(
        F.expr("bit_or(shiftleft(1L, cast(place & 63 AS int)))").alias("bits")
    )
    marks = marks.toPandas()
    bitmap = np.zeros(1 << BITS - 6, np.int64)
    bitmap[marks["at"]] = marks["bits"]
    return bitmap.view(_U)


def word_vectors(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """``(word, n, p0 .. )``: the vector of every marked word, ``SCALE`` times and packed, and how often it stands."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, texts in _slices(encode(batch["text"])):
                word, spelling, owner = words_of(texts)
                at = np.flatnonzero(_marked(bitmap, word))
                at = at[np.argsort(word[at], kind="stable")]
                heads = _heads(word[at])
                if not len(heads):
                    continue
                sums = np.add.reduceat(contexts(word, spelling, owner, at), heads, dtype=np.int32)
                out = pd.DataFrame(sums, columns=_SUMS)
                out.insert(0, "word", word[at[heads]].view(np.int64))
                out.insert(1, "n", np.diff(np.append(heads, len(at))))
                yield out

    sums = short_batches(docs).select("text").mapInPandas(run, "word long, n long, " + ", ".join(f"{v} int" for v in _SUMS))
    total = F.sum("n")
    means = [F.round(F.sum(v) * SCALE / total).cast("long").alias(v) for v in _SUMS]
    means = sums.groupBy("word").agg(total.alias("n"), *means)
    return stage(means.select("word", "n", *[_pack(i).alias(name) for i, name in enumerate(_PACKED)]))


def _pack(i: int) -> Column:
    out = F.lit(0)
    for j, v in enumerate(_SUMS[4 * i : 4 * i + 4]):
        out = out.bitwiseOR(F.shiftleft(F.col(v).bitwiseAND(F.lit(0xFFFF)), 16 * j))
    return out


def _unpacked(i: int) -> Column:
    return F.shiftright(F.shiftleft(F.col(_PACKED[i // 4]), 48 - 16 * (i % 4)), 48)


def unpack(rows: pd.DataFrame) -> np.ndarray:
    return np.ascontiguousarray(rows[_PACKED].to_numpy(np.int64)).view(np.int16).reshape(-1, SIZE)


class Vectors(NamedTuple):
    """The vectors of all words: where they are looked up."""

    bitmap: np.ndarray
    hot: np.ndarray
    found: np.ndarray
    table: DataFrame


def vectors_of(docs: DataFrame, least: int = LEAST, hot: int = HOT) -> Vectors:
    bitmap = frequent(docs, least)
    table = word_vectors(docs, bitmap)
    # Sixteen levels to a doubling: a bounded count of groups, whole levels become hot.
    level = F.floor(F.log2("n") * 16)
    total, lowest = 0, None
    for row in table.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        total += row["count"]
        if total > hot:
            break
        lowest = row["level"]
    rows = table.where(level >= lowest if lowest is not None else F.lit(False)).select("word", *_PACKED).toPandas()
    word = rows["word"].to_numpy(np.int64).view(_U)
    order = np.argsort(word)
    return Vectors(bitmap, word[order], unpack(rows)[order], table)


def _key() -> list[Column]:
    """128 bits that name a text; NULL is the empty text."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def _named_key() -> list[Column]:
    return [key.alias(name) for key, name in zip(_key(), ("k1", "k2"))]


def pooled(docs: DataFrame, vectors: Vectors) -> DataFrame:
    """``(k1, k2, n, copies, near, far)`` of every distinct text of ``n`` words.

    ``near`` holds the mean and mean square of what the tasks know, ``far`` the sums over
    the words of the joined table, over all copies of the text, or NULL.
    """
    bitmap, hot, found, table = vectors

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = batch[["k1", "k2"]].to_numpy(np.int64)
            for first, texts in _slices(encode(batch["text"])):
                word, spelling, owner = words_of(texts)
                number = np.searchsorted(hot, word)
                number[number == len(hot)] = 0
                known = hot[number] == word if len(hot) else np.zeros(len(word), bool)
                rare = np.flatnonzero(~known & ~_marked(bitmap, word))
                each = np.zeros((len(word), SIZE), np.float32)
                each[known] = found[number[known]] / np.float32(SCALE)
                each[rare] = contexts(word, spelling, owner, rare)
                pool, count = np.zeros((len(texts), 2 * SIZE)), np.bincount(owner, minlength=len(texts))
                heads = _heads(owner)
                if len(heads):
                    size = count[owner[heads]][:, None]
                    pool[owner[heads], :SIZE] = np.add.reduceat(each, heads, dtype=np.float64) / size
                    pool[owner[heads], SIZE:] = np.add.reduceat(each * each, heads, dtype=np.float64) / size
                mine = keys[first : first + len(texts)]
                near = [p.tobytes() for p in pool.astype(np.float32)]
                yield pd.DataFrame({"k1": mine[:, 0], "k2": mine[:, 1], "word": 0, "n": count, "near": near})
                known[rare] = True
                left = np.flatnonzero(~known)
                left = left[np.lexsort((word[left], owner[left]))]
                heads = np.union1d(_heads(owner[left]), _heads(word[left]))
                if len(heads):
                    at, times = left[heads], np.diff(np.append(heads, len(left)))
                    mine = mine[owner[at]]
                    names = word[at].view(np.int64)
                    yield pd.DataFrame({"k1": mine[:, 0], "k2": mine[:, 1], "word": names, "n": times, "near": None})

    rows = short_batches(docs).select(*_named_key(), "text")
    rows = stage(rows.mapInPandas(run, "k1 long, k2 long, word long, n long, near binary"))
    texts = rows.where("near is not null").groupBy("k1", "k2").agg(
        F.first("n").alias("n"), F.count("*").alias("copies"), F.first("near").alias("near")
    )
    far = rows.where("near is null").drop("near").join(table.drop("n"), "word")
    parts = [_unpacked(i) for i in range(SIZE)]
    sums = [F.sum(F.col("n") * v) for v in parts] + [F.sum(F.col("n") * v * v) for v in parts]
    # Packed rows travel, not sums.  Copies of a text that is not rare hold only frequent words, so no key is hot.
    far = far.repartition("k1", "k2").groupBy("k1", "k2").agg(F.array(*sums).alias("far"))
    return stage(texts.join(far, ["k1", "k2"], "left"))


def pools(rows: pd.DataFrame) -> np.ndarray:
    """Mean and mean square of the word vectors of pooled texts; zeros without words."""
    out = np.array([np.frombuffer(x, np.float32) for x in rows["near"]], np.float64).reshape(-1, 2 * SIZE)
    scale = np.repeat([SCALE, SCALE * SCALE], SIZE)
    for i, (far, n, copies) in enumerate(zip(rows["far"], rows["n"], rows["copies"])):
        if far is not None:
            out[i] += np.asarray(far, np.float64) / (scale * n * copies)
    return out


class Network:
    """Two layers and a temperature; ``score`` gives the probability of label 1."""

    def __init__(self, pool: np.ndarray, label: np.ndarray, seed: int = 3):
        self.flat = float(label.mean()) if len(label) else 0.5
        self.known = 0 < label.sum() < len(label)
        if not self.known:
            return
        held = np.arange(len(label)) % 5 == 4
        if not 0 < label[held].sum() < held.sum():
            held[:] = False
        x, y = pool[~held], label[~held].astype(float)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        rng = np.random.default_rng(seed)
        start = [
            rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)),
            np.zeros(HIDDEN),
            rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN),
            np.array(0.0),
        ]
        x = (x - self.mean) / self.scale

        def gradient(parameters):
            w, b, v, c = parameters
            inner = np.tanh(x @ w + b)
            slope = (sigmoid(inner @ v + c) - y) / len(y)
            back = slope[:, None] * v * (1 - inner * inner)
            return [x.T @ back + 1e-4 * w, back.sum(axis=0), inner.T @ slope + 1e-4 * v, np.array(slope.sum())]

        self.parameters = adam(start, gradient, 300, 0.02)
        self.temperature = 1.0
        if held.any():
            z, t = self.logit(pool[held]), label[held]
            heats = np.geomspace(0.25, 4, 49)
            self.temperature = float(min(heats, key=lambda h: np.logaddexp(0, np.where(t, -z, z) / h).mean()))

    def logit(self, pool: np.ndarray) -> np.ndarray:
        w, b, v, c = self.parameters
        return np.tanh((pool - self.mean) / self.scale @ w + b) @ v + c

    def score(self, pool: np.ndarray) -> np.ndarray:
        return sigmoid(self.logit(pool) / self.temperature) if self.known else np.full(len(pool), self.flat)


def train(docs: DataFrame, labels: DataFrame, pooled_texts: DataFrame) -> Network:
    chosen = sample(docs, labels, "quality", FOLDS, HELD, ROWS).select("doc_id", "label", *_named_key())
    rows = chosen.join(pooled_texts, ["k1", "k2"]).toPandas()
    # By hash, so that the part kept back is no stretch of the table.
    ids = rows["doc_id"].to_numpy(np.int64)
    rows = rows.iloc[np.lexsort((rows["k1"], ids, mix(ids.astype(_U))))]
    return Network(pools(rows), rows["label"].to_numpy() == 1)


def text_scores(docs: DataFrame, labels: DataFrame, least: int = LEAST, hot: int = HOT) -> DataFrame:
    """``(k1, k2, score)`` of every distinct text."""
    pooled_texts = pooled(docs, vectors_of(docs, least, hot))
    network = train(docs, labels, pooled_texts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"k1": batch["k1"], "k2": batch["k2"], "score": network.score(pools(batch))})

    return pooled_texts.mapInPandas(run, "k1 long, k2 long, score double")


def score(docs: DataFrame, labels: DataFrame, least: int = LEAST, hot: int = HOT) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document."""
    held = F.coalesce(fold("doc_id", FOLDS) == HELD, F.lit(True)).alias("held_out")
    rows = docs.select("doc_id", held, *_named_key())
    scored = rows.join(text_scores(docs, labels, least, hot), ["k1", "k2"]).drop("k1", "k2")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows whose text scores at least the threshold, judged by their text, with their columns."""
    bad = stage(text_scores(docs, labels).where(F.col("score") < THRESHOLD).select("k1", "k2"))
    bad = broadcast_if_small(bad)
    k1, k2 = _key()
    return docs.join(bad, (k1 == bad["k1"]) & (k2 == bad["k2"]), "left_anti")
