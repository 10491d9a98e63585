"""Language identification by a linear-chain conditional random field over words.

Every word of a text has a hidden language.  What speaks for a language in a word:

* *n-grams* of 2 to 5 bytes of the lower-cased word between two edge marks, hashed to
  ``2 ** BITS`` numbers; those that hold an edge mark are its *affixes*;
* the *lexicon*: how often the word stands in texts of each language, counted over all
  documents that may be learned from.

Learned transitions say how readily one language follows another, and forward-backward
gives the probability of each language at each word, so a text may switch languages.  A
document's language is the one with most expected words; its score is that share.

Counting covers every learnable document and its table grows with them; of it the
``LEXICON`` most frequent words are sent to the tasks, the others are told by their
n-grams.  The field is fitted on at most ``ROWS`` documents of each language, of each at
most ``STRETCHES`` stretches of ``STRETCH`` words; pieces of them in random order make up
switching text, from which the transitions are learned.  In half of it the lexicon is
hidden, so that the n-grams learn to do without.

Chains of any length: a text is cut into blocks of ``STEPS`` words.  The product of a
block's transition matrices is made for all blocks at once, a short walk over the blocks
of each text gives every block what comes before and after it, and forward and backward
inside the blocks run at once again.

Results for odd input: a text that is NULL or has no letter is ``und`` with score 0, and
so is everything where nothing can be learned; runs of more than ``LONGEST`` bytes count
as several words; ties go to the language that sorts first; rows without id are
predicted, count as held out and are not learned from; rows that repeat an id are scored
one by one; an empty table gives no rows.  A document has to fit into a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import encode, mix
from tokenloom.llm.learning import adam, fold
from tokenloom.llm.repeats import word_hashes
from tokenloom.plans.skew import top_k_per_group
from tokenloom.session import stage

FOLDS, HELD = 4, 2
ROWS, STRETCHES, STRETCH = 250, 4, 32
LEXICON, BITS, GRAMS = 65_536, 18, (2, 3, 4, 5)
LONGEST, STEPS, SLICE = 64, 64, 1 << 20
#: Words of a training sequence, and of its pieces.
SEQUENCE, PIECE = 64, (6, 32)
ROUNDS, RATE, DECAY = 60, 0.1, 1e-6

#: Letters are ASCII letters and every byte outside ASCII.
_LETTER = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of some lower-cased texts: their bytes, starts, ends, and the text each is in."""
    data = np.frombuffer(b" ".join(texts), np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], _LETTER[data], [False])).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    parts = -(-(ends - starts) // LONGEST)
    if (parts > 1).any():
        turn = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = np.repeat(starts, parts) + turn * LONGEST
        ends = np.minimum(np.repeat(ends, parts), starts + LONGEST)
    limits = np.cumsum([len(t) + 1 for t in texts])
    return data, starts, ends, np.searchsorted(limits, starts, "right")


def lowered(texts) -> list[bytes]:
    return encode([None if t is None else t.lower() for t in texts])


def grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of words between edge marks, and the word each is of."""
    sizes = ends - starts + 2
    first = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(starts)), sizes)
    offset = np.arange(len(word)) - first[word]
    inner = (offset > 0) & (offset < sizes[word] - 1)
    marked = np.where(offset == 0, 1, 2).astype(np.uint64)
    marked[inner] = data[(starts[word] + offset - 1)[inner]]
    numbers, owners = [], []
    for n in GRAMS:
        fits = np.flatnonzero(offset + n <= sizes[word])
        code = np.full(len(fits), n, np.uint64)
        for i in range(n):
            code = (code << np.uint64(8)) | marked[fits + i]
        numbers.append((mix(code) >> np.uint64(64 - BITS)).astype(np.int64))
        owners.append(word[fits])
    return np.concatenate(numbers), np.concatenate(owners)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray
    bias: np.ndarray
    lexicon: np.ndarray
    shares: np.ndarray
    trust: np.ndarray
    moves: np.ndarray

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """What the lexicon says of words; zero for those it does not hold."""
        if not len(self.lexicon):
            return np.zeros((len(hashes), len(self.langs)))
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        return np.where((self.lexicon[at] == hashes)[:, None], self.shares[at], 0)

    def emissions(self, data, starts, ends) -> tuple[np.ndarray, np.ndarray]:
        """For each distinct word the support of each language, and which word each span is."""
        hashes, at, back = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        number, owner = grams(data, starts[at], ends[at])
        spelled = [np.bincount(owner, w[number], len(at)) for w in self.weights.T]
        return np.stack(spelled, 1) + self.bias + self.known(hashes) @ self.trust, back


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.max(axis=tuple(range(1, x.ndim)), keepdims=True)


def chains(support: np.ndarray, owner: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Probability of each language at each word; ``owner`` numbers the text of each word, ascending."""
    n, kinds = support.shape
    begin = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    counts = np.diff(np.append(begin, n))
    per_text = -(-counts // STEPS)
    text_of = np.repeat(np.arange(len(begin)), per_text)
    turn = np.arange(len(text_of)) - (np.cumsum(per_text) - per_text)[text_of]
    at = (begin[text_of] + turn * STEPS)[:, None] + np.arange(STEPS)
    filled = at < (begin + counts)[text_of][:, None]
    force = np.exp(support - support.max(axis=1, keepdims=True))[np.where(filled, at, 0)]
    step, head = np.exp(moves - moves.max()), turn == 0
    even, full = np.full((kinds, kinds), 1 / kinds), filled.all(axis=0)

    def ahead(x: np.ndarray, t: int) -> np.ndarray:
        """One word further: ``x`` has the languages of the word before in its last axis."""
        y = (x.reshape(-1, kinds) @ step).reshape(x.shape)
        if t == 0:
            y[head] = x[head] @ even
        y *= force[:, t] if x.ndim == 2 else force[:, t, None]
        if not full[t]:
            y = np.where(filled[:, t].reshape(-1, *[1] * (x.ndim - 1)), y, x)
        # One language has force 1 at each word, so eight words cannot bring all of them near zero.
        return y if t % 8 else _scaled(y)

    whole = np.broadcast_to(np.eye(kinds), (len(turn), kinds, kinds))
    for t in range(STEPS):
        whole = ahead(whole, t)
    before, after = np.full((len(turn), kinds), 1.0), np.full((len(turn), kinds), 1.0)
    by_turn = np.argsort(turn, kind="stable")
    cuts = np.searchsorted(turn[by_turn], np.arange(1, per_text.max() + 1))
    for i, j in zip(cuts[:-1], cuts[1:]):
        b = by_turn[i:j]
        before[b] = _scaled(np.einsum("bi,bij->bj", before[b - 1], whole[b - 1]))
    for i, j in zip(cuts[:-1][::-1], cuts[1:][::-1]):
        b = by_turn[i:j]
        after[b - 1] = _scaled(np.einsum("bij,bj->bi", whole[b], after[b]))
    forward = np.empty((len(turn), STEPS, kinds))
    x = before
    for t in range(STEPS):
        x = forward[:, t] = ahead(x, t)
    x = after
    for t in range(STEPS - 1, -1, -1):
        forward[:, t] *= x
        y = (force[:, t] * x) @ step.T
        y = y if full[t] else np.where(filled[:, t, None], y, x)
        x = y if t % 8 else _scaled(y)
    out = forward[filled]
    return out / out.sum(axis=1, keepdims=True)


def _learnable(docs: DataFrame) -> DataFrame:
    return docs.where((fold("doc_id", FOLDS) != HELD) & F.col("lang").isNotNull() & F.col("text").isNotNull())


def _stretches(docs: DataFrame, rows: int) -> pd.DataFrame:
    """``(lang, words)`` of the bounded sample, in a fixed order."""
    ids = _learnable(docs).select("doc_id", "lang").distinct()
    chosen = top_k_per_group(ids, ["lang"], [F.xxhash64("doc_id"), F.col("doc_id")], rows, F.col("doc_id"))
    texts = _learnable(docs).select("doc_id", "lang", "text").join(F.broadcast(chosen.drop("rank")), ["doc_id", "lang"])
    # An id that stands in several rows gives one of them.
    texts = texts.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {"key": [], "lang": [], "words": []}
            rows = zip(*(batch.column(n).to_pylist() for n in ("doc_id", "lang", "text")))
            for doc_id, lang, text in rows:
                data, starts, ends, _ = words_of(lowered([text]))
                rng = np.random.default_rng(doc_id % (1 << 63))
                places = range(0, len(starts), STRETCH)
                for i in sorted(rng.permutation(len(places))[:STRETCHES].tolist()):
                    a, b = places[i], min(places[i] + STRETCH, len(starts))
                    words = [data[x:y].tobytes() for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist())]
                    found["key"].append(f"{doc_id}:{a}")
                    found["lang"].append(lang)
                    found["words"].append(b" ".join(words))
            yield pa.RecordBatch.from_pydict(found, pa.schema([("key", "string"), ("lang", "string"), ("words", "binary")]))

    return texts.mapInArrow(cut, "key string, lang string, words binary").toPandas().sort_values(["lang", "key"])


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, lang, n)``: how often each word, as a hash, stands in learnable texts of each language."""

    def folded(held: list[tuple]) -> tuple:
        words, back = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        return words, np.bincount(back, np.concatenate([h[1] for h in held]), len(words)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple]] = {}
        sizes: dict[str, int] = {}

        def out(lang: str) -> pa.RecordBatch:
            words, n = folded(held.pop(lang))
            sizes.pop(lang)
            names = pa.array([lang] * len(words), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), names, pa.array(n)], names=["word", "lang", "n"])

        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for at, part in _slices(batch.column("text")):
                data, starts, ends, owner = words_of(part)
                hashes, spoken = word_hashes(data, starts, ends), langs[at : at + len(part)]
                for lang in set(spoken):
                    words, n = np.unique(hashes[(spoken == lang)[owner]], return_counts=True)
                    held.setdefault(lang, []).append((words, n))
                    sizes[lang] = sizes.get(lang, 0) + len(words)
                    # Folded now and then; sent when many different words have come together.
                    if sizes[lang] > 1 << 19:
                        held[lang] = [folded(held[lang])]
                        sizes[lang] = len(held[lang][0][0])
                        if sizes[lang] > 1 << 18:
                            yield out(lang)
        for lang in list(held):
            yield out(lang)

    parts = _learnable(docs).select("lang", "text").mapInArrow(count, "word long, lang string, n long")
    return parts.groupBy("word", "lang").agg(F.sum("n").alias("n"))


def _slices(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Lower-cased texts in parts of about ``SLICE`` bytes, with the number of the first; only one part is held."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    total, at = np.cumsum(sizes), 0
    while at < len(column):
        stop = int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE)) + 1
        yield at, lowered(column.slice(at, stop - at).to_pylist())
        at = stop


def _lexicon(docs: DataFrame, langs: list[str], most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent words and, for each language, its share of them above an even one."""
    counts = stage(word_counts(docs).where(F.col("lang").isin(langs)))
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    each = F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("n")
    words = counts.groupBy("word").agg(each, F.sum("n").alias("all"))
    top = words.orderBy(F.desc("all"), "word").limit(most)
    rows = top.select("word", *[F.coalesce(F.col("n").getItem(x), F.lit(0)).alias(f"n{i}") for i, x in enumerate(langs)])
    rows = rows.toPandas()
    hashes = rows["word"].to_numpy(np.int64).view(np.uint64)
    rate = np.array([totals.get(x, 1) for x in langs], float)
    # A count of one half is added to each, so that rare words say less.
    share = (rows[[f"n{i}" for i in range(len(langs))]].to_numpy(float) + 0.5) / rate
    share = share / share.sum(axis=1, keepdims=True) - 1 / len(langs)
    order = np.argsort(hashes)
    return hashes[order], share[order]


def fit(words: list[bytes], label: np.ndarray, langs: list[str], lexicon, shares, seed: int = 5) -> Model:
    """The field, from switching text ``words`` with the language number of each word."""
    kinds, rng = len(langs), np.random.default_rng(seed)
    data, starts, ends, _ = words_of(words)
    hashes, at, word = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    number, owner = grams(data, starts[at], ends[at])
    names, number = np.unique(number, return_inverse=True)
    zeros = np.zeros(kinds)
    model = Model(langs, np.zeros((1 << BITS, kinds)), zeros, lexicon, shares, np.zeros((kinds, kinds)), np.zeros((kinds, kinds)))
    told = model.known(hashes)
    rows = len(word) // SEQUENCE
    word, label = (x[: rows * SEQUENCE].reshape(rows, SEQUENCE) for x in (word, label))
    truth = np.eye(kinds)[label]
    open_book = (rng.random((rows, 1, 1)) < 0.5).astype(float)
    seen = np.zeros((kinds, kinds))
    np.add.at(seen, (label[:, :-1].ravel(), label[:, 1:].ravel()), 1)
    tokens = rows * SEQUENCE

    def gradient(parameters):
        weights, bias, trust, moves = parameters
        spelled = np.stack([np.bincount(owner, w[number], len(at)) for w in weights.T], 1) + bias
        force = spelled[word] + open_book * (told @ trust)[word]
        force = np.exp(force - force.max(axis=2, keepdims=True))
        step = np.exp(moves - moves.max())
        ahead = np.empty_like(force)
        back = np.empty_like(force)
        x = ahead[:, 0] = _scaled(force[:, 0])
        for t in range(1, SEQUENCE):
            x = ahead[:, t] = _scaled((x @ step) * force[:, t])
        x = back[:, -1] = np.ones((rows, kinds))
        for t in range(SEQUENCE - 1, 0, -1):
            x = back[:, t - 1] = _scaled((force[:, t] * x) @ step.T)
        post = ahead * back
        post /= post.sum(axis=2, keepdims=True)
        pair = ahead[:, :-1, :, None] * step * (force * back)[:, 1:, None, :]
        pair /= pair.sum(axis=(2, 3), keepdims=True)
        off = (post - truth) / tokens
        by_word = np.stack([np.bincount(word.ravel(), off[..., k].ravel(), len(at)) for k in range(kinds)], 1)
        booked = (off * open_book).reshape(-1, kinds)
        return [
            np.stack([np.bincount(number, by_word[owner, k], len(names)) for k in range(kinds)], 1) + DECAY * weights,
            off.sum(axis=(0, 1)),
            told[word.ravel()].T @ booked + DECAY * trust,
            (pair.sum(axis=(0, 1)) - seen) / tokens + DECAY * moves,
        ]

    start = [np.zeros((len(names), kinds)), zeros.copy(), model.trust, model.moves]
    weights, model.bias, model.trust, model.moves = adam(start, gradient, ROUNDS, RATE)
    model.weights[names] = weights
    return model


def train(docs: DataFrame, rows: int = ROWS, lexicon: int = LEXICON) -> Model | None:
    """The field of all languages that documents can be learned from; None without any."""
    sample = _stretches(docs, rows)
    langs = sorted(set(sample["lang"]))
    if not langs:
        return None
    rng = np.random.default_rng(3)
    pieces = []
    for lang, joined in zip(sample["lang"], sample["words"]):
        words = joined.split()
        while words:
            n = int(rng.integers(*PIECE, endpoint=True))
            pieces.append((langs.index(lang), words[:n]))
            words = words[n:]
    pieces = [pieces[i] for i in rng.permutation(len(pieces))]
    label = np.repeat([p[0] for p in pieces], [len(p[1]) for p in pieces])
    return fit([w for p in pieces for w in p[1]], label, langs, *_lexicon(docs, langs, lexicon))


def identify(docs: DataFrame, model: Model | None, keep: list[Column] | None = None, stretches: bool = False) -> DataFrame:
    """``lang_pred, score, n_switches`` beside the columns ``keep`` (default: ``doc_id``).

    ``n_switches`` counts neighbouring words of different most likely languages.  With
    ``stretches`` also ``stretches``: number of the first word, words and language of
    each run of one language.
    """
    keep = keep or [F.col("doc_id")]
    readable = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(*keep, F.when(readable, F.col("text")).alias("__text"))
    run = "array<struct<first:int,words:int,lang:string>>"
    empty = F.array().cast(run)
    if model is None:
        none = [F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0).alias("n_switches")]
        return rows.select(*rows.columns[:-1], *none, *[empty.alias("stretches")] * stretches)
    langs = np.array(model.langs)
    fields = rows.schema.fields[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    schema += ", lang_pred string, score double, n_switches int" + f", stretches {run}" * stretches
    run_type = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            best, score, switches = np.full(n, -1), np.zeros(n), np.zeros(n, np.int32)
            runs: list[list] = [[] for _ in range(n)]
            for at, part in _slices(batch.column("__text")):
                data, starts, ends, owner = words_of(part)
                if not len(starts):
                    continue
                support, word = model.emissions(data, starts, ends)
                chance = chains(support[word], owner, model.moves)
                total = np.stack([np.bincount(owner, c, len(part)) for c in chance.T], 1)
                counts = np.bincount(owner, minlength=len(part))
                has = np.flatnonzero(counts)
                best[at + has] = total[has].argmax(axis=1)
                score[at + has] = np.clip(total[has].max(axis=1) / counts[has], 0, 1)
                most = chance.argmax(axis=1)
                turned = (most[1:] != most[:-1]) & (owner[1:] == owner[:-1])
                switches[at : at + len(part)] = np.bincount(owner[1:][turned], minlength=len(part))
                if stretches:
                    cuts = np.flatnonzero(np.concatenate(([True], turned | (owner[1:] != owner[:-1]))))
                    begin = np.cumsum(counts) - counts
                    for i, j in zip(cuts.tolist(), np.append(cuts[1:], len(owner)).tolist()):
                        place = {"first": int(i - begin[owner[i]]), "words": j - i, "lang": model.langs[most[i]]}
                        runs[at + owner[i]].append(place)
            held = [batch.column(i) for i in range(batch.num_columns - 1)]
            found = [pa.array(np.where(best < 0, "und", langs[best])), pa.array(score), pa.array(switches)]
            found += [pa.array(runs, run_type)] * stretches
            names = [f.name for f in fields] + ["lang_pred", "score", "n_switches"] + ["stretches"] * stretches
            yield pa.RecordBatch.from_arrays(held + found, names=names)

    return rows.mapInArrow(work, schema)


def predict(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, n_switches)`` of every document."""
    held = F.coalesce(fold("doc_id", FOLDS) == HELD, F.lit(True)).alias("held_out")
    return identify(docs, train(docs), [F.col("doc_id"), held])
