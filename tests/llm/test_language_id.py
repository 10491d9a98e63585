"""Language identification on held-out rows, its chains against a word-by-word recursion."""

import random

import numpy as np
import pytest

from tokenloom.llm import language_id as lang

DOCS = "doc_id long, text string, lang string, source string, score string, __text string"
SYLLABLES = {"aa": "ka lo mi tu ra ne".split(), "bb": "sch ung ver ich ten auf".split(), "cc": "éa oux ién ère quo dè".split()}


def text(code, n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(SYLLABLES[code], k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    out = [(i, text(c, 5 + i % 60, i), c) for i in range(240) for c in [sorted(SYLLABLES)[i % 3]]]
    out += [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 34 .. €", "cc"), (1003, "x" * 5000, "aa"), (None, text("bb", 40, 9), "aa")]
    out += [(1004, text("aa", 300, 1) + ". " + text("cc", 300, 2), None), (2**53 + 1, text("cc", 30, 3), None)]
    return out + [(7, text("aa", 30, 4), "aa"), (7, text("bb", 30, 4), "bb")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, c, "s", "x", "y") for i, t, c in rows], DOCS).repartition(4)


def test_held_out_rows(docs, rows):
    found = lang.predict(docs).collect()
    assert len(found) == len(rows)
    by_id = {r["doc_id"]: r for r in found if r["doc_id"] != 7}
    held = [(by_id[i], c) for i, t, c in rows if i is not None and i < 240 and i != 7 and by_id[i]["held_out"]]
    assert len(held) > 30 and sum(r["lang_pred"] == c for r, c in held) / len(held) > 0.97
    assert {by_id[i]["lang_pred"] for i in (1000, 1001, 1002)} == {"und"}
    assert {by_id[i]["score"] for i in (1000, 1001, 1002)} == {0.0}
    assert by_id[None]["held_out"] and by_id[None]["lang_pred"] == "bb"
    assert by_id[2**53 + 1]["lang_pred"] == "cc" and by_id[1003]["lang_pred"] in SYLLABLES
    assert all(0 <= r["score"] <= 1 for r in found)


def test_switching_text(docs):
    model = lang.train(docs)
    two = lang.identify(docs.where("doc_id = 1004"), model, stretches=True).collect()[0]
    assert two["n_switches"] <= 5 and 0.4 < two["score"] < 0.6
    longest = sorted(two["stretches"], key=lambda s: -s["words"])[:2]
    assert sorted(s["lang"] for s in longest) == ["aa", "cc"] and abs(max(s["first"] for s in longest) - 300) <= 5
    assert sum(s["words"] for s in two["stretches"]) == 600


def test_lexicon_counts_all_learnable_words(docs, rows):
    import zlib

    counts = {(r["word"], r["lang"]): r["n"] for r in lang.word_counts(docs).collect()}
    words = [
        w for i, t, c in rows if i is not None and c and t and zlib.crc32(str(i).encode()) % 4 != 2
        for w in lang.words_of(lang.lowered([t]))[1]
    ]
    assert sum(counts.values()) == len(words)


def test_nothing_to_learn_from(spark, docs):
    empty = lang.predict(docs.where("false"))
    assert empty.collect() == [] and empty.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    blind = lang.predict(docs.where("lang is null")).collect()
    assert {(r["lang_pred"], r["score"]) for r in blind} == {("und", 0.0)}


@pytest.mark.parametrize("sizes", [[1], [3, 70, 1, 130, 64, 65], [200, 5]])
def test_chains_equal_the_recursion(sizes):
    rng = np.random.default_rng(len(sizes))
    support, moves = rng.normal(size=(sum(sizes), 3)), rng.normal(size=(3, 3))
    got = lang.chains(support, np.repeat(np.arange(len(sizes)) * 2, sizes), moves)
    at = 0
    for n in sizes:
        force, step = np.exp(support[at : at + n]), np.exp(moves)
        ahead, back = [force[0]], [np.ones(3)]
        for t in range(1, n):
            ahead.append(ahead[-1] @ step * force[t])
            ahead[-1] = ahead[-1] / ahead[-1].sum()
        for t in range(n - 1, 0, -1):
            back.append(step @ (force[t] * back[-1]))
            back[-1] = back[-1] / back[-1].sum()
        want = np.array(ahead) * np.array(back[::-1])
        assert np.allclose(got[at : at + n], want / want.sum(axis=1, keepdims=True))
        at += n
