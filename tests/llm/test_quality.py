"""Word vectors against a plain count, the two ways to them, and what vocabulary alone can tell."""

import random
from collections import defaultdict

import numpy as np
import pytest
from tokenloom.llm import quality
from tokenloom.llm.common import encode

DOCS = "doc_id long, text string, k1 string, word int, near int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], DOCS).repartition(5)


def labelled(spark, good, bad, n=300, length=60):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(bad if i % 3 == 0 else good, k=length))) for i in range(n)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(n)], "doc_id long, quality int")
    return rows, labels


def vocabulary(seed, size=200):
    """Words of one spelling: eight lower-case letters."""
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(size)]


def test_only_vocabulary_tells(spark):
    rows, labels = labelled(spark, vocabulary(1), vocabulary(2))
    got = quality.score(frame(spark, rows), labels).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 300 and len(held) > 40
    assert np.mean([r["predicted"] == (r["doc_id"] % 3 != 0) for r in held]) > 0.97


def test_vectors_against_a_plain_count(spark):
    texts = ["red fish blue fish", "red fish", None, "", "  blue\n", "fish " * 40, "red fish blue fish", "é 中 é"]
    docs = frame(spark, list(enumerate(texts)))
    sums, times = defaultdict(lambda: np.zeros(quality.SIZE, int)), defaultdict(int)
    index = quality._index_vectors().astype(int)
    for text in texts:
        word, spelling, owner = quality.words_of(encode([text]))
        side = [index[w >> np.uint64(51)] + index[quality.CONTEXTS + s] for w, s in zip(word, spelling)]
        for i, w in enumerate(word.tolist()):
            times[w] += 1
            sums[w] += index[quality.CONTEXTS + spelling[i]]
            for j in (i - 1, i + 1):
                if 0 <= j < len(word):
                    sums[w] += side[j]
    for least in (1, 3):
        table = quality.word_vectors(docs, quality.frequent(docs, least)).toPandas()
        got = {w % (1 << 64): (n, v) for w, n, v in zip(table["word"].tolist(), table["n"].tolist(), quality.unpack(table))}
        assert {w: n for w, (n, _) in got.items()} == {w: n for w, n in times.items() if n >= least}
        for w, (n, v) in got.items():
            assert np.abs(v - sums[w] * quality.SCALE / n).max() <= 0.5


@pytest.mark.parametrize("least", [1, 4])
def test_joined_words_score_like_those_in_the_tasks(spark, least):
    rows, labels = labelled(spark, vocabulary(1, 60), vocabulary(2, 60), n=90, length=20)
    # Copies, texts without words and rows without id; columns whose names the operator uses itself.
    rows += [(1000 + i, rows[0][1]) for i in range(200)] + [(None, rows[1][1]), (2000, None), (2001, ""), (2002, " \n")]
    docs = frame(spark, rows)
    inside, part, joined = (
        {(r["doc_id"], r["held_out"]): r["score"] for r in quality.score(docs, labels, least, hot).collect()}
        for hot in (1 << 18, 40, 0)
    )
    assert len(inside) == len(rows) and inside.keys() == part.keys() == joined.keys()
    assert max(abs(inside[k] - other[k]) for k in inside for other in (part, joined)) < 1e-4
    score = dict((i, s) for (i, _), s in joined.items())
    assert len({score[1000 + i] for i in range(200)} | {score[0]}) == 1 and score[None] == score[1]
    assert score[2000] == score[2001] == score[2002]


def test_kept_rows_keep_their_columns(spark):
    rows, labels = labelled(spark, vocabulary(1), vocabulary(2))
    docs = frame(spark, rows + [(None, rows[0][1]), (None, rows[1][1]), (1, rows[1][1])])
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    scores = {r["doc_id"]: r["predicted"] for r in quality.score(frame(spark, rows), labels).collect()}
    wanted = [i for i, _ in rows if scores[i]] + [None] * (scores[0] + scores[1]) + [1] * scores[1]
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(map(str, wanted))
