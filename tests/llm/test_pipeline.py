"""The stages of the pipeline over the driver's smallest tables."""

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from tokenloom.llm import pii, queries, simhash
from tokenloom.llm.common import table
from tokenloom.llm.registry import QUERIES
from tokenloom.session import stage

SF = "/root/testdata/sf0.001"


def test_one_query_an_operator():
    assert queries and sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_stages(spark):
    docs = table(spark, SF, "documents").withColumn("score", F.lit("kept"))
    columns, texts = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    quality_kept = stage(corpus_pipeline.quality_stage(spark, docs, SF))
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    kept = {r["doc_id"] for r in quality_kept.collect()}
    assert quality_kept.columns == columns and kept < set(texts)
    right = [(i in kept) == (y == 1) for i, y in labels.items()]
    assert np.mean(right) > 0.9

    deduped = stage(corpus_pipeline.dedup_stage(spark, quality_kept, SF))
    left = {r["doc_id"] for r in deduped.collect()}
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(quality_kept).collect()}
    assert deduped.columns == columns and left == set(found.values())
    seen = [texts[i] for i in left]
    assert len(seen) == len(set(seen))

    clean = stage(corpus_pipeline.decontamination_stage(spark, deduped, SF))
    items = [" ".join(r["text"].lower().split()) for r in table(spark, SF, "benchmark").collect()]
    holds = {i for i in left if any(x in " ".join(texts[i].lower().split()) for x in items)}
    assert {r["doc_id"] for r in clean.collect()} == left - holds

    masked = stage(corpus_pipeline.pii_stage(spark, clean, SF))
    assert masked.columns == columns and masked.count() == clean.count()
    assert not any(pii.base_spans(r["text"]) for r in masked.collect())

    mixed = corpus_pipeline.mixing_stage(spark, masked, SF).toPandas()
    by = mixed.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(by["taken"] - by["target"]) <= 1).all()


def test_near_copies_are_found(spark):
    """Share of pairs with five-word Jaccard similarity of 0.8 and more that end in one group."""
    import random

    rng, rows, pairs = random.Random(1), [], []
    for i in range(150):
        w = [f"w{rng.randint(0, 9999)}" for _ in range(200)]
        v = [f"e{rng.randint(0, 9999)}" if rng.random() < 0.018 else x for x in w]
        a, b = ({tuple(x[j : j + 5]) for j in range(len(x) - 4)} for x in (w, v))
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
        if len(a & b) / len(a | b) >= 0.8:
            pairs.append(i)
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(pairs) > 50 and np.mean([found[2 * i + 1] == 2 * i for i in pairs]) > 0.85
    assert all(found[2 * i + 1] // 2 == i for i in range(150))


def test_near_copies_by_narrow_strata(spark):
    """Pairs just above 0.8 are linked, pairs below are not: five-word Jaccard by brute force."""
    import random

    rng, strata = random.Random(11), {"above": [], "below": []}
    while min(map(len, strata.values())) < 150:
        w = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
        v = list(w)
        for k in rng.sample(range(5, 295), rng.randint(6, 13)):
            v[k] = f"e{rng.randint(0, 10**6)}"
        a, b = ({tuple(x[j : j + 5]) for j in range(len(x) - 4)} for x in (w, v))
        jaccard = len(a & b) / len(a | b)
        name = "above" if 0.8 <= jaccard < 0.82 else "below" if 0.7 <= jaccard < 0.79 else None
        if name:
            strata[name].append((" ".join(w), " ".join(v)))
    for name, pairs in strata.items():
        rows = [(2 * i + k, pair[k]) for i, pair in enumerate(pairs) for k in (0, 1)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
        linked = np.mean([found[2 * i + 1] == 2 * i for i in range(len(pairs))])
        assert linked > 0.99 if name == "above" else linked == 0


def test_near_copies_in_large_buckets(spark):
    """Buckets over the limit give the groups of all pairs."""
    import random

    rng = random.Random(12)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    rows = [(0, " ".join(base)), (90, None), (91, " "), (92, "two words"), (93, "TWO  words")]
    for i in range(1, 40):
        v = list(base)
        for k in rng.sample(range(120), 1 + i % 4):
            v[k] = f"e{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(v)))
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, t in rows if (w := (t or "").lower().split())}
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    want = {i: i for i, _ in rows} | {91: 90}
    for _ in rows:
        for a, b in near:
            want[a] = want[b] = min(want[a], want[b])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (256, 3):
        assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, hot=hot).collect()} == want


def test_near_copies_meet_by_fingerprint(spark, monkeypatch):
    """Pairs within two bits are found by pigeonring chains, whatever the bands give, and only similar ones link."""
    import random

    import xxhash

    rng, rows, want = random.Random(21), [], {}

    def bits(words):
        grams = {" ".join(words[j : j + 5]) for j in range(len(words) - 4)}
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return grams, sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))

    for i in range(40):
        w = [f"w{rng.randint(0, 10**6)}" for _ in range(400)]
        v = [*w[:-1], "end"]
        (a, x), (b, y) = bits(w), bits(v)
        assert len(a & b) / len(a | b) >= 0.8
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
        want |= {2 * i: 2 * i, 2 * i + 1: 2 * i if (x ^ y).bit_count() <= 2 else 2 * i + 1}
    monkeypatch.setattr(simhash, "SKETCH_LANES", -1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert got == want and sum(want[2 * i + 1] == 2 * i for i in range(40)) > 20
    assert {r["doc_id"] for r in simhash.keep_first(docs).collect()} == set(want.values())


def test_pairs_below_the_similarity_are_not_listed(spark, monkeypatch):
    """Many texts that are alike, but not enough, cost about their number, not its square."""
    import random

    rng, seen, similar = random.Random(22), [], simhash._similar
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    rows = []
    for i in range(80):
        v = list(base)
        for k in rng.sample(range(10, 110), 2):
            v[k] = f"e{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(v)))

    def counted(pairs, sets, similarity):
        seen.append(pairs.count())
        return similar(pairs, sets, similarity)

    monkeypatch.setattr(simhash, "_similar", counted)
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    near = [(a, b) for a in range(80) for b in range(a) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    want = {i: i for i in range(80)}
    for _ in rows:
        for a, b in near:
            want[a] = want[b] = min(want[a], want[b])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()} == want
    assert sum(seen) <= 4 * len(rows), seen
