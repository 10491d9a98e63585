"""Each operator on small odd inputs, against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tokenloom.llm import decontaminate, embedding_dedup, license_scan, mixing, pii, quality, repeats, simhash
from tokenloom.llm import substring_dedup, suffix_dedup, toxicity
from tokenloom.llm.components import components
from tokenloom.session import FEW_FILES, stage

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, None) for i, t, s in rows], DOCS)


def words(n, seed, size=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randint(0, size)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    shared, line = words(60, 1), words(24, 2)
    rows = [(i, words(90, 10 + i) + " " + shared + "\n" + words(40, 50 + i), "a") for i in range(6)]
    rows += [(10 + i, line + " " + words(5, 80 + i), "b") for i in range(4)]
    rows += [(20, rows[0][1], None), (21, None, "a"), (22, "", "a"), (23, " \t\n", None), (24, "é" * 400, "c")]
    rows += [(25, line + " " + line, "b"), (25, line + " " + line, "b"), (None, shared, "a"), (26, "aß" * 300, "c")]
    rows += [(27, words(4000, 3), "a"), (28, words(19, 5), "a"), (29, "x " * 3000, "c")]
    return rows


def covered(starts, n, size):
    gone = np.zeros(n, bool)
    for s in starts:
        gone[s : s + size] = True
    return gone


def naive_words(rows, size=20):
    lists = [(i, WORD.findall(t or "")) for i, t, _ in rows if i is not None]
    first = {}
    for i, w in lists:
        for s in range(len(w) - size + 1):
            key = tuple(w[s : s + size])
            first[key] = min(first.get(key, (i, s)), (i, s))
    out = []
    for i, w in lists:
        starts = [s for s in range(len(w) - size + 1) if first[tuple(w[s : s + size])] < (i, s)]
        gone = covered(starts, len(w), size)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def naive_bytes(rows, size=50):
    lists = [(i, (t or "").encode()) for i, t, _ in rows if i is not None]
    first = {}
    for i, b in lists:
        for s in range(len(b) - size + 1):
            first[b[s : s + size]] = min(first.get(b[s : s + size], i), i)
    out = []
    for i, b in lists:
        gone = covered([s for s in range(len(b) - size + 1) if first[b[s : s + size]] < i], len(b), size)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [4096, 2])
def test_substring_dedup(spark, corpus, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    got = substring_dedup.remove_repeats(frame(spark, corpus)).collect()
    assert sorted(map(tuple, got)) == naive_words(corpus)


@pytest.mark.parametrize("hot", [4096, 2])
def test_suffix_dedup(spark, corpus, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    got = suffix_dedup.remove_repeats(frame(spark, corpus)).collect()
    assert sorted(map(tuple, got)) == naive_bytes(corpus)


def test_dedup_over_many_chunks_and_its_texts(spark, corpus, monkeypatch):
    for name in ("CHUNK", "BLOCK", "GROUP"):
        monkeypatch.setattr(repeats, name, 2000)
    got = substring_dedup.remove_repeats(frame(spark, corpus), texts=True).collect()
    assert sorted(tuple(r)[:4] for r in got) == naive_words(corpus)
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in got)
    kept = suffix_dedup.remove_repeats(frame(spark, corpus), texts=True).collect()
    assert sorted(tuple(r)[:5] for r in kept) == naive_bytes(corpus)


def test_merge_of_runs_knows_common_prefixes():
    rng = random.Random(4)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(6)) for _ in range(rng.randint(0, 9))) for _ in range(5)]
    common = [[0] + [len(x) if x == y else next(i for i in range(6) if x[i] != y[i]) for x, y in zip(r, r[1:])] for r in runs]
    run, row, share = suffix_dedup.merge_runs([(r, c[: len(r)]) for r, c in zip(runs, common)], 6)
    merged = [runs[a][b] for a, b in zip(run, row)]
    assert merged == sorted(x for r in runs for x in r)
    for x, y, n in zip(merged, merged[1:], share[1:]):
        assert x[:n] == y[:n] and (n == 6 or x[n] != y[n])


def naive_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def naive_groups(nodes, linked):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("hot", [256, 1])
def test_simhash_links(spark, hot):
    rng = random.Random(6)
    prints = [rng.getrandbits(64) for _ in range(12)]
    prints += [p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for p in prints for _ in range(8)]
    prints += [0, 0, 3, 7]
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    rows = simhash.groups(spark.createDataFrame(signed, "doc_id long, f0 long"), 2, hot=hot).collect()
    near = [(a, b) for a in range(len(prints)) for b in range(a) if bin(prints[a] ^ prints[b]).count("1") <= 2]
    assert {r["doc_id"]: r["component_id"] for r in rows} == naive_groups(range(len(prints)), near)


def test_simhash_query_form(spark, corpus):
    rows = simhash.linked(frame(spark, corpus)).collect()
    assert len(rows) == sum(i is not None for i, _, _ in corpus)
    texts = {i: t for i, t, _ in corpus}
    assert all(r["fingerprint"] == f"{naive_print(texts[r['doc_id']]):016x}" for r in rows)
    assert {r["component_id"] for r in rows if r["doc_id"] in (21, 22, 23)} == {21}


def test_near_duplicates_keep_one_of_each_group(spark):
    base = [words(300, 100 + i, 5000) for i in range(12)]
    near = [t.split() for t in base]
    for w in near:
        w[150] = "other"
    rows = [(i, t, "a") for i, t in enumerate(base)] + [(100 + i, " ".join(w), "a") for i, w in enumerate(near)]
    rows += [(None, base[0], "a"), (200, base[0], "b")]
    kept = [r["doc_id"] for r in simhash.keep_first(frame(spark, rows)).collect()]
    assert sorted(x for x in kept if x is not None) == list(range(12)) and kept.count(None) == 1


def test_few_links_make_few_files(spark, monkeypatch):
    """Not one for each shuffle partition, in every table of every round."""
    written = []

    def counted(df, rows=None):
        out = stage(df, rows)
        if rows is not None:
            written.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr("tokenloom.llm.components.stage", counted)
    links = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    names = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        got = {r["node"]: r["component"] for r in components(links).collect()}
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert got == {i: 0 for i in range(301)}
    assert written and max(written) <= FEW_FILES


def test_components_of_a_long_chain(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(200)] + [(500, i) for i in range(501, 540)] + [(7, 7), (900, 901)]
    rng.shuffle(links)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == naive_groups({x for e in links for x in e}, links)


def test_mixing(spark, corpus):
    mixed = mixing.mix_sources(frame(spark, corpus), block_words=50)
    rows = mixed.collect()
    sizes = {}
    for _, t, s in corpus:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    names = sorted((s for s in sizes if s is not None)) + [None]
    goal, open_names, total = {}, list(names), sum(sizes.values())
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    while True:
        level = (total - sum(goal.values())) / sum(weight[s] for s in open_names)
        above = [s for s in open_names if level * weight[s] > 3 * sizes[s]]
        if not above:
            break
        goal.update({s: 3 * sizes[s] for s in above})
        open_names = [s for s in open_names if s not in above]
    goal.update({s: level * weight[s] for s in open_names})
    for s in names:
        mine = [r for r in rows if r["source"] == s]
        assert mine[0]["source_size"] == sizes[s] and mine[0]["target"] == pytest.approx(goal[s])
        assert abs(sum(r["taken"] for r in mine) - goal[s]) <= 1
    assert len(rows) == len(corpus) and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(frame(spark, corpus), block_words=50).collect()))


def test_splitting_tree_gives_every_draw_to_one_shard(spark, corpus):
    mixed = mixing.mix_sources(frame(spark, corpus), block_words=50)
    draws = mixing.shard_of(mixed, 5).collect()
    taken = {}
    for r in draws:
        assert r["shard"] in range(5)
        taken[r["doc_id"], r["source"]] = taken.get((r["doc_id"], r["source"]), 0) + r["words"]
    want = {}
    for r in mixed.where("taken > 0").collect():
        want[r["doc_id"], r["source"]] = want.get((r["doc_id"], r["source"]), 0) + r["taken"]
    assert taken == want
    quotas = spark.createDataFrame([("a", 700), ("b", 300), (None, 24)], "source string, quota long")
    rows = mixing.split_tree(quotas, 8, 3).collect()
    for s, n in (("a", 700), ("b", 300), (None, 24)):
        assert sum(r["blocks"] for r in rows if r["source"] == s) == n
    assert {sum(r["blocks"] for r in rows if r["shard"] == k) for k in range(8)} == {128}


def test_mix_is_the_sum_of_draws_from_the_tree(spark, corpus, monkeypatch):
    docs = frame(spark, corpus)
    mixed = mixing.mix_sources(docs, block_words=50)
    want = sorted((str(r["doc_id"]), str(r["source"]), r["size"], r["taken"]) for r in mixed.collect())
    asked = []
    tree = mixing.split_tree
    monkeypatch.setattr(mixing, "split_tree", lambda q, shards, seed: asked.append(shards) or tree(q, shards, seed))
    rows = mixing.deal_sources(docs, block_words=50, shard_words=1000).collect()
    assert sorted((str(r["doc_id"]), str(r["source"]), r["size"], r["taken"]) for r in rows) == want
    assert asked == [-(-sum(r["taken"] for r in rows) // 1000)] and asked[0] > 3
    assert all(r["taken"] == sum(d["words"] for d in r["draws"]) for r in rows)
    assert {d["shard"] for r in rows for d in r["draws"]} == set(range(asked[0]))
    # Draws of one document in one shard still have places of their own.
    assert all(len({d["place"] for d in r["draws"]}) == len(r["draws"]) for r in rows)
    assert mixing.deal_sources(frame(spark, [])).count() == 0


def test_mixing_query_and_stage_draw_from_the_tree(spark, monkeypatch):
    import corpus_pipeline
    from tokenloom.llm.queries import op2

    asked = []
    tree = mixing.split_tree
    monkeypatch.setattr(mixing, "split_tree", lambda *a: asked.append(1) or tree(*a))
    sf = "/root/testdata/sf0.001"
    rows = op2(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    staged = corpus_pipeline.mixing_stage(spark, docs, sf).collect()
    assert asked == [1, 1] and len(rows) == len(staged) == docs.count()
    for r in rows + staged:
        assert r["taken"] == sum(d["words"] for d in r["draws"])


def test_licences(spark):
    text = "Some prose here.\nlicensed under THE apache license version 2.0\nunder the\n\nReleased under the MIT License."
    rows = [(1, text, "a"), (2, None, "a"), (3, "", "a"), (4, "word " * 5000, "a"), (None, "Licensed under CC BY-NC 4.0.", "a")]
    got = {(r["doc_id"], r["line_no"], r["license"]): r["dice"] for r in license_scan.scan(frame(spark, rows)).collect()}
    assert got == {(1, 1, "Apache-2.0"): 1.0, (1, 4, "MIT"): 1.0, (None, 0, "CC-BY-NC-4.0"): 1.0}
    pairs = lambda t: {(a, b) for a, b in zip(t, t[1:])}
    near = "this work is licensed under the gnu public license version 3"
    a, b = pairs(near.split()), pairs("this work is licensed under the gnu general public license version 3".split())
    row = license_scan.scan(frame(spark, [(1, near, "a")])).first()
    assert row["license"] == "GPL-3.0" and row["dice"] == pytest.approx(2 * len(a & b) / (len(a) + len(b)))


def test_decontamination(spark):
    item = words(40, 900, 9000)
    edited = item.replace(" w", " v", 3)
    rows = [(1, words(50, 1) + " " + item.upper() + "\n" + words(50, 2), "a"), (2, words(80, 3) + " " + edited, "a")]
    rows += [(3, words(120, 4), "a"), (4, None, "a"), (5, "", "a"), (6, item[: len(item) // 2], "a"), (None, item, "a")]
    bench = spark.createDataFrame([(7, item), (8, None), (9, "short"), (7, item)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.leaks(frame(spark, rows), bench).collect()}
    assert got == {(1, 7, 0), (2, 7, 3), (None, 7, 0)}
    kept = decontaminate.drop_leaks(frame(spark, rows), bench)
    assert kept.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    # The row without id holds the whole item, so it goes like any other.
    assert {r["doc_id"] for r in kept.collect()} == {3, 4, 5, 6}
    clean = frame(spark, [(None, words(60, 5), "a"), (2**53 + 1, words(60, 6), "a")])
    assert {r["doc_id"] for r in decontaminate.drop_leaks(clean, bench).collect()} == {None, 2**53 + 1}


def naive_leaks(text, items, rate):
    """Fewest edits of every item against any part of a text, where its budget allows them."""
    out = {}
    for number, item in items:
        budget = min(int(len(item) * rate), (len(item) - decontaminate.GRAM) // decontaminate.GRAM)
        cost = [0] * (len(text) + 1)
        for i, x in enumerate(item, 1):
            row = [i]
            for j, y in enumerate(text, 1):
                row.append(min(cost[j] + 1, row[j - 1] + 1, cost[j - 1] + (x != y)))
            cost = row
        if min(cost) <= budget:
            out[number] = min(min(cost), out.get(number, budget))
    return out


def test_decontamination_equals_all_alignments(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PAIRS", 64)
    rng = random.Random(12)
    items = [(i, "".join(rng.choice("abcde ") for _ in range(rng.randint(40, 90)))) for i in range(4)] + [(4, "ab" * 30)]
    rows = []
    for i in range(24):
        part = list(items[i % 5][1])
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(part))
            rng.choice([lambda: part.__delitem__(at), lambda: part.insert(at, "x"), lambda: part.__setitem__(at, "y")])()
        rows.append((i, "zq " * rng.randint(0, 9) + "".join(part) + " qz" * rng.randint(0, 9), "a"))
    rows += [(50, "ab" * 200, "a"), (51, "ba" * 200, "a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.leaks(frame(spark, rows), bench).collect()}
    normal = [(n, decontaminate.normal(t).decode()) for n, t in items]
    want = {
        (i, n): e for i, t, _ in rows for n, e in naive_leaks(decontaminate.normal(t).decode(), normal, decontaminate.RATE).items()
    }
    assert got == want and len(want) > 12


def test_repetitive_text_is_searched_in_bounded_memory():
    index = decontaminate.Index.of([{"item_id": 1, "text": "ab" * 500}], decontaminate.GRAM, decontaminate.RATE)
    hits = decontaminate.search(decontaminate.normal("ab" * 16_000), index, decontaminate.GRAM)
    assert [h[:2] for h in hits] == [(1, 0)]


def test_large_ids_beside_rows_without_id(spark):
    """Whole numbers above 2**53 stay what they are in a batch that also holds a NULL."""
    big, text = 2**53 + 1, "write to bob@mail.example.com now"
    docs = frame(spark, [(None, text, "a"), (big, text, "a"), (big + 2, None, "a")]).coalesce(1)
    labels = spark.createDataFrame([(big, 1, 1), (big + 2, 0, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(big, text * 3)], "item_id long, text string")
    three = frame(spark, [(None, text * 3, "a"), (big, text * 3, "a"), (big + 2, None, "a")]).coalesce(1)
    ids = {None, big, big + 2}
    for found in (
        toxicity.score(docs, labels), quality.score(docs, labels), pii.find(docs), pii.redact(docs),
        quality.keep_good(docs, labels.where("false")),
    ):
        assert {r["doc_id"] for r in found.collect()} == ids
    assert {r["doc_id"] for r in decontaminate.leaks(three, bench).collect()} == {None, big}
    assert {r["doc_id"] for r in decontaminate.drop_leaks(three, bench).collect()} == {big + 2}


def test_alignment_is_the_edit_distance():
    rng = random.Random(8)
    for _ in range(60):
        item = bytes(rng.choice(b"abcd") for _ in range(rng.randint(12, 30)))
        text = bytearray(item)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(text))
            rng.choice([lambda: text.__delitem__(at), lambda: text.insert(at, 120), lambda: text.__setitem__(at, 121)])()
        whole = b"zz" + bytes(text) + b"zzz"
        cost = [0] * (len(whole) + 1)
        for i, x in enumerate(item, 1):
            row = [i]
            for j, y in enumerate(whole, 1):
                row.append(min(cost[j] + 1, row[j - 1] + 1, cost[j - 1] + (x != y)))
            cost = row
        hit = decontaminate.align(item, whole, -6, 12, 30)
        assert hit[0] == min(cost)


def naive_base(text):
    found = []
    for k, p in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(p, text):
            v, d = m.group(), re.sub("[^0-9]", "", m.group())
            if k == "ip" and any(int(x) > 255 for x in v.split(".")):
                continue
            if k == "card" and not (12 <= len(d) <= 19 and pii.luhn(d)):
                continue
            if k == "phone" and not 9 <= len(d) <= 15:
                continue
            found.append((m.start(), m.end(), k))
    return sorted(found, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    pieces = ["a.b@c.de", "@", "x@y", "1.2.3.4", "1.2.3.4.5.6.7.8.9", "999.1.1.1", "4111111111111111", "4111 1111-1111 1111"]
    pieces += ["+1 (017) 555-7713", "+49", "..", " ", "é", "٣", "a@b@c.d.e", "0007", "-", "+", "12345678901234567890"]
    for _ in range(600):
        text = "".join(rng.choice(pieces) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 9)))
        assert pii.base_spans(text) == naive_base(text), text


def test_pii_query_and_redaction(spark):
    pad = " and some more plain words stand here between them "
    kinds = ["+1 (017) 555-77{:02}", "bob{}@mail.example.com", "10.0.0.{}"]
    cards = [c for n in range(4111111111110000, 4111111111110900) if pii.luhn(c := str(n))]
    rows = [(i, pad.join([k.format(i) for k in kinds] + [cards[i]]) + pad, "a") for i in range(40)]
    rows += [(100, "the card 4111111111111112 end", "a"), (101, None, "a"), (102, "", "a"), (None, "mail a@b.cd", "a")]
    rows += [(103, 'key token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" of v1.2.3', "a"), (104, "1" * 20000, "a")]
    got = {r["doc_id"]: r for r in pii.find(frame(spark, rows)).collect()}
    for i, t, _ in rows:
        base = pii.joined(naive_base(t or ""))
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(got[i]["spans"].split(","))
    assert got[100]["n_card"] == 0 and got[100]["spans"] == "card:9:25", got[100]
    assert got[103]["spans"] == "" and got[101]["spans"] == ""
    clean = {r["doc_id"]: r for r in pii.redact(frame(spark, rows)).collect()}
    assert clean[3]["text"] == pad.join(["[PHONE]", "[EMAIL]", "[IP]", "[CARD]"]) + pad
    assert clean[101]["text"] is None and clean[3]["n_chars"] == len(clean[3]["text"])


SPELLED = ["und.34 at mail7 dot example dot com", "und.34(at)mail7.example.com", "und.34 (at) mail7.example.com", "und.34[at]mail7[dot]example[dot]com"]


def test_spelled_out_addresses(spark, monkeypatch):
    rng, rows = random.Random(9), []
    kinds = ["+1 (0{:02}) 555-77{:02}", "und.{}@mail{}.example.com", "10.0.{}.{}"]
    for i in range(120):
        lead = [" ".join(rng.choice("some more plain words stand here".split()) for _ in range(4)) for _ in range(2)]
        rows.append((i, f" {lead[0]} ".join(["say", kinds[i % 3].format(i % 90, 10 + i % 80), lead[1]]), "a"))
    seen, fit = [], pii.fit
    monkeypatch.setattr(pii, "fit", lambda examples: seen.extend(examples) or fit(examples))
    field = pii.train(frame(spark, rows))
    # Every kind has segments that the field can hold, base and damaged.
    gold = [t for _, truth in seen for t in truth]
    assert all(b - a <= pii.LONGEST for a, b, _ in gold) and len(gold) == 240
    assert [sum(k == n for *_, k in gold) for n in range(3)] == [80, 80, 0]
    text = lambda a: f"please write some words to {a} when you stand here"
    for a in SPELLED:
        assert pii.all_spans(text(a), field)[1] == [(27, 27 + len(a), "email")], a
    for a in ("und.34 AT mail7 DOT example DOT com", "und.34\nat mail7 dot example\ndot com", "und.34 (AT) mail7.example.com"):
        assert pii.all_spans(text(a), field)[1] == [(27, 27 + len(a), "email")], a
    assert pii.all_spans("plain words stand at home and here", field)[1] == []
    more = rows + [(200 + i, text(a), "a") for i, a in enumerate(SPELLED)]
    clean = {r["doc_id"]: r["text"] for r in pii.redact(frame(spark, more)).collect()}
    assert {clean[200 + i] for i in range(len(SPELLED))} == {text("[EMAIL]")}


def test_stretches_around_spelled_out_marks():
    forms = ["jane at example.com", "jane AT host DOT example DOT com", "jane\nat host dot com", "jane ( At ) host.com"]
    forms += ["jane at\thost.com", "jane at host  dot\nexample dot com"]
    for form in forms:
        assert any(form in "".join(tokens) for _, tokens in pii.regions(f"words stand here {form} and others here")), form
    for plain in ("we met at home and left", "look at that. Then go", "at last the dot is here"):
        assert not list(pii.regions(plain)), plain


def naive_cosine(vectors):
    good = {i: v for i, v in vectors if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    unit = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v in good.items()}
    ids = sorted(unit)
    return [(a, b) for a in ids for b in ids if a > b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]


@pytest.mark.parametrize("tile", [2048, 3])
def test_embeddings(spark, tile, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(40)]
    rows += [(100 + i, (np.array(rows[i % 4][1]) + 0.05 * rng.standard_normal(16)).tolist()) for i in range(30)]
    rows += [(200 + i, rows[5][1]) for i in range(9)]
    rows += [(300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, [1.0, None]), (304, []), (305, [1e-30, 0.0]), (306, [5.0, 0.0])]
    got = {r["vec_id"]: r for r in embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    links = naive_cosine(rows)
    found = sum(r["n_links"] for r in got.values())
    assert 0.9 * 2 * len(links) <= found <= 2 * len(links)
    groups = naive_groups([i for i, _ in rows], links)
    assert {i: r["component_id"] for i, r in got.items()} == groups
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())
    assert got[200]["n_links"] >= 9 and got[302]["n_links"] == 0


def test_planted_pairs_of_vectors_are_components(spark):
    rng = np.random.default_rng(11)
    near = []
    for i in range(400):
        v = rng.standard_normal(64)
        near += [(2 * i, v.tolist()), (2 * i + 1, (v + 0.05 * rng.standard_normal(64)).tolist())]
    vectors = spark.createDataFrame(near, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in embedding_dedup.link(vectors).collect()}
    assert naive_groups(range(800), naive_cosine(near)) == {i: r["component_id"] for i, r in got.items()}
    assert sum(r["kept"] for r in got.values()) == 400 and all(r["n_links"] == 1 for r in got.values())


def labelled(spark, bad, n=400):
    rows = [(i, words(30, i, 50) + (" " + bad(i) if i % 4 == 0 else ""), "a") for i in range(n)]
    rows += [(None, "x", "a"), (n, None, "a"), (n + 1, "", "a"), (n + 2, "y " * 9000, "a")]
    labels = [(i, int(i % 4 != 0), int(i % 4 == 0)) for i in range(n)] + [(3, None, None), (None, 1, 1), (9999, 1, 1)]
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("score, label, bad", [
    (toxicity.score, "toxic", lambda i: "filth scum"[: 5 + 5 * (i % 8 == 0)]),
    (quality.score, "quality", lambda i: "%%% @@@## " * 12),
])
def test_classifiers_on_held_out_rows(spark, score, label, bad):
    docs, labels = labelled(spark, bad)
    scored = score(docs, labels)
    got = scored.collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    truth = {r["doc_id"]: r[label] for r in labels.where(f"{label} is not null").collect()}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 40 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(r["held_out"] for r in got if r["doc_id"] is None)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]


def test_classifiers_without_labels(spark):
    docs, labels = labelled(spark, lambda i: "", 8)
    none = labels.where("false")
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.keep_good(docs, none).count() == docs.count()


def test_empty_tables(spark):
    none = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<double>")
    for df in (
        substring_dedup.remove_repeats(none), suffix_dedup.remove_repeats(none), simhash.linked(none),
        mixing.mix_sources(none), license_scan.scan(none), decontaminate.leaks(none, bench), pii.find(none),
        pii.redact(none), embedding_dedup.link(vectors), toxicity.score(none, labels), quality.score(none, labels),
        quality.keep_good(none, labels), simhash.keep_first(none), decontaminate.drop_leaks(none, bench),
    ):
        assert df.count() == 0
