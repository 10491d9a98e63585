"""The registered queries: each operator over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom.llm import decontaminate, embedding_dedup, license_scan, mixing, quality, simhash
from tokenloom.llm import hard_negatives, language_id, pii, prefix_trie, substring_dedup, suffix_dedup, toxicity
from tokenloom.llm.common import table
from tokenloom.llm.registry import query


@query(
    "op1_substring_dedup",
    r"""
    WITH w AS (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
    ), win AS (
        SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS s
        FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 18, 1))) AS i FROM w)
    ), again AS (
        SELECT doc_id, i FROM (
            SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM win
        ) WHERE n > 1
    ), gone AS (
        SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM again
    ), word AS (
        SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w
    ), kept AS (
        SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS t
        FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id
    )
    SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed,
           sha256(coalesce(t, '')) AS kept_sha256
    FROM w LEFT JOIN kept USING (doc_id)
    """,
)
def op1(spark, sf_dir):
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@query(
    "op5_suffix_array_dedup",
    """
    WITH w AS (
        SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
    ), win AS (
        SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s
        FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 49, 0))) AS i FROM w)
    ), again AS (
        SELECT doc_id, i
        FROM win JOIN (SELECT s, min(doc_id) AS m FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)) USING (s)
        WHERE m < doc_id
    ), gone AS (
        SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM again
    ), spans AS (
        SELECT doc_id, count(*) AS n, count(*) FILTER (j - 1 IS DISTINCT FROM p) AS k
        FROM (SELECT doc_id, j, lag(j) OVER (PARTITION BY doc_id ORDER BY j) AS p FROM gone) GROUP BY doc_id
    ), byte AS (
        SELECT doc_id, substr(h, 2 * j + 1, 2) AS b, j
        FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2)) AS j FROM w)
    ), kept AS (
        SELECT doc_id, string_agg(b, '' ORDER BY j) AS t FROM byte ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id
    )
    SELECT w.doc_id, len(h) // 2 AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(k, 0) AS n_spans,
           sha256(unhex(coalesce(t, ''))) AS kept_sha256
    FROM w LEFT JOIN spans USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
)
def op5(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@query("op6_simhash_near_dedup")
def op6(spark, sf_dir):
    return simhash.linked(table(spark, sf_dir, "documents"))


@query("op2_mixing")
def op2(spark, sf_dir):
    mixed = mixing.deal_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "draws")


@query("op8_decontamination")
def op8(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _license_sql() -> str:
    """Every line against every template, without size bounds."""
    rows = ", ".join(f"('{name}', '{notice}')" for name, notice in license_scan.TEMPLATES.items())
    pairs = lambda text: (
        r"regexp_extract_all(lower(" + text + r"), '[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*')"
    )
    return f"""
    WITH lic(name, notice) AS (VALUES {rows}),
    lines AS (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               unnest(range(len(string_split(text, chr(10))))) AS line_no
        FROM documents WHERE text IS NOT NULL
    ), words AS (
        SELECT doc_id, line_no, NULL AS name, {pairs("line")} AS ws FROM lines
        UNION ALL SELECT NULL, NULL, name, {pairs("notice")} FROM lic
    ), grams AS (
        SELECT doc_id, line_no, name, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS g
        FROM words WHERE len(ws) > 1
    ), scores AS (
        SELECT l.doc_id, l.line_no, t.name AS license,
               CAST(2 AS DOUBLE) * len(list_intersect(l.g, t.g)) / (len(l.g) + len(t.g)) AS dice
        FROM grams l JOIN grams t ON l.name IS NULL AND t.name IS NOT NULL
    )
    SELECT doc_id, line_no, license, dice FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY dice DESC, license) AS n FROM scores
    ) WHERE n = 1 AND dice >= 0.8
    """


@query("op9_license_scan", _license_sql())
def op9(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query(
    "op10_embedding_near_dedup",
    """
    WITH RECURSIVE v AS (
        SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), link AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
        WHERE list_cosine_similarity(a.e, b.e) >= 0.95
    ), reach AS (
        SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
    ), low AS (
        SELECT a, min(b) AS m FROM reach GROUP BY a
    ), near AS (
        SELECT a, count(*) AS n FROM link GROUP BY a
    )
    SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
           vec_id <= coalesce(m, vec_id) AS kept
    FROM embeddings LEFT JOIN near ON near.a = vec_id LEFT JOIN low ON low.a = vec_id
    """,
)
def op10(spark, sf_dir):
    return embedding_dedup.link(table(spark, sf_dir, "embeddings"))


@query("op3_toxicity")
def op3(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_quality")
def op4(spark, sf_dir):
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_pii")
def op7(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


@query(
    "op13_hard_negatives",
    """
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
        SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same,
               CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
        FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0
    ), p AS (
        SELECT a, b, score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
    )
    SELECT p.a AS anchor_id, p.b AS positive_id,
           CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INTEGER) AS rank,
           s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
    FROM p JOIN s ON p.a = s.a AND NOT s.same
     AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
    QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) <= 10
    """,
)
def op13(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved))


@query(
    "op11_prefix_trie",
    """
    WITH own AS (
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
               struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS t
        FROM conversations WHERE conv_id IS NOT NULL
    ), conv AS (
        SELECT conv_id, conv_id - conv_id % 100 AS base, list(t ORDER BY i) AS ts FROM own GROUP BY conv_id
    ), crc AS (  -- CRC-32 bit by bit: a number of 256 or more brings a character in, 0 is one shift
        SELECT conv_id, xor(list_reduce(
            list_prepend(4294967295, flatten(list_transform(
                string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [ascii(c) + 256, 0, 0, 0, 0, 0, 0, 0, 0]))),
            lambda s, e: CASE WHEN e >= 256 THEN xor(s, e - 256)
                              WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END), 4294967295) % 6 AS h
        FROM conv
    ), rebuilt AS (
        SELECT c.conv_id, list_concat(coalesce(b.ts, [])[1:h], c.ts[h + 1:]) AS ts
        FROM conv c JOIN crc USING (conv_id) LEFT JOIN conv b ON b.conv_id = c.base
    ), member AS (
        SELECT conv_id, d, ts[1:d] AS node, len(ts) AS n
        FROM (SELECT *, unnest(range(0, len(ts) + 1)) AS d FROM rebuilt)
    ), node AS (
        SELECT d, node, min(conv_id) AS conv_id, count(*) AS n_convs,
               sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
        FROM member GROUP BY d, node
    ), kids AS (
        SELECT node[1:d - 1] AS node, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY 1, 2
    ), full_node AS (
        SELECT node.*, coalesce(kids.n, 0) AS n_children,
               CASE WHEN node.d > 0 THEN (n_convs - 1) * length(node[-1].text) ELSE 0 END AS saved
        FROM node LEFT JOIN kids USING (d, node)
    ), up AS (
        SELECT unnest(range(0, d + 1)) AS a, node, n_children, saved FROM full_node
    ), sums AS (
        SELECT a AS d, node[1:a] AS node, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
        FROM up GROUP BY 1, 2
    )
    SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children,
           n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
    FROM full_node f JOIN sums s ON s.d = f.d AND s.node = f.node
    LEFT JOIN node p ON f.d > 0 AND p.d = f.d - 1 AND p.node = f.node[1:f.d - 1]
    """,
)
def op11(spark, sf_dir):
    base = F.col("conv_id") - F.col("conv_id") % 100
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    turns = prefix_trie.turns(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(*prefix_trie.rebuild(turns, base, head, most=5))


@query("op12_language_id")
def op12(spark, sf_dir):
    return language_id.predict(table(spark, sf_dir, "documents"))
