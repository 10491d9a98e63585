"""Secret scan and redaction over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom import bridge
from tokenloom.catalog import lake
from tokenloom.catalog.registry import query
from tokenloom.catalog.sql import q
from tokenloom.functions import secrets
from tokenloom.operators import exposure
from tokenloom.sources import linear_agent

# Every 50th document gets key-shaped text derived from its id appended.
PLANTED = """
pl AS (SELECT doc_id, text || CASE WHEN doc_id%50=0 THEN ' id AKIA'||upper(substr(md5(CAST(doc_id AS VARCHAR)),1,16))||' end' ELSE '' END
   || CASE WHEN doc_id%70=0 THEN ' use ghp_'||substr(sha256(CAST(doc_id AS VARCHAR)),1,40)||' ok' ELSE '' END
   || CASE WHEN doc_id%90=0 THEN ' key sk-ant-api03-'||md5(CAST(doc_id AS VARCHAR)) ELSE '' END
   || CASE WHEN doc_id%110=0 THEN ' key sk-proj-'||md5(CAST(doc_id AS VARCHAR)) ELSE '' END AS text FROM documents),
asg AS (SELECT doc_id, regexp_extract_all(text, '(?i)(\\b[A-Za-z0-9_.-]*(?:password|passwd|secret|api[_-]?key|access[_-]?key|token)[A-Za-z0-9_]*\\s*[=:]\\s*\\\\?["'']?)([^\\s"''\\\\,;(){}<>\\[\\]]{8,})', 2) AS vals, text FROM pl)
"""

#: Occurrences of every kind of each planted text.
FOUND = (
    PLANTED
    + r""",
fnd AS (SELECT doc_id, kind, n AS occurrences FROM (
 SELECT doc_id, 'aws-access-key-id' AS kind, len(regexp_extract_all(text,'\b(?:AKIA|ASIA)[0-9A-Z]{16}\b')) AS n FROM pl
 UNION ALL SELECT doc_id, 'github-token', len(regexp_extract_all(text,'\bgh[pousr]_[A-Za-z0-9]{36,}')) FROM pl
 UNION ALL SELECT doc_id, 'anthropic-api-key', len(regexp_extract_all(text,'\bsk-ant-[A-Za-z0-9_-]{20,}')) FROM pl
 UNION ALL SELECT doc_id, 'openai-api-key', len(regexp_extract_all(text,'\bsk-proj-[A-Za-z0-9_-]{15,}')) FROM pl
 UNION ALL SELECT doc_id, 'environment-secret', len(list_filter(vals, lambda x: length(x)>=12 AND regexp_matches(x,'[A-Za-z]') AND regexp_matches(x,'[0-9]') AND NOT contains(x,'/')
    AND NOT regexp_matches(x,'(?i)your[_-]|example|changeme|placeholder|dummy|xxxx') AND len(list_distinct(string_split(x,'')))>=8)) FROM asg) WHERE n>0)
"""
)


def planted(spark, sf_dir):
    d = F.col("doc_id")
    ds = d.cast("string")
    extra = lambda n, *parts: F.when(d % n == 0, F.concat(*parts)).otherwise("")
    return bridge.read_spread(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(
            "text",
            extra(50, F.lit(" id AKIA"), F.upper(F.left(F.md5(ds), F.lit(16))), F.lit(" end")),
            extra(70, F.lit(" use ghp_"), F.left(F.sha2(ds, 256), F.lit(40)), F.lit(" ok")),
            extra(90, F.lit(" key sk-ant-api03-"), F.md5(ds)),
            extra(110, F.lit(" key sk-proj-"), F.md5(ds)),
        ).alias("text"),
    )


@query(
    "secret_scan",
    q(FOUND, "SELECT doc_id, kind, occurrences FROM fnd"),
)
def secret_scan(spark, sf_dir):
    found = exposure.kinds_found(planted(spark, sf_dir), "text")
    return found.select("doc_id", "f.kind", "f.occurrences")


@query(
    "redact_text",
    q(
        PLANTED,
        r"""SELECT doc_id, sha256(r) AS fp, len(regexp_extract_all(r,'\[REDACTED:[a-z-]+\]')) AS n FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  '\bsk-ant-[A-Za-z0-9_-]{20,}','[REDACTED:anthropic-api-key]','g'),'\bsk-proj-[A-Za-z0-9_-]{15,}','[REDACTED:openai-api-key]','g'),'\bgh[pousr]_[A-Za-z0-9]{36,}','[REDACTED:github-token]','g'),
  '\b(?:AKIA|ASIA)[0-9A-Z]{16}\b','[REDACTED:aws-access-key-id]','g'),
  '(?i)(\b[A-Za-z0-9_.-]*(?:password|passwd|secret|api[_-]?key|access[_-]?key|token)[A-Za-z0-9_]*\s*[=:]\s*\\?["'']?)([^\s"''\\,;(){}<>\[\]]{8,})','\1[REDACTED:environment-secret]','g') AS r FROM pl)""",
    ),
)
def redact_text(spark, sf_dir):
    out = planted(spark, sf_dir).select("doc_id", secrets.redact_text(F.col("text")).alias("r"))
    return out.select("doc_id", F.sha2("r.text", 256).alias("fp"), F.col("r.n").alias("n"))


@query(
    "redacted_records_are_clean",
    "SELECT CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS VARCHAR) AS problem FROM region WHERE FALSE",
)
def redacted_records_are_clean(spark, sf_dir):
    """Whole texts as JSON records, with and without unicode escapes: redaction leaves no match and valid JSON."""
    record = F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("text").alias("body"), F.lit("hunter2hunter2").alias("password")))
    escaped = F.when(F.col("doc_id") % 2 == 0, F.replace(record, F.lit("e"), F.lit("\\u0065"))).otherwise(record)
    # Member names must stay readable JSON either way, so both forms are parsed back.
    out = planted(spark, sf_dir).select("doc_id", secrets.redact_record(escaped).alias("r"))
    back = out.select("doc_id", F.from_json("r.text", "id bigint, body string, password string").alias("j"), F.col("r.n").alias("n"))
    problem = (
        F.when(F.col("j.body").isNull(), "not json")
        .when(F.size(secrets.scan(F.col("j.body"))) > 0, "still matches")
        .when(F.col("j.password") != "[REDACTED:environment-secret]", "member kept")
        .when(F.col("n") < 1, "not counted")
    )
    return back.select("doc_id", problem.alias("problem")).where(F.col("problem").isNotNull())


@lake.table
def exposed_records(spark, sf_dir):
    """Planted texts as messages of straight logs; every ninth record is a report, every seventh cannot be read again."""
    d = F.col("doc_id")
    block = F.struct(F.lit("input_text").alias("type"), F.col("text"))
    message = F.struct(F.lit("message").alias("type"), F.lit("user").alias("role"), F.array(block).alias("content"))
    said = F.to_json(F.struct(F.lit("response_item").alias("type"), message.alias("payload")))
    raw = F.when(d % 9 == 0, '{"type":"event_msg","payload":{"type":"token_count"}}').otherwise(said)
    lines = (
        planted(spark, sf_dir)
        .join(bridge.read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("session_id")), "doc_id")
        .select("session_id", (d + 1).alias("line_no"), raw.alias("raw"))
        .withColumn("byte_len", F.octet_length("raw").cast("bigint"))
        .withColumn("byte_offset", F.lit(None).cast("bigint"))
    )
    # The parser keeps narrow columns; the scan fetches records by their position.
    parsed = linear_agent.normalise(lines).drop("raw")
    found = lines.select("session_id", "line_no", F.when(F.col("line_no") % 7 != 1, F.col("raw")).alias("raw"))
    return parsed.join(found, ["session_id", "line_no"]).withColumn("turn", F.floor((F.col("line_no") - 1) / 9) + 1)


@query(
    "exposure_findings",
    q(
        FOUND,
        """SELECT lang AS session_id, d.doc_id+1 AS line_no, d.doc_id//9+1 AS turn, 'response_item/message' AS event_type, kind, occurrences
 FROM fnd JOIN documents d ON d.doc_id=fnd.doc_id WHERE d.doc_id%9<>0 AND d.doc_id%7<>0""",
    ),
)
def exposure_findings(spark, sf_dir):
    """Credentials in records that reach the model, at line starts and after escapes as well."""
    return exposure.findings(exposed_records(spark, sf_dir)).drop("agent", "severity")


@query(
    "exposure_counts",
    "SELECT lang AS session_id, count(*) FILTER (WHERE doc_id%7<>0) AS scanned_records, count(*) FILTER (WHERE doc_id%7=0) AS unreadable_records FROM documents WHERE doc_id%9<>0 GROUP BY 1",
)
def exposure_counts(spark, sf_dir):
    return exposure.scan_counts(exposed_records(spark, sf_dir)).drop("agent")


@query(
    "doctor_secrets",
    q(
        FOUND,
        """SELECT session_id, line_no, kind, occurrences FROM (SELECT lang AS session_id, d.doc_id+1 AS line_no, kind, occurrences, row_number() OVER (PARTITION BY lang ORDER BY d.doc_id, kind) AS rn
 FROM fnd JOIN documents d ON d.doc_id=fnd.doc_id WHERE d.doc_id%9<>0 AND d.doc_id%7<>0) WHERE rn<=12""",
    ),
)
def doctor_secrets(spark, sf_dir):
    """The panel's first twelve findings of every session."""
    first = exposure.first_findings(exposure.findings(exposed_records(spark, sf_dir)))
    return first.select("session_id", "line_no", "kind", "occurrences")


@query(
    "redacted_records",
    q(
        PLANTED,
        r"""SELECT doc_id, sha256(r) AS body_fp, '[REDACTED:environment-secret]' AS password, len(regexp_extract_all(r,'\[REDACTED:[a-z-]+\]')) - len(regexp_extract_all(text,'\[REDACTED:[a-z-]+\]')) + 1 AS n
 FROM (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  '\bsk-ant-[A-Za-z0-9_-]{20,}','[REDACTED:anthropic-api-key]','g'),'\bsk-proj-[A-Za-z0-9_-]{15,}','[REDACTED:openai-api-key]','g'),'\bgh[pousr]_[A-Za-z0-9]{36,}','[REDACTED:github-token]','g'),
  '\b(?:AKIA|ASIA)[0-9A-Z]{16}\b','[REDACTED:aws-access-key-id]','g'),
  '(?i)(\b[A-Za-z0-9_.-]*(?:password|passwd|secret|api[_-]?key|access[_-]?key|token)[A-Za-z0-9_]*\s*[=:]\s*\\?["'']?)([^\s"''\\,;(){}<>\[\]]{8,})','\1[REDACTED:environment-secret]','g') AS r
  FROM (SELECT doc_id, 'first line'||chr(10)||CASE WHEN doc_id%3=0 THEN 'AKIA'||upper(substr(md5(CAST(doc_id AS VARCHAR)),1,16))||chr(9) ELSE '' END||text AS text FROM pl))""",
    ),
)
def redacted_records(spark, sf_dir):
    """Redacted bodies and counts of whole records, with keys planted right after an escaped line end."""
    d = F.col("doc_id")
    key = F.when(d % 3 == 0, F.concat(F.lit("AKIA"), F.upper(F.left(F.md5(d.cast("string")), F.lit(16))), F.lit("\t"))).otherwise("")
    body = F.concat(F.lit("first line\n"), key, F.col("text"))
    record = F.to_json(F.struct(d.alias("id"), body.alias("body"), F.lit("hunter2hunter2").alias("password")))
    out = planted(spark, sf_dir).select("doc_id", secrets.redact_record(record).alias("r"))
    back = out.select("doc_id", F.from_json("r.text", "id bigint, body string, password string").alias("j"), F.col("r.n").alias("n"))
    return back.select("doc_id", F.sha2("j.body", 256).alias("body_fp"), "j.password", "n")
