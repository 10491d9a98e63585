"""Credential findings of records."""

import json

from tokenloom.operators import exposure

KEY = "AKIA" + "ABCDEFGH12345678"
TOKEN = "ghp_" + "a" * 36
SCHEMA = "agent string, session_id string, line_no bigint, turn bigint, raw_type string, kind string, raw string"


def _found(spark, raws):
    rows = [("codex", "s", i, 1, "response_item/message", "message", raw) for i, raw in enumerate(raws)]
    return exposure.findings(spark.createDataFrame(rows, SCHEMA))


def test_kinds_of_records(spark):
    raws = [json.dumps({"t": f"first\n{KEY}\n{KEY} and {TOKEN}"}), json.dumps({"t": "nothing"}), None, "", f"plain {TOKEN}"]
    got = sorted((r.line_no, r.kind, r.occurrences, r.severity) for r in _found(spark, raws).collect())
    assert got == [
        (0, "aws-access-key-id", 2, "critical"), (0, "github-token", 1, "critical"), (4, "github-token", 1, "critical")
    ]


def test_a_record_is_decoded_once(spark):
    plan = _found(spark, ["{}"])._jdf.queryExecution().optimizedPlan().toString()
    # The text's own expression names the pattern of strings three times.
    assert 1 <= plan.count(r"(\s*:)?") <= 3
