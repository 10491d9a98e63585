"""From log files to turns: the tables written as logs, ingested, and their turns compared."""

from __future__ import annotations

import dataclasses
import os
import re
import uuid
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom import bridge
from tokenloom.catalog import lake
from tokenloom.catalog.ingest import GL, LL
from tokenloom.catalog.registry import query
from tokenloom.catalog.sql import q
from tokenloom.operators.turns import linear_context_sizes
from tokenloom.plans.ingest import LogTables, ingest
from tokenloom.session import ensure_checkpoint_dir
from tokenloom.sources.profile import profile

_INGESTED: dict[tuple[str, str, str], LogTables] = {}


#: What Spark escapes in the name of a partition's folder, and its name for no value.
_ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")
_NO_NAME = "__HIVE_DEFAULT_PARTITION__"


def _folder(session: str | None) -> str:
    return "session=" + (_ESCAPED.sub(lambda c: f"%{ord(c[0]):02X}", session) if session else _NO_NAME)


def _file_writer(root: str):
    """Writes rows sorted by session as one file each; a file has its name once it is whole, so a task may run again."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns)))
        files = 0
        for session, own in groupby(rows, itemgetter(0)):
            folder = os.path.join(root, _folder(session))
            os.makedirs(folder, exist_ok=True)
            part = os.path.join(folder, f".{uuid.uuid4().hex}")
            with open(part, "w", encoding="utf-8", newline="") as f:
                f.writelines(f"{value or ''}\n" for _, value in own)
            # No name and an empty one share a folder.
            os.replace(part, os.path.join(folder, "none.txt" if session is None else "log.txt"))
            files += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    return write


def write_logs(lines: DataFrame) -> str:
    """Write ``session_id, line_no, raw`` as one log file a session, as agents do, into the shared folder.

    In a mounted folder the tasks create the files themselves: Hadoop's local file system starts
    a process for the permissions of each file and of its checksum, and the driver renames every file once more.
    """
    root = f"{ensure_checkpoint_dir(lines.sparkSession)}/logs-{uuid.uuid4().hex}"
    ordered = (
        lines.select(F.col("session_id").alias("session"), "line_no", F.col("raw").alias("value"))
        .repartition("session")
        .sortWithinPartitions("session", "line_no")
        .select("session", "value")
    )
    place = urlsplit(root)
    if place.scheme in ("", "file"):
        local = unquote(place.path) if place.scheme else root
        os.makedirs(local, exist_ok=True)
        ordered.mapInArrow(_file_writer(local), "files bigint").agg(F.sum("files")).collect()
    else:
        ordered.write.partitionBy("session").text(root, lineSep="\n")
    return root


def _once(spark: SparkSession, sf_dir: str, name: str, build) -> LogTables:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _INGESTED:
        _INGESTED[key] = build()
    return _INGESTED[key]


def linear_tables(spark: SparkSession, sf_dir: str) -> LogTables:
    """Straight logs: every file opens with the record that names its session."""

    def build() -> LogTables:
        lines = bridge.linear_lines(spark, sf_dir).select("session_id", "line_no", "raw")
        name = F.concat(F.lit('{"type":"session_meta","payload":{"id":"'), F.col("session_id"), F.lit('"}}'))
        opening = lines.groupBy("session_id").agg(F.lit(0).cast("bigint").alias("line_no")).withColumn("raw", name)
        return ingest(spark, profile("codex"), write_logs(lines.unionByName(opening)), glob="*.txt")

    return _once(spark, sf_dir, "linear", build)


def graph_tables(spark: SparkSession, sf_dir: str) -> LogTables:
    """Graph logs: a session is named after its file, here after the file's folder."""
    agent = profile("claude-code")

    def in_folders(lines: DataFrame) -> DataFrame:
        named = agent.inventory(lines)
        return named.withColumn("session_id", F.regexp_extract("path", "session=([^/]+)", 1))

    def build() -> LogTables:
        root = write_logs(bridge.graph_lines(spark, sf_dir))
        return ingest(spark, dataclasses.replace(agent, inventory=in_folders), root, glob="*.txt")

    return _once(spark, sf_dir, "graph", build)


# Straight logs: line 1 names the session, so record number n of the table is at seq n.
LOG_TURNS = (
    LL
    + """,
ln AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS seq, w, k,
   CAST(date_trunc('milliseconds', ts) AS TIMESTAMP) AS ts,
   CASE w WHEN 'call' THEN length('{"command":["run","f0.py"],"pad":""}')+size
          WHEN 'result' THEN CASE WHEN k%5=0 THEN length('[{"type":"input_image","image_url":},{"type":"input_text","text":"t"}]')+length(CAST(k AS VARCHAR)) ELSE size END
          WHEN 'msg' THEN size+1+length(CAST(k AS VARCHAR)) WHEN 'think' THEN size+CASE WHEN k%2=0 THEN 10 ELSE 0 END
          WHEN 'tools' THEN length('[{"name":""}]')+size WHEN 'meta' THEN size END AS chars,
   CASE WHEN w='start' AND k%4<>0 THEN 'model-'||CAST(k%3 AS VARCHAR) END AS model,
   CASE WHEN w='usage' AND k%17<>0 THEN big END AS prompt, w='msg' AND k%5=1 AS asked,
   w IN ('think','call') OR (w='msg' AND k%5<>1) AS answers FROM ll),
lt AS (SELECT *, count(*) FILTER (WHERE w='usage') OVER (PARTITION BY session_id ORDER BY seq DESC) AS reports_left,
   count(*) FILTER (WHERE w='usage') OVER (PARTITION BY session_id) AS reports FROM ln),
le AS (SELECT *, reports-reports_left+1 AS turn FROM lt WHERE reports_left>0),
lr AS (SELECT session_id, turn, max(seq) AS reset FROM le WHERE w IN ('start','comp') OR asked GROUP BY ALL),
ls AS (SELECT e.session_id, e.turn, min(e.seq) AS opened FROM le e LEFT JOIN lr r ON r.session_id=e.session_id AND r.turn=e.turn
   WHERE e.answers AND e.seq>coalesce(r.reset,-1) GROUP BY ALL),
lu AS (SELECT e.session_id, e.turn, e.ts, e.seq AS anchor_seq, s.opened AS response_start_seq, coalesce(s.opened, e.seq) AS cutoff_seq, nullif(e.prompt,0) AS prompt_tokens,
   (SELECT max(b.seq) FROM ln b WHERE b.session_id=e.session_id AND b.w='start' AND b.seq<e.seq) AS start_seq
   FROM le e LEFT JOIN ls s ON s.session_id=e.session_id AND s.turn=e.turn WHERE e.w='usage'),
lc AS (SELECT u.*, (SELECT max(c.seq) FROM ln c WHERE c.session_id=u.session_id AND c.w='comp' AND c.seq<u.cutoff_seq) AS comp_seq FROM lu u),
lh AS (SELECT u.session_id, u.turn, count(i.seq) AS held, CAST(coalesce(sum(i.chars),0) AS BIGINT) AS chars FROM lc u LEFT JOIN ln i ON i.session_id=u.session_id AND i.seq<u.cutoff_seq
   AND i.chars IS NOT NULL AND (i.w='meta' OR i.seq>coalesce(u.comp_seq,-1)) GROUP BY ALL)
"""
)


@query(
    "e2e_linear_turns",
    q(
        LOG_TURNS,
        """SELECT u.session_id, u.turn, u.ts, b.model, u.prompt_tokens, u.anchor_seq, u.response_start_seq, u.comp_seq,
 n.records + CASE WHEN u.turn=1 THEN 1 ELSE 0 END AS event_count, h.held + CASE WHEN u.comp_seq IS NULL THEN 0 ELSE 1 END AS context_items, h.chars AS logged_chars
 FROM lc u LEFT JOIN ln b ON b.session_id=u.session_id AND b.seq=u.start_seq
 JOIN (SELECT session_id, turn, count(*) AS records FROM le GROUP BY ALL) n ON n.session_id=u.session_id AND n.turn=u.turn
 JOIN lh h ON h.session_id=u.session_id AND h.turn=u.turn""",
    ),
)
def e2e_linear_turns(spark, sf_dir):
    """Files, lines, records, numbering, inventory and turns of straight logs."""
    tables = linear_tables(spark, sf_dir)
    return linear_context_sizes(tables.events, tables.turns).select(
        "session_id", "turn", "ts", "model", "prompt_tokens", "anchor_seq", "response_start_seq", "comp_seq",
        "event_count", "context_items", (F.col("context_chars") - F.col("summary_chars")).alias("logged_chars"),
    )


@query(
    "e2e_linear_events",
    q(
        LOG_TURNS,
        """SELECT session_id, seq, seq+1 AS line_no, turn, w='comp' AS compaction FROM (SELECT n.session_id, n.seq, n.w, e.turn FROM ln n LEFT JOIN le e ON e.session_id=n.session_id AND e.seq=n.seq)
 UNION ALL SELECT session_id, 0, 1, CASE WHEN count(*) FILTER (WHERE w='usage')>0 THEN 1 END, FALSE FROM ln GROUP BY session_id""",
    ),
)
def e2e_linear_events(spark, sf_dir):
    """Line number and turn of every record read from the files."""
    return linear_tables(spark, sf_dir).events.select(
        "session_id", "seq", "line_no", "turn", (F.col("kind") == "compacted").alias("compaction")
    )


GRAPH_TURNS = (
    GL
    + """,
rq AS (SELECT session_id, t AS seq, v, t//4 AS req, CASE WHEN v%9<>0 THEN 'model-x' END AS model, TIMESTAMP '2026-01-01' + INTERVAL (CAST(t%9 AS INTEGER)) DAY AS ts,
   CASE WHEN v%6=0 THEN v%50+1+t*50 ELSE v%50+CASE WHEN t%3<>0 THEN v*3 ELSE 0 END+t*100 END AS prompt FROM gl WHERE asst AND NOT broken AND NOT future),
ro AS (SELECT *, req IS DISTINCT FROM lag(req) OVER (PARTITION BY session_id ORDER BY seq) AS opens FROM rq),
rn AS (SELECT *, count(*) FILTER (WHERE opens) OVER (PARTITION BY session_id ORDER BY seq) AS turn FROM ro),
gr AS (SELECT session_id, turn, min(seq) AS opened, max(seq) AS anchor_seq FROM rn GROUP BY ALL),
ge AS (SELECT g.session_id, g.t AS seq, (SELECT min(r.turn) FROM rn r WHERE r.session_id=g.session_id AND r.seq>=g.t) AS turn FROM gl g)
"""
)


@query(
    "e2e_graph_turns",
    q(
        GRAPH_TURNS,
        """SELECT g.session_id, g.turn, o.ts, o.model, nullif(o.prompt,0) AS prompt_tokens, g.anchor_seq, g.opened AS response_start_seq, n.records AS event_count
 FROM gr g JOIN rn o ON o.session_id=g.session_id AND o.seq=g.opened JOIN (SELECT session_id, turn, count(*) AS records FROM ge GROUP BY ALL) n ON n.session_id=g.session_id AND n.turn=g.turn""",
    ),
)
def e2e_graph_turns(spark, sf_dir):
    """The same for graph logs, with broken records and records of unknown types among them."""
    return graph_tables(spark, sf_dir).turns.select(
        "session_id", "turn", "ts", "model", "prompt_tokens", "anchor_seq", "response_start_seq", "event_count"
    )


@query(
    "e2e_corpus_totals",
    q(
        LOG_TURNS + "," + GRAPH_TURNS,
        """SELECT 'codex' AS agent, count(DISTINCT session_id) AS sessions, count(*) + count(DISTINCT session_id) AS records,
   (SELECT count(*) FROM lu) AS turns, (SELECT CAST(sum(prompt_tokens) AS BIGINT) FROM lu) AS prompt_tokens FROM ln
 UNION ALL SELECT 'claude-code', count(DISTINCT session_id), count(*), (SELECT count(*) FROM gr),
   (SELECT CAST(sum(o.prompt) AS BIGINT) FROM gr g JOIN rn o ON o.session_id=g.session_id AND o.seq=g.opened) FROM gl""",
    ),
)
def e2e_corpus_totals(spark, sf_dir):
    """Sessions, records, turns and prompt tokens of both kinds of logs."""
    out = None
    for tables in (linear_tables(spark, sf_dir), graph_tables(spark, sf_dir)):
        # Sessions, records and turns meet as three small sums, not as a join of the tables.
        counts = (
            tables.sessions.groupBy("agent").agg(F.count(F.lit(1)).alias("sessions"))
            .join(tables.events.groupBy("agent").agg(F.count(F.lit(1)).alias("records")), "agent")
            .join(
                tables.turns.groupBy("agent").agg(
                    F.count(F.lit(1)).alias("turns"), F.sum("prompt_tokens").alias("prompt_tokens")
                ),
                "agent",
            )
        )
        out = counts if out is None else out.unionByName(counts)
    return out
