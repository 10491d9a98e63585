"""Log files, inventories and finding sessions."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from tokenloom import bridge
from tokenloom.catalog import lake
from tokenloom.catalog.registry import query
from tokenloom.catalog.sql import q
from tokenloom.operators import catalog as cat
from tokenloom.schema import SESSION
from tokenloom.session import ensure_checkpoint_dir
from tokenloom.sources import inventory, lines
from tokenloom.sources.growing import SCHEMA, GrowingLines

FILES = """
f0 AS (SELECT CAST(user_id%40 AS VARCHAR)||'-'||CAST(event_id//65536 AS VARCHAR) AS file, event_id AS n, CAST(props->>'$.k' AS BIGINT) AS k,
   strlen('{"type":"x","n":'||CAST(event_id AS VARCHAR)||',"s":"é"}') AS len FROM events),
f1 AS (SELECT *, CASE WHEN k%10=0 THEN 0 ELSE len END AS byte_len, CASE WHEN k%10=0 THEN 1 WHEN k%7=0 THEN len+2 ELSE len+1 END AS framed FROM f0),
f2 AS (SELECT file, n, row_number() OVER w AS line_no, CAST(sum(framed) OVER w AS BIGINT)-framed AS byte_offset, byte_len FROM f1 WINDOW w AS (PARTITION BY file ORDER BY n))
"""


_FOLDERS: dict[tuple[str, str], str] = {}


def log_folder(spark, sf_dir) -> str:
    """The lines written as files into the shared folder, once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _FOLDERS:
        return _FOLDERS[key]
    root = f"{ensure_checkpoint_dir(spark)}/logs-{uuid.uuid4().hex}"
    (
        bridge.line_files(spark, sf_dir)
        .repartition("file")
        .sortWithinPartitions("file", "n")
        .select("file", "line")
        .write.partitionBy("file")
        .text(root, lineSep="\n")
    )
    _FOLDERS[key] = root
    return root


@lake.table
def scanned_files(spark, sf_dir):
    return lines.raw_lines(spark, log_folder(spark, sf_dir), glob="*.txt")


@query("scan_log_files", q(FILES, "SELECT file, line_no, byte_offset, byte_len, n FROM f2 WHERE byte_len>0"))
def scan_log_files(spark, sf_dir):
    return scanned_files(spark, sf_dir).select(
        F.regexp_extract("path", "file=([^/]+)", 1).alias("file"),
        "line_no",
        "byte_offset",
        "byte_len",
        F.get_json_object("raw", "$.n").cast("bigint").alias("n"),
    )


@query("tail_growing_files", q(FILES, "SELECT file, byte_offset, byte_len, n FROM f2 WHERE byte_len>0"))
def tail_growing_files(spark, sf_dir):
    """One poll of the stream over growing files, in ranges of 64 KiB that cut lines anywhere."""
    spark.dataSource.register(GrowingLines)
    out = f"{ensure_checkpoint_dir(spark)}/tail-{uuid.uuid4().hex}"
    polled = (
        spark.readStream.format("growing_lines")
        .option("path", log_folder(spark, sf_dir))
        .option("suffix", ".txt")
        .option("rangeBytes", 1 << 16)
        .load()
    )
    poll = polled.writeStream.option("checkpointLocation", f"{out}-state").trigger(availableNow=True)
    poll = poll.start(out, format="parquet")
    poll.awaitTermination()
    if poll.exception() is not None:
        raise poll.exception()
    return spark.read.schema(SCHEMA).parquet(out).select(
        F.regexp_extract("path", "file=([^/]+)", 1).alias("file"),
        "byte_offset",
        "byte_len",
        F.get_json_object("raw", "$.n").cast("bigint").alias("n"),
    )


@query("recover_record_by_position", q(FILES, "SELECT file, line_no, n FROM f2 WHERE byte_len>0 AND line_no%9=0"))
def recover_record_by_position(spark, sf_dir):
    table = scanned_files(spark, sf_dir)
    wanted = table.where(F.col("line_no") % 9 == 0).select("path", "line_no")
    found = lines.recover_records(wanted, table)
    return found.select(
        F.regexp_extract("path", "file=([^/]+)", 1).alias("file"),
        "line_no",
        F.get_json_object("raw", "$.n").cast("bigint").alias("n"),
    )


PLANTED = """
rec AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn+1 AS line_no, left(regexp_replace(text,'[^A-Za-z ]','','g'),40) AS t, conv_id*100+turn AS n FROM conversations),
planted AS (SELECT *, CASE n%3 WHEN 0 THEN chr(92)||'n' WHEN 1 THEN chr(92)||'t' ELSE chr(92)||'"' END AS esc FROM rec)
"""


@query(
    "records_hide_keys_behind_escapes",
    q(
        PLANTED,
        """SELECT session_id, line_no, '{"t":"'||t||esc||'[REDACTED:aws-access-key-id]'||esc||'","n":'||n||'}' AS raw FROM planted
UNION ALL SELECT session_id, line_no, 'hit '||CASE WHEN length(h)>176 THEN left(h,176)||'…' ELSE h END FROM (
 SELECT session_id, line_no, '{"t":"'||t||esc||'[REDACTED:aws-access-key-id]'||esc||'","n":'||n||'}' AS h FROM planted WHERE n%5=0)""",
    ),
)
def records_hide_keys_behind_escapes(spark, sf_dir):
    """Keys planted behind line ends, tabs and quotes of JSON records, recovered and searched."""
    conv = bridge.read(spark, sf_dir, "conversations")
    n = F.col("conv_id") * 100 + F.col("turn")
    esc = F.concat(F.lit("\\"), F.when(n % 3 == 0, "n").when(n % 3 == 1, "t").otherwise('"'))
    key = F.concat(F.lit("AKIA"), F.lpad(n.cast("string"), 16, "0"))
    text = F.left(F.regexp_replace("text", "[^A-Za-z ]", ""), F.lit(40))
    raw = F.concat(F.lit('{"t":"'), text, esc, key, esc, F.lit('","n":'), n.cast("string"), F.lit("}"))
    table = conv.select(
        F.lit("codex").alias("agent"), F.col("conv_id").cast("string").alias("session_id"), F.col("conv_id").cast("string").alias("path"),
        (F.col("turn") + 1).alias("line_no"), F.col("turn"), n.alias("n"), raw.alias("raw"),
    )
    records = lines.recover_records(table.select("session_id", "path", "line_no"), table).select("session_id", "line_no", "raw")
    searched = table.where("n % 5 = 0")
    hits = cat.search_lines(searched.select("agent", "session_id", "line_no", "raw"), "akia")
    found = cat.first_hits(hits, table.select("agent", "session_id", "line_no", "turn"), limit=1 << 30)
    return records.unionByName(
        found.select("session_id", "line_no", F.concat(F.lit("hit "), F.col("preview")).alias("raw"))
    )


@query(
    "oversized_and_malformed",
    """SELECT doc_id, CASE WHEN length(text)=0 THEN NULL WHEN doc_id%3=0 THEN 'note' WHEN doc_id%3=1 THEN 'deep' END AS sniffed, doc_id%5<>0 AS parsed FROM documents""",
)
def oversized_and_malformed(spark, sf_dir):
    """The outer type of a record from its head, and whether the whole record parses."""
    d = F.col("doc_id")
    body = F.to_json(F.struct(F.col("text").alias("t")))
    raw = (
        F.when(d % 3 == 0, F.concat(F.lit('{"a":1,"type":"note","p":'), body, F.lit("}")))
        .when(d % 3 == 1, F.concat(F.lit('{"q":{"type":"inner","w":[1,{"type":"x"}]},"s":"\\"type\\":\\"no\\"","type":"deep","p":'), body, F.lit("}")))
        .otherwise(F.concat(F.lit('{"q":{"type":"inner"},"p":'), body, F.lit("}")))
    )
    raw = F.when(d % 5 == 0, F.left(raw, F.length(raw) - 1)).otherwise(raw)
    return bridge.read_spread(spark, sf_dir, "documents").select(
        "doc_id", lines.sniffed_type(raw).alias("sniffed"), lines.parsed(raw).isNotNull().alias("parsed")
    )


GINV = """
g0 AS (SELECT *, conv_id%10=0 AND turn%3=2 AS broken, conv_id%10=5 AND turn%3=2 AS future FROM conversations),
g1 AS (SELECT conv_id, turn, CASE WHEN role='user' AND turn%4<>2 AND NOT broken AND NOT future THEN regexp_replace(trim(text, E' \\n\\t\\r'), '\\s+', ' ', 'g') END AS prompt, conv_id%7=3 AS side, NOT broken AND NOT future AS ok FROM g0)
"""


@query(
    "inventory_graph",
    q(
        GINV,
        """SELECT 'c'||CAST(conv_id AS VARCHAR) AS session_id, '/work/demo' AS project, 'main' AS git_branch,
 (SELECT CASE WHEN length(p.prompt)>120 THEN left(p.prompt,120)||'…' ELSE p.prompt END FROM g1 p WHERE p.conv_id=g.conv_id AND length(p.prompt)>=16 AND p.side=(g.conv_id%4=3) ORDER BY p.turn LIMIT 1) AS title,
 CASE WHEN conv_id%4=3 THEN 'subagent' ELSE 'root' END AS thread_role, CASE WHEN conv_id%4=3 THEN 'c'||CAST(conv_id-1 AS VARCHAR) END AS parent_id
 FROM g1 g GROUP BY conv_id HAVING bool_or(ok)""",
    ),
)
def inventory_graph(spark, sf_dir):
    return inventory.graph_inventory(bridge.graph_files(spark, sf_dir)).select(
        "session_id", "project", "git_branch", "title", "thread_role", "parent_id"
    )


@query(
    "inventory_linear",
    """
WITH h AS (SELECT *, c_custkey AS k, CASE WHEN c_custkey%4=3 THEN 'short'||CAST(c_custkey AS VARCHAR) ELSE 'aaaaaaaa-bbbb-cccc-dddd-'||lpad(CAST(c_custkey AS VARCHAR),12,'0') END AS stem,
  CASE WHEN c_custkey%4=0 THEN 'id'||CAST(c_custkey AS VARCHAR) END AS id, CASE WHEN c_custkey%4=1 THEN 'sid'||CAST(c_custkey AS VARCHAR) END AS sid,
  CASE WHEN c_custkey%6=0 THEN 'id'||CAST(c_custkey//8 AS VARCHAR) END AS par FROM customer),
p AS (SELECT *, coalesce(par,sid) AS parent, regexp_replace(trim('Then please '||repeat('look again ',CAST(k%20 AS INTEGER))||c_mktsegment),'\\s+',' ','g') AS third FROM h)
SELECT coalesce(id,sid,stem) AS session_id, '/work/n'||CAST(c_nationkey AS VARCHAR) AS project, 'b'||CAST(k%5 AS VARCHAR) AS git_branch,
 CASE WHEN k%3=2 THEN 'First real prompt of '||c_name WHEN length(third)>120 THEN left(third,120)||'…' WHEN length(third)>=16 THEN third END AS title,
 CASE WHEN k%3=0 AND parent IS NOT NULL AND parent IS DISTINCT FROM id THEN 'subagent' ELSE 'root' END AS thread_role,
 CASE WHEN k%3=0 AND parent IS NOT NULL AND parent IS DISTINCT FROM id THEN parent END AS parent_id FROM p
""",
)
def inventory_linear(spark, sf_dir):
    return inventory.linear_inventory(bridge.linear_headers(spark, sf_dir)).select(
        "session_id", "project", "git_branch", "title", "thread_role", "parent_id"
    )


@query(
    "session_metadata",
    """
WITH g0 AS (SELECT *, (conv_id%10=0 OR conv_id%10=5) AND turn%3=2 AS bad FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS session_id, max(CASE WHEN NOT bad THEN '/work/demo' END) AS cwd, max(CASE WHEN NOT bad THEN 'main' END) AS git_branch, max(CASE WHEN NOT bad THEN '2.1.0' END) AS agent_version,
 max(CASE WHEN NOT bad AND role='assistant' AND conv_id%9<>0 THEN 'model-x' END) AS model, TIMESTAMP '2026-01-01' + INTERVAL (CAST(arg_min(turn%9, turn) FILTER (WHERE NOT bad) AS INTEGER)) DAY AS started_at,
 TIMESTAMP '2026-01-01' + INTERVAL (CAST(arg_max(turn%9, turn) FILTER (WHERE NOT bad) AS INTEGER)) DAY AS last_activity FROM g0 GROUP BY 1
""",
)
def session_metadata(spark, sf_dir):
    located = bridge.graph_lines(spark, sf_dir).withColumn("agent", F.lit("claude-code"))
    return inventory.session_metadata(located).drop("agent")


# --- the customer inventory --------------------------------------------------

INV = """
inv AS (SELECT c_custkey AS k, CASE WHEN c_custkey%2=0 THEN 'claude-code' ELSE 'codex' END AS agent, 'S'||CAST(c_custkey AS VARCHAR) AS session_id, '/logs/'||CAST(c_custkey AS VARCHAR)||'.jsonl' AS path,
  CAST(floor(c_acctbal) AS BIGINT) AS size_bytes, CASE WHEN c_custkey%9=0 THEN NULL WHEN c_custkey%10=1 THEN '/tmp/run'||CAST(c_custkey%3 AS VARCHAR) WHEN c_custkey%10=2 THEN 'C:\\Users\\Ann\\AppData\\Local\\Temp\\w'||CAST(c_custkey%3 AS VARCHAR)
   WHEN c_custkey%10=3 THEN '/home/x/../../var/tmp/z/./'||CAST(c_custkey%2 AS VARCHAR) ELSE '/work/nation'||CAST(c_nationkey AS VARCHAR)||'/' END AS project,
  c_custkey%10 IN (1,2,3) AND c_custkey%9<>0 AS temp, CASE WHEN c_custkey%7<>0 THEN 'About '||c_mktsegment END AS title, 'b'||CAST(c_custkey%4 AS VARCHAR) AS git_branch,
  CASE WHEN c_custkey%6<>0 THEN TIMESTAMP '2026-01-01' + INTERVAL (CAST(c_custkey*7 AS INTEGER)) HOUR END AS started_at,
  CASE WHEN c_custkey%11<>0 THEN TIMESTAMP '2026-01-01' + INTERVAL (CAST(c_custkey*13%2000 AS INTEGER)) HOUR END AS last_activity,
  c_custkey%5=0 AND c_custkey>0 AS child, CASE WHEN c_custkey%5=0 AND c_custkey>0 THEN 'S'||CAST(CASE WHEN c_custkey%3=0 THEN 99999999 ELSE c_custkey//20*2+c_custkey%2 END AS VARCHAR) END AS parent_id FROM customer)
"""


@lake.table
def customer_inventory(spark, sf_dir):
    return bridge.customer_sessions(spark, sf_dir)


@query(
    "session_filter",
    q(INV, "SELECT session_id FROM inv WHERE agent='codex' AND lower(coalesce(project,'')) LIKE '%nation1%' AND (last_activity IS NULL OR CAST(last_activity AS DATE)>=DATE '2026-02-01')"),
)
def session_filter(spark, sf_dir):
    keep = cat.session_filter("codex", "NATION1", dt.date(2026, 2, 1))
    return customer_inventory(spark, sf_dir).where(keep).select("session_id")


@query("recent_sessions", q(INV, "SELECT agent, session_id, last_activity FROM inv ORDER BY last_activity DESC NULLS LAST, agent, session_id LIMIT 40"))
def recent_sessions(spark, sf_dir):
    return cat.recent_sessions(customer_inventory(spark, sf_dir)).select("agent", "session_id", "last_activity")


@query(
    "session_search",
    q(INV, "SELECT session_id FROM inv WHERE lower(session_id) LIKE '%build%' OR lower(project) LIKE '%build%' OR lower(path) LIKE '%build%' OR lower(title) LIKE '%build%' OR lower(git_branch) LIKE '%build%' OR lower(agent) LIKE '%build%'"),
)
def session_search(spark, sf_dir):
    return customer_inventory(spark, sf_dir).where(cat.matches_query(" BUILD ")).select("session_id")


@query(
    "session_page",
    q(INV, "SELECT session_id, CAST((SELECT count(*) FROM inv WHERE NOT child) AS BIGINT) AS total FROM inv WHERE NOT child ORDER BY last_activity DESC NULLS LAST, agent, session_id LIMIT 25 OFFSET 50"),
)
def session_page(spark, sf_dir):
    part = cat.page(customer_inventory(spark, sf_dir).where(cat.in_project()), 50, 25)
    return part.rows.select("session_id").withColumn("total", F.lit(part.total).cast("bigint"))


@query(
    "project_scopes",
    q(
        INV,
        """SELECT scope, count(*) AS sessions FROM (SELECT 'unrecorded' AS scope FROM inv WHERE NOT child AND project IS NULL UNION ALL SELECT 'temporary' FROM inv WHERE temp
 UNION ALL SELECT 'path' FROM inv WHERE NOT child AND project='/work/nation3/') GROUP BY 1""",
    ),
)
def project_scopes(spark, sf_dir):
    inv = customer_inventory(spark, sf_dir)
    scope = (
        inv.select(
            F.explode(
                F.array_compact(
                    F.array(
                        F.when(cat.in_project("unrecorded"), "unrecorded"),
                        F.when(cat.in_project("temporary", include_subagents=True), "temporary"),
                        F.when(cat.in_project("path:/work/nation3/"), "path"),
                    )
                )
            ).alias("scope")
        )
    )
    return scope.groupBy("scope").agg(F.count(F.lit(1)).alias("sessions"))


@query(
    "project_list",
    q(INV, "SELECT project, coalesce(regexp_extract(rtrim(project,'/'),'([^/\\\\]*)$',1),'No recorded folder') AS label, bool_or(temp) AS temporary, count(*) AS sessions FROM inv GROUP BY project"),
)
def project_list(spark, sf_dir):
    return cat.project_list(customer_inventory(spark, sf_dir))


FAM = INV + """,
mem AS (SELECT agent, session_id AS root_id, session_id, 'root' AS member, started_at FROM inv WHERE NOT child UNION ALL SELECT agent, parent_id, session_id, 'branch', started_at FROM inv WHERE child)
"""


@query(
    "session_families",
    q(FAM, "SELECT m.agent, m.root_id, m.session_id, m.member, EXISTS(SELECT 1 FROM inv r WHERE NOT r.child AND r.agent=m.agent AND r.session_id=m.root_id) AS root_known FROM mem m"),
)
def session_families(spark, sf_dir):
    return cat.families(customer_inventory(spark, sf_dir)).drop("started_at")


@query(
    "family_sizes",
    q(
        FAM,
        """SELECT m.agent, m.root_id, bool_or(EXISTS(SELECT 1 FROM inv r WHERE NOT r.child AND r.agent=m.agent AND r.session_id=m.root_id)) AS root_known, count(*) FILTER (WHERE member='branch') AS branches,
 arg_min(session_id, coalesce(started_at, TIMESTAMP '0001-01-01')::VARCHAR||session_id) FILTER (WHERE member='branch') AS first_branch FROM mem m GROUP BY 1,2""",
    ),
)
def family_sizes(spark, sf_dir):
    return cat.family_sizes(customer_inventory(spark, sf_dir))


@query("resume_targets", q(INV, "SELECT agent, session_id, CASE WHEN child THEN parent_id ELSE session_id END AS resume_id FROM inv"))
def resume_targets(spark, sf_dir):
    return cat.resume_target(customer_inventory(spark, sf_dir))


@query("resolve_session_prefix", q(INV, "SELECT session_id FROM inv WHERE session_id='S12'"))
def resolve_session_prefix(spark, sf_dir):
    return cat.resolve_session(customer_inventory(spark, sf_dir), "S12").select("session_id")


@query(
    "catalog_with_archive",
    q(INV, "SELECT agent, session_id, FALSE AS archived FROM inv WHERE k%4<>0 UNION ALL SELECT agent, session_id, TRUE FROM inv WHERE k%4=0 AND k%2=0"),
)
def catalog_with_archive(spark, sf_dir):
    """Three quarters of the sessions are live, the even ones are archived."""
    inv = customer_inventory(spark, sf_dir)
    k = F.substring("session_id", 2, 12).cast("bigint")
    return inventory.with_archive(inv.where(k % 4 != 0), inv.where(k % 2 == 0)).select(*SESSION, "archived")


@query(
    "inventory_changes",
    q(
        INV,
        """SELECT agent, session_id, CASE WHEN k%8=0 THEN 'deleted' WHEN k%8=2 THEN 'new' ELSE 'changed' END AS change FROM inv WHERE agent='claude-code' AND k%8 IN (0,2,4)""",
    ),
)
def inventory_changes(spark, sf_dir):
    """One agent's listing failed this time: none of its sessions counts as deleted."""
    inv = customer_inventory(spark, sf_dir)
    k = F.substring("session_id", 2, 12).cast("bigint")
    now = inv.where((F.col("agent") == "claude-code") & (k % 8 != 0)).withColumn(
        "size_bytes", F.col("size_bytes") + F.when(k % 8 == 4, 1).otherwise(0)
    )
    return inventory.inventory_changes(inv.where(k % 8 != 2), now)


@query(
    "union_of_agent_catalogs",
    q(INV, "SELECT agent, count(*) AS sessions FROM inv GROUP BY 1"),
)
def union_of_agent_catalogs(spark, sf_dir):
    inv = customer_inventory(spark, sf_dir)
    both = inv.where("agent = 'codex'").unionByName(inv.where("agent = 'claude-code'"))
    return both.groupBy("agent").agg(F.count(F.lit(1)).alias("sessions"))


@query(
    "search_lines",
    "SELECT CAST(conv_id AS VARCHAR) AS session_id, turn+1 AS line_no FROM conversations WHERE lower(text) LIKE '%there%'",
)
def search_lines(spark, sf_dir):
    located = bridge.read(spark, sf_dir, "conversations").select(
        F.lit("codex").alias("agent"), F.col("conv_id").cast("string").alias("session_id"), (F.col("turn") + 1).alias("line_no"), F.col("text").alias("raw")
    )
    return cat.search_lines(located, "THERE").select("session_id", "line_no")


@query(
    "search_first_hits",
    """SELECT session_id, line_no, turn, CASE WHEN length(t)>180 THEN left(t,180)||'…' ELSE t END AS preview FROM (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn+1 AS line_no, turn//2+1 AS turn, trim(text) AS t
 FROM conversations WHERE lower(text) LIKE '%the%' ORDER BY 1,2 LIMIT 50)""",
)
def search_first_hits(spark, sf_dir):
    table = bridge.read(spark, sf_dir, "conversations").select(
        F.lit("codex").alias("agent"), F.col("conv_id").cast("string").alias("session_id"), (F.col("turn") + 1).alias("line_no"),
        F.floor(F.col("turn") / 2 + 1).cast("bigint").alias("turn"), F.col("text").alias("raw"),
    )
    hits = cat.search_lines(table.drop("turn"), "the")
    return cat.first_hits(hits, table.drop("raw")).drop("agent")
