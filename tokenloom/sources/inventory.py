"""Session inventories: one descriptor row per log file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.text import GRAPH_AGENT_MARKERS, LINEAR_AGENT_MARKERS, authored_title
from tokenloom.schema import AGENT_GRAPH, AGENT_LINEAR, SESSION
from tokenloom.sources import variant as j
from tokenloom.sources.lines import with_positions

#: What the numbering of lines needs of a projection of the line table.
PLACE = ["path", "block", "rid", "framed_bytes"]

DESCRIPTOR = [
    *SESSION,
    "path",
    "size_bytes",
    "project",
    "title",
    "title_origin",
    "git_branch",
    "started_at",
    "last_activity",
    "thread_role",
    "parent_id",
]


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+?)(\.[^./\\]*)?$", 1)


def _unslug(slug: Column) -> Column:
    """Best-effort reading of a project folder name; for display only."""
    drive = F.regexp_extract(slug, r"^(.)--(.*)$", 1)
    rest = F.regexp_extract(slug, r"^(.)--(.*)$", 2)
    return F.when(
        F.length(drive) == 1, F.concat(F.upper(drive), F.lit(":\\"), F.replace(rest, F.lit("-"), F.lit("\\")))
    ).otherwise(F.replace(slug, F.lit("-"), F.lit("/")))


def _first(value: Column) -> Column:
    return F.min_by(value, F.when(value.isNotNull(), F.col("line_no")))


def graph_inventory(lines: DataFrame) -> DataFrame:
    """Descriptors of graph logs from :func:`tokenloom.sources.lines.read_lines`.

    Each field comes from the first line that has it, wherever that is, as long as
    it is not past both the line that completes identity, folder and time and the
    first title the agent gave.  A file without any ``uuid`` is no session.
    Records are parsed where they are read; only the narrow fields are numbered.
    """
    v = F.col("v")
    opened = lines.withColumn("v", F.try_parse_json("raw"))
    said = F.coalesce(
        j.plain_text(v, "$.message.content"),
        F.when(
            ~F.exists(j.items(v, "$.message.content"), lambda b: j.text(b, "$.type") == "tool_result"),
            F.array_join(
                F.transform(
                    F.filter(j.items(v, "$.message.content"), lambda b: j.text(b, "$.type") == "text"),
                    lambda b: j.text(b, "$.text"),
                ),
                "\n",
            ),
        ),
    )
    kind = j.text(v, "$.type")
    prompt = F.when(kind == "user", authored_title(said, GRAPH_AGENT_MARKERS))
    side = j.flag(v, "$.isSidechain")
    narrow = opened.select(
        *PLACE,
        "file_size",
        "modified",
        j.text(v, "$.cwd").alias("cwd"),
        j.timestamp(v).alias("ts"),
        j.text(v, "$.gitBranch").alias("branch"),
        F.when(kind == "ai-title", j.text(v, "$.aiTitle")).alias("ai_title"),
        F.when(~side, prompt).alias("prompt"),
        F.when(side, prompt).alias("side_prompt"),
        j.present(v, "$.uuid").alias("has_uuid"),
    )
    fields = with_positions(narrow)
    line = F.col("line_no")
    stops = fields.groupBy("path").agg(
        F.greatest(
            F.min(F.when(F.col("has_uuid"), line)),
            F.min(F.when(F.col("cwd").isNotNull(), line)),
            F.min(F.when(F.col("ts").isNotNull(), line)),
        ).alias("g"),
        F.count_if(F.col("has_uuid")).alias("uuids"),
        F.count("cwd").alias("cwds"),
        F.count("ts").alias("stamps"),
        F.min(F.when(F.col("ai_title").isNotNull(), line)).alias("titled_at"),
    ).withColumn(
        "identified_at", F.when((F.col("uuids") > 0) & (F.col("cwds") > 0) & (F.col("stamps") > 0), F.col("g"))
    )
    read = (
        fields.join(stops.select("path", "identified_at", "titled_at"), "path")
        .where(
            F.col("identified_at").isNull()
            | (line <= F.col("identified_at"))
            | F.col("titled_at").isNull()
            | (line <= F.col("titled_at"))
        )
    )
    described = read.groupBy("path").agg(
        F.max("file_size").alias("size_bytes"),
        F.max("modified").alias("last_activity"),
        _first(F.col("cwd")).alias("cwd"),
        _first(F.col("ts")).alias("started_at"),
        _first(F.col("branch")).alias("git_branch"),
        _first(F.col("ai_title")).alias("ai_title"),
        _first(F.col("prompt")).alias("prompt"),
        _first(F.col("side_prompt")).alias("side_prompt"),
        F.bool_or("has_uuid").alias("conversation"),
    ).where("conversation")
    folder = F.regexp_extract("path", r"([^/\\]+)[/\\][^/\\]+$", 1)
    nested = F.lower(folder) == "subagents"
    owner = F.regexp_extract("path", r"([^/\\]+)[/\\][^/\\]+[/\\][^/\\]+$", 1)
    slug = F.when(nested, F.regexp_extract("path", r"([^/\\]+)[/\\][^/\\]+[/\\][^/\\]+[/\\][^/\\]+$", 1)).otherwise(folder)
    child = nested & (F.length(F.trim(owner)) > 0)
    fallback = F.when(child, F.col("side_prompt")).otherwise(F.col("prompt"))
    return described.select(
        F.lit(AGENT_GRAPH).alias("agent"),
        _stem(F.col("path")).alias("session_id"),
        "path",
        "size_bytes",
        F.coalesce("cwd", F.when(F.length(slug) > 0, _unslug(slug))).alias("project"),
        F.coalesce("ai_title", fallback).alias("title"),
        F.when(F.col("ai_title").isNotNull(), "agent").when(fallback.isNotNull(), "first-prompt").alias("title_origin"),
        "git_branch",
        "started_at",
        "last_activity",
        F.when(child, "subagent").otherwise("root").alias("thread_role"),
        F.when(child, owner).alias("parent_id"),
    )


def linear_inventory(lines: DataFrame) -> DataFrame:
    """Descriptors of straight logs: identity from the first line, title from a prompt."""
    v = F.col("v")
    opened = lines.withColumn("v", F.try_parse_json("raw"))
    payload = lambda key: j.text(v, f"$.payload.{key}")
    spoken = F.array_join(
        F.flatten(
            F.transform(
                j.items(v, "$.payload.content"),
                lambda b: F.array_compact(F.array(*[j.text(b, f"$.{k}") for k in ("text", "input_text", "output_text")])),
            )
        ),
        "",
    )
    prompt = F.when(
        (j.text(v, "$.type") == "response_item") & (payload("type") == "message") & (payload("role") == "user"),
        authored_title(spoken, LINEAR_AGENT_MARKERS),
    )
    first = F.col("line_no") == 1
    meta = ["id", "session_id", "parent_thread_id", "thread_source", "cwd"]
    # Only the first record of a split can be the first line of its file.
    opens = F.col("block") == 0
    fields = with_positions(
        opened.select(
            *PLACE,
            "file_size",
            *[F.when(opens, payload(k)).alias(k) for k in meta],
            F.when(opens, j.timestamp(v)).alias("ts"),
            F.when(opens, j.text(v, "$.payload.git.branch")).alias("branch"),
            v.isNotNull().alias("parsed"),
            prompt.alias("prompt"),
        )
    )
    grouped = fields.groupBy("path").agg(
        F.max("file_size").alias("size_bytes"),
        *[F.max(F.when(first, F.col(k))).alias(f"m_{k}") for k in meta],
        F.max(F.when(first, F.col("ts"))).alias("started_at"),
        F.max(F.when(first, F.col("branch"))).alias("git_branch"),
        F.bool_or(first & F.col("parsed")).alias("readable"),
        F.min_by(F.when(~first, F.col("prompt")), F.when(~first & F.col("prompt").isNotNull(), F.col("line_no"))).alias("prompt"),
    )
    stem = _stem(F.col("path"))
    from_name = F.regexp_extract(stem, r"([^-]+(?:-[^-]+){4})$", 1)
    ident = F.coalesce("m_id", "m_session_id", F.when(F.length(from_name) == 36, from_name), stem)
    parent = F.coalesce("m_parent_thread_id", "m_session_id")
    child = F.coalesce(
        (F.col("m_thread_source") == "subagent") & parent.isNotNull() & ~parent.eqNullSafe(F.col("m_id")), F.lit(False)
    )
    return grouped.select(
        F.lit(AGENT_LINEAR).alias("agent"),
        ident.alias("session_id"),
        "path",
        "size_bytes",
        F.col("m_cwd").alias("project"),
        F.when(F.col("readable"), F.col("prompt")).alias("title"),
        F.when(F.col("readable") & F.col("prompt").isNotNull(), "first-prompt").alias("title_origin"),
        "git_branch",
        "started_at",
        F.col("started_at").alias("last_activity"),
        F.when(child, "subagent").otherwise("root").alias("thread_role"),
        F.when(child, parent).alias("parent_id"),
    )


def session_metadata(lines: DataFrame) -> DataFrame:
    """First known folder, branch, version and model, and the time span, per session.

    ``lines`` carry session, ``line_no`` and ``raw`` of either format.
    """
    v = F.col("v")
    opened = lines.withColumn("v", F.try_parse_json("raw"))
    model = j.text(v, "$.message.model")
    linear_meta = j.text(v, "$.type") == "session_meta"
    started = j.text(v, "$.type") == "turn_context"
    cols = {
        "cwd": F.coalesce(j.text(v, "$.cwd"), F.when(linear_meta | started, j.text(v, "$.payload.cwd"))),
        "git_branch": F.coalesce(j.text(v, "$.gitBranch"), F.when(linear_meta, j.text(v, "$.payload.git.branch"))),
        "agent_version": F.coalesce(j.text(v, "$.version"), F.when(linear_meta, j.text(v, "$.payload.cli_version"))),
        "model": F.coalesce(F.when(~model.startswith("<"), model), F.when(started, j.text(v, "$.payload.model"))),
        "started_at": j.timestamp(v),
    }
    stamped = F.when(j.timestamp(v).isNotNull(), F.col("line_no"))
    return opened.groupBy(*SESSION).agg(
        *[_first(c).alias(n) for n, c in cols.items()], F.max_by(j.timestamp(v), stamped).alias("last_activity")
    )


def with_archive(live: DataFrame, archived: DataFrame) -> DataFrame:
    """Archived sessions stand in only for logs that are gone."""
    gone = archived.join(live.select(*SESSION), SESSION, "left_anti")
    return live.withColumn("archived", F.lit(False)).unionByName(gone.withColumn("archived", F.lit(True)))


def inventory_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Sessions that are new, changed or deleted between two inventories.

    An agent missing from ``current`` altogether failed to be listed; its
    sessions are not deletions.
    """
    mark = F.struct("path", "size_bytes", "last_activity")
    old = previous.join(current.select("agent").distinct(), "agent", "left_semi").select(*SESSION, mark.alias("was"))
    new = current.select(*SESSION, mark.alias("now"))
    both = old.join(new, SESSION, "full_outer")
    return both.where(~F.col("was").eqNullSafe(F.col("now"))).select(
        *SESSION,
        F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").otherwise("changed").alias("change"),
    )
