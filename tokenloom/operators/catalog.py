"""Finding sessions: filters, pages, families, projects, full-text search."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.text import is_temporary_path, leaf
from tokenloom.functions.secrets import redact_line
from tokenloom.schema import SESSION

PAGE_DEFAULT = 200
HITS_DEFAULT = 50


def session_filter(
    agent: str | None = None, project: str | None = None, since: dt.date | None = None
) -> Column:
    """Agent, project substring and activity date; unknown activity passes the date."""
    keep = F.lit(True)
    if agent is not None:
        keep = keep & (F.col("agent") == agent)
    if project is not None:
        keep = keep & F.lower(F.coalesce("project", F.lit(""))).contains(project.lower())
    if since is not None:
        keep = keep & (F.col("last_activity").isNull() | (F.to_date("last_activity") >= F.lit(since)))
    return keep


def recent_sessions(sessions: DataFrame, limit: int = 40) -> DataFrame:
    return sessions.orderBy(F.col("last_activity").desc_nulls_last(), *SESSION).limit(limit)


def matches_query(needle: str) -> Column:
    """Case-insensitive needle in id, project, path, title, branch or agent."""
    found = F.lit(False)
    for c in ("session_id", "project", "path", "title", "git_branch", "agent"):
        found = found | F.coalesce(F.lower(F.col(c)).contains(needle.strip().lower()), F.lit(False))
    return found


def in_project(scope: str | None = None, include_subagents: bool = False) -> Column:
    """``scope``: None for all, ``unrecorded``, ``temporary`` or ``path:<exact path>``."""
    keep = F.lit(True) if include_subagents else F.col("thread_role") == "root"
    if scope is None:
        return keep
    if scope == "unrecorded":
        return keep & F.col("project").isNull()
    if scope == "temporary":
        return keep & is_temporary_path(F.col("project"))
    if scope.startswith("path:"):
        return keep & (F.col("project") == scope[5:])
    raise ValueError(f"unknown project scope '{scope}'")


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    total: int
    offset: int
    has_more: bool


def page(sessions: DataFrame, offset: int = 0, limit: int = PAGE_DEFAULT) -> Page:
    """One page of a catalog, newest first."""
    total = sessions.count()
    offset = min(offset, total)
    limit = max(1, limit)
    ordered = sessions.orderBy(F.col("last_activity").desc_nulls_last(), *SESSION)
    return Page(ordered.offset(offset).limit(limit), total, offset, offset + limit < total)


class SessionNotFound(LookupError):
    pass


class AmbiguousSession(LookupError):
    def __init__(self, needle: str, matches: list[str], more: bool):
        super().__init__(f"'{needle}' matches {', '.join(matches)}{' and more' if more else ''}")
        self.matches = matches


def resolve_session(sessions: DataFrame, needle: str) -> DataFrame:
    """The session an id or id prefix means; exact ids win over prefixes."""
    exact = sessions.where(F.col("session_id") == needle)
    hits = [r.session_id for r in exact.select("session_id").limit(2).collect()]
    if len(hits) == 1:
        return exact
    if not hits:
        prefix = needle.strip().lower()
        exact = sessions.where(F.lower("session_id").startswith(prefix))
        hits = [r.session_id for r in exact.select("session_id").orderBy("session_id").limit(6).collect()]
    if not hits:
        raise SessionNotFound(needle)
    if len(hits) > 1:
        raise AmbiguousSession(needle, hits[:5], len(hits) > 5)
    return exact


def families(sessions: DataFrame) -> DataFrame:
    """Root threads with their branches, one row per member in branch order.

    A family exists as soon as a branch names its root, even when the root's own
    log is missing.  Members stay rows, so a family may be of any size.
    """
    roots = sessions.where(F.col("thread_role") == "root").select(
        "agent", F.col("session_id").alias("root_id"), "session_id", F.lit("root").alias("member"), "started_at"
    )
    branches = sessions.where(F.col("thread_role") == "subagent").select(
        "agent", F.col("parent_id").alias("root_id"), "session_id", F.lit("branch").alias("member"), "started_at"
    )
    known = roots.select("agent", "root_id").distinct().withColumn("root_known", F.lit(True))
    return (
        roots.unionByName(branches)
        .join(known, ["agent", "root_id"], "left")
        .withColumn("root_known", F.coalesce("root_known", F.lit(False)))
    )


def family_sizes(sessions: DataFrame) -> DataFrame:
    members = families(sessions)
    return members.groupBy("agent", "root_id").agg(
        F.bool_or("root_known").alias("root_known"),
        F.count_if(F.col("member") == "branch").alias("branches"),
        F.min_by(
            "session_id",
            F.when(F.col("member") == "branch", F.struct(F.coalesce("started_at", F.lit("0001-01-01").cast("timestamp")), "session_id")),
        ).alias("first_branch"),
    )


def resume_target(sessions: DataFrame) -> DataFrame:
    """Where to resume each session: a subagent is resumed through its parent thread."""
    return sessions.select(
        *SESSION,
        F.when(F.col("thread_role") == "subagent", F.col("parent_id")).otherwise(F.col("session_id")).alias("resume_id"),
    )


def project_list(sessions: DataFrame) -> DataFrame:
    """Sessions per working folder, with display name and temporary flag."""
    return sessions.groupBy("project").agg(F.count(F.lit(1)).alias("sessions")).select(
        "project",
        F.coalesce(leaf(F.col("project")), F.lit("No recorded folder")).alias("label"),
        is_temporary_path(F.col("project")).alias("temporary"),
        "sessions",
    )


def search_lines(lines: DataFrame, needle: str) -> DataFrame:
    """Every raw line that contains the needle, ignoring case.

    ``lines``: session, ``line_no``, ``raw``.  All hits are returned;
    :func:`first_hits` takes a page of them.
    """
    return lines.where(F.lower("raw").contains(needle.strip().lower()))


def first_hits(hits: DataFrame, turns_by_line: DataFrame, redact=redact_line, limit: int = HITS_DEFAULT) -> DataFrame:
    """A page of hits with turn and redacted preview."""
    taken = hits.orderBy(*SESSION, "line_no").limit(max(1, limit))
    preview = redact(F.trim("raw"))
    return taken.join(turns_by_line, [*SESSION, "line_no"], "left").select(
        *SESSION,
        "line_no",
        "turn",
        F.when(F.length(preview) > 180, F.concat(F.left(preview, F.lit(180)), F.lit("…"))).otherwise(preview).alias("preview"),
    )
