"""Column expressions over labels, paths and short texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ELLIPSIS = "…"

# Argument names that say what a call acted on, best first.
TARGET_KEYS = [
    "file_path",
    "notebook_path",
    "path",
    "command",
    "pattern",
    "url",
    "query",
    "file",
    "description",
    "prompt",
]
FILE_KEYS = ["file_path", "notebook_path", "path", "file"]

# Openings of prompts that a harness wrote, not a person.
GRAPH_AGENT_MARKERS = [
    "<local-command-caveat>",
    "<local-command-stdout>",
    "<command-name>",
    "<command-message>",
    "<system-reminder>",
    "<user-prompt-submit-hook>",
]
LINEAR_AGENT_MARKERS = [
    "# AGENTS.md instructions for",
    "<user_instructions>",
    "<environment_context>",
    "<multi_agent_mode>",
    "<INSTRUCTIONS>",
    "<recommended_plugins>",
    "The following is the Codex agent history",
]

TARGET_CHARS = 160
PREVIEW_CHARS = 160
TITLE_CHARS = 120
TITLE_MIN_CHARS = 16


def truncate(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, an ellipsis marking the cut."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(ELLIPSIS))).otherwise(
        text
    )


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def authored_title(text: Column, markers: Sequence[str]) -> Column:
    """A session title from a prompt a person wrote; NULL for harness text and short prompts."""
    trimmed = strip(text)
    scaffold = F.lit(False)
    for marker in markers:
        scaffold = scaffold | trimmed.startswith(marker)
    line = collapse_whitespace(trimmed)
    return F.when(~scaffold & (F.length(line) >= TITLE_MIN_CHARS), truncate(line, TITLE_CHARS))


def target_label(args_json: Column) -> Column:
    """What a tool call acted on: the first telling argument as one short line."""
    candidates = []
    for key in TARGET_KEYS:
        raw = F.get_json_object(args_json, f"$.{key}")
        listed = F.from_json(raw, "array<string>")
        joined = F.when(
            raw.startswith("["), F.array_join(F.coalesce(listed, F.array().cast("array<string>")), " ")
        ).when(~raw.startswith("{") & ~raw.isin("true", "false"), raw)
        line = collapse_whitespace(joined)
        candidates.append(F.when(F.length(line) > 0, truncate(line, TARGET_CHARS)))
    return F.coalesce(*candidates)


def file_target(args_json: Column) -> Column:
    """The exact path argument of a call, when it is a plain file path."""
    path = F.coalesce(*[F.get_json_object(args_json, f"$.{k}") for k in FILE_KEYS])
    usable = (
        (F.length(path) > 0)
        & (F.octet_length(path) <= 32768)
        & ~path.rlike(r"\p{Cntrl}")
        & ~path.contains("://")
    )
    return F.when(usable, path)


def file_target_dir(args_json: Column, cwd: Column) -> Column:
    return F.coalesce(
        F.get_json_object(args_json, "$.workdir"), F.get_json_object(args_json, "$.cwd"), cwd
    )


def item_label(tool: Column, target: Column) -> Column:
    return F.when(target.isNotNull(), F.concat_ws(" ", tool, target)).otherwise(tool)


def leaf(path: Column) -> Column:
    """The last path segment, whichever way the slashes lean."""
    trimmed = F.regexp_replace(path, r"[\\/]+$", "")
    name = F.regexp_extract(trimmed, r"([^\\/]*)$", 1)
    return F.when(F.length(name) > 0, name).otherwise(path)


def short_label(label: Column) -> Column:
    return F.regexp_extract(label, r"([^\\/]*)$", 1)


def path_has_prefix(path: Column, prefix: str | None) -> Column:
    """Case- and separator-insensitive path prefix; an empty prefix matches all."""
    if not prefix:
        return F.lit(True)
    flat = prefix.replace("\\", "/").lower()
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/"))).startswith(flat)


def normalised_path(path: Column) -> Column:
    """Forward slashes, ``.`` and ``..`` resolved, lower case on a drive letter."""
    flat = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(flat, "/"), lambda p: p != ".")
    resolved = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(
            p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        ).otherwise(F.array_append(acc, p)),
    )
    joined = F.rtrim(F.array_join(resolved, "/"), F.lit("/"))
    return F.when(flat.rlike("^.:"), F.lower(joined)).otherwise(joined)


def is_temporary_path(path: Column, configured_root: str = "/tmp") -> Column:
    """Whether a working folder lies under a temporary root."""
    norm = normalised_path(path)
    inside = F.lit(False)
    for root in [configured_root, "/tmp", "/var/tmp", "/private/tmp", "/private/var/tmp"]:
        inside = inside | (norm == root) | norm.startswith(root + "/")
    drive = norm.rlike(r"^[a-zA-Z]:/(windows/temp|users/[^/]+/appdata/local/temp)(/|$)")
    return F.coalesce(inside | drive, F.lit(False))


def is_local_absolute(path: Column) -> Column:
    """A plain absolute path on a local disk."""
    return (
        (F.length(path) > 0)
        & ~path.rlike(r"\p{Cntrl}")
        & path.startswith("/")
        & ~path.startswith("//")
        & ~path.contains(":")
        & ~path.contains("\\")
    )


def comparable_path(path: Column, root: Column) -> Column:
    """Where a recorded instruction path may be read from; NULL when it is unsafe."""
    reserved = path.rlike(
        r"(?i)(^|[/\\])(con|prn|aux|nul|conin\$|conout\$|(com|lpt)[1-9¹²³]) *(\.[^/\\]*)?($|[/\\])"
    )
    dotted_end = path.rlike(r"[^/\\.][. ]+($|[/\\])|(^|[/\\]) +($|[/\\])")
    relative_ok = (
        (F.length(path) > 0)
        & ~path.contains(":")
        & ~path.rlike(r"^[/\\]")
        & ~path.rlike(r"\p{Cntrl}")
        & ~reserved
        & ~dotted_end
        & is_local_absolute(root)
    )
    joined = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"), path)
    return F.when(is_local_absolute(path), path).when(
        F.coalesce(relative_ok, F.lit(False)) & is_local_absolute(joined), joined
    )


def alert_key(rule: Column, agent: Column, session_id: Column, key: Column) -> Column:
    """Feed-wide identity of a finding; format findings are shared by all sessions of an agent."""
    own = F.concat(
        F.lit("v2:"), agent, F.lit(":"), F.octet_length(session_id).cast("string"), F.lit(":"), session_id, F.lit(":")
    )
    prefix = F.when(rule == "format_drift", F.concat(F.lit("v2:"), agent, F.lit(":global:"))).otherwise(own)
    return F.when(key.startswith(prefix), key).otherwise(F.concat(prefix, key))
