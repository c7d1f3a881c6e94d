"""Scalar text functions on Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "strip_offset", "parse_churn", "exclude", "clean_message", "clean_title",
    "unknown_author", "is_code_file", "described", "has_text", "highlight",
    "highlights", "format_description", "fmt2", "diff_key", "code_key",
    "score_key", "split_model", "rel_path", "path_parts", "resolve_rename",
    "NON_CODE_EXTENSIONS", "COLORS",
]


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def strip_offset(c) -> Column:
    """Remove a trailing ``+HH:MM`` / ``-HH:MM`` UTC offset."""
    return F.regexp_replace(_c(c), r"[+\-][0-9]{2}:[0-9]{2}$", "")


def parse_churn(c) -> Column:
    """``-`` or blank -> 0, else an integer; a bad number fails the job."""
    c = _c(c)
    return F.when(F.trim(c).isin("-", ""), F.lit(0).cast("bigint")).otherwise(
        F.trim(c).cast("bigint"))


def exclude(c, pattern: str | None) -> Column:
    """True when the value should be kept: case-insensitive regex search,
    an empty pattern excludes nothing (P4)."""
    if not pattern:
        return F.lit(True)
    return ~_c(c).rlike("(?i)" + pattern)


def clean_message(c) -> Column:
    """Newlines and ``--`` to spaces in commit messages (P5)."""
    return F.replace(F.regexp_replace(_c(c), "\n", " "), F.lit("--"), F.lit(" "))


def clean_title(c) -> Column:
    """Tabs and line ends to spaces in titles and counts (P5)."""
    return F.translate(_c(c), "\t\r\n", "   ")


def unknown_author(c) -> Column:
    """Missing or empty author -> 'Unknown' (P6)."""
    return F.coalesce(F.nullif(F.trim(_c(c)), F.lit("")), F.lit("Unknown"))


# File extensions that are not code (exact, case-sensitive;
# only the last extension of a path is compared, so the .env.* entries can
# never match -- kept as listed).
NON_CODE_EXTENSIONS = [
    ".md", ".lock", ".jpg", ".jpeg", ".png", ".gif", ".ico", ".yaml", ".yml",
    ".json", ".xml", ".scss", ".svg", ".ttf", ".ipynb", ".eslintcache",
    ".env.development", ".env.production", ".env.test", ".env.local",
    ".env.sample",
]


def is_code_file(c) -> Column:
    """Code-file predicate (P9), after ``os.path.splitext``: the extension is
    the last ``.xxx`` of the final path component unless that component
    starts with the dot (``.gitignore`` has no extension); the path without
    the extension must not start with ``.``."""
    c = _c(c)
    leaf = F.element_at(F.split(c, "/"), -1)
    # leading dots of the leaf never start an extension
    body = F.regexp_replace(leaf, r"^\.+", "")
    ext = F.when(body.contains("."), F.regexp_extract(body, r"(\.[^.]*)$", 1)).otherwise(F.lit(""))
    root = F.substring(c, F.lit(1), F.length(c) - F.length(ext))
    return (~ext.isin(*NON_CODE_EXTENSIONS)) & (~root.startswith("."))


def described(c="description") -> Column:
    """Row has a description (P10)."""
    return _c(c).isNotNull()


def has_text(c="description") -> Column:
    """Description present and not blank (P10, work selection)."""
    c = _c(c)
    return c.isNotNull() & (F.trim(c) != "")


def highlight(c, open_tag: str = "<span class=\"highlight\">", close_tag: str = "</span>") -> Column:
    """``||x||`` -> highlighted span, non-greedy, every match."""
    return F.regexp_replace(_c(c), r"\|\|(.+?)\|\|", open_tag + "$1" + close_tag)


def highlights(c) -> Column:
    """All ``||x||`` markers as an array of their inner text."""
    return F.regexp_extract_all(_c(c), F.lit(r"\|\|(.+?)\|\|"), 1)


def format_description(c) -> Column:
    """PR description for display: newline -> ``<BR>``, ``1. ``..``9. `` ->
    bullet entity (P12)."""
    c = F.replace(_c(c), F.lit("\n"), F.lit("<BR>"))
    return F.regexp_replace(c, r"[1-9]\. ", "&nbsp;&#8226;&nbsp;")


def fmt2(c) -> Column:
    """Two-decimal text of a number, rounded HALF_UP on its decimal value."""
    return F.round(_c(c).cast("decimal(38,6)"), 2).cast("decimal(38,2)").cast("string")


def diff_key(commit_hash, filename) -> Column:
    """sha256 of ``<sha>-<file>``: key of the diff cache."""
    return F.sha2(F.concat_ws("-", _c(commit_hash), _c(filename)), 256)


def code_key(code) -> Column:
    """md5 of the code text: key of a code description."""
    return F.md5(_c(code))


def score_key(code) -> Column:
    """md5 of ``score<TAB>code``: key of a readability score."""
    return F.md5(F.concat(F.lit("score\t"), _c(code)))


def split_model(c) -> tuple[Column, Column]:
    """``service|model`` -> (service, model)."""
    c = _c(c)
    return F.split_part(c, F.lit("|"), F.lit(1)), F.split_part(c, F.lit("|"), F.lit(2))


def rel_path(c, marker: str = "/_source/") -> Column:
    """Part after the copy-folder marker, whole path when absent."""
    c = _c(c)
    return F.when(F.instr(c, marker) > 0, F.substring_index(c, marker, -1)).otherwise(c)


def path_parts(c) -> tuple[Column, Column]:
    """(directories array, leaf) of a ``/`` path."""
    parts = F.split(_c(c), "/")
    return F.slice(parts, 1, F.size(parts) - 1), F.element_at(parts, -1)


def resolve_rename(c) -> Column:
    """The old path of git's rename notation (P19): ``dir/{old => new}/file``,
    either part of which may be empty, or the whole ``old => new``."""
    c = _c(c)
    part = F.regexp_replace(F.regexp_replace(c, "[{](.*?) => .*?[}]", "$1"), "/{2,}", "/")
    whole = F.substring_index(c, " => ", 1)
    return F.when(c.rlike("[{].* => .*[}]"), part).when(c.contains(" => "), whole).otherwise(c)


# Chart colours cycled by tree depth.
COLORS = ["#D98943", "#D9A78B", "#59696D", "#8CD0B6", "#465659", "#7CA2A6", "#172626"]
