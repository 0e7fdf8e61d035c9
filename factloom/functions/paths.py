"""Expressions over `path:line` texts, globs and lines."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN_SOURCE = "<unknown-source>"


def source_file(source: Column) -> Column:
    """The path of `path:line` when the line is a positive number, else the whole text; a stand-in for null or empty."""
    line = F.regexp_extract(source, r"^.+:([0-9]+)$", 1)
    return F.when(source.isNull() | (source == ""), UNKNOWN_SOURCE).when(line.rlike("[1-9]"), F.regexp_extract(source, r"^(.+):[0-9]+$", 1)).otherwise(source)


def source_bucket(source: Column) -> Column:
    """The path of `path:digits`, else what stands before the first colon."""
    return F.when(source.rlike(r"^.+:[0-9]+$"), F.regexp_extract(source, r"^(.+):[0-9]+$", 1)).otherwise(F.split_part(source, F.lit(":"), F.lit(1)))


def source_path(source: Column) -> Column:
    """The path of `path:number` (line 0 included), else the text."""
    return F.regexp_replace(source, r"^(.+):[0-9]+$", "$1")


def source_line(source: Column) -> Column:
    """The positive line of a relative `path:line`, else null."""
    line = F.regexp_extract(source, r"^[^/].*:([0-9]{1,9})$", 1)
    return F.when(line.rlike("[1-9]"), line.cast("int"))


def glob_regex(pattern: str) -> str:
    """A regular expression for an anchored glob: `**` spans segments, `*`, `?` and `[...]` stay in one."""
    out = []
    segments = pattern.split("/")
    for k, seg in enumerate(segments):
        last = k == len(segments) - 1
        if seg == "**":
            out.append(".*" if last else "(?:[^/]+/)*")
            continue
        text, i = "", 0
        while i < len(seg):
            c = seg[i]
            if c == "*":
                text += "[^/]*"
            elif c == "?":
                text += "[^/]"
            elif c == "[" and (end := seg.find("]", i + 2)) > 0:
                inner = seg[i + 1 : end]
                text += "[" + ("^" + inner[1:] if inner[0] == "!" else inner).replace("\\", "\\\\") + "]"
                i = end
            else:
                text += re.escape(c)
            i += 1
        out.append(text + ("" if last else "/"))
    return "^" + "".join(out) + "$"


def matches_any(path: Column, globs: list[str]) -> Column:
    """Whether a path matches one of the globs."""
    hit = F.lit(False)
    for g in globs:
        hit = hit | path.rlike(glob_regex(g))
    return hit


def truncated_text(col: Column, limit: int) -> Column:
    """At most `limit` characters, with a mark if cut; empty for limit 0."""
    if limit <= 0:
        return F.when(F.length(col) > 0, "").otherwise(col)
    return F.when(F.length(col) > limit, F.concat(F.substring(col, 1, limit), F.lit("...[TRUNCATED]"))).otherwise(col)


def line_at(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based character offset."""
    head = F.substring(text, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def snippet(text: Column, line: Column) -> Column:
    """A line, trimmed, at most 240 characters."""
    return F.substring(F.trim(F.try_element_at(F.split(text, "\n"), line)), 1, 240)


def window_of_lines(text: Column, line: Column, radius: int) -> Column:
    """struct(start_line, end_line, lines, truncated) around a line; null if the text has no such line."""
    lines = F.split(F.regexp_replace(text, r"\n\z", ""), "\n")
    n = F.size(lines)
    start, end = F.greatest(F.lit(1), line - radius), F.least(n, line + radius)
    return F.when(
        (line >= 1) & (line <= n),
        F.struct(start.alias("start_line"), end.alias("end_line"), F.slice(lines, start, end - start + 1).alias("lines"), ((start > 1) | (end < n)).alias("truncated")),
    )


def compacted(col: Column, chars: int = 512) -> Column:
    """A text on one line, at most `chars` characters, an ellipsis where cut; the column twin of `csource.compact_condition`."""
    flat = F.regexp_replace(F.regexp_replace(col, r"(?U)\s+", " "), r"^ | \z", "")
    return F.when(F.length(flat) <= chars, flat).otherwise(F.concat(F.regexp_replace(F.substring(flat, 1, chars - 3), r" \z", ""), F.lit("...")))
