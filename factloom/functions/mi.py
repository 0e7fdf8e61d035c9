"""Lines of a debugger's machine interface as records (kind, class, token, results, text)."""

from __future__ import annotations

import codecs
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The marks that begin a record.
STREAMS = {"~": "console", "@": "target", "&": "log"}
RECORDS = {"^": "result", "*": "exec", "+": "status", "=": "notify"}

_LINE = re.compile(r"(\d*)(.?)(.*)", re.S)
_TOKEN = re.compile(r'\s*(?:([\w.-]+)=|("(?:\\.|[^"\\])*")|([{}\[\],]))')


def unquoted(text: str) -> str:
    """The text of a C string literal; what is none stays."""
    text = text.strip()
    if len(text) < 2 or text[0] != '"' or text[-1] != '"':
        return text
    try:
        return codecs.decode(text[1:-1], "unicode_escape")
    except UnicodeDecodeError:
        return text[1:-1]


def quote(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def results(text: str) -> dict:
    """`name=value` lists, values being texts, `{…}` and `[…]`; a name given again collects a list. What follows a fault is left out."""
    top: dict = {}
    open_values, names, at = [top], [None], 0

    def add(value):
        held, name = open_values[-1], names[-1]
        if isinstance(held, list):
            held.append(value if name is None else {name: value})
        elif name is not None and name in held:
            held[name] = [*(held[name] if isinstance(held[name], Several) else [held[name]]), value]
            held[name] = Several(held[name])
        elif name is not None:
            held[name] = value
        names[-1] = None

    while at < len(text) and (m := _TOKEN.match(text, at)):
        at = m.end()
        name, string, mark = m.groups()
        if name is not None:
            names[-1] = name
        elif string is not None:
            add(unquoted(string))
        elif mark in "{[":
            value: dict | list = {} if mark == "{" else []
            add(value)
            open_values.append(value)
            names.append(None)
        elif mark in "}]" and len(open_values) > 1:
            open_values.pop()
            names.pop()
    return top


class Several(list):
    """Values of one name that was given more than once."""


def parse(line: str | None) -> dict | None:
    """One record; None for a prompt or an empty line."""
    line = (line or "").rstrip("\r\n")
    if not line or line == "(gdb)":
        return None
    digits, mark, body = _LINE.match(line).groups()
    out = {"token": int(digits) if digits else None, "kind": "console", "class": mark, "results": "{}", "text": None}
    if mark in STREAMS:
        return out | {"kind": STREAMS[mark], "class": "stream", "text": unquoted(body)}
    if mark in RECORDS:
        name, _, rest = body.partition(",")
        return out | {"kind": RECORDS[mark], "class": name, "results": json.dumps(results(rest), ensure_ascii=False, sort_keys=True, separators=(",", ":"))}
    return out | {"text": body if mark else None}


def records(line: Column) -> Column:
    """struct(token, kind, class, results, text) of lines; results is JSON."""

    @F.pandas_udf("token bigint, kind string, class string, results string, text string")
    def run(lines: pd.Series) -> pd.DataFrame:
        none = dict.fromkeys(("token", "kind", "class", "results", "text"))
        return pd.DataFrame([parse(x) or none for x in lines], columns=list(none)).astype({"token": "Int64"})

    return run(line)
