"""Operations on JSON documents of any depth, as Arrow-batched UDFs."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.canonical import canonical

CUT = "...[TRUNCATED]"
TRUNCATED, REDACTED = "[TRUNCATED]", "[REDACTED]"
# Keys whose values are hidden.
SECRET_KEYS = [r"(?i)password", r"(?i)secret", r"(?i)token", r"(?i)api[_-]?key", r"(?i)authorization", r"(?i)cookie"]


def dumps(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def _loaded(text):
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return None


def bound(value, chars: int, items: int = 8) -> tuple[object, bool]:
    """Texts of at most `chars`, collections of at most `items` (objects by key); and whether anything was cut."""
    if isinstance(value, str):
        return (value[:chars] + CUT, True) if len(value) > chars else (value, False)
    if isinstance(value, list):
        kept = [bound(v, chars) for v in value[:items]]
        return [v for v, _ in kept], len(value) > items or any(c for _, c in kept)
    if isinstance(value, dict):
        kept = {str(k): bound(value[k], chars) for k in sorted(value)[:items]}
        return {k: v for k, (v, _) in kept.items()}, len(value) > items or any(c for _, c in kept.values())
    return value, False


def bounded_payload(payload: Column, fields: int = 8, chars: int = 128) -> Column:
    """struct(preview, truncated): the first `fields` keys in order, each bounded. Null for what is no object."""

    @F.pandas_udf(T.StructType([T.StructField("preview", T.StringType()), T.StructField("truncated", T.BooleanType())]))
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            v = _loaded(t)
            out, cut = bound(v, chars, fields) if isinstance(v, dict) else (None, None)
            rows.append((None if out is None else dumps(out), cut))
        return pd.DataFrame(rows, columns=["preview", "truncated"])

    return run(payload)


def redact(value, rules):
    if isinstance(value, dict):
        return {str(k): REDACTED if any(r.search(str(k)) for r in rules) else redact(v, rules) for k, v in value.items()}
    if isinstance(value, list):
        return [redact(v, rules) for v in value]
    return value


def shorten(value, string: int = 512, collection: int = 50, depth: int = 5, at: int = 0):
    """Bounds a document by depth, members and text length, leaving marks."""
    if isinstance(value, str):
        return value if len(value) <= string else value[:string] + "..." + TRUNCATED
    if not isinstance(value, (dict, list)):
        return value
    if at >= depth:
        return TRUNCATED
    over = len(value) > collection
    if isinstance(value, list):
        out = [shorten(v, string, collection, depth, at + 1) for v in value[:collection]]
        if over and out:
            out[-1] = TRUNCATED
        return out
    kept = {str(k): shorten(v, string, collection, depth, at + 1) for k, v in list(value.items())[: collection - over]}
    return kept | ({"_truncated": TRUNCATED} if over else {})


def redacted(payload: Column, patterns: list[str] | None = None) -> Column:
    """JSON with the values of secret keys hidden, at any depth; null for what is no JSON."""
    rules = [re.compile(p) for p in (SECRET_KEYS if patterns is None else patterns)]

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if (v := _loaded(t)) is None else dumps(redact(v, rules)))

    return run(payload)


def shortened(payload: Column, string: int = 512, collection: int = 50, depth: int = 5) -> Column:
    """JSON bounded by `shorten`; null for what is no JSON."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if (v := _loaded(t)) is None else json.dumps(shorten(v, string, collection, depth), ensure_ascii=False, separators=(",", ":")))

    return run(payload)


def is_subset(small, large) -> bool:
    """Whether every key of the small document is in the large one with the same value, recursively."""
    if isinstance(small, dict) and isinstance(large, dict):
        return all(k in large and is_subset(v, large[k]) for k, v in small.items())
    return type(small) is type(large) and small == large


def subset_of(left: Column, right: Column) -> Column:
    @F.pandas_udf(T.BooleanType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([is_subset(_loaded(x), _loaded(y)) for x, y in zip(a, b)])

    return run(left, right)


def counts_of(payload: Column, names: list[str]) -> Column:
    """Integer values of the named keys, as a map; empty for what is no object."""
    doc = F.try_parse_json(payload)
    at = lambda k: F.try_variant_get(doc, f"$['{k}']", "variant")
    entry = lambda k: F.when(F.schema_of_variant(at(k)) == "BIGINT", F.struct(F.lit(k).alias("key"), F.try_variant_get(doc, f"$['{k}']", "bigint").alias("value")))
    return F.map_from_entries(F.array_compact(F.array(*(entry(k) for k in dict.fromkeys(names)))))


def json_path(path: str) -> str:
    """`a.0.b` as `$.a[0].b`; parts must not be empty or hold `*`, `[` or `]`."""
    parts = path.split(".")
    if not path or any(not p or re.search(r"[*\[\]]", p) for p in parts):
        raise ValueError(f"not a path: {path!r}")
    return "$" + "".join(f"[{p}]" if p.isdecimal() else f".{p}" for p in parts)


__all__ = ["bounded_payload", "canonical", "counts_of", "json_path", "redacted", "shortened", "subset_of"]
