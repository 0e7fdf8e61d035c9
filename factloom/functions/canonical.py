"""Canonical JSON: one text for one JSON value."""

from __future__ import annotations

import json

import pandas as pd
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _plain(x):
    if isinstance(x, float) and x.is_integer() and abs(x) < 2**53:
        return int(x)
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, list):
        return [_plain(v) for v in x]
    return x


def canonical(text: str | None) -> str | None:
    """Sorted keys, no outer white space, no needless escapes, 1.0 as 1.

    Text that is no JSON stays itself, marked, and so differs from any value.
    """
    if text is None:
        return None
    try:
        return json.dumps(_plain(json.loads(text)), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except (ValueError, RecursionError):
        return "\x00" + text


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    return texts.map(canonical, na_action="ignore")


@F.pandas_udf(T.BinaryType())
def json_digest(texts: pd.Series) -> pd.Series:
    """128 bits of the canonical JSON; null for null."""
    return texts.map(lambda t: xxhash.xxh3_128_digest(canonical(t).encode("utf-8", "surrogatepass")), na_action="ignore")
