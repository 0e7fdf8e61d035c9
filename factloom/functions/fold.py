"""Unicode case folding inside the JVM.

Spark's `lower` is not `casefold`: 'ß' stays. What folding does beyond lower
case is a rule of Unicode that Python knows, so the tables are derived from
`str.casefold` when first needed. Only texts that hold such characters take the
slow branch.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _extra() -> dict[str, str]:
    """Characters, in lower case, that folding still changes, and to what."""
    points = (chr(code) for code in range(0x80, 0x20000) if not 0xD800 <= code < 0xE000)
    return {c: c.casefold() for c in points if c.lower() == c and c.casefold() != c}


def casefold(col: Column | str) -> Column:
    """`str.casefold` of a string column; null for null."""
    col = F.col(col) if isinstance(col, str) else col
    low, extra = F.lower(col), _extra()
    # One map literal, looked up character by character, and only in texts that need it.
    table = F.map_from_arrays(F.split(F.lit("\n".join(extra)), "\n"), F.split(F.lit("\n".join(extra.values())), "\n"))
    folded = F.array_join(F.transform(F.split(low, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    return F.when(col.rlike(r"^[\x00-\x7f]*$"), low).when(low.rlike("[" + "".join(extra) + "]"), folded).otherwise(low)


def ascii_lower(col: Column | str) -> Column:
    """Lower case of A-Z only."""
    return F.translate(F.col(col) if isinstance(col, str) else col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
