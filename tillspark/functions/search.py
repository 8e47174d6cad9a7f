"""Search predicates (B3–B8, H3, H8; rule S13).

Server search is SQL ``LIKE '%q%'``: ASCII case-insensitive, and a ``%`` or
``_`` typed by the user still acts as a wildcard.  Spark's ``ilike`` has the
same wildcards but treats ``\\`` as its escape character, so a backslash in
the query is doubled first.  The point-of-sale grid instead does a literal,
lower-cased ``includes``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def like_pattern(q: str) -> str:
    return "%" + q.strip().replace("\\", "\\\\") + "%"


def like_any(cols: list[str | Column], q: str | None) -> Column:
    """``c1 ILIKE '%q%' OR c2 ILIKE …``; an empty query matches everything."""
    if q is None or not q.strip():
        return F.lit(True)
    pat = like_pattern(q)
    preds = [(F.col(c) if isinstance(c, str) else c).ilike(pat) for c in cols]
    # NULL columns do not match (LIKE on NULL is NULL → row not kept)
    return F.coalesce(reduce(lambda a, b: a | b, preds), F.lit(False))


def contains_any(cols: list[str | Column], q: str | None) -> Column:
    """Literal, case-folded substring test over several columns (POS grid, B8)."""
    if q is None or not q.strip():
        return F.lit(True)
    needle = F.lit(q.strip().lower())
    preds = [F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))).contains(needle) for c in cols]
    return reduce(lambda a, b: a | b, preds)
