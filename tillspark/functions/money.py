"""Money, ratio and text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
# Aggregates get the widest precision: a sum over 100 TB of lines overflows 18 digits.
TOTAL = T.DecimalType(38, 2)


# Quantities keep fractions of a unit (weighed goods).
QUANTITY = T.DecimalType(18, 6)
# Fixed value: the decimal forms that ``Number()`` reads.
DECIMAL_NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(c: str | Column) -> Column:
    """Round half-up to cents as ``decimal(38,2)`` (for aggregates)."""
    return F.round(col(c), 2).cast(TOTAL)


def csum(c: str | Column) -> Column:
    """``COALESCE(SUM(c), 0)`` rounded to cents."""
    return total(F.coalesce(F.sum(col(c)), F.lit(0)))


def nsum(c: str | Column) -> Column:
    """``SUM(c)`` rounded to cents; NULL for an empty group."""
    return total(F.sum(col(c)))


def pct(num: str | Column, den: str | Column) -> Column:
    """``num / den * 100`` with 0 when ``den`` is 0 (S23); computed in double."""
    n, d = col(num).cast("double"), col(den).cast("double")
    return F.when(d != 0, n / d * 100.0).otherwise(F.lit(0.0))


def to_number(c: str | Column) -> Column:
    """JavaScript ``Number(x)`` on text: '' and NULL → 0; junk and what is not finite → NULL."""
    s = F.trim(col(c).cast("string"))
    x = F.when(s.rlike(DECIMAL_NUMBER), s.try_cast("double"))
    return F.when(s.isNull() | (s == ""), F.lit(0.0)).otherwise(F.when(F.abs(x) < F.lit(float("inf")), x))


def falsy_default(c: str | Column, default) -> Column:
    """JavaScript ``x || default`` for text: NULL and '' take the default (H1)."""
    return F.coalesce(F.nullif(col(c), F.lit("")), F.lit(default))


def js_round(c: str | Column) -> Column:
    """``Math.round``: halves go toward +infinity."""
    return F.floor(col(c).cast("double") + 0.5).cast("long")


def money_text(c: str | Column, currency: str | Column = "Rs") -> Column:
    """``'Rs 1,234'`` from an amount: rounded like ``Math.round`` and grouped by thousands."""
    cur = F.lit(currency) if isinstance(currency, str) else currency
    return F.concat_ws(" ", cur, F.format_number(js_round(c), 0))


def plural(n: str | Column, singular: str, plural_: str) -> Column:
    """Choice word by count."""
    return F.when(col(n) == 1, F.lit(singular)).otherwise(F.lit(plural_))
