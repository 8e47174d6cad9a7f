"""Reporting periods (B1, B2, H6).

A period is a pair of ISO dates ``(from, to)``, both inclusive as whole days.
It is applied half-open — ``date >= from AND date < to + 1 day`` — which keeps
the fractional last second that a text ``BETWEEN … 23:59:59`` drops (S1).
The bounds are constant-folded NTZ literals, so the comparison reaches the
Parquet scan as ``PushedFilters``.  Operators never read the wall clock (S2):
callers pass the period or an ``as_of`` date.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Period = tuple[str, str]


def _d(text: str) -> _dt.date:
    return _dt.date.fromisoformat(str(text)[:10])


def bounds(rng: Period) -> tuple[str, str]:
    """Half-open NTZ bounds of a period as text."""
    start, end = _d(rng[0]), _d(rng[1]) + _dt.timedelta(days=1)
    return f"{start.isoformat()} 00:00:00", f"{end.isoformat()} 00:00:00"


def ntz(text: str) -> Column:
    return F.lit(text).cast(T.TimestampNTZType())


def period_filter(rng: Period, col: str | Column = "date") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    lo, hi = bounds(rng)
    return (c >= ntz(lo)) & (c < ntz(hi))


def in_period(df: DataFrame, rng: Period, col: str = "date", month_col: str | None = "month") -> DataFrame:
    """Rows of ``df`` whose ``col`` falls in the period (B1).

    On a table written by ``sinks.append_facts`` (partitioned by ``month``)
    the matching month range is added too, so whole partitions are pruned.
    """
    out = df.filter(period_filter(rng, col))
    if month_col and month_col in df.columns:
        lo, hi = str(rng[0])[:7], str(rng[1])[:7]
        out = out.filter((F.col(month_col) >= lo) & (F.col(month_col) <= hi))
    return out


def preset_ranges(as_of: str) -> list[tuple[str, str, str]]:
    """The page's presets relative to ``as_of`` (B2): today, 7d, 30d, month, year."""
    d = _d(as_of)
    return [
        ("today", d.isoformat(), d.isoformat()),
        ("7d", (d - _dt.timedelta(days=6)).isoformat(), d.isoformat()),
        ("30d", (d - _dt.timedelta(days=29)).isoformat(), d.isoformat()),
        ("month", d.replace(day=1).isoformat(), d.isoformat()),
        ("year", d.replace(month=1, day=1).isoformat(), d.isoformat()),
    ]


def range_table(spark: SparkSession, ranges: list[tuple[str, str, str]]) -> DataFrame:
    """Small frame ``(preset, from_ts, to_ts)`` of half-open NTZ bounds for named periods."""
    rows = []
    for name, lo, hi in ranges:
        a, b = bounds((lo, hi))
        rows.append((name, _dt.datetime.fromisoformat(a), _dt.datetime.fromisoformat(b)))
    schema = T.StructType([
        T.StructField("preset", T.StringType(), False),
        T.StructField("from_ts", T.TimestampNTZType(), False),
        T.StructField("to_ts", T.TimestampNTZType(), False),
    ])
    return spark.createDataFrame(rows, schema)


def presets(spark: SparkSession, as_of: str) -> DataFrame:
    """Five-row frame ``(preset, from_ts, to_ts)`` of the page's presets (B2)."""
    return range_table(spark, preset_ranges(as_of))


def tag_ranges(df: DataFrame, spark: SparkSession, ranges: list[tuple[str, str, str]], col: str = "date") -> DataFrame:
    """Attach every named period a row falls in: one scan of ``df`` serves all periods.

    The period table is a handful of literal rows, so broadcasting it is
    always safe; the fact side is pre-filtered to the widest span so the scan prunes.
    """
    p = range_table(spark, ranges)
    lo = min(bounds((a, b))[0] for _, a, b in ranges)
    hi = max(bounds((a, b))[1] for _, a, b in ranges)
    facts = df.filter((F.col(col) >= ntz(lo)) & (F.col(col) < ntz(hi)))
    return facts.join(F.broadcast(p), (F.col(col) >= p.from_ts) & (F.col(col) < p.to_ts), "inner")


def tag_presets(df: DataFrame, spark: SparkSession, as_of: str, col: str = "date") -> DataFrame:
    """``tag_ranges`` over the five presets relative to ``as_of`` (B2)."""
    return tag_ranges(df, spark, preset_ranges(as_of), col)


def posted_at(date: str, as_of: str | None) -> Column:
    """A record's date, or where it has none the time of posting ``as_of`` (H5); without ``as_of`` it stays undated."""
    return F.coalesce(F.col(date), ntz(as_of if len(as_of) > 10 else f"{as_of} 00:00:00")) if as_of else F.col(date)
