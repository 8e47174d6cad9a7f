"""Ordered scans that stay parallel when one key is hot.

A running total over ``Window.partitionBy(key).orderBy(t)`` puts every row
of a key into one task; with no key at all (the cash drawer) the whole table
lands in one task.  Each scan here runs in phases instead:

1. the keyed rows are written to the shared folder, range-partitioned by their
   full order (key, then row order) and written again, each with the number of
   its range as its block; the first copy is deleted.  The splitters come from Spark's sample of the rows, so
   a block holds about as many rows as any other, whatever the dates, ids or
   amounts look like, and a key takes as many blocks as its rows need;
2. each ``(key, block)`` is summarised, and the summaries of a key, one a
   block, are scanned to get each block's carry-in;
3. the carry-in goes in front of its block as a row of its own, and each
   ``(key, block)`` is scanned.

Results are identical to the single window.  Rows that are equal in the whole
order share a block.  Rows with a NULL key or date form keys like any other, so
none is lost.  Blocks are as many as shuffle partitions, less what adaptive
execution merges of small ones; ``blocks`` fixes their number.  The rows' source
plan runs once: the sample and the later phases read the written rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import dropped, written

_BLK, _ROW = "_blk", "_row"


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def in_blocks(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], blocks: int | None = None) -> DataFrame:
    """The rows in ranges of the full order, written, with the number of their range in ``_blk``."""
    given = hasattr(df, "_stage_path")  # rows that are a written table already are not written again
    keys, source = _cols([*by, *order]), df if given else written(df, "source")
    ranged = source.repartitionByRange(blocks, *keys) if blocks else source.repartitionByRange(*keys)
    out = written(ranged.withColumn(_BLK, F.spark_partition_id()), "scan")
    if not given:
        dropped(source)
    return out


def _with_carry(base: DataFrame, carry: DataFrame) -> DataFrame:
    """The rows with each block's carry-in as its first row (``_row`` = 0)."""
    first = carry.withColumn(_ROW, F.lit(0))
    return base.withColumn(_ROW, F.lit(1)).unionByName(first, allowMissingColumns=True)


def _in_block(by: Sequence[str], order: Sequence, last: int) -> Window:
    return Window.partitionBy(*by, _BLK).orderBy(_ROW, *_cols(order)).rowsBetween(Window.unboundedPreceding, last)


def _blocks_before(by: Sequence[str]) -> Window:
    return Window.partitionBy(*by).orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)


def running_sums(
    df: DataFrame,
    values: Mapping[str, Column],
    by: Sequence[str],
    order: Sequence[str | Column],
    inclusive: bool = True,
    blocks: int | None = None,
    per_key: DataFrame | None = None,
) -> DataFrame:
    """Add one running sum per ``by`` in ``order`` for each of ``values`` (name of the sum: what is summed).

    ``inclusive=False`` gives the sum of the rows strictly before (0 for the first).  ``per_key`` is left-joined by
    ``by``, which may not be NULL then: it meets the block summaries, and the rows where they are scanned.
    """
    by = list(by)
    base = in_blocks(df, by, order, blocks)
    totals = base.groupBy(*by, _BLK).agg(*[F.sum(c).alias(f"_v_{k}") for k, c in values.items()])
    before = _blocks_before(by)
    carry = totals.select(*by, _BLK, *[F.coalesce(F.sum(f"_v_{k}").over(before), F.lit(0)).alias(f"_v_{k}") for k in values])
    here = _in_block(by, order, 0 if inclusive else -1)
    # the carry-in is a column of its own, NULL elsewhere: what is summed is not moved twice
    scanned = _with_carry(base, carry).select("*", *[
        F.coalesce(F.sum(F.when(F.col(_ROW) == 0, F.col(f"_v_{k}")).otherwise(c)).over(here), F.lit(0)).alias(f"_s_{k}")
        for k, c in values.items()])
    kept = [c for c in df.columns if c not in values]
    scanned = scanned.filter(F.col(_ROW) == 1)
    if per_key is not None:
        kept += [c for c in per_key.columns if c not in by]
        scanned = scanned.join(base.select(*by, _BLK).distinct().join(per_key, by, "left"), [*by, _BLK])
    return scanned.select(*kept, *[F.col(f"_s_{k}").alias(k) for k in values])


def running_sum(
    df: DataFrame,
    value: str | Column,
    by: Sequence[str],
    order: Sequence[str | Column],
    out: str,
    inclusive: bool = True,
    blocks: int | None = None,
    per_key: DataFrame | None = None,
) -> DataFrame:
    """``running_sums`` of one value."""
    return running_sums(df, {out: F.col(value) if isinstance(value, str) else value}, by, order, inclusive, blocks, per_key)


def running_max(
    df: DataFrame,
    value: str | Column,
    by: Sequence[str],
    order: Sequence[str | Column],
    out: str,
    inclusive: bool = True,
    blocks: int | None = None,
) -> DataFrame:
    """Add ``out`` = greatest ``value`` at or before each row, per ``by``; ``inclusive=False``: strictly before (NULL for the first)."""
    by = list(by)
    base = in_blocks(df.withColumn("_v", F.col(value) if isinstance(value, str) else value), by, order, blocks)
    carry = base.groupBy(*by, _BLK).agg(F.max("_v").alias("_bm"))
    carry = carry.select(*by, _BLK, F.max("_bm").over(_blocks_before(by)).alias("_v"))
    scanned = _with_carry(base, carry).withColumn(out, F.max("_v").over(_in_block(by, order, 0 if inclusive else -1)))
    return scanned.filter(F.col(_ROW) == 1).drop(_BLK, _ROW, "_v")


def sums_and_min(
    df: DataFrame,
    value: str | Column,
    by: Sequence[str],
    order: Sequence[str | Column],
    sum_out: str,
    min_out: str,
    min_before_out: str | None = None,
    sums: Mapping[str, Column] | None = None,
    blocks: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Add ``sum_out`` = inclusive running sum S and ``min_out`` = min(S_j, j ≤ current).

    ``min_before_out`` (optional) = min(S_j, j < current), NULL on a key's first row; ``sums`` are further
    running sums of the same scan.  Also returns one row per key: ``sum_out``, ``min_out`` and ``sums`` over
    all its rows, taken from the block summaries.
    """
    val = F.col(value) if isinstance(value, str) else value
    by, extra = list(by), dict(sums or {})
    held = {"_v": val, **{f"_x_{k}": c for k, c in extra.items()}}
    base = in_blocks(df.withColumns(held), by, order, blocks)
    local = base.withColumn("_s", F.sum("_v").over(
        Window.partitionBy(*by, _BLK).orderBy(*_cols(order)).rowsBetween(Window.unboundedPreceding, 0)))
    per_block = local.groupBy(*by, _BLK).agg(F.min("_s").alias("_bm"), *[F.sum(c).alias(c) for c in held])
    before = _blocks_before(by)
    offset = F.coalesce(F.sum("_v").over(before), F.lit(0))
    per_block = written(per_block.withColumn("_low", offset + F.col("_bm")), "blocks")
    carry = per_block.select(
        *by, _BLK, F.min("_low").over(before).alias("_pm"),
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in held])
    rows = _with_carry(base, carry)
    here, earlier = _in_block(by, order, 0), _in_block(by, order, -1)
    rows = rows.withColumn(sum_out, F.sum("_v").over(here)).withColumns(
        {k: F.coalesce(F.sum(f"_x_{k}").over(here), F.lit(0)) for k in extra})
    rows = rows.withColumn("_m", F.when(F.col(_ROW) == 0, F.col("_pm")).otherwise(F.col(sum_out)))
    rows = rows.withColumn(min_out, F.min("_m").over(here))
    if min_before_out:
        rows = rows.withColumn(min_before_out, F.min("_m").over(earlier))
    summary = per_block.groupBy(*by).agg(
        F.sum("_v").alias(sum_out), F.min("_low").alias(min_out), *[F.sum(f"_x_{k}").alias(k) for k in extra])
    return rows.filter(F.col(_ROW) == 1).drop(_BLK, _ROW, "_m", "_pm", *held), summary


def running_sum_and_min(*args, **options) -> DataFrame:
    """The rows of ``sums_and_min`` alone."""
    return sums_and_min(*args, **options)[0]


def carry_forward(
    df: DataFrame,
    value: str | Sequence[str],
    by: Sequence[str],
    order: Sequence[str | Column],
    out: str | Sequence[str],
    inclusive: bool = True,
    blocks: int | None = None,
) -> DataFrame:
    """Add ``out`` = last non-null ``value`` at or before each row, per ``by`` (as-of fill); ``inclusive=False``: strictly before.

    Several columns can be filled at once (lists for ``value`` and ``out``);
    they share the block summaries and one in-block window.
    """
    values = [value] if isinstance(value, str) else list(value)
    outs = [out] if isinstance(out, str) else list(out)
    by = list(by)
    base, ordered = in_blocks(df, by, order, blocks), F.struct(*_cols(order))
    # last non-null value of each column in each block (rows with a NULL value do not compete)
    lasts = base.groupBy(*by, _BLK).agg(*[
        F.max_by(F.col(v), F.when(F.col(v).isNotNull(), ordered)).alias(f"_bl{i}") for i, v in enumerate(values)
    ])
    before = _blocks_before(by)
    carry = lasts.select(*by, _BLK, *[
        F.last(f"_bl{i}", ignorenulls=True).over(before).alias(f"_cin{i}") for i in range(len(values))])
    rows = _with_carry(base, carry)
    here = _in_block(by, order, 0 if inclusive else -1)
    rows = rows.withColumns({
        o: F.last(F.coalesce(F.col(v), F.col(f"_cin{i}")), ignorenulls=True).over(here)
        for i, (v, o) in enumerate(zip(values, outs))})
    return rows.filter(F.col(_ROW) == 1).drop(_BLK, _ROW, *[f"_cin{i}" for i in range(len(values))])
