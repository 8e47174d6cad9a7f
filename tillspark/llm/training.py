"""Bounded samples of labelled documents for fitting, and the held-out split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEPS = 1_000_000


def in_fold(doc_id: Column, mod: int, fold: int) -> Column:
    """crc32 of the id as text, modulo ``mod``, is ``fold``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod == fold


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, fold: int, max_rows: int) -> DataFrame:
    """(doc_id, text, label) of at most ``max_rows`` labelled rows outside the held-out fold.

    Rows are chosen by a hash of their id, so the sample is the same on every run
    and at every partitioning. Ids labelled twice take the larger label; null
    labels do not take part.
    """
    known = (
        labels.select("doc_id", F.col(label).cast("double").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~in_fold(F.col("doc_id"), mod, fold))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    total = known.count()
    share = min(1.0, 0.9 * max_rows / max(1, total))
    ids = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(_STEPS)) < int(share * _STEPS)).limit(max_rows)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
