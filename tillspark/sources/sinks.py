"""Sinks: append posted documents in committed batches, write result documents.

Facts are written under ``batch_id``, an attempt of the batch, and the month of
their date, so a period query prunes whole months (``in_period`` also filters
``month``).  A batch counts once its attempt is recorded in the commit log beside
the data; the latest recorded attempt of a batch replaces what earlier ones wrote,
also where it has fewer months or rows, and the files of an attempt that stopped
half-way are never read.
"""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "_commits"  # hidden from readers of the data by its first character
_ID = re.compile(r"[A-Za-z0-9_.-]+")
_COMMIT = "batch_id string, attempt string, at long"


def with_month(df: DataFrame, date_col: str = "date") -> DataFrame:
    return df.withColumn("month", F.date_format(F.col(date_col), "yyyy-MM"))


def _path(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), folder


def exists(spark: SparkSession, path: str) -> bool:
    fs, folder = _path(spark, path)
    return fs.exists(folder)


def remove(spark: SparkSession, path: str) -> None:
    fs, folder = _path(spark, path)
    fs.delete(folder, True)


def commits(spark: SparkSession, path: str) -> DataFrame:
    """The attempt that counts of every batch: one row a batch, nothing where no batch was committed."""
    if not exists(spark, f"{path}/{LOG}"):
        return spark.createDataFrame([], _COMMIT)
    log = spark.read.schema(_COMMIT).json(f"{path}/{LOG}")
    return log.groupBy("batch_id").agg(F.max_by(F.struct("attempt", "at"), "at").alias("c")).select("batch_id", "c.*")


def commit(spark: SparkSession, path: str, batch_id: str, attempt: str) -> None:
    """Record that an attempt is complete: one small file, added by one task and renamed into place."""
    row = spark.createDataFrame([(batch_id, attempt, time.time_ns())], _COMMIT)
    row.coalesce(1).write.mode("append").json(f"{path}/{LOG}")


def committed(df: DataFrame, path: str) -> DataFrame:
    """Rows of ``df``, read from ``path``, that a counting attempt wrote; the join prunes the folders of others."""
    return df.join(commits(df.sparkSession, path).select("batch_id", "attempt"), ["batch_id", "attempt"], "left_semi")


def append_facts(df: DataFrame, path: str, batch_id: str, date_col: str = "date") -> None:
    """Append one batch to a Parquet table partitioned by batch and month (A5).

    ``batch_id`` names the batch: writing the same one again replaces what it wrote, other batches stay.
    Rows without a date go to the partition of unknown months.  Read the table with ``schemas.read_table``.
    """
    if not batch_id or not _ID.fullmatch(str(batch_id)):
        raise ValueError("append_facts needs the batch's id: letters, digits, '_', '.' or '-'")
    spark, batch_id, attempt = df.sparkSession, str(batch_id), uuid.uuid4().hex
    before = [r.attempt for r in commits(spark, path).filter(F.col("batch_id") == batch_id).collect()]  # one row at most
    out = with_month(df, date_col).withColumn("batch_id", F.lit(batch_id)).withColumn("attempt", F.lit(attempt))
    out.write.partitionBy("batch_id", "attempt", "month").mode("append").parquet(path)
    commit(spark, path, batch_id, attempt)
    for old in before:
        remove(spark, f"{path}/batch_id={batch_id}/attempt={old}")


def write_json(df: DataFrame, path: str) -> None:
    """Write result documents as newline-delimited JSON."""
    df.write.mode("overwrite").json(path)
