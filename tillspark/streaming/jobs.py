"""Structured Streaming jobs for the figures a shop watches live.

The reference re-queries everything on each page view; these keep the
"today" takings, low-stock warnings and cash position up to date instead.

* I1 ``daily_takings`` — event-time tumbling day windows per tender, with a
  watermark (late rows beyond it are dropped) and de-duplication of resent
  invoices within the watermark; append mode emits a day once it is closed.
* I2 ``write_alerts`` — each micro-batch of stock movements is scanned from the
  stock that the epoch before left; a row is written only where a product
  crosses its reorder level (either way).
* I3 ``cash_position`` — running totals per cash component in complete mode,
  delivered through ``foreachBatch``, each epoch whole to its own folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import TOTAL
from ..operators.prefix import running_sum
from ..sources import sinks


def daily_takings(sales_stream: DataFrame, watermark: str = "2 days") -> DataFrame:
    """Per-day, per-tender revenue and order count from a stream of sales rows.

    ``date`` is cast to ``timestamp`` first: a watermark on ``timestamp_ntz``
    is rejected by Spark.
    """
    zone = sales_stream.sparkSession.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"day windows are cut in UTC; the session's time zone is {zone}")
    s = sales_stream.withColumn("ts", F.col("date").cast("timestamp")).withWatermark("ts", watermark)
    s = s.dropDuplicatesWithinWatermark(["invoice_no"])
    return s.groupBy(F.window("ts", "1 day").alias("day"), "payment_type").agg(
        F.sum("total").cast(TOTAL).alias("revenue"), F.count(F.lit(1)).alias("orders")
    ).select(F.col("day.start").cast("timestamp_ntz").cast("date").cast("string").alias("day"), "payment_type", "revenue", "orders")


_MOVE_ORDER = ["date", "rank", "ref", "line_no", "delta"]


def write_alerts(path: str, products: DataFrame) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer of low-stock crossings from a stream of ``inventory.stock_movements`` rows.

    Each micro-batch is one ordered scan in blocks of rows, so a product with a third of the movements is no task of
    its own, and stock stays decimal.  A movement is an alert if it takes its product across the reorder level, either
    way.  The stock after each epoch is written whole beside the alerts and committed with them; a replayed epoch
    starts from the stock of the epoch before and writes the same folders again.
    """
    levels = products.select(F.col("id").alias("product_id"), F.col("quantity").cast(TOTAL).alias("opening"), "reorder_level")

    def write(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        before = sinks.commits(spark, path).filter(F.col("attempt").cast("long") < epoch_id).agg(F.max(F.col("attempt").cast("long")).alias("e")).first()["e"]
        stock = levels
        if before is not None:
            held = spark.read.parquet(f"{path}/stock/epoch={before}")
            stock = levels.join(held, "product_id", "left").withColumn("opening", F.coalesce("quantity", "opening")).drop("quantity")
        moves = running_sum(batch.select("product_id", *_MOVE_ORDER), F.col("delta"), ["product_id"], _MOVE_ORDER, "moved")
        moves = moves.join(stock, "product_id").withColumn("quantity", (F.col("opening") + F.col("moved")).cast(TOTAL))
        low, was = F.col("quantity") <= F.col("reorder_level"), F.col("quantity") - F.col("delta") <= F.col("reorder_level")
        moves.filter(low != was).select("product_id", *_MOVE_ORDER, "quantity", "reorder_level", low.alias("low")).write.mode(
            "overwrite").parquet(f"{path}/alerts/epoch={epoch_id}")
        taken = batch.groupBy("product_id").agg(F.sum("delta").alias("d"))
        stock.join(taken, "product_id", "left").select(
            "product_id", (F.col("opening") + F.coalesce("d", F.lit(0))).cast(TOTAL).alias("quantity")).write.mode(
            "overwrite").parquet(f"{path}/stock/epoch={epoch_id}")
        sinks.commit(spark, path, f"epoch-{epoch_id}", str(epoch_id))
        sinks.remove(spark, f"{path}/stock/epoch={epoch_id - 2}")

    return write


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """The alerts of all committed epochs."""
    done = sinks.commits(spark, path).select(F.col("attempt").cast("int").alias("epoch"))
    return spark.read.parquet(f"{path}/alerts").join(done, "epoch", "left_semi").drop("epoch")


def cash_position(flows_stream: DataFrame) -> DataFrame:
    """Running total per cash component from a stream of ``(component, amount)`` flows (I3, complete mode)."""
    return flows_stream.groupBy("component").agg(F.sum("amount").cast(TOTAL).alias("amount"))


def write_position(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer of the complete state: each epoch is written whole to its own folder, then committed.

    Run the query in complete mode.  Nothing is read back or merged, so a failed read cannot lose a
    component, and an epoch that is replayed writes the same folder again.  The folder of the epoch before the
    last committed one is removed.
    """

    def write(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch_id}")
        sinks.commit(spark, path, "position", str(epoch_id))
        sinks.remove(spark, f"{path}/epoch={epoch_id - 2}")

    return write


def read_position(spark: SparkSession, path: str) -> DataFrame:
    """The position of the latest epoch whose write was completed."""
    last = sinks.commits(spark, path).first()  # one row
    if last is None:
        return spark.createDataFrame([], "component string, amount decimal(38,2)")
    return spark.read.parquet(f"{path}/epoch={last.attempt}")
