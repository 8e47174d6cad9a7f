"""Streaming jobs against their batch forms."""

from __future__ import annotations

import datetime as dt
import tempfile

from pyspark.sql import functions as F

from tillspark.operators import cash, inventory
from tillspark.sources.mapping import Retail
from tillspark.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_daily_takings_closed_days_match_batch(spark):
    r = Retail(spark, SF)
    s = r["sales"].filter((F.col("date") >= F.lit("1997-01-01").cast("timestamp_ntz")) &
                          (F.col("date") < F.lit("1997-03-01").cast("timestamp_ntz")))
    d = tempfile.mkdtemp(prefix="tillspark-i1-")
    s.select("invoice_no", "date", "payment_type", "total").withColumn("day", F.to_date("date")) \
        .write.partitionBy("day").parquet(f"{d}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{d}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/in")
    q = jobs.daily_takings(stream).writeStream.outputMode("append").format("memory").queryName("i1_out") \
        .option("checkpointLocation", f"{d}/ckpt").start()
    q.processAllAvailable()
    q.stop()
    got = {(x.day, x.payment_type): (float(x.revenue), x.orders) for x in spark.sql("SELECT * FROM i1_out").collect()}
    batch = s.groupBy(F.date_format("date", "yyyy-MM-dd").alias("day"), "payment_type").agg(
        F.sum("total").alias("rev"), F.count(F.lit(1)).alias("n")).collect()
    exp = {(x.day, x.payment_type): (float(x.rev), x.n) for x in batch}
    last = max(x.day for x in batch)
    closed = {k for k in exp if dt.date.fromisoformat(k[0]) + dt.timedelta(days=3) <= dt.date.fromisoformat(last)}
    assert got == {k: exp[k] for k in closed} and len(closed) > 25  # every closed day, and only those


def test_low_stock_alerts_are_the_ledger_s_crossings(spark):
    r = Retail(spark, SF)
    mv = inventory.stock_movements(r["purchase_items"], r["sale_items"], r["sales"], r["stock_adjustments"]).cache()
    d = tempfile.mkdtemp(prefix="tillspark-i2-")
    cuts = [None, dt.datetime(1996, 6, 1), dt.datetime(1998, 1, 1), None]
    spark.createDataFrame([], mv.schema).write.parquet(f"{d}/in")
    stream = spark.readStream.schema(mv.schema).parquet(f"{d}/in")
    for lo, hi in zip(cuts, cuts[1:]):  # the movements arrive in three lots
        part = mv.filter((F.lit(lo is None) | (F.col("date") >= F.lit(lo))) & (F.lit(hi is None) | (F.col("date") < F.lit(hi))))
        part.write.mode("append").parquet(f"{d}/in")
        job = stream.writeStream.foreachBatch(jobs.write_alerts(f"{d}/out", r["products"])).option("checkpointLocation", f"{d}/ckpt")
        job.trigger(availableNow=True).start().awaitTermination()
    got = jobs.read_alerts(spark, f"{d}/out")
    level = r["products"].select(F.col("id").alias("product_id"), "reorder_level")
    ledger = inventory.stock_ledger(r["products"], r["purchase_items"], r["sale_items"], r["sales"], r["stock_adjustments"]).join(level, "product_id")
    low, was = F.col("position") <= F.col("reorder_level"), F.col("position") - F.col("delta") <= F.col("reorder_level")
    want = ledger.filter(low != was).select("product_id", "date", "ref", "line_no", "delta", "position", low.alias("low"))

    def rows(df, last):
        return sorted((x.product_id, x.date, x.ref, x.line_no, x.delta, x[last], x.low) for x in df.collect())

    found = rows(got, "quantity")
    assert found == rows(want, "position") and len(found) > 100
    assert jobs.read_alerts(spark, f"{d}/out").select("product_id").distinct().count() > 50


def test_cash_position_final_equals_breakdown(spark):
    r = Retail(spark, SF)
    tables = (r["sales"], r["payments"], r["purchases"], r["supplier_payments"], r["expenses"], r["cash_adjustments"])
    d = tempfile.mkdtemp(prefix="tillspark-i3-")
    cash.cash_flows(*tables).repartition(4).write.parquet(f"{d}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{d}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/in")
    q = jobs.cash_position(stream).writeStream.outputMode("complete").foreachBatch(jobs.write_position(f"{d}/out")) \
        .option("checkpointLocation", f"{d}/ckpt").start()
    q.processAllAvailable()
    q.stop()
    got = {x.component: float(x.amount) for x in jobs.read_position(spark, f"{d}/out").collect()}
    b = cash.cash_breakdown(*tables).collect()[0].asDict()
    assert set(got) == {c for c in cash.COMPONENTS if b[c]}
    for comp, amount in got.items():
        assert float(b[comp]) == amount
