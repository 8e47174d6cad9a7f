"""Append sink partitioned by month and batch: a batch that is run again replaces its own rows, others stay (A5)."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from tillspark.sources.schemas import read_table
from tillspark.sources.sinks import append_facts


def test_batches_of_one_month_stand_side_by_side(frame, spark):
    path = tempfile.mkdtemp(prefix="tillspark-sink-") + "/sales"
    append_facts(frame("sales", [{"id": 1, "date": "2024-01-02 10:00:00", "total": 5}]), path, "b1")
    append_facts(frame("sales", [{"id": 2, "date": "2024-01-20 10:00:00", "total": 7}]), path, "b2")
    append_facts(frame("sales", [{"id": 3, "total": 1}]), path, "b3")  # undated
    assert sorted(r.id for r in read_table(spark, "sales", path).collect()) == [1, 2, 3]
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_lines_can_be_appended_and_read(frame, spark):
    path = tempfile.mkdtemp(prefix="tillspark-sink-") + "/sale_items"
    append_facts(frame("sale_items", [{"sale_id": 1, "date": "2024-01-02 10:00:00", "quantity": "0.125"}]), path, "b1")
    assert read_table(spark, "sale_items", path).first()["month"] == "2024-01"


def test_append_is_idempotent_per_month(frame, spark):
    s = frame("sales", [{"id": 1, "date": "2024-01-02 10:00:00", "total": 5},
                        {"id": 2, "date": "2024-02-03 10:00:00", "total": 7}])
    path = tempfile.mkdtemp(prefix="tillspark-sink-") + "/sales"
    append_facts(s, path, "b1")
    append_facts(s, path, "b1")  # replayed batch
    back = spark.read.parquet(path)
    assert back.count() == 2
    assert sorted(r.month for r in back.select("month").distinct().collect()) == ["2024-01", "2024-02"]
    pruned = back.filter(F.col("month") == "2024-02")
    assert [r.id for r in pruned.collect()] == [2]


def test_in_period_prunes_month_partitions(frame, spark):
    from tillspark.functions.period import in_period

    s = frame("sales", [{"id": i, "date": f"2024-0{m}-1{i % 9} 10:00:00", "total": 1} for i, m in
                        [(1, 1), (2, 2), (3, 3), (4, 3)]])
    path = tempfile.mkdtemp(prefix="tillspark-prune-") + "/sales"
    append_facts(s, path, "b1")
    df = in_period(read_table(spark, "sales", path), ("2024-03-01", "2024-03-31"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    assert sorted(r.id for r in df.collect()) == [3, 4]


def test_a_replay_with_fewer_months_removes_its_old_rows(frame, spark):
    path = tempfile.mkdtemp(prefix="tillspark-sink-") + "/sales"
    s = frame("sales", [{"id": i, "date": f"2024-0{i}-02 10:00:00", "total": 5} for i in (1, 2, 3)])
    append_facts(s, path, "b1")
    append_facts(frame("sales", [{"id": 9, "date": "2024-02-02 10:00:00"}]), path, "b2")
    append_facts(s.filter("id = 2"), path, "b1")
    assert sorted(r.id for r in read_table(spark, "sales", path).collect()) == [2, 9]
    append_facts(s.limit(0), path, "b1")
    assert [r.id for r in read_table(spark, "sales", path).collect()] == [9]


def test_a_half_written_batch_is_not_read(frame, spark):
    path = tempfile.mkdtemp(prefix="tillspark-sink-") + "/sales"
    s = frame("sales", [{"id": 1, "date": "2024-01-02 10:00:00", "total": 5}])
    half = s.withColumns({"month": F.lit("2024-01"), "batch_id": F.lit("b1"), "attempt": F.lit("stopped")})
    half.write.partitionBy("batch_id", "attempt", "month").parquet(path)  # files without a commit
    assert read_table(spark, "sales", path).count() == 0
    append_facts(s, path, "b1")
    assert [r.id for r in read_table(spark, "sales", path).collect()] == [1]


def test_position_is_read_from_the_last_committed_epoch(spark):
    from tillspark.streaming.jobs import read_position, write_position

    path = tempfile.mkdtemp(prefix="tillspark-position-")
    write, flows = write_position(path), "component string, amount decimal(38,2)"
    assert read_position(spark, path).count() == 0
    for epoch in range(4):
        write(spark.createDataFrame([("cash_sales_in", epoch)], "component string, amount int").selectExpr("component", "CAST(amount AS DECIMAL(38,2)) AS amount"), epoch)
    spark.createDataFrame([], flows).write.parquet(f"{path}/epoch=4")  # written, not committed
    assert [(r.component, float(r.amount)) for r in read_position(spark, path).collect()] == [("cash_sales_in", 3.0)]
    import os

    assert sorted(x for x in os.listdir(path) if x.startswith("epoch")) == ["epoch=2", "epoch=3", "epoch=4"]
