"""What is moved: rows carry what the next step reads, and written tables are not written again."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tillspark.operators import credit, integrity, posting, prefix, suppliers
from tillspark.session import DEFAULTS, written
from tillspark.sources import docs
from tillspark.sources.mapping import Retail


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_headers_stand_on_the_first_line(spark, frame):
    products = frame("products", [{"id": 1, "name": "a", "selling_price": 2, "cost_price": 1, "quantity": 9}])
    doc = {"ref": 5, "customer_name": "Ann", "date": "2024-01-01", "items": [{"product_id": 1, "quantity": "1"}] * 3}
    rows = posting.sale_line_rows(spark.createDataFrame([(json.dumps(doc),)], "doc string"), products).orderBy("pos").collect()
    assert [r.head and r.head.customer_name for r in rows] == ["Ann", None, None]


def test_baskets_are_not_moved_to_the_customers(spark):
    line = ("l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, "
            "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz")
    r = {"lineitem": spark.createDataFrame([], line),
         "orders": spark.createDataFrame([(1, 2, None, "2-HIGH")], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderpriority string"),
         "customer": spark.createDataFrame([(2, "Ann"), (2, "Bob")], "c_custkey long, c_name string")}
    feed = docs.sale_docs(r)
    assert sorted(json.loads(x.doc)["customer_name"] for x in feed.collect()) == ["Ann", "Bob"]
    plan = _plan(feed)
    assert plan.index("collect_list") > plan.index("o_custkey#", plan.index("Join LeftOuter, (o_custkey"))


def test_written_rows_are_not_written_again_by_a_scan(spark, monkeypatch):
    table, names = written(spark.range(20).withColumn("k", F.col("id") % 3), "table"), []
    monkeypatch.setattr(prefix, "written", lambda df, name: names.append(name) or written(df, name))
    got = prefix.running_sum(table, "id", ["k"], ["id"], "s", blocks=3).filter("k = 0").orderBy("id").collect()
    assert [r.s for r in got] == [0, 3, 9, 18, 30, 45, 63] and names == ["scan"] and table.count() == 20


def test_repayments_need_no_written_scan(frame, spark, monkeypatch):
    monkeypatch.setattr(prefix, "written", lambda *a: 1 / 0)
    s = frame("sales", [{"id": 1, "amount_due": 100}])
    req = spark.createDataFrame([(1, 1, 1, None, 70.0, "cash"), (2, 1, 2, None, 70.0, "cash")],
                                "id long, sale_id long, seq long, date timestamp_ntz, amount double, method string").withColumn(
        "amount", F.col("amount").cast("decimal(18,2)"))
    assert sorted((r.id, float(r.applied)) for r in credit.repayments_applied(s, req).collect()) == [(1, 70.0), (2, 30.0)]


def test_kept_views_hold_the_named_columns(spark):
    r = Retail(spark, "nowhere")
    r._frames["sales"] = spark.createDataFrame([(1, 2, 3)], "id long, total long, discount long")
    assert r.kept({"sales": "id total"})["sales"].columns == ["id", "total"] and r["sales"].collect() == [(1, 2)]


def test_values_of_a_key_meet_its_scan(spark):
    rows = spark.createDataFrame([(k, i) for k in (1, 2) for i in range(6)], "k long, i long")
    per_key = spark.createDataFrame([(1, "a"), (1, "b")], "k long, name string")
    got = prefix.running_sum(rows, "i", ["k"], ["i"], "s", blocks=4, per_key=per_key)
    assert sorted((r.k, r.s, r.name or "") for r in got.collect()) == sorted(
        [(1, s, n) for s in (0, 1, 3, 6, 10, 15) for n in "ab"] + [(2, s, "") for s in (0, 1, 3, 6, 10, 15)])


def test_products_are_flagged_before_lines_move(spark):
    def ids(n):
        return spark.range(n).toDF("id")

    relations = [r for r in integrity.RELATIONS if r.child == "sale_items"]
    child = spark.createDataFrame([(1, 9), (7, 2)], "sale_id long, product_id long")
    flagged = integrity._flagged(child, relations, {"sales": ids(3), "products": ids(5)}, "_has_")
    assert sorted(flagged.select("sale_id", "_has_sale_id", "_has_product_id").collect()) == [(1, True, False), (7, False, True)]
    assert flagged.columns.index("_has_product_id") < flagged.columns.index("_has_sale_id")


def test_one_fifo_scan_serves_two_readers(monkeypatch):
    monkeypatch.setattr(suppliers, "fifo_scan", lambda *a: 1 / 0)

    class Seen(Exception):
        pass

    class Rows:
        def filter(self, *a):
            raise Seen

    with pytest.raises(Seen):
        suppliers.fifo_payments(None, None, (Rows(), None))


def test_tasks_read_bounded_partitions(spark):
    assert DEFAULTS["spark.sql.adaptive.advisoryPartitionSizeInBytes"] == spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"
