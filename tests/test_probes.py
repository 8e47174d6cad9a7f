"""Cases that once lost rows or changed figures: undated rows, several batches, bad documents, bad amounts."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

import __spark_entry__ as E
from tillspark.operators import asof, credit, expenses, integrity, inventory, pnl, posting, prefix, sales
from tillspark.sources.intake import SALE_DOC, parse_docs, sale_lines
from tillspark.sources.mapping import Retail

SF = "/root/testdata/sf0.001"


def _docs(spark, docs):
    return spark.createDataFrame([(json.dumps(d) if isinstance(d, dict) else d,) for d in docs], "doc string")


def _products(frame):
    return frame("products", [{"id": 1, "name": "tea", "selling_price": 10, "cost_price": 4, "quantity": 100}])


def test_undated_rows_stay_in_scans(frame):
    adj = frame("cash_adjustments", [{"id": 1, "amount": 5}, {"id": 2, "date": "2024-01-01 10:00:00", "amount": 7}])
    rows = prefix.running_sum(adj, "amount", [], ["date", "id"], "balance").collect()
    assert sorted((r.id, float(r.balance)) for r in rows) == [(1, 5.0), (2, 12.0)]
    filled = prefix.carry_forward(adj.withColumn("k", F.lit(None).cast("long")), "amount", ["k"], ["date", "id"], "last").collect()
    assert sorted((r.id, float(r.last)) for r in filled) == [(1, 5.0), (2, 7.0)]


def _sizes(df, by, order, blocks):
    return [r["count"] for r in prefix.in_blocks(df, by, order, blocks).groupBy("_blk").count().collect()]


def test_blocks_are_bounded_by_rows(spark):
    day = dt.datetime(2024, 1, 1)
    df = spark.range(400_000).select(F.lit(day).cast("timestamp_ntz").alias("date"), F.lit(0).alias("rank"), "id", F.lit(1).alias("v"))
    sizes = _sizes(df, [], ["date", "rank", "id"], 16)  # one key, one instant
    assert len(sizes) == 16 and max(sizes) < 2 * 400_000 / 16
    out = prefix.running_sum(df, "v", [], ["date", "rank", "id"], "s", blocks=16)
    assert out.filter(F.col("s") != F.col("id") + 1).isEmpty() and out.count() == 400_000
    lines = sale_lines(parse_docs(Retail(spark, SF)["sale_docs"], SALE_DOC)).select("product_id", "date", "ref", "pos")
    sizes = _sizes(lines, ["product_id"], ["date", "ref", "pos"], 12)  # the feed of shortage_flags: a block for many rows
    assert len(sizes) == 12 and max(sizes) < 2 * sum(sizes) / 12
    hot = spark.range(60_000).select((F.col("id") % 3 * (F.col("id") % 40 == 0).cast("int")).alias("k"), "id", F.lit(1).alias("v"))
    sizes = _sizes(hot, ["k"], ["id"], 10)  # one key with nearly all rows
    assert len(sizes) == 10 and max(sizes) < 2 * 6000
    sums = prefix.running_sum(hot, "v", ["k"], ["id"], "s", blocks=10).groupBy("k").agg(F.max("s").alias("s"), F.count("*").alias("n")).collect()
    assert all(r.s == r.n for r in sums)


def test_scan_reads_its_source_once(spark, frame):
    adj = frame("cash_adjustments", [{"id": i, "date": "2024-01-01 10:00:00", "amount": i} for i in range(1, 5)])
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    out = prefix.running_sum(adj.mapInArrow(count, adj.schema), "amount", [], ["date", "id"], "s")
    assert out.count() == 4 and seen.value == 4


def test_bad_documents_do_not_stop_or_merge_others(spark, frame):
    line = {"product_id": 1, "quantity": "0.125"}
    good = {"ref": 1, "date": "2024-01-01 10:00:00", "payment_type": "cash", "items": [line]}
    docs = _docs(spark, [
        good, {**good, "ref": 2, "date": "yesterday"}, {**good, "ref": 3, "items": [{"product_id": 1, "quantity": "NaN"}]},
        {**good, "ref": 4, "items": [{"product_id": 1, "quantity": "1e20"}]}, {k: v for k, v in good.items() if k != "ref"},
        {**good, "ref": 5}, {**good, "ref": 5}, {**good, "ref": 6, "items": [{"product_id": 1, "quantity": "1", "unit_price": "abc"}]},
        {**good, "ref": 7, "date": None}, {**good, "ref": 8, "items": [{"product_id": 1, "quantity": "Infinity"}]},
    ])
    got = {r.ref: r for r in posting.intake_sales(docs, _products(frame), as_of="2024-05-06 07:08:09").collect()}
    assert set(got) == {1, 7}
    assert float(got[1].total) == 1.25 and str(got[7].date) == "2024-05-06 07:08:09"
    rejects = {r.ref: r.reason for r in posting.intake_rejects(docs, _products(frame)).collect()}
    assert rejects == {2: "bad_date", 3: "bad_quantity", 4: "bad_quantity", None: "no_ref", 5: "repeated_ref", 6: "bad_amount", 8: "bad_quantity"}


def test_repayments_need_an_amount_and_a_sale(frame, spark):
    s = frame("sales", [{"id": 1, "amount_due": 100}])
    req = spark.createDataFrame([(1, 1, 1, "-50"), (2, 1, 2, "120"), (3, 9, 1, "5"), (4, 1, 3, "0")], "id long, sale_id long, seq int, amount string")
    req = req.withColumn("amount", F.col("amount").cast("decimal(18,2)")).withColumn("date", F.lit(None).cast("timestamp_ntz")).withColumn("method", F.lit("cash"))
    assert [(r.id, float(r.applied)) for r in credit.repayments_applied(s, req).collect()] == [(2, 100.0)]
    assert {r.id: r.reason for r in credit.repayment_rejects(s, req).collect()} == {1: "bad_amount", 3: "unknown_sale", 4: "bad_amount"}


def test_statement_lines_are_numbered_over_blocks(frame, spark):
    spread = [{"id": k, "date": "2024-01-05 10:00:00", "category": f"c{k:03}", "amount": 2000 * (k // 2 + 1)} for k in range(300)]
    spread.append({"id": 300, "date": "2024-01-05 10:00:00", "amount": 2000})
    empty = {t: frame(t, [{"id": 1, "date": "2020-01-01 00:00:00"}]) for t in ("sales", "sale_items")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = pnl.pnl_statement(empty["sales"], empty["sale_items"], frame("expenses", spread), ("2024-01-01", "2024-01-31")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = [(r.label, float(r.amount)) for r in sorted(rows, key=lambda r: r.line_no) if r.line_no > 8]
    assert len({r.line_no for r in rows}) == len(rows) == 309
    assert got == sorted(got, key=lambda x: (-x[1], x[0] or ""))


def test_repayment_entries_are_judged_against_every_sale(spark):
    r = Retail(spark, SF)
    rejects = E.queries()["repayment_entry_rejects"](spark, SF).toPandas()
    entries = r["repayment_entries"].toPandas()
    known = {x.id for x in r["sales"].select("id").collect()}
    want = {e.id: "unknown_sale" if e.amount is not None and e.amount > 0 else "bad_amount"
            for e in entries.itertuples() if e.amount is None or e.amount <= 0 or e.sale_id not in known}
    assert len(entries) == r["repayment_requests"].count() > len(want) and set(want.values()) == {"unknown_sale", "bad_amount"}
    assert dict(zip(rejects.id, rejects.reason)) == want and len(rejects) == len(want)


def test_expense_method_default_covers_absence_only(spark):
    req = spark.createDataFrame([(1, "5", ""), (2, "5", None), (3, "NaN", None)], "id long, amount string, payment_method string")
    req = req.withColumns({"date": F.lit(None).cast("timestamp_ntz"), "category": F.lit(None).cast("string"), "description": F.lit("")})
    assert {r.id: r.payment_method for r in expenses.clean_expenses(req, "2024-01-01").collect()} == {1: "", 2: "cash"}


def test_pnl_lines_are_numbered_without_gaps_at_any_number_of_categories(frame):
    e = frame("expenses", [{"id": i, "date": "2024-01-01 10:00:00", "category": f"c{i}", "amount": 1 + i % 7} for i in range(901)])
    rows = pnl.pnl_statement(frame("sales", [{"id": 1, "date": "2024-01-01 10:00:00", "payment_type": "cash", "total": 5}]), frame("sale_items", [{"sale_id": 1}]), e, ("2024-01-01", "2024-01-31")).collect()
    assert sorted(r.line_no for r in rows) == list(range(1, 910))
    assert [r.label for r in rows if r.is_loss] == ["Net profit"]


def test_limited_list_reads_only_the_chosen_documents(frame):
    s = frame("sales", [{"id": i, "date": f"2024-01-0{i} 10:00:00", "total": 10} for i in range(1, 6)])
    items = frame("sale_items", [{"sale_id": i, "quantity": i, "unit_cost": 1} for i in range(1, 6)])
    got = sales.sale_list(s, items, limit=2).collect()
    assert [(r.id, float(r.item_count)) for r in got] == [(5, 5.0), (4, 4.0)]


def test_upsert_leaves_one_row_per_key(spark):
    base = spark.createDataFrame([(1, "a")], "id long, name string")
    twice = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (2, "d", 1)], "id long, name string, seq int")
    assert sorted(map(tuple, integrity.upsert(base, twice, seq="seq").collect())) == [(1, "c"), (2, "d")]
    assert integrity.upsert(base, twice.drop("seq")).count() == 2


def test_operators_run_on_the_library_s_own_schemas(frame):
    buys = frame("purchase_items", [{"purchase_id": 1, "line_no": 1, "product_id": 1, "quantity": 2, "unit_cost": 3, "date": "2024-01-01 10:00:00", "ref": 11}])
    sold = frame("sale_items", [{"sale_id": 1, "line_no": 1, "product_id": 1, "quantity": 1, "date": "2024-01-02 10:00:00"}])
    s = frame("sales", [{"id": 1, "date": "2024-01-02 10:00:00"}])
    assert inventory.latest_cost(buys).count() == 1
    assert asof.asof_cost(sold, s, buys).count() == 1
