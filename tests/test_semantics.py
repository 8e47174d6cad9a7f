"""One test per semantic rule of SURVEY §1.4 that the operators decide."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tillspark.functions.money import to_number
from tillspark.functions.period import in_period
from tillspark.functions.search import like_any
from tillspark.operators import asof, cash, credit, inventory, pnl, posting, sales, suppliers
from tillspark.plans import narrative

RNG = ("2024-01-01", "2024-01-31")


def test_s1_range_is_half_open_whole_days(frame):
    s = frame("sales", [
        {"id": 1, "date": "2024-01-01 00:00:00", "total": 1}, {"id": 2, "date": "2024-01-31 23:59:59", "total": 1},
        {"id": 3, "date": "2024-01-31 23:59:59.5", "total": 1}, {"id": 4, "date": "2024-02-01 00:00:00", "total": 1},
        {"id": 5, "date": "2023-12-31 23:59:59", "total": 1},
    ])
    assert sorted(r.id for r in in_period(s, RNG).collect()) == [1, 2, 3]


def test_s3_expense_only_day_dropped_unless_fill_all(frame):
    s = frame("sales", [{"id": 1, "date": "2024-01-02 10:00:00", "total": 100, "payment_type": "cash"}])
    si = frame("sale_items", [{"sale_id": 1, "product_id": 1, "quantity": 1, "unit_price": 100, "unit_cost": 60}])
    e = frame("expenses", [{"id": 1, "date": "2024-01-03 10:00:00", "amount": 7}])
    ref = pnl.timeseries(s, si, e, RNG, "day").collect()
    assert [r.bucket for r in ref] == ["2024-01-02"]
    full = pnl.timeseries(s, si, e, RNG, "day", fill="all").collect()
    assert [(r.bucket, float(r.net_profit)) for r in full] == [("2024-01-02", 40.0), ("2024-01-03", -7.0)]


def test_s10_supplier_overpayment_excess_lost(frame):
    p = frame("purchases", [
        {"id": 1, "supplier_id": 9, "date": "2024-01-01 10:00:00", "total": 100, "amount_paid": 0, "amount_due": 100, "payment_type": "credit", "invoice_no": "P1"},
        {"id": 2, "supplier_id": 9, "date": "2024-01-02 10:00:00", "total": 50, "amount_paid": 0, "amount_due": 50, "payment_type": "credit", "invoice_no": "P2"},
        {"id": 3, "supplier_id": 9, "date": "2024-01-05 10:00:00", "total": 40, "amount_paid": 0, "amount_due": 40, "payment_type": "credit", "invoice_no": "P3"},
    ])
    sp = frame("supplier_payments", [
        {"id": 1, "supplier_id": 9, "date": "2024-01-03 10:00:00", "amount": 120, "method": "cash"},
        {"id": 2, "supplier_id": 9, "date": "2024-01-04 10:00:00", "amount": 80, "method": "cash"},
    ])
    dues = {r.purchase_id: float(r.amount_due) for r in suppliers.fifo_allocation(p, sp).collect()}
    assert dues == {1: 0.0, 2: 0.0, 3: 40.0}
    lost = {r.payment_id: float(r.lost) for r in suppliers.fifo_payments(p, sp).collect()}
    assert lost == {1: 0.0, 2: 50.0}
    closing = suppliers.supplier_closing(p, sp).collect()[0]
    assert float(closing.closing) == -10.0
    links = {(r.purchase_id, r.payment_id): float(r.amount) for r in suppliers.fifo_links(p, sp).collect()}
    assert links == {(1, 1): 100.0, (2, 1): 20.0, (2, 2): 30.0}


def test_s11_repayment_clamped(frame, spark):
    s = frame("sales", [{"id": 1, "date": "2024-01-01 10:00:00", "total": 100, "amount_paid": 0, "amount_due": 100, "payment_type": "credit"}])
    req = spark.createDataFrame(
        [(11, 1, 1, "2024-01-02 10:00:00", "60"), (12, 1, 2, "2024-01-03 10:00:00", "60"), (13, 1, 3, "2024-01-04 10:00:00", "10")],
        "id long, sale_id long, seq long, date string, amount string",
    ).select("id", "sale_id", "seq", F.col("date").cast("timestamp_ntz").alias("date"),
             F.col("amount").cast("decimal(18,2)").alias("amount"), F.lit("cash").alias("method"))
    got = [float(r.applied) for r in credit.repayments_applied(s, req).orderBy("seq").collect()]
    assert got == [60.0, 40.0, 0.0]


def test_s12_top_products_merge_same_name(frame):
    s = frame("sales", [{"id": 1, "date": "2024-01-02 10:00:00", "total": 30}])
    si = frame("sale_items", [
        {"sale_id": 1, "product_id": 1, "product_name": "Soap", "quantity": 1, "unit_price": 10, "unit_cost": 5, "line_total": 10},
        {"sale_id": 1, "product_id": 2, "product_name": "Soap", "quantity": 1, "unit_price": 20, "unit_cost": 5, "line_total": 20},
    ])
    got = sales.top_products(s, si, RNG).collect()
    assert [(r.product_name, float(r.revenue), float(r.profit)) for r in got] == [("Soap", 30.0, 20.0)]


@pytest.mark.parametrize("q,expected", [("50%", ["50% off"]), ("a_c", ["abc", "a_c"]), ("\\", ["back\\slash"]),
                                         ("ÉCLAIR", ["éclair"]), ("SOAP", ["Soap"])])
def test_s13_like_search(spark, q, expected):
    names = ["50% off", "abc", "a_c", "back\\slash", "éclair", "Soap", "plain"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert sorted(r.name for r in df.filter(like_any(["name"], q)).collect()) == sorted(expected)


def test_s15_basket_sum_vs_per_line(spark, frame):
    prods = frame("products", [{"id": 1, "name": "Tea", "selling_price": 10, "cost_price": 5, "quantity": 5}])
    doc = '{"ref": 1, "payment_type": "cash", "date": "2024-01-02 10:00:00", "items": [{"product_id": 1, "quantity": 4}, {"product_id": 1, "quantity": 4}]}'
    docs = spark.createDataFrame([(1, doc)], "ref long, doc string")
    rej = posting.intake_rejects(docs, prods).collect()
    assert [(r.reason, r.message) for r in rej] == [("no_stock", "Not enough stock for Tea (have 5, need 4)")]
    assert posting.intake_sales(docs, prods, per_line=True).count() == 1


def test_s16_later_purchase_line_sets_cost(frame, spark):
    pi = spark.createDataFrame(
        [(1, 1, 9, "2024-01-02 10:00:00", 0, 7, "x", "1", "10"), (1, 2, 9, "2024-01-02 10:00:00", 0, 7, "x", "1", "12")],
        "purchase_id long, line_no int, supplier_id long, date string, ref long, product_id long, product_name string, quantity string, unit_cost string",
    ).select("purchase_id", "line_no", "supplier_id", F.col("date").cast("timestamp_ntz").alias("date"), "ref", "product_id",
             "product_name", F.col("quantity").cast("decimal(18,2)").alias("quantity"),
             F.col("unit_cost").cast("decimal(18,2)").alias("unit_cost"))
    assert float(inventory.latest_cost(pi).collect()[0].cost_price) == 12.0
    s = frame("sales", [{"id": 5, "date": "2024-01-03 10:00:00"}, {"id": 6, "date": "2024-01-01 10:00:00"}])
    si = frame("sale_items", [{"sale_id": 5, "line_no": 1, "product_id": 7, "quantity": 2}, {"sale_id": 6, "line_no": 1, "product_id": 7, "quantity": 1}])
    got = {r.sale_id: (None if r.cost_asof is None else float(r.cost_asof)) for r in asof.asof_cost(si, s, pi).collect()}
    assert got == {5: 12.0, 6: None}


def test_s21_same_instant_ledger_keeps_source_order(frame):
    t = "2024-01-02 10:00:00"
    s = frame("sales", [{"id": 1, "invoice_no": "INV-1", "date": t, "payment_type": "cash", "total": 50, "amount_paid": 50}])
    e = frame("expenses", [{"id": 1, "date": t, "category": "Tea", "amount": 20, "payment_method": "cash"}])
    empty = {n: frame(n, []) for n in ("payments", "purchases", "supplier_payments", "cash_adjustments", "suppliers")}
    led = cash.cash_ledger(s, empty["payments"], empty["purchases"], empty["supplier_payments"], e,
                           empty["cash_adjustments"], empty["suppliers"]).collect()
    assert [(r.label, float(r.balance)) for r in led] == [("Expense: Tea", 30.0), ("Cash sale INV-1", 50.0)]


def test_s23_zero_revenue_margins(frame):
    empty_s, empty_i = frame("sales", []), frame("sale_items", [])
    e = frame("expenses", [{"id": 1, "date": "2024-01-05 10:00:00", "amount": 50}])
    k = pnl.period_kpis(empty_s, empty_i, e, RNG).collect()[0]
    assert (k.gross_margin_pct, k.net_margin_pct, k.order_count, float(k.net_profit), k.is_loss) == (0.0, 0.0, 0, -50.0, True)


def test_s24_number_text(spark):
    df = spark.createDataFrame([("",), (None,), ("abc",), ("3",), (" 2.5 ",)], "x string")
    assert [r.n for r in df.select(to_number("x").alias("n")).collect()] == [0.0, 0.0, None, 3.0, 2.5]


def test_loss_period_summary(frame, spark):
    s = frame("sales", [{"id": 1, "date": "2024-01-02 10:00:00", "total": 100, "payment_type": "cash", "amount_paid": 100}])
    si = frame("sale_items", [{"sale_id": 1, "product_id": 1, "product_name": "Tea", "quantity": 1, "unit_price": 100, "unit_cost": 80, "line_total": 100}])
    e = frame("expenses", [{"id": 1, "date": "2024-01-05 10:00:00", "amount": 50}])
    k = pnl.period_kpis(s, si, e, RNG)
    zero = spark.createDataFrame([(0.0, 0)], "due double, count long")
    pay = spark.createDataFrame([(0.0, 0)], "total_payable double, count long")
    inv = spark.createDataFrame([(0, 0)], "products long, low_stock_count long")
    cash_row = spark.createDataFrame([(1234.5,)], "cash_on_hand double")
    top = sales.top_earner(s, si, RNG)
    d = narrative.dashboard(k, k, zero, pay, inv, cash_row, top, RNG).collect()[0]
    assert d.summary == (
        "You made 1 sale totalling Rs 100, for a loss of Rs 30 after costs and expenses (-30% margin). "
        "Expenses (Rs 50) are eating into your gross profit of Rs 20 — worth reviewing where the money is going. "
        "Your best earner is Tea, bringing in Rs 20 profit. You have about Rs 1,235 cash in hand."
    )
