"""Relations, rules and flat records on small tables with planted faults."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tillspark.operators import integrity, suppliers
from tillspark.sources import flat
from tillspark.sources.schemas import SCHEMAS


@pytest.fixture()
def shop(frame):
    rows = {
        "categories": [{"id": 1, "name": "a"}, {"id": 2, "name": "b"}],
        "products": [{"id": 1, "name": "tea", "category_id": 1, "quantity": -2}, {"id": 2, "name": "jam", "category_id": 7, "quantity": 3}],
        "sales": [{"id": 1, "payment_type": "cash", "total": 9, "amount_paid": 10, "discount": -1}, {"id": 2, "payment_type": "pledge", "total": 4},
                  {"id": 3, "payment_type": None, "total": 1}],
        "sale_items": [{"sale_id": 1, "product_id": 1, "line_total": 5}, {"sale_id": 1, "product_id": 2, "line_total": 4},
                       {"sale_id": 2, "product_id": 9, "line_total": 4}, {"sale_id": 8, "product_id": None, "line_total": 1}],
        "payments": [{"id": 1, "sale_id": 1, "amount": 3, "method": "shells"}, {"id": 2, "sale_id": 6, "amount": 2}],
        "suppliers": [{"id": 1, "name": "s"}, {"id": 2, "name": "t"}],
        "purchases": [{"id": 1, "supplier_id": 1, "payment_type": "cash", "total": 7}, {"id": 2, "supplier_id": 5, "payment_type": "x", "total": -7}],
        "purchase_items": [{"purchase_id": 1, "product_id": 1, "line_total": 7}, {"purchase_id": 2, "product_id": 2, "line_total": 2},
                           {"purchase_id": 9, "product_id": 8, "line_total": 2}],
        "supplier_payments": [{"id": 1, "supplier_id": 1, "amount": 1, "method": "iou"}, {"id": 2, "supplier_id": 9, "purchase_id": 1, "amount": 5}],
        "expenses": [{"id": 1, "amount": 0}], "cash_adjustments": [{"id": 1, "amount": 2}],
    }
    return {t: frame(t, rows[t]) for t in integrity.TABLES if t in SCHEMAS}


def test_every_rule_and_relation_finds_its_faults(shop):
    counts = {r.check: r.violations for r in integrity.domain_violations(shop).collect()}
    assert counts == {"sales.payment_type": 2, "sales.negative_money": 1, "sales.overpaid": 1, "purchases.payment_type": 1,
                      "purchases.negative_money": 1, "supplier_payments.method": 1, "payments.method": 1, "expenses.amount": 1, "products.negative_stock": 1}
    assert {r.id: r.broken for r in integrity.rule_breaks(shop, "sales").collect()} == {
        1: ["sales.negative_money", "sales.overpaid"], 2: ["sales.payment_type"], 3: ["sales.payment_type"]}
    orphans = {r.check: r.orphans for r in integrity.orphan_items(shop).collect()}
    assert orphans == {"sale_items.sale_id": 1, "sale_items.product_id": 1, "payments.sale_id": 1, "purchase_items.purchase_id": 1,
                       "purchase_items.product_id": 1, "purchases.supplier_id": 1, "supplier_payments.supplier_id": 1, "products.category_id": 1}


def test_a_table_s_rules_are_one_scan(shop):
    plan = integrity.domain_violations({**shop, "payments": shop["payments"]})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == len({t for _, t, _ in integrity.RULES})


def test_deletes_go_through_the_relations(shop):
    gone = {"categories": shop["categories"].filter("id = 1"), "products": shop["products"].filter("id = 2"),
            "sales": shop["sales"].filter("id = 1"), "suppliers": shop["suppliers"].filter("id = 1"), "purchases": shop["purchases"].filter("id = 1")}
    left = integrity.delete_rows(shop, gone)
    assert {t: left[t].columns == shop[t].columns for t in left} == {t: True for t in integrity.TABLES}

    def rows(t, *cols):
        return sorted((tuple(r) for r in left[t].select(*cols).collect()), key=repr)

    assert rows("products", "id", "category_id") == [(1, None)]
    assert rows("sale_items", "sale_id", "product_id") == [(2, 9), (8, None)]
    assert rows("payments", "id") == [(2,)] and rows("suppliers", "id") == [(2,)]
    assert rows("purchases", "id", "supplier_id") == [(2, 5)]
    assert rows("purchase_items", "purchase_id", "product_id") == [(2, None), (9, 8)]
    assert rows("supplier_payments", "id", "purchase_id") == [(2, None)]
    state = {r.table: (r.rows, r.removed, r.keys_set_null) for r in integrity.delete_state(shop, gone).collect()}
    assert state["products"] == (1, 1, 1) and state["sale_items"] == (2, 2, 0) and state["purchase_items"] == (2, 1, 1)
    assert state["supplier_payments"] == (1, 1, 1) and state["expenses"] == (1, 0, 0)
    untouched = {r.table: r.removed for r in integrity.delete_state(shop, {}).collect()}
    assert set(untouched.values()) == {0}


def test_flat_files_keep_bad_records(spark, tmp_path):
    (tmp_path / "s.csv").write_text('"  Ann ",1,\n,2,x\nlost\nBea,,"a ""b"""\na,b,c,d\n')
    (tmp_path / "c.json").write_text('{"name": " x "}\n{"name": \n{"name": "x"}\n7\n{}\n{"name": "old"}\n')
    rows = flat.read_flat(spark, str(tmp_path / "s.csv"), flat.SUPPLIER_RECORD, escape='"').collect()
    assert [r._corrupt for r in rows] == [None, None, "lost", None, "a,b,c,d"] and rows[3].notes == 'a "b"'
    lines = spark.createDataFrame([(i, x) for i, x in enumerate((tmp_path / "s.csv").read_text().splitlines())] + [(9, None)], "seq long, raw string")
    assert sorted(map(tuple, flat.supplier_intake(lines).collect())) == [(0, "Ann", "1", None), (3, "Bea", None, 'a "b"')]
    assert sorted((r.seq, r.raw, r.reason) for r in flat.supplier_intake_rejects(lines).collect()) == [
        (1, ",2,x", "missing_name"), (2, "lost", "malformed"), (4, "a,b,c,d", "malformed"), (9, "", "malformed")]
    lines = spark.createDataFrame([(i, x) for i, x in enumerate((tmp_path / "c.json").read_text().splitlines())], "seq long, raw string")
    held = spark.createDataFrame([(1, "old", None)], "id long, name string, created_at timestamp_ntz")
    assert [tuple(r) for r in flat.category_intake(lines, held).collect()] == [(0, 1000, "x")]
    assert sorted((r.seq, r.reason) for r in flat.category_intake_rejects(lines, held).collect()) == [
        (1, "malformed"), (2, "duplicate_key"), (3, "malformed"), (4, "missing_name"), (5, "duplicate_key")]


def test_supplier_payments_need_an_amount_and_a_supplier(spark, frame):
    entries = spark.createDataFrame([(1, 1, "5", None, ""), (2, 1, "", "card", "x"), (3, 9, "5", "cash", None), (4, 1, "-1", None, None), (5, 1, "1e2", "bank", "n")],
                                    "id long, supplier_id long, amount string, method string, note string")
    entries = entries.withColumn("date", F.when(F.col("id") == 5, F.lit("2024-01-02 03:04:05")).cast("timestamp_ntz"))
    held = frame("suppliers", [{"id": 1, "name": "s"}])
    got = {r.id: (float(r.amount), r.method, r.note, str(r.date)) for r in suppliers.clean_supplier_payments(entries, held, "2024-05-06").collect()}
    assert got == {1: (5.0, "cash", "Payment to supplier", "2024-05-06 00:00:00"), 5: (100.0, "bank", "n", "2024-01-02 03:04:05")}
    assert {r.id: r.message for r in suppliers.supplier_payment_rejects(entries, held).collect()} == {
        2: "Valid amount required", 3: "Supplier not found", 4: "Valid amount required"}
