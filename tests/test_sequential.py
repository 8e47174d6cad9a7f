"""Sales posted in turn, against a plain loop that keeps the stock as it goes."""

from __future__ import annotations

import json
import random
from decimal import Decimal

import pytest

from tillspark.operators import posting, sequential

DAYS = [None, "2024-01-01 10:00:00", "2024-01-01 10:00:01", "2024-01-02 00:00:00", "2024-01-03 09:00:00"]


def _feed(rng, n, products):
    docs = []
    for ref in range(n):
        items = [{"product_id": rng.choice([*range(1, products + 1), 1, 1, 99 if rng.random() < 0.1 else 2]),
                  "quantity": rng.choice(["1", "2", "3", "0.5", "4", "0" if rng.random() < 0.2 else "1"])}
                 for _ in range(rng.choice([0, 1, 1, 2, 3, 4]) if rng.random() < 0.95 else 0)]
        docs.append({"ref": ref, "date": rng.choice(DAYS), "payment_type": rng.choice(["cash", "credit", "card"]), "amount_paid": "3",
                     "items": items})
    docs += [{**docs[3]}, {**docs[4], "ref": None}, {**docs[5], "ref": n + 1, "date": "never"}]
    rng.shuffle(docs)
    return docs


def _loop(docs, stock, names, per_line):
    """Post the documents one by one in (date, ref) order; whole documents pass or fail."""
    stock = dict(stock)
    refs = [d["ref"] for d in docs]
    rejects, sold = {}, []
    for d in sorted((d for d in docs if d["ref"] is not None), key=lambda d: (d["date"] or "", d["ref"])):
        if refs.count(d["ref"]) > 1:
            rejects[d["ref"]] = ("repeated_ref", "The reference is not unique")
            continue
        if d["date"] == "never":
            rejects[d["ref"]] = ("bad_date", "Invalid date")
            continue
        bad = None if d["items"] else ("empty", "At least one item is required")
        for it in d["items"]:
            p, q = it["product_id"], Decimal(it["quantity"])
            need = q if per_line else sum(Decimal(x["quantity"]) for x in d["items"] if x["product_id"] == p)
            if p not in stock:
                bad = ("not_found", f"Product {p} not found")
            elif q <= 0:
                bad = ("bad_quantity", f"Invalid quantity for {names[p]}")
            elif need > stock[p]:
                bad = ("no_stock", f"Not enough stock for {names[p]} (have {float(stock[p]):g}, need {float(q):g})")
            if bad:
                break
        if bad:
            rejects[d["ref"]] = bad
            continue
        sold.append(d["ref"])
        for it in d["items"]:
            stock[it["product_id"]] -= Decimal(it["quantity"])
    return sold, rejects, stock


@pytest.mark.parametrize("per_line,replay_rows,blocks", [(False, 0, 5), (False, 100_000, None), (True, 40, 3)])
def test_posting_in_turn_equals_the_loop(spark, frame, per_line, replay_rows, blocks):
    rng = random.Random(21 + replay_rows + per_line)
    stock = {p: Decimal(rng.choice([0, 3, 5, 12, 1000])) for p in range(1, 8)}
    names = {p: f"item{p}" for p in stock}
    products = frame("products", [{"id": p, "name": names[p], "selling_price": 2, "cost_price": 1, "quantity": q} for p, q in stock.items()])
    docs = _feed(rng, 90, 7)
    feed = spark.createDataFrame([(json.dumps(d),) for d in docs], "doc string")
    run = sequential.SequentialPosting(feed, products, per_line=per_line, replay_rows=replay_rows, blocks=blocks)
    sold, rejects, after = _loop(docs, stock, names, per_line)
    assert sorted(r.ref for r in run.sales().collect()) == sorted(sold)
    got = {r.ref: (r.reason, r.message) for r in run.rejects().collect()}
    assert got.pop(None)[0] == "no_ref" and got == rejects
    assert {r.product_id: r.after for r in run.stock_after().collect()} == after
    assert {r.ref for r in run.items().collect()} == set(sold)
    assert {r.reason for r in run.rejects().collect()} >= {"no_stock", "empty", "repeated_ref", "bad_date"}


def test_last_unit_goes_to_the_first_basket(spark, frame):
    products = frame("products", [{"id": 1, "name": "tea", "selling_price": 5, "quantity": 1}, {"id": 2, "name": "jam", "selling_price": 5, "quantity": 9}])

    def doc(ref, date, *products):
        return json.dumps({"ref": ref, "date": date, "items": [{"product_id": p, "quantity": "1"} for p in products]})

    feed = spark.createDataFrame([(doc(2, "2024-01-02 08:00:00", 1, 2),), (doc(1, "2024-01-02 09:00:00", 1),), (doc(3, "2024-01-01 09:00:00", 2),)], "doc string")
    assert {r.ref for r in posting.intake_sales(feed, products).collect()} == {1, 2, 3}
    assert {r.ref for r in sequential.intake_sales_sequential(feed, products).collect()} == {2, 3}
    refused = sequential.intake_rejects_sequential(feed, products).collect()
    assert [(r.ref, r.message) for r in refused] == [(1, "Not enough stock for tea (have 0, need 1)")]
    empty = spark.createDataFrame([], "doc string")
    assert sequential.intake_sales_sequential(empty, products).count() == 0


def test_purchases_refresh_cost_in_posting_order(spark, frame):
    products = frame("products", [{"id": 1, "name": "tea", "cost_price": 4, "quantity": 10}, {"id": 2, "name": "jam", "cost_price": 6, "quantity": 1}])
    docs = [
        {"ref": 1, "date": "2024-01-02 10:00:00", "discount": "5", "note": "by van", "items": [
            {"product_id": 1, "quantity": "2", "unit_cost": "10"}, {"product_id": 1, "quantity": "1", "unit_cost": "12"}]},
        {"ref": 2, "date": "2024-01-01 10:00:00", "items": [{"product_id": 1, "quantity": "5", "unit_cost": "99"}]},
        {"ref": 3, "date": "2024-01-09 10:00:00", "items": [{"product_id": 2, "quantity": "1", "unit_cost": "-1"}]},
    ]
    feed = spark.createDataFrame([(json.dumps(d),) for d in docs], "doc string")
    after = {r.product_id: (float(r.after), float(r.cost_after), r.lines) for r in posting.products_after_purchases(feed, products).collect()}
    assert after == {1: (18.0, 12.0, 3), 2: (1.0, 6.0, 0)}
    heads = {r.ref: (float(r.discount), float(r.total), r.note) for r in posting.intake_purchases(feed, products).collect()}
    assert heads == {1: (5.0, 27.0, "by van"), 2: (0.0, 495.0, None)}
    assert {r.ref: r.message for r in posting.purchase_rejects(feed, products).collect()} == {3: "Invalid cost for jam"}
