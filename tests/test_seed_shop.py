"""Goldens from the reference's 11-product seed shop (FIXTURES.md §3)."""

from __future__ import annotations

import pytest

from tillspark.operators import inventory, pnl

# The reference seed's products (name, sku, category, cost, sell, quantity, reorder) and expenses.
SEED_PRODUCTS = [
    ("Rice 5kg", "GR-001", "Groceries", 900, 1150, 40, 10),
    ("Cooking Oil 1L", "GR-002", "Groceries", 420, 520, 25, 10),
    ("Sugar 1kg", "GR-003", "Groceries", 130, 165, 8, 10),
    ("Cola 1.5L", "BV-001", "Beverages", 120, 170, 60, 15),
    ("Mineral Water 1L", "BV-002", "Beverages", 40, 70, 100, 20),
    ("Potato Chips", "SN-001", "Snacks", 45, 80, 70, 20),
    ("Biscuits Pack", "SN-002", "Snacks", 60, 95, 5, 15),
    ("Dish Soap", "HH-001", "Household", 140, 195, 30, 10),
    ("Detergent 1kg", "HH-002", "Household", 260, 340, 18, 10),
    ("Shampoo 200ml", "PC-001", "Personal Care", 180, 260, 22, 8),
    ("Toothpaste", "PC-002", "Personal Care", 95, 150, 3, 8),
]
SEED_CATEGORIES = ["Groceries", "Beverages", "Snacks", "Household", "Personal Care"]
SEED_EXPENSES = [
    ("Rent", 35000, "Monthly shop rent"), ("Salaries", 22000, "Staff salary"), ("Utilities", 6500, "Electricity bill"),
    ("Utilities", 1800, "Water bill"), ("Transport", 2400, "Delivery van fuel"),
]


@pytest.fixture(scope="module")
def shop(frame):
    cats = frame("categories", [{"id": i + 1, "name": n} for i, n in enumerate(SEED_CATEGORIES)])
    cid = {n: i + 1 for i, n in enumerate(SEED_CATEGORIES)}
    prods = frame("products", [
        {"id": i + 1, "name": n, "sku": s, "category_id": cid[c], "cost_price": cp, "selling_price": sp,
         "quantity": q, "reorder_level": r}
        for i, (n, s, c, cp, sp, q, r) in enumerate(SEED_PRODUCTS)
    ])
    exps = frame("expenses", [
        {"id": i + 1, "date": f"2024-05-{i + 10} 09:00:00", "category": c, "amount": a, "description": d}
        for i, (c, a, d) in enumerate(SEED_EXPENSES)
    ])
    return cats, prods, exps


def test_inventory_totals(shop):
    _, prods, _ = shop
    r = inventory.inventory_totals(prods).collect()[0]
    assert r.product_count == 11
    assert float(r.total_units) == 381
    assert float(r.total_cost_value) == 75315
    assert float(r.total_retail_value) == 101735
    assert float(r.potential_profit) == 26420


def test_low_stock_order(shop):
    _, prods, _ = shop
    got = [(r.name, float(r.quantity)) for r in inventory.low_stock(prods).collect()]
    assert got == [("Toothpaste", 3.0), ("Biscuits Pack", 5.0), ("Sugar 1kg", 8.0)]


def test_expenses(shop):
    _, _, exps = shop
    rows = {r.category: (r["count"], float(r.total)) for r in pnl.expense_breakdown(exps, ("2024-05-01", "2024-05-31")).collect()}
    assert sum(t for _, t in rows.values()) == 67700
    assert rows["Utilities"] == (2, 8300.0)


def test_category_list_keeps_empty(shop, frame):
    cats, prods, _ = shop
    cats = cats.unionByName(frame("categories", [{"id": 99, "name": "Empty"}]))
    got = {r.name: (r.product_count, float(r.total_units)) for r in inventory.category_list(prods, cats).collect()}
    assert got["Empty"] == (0, 0.0)
    assert got["Groceries"] == (3, 73.0)
