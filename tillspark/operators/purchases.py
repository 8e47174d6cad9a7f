"""Purchases and what is owed to suppliers.

Per-purchase and per-supplier figures are grouped once and left-joined (the
decorrelated form of the reference's correlated subqueries).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import csum, total
from ..functions.search import like_any


def purchase_list(
    purchases: DataFrame, suppliers: DataFrame, purchase_items: DataFrame, q: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Purchases newest first with supplier name and item count."""
    s = suppliers.select(F.col("id").alias("_sid"), F.col("name").alias("supplier_name"))
    p = purchases.join(s, purchases.supplier_id == s._sid, "left").drop("_sid")
    if q:
        p = p.filter(like_any(["invoice_no", "supplier_name"], q))
    if limit is not None and limit >= 0:
        p = p.orderBy(F.desc("date"), F.desc("id")).limit(limit)
    if q or limit is not None and limit >= 0:  # only the chosen documents' lines are aggregated
        purchase_items = purchase_items.join(p.select(F.col("id").alias("purchase_id")), "purchase_id", "left_semi")
    items = purchase_items.groupBy("purchase_id").agg(F.sum("quantity").alias("_n"))
    out = p.join(items, p.id == items.purchase_id, "left").select(
        *purchases.columns, "supplier_name", total(F.coalesce("_n", F.lit(0))).alias("item_count")
    ).orderBy(F.desc("date"), F.desc("id"))
    return out


def payables_total(purchases: DataFrame) -> DataFrame:
    """Dashboard payables: due and count over purchases with a balance, supplier-less ones too."""
    return purchases.filter(F.col("amount_due") > 0).agg(
        csum("amount_due").alias("total_payable"), F.count(F.lit(1)).alias("count")
    )


def payables_summary(suppliers: DataFrame, purchases: DataFrame) -> DataFrame:
    """One row: what is owed to known suppliers in all, and to how many."""
    owed = payables_by_supplier(suppliers, purchases)
    return owed.agg(csum("payable").alias("total_payable"), F.count(F.lit(1)).alias("suppliers"))


def payables_by_supplier(suppliers: DataFrame, purchases: DataFrame) -> DataFrame:
    """What is owed to each supplier with a balance, largest first."""
    due = purchases.filter(F.col("amount_due") > 0).groupBy("supplier_id").agg(
        F.sum("amount_due").alias("_due"), F.count(F.lit(1)).alias("open_purchases")
    )
    j = suppliers.join(due, suppliers.id == due.supplier_id, "inner")
    return j.select("id", "name", "phone", total("_due").alias("payable"), "open_purchases").orderBy(
        F.desc("payable"), "id"
    )


def supplier_list(suppliers: DataFrame, purchases: DataFrame, q: str | None = None) -> DataFrame:
    """Suppliers by name with payable and total purchased."""
    s = suppliers.filter(like_any(["name", "phone"], q)) if q else suppliers
    per = purchases.groupBy("supplier_id").agg(F.sum("amount_due").alias("_due"), F.sum("total").alias("_tot"))
    j = s.join(per, s.id == per.supplier_id, "left")
    return j.select(
        *[s[c] for c in suppliers.columns],
        total(F.coalesce("_due", F.lit(0))).alias("payable"),
        total(F.coalesce("_tot", F.lit(0))).alias("total_purchased"),
    ).orderBy("name", "id")
