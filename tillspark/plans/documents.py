"""Documents: sale/purchase records with nested lines, and printable invoice lines (C11, M3, M4, H7).

Nesting is ``groupBy(doc).agg(sort_array(collect_list(struct)))`` — bounded
by one document's lines or payments, never by a whole history — done for all
documents at once and joined to the headers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import MONEY, TOTAL


def sale_documents(sales: DataFrame, sale_items: DataFrame, payments: DataFrame) -> DataFrame:
    """Every sale with ``items[]`` (line order) and ``payments[]`` (date order) (C11)."""
    items = sale_items.groupBy("sale_id").agg(F.sort_array(F.collect_list(F.struct(
        "line_no", "product_id", "product_name", "quantity", "unit_price", "unit_cost", "line_discount", "line_total",
    ))).alias("items"))
    pays = payments.groupBy("sale_id").agg(F.sort_array(F.collect_list(F.struct(
        "date", "id", "amount", "method", "note"))).alias("payments"))
    s = sales.join(items, sales.id == items.sale_id, "left").drop("sale_id")
    s = s.join(pays, s.id == pays.sale_id, "left").drop("sale_id")
    return s.withColumn("items", F.coalesce("items", F.array())).withColumn("payments", F.coalesce("payments", F.array()))


def purchase_documents(purchases: DataFrame, suppliers: DataFrame, purchase_items: DataFrame) -> DataFrame:
    """Every purchase with supplier name/phone and ``items[]``."""
    items = purchase_items.groupBy("purchase_id").agg(F.sort_array(F.collect_list(F.struct(
        "line_no", "ref", "product_id", "product_name", "quantity", "unit_cost", "line_total"))).alias("items"))
    sup = suppliers.select(F.col("id").alias("_sid"), F.col("name").alias("supplier_name"), F.col("phone").alias("supplier_phone"))
    p = purchases.join(sup, purchases.supplier_id == sup._sid, "left").drop("_sid")
    p = p.join(items, p.id == items.purchase_id, "left").drop("purchase_id")
    return p.withColumn("items", F.coalesce("items", F.array()))


def document_totals(docs: DataFrame, lines_col: str, amount_field: str, extra: dict | None = None) -> DataFrame:
    """Flat check of nested documents: counts and sums taken from inside the arrays (higher-order functions)."""
    agg = F.aggregate(F.col(lines_col), F.lit(0).cast(TOTAL), lambda acc, x: acc + x[amount_field])
    cols = [F.size(lines_col).cast("long").alias(f"{lines_col}_count"), agg.alias(f"{lines_col}_{amount_field}")]
    for name, expr in (extra or {}).items():
        cols.append(expr.alias(name))
    return docs.select("id", "invoice_no", *cols)


def invoice_lines(sales: DataFrame, sale_items: DataFrame) -> DataFrame:
    """Printable sale invoices as rows ``(sale_id, section, seq, label, …)`` for all sales (M3, H7).

    Item rows (line order, numbered inside each invoice) followed by the
    totals block: Subtotal, Discount (negative), Total, Paid, Balance due.
    """
    w = Window.partitionBy("sale_id").orderBy("line_no", "product_id", "quantity", "line_total", "line_discount")
    items = sale_items.select(
        "sale_id", F.lit("item").alias("section"), F.row_number().over(w).cast("long").alias("seq"),
        F.col("product_name").alias("label"), "quantity", "unit_price",
        F.when(F.col("line_discount") != 0, -F.col("line_discount")).cast(MONEY).alias("discount"),
        F.col("line_total").cast(TOTAL).alias("amount"),
    )
    head = sales.select(
        F.col("id").alias("sale_id"),
        F.expr(
            "stack(5, 1L, 'Subtotal', subtotal, 2L, 'Discount', -discount, 3L, 'Total', total,"
            " 4L, 'Paid', amount_paid, 5L, 'Balance due', amount_due) AS (seq, label, amount)"
        ),
    ).select(
        "sale_id", F.lit("total").alias("section"), "seq", "label", F.lit(None).cast(MONEY).alias("quantity"),
        F.lit(None).cast(MONEY).alias("unit_price"), F.lit(None).cast(MONEY).alias("discount"),
        F.col("amount").cast(TOTAL).alias("amount"),
    )
    info = sales.select(
        F.col("id").alias("sale_id"), "invoice_no",
        F.date_format("date", "yyyy-MM-dd HH:mm").alias("doc_date"),
        F.coalesce(F.concat(F.lit("Customer: "), "customer_name"), F.lit("Walk-in customer")).alias("party"),
    )
    return items.unionByName(head).join(info, "sale_id")


def purchase_invoice_lines(purchases: DataFrame, suppliers: DataFrame, purchase_items: DataFrame) -> DataFrame:
    """Printable purchase invoices; Paid is shown as total − due (M4)."""
    w = Window.partitionBy("purchase_id").orderBy("line_no", "ref", "product_id", "quantity", "unit_cost")
    items = purchase_items.select(
        "purchase_id", F.lit("item").alias("section"), F.row_number().over(w).cast("long").alias("seq"),
        F.col("product_name").alias("label"), "quantity", F.col("unit_cost").alias("unit_price"),
        F.col("line_total").cast(TOTAL).alias("amount"),
    )
    head = purchases.select(
        F.col("id").alias("purchase_id"),
        F.expr(
            "stack(5, 1L, 'Subtotal', subtotal, 2L, 'Discount', -discount, 3L, 'Total', total,"
            " 4L, 'Paid', CAST(total - amount_due AS DECIMAL(18,2)), 5L, 'Balance owed', amount_due) AS (seq, label, amount)"
        ),
    ).select(
        "purchase_id", F.lit("total").alias("section"), "seq", "label", F.lit(None).cast(MONEY).alias("quantity"),
        F.lit(None).cast(MONEY).alias("unit_price"), F.col("amount").cast(TOTAL).alias("amount"),
    )
    sup = suppliers.select(F.col("id").alias("supplier_id"), F.col("name").alias("sname"), F.col("phone").alias("sphone"))
    info = purchases.join(sup, "supplier_id", "left").select(
        F.col("id").alias("purchase_id"), "invoice_no", F.date_format("date", "yyyy-MM-dd HH:mm").alias("doc_date"),
        F.concat(F.lit("Supplier: "), F.coalesce("sname", F.lit("—")),
                 F.when(F.coalesce("sphone", F.lit("")) != "", F.concat(F.lit(" · "), "sphone")).otherwise(F.lit(""))
                 ).alias("party"),
    )
    return items.unionByName(head).join(info, "purchase_id")
