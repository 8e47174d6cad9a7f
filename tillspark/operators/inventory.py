"""Products and stock.

The category dimension is left-joined without a broadcast hint: Spark
broadcasts it on its own when its measured size is under the threshold and
falls back to a shuffle join otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import MONEY, TOTAL, csum, total
from ..functions.search import contains_any, like_any
from .prefix import running_sum


def with_category(products: DataFrame, categories: DataFrame) -> DataFrame:
    c = categories.select(F.col("id").alias("_cid"), F.col("name").alias("category_name"))
    return products.join(c, products.category_id == c._cid, "left").drop("_cid")


def product_list(products: DataFrame, categories: DataFrame, q: str | None = None) -> DataFrame:
    """Products by name with category, unit margin, stock values and stock flags."""
    p = with_category(products, categories)
    if q:
        p = p.filter(like_any(["name", "sku", "barcode", "category_name"], q))
    return p.select(
        *products.columns, "category_name",
        (F.col("selling_price") - F.col("cost_price")).cast(MONEY).alias("margin_per_unit"),
        total(F.col("quantity") * F.col("cost_price")).alias("stock_cost_value"),
        total(F.col("quantity") * F.col("selling_price")).alias("stock_retail_value"),
        (F.col("quantity") <= F.col("reorder_level")).alias("low_stock"),
        (F.col("quantity") > 0).alias("in_stock"),
        (F.col("quantity") >= 1).alias("can_add"),
    ).orderBy("name", "id")


def pos_product_search(products: DataFrame, categories: DataFrame, q: str | None) -> DataFrame:
    """The point-of-sale grid filter: literal lower-case substring on name, sku, barcode, category."""
    p = with_category(products, categories)
    p = p.filter(contains_any(["name", "sku", "barcode", "category_name"], q))
    return p.select("id", "name", "sku", "barcode", "category_name", "selling_price", "quantity",
                    (F.col("quantity") <= 0).alias("disabled")).orderBy("name", "id")


def code_index(products: DataFrame) -> DataFrame:
    """``(code, product_id)``: every barcode and SKU, first product id per code."""
    codes = products.select(
        "id", F.expr("stack(2, barcode, sku) AS code")
    ).filter(F.col("code").isNotNull())
    return codes.groupBy("code").agg(F.min("id").alias("product_id"))


def lookup_codes(scans: DataFrame, products: DataFrame, categories: DataFrame) -> DataFrame:
    """Resolve scanned codes ``(scan_id, code)`` to products by exact barcode or SKU.

    The index holds one row per distinct code (an aggregate over products),
    so a hot code costs one join row; AQE splits a skewed scan side.  It is joined
    with the products first, so the scans are joined once and unknown codes, which
    come back with a NULL product, stay spread by their text.
    """
    idx = code_index(products)
    p = with_category(products, categories).select(
        F.col("id").alias("product_id"), F.col("name"), "category_name", "selling_price", "quantity"
    )
    s = scans.withColumn("code", F.trim("code"))
    return s.join(idx.join(p, "product_id"), "code", "left").select(
        "scan_id", "code", "product_id", "name", "category_name", "selling_price", "quantity"
    )


def low_stock(products: DataFrame) -> DataFrame:
    """Products at or below their reorder level, fewest first."""
    return products.filter(F.col("quantity") <= F.col("reorder_level")).select(
        "id", "name", "sku", "quantity", "reorder_level"
    ).orderBy("quantity", "id")


def inventory_totals(products: DataFrame) -> DataFrame:
    """Count, units, cost and retail value, potential profit (D13): one row."""
    agg = products.agg(
        F.count(F.lit(1)).alias("product_count"),
        csum("quantity").alias("total_units"),
        csum(F.col("quantity") * F.col("cost_price")).alias("total_cost_value"),
        csum(F.col("quantity") * F.col("selling_price")).alias("total_retail_value"),
    )
    return agg.withColumn("potential_profit", (F.col("total_retail_value") - F.col("total_cost_value")).cast(TOTAL))


def inventory_by_category(products: DataFrame, categories: DataFrame) -> DataFrame:
    """Stock by category id, 'Uncategorized' for none, largest cost value first."""
    c = categories.select(F.col("id").alias("cid"), F.col("name").alias("cname"))
    j = products.join(c, products.category_id == c.cid, "left")
    agg = j.groupBy("cid", "cname").agg(
        F.count("id").alias("product_count"),
        csum("quantity").alias("units"),
        csum(F.col("quantity") * F.col("cost_price")).alias("cost_value"),
        csum(F.col("quantity") * F.col("selling_price")).alias("retail_value"),
    )
    return agg.select(
        F.col("cid").alias("category_id"), F.coalesce("cname", F.lit("Uncategorized")).alias("category"),
        "product_count", "units", "cost_value", "retail_value",
    ).orderBy(F.desc("cost_value"), "category_id")


def category_list(products: DataFrame, categories: DataFrame) -> DataFrame:
    """Every category, empty ones included, with product count, units and values."""
    per = products.filter(F.col("category_id").isNotNull()).groupBy("category_id").agg(
        F.count(F.lit(1)).alias("product_count"),
        F.sum("quantity").alias("total_units"),
        F.sum(F.col("quantity") * F.col("cost_price")).alias("stock_cost_value"),
        F.sum(F.col("quantity") * F.col("selling_price")).alias("stock_retail_value"),
    )
    j = categories.join(per, categories.id == per.category_id, "left")
    return j.select(
        categories.id, categories.name,
        F.coalesce("product_count", F.lit(0)).cast("long").alias("product_count"),
        *[total(F.coalesce(c, F.lit(0))).alias(c) for c in ("total_units", "stock_cost_value", "stock_retail_value")],
    ).orderBy("name", "id")


def inventory_kpis(products: DataFrame) -> DataFrame:
    """Dashboard inventory block; low_stock_count is a plain SUM, NULL without products."""
    return products.agg(
        csum(F.col("quantity") * F.col("cost_price")).alias("cost_value"),
        csum(F.col("quantity") * F.col("selling_price")).alias("retail_value"),
        F.count(F.lit(1)).alias("products"),
        F.sum(F.when(F.col("quantity") <= F.col("reorder_level"), 1).otherwise(0)).cast("long").alias("low_stock_count"),
    )


# Posting order of stock movements on one timestamp: receipts, restocks, then sales.
RANK_PURCHASE, RANK_RESTOCK, RANK_SALE = 0, 1, 2


def stock_movements(
    purchase_items: DataFrame, sale_items: DataFrame, sales: DataFrame, stock_adjustments: DataFrame
) -> DataFrame:
    """Union of signed stock movements ``(product_id, date, rank, ref, line_no, delta, source)``."""
    pur = purchase_items.select(
        "product_id", "date", F.lit(RANK_PURCHASE).alias("rank"), F.col("purchase_id").alias("ref"),
        F.col("line_no").cast("long").alias("line_no"), F.col("quantity").alias("delta"), F.lit("purchase").alias("source"),
    )
    sold = sale_items.drop("date").join(sales.select(F.col("id").alias("sale_id"), "date"), "sale_id").select(
        "product_id", "date", F.lit(RANK_SALE).alias("rank"), F.col("sale_id").alias("ref"),
        F.col("line_no").cast("long").alias("line_no"), (-F.col("quantity")).cast(MONEY).alias("delta"), F.lit("sale").alias("source"),
    )
    adj = stock_adjustments.select(
        "product_id", "date", F.lit(RANK_RESTOCK).alias("rank"), "ref", F.lit(0).cast("long").alias("line_no"),
        F.col("quantity").alias("delta"), F.lit("restock").alias("source"),
    )
    return pur.unionByName(sold).unionByName(adj).filter(F.col("product_id").isNotNull())


def stock_ledger(
    products: DataFrame, purchase_items: DataFrame, sale_items: DataFrame, sales: DataFrame,
    stock_adjustments: DataFrame,
) -> DataFrame:
    """Stock position after every movement, from the opening quantity.

    Running sum per product in (date, rank, ref, line, delta) order, scanned in
    ranges of rows so a best-selling product is not one task.
    """
    mv = stock_movements(purchase_items, sale_items, sales, stock_adjustments).drop("source")
    opening = products.select(F.col("id").alias("product_id"), F.col("quantity").alias("opening"))
    run = running_sum(mv, "delta", ["product_id"], ["date", "rank", "ref", "line_no", "delta"], "moved", per_key=opening)
    source = F.when(F.col("rank") == RANK_PURCHASE, "purchase").when(F.col("rank") == RANK_RESTOCK, "restock").otherwise("sale")
    return run.select(
        "product_id", "date", source.alias("source"), "ref", "line_no", "delta",
        total(F.coalesce("opening", F.lit(0)) + F.col("moved")).alias("position"),
    )


def latest_cost(purchase_items: DataFrame) -> DataFrame:
    """Cost of each product's latest posted purchase line (E7, S16): ``max_by`` over the posting order."""
    key = F.struct("date", "purchase_id", "line_no", "ref", "unit_cost")
    return purchase_items.groupBy("product_id").agg(
        F.max_by("unit_cost", key).alias("cost_price"), F.max("date").alias("last_purchase")
    )


def product_snapshot(
    products: DataFrame, purchase_items: DataFrame, sale_items: DataFrame, stock_adjustments: DataFrame
) -> DataFrame:
    """Products after all posted purchases, sales and restocks: quantity and refreshed cost (K4, K5)."""
    deltas = (
        purchase_items.select("product_id", F.col("quantity").alias("d"))
        .unionByName(sale_items.select("product_id", (-F.col("quantity")).alias("d")))
        .unionByName(stock_adjustments.select("product_id", F.col("quantity").alias("d")))
        .groupBy("product_id").agg(F.sum("d").alias("moved"))
    )
    cost = latest_cost(purchase_items).select("product_id", F.col("cost_price").alias("new_cost"))
    j = products.join(deltas, products.id == deltas.product_id, "left").drop("product_id")
    j = j.join(cost, j.id == cost.product_id, "left")
    return j.select(
        "id", "name",
        total(F.col("quantity") + F.coalesce("moved", F.lit(0))).alias("quantity"),
        F.coalesce("new_cost", "cost_price").alias("cost_price"),
        "selling_price",
    )
