"""Sales lists, search, best sellers and document numbers.

Per-sale figures (item count, COGS, profit) are one ``groupBy(sale_id)`` over
the lines joined back to the sales — the decorrelated form of the
reference's three correlated subqueries, computed once rather than twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import TOTAL, nsum, total
from ..functions.period import Period, in_period
from ..functions.search import like_any
from .prefix import running_sum


def per_sale_lines(sale_items: DataFrame) -> DataFrame:
    """``(sale_id, item_count, cogs)`` per sale — partial aggregation before any join."""
    return sale_items.groupBy("sale_id").agg(
        F.sum("quantity").alias("item_count"), F.sum(F.col("unit_cost") * F.col("quantity")).alias("cogs")
    )


def sale_list(sales: DataFrame, sale_items: DataFrame, q: str | None = None, limit: int | None = None) -> DataFrame:
    """Sales newest first with item_count, cogs and profit (M6, B4); optional search and top-n.

    A negative or missing limit means all rows (SQLite's ``LIMIT -1``).  With a search or a limit the
    documents are chosen first, and only their lines are aggregated.
    """
    s = sales.filter(like_any(["invoice_no", "customer_name"], q)) if q else sales
    if limit is not None and limit >= 0:
        s = s.orderBy(F.desc("date"), F.desc("id")).limit(limit)
    chosen = q or limit is not None and limit >= 0
    lines = sale_items.join(s.select(F.col("id").alias("sale_id")), "sale_id", "left_semi") if chosen else sale_items
    agg = per_sale_lines(lines)
    out = s.join(agg, s.id == agg.sale_id, "left").select(
        *[s[c] for c in sales.columns],
        total(F.coalesce(agg.item_count, F.lit(0))).alias("item_count"),
        total(F.coalesce(agg.cogs, F.lit(0))).alias("cogs"),
    ).withColumn("profit", (F.col("total") - F.col("cogs")).cast(TOTAL))
    return out.orderBy(F.desc("date"), F.desc("id"))


def sales_in_period(sales: DataFrame, rng: Period) -> DataFrame:
    """The period's sales, key columns only (B1)."""
    return in_period(sales, rng).select("id", "invoice_no", "date", "payment_type", "total")


def top_products(sales: DataFrame, sale_items: DataFrame, rng: Period, n: int = 10) -> DataFrame:
    """Best sellers by line revenue: units, revenue, profit before discount.

    Grouped by the product-name snapshot on the lines.  ``orderBy().limit()``
    plans as TakeOrderedAndProject: each partition keeps its own top n.
    """
    s = in_period(sales, rng).select(F.col("id").alias("sale_id"))
    lines = sale_items.join(s, "sale_id")
    agg = lines.groupBy("product_name").agg(
        nsum("quantity").alias("units_sold"),
        nsum("line_total").alias("revenue"),
        nsum((F.col("unit_price") - F.col("unit_cost")) * F.col("quantity")).alias("profit"),
    )
    return agg.orderBy(F.desc("revenue"), "product_name").limit(n)


def top_earner(sales: DataFrame, sale_items: DataFrame, rng: Period) -> DataFrame:
    """The single best earner by profit after line discounts."""
    s = in_period(sales, rng).select(F.col("id").alias("sale_id"))
    lines = sale_items.join(s, "sale_id")
    agg = lines.groupBy(F.col("product_name").alias("name")).agg(
        nsum((F.col("unit_price") - F.col("unit_cost")) * F.col("quantity") - F.col("line_discount")).alias("profit")
    )
    return agg.orderBy(F.desc("profit"), "name").limit(1)


def invoice_numbers(sales: DataFrame, purchases: DataFrame) -> DataFrame:
    """Deterministic document numbers ``INV-yyyyMMdd-nnnn`` / ``PUR-…``.

    Numbered within each day by id.  The count runs through the two-phase
    scan, so a day holding a large share of documents is still numbered by many tasks.
    """
    docs = sales.select(F.lit("INV").alias("prefix"), "id", "date").unionByName(
        purchases.select(F.lit("PUR").alias("prefix"), "id", "date")
    ).withColumn("day", F.to_date("date"))
    numbered = running_sum(docs, F.lit(1).cast("long"), ["prefix", "day"], ["id"], "seq")
    return numbered.select(
        "prefix", "id", "date",
        F.concat_ws("-", "prefix", F.date_format("date", "yyyyMMdd"), F.format_string("%04d", F.col("seq")))
        .alias("number"),
        F.col("seq").cast("long").alias("seq"),
    )
