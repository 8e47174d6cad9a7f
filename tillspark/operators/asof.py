"""As-of join: each sale line takes the product cost in force at the sale.

Public PySpark has no as-of join.  Sale lines and purchase lines of a product
are unioned into one sequence ordered by (date, purchases first, posting
order), and the last purchase cost is carried forward onto every sale line.
The carry runs in ranges of rows — a best-selling product's history is spread
over many tasks instead of one long window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import MONEY, total
from .prefix import carry_forward


def asof_cost(sale_items: DataFrame, sales: DataFrame, purchase_items: DataFrame) -> DataFrame:
    """Sale lines with ``cost_asof`` (latest purchase cost at or before the sale) and ``line_cost``."""
    lines = sale_items.drop("date").join(sales.select(F.col("id").alias("sale_id"), "date"), "sale_id").select(
        "product_id", "date", F.lit(1).alias("rank"), F.col("sale_id").alias("k1"), F.col("line_no").cast("long").alias("k2"),
        F.lit(0).cast("long").alias("k3"), F.col("quantity").alias("qc"),
        F.lit(None).cast(MONEY).alias("cost"), "sale_id", "line_no", "quantity",
    )
    buys = purchase_items.select(
        "product_id", "date", F.lit(0).alias("rank"), F.col("purchase_id").alias("k1"),
        F.col("line_no").cast("long").alias("k2"), F.col("ref").alias("k3"), F.col("unit_cost").alias("qc"),
        F.col("unit_cost").alias("cost"), F.lit(None).cast("long").alias("sale_id"),
        F.lit(None).cast("int").alias("line_no"), F.lit(None).cast(MONEY).alias("quantity"),
    )
    seq = lines.unionByName(buys).filter(F.col("product_id").isNotNull())
    filled = carry_forward(seq, "cost", ["product_id"], ["date", "rank", "k1", "k2", "k3", "qc"], "cost_asof")
    return filled.filter(F.col("rank") == 1).select(
        "sale_id", "line_no", "product_id", "date", "quantity", "cost_asof",
        total(F.col("quantity") * F.col("cost_asof")).alias("line_cost"),
    )
