"""Document sources: sale and purchase baskets as JSON.

A document is one JSON object per row, as the reference's POST bodies.  Numbers
are read as text and converted like JavaScript ``Number()`` (S24), so a
quantity sent as ``"3"`` or ``""`` behaves as in the reference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.money import to_number

S = T.StringType()

SALE_DOC = T.StructType([
    T.StructField("ref", T.LongType()),
    T.StructField("customer_name", S),
    T.StructField("payment_type", S),
    T.StructField("discount", S),
    T.StructField("amount_paid", S),
    T.StructField("paid_method", S),
    T.StructField("date", S),
    T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("product_id", T.LongType()),
        T.StructField("quantity", S),
        T.StructField("unit_price", S),
        T.StructField("line_discount", S),
    ]))),
])

PURCHASE_DOC = T.StructType([
    T.StructField("ref", T.LongType()),
    T.StructField("supplier_id", T.LongType()),
    T.StructField("payment_type", S),
    T.StructField("discount", S),
    T.StructField("amount_paid", S),
    T.StructField("note", S),
    T.StructField("date", S),
    T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("product_id", T.LongType()),
        T.StructField("quantity", S),
        T.StructField("unit_cost", S),
    ]))),
])


def parse_docs(docs: DataFrame, schema: T.StructType, col: str = "doc") -> DataFrame:
    """``from_json`` with an explicit schema: one parsed struct column ``d`` per document."""
    return docs.select(F.from_json(F.col(col), schema).alias("d")).select("d.*")


def read_docs(spark, path: str, schema: T.StructType) -> DataFrame:
    """Newline-delimited JSON documents from files, schema given (no inference)."""
    return spark.read.schema(schema).json(path)


def explode_lines(docs: DataFrame, header: list[str]) -> DataFrame:
    """One row per basket line with its position; an empty basket gives one row with NULL line (posexplode_outer)."""
    return docs.select(*header, F.posexplode_outer("items").alias("pos", "item"))


def sale_lines(docs: DataFrame) -> DataFrame:
    head = ["ref", "customer_name", "payment_type", "discount", "amount_paid", "paid_method", "date"]
    x = explode_lines(docs, head)
    return x.select(
        *head, "pos", F.col("item.product_id").alias("product_id"),
        to_number("item.quantity").alias("qty"),
        F.when(F.col("item.unit_price").isNull(), F.lit(None)).otherwise(to_number("item.unit_price")).alias("price_in"),
        to_number("item.line_discount").alias("ldisc_in"),
        (F.col("item.unit_price").isNotNull() & to_number("item.unit_price").isNull()).alias("price_junk"),
        F.col("item").isNull().alias("no_item"),
    )


def purchase_lines(docs: DataFrame) -> DataFrame:
    head = ["ref", "supplier_id", "payment_type", "discount", "amount_paid", "note", "date"]
    x = explode_lines(docs, head)
    return x.select(
        *head, "pos", F.col("item.product_id").alias("product_id"),
        to_number("item.quantity").alias("qty"),
        # a missing cost reads as NaN in the reference and is rejected: keep it NULL
        F.when(F.col("item.unit_cost").isNull(), F.lit(None)).otherwise(to_number("item.unit_cost")).alias("cost_num"),
        F.col("item").isNull().alias("no_item"),
    )
