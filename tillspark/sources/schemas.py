"""Table schemas of the retail data model (A7) and schema alignment.

Money and quantities are ``decimal(18,2)`` so that distributed sums do not
depend on the order rows arrive in; datetimes are ``timestamp_ntz`` (the
reference stores UTC wall-clock text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
TS = T.TimestampNTZType()


def _f(name, dtype, nullable=True):
    return T.StructField(name, dtype, nullable)


L, S = T.LongType(), T.StringType()

SCHEMAS: dict[str, T.StructType] = {
    "categories": T.StructType([_f("id", L, False), _f("name", S, False), _f("created_at", TS)]),
    "products": T.StructType([
        _f("id", L, False), _f("name", S, False), _f("sku", S), _f("barcode", S), _f("category_id", L),
        _f("cost_price", MONEY), _f("selling_price", MONEY), _f("quantity", MONEY),
        _f("reorder_level", MONEY), _f("created_at", TS),
    ]),
    "sales": T.StructType([
        _f("id", L, False), _f("invoice_no", S), _f("date", TS), _f("payment_type", S), _f("customer_name", S),
        _f("subtotal", MONEY), _f("discount", MONEY), _f("total", MONEY), _f("amount_paid", MONEY),
        _f("amount_due", MONEY), _f("created_at", TS),
    ]),
    "sale_items": T.StructType([
        _f("sale_id", L, False), _f("line_no", T.IntegerType()), _f("product_id", L), _f("product_name", S),
        _f("quantity", MONEY), _f("unit_price", MONEY), _f("unit_cost", MONEY), _f("line_total", MONEY),
        _f("line_discount", MONEY), _f("date", TS),
    ]),
    "payments": T.StructType([
        _f("id", L, False), _f("sale_id", L, False), _f("date", TS), _f("amount", MONEY), _f("note", S),
        _f("method", S),
    ]),
    "expenses": T.StructType([
        _f("id", L, False), _f("date", TS), _f("category", S), _f("amount", MONEY), _f("description", S),
        _f("created_at", TS), _f("payment_method", S),
    ]),
    "suppliers": T.StructType([
        _f("id", L, False), _f("name", S, False), _f("phone", S), _f("notes", S), _f("created_at", TS),
    ]),
    "purchases": T.StructType([
        _f("id", L, False), _f("invoice_no", S), _f("supplier_id", L), _f("date", TS), _f("payment_type", S),
        _f("subtotal", MONEY), _f("discount", MONEY), _f("total", MONEY), _f("amount_paid", MONEY),
        _f("amount_due", MONEY), _f("note", S), _f("created_at", TS),
    ]),
    "purchase_items": T.StructType([
        _f("purchase_id", L, False), _f("line_no", T.IntegerType()), _f("product_id", L), _f("product_name", S),
        _f("quantity", MONEY), _f("unit_cost", MONEY), _f("line_total", MONEY), _f("date", TS), _f("ref", L),
    ]),
    "stock_adjustments": T.StructType([
        _f("product_id", L), _f("date", TS), _f("quantity", MONEY), _f("ref", L),
    ]),
    "supplier_payments": T.StructType([
        _f("id", L, False), _f("supplier_id", L, False), _f("purchase_id", L), _f("date", TS),
        _f("amount", MONEY), _f("method", S), _f("note", S),
    ]),
    "cash_adjustments": T.StructType([
        _f("id", L, False), _f("date", TS), _f("amount", MONEY), _f("reason", S), _f("created_at", TS),
    ]),
}

# Column defaults of the reference's additive migrations and DDL.
DEFAULTS: dict[str, dict[str, object]] = {
    "products": {"barcode": None, "cost_price": 0, "selling_price": 0, "quantity": 0, "reorder_level": 5},
    "payments": {"method": "cash"},
    "expenses": {"category": "General", "payment_method": "cash"},
    "sale_items": {"line_discount": 0},
}


def empty_frame(spark: SparkSession, table: str) -> DataFrame:
    """An empty frame with the table's schema, used when a path is absent."""
    return spark.createDataFrame([], SCHEMAS[table])


# Partition columns of tables written by ``sinks.append_facts``; kept so that period filters prune.
PARTITIONS = ("month", "batch_id")


def read_table(spark: SparkSession, table: str, path: str) -> DataFrame:
    """Read one table with its declared schema and partition columns, or an empty frame if the path is missing."""
    try:
        df = spark.read.parquet(path)
    except Exception as exc:  # path absent → empty table, like CREATE TABLE IF NOT EXISTS
        if any(sign in str(exc) for sign in ("PATH_NOT_FOUND", "does not exist", "UNABLE_TO_INFER_SCHEMA")):
            return empty_frame(spark, table)
        raise
    if {"batch_id", "attempt"} <= set(df.columns):
        from .sinks import committed

        df = committed(df, path)
    return align_schema(df, table, keep=PARTITIONS)


def align_schema(df: DataFrame, table: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Add any missing column with its default and order/cast columns to the table schema.

    A column absent from ``df`` is filled with the migration default (or NULL); ``keep`` names
    further columns that stay if present;
    a NULL in a defaulted column that exists is left as it is, as in SQLite.
    """
    schema = SCHEMAS[table]
    defaults = DEFAULTS.get(table, {})
    present = set(df.columns)
    cols = []
    for field in schema.fields:
        if field.name in present:
            cols.append(F.col(field.name).cast(field.dataType).alias(field.name))
        else:
            default = defaults.get(field.name)
            cols.append(F.lit(default).cast(field.dataType).alias(field.name))
    return df.select(*cols, *[c for c in keep if c in present and c not in schema.names])
