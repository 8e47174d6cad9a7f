"""Expenses: search, intake, edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import MONEY, to_number
from ..functions.period import Period, in_period, ntz
from ..functions.search import like_any


def search_expenses(expenses: DataFrame, rng: Period, q: str | None) -> DataFrame:
    """Expenses of the period matching ``q`` in category or description, newest first."""
    e = in_period(expenses, rng).filter(like_any(["category", "description"], q))
    return e.orderBy(F.desc("date"), F.desc("id"))


def clean_expenses(requests: DataFrame, as_of: str) -> DataFrame:
    """Expense intake (K11): amount must read as > 0; category defaults to 'General',
    a missing payment method to 'cash' (an empty one stays), description '' to NULL, a missing date to ``as_of``.

    A JSON null and an absent field are the same in a DataFrame; both take the default.
    """
    amt = to_number("amount")
    ok = requests.withColumn("_a", amt).filter(F.col("_a").isNotNull() & (F.col("_a") > 0))
    return ok.select(
        "id",
        F.coalesce(F.col("date"), ntz(f"{as_of[:10]} 00:00:00")).alias("date"),
        F.coalesce(F.col("category"), F.lit("General")).alias("category"),
        F.col("_a").cast(MONEY).alias("amount"),
        F.nullif(F.col("description"), F.lit("")).alias("description"),
        F.coalesce(F.col("payment_method"), F.lit("cash")).alias("payment_method"),
    )


def merge_expenses(expenses: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply edits ``(id, category, amount, description, date, payment_method)`` (K9).

    Every field is replaced except a NULL payment method, which keeps the old
    one.  The latest edit per id wins when ``edits`` has an ``seq`` column.
    """
    if "seq" in edits.columns:
        edits = edits.groupBy("id").agg(F.max_by(F.struct(*[c for c in edits.columns if c not in ("id",)]), "seq").alias("_e")).select("id", "_e.*").drop("seq")
    e = edits.select(
        "id", F.col("category").alias("n_category"), to_number("amount").cast(MONEY).alias("n_amount"),
        F.nullif(F.col("description"), F.lit("")).alias("n_description"), F.col("date").alias("n_date"),
        F.nullif(F.col("payment_method"), F.lit("")).alias("n_method"), F.lit(True).alias("_hit"),
    )
    j = expenses.join(e, "id", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    return j.select(
        "id",
        F.when(hit, F.col("n_date")).otherwise(F.col("date")).alias("date"),
        F.when(hit, F.col("n_category")).otherwise(F.col("category")).alias("category"),
        F.when(hit, F.col("n_amount")).otherwise(F.col("amount")).alias("amount"),
        F.when(hit, F.col("n_description")).otherwise(F.col("description")).alias("description"),
        F.when(hit, F.coalesce("n_method", "payment_method")).otherwise(F.col("payment_method")).alias("payment_method"),
        hit.alias("edited"),
    )
