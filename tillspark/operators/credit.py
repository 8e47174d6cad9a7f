"""Customer credit: repayments and receivables.

A repayment is clamped to what is still due, and the clamped amount is what
gets stored — possibly 0 (S11).  Sequentially, ``due_k = max(0, due_{k-1} -
amount_k)``, which with positive requests is ``max(0, due_0 - Σ_{j≤k}
amount_j)``; so the applied amount is

    applied_k = least(amount_k, greatest(0, due_0 - Σ_{j<k} amount_j))

— one exclusive running sum per sale, no loop; a reader of other columns does not pay for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import MONEY, csum
from ..functions.period import posted_at


def repayments_applied(sales: DataFrame, requests: DataFrame, as_of: str | None = None) -> DataFrame:
    """Clamp each repayment request ``(id, sale_id, seq, date, amount, method)`` to the due (E5).

    Requests are applied per sale in ``(date, seq)`` order against the sale's
    ``amount_due``.  Only amounts above 0 for known sales are applied; the others are ``repayment_rejects``.
    A request without a date is posted at ``as_of`` (H5).
    """
    requests = requests.withColumn("date", posted_at("date", as_of))
    req = requests.filter(F.col("amount") > 0).join(sales.select(F.col("id").alias("sale_id"), F.col("amount_due").alias("due0")), "sale_id")
    # a sale's repayments are as few as its document nests, and the join has brought them together
    earlier = Window.partitionBy("sale_id").orderBy("date", "seq").rowsBetween(Window.unboundedPreceding, -1)
    req = req.withColumn("_before", F.coalesce(F.sum("amount").over(earlier), F.lit(0)))
    left = F.greatest(F.lit(0).cast(MONEY), F.col("due0") - F.col("_before"))
    return req.select(
        "id", "sale_id", "seq", "date", "method",
        F.col("amount").alias("requested"),
        F.least(F.col("amount"), left).cast(MONEY).alias("applied"),
        left.cast(MONEY).alias("due_before"),
    )


def repayment_rejects(sales: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests that are not applied: an amount that is missing or not above 0, or an unknown sale (E5)."""
    known = sales.select(F.col("id").alias("sale_id"), F.lit(True).alias("_known"))
    bad_amount = ~F.coalesce(F.col("amount") > 0, F.lit(False))
    reason = F.when(bad_amount, F.lit("bad_amount")).when(F.col("_known").isNull(), F.lit("unknown_sale"))
    return requests.join(known, "sale_id", "left").withColumn("reason", reason).filter(F.col("reason").isNotNull()).select(
        "id", "sale_id", "seq", "date", "amount", "reason")


def payments_from_requests(sales: DataFrame, requests: DataFrame) -> DataFrame:
    """The payments table: first instalments of credit sales ∪ clamped repayments."""
    first = sales.filter((F.col("payment_type") == "credit") & (F.col("amount_paid") > 0)).select(
        (F.col("id") * 1000).alias("id"), F.col("id").alias("sale_id"), "date",
        F.col("amount_paid").alias("amount"), F.lit("Initial payment at sale").alias("note"),
        F.lit("cash").alias("method"),
    )
    rep = repayments_applied(sales, requests).select(
        "id", "sale_id", "date", F.col("applied").alias("amount"), F.lit("Repayment").alias("note"), "method"
    )
    return first.unionByName(rep)


def receivables_after(sales: DataFrame, requests: DataFrame) -> DataFrame:
    """Sales with repayments applied: paid +, due − (K6)."""
    applied = repayments_applied(sales, requests).groupBy("sale_id").agg(F.sum("applied").alias("_rep"))
    out = sales.join(applied, sales.id == applied.sale_id, "left").withColumn("_rep", F.coalesce("_rep", F.lit(0)))
    return out.select(
        "id", "invoice_no", "customer_name", "total",
        (F.col("amount_paid") + F.col("_rep")).cast(MONEY).alias("amount_paid"),
        (F.col("amount_due") - F.col("_rep")).cast(MONEY).alias("amount_due"),
        F.col("_rep").cast(MONEY).alias("repaid"),
    )


def outstanding(sales: DataFrame) -> DataFrame:
    return sales.filter(F.col("amount_due") > 0)


def receivables_total(sales: DataFrame) -> DataFrame:
    """One row: total due and number of unpaid invoices (D17, dashboard)."""
    return outstanding(sales).agg(csum("amount_due").alias("due"), F.count(F.lit(1)).alias("count"))


def receivables_list(sales: DataFrame) -> DataFrame:
    """Unpaid invoices oldest first, with the business columns only."""
    return outstanding(sales).select(
        "id", "invoice_no", "date", "customer_name", "total", "amount_paid", "amount_due"
    ).orderBy("date", "id")


def receivables_by_customer(sales: DataFrame) -> DataFrame:
    """What each customer owes, largest first."""
    return (
        outstanding(sales)
        .groupBy("customer_name")
        .agg(csum("amount_due").alias("due"), F.count(F.lit(1)).alias("invoices"), F.min("date").alias("oldest"))
        .orderBy(F.desc("due"), "customer_name")
    )
