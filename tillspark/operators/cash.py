"""Cash in the drawer: breakdown, on-hand, ledger, manual movements.

Cash in = cash sales + cash received on credit + cash added; cash out = cash
and credit purchases' paid part (S7) + cash supplier payments + cash expenses
+ cash removed.  Credit-sale cash comes only from ``payments`` (S8).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import MONEY, TOTAL, csum, to_number, total
from ..functions.period import posted_at
from .prefix import running_sum

# The breakdown's components, inflows first, in the reference's order.
COMPONENTS = (
    "cash_sales_in", "cash_repayments_in", "cash_added_in",
    "cash_purchases_out", "supplier_payments_out", "cash_expenses_out", "cash_removed_out",
)
INFLOWS = COMPONENTS[:3]


def cash_flows(
    sales: DataFrame, payments: DataFrame, purchases: DataFrame, supplier_payments: DataFrame,
    expenses: DataFrame, cash_adjustments: DataFrame,
) -> DataFrame:
    """Narrow union ``(component, amount)`` of every cash movement, amounts positive."""
    parts = [
        sales.filter(F.col("payment_type") == "cash").select(F.lit("cash_sales_in").alias("component"), F.col("amount_paid").alias("amount")),
        payments.filter(F.col("method") == "cash").select(F.lit("cash_repayments_in").alias("component"), "amount"),
        cash_adjustments.filter(F.col("amount") > 0).select(F.lit("cash_added_in").alias("component"), "amount"),
        purchases.filter(F.col("payment_type").isin("cash", "credit")).select(F.lit("cash_purchases_out").alias("component"), F.col("amount_paid").alias("amount")),
        supplier_payments.filter(F.col("method") == "cash").select(F.lit("supplier_payments_out").alias("component"), "amount"),
        expenses.filter(F.col("payment_method") == "cash").select(F.lit("cash_expenses_out").alias("component"), "amount"),
        cash_adjustments.filter(F.col("amount") < 0).select(F.lit("cash_removed_out").alias("component"), (-F.col("amount")).alias("amount")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("component", F.col("amount").cast(TOTAL).alias("amount"))


def cash_breakdown(*tables: DataFrame) -> DataFrame:
    """One row: seven components, totals in and out, cash on hand (D22).  One aggregate over one union."""
    flows = cash_flows(*tables)
    agg = flows.agg(*[csum(F.when(F.col("component") == c, F.col("amount"))).alias(c) for c in COMPONENTS])
    tin = sum((F.col(c) for c in INFLOWS), F.lit(0))
    tout = sum((F.col(c) for c in COMPONENTS[3:]), F.lit(0))
    return agg.select(
        *COMPONENTS, tin.cast(TOTAL).alias("total_in"), tout.cast(TOTAL).alias("total_out"),
        (tin - tout).cast(TOTAL).alias("cash_on_hand"),
    )


def cash_on_hand(*tables: DataFrame) -> DataFrame:
    """The cash-on-hand figure alone."""
    flows = cash_flows(*tables)
    signed = F.when(F.col("component").isin(*INFLOWS), F.col("amount")).otherwise(-F.col("amount"))
    return flows.agg(csum(signed).alias("cash_on_hand"))


def cash_entries(
    sales: DataFrame, payments: DataFrame, purchases: DataFrame, supplier_payments: DataFrame,
    expenses: DataFrame, cash_adjustments: DataFrame, suppliers: DataFrame,
) -> DataFrame:
    """The six sources mapped to ``(date, rank, id, label, in, out)``."""
    z = F.lit(0).cast(MONEY)

    def label(prefix: str, c):
        return F.trim(F.concat_ws(" ", F.lit(prefix), c))

    inv = sales.select(F.col("id").alias("sale_id"), "invoice_no")
    sup = suppliers.select(F.col("id").alias("supplier_id"), F.col("name").alias("supplier_name"))
    parts = [
        sales.filter((F.col("payment_type") == "cash") & (F.col("amount_paid") > 0)).select(
            "date", F.lit(0).alias("rank"), "id", label("Cash sale", F.col("invoice_no")).alias("label"),
            F.col("amount_paid").alias("in"), z.alias("out")),
        payments.filter(F.col("method") == "cash").join(inv, "sale_id").select(
            "date", F.lit(1).alias("rank"), "id", label("Cash received", F.col("invoice_no")).alias("label"),
            F.col("amount").alias("in"), z.alias("out")),
        purchases.filter(F.col("payment_type").isin("cash", "credit") & (F.col("amount_paid") > 0)).select(
            "date", F.lit(2).alias("rank"), "id", label("Cash paid on purchase", F.col("invoice_no")).alias("label"),
            z.alias("in"), F.col("amount_paid").alias("out")),
        supplier_payments.filter(F.col("method") == "cash").join(sup, "supplier_id", "left").select(
            "date", F.lit(3).alias("rank"), "id", label("Paid supplier", F.col("supplier_name")).alias("label"),
            z.alias("in"), F.col("amount").alias("out")),
        expenses.filter(F.col("payment_method") == "cash").select(
            "date", F.lit(4).alias("rank"), "id",
            F.concat(F.lit("Expense: "), F.coalesce("category", F.lit("null")),
                     F.when(F.coalesce(F.col("description"), F.lit("")) != "", F.concat(F.lit(" — "), "description")).otherwise(F.lit(""))).alias("label"),
            z.alias("in"), F.col("amount").alias("out")),
        cash_adjustments.select(
            "date", F.lit(5).alias("rank"), "id",
            F.coalesce(F.nullif("reason", F.lit("")), F.lit("Cash adjustment")).alias("label"),
            F.greatest(F.col("amount"), z).alias("in"), F.greatest(-F.col("amount"), z).alias("out")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("date", "rank", "id", "label", F.col("in").cast(MONEY).alias("in"), F.col("out").cast(MONEY).alias("out"))


def cash_ledger(*tables: DataFrame) -> DataFrame:
    """Every cash movement with the running drawer balance, newest first.

    The balance is a running sum with no partition key; it is scanned in ranges
    of the ledger's order, never in a single task.
    """
    return cash_balances(*tables).orderBy(F.desc("date"), F.desc("rank"), F.desc("id"))


def cash_balances(*tables: DataFrame) -> DataFrame:
    """The ledger's rows in no order."""
    return _balances(cash_entries(*tables))


def _balances(entries: DataFrame) -> DataFrame:
    run = running_sum(entries, F.col("in") - F.col("out"), [], ["date", "rank", "id"], "balance")
    return run.select(*entries.columns, total("balance").alias("balance"))


def cash_closing(*tables: DataFrame) -> DataFrame:
    """The balance of the ledger's last row; 0 without rows."""
    last = F.max_by("balance", F.struct("date", "rank", "id"))
    return _balances(cash_entries(*tables).drop("label")).agg(F.coalesce(last, F.lit(0)).alias("closing"))


def clean_adjustments(requests: DataFrame, as_of: str | None = None) -> DataFrame:
    """Manual cash movements from raw requests ``(id, date, amount, reason)``.

    The amount is read like ``Number()``; zero or unreadable amounts are
    rejected; a missing reason defaults by sign, a missing date to ``as_of``.
    """
    amt = to_number("amount")
    ok = requests.withColumn("_a", amt).filter(F.col("_a").isNotNull() & (F.col("_a") != 0))
    return ok.select(
        "id", posted_at("date", as_of).alias("date"), F.col("_a").cast(MONEY).alias("amount"),
        F.coalesce(F.nullif(F.col("reason"), F.lit("")),
                   F.when(F.col("_a") > 0, F.lit("Cash added")).otherwise(F.lit("Cash removed"))).alias("reason"),
    )
