"""Dashboard record, plain-language summary and chart feed.

The dashboard's figures are one-row aggregates.  They are combined without a
cross join: each is padded to the union of all columns, the frames are
unioned, and one global ``first(ignorenulls)`` aggregate folds them into a
single row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import js_round, money_text, plural
from ..functions.period import Period


def one_row(frames: dict[str, DataFrame]) -> DataFrame:
    """Fold one-row frames into one row, each frame's columns kept under its name as a struct."""
    parts = [df.select(F.struct(*df.columns).alias(name)) for name, df in frames.items()]
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return u.agg(*[F.first(name, ignorenulls=True).alias(name) for name in frames])


# The summary sentences of the reference, in order.
NO_SALES = ("No sales recorded in this period yet. Once you start ringing up sales, your profit, cash, "
            "and trends will appear here.")


def summary_text(currency: str = "Rs") -> F.Column:
    """The 1–7 sentence store summary over a folded dashboard row (M1)."""
    p, tp = F.col("period"), F.col("top")
    rec, pay, inv, cash = F.col("receivables"), F.col("payables"), F.col("inventory"), F.col("cash.cash_on_hand")

    def m(c):
        return money_text(c, currency)

    n = p["order_count"]
    first = F.when(n == 0, F.lit(NO_SALES)).otherwise(F.concat(
        F.lit("You made "), n.cast("string"), F.lit(" sale"), plural(n, "", "s"), F.lit(" totalling "), m(p["revenue"]),
        F.lit(", for "), F.when(p["is_loss"], F.lit("a loss")).otherwise(F.lit("a profit")), F.lit(" of "),
        m(F.abs(p["net_profit"])), F.lit(" after costs and expenses ("),
        F.format_string("%.0f", p["net_margin_pct"]), F.lit("% margin)."),
    ))
    loss = F.when((n != 0) & p["is_loss"], F.concat(
        F.lit("Expenses ("), m(p["expenses"]), F.lit(") are eating into your gross profit of "), m(p["gross_profit"]),
        F.lit(" — worth reviewing where the money is going."),
    ))
    top = F.when(tp.isNotNull() & tp["name"].isNotNull(), F.concat(
        F.lit("Your best earner is "), tp["name"], F.lit(", bringing in "), m(tp["profit"]), F.lit(" profit.")))
    cash_s = F.when(cash.isNotNull(), F.concat(F.lit("You have about "), m(cash), F.lit(" cash in hand.")))
    rec_s = F.when(rec["due"] > 0, F.concat(
        F.lit("Customers owe you "), m(rec["due"]), F.lit(" across "), rec["count"].cast("string"),
        F.lit(" unpaid invoice"), plural(rec["count"], "", "s"), F.lit(".")))
    pay_s = F.when(pay["total_payable"] > 0, F.concat(F.lit("You owe suppliers "), m(pay["total_payable"]), F.lit(".")))
    low = inv["low_stock_count"]
    low_s = F.when(low > 0, F.concat(low.cast("string"), F.lit(" item"), plural(low, " is", "s are"),
                                     F.lit(" low on stock and may need reordering.")))
    return F.concat_ws(" ", first, loss, top, cash_s, rec_s, pay_s, low_s)


def dashboard(
    period_kpis: DataFrame, today_kpis: DataFrame, receivables: DataFrame, payables: DataFrame,
    inventory: DataFrame, cash: DataFrame, top: DataFrame, rng: Period, currency: str = "Rs",
) -> DataFrame:
    """The dashboard record as one row of structs plus the summary (M2)."""
    row = one_row({
        "period": period_kpis, "today": today_kpis, "receivables": receivables, "payables": payables,
        "inventory": inventory, "cash": cash, "top": top,
    })
    return row.select(
        F.struct(F.lit(f"{rng[0]} 00:00:00").alias("from"), F.lit(f"{rng[1]} 23:59:59").alias("to")).alias("range"),
        "period", "today", "receivables", "payables", "inventory",
        F.col("cash.cash_on_hand").alias("cash_on_hand"), summary_text(currency).alias("summary"),
    )


def dashboard_json(dash: DataFrame) -> DataFrame:
    """The dashboard as one JSON document."""
    return dash.select(F.to_json(F.struct(*dash.columns)).alias("json"))


def chart_feed(period_sales: DataFrame, inventory_by_category: DataFrame, expense_breakdown: DataFrame) -> DataFrame:
    """Long ``(chart, label, value)`` rows for the dashboard charts.

    Cash and card are kept apart (the page labels cash-only 'Cash / Card').
    """
    pay = period_sales.select(F.expr(
        "stack(3, 'Cash', cash_sales, 'Card', card_sales, 'Credit', credit_sales) AS (label, value)"
    )).select(F.lit("sales_split").alias("chart"), "label", F.col("value").cast("decimal(38,2)").alias("value"))
    inv = inventory_by_category.select(F.lit("inventory_value").alias("chart"), F.col("category").alias("label"),
                                       F.col("cost_value").cast("decimal(38,2)").alias("value"))
    exp = expense_breakdown.select(F.lit("expenses").alias("chart"), F.col("category").alias("label"),
                                   F.col("total").cast("decimal(38,2)").alias("value"))
    return pay.unionByName(inv).unionByName(exp)


__all__ = ["chart_feed", "dashboard", "dashboard_json", "js_round", "one_row", "summary_text"]
