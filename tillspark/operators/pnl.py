"""Period reporting: KPIs, P&L statement, expense breakdown, time series.

Every period report reads each fact once: the facts are narrowed to
``(kind, value, payment_type)`` rows, unioned, and reduced by a single
conditional aggregate (partial aggregation on each partition, one tiny final
merge).  P&L revenue is ``SUM(sales.total)`` (after order discounts, S5);
COGS is ``Σ unit_cost × quantity`` over the lines of the period's sales.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import TOTAL, csum, nsum, pct, total
from .prefix import running_sum
from ..functions.period import Period, in_period, tag_presets

TENDERS = ("cash", "card", "credit")  # fixed values: payment types of a sale (S18)


def period_facts(sales: DataFrame, sale_items: DataFrame, expenses: DataFrame, rng: Period | None) -> DataFrame:
    """Narrow union ``(kind, v, payment_type, date)`` of sale totals, line costs and expenses."""
    s = sales if rng is None else in_period(sales, rng)
    sale_rows = s.select(F.lit("sale").alias("kind"), F.col("total").cast(TOTAL).alias("v"), "payment_type", "date")
    lines = sale_items.select("sale_id", (F.col("unit_cost") * F.col("quantity")).alias("v"))
    cogs_rows = lines.join(s.select(F.col("id").alias("sale_id"), "date"), "sale_id").select(
        F.lit("cogs").alias("kind"), F.col("v").cast("decimal(38,4)").alias("v"), F.lit(None).cast("string").alias("payment_type"), "date"
    )
    e = expenses if rng is None else in_period(expenses, rng)
    exp_rows = e.select(F.lit("exp").alias("kind"), F.col("amount").cast(TOTAL).alias("v"), F.lit(None).cast("string").alias("payment_type"), "date")
    return sale_rows.unionByName(cogs_rows).unionByName(exp_rows)


def _kpi_aggs() -> list:
    k, v, pt = F.col("kind"), F.col("v"), F.col("payment_type")
    sale = k == "sale"
    return [
        csum(F.when(sale, v)).alias("revenue"),
        csum(F.when(k == "cogs", v)).alias("cogs"),
        csum(F.when(k == "exp", v)).alias("expenses"),
        csum(F.when(sale & (pt == "credit"), v)).alias("credit_sales"),
        csum(F.when(sale & (pt == "cash"), v)).alias("cash_sales"),
        csum(F.when(sale & (pt == "card"), v)).alias("card_sales"),
        F.count(F.when(sale, F.lit(1))).alias("order_count"),
    ]


def _kpi_columns(df: DataFrame, keys: list[str]) -> DataFrame:
    gross = (F.col("revenue") - F.col("cogs")).cast(TOTAL)
    net = (F.col("revenue") - F.col("cogs") - F.col("expenses")).cast(TOTAL)
    return df.select(
        *keys, "revenue", "cogs", gross.alias("gross_profit"), "expenses", net.alias("net_profit"),
        (net < 0).alias("is_loss"), "credit_sales", "cash_sales", "card_sales", "order_count",
        pct(gross, "revenue").alias("gross_margin_pct"), pct(net, "revenue").alias("net_margin_pct"),
    )


def period_kpis(sales: DataFrame, sale_items: DataFrame, expenses: DataFrame, rng: Period) -> DataFrame:
    """The dashboard KPI record for one period (D1–D4, S23): one row."""
    agg = period_facts(sales, sale_items, expenses, rng).agg(*_kpi_aggs())
    return _kpi_columns(agg, [])


def period_sales(sales: DataFrame, rng: Period) -> DataFrame:
    """Revenue, tender split and order count of a period (D1): one row."""
    s = in_period(sales, rng)
    pt, t = F.col("payment_type"), F.col("total")
    return s.agg(
        csum(t).alias("revenue"),
        csum(F.when(pt == "credit", t)).alias("credit_sales"),
        csum(F.when(pt == "cash", t)).alias("cash_sales"),
        csum(F.when(pt == "card", t)).alias("card_sales"),
        F.count(F.lit(1)).alias("order_count"),
    )


def cogs_period(sales: DataFrame, sale_items: DataFrame, rng: Period) -> DataFrame:
    """Cost of goods sold over the lines of the period's sales (D2, C3): one row."""
    s = in_period(sales, rng).select(F.col("id").alias("sale_id"))
    lines = sale_items.join(s, "sale_id")
    return lines.agg(
        csum(F.col("unit_cost") * F.col("quantity")).alias("cogs"),
        F.count(F.lit(1)).alias("lines"),
        csum("quantity").alias("units"),
    )


def kpis_all_presets(
    spark: SparkSession, sales: DataFrame, sale_items: DataFrame, expenses: DataFrame, as_of: str
) -> DataFrame:
    """KPIs for today / 7d / 30d / month / year in one pass over the facts."""
    facts = period_facts(sales, sale_items, expenses, None)
    tagged = tag_presets(facts, spark, as_of)
    agg = tagged.groupBy("preset").agg(*_kpi_aggs())
    return _kpi_columns(agg, ["preset"])


def kpis_for_ranges(
    spark: SparkSession, sales: DataFrame, sale_items: DataFrame, expenses: DataFrame, ranges: dict[str, Period]
) -> DataFrame:
    """KPI rows for several named periods from one pass over the facts (keyed by ``preset``)."""
    from ..functions.period import tag_ranges

    facts = period_facts(sales, sale_items, expenses, None)
    tagged = tag_ranges(facts, spark, [(k, a, b) for k, (a, b) in ranges.items()])
    return _kpi_columns(tagged.groupBy("preset").agg(*_kpi_aggs()), ["preset"])


def pick_period(kpis: DataFrame, name: str) -> DataFrame:
    """One period's KPI row from ``kpis_for_ranges``; an empty period still yields its zero row."""
    row = kpis.filter(F.col("preset") == name).drop("preset")
    zero = kpis.sparkSession.createDataFrame([(name,)], "preset string").select(
        F.lit(0).cast(TOTAL).alias("revenue"), F.lit(0).cast(TOTAL).alias("cogs"), F.lit(0).cast(TOTAL).alias("expenses"),
        F.lit(0).cast(TOTAL).alias("credit_sales"), F.lit(0).cast(TOTAL).alias("cash_sales"),
        F.lit(0).cast(TOTAL).alias("card_sales"), F.lit(0).cast("long").alias("order_count"))
    # a period with no facts has no group: fall back to the zero row (union + one-row fold, no join)
    both = row.select(F.lit(0).alias("_p"), *row.columns).unionByName(
        _kpi_columns(zero, []).select(F.lit(1).alias("_p"), *row.columns))
    return both.agg(*[F.min_by(c, "_p").alias(c) for c in row.columns])


def expense_breakdown(expenses: DataFrame, rng: Period) -> DataFrame:
    """Expenses by category, largest first, with counts."""
    e = in_period(expenses, rng)
    return e.groupBy("category").agg(F.count(F.lit(1)).alias("count"), nsum("amount").alias("total")).orderBy(
        F.desc("total"), "category"
    )


def expense_rollup(expenses: DataFrame, rng: Period) -> DataFrame:
    """Per-category totals plus the grand-total row, flagged by ``is_total``."""
    e = in_period(expenses, rng)
    return e.rollup("category").agg(
        F.count(F.lit(1)).alias("count"), csum("amount").alias("total"), (F.grouping("category") == 1).alias("is_total")
    )


def sales_by_payment(sales: DataFrame, rng: Period) -> DataFrame:
    """One row of takings per tender, zero-filled for the fixed tenders."""
    s = in_period(sales, rng)
    p = s.groupBy().pivot("payment_type", list(TENDERS)).agg(F.sum("total").cast(TOTAL))
    return p.select(*[F.coalesce(F.col(t), F.lit(0)).cast(TOTAL).alias(t) for t in TENDERS])


def pnl_statement(sales: DataFrame, sale_items: DataFrame, expenses: DataFrame, rng: Period) -> DataFrame:
    """The P&L as a long statement ``(line_no, section, label, amount, is_loss)``.

    Lines 1 to 8 are revenue, COGS, gross profit, total expenses, net profit and
    takings per tender; from 9 on follows one line per expense category, largest
    first, numbered by a scan over range partitions since categories are free text.
    ``is_loss`` marks a negative net profit.
    """
    kpi = period_kpis(sales, sale_items, expenses, rng)
    head = kpi.select(
        F.expr(
            "stack(8,"
            " 1, 'income', 'Revenue', revenue,"
            " 2, 'income', 'Cost of goods sold', cogs,"
            " 3, 'income', 'Gross profit', gross_profit,"
            " 4, 'expenses', 'Total expenses', expenses,"
            " 5, 'result', 'Net profit', net_profit,"
            " 6, 'payments', 'cash', cash_sales,"
            " 7, 'payments', 'card', card_sales,"
            " 8, 'payments', 'credit', credit_sales)"
            " AS (line_no, section, label, amount)"
        )
    )

    cats = expense_breakdown(expenses, rng).withColumn("_down", -F.col("total"))
    ranked = running_sum(cats, F.lit(1), [], ["_down", "category"], "_rank")
    cat_lines = ranked.select(
        (F.lit(8) + F.col("_rank")).cast("int").alias("line_no"), F.lit("expenses").alias("section"),
        F.col("category").alias("label"), F.col("total").alias("amount"),
    )
    lines = head.select("line_no", "section", "label", F.col("amount").cast(TOTAL).alias("amount")).unionByName(
        cat_lines.select("line_no", "section", "label", F.col("amount").cast(TOTAL).alias("amount"))
    )
    return lines.withColumn("is_loss", (F.col("section") == "result") & (F.col("amount") < 0))


def timeseries(
    sales: DataFrame, sale_items: DataFrame, expenses: DataFrame, rng: Period, group: str = "day", fill: str = "sales"
) -> DataFrame:
    """Revenue, COGS, gross, expenses, net per day or month bucket.

    Buckets come from the sales (``fill='sales'``, as the reference: an
    expense-only day is not shown) or from both sides (``fill='all'``).  COGS is
    aggregated per sale of the period; lines of other sales are left out first.
    """
    fmt = "yyyy-MM" if group == "month" else "yyyy-MM-dd"
    s = in_period(sales, rng).select(F.col("id").alias("sale_id"), F.date_format("date", fmt).alias("bucket"), "total")
    lines = sale_items.join(s.select("sale_id"), "sale_id", "left_semi")
    cogs = lines.groupBy("sale_id").agg(F.sum(F.col("unit_cost") * F.col("quantity")).alias("cogs"))
    per_sale = s.join(cogs, "sale_id", "left")
    sb = per_sale.groupBy("bucket").agg(
        total(F.sum("total")).alias("revenue"), total(F.coalesce(F.sum("cogs"), F.lit(0))).alias("cogs")
    )
    eb = (
        in_period(expenses, rng)
        .groupBy(F.date_format("date", fmt).alias("bucket"))
        .agg(total(F.sum("amount")).alias("expenses"))
    )
    how = "full" if fill == "all" else "left"
    j = sb.join(eb, sb.bucket.eqNullSafe(eb.bucket), how)
    bucket = F.coalesce(sb.bucket, eb.bucket)
    rev, cg, ex = (F.coalesce(F.col(c), F.lit(0)).cast(TOTAL) for c in ("revenue", "cogs", "expenses"))
    return j.select(
        bucket.alias("bucket"), rev.alias("revenue"), cg.alias("cogs"), (rev - cg).cast(TOTAL).alias("gross_profit"),
        ex.alias("expenses"), (rev - cg - ex).cast(TOTAL).alias("net_profit"),
    ).orderBy("bucket")
