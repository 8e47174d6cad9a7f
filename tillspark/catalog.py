"""Registration of the library's operators as named queries over the mapped tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import pnl
from .registry import AS_OF, PERIOD, query


# ---- period reporting (pnl.py) -------------------------------------------------------------
@query("period_kpis")
def _period_kpis(r):
    return pnl.period_kpis(r["sales"], r["sale_items"], r["expenses"], PERIOD)


@query("period_sales")
def _period_sales(r):
    return pnl.period_sales(r["sales"], PERIOD)


@query("cogs_period")
def _cogs_period(r):
    return pnl.cogs_period(r["sales"], r["sale_items"], PERIOD)


@query("kpis_all_presets")
def _kpis_all_presets(r):
    return pnl.kpis_all_presets(r.spark, r["sales"], r["sale_items"], r["expenses"], AS_OF)


@query("expense_breakdown")
def _expense_breakdown(r):
    return pnl.expense_breakdown(r["expenses"], PERIOD)


@query("expense_rollup")
def _expense_rollup(r):
    return pnl.expense_rollup(r["expenses"], PERIOD)


@query("sales_by_payment")
def _sales_by_payment(r):
    return pnl.sales_by_payment(r["sales"], PERIOD)


@query("pnl_statement")
def _pnl_statement(r):
    return pnl.pnl_statement(r["sales"], r["sale_items"], r["expenses"], PERIOD)


@query("timeseries_day")
def _timeseries_day(r):
    return pnl.timeseries(r["sales"], r["sale_items"], r["expenses"], PERIOD, "day")


@query("timeseries_month")
def _timeseries_month(r):
    return pnl.timeseries(r["sales"], r["sale_items"], r["expenses"], PERIOD, "month")


# ---- sales (sales.py) --------------------------------------------------------------------------
from .operators import backdated, cash, credit, expenses, inventory, purchases, sales, suppliers  # noqa: E402
from .registry import Q_EXPENSES, Q_PRODUCTS, Q_SALES, Q_SUPPLIERS, RECENT_PURCHASES, RECENT_SALES, TOP_N  # noqa: E402


@query("sales_in_period")
def _sales_in_period(r):
    return sales.sales_in_period(r["sales"], PERIOD)


@query("sale_list")
def _sale_list(r):
    return sales.sale_list(r["sales"], r["sale_items"])


@query("search_sales")
def _search_sales(r):
    return sales.sale_list(r["sales"], r["sale_items"], q=Q_SALES)


@query("recent_sales")
def _recent_sales(r):
    return sales.sale_list(r["sales"], r["sale_items"], limit=RECENT_SALES)


@query("top_products")
def _top_products(r):
    return sales.top_products(r["sales"], r["sale_items"], PERIOD, TOP_N)


@query("top_earner")
def _top_earner(r):
    return sales.top_earner(r["sales"], r["sale_items"], PERIOD)


@query("invoice_numbers")
def _invoice_numbers(r):
    return sales.invoice_numbers(r["sales"], r["purchases"])


# ---- inventory (inventory.py) -----------------------------------------------------------------
@query("product_list")
def _product_list(r):
    return inventory.product_list(r["products"], r["categories"])


@query("search_products")
def _search_products(r):
    return inventory.product_list(r["products"], r["categories"], q=Q_PRODUCTS)


@query("pos_product_search")
def _pos_product_search(r):
    return inventory.pos_product_search(r["products"], r["categories"], Q_PRODUCTS)


@query("lookup_codes")
def _lookup_codes(r):
    return inventory.lookup_codes(r["code_scans"], r["products"], r["categories"])


@query("low_stock")
def _low_stock(r):
    return inventory.low_stock(r["products"])


@query("inventory_totals")
def _inventory_totals(r):
    return inventory.inventory_totals(r["products"])


@query("inventory_by_category")
def _inventory_by_category(r):
    return inventory.inventory_by_category(r["products"], r["categories"])


@query("category_list")
def _category_list(r):
    return inventory.category_list(r["products"], r["categories"])


@query("inventory_kpis")
def _inventory_kpis(r):
    return inventory.inventory_kpis(r["products"])


@query("stock_ledger")
def _stock_ledger(r):
    return inventory.stock_ledger(r["products"], r["purchase_items"], r["sale_items"], r["sales"], r["stock_adjustments"])


@query("latest_cost")
def _latest_cost(r):
    return inventory.latest_cost(r["purchase_items"])


@query("product_snapshot")
def _product_snapshot(r):
    return inventory.product_snapshot(r["products"], r["purchase_items"], r["sale_items"], r["stock_adjustments"])


# ---- purchases and suppliers (purchases.py, suppliers.py) ----------------------------------------
@query("purchase_list")
def _purchase_list(r):
    return purchases.purchase_list(r["purchases"], r["suppliers"], r["purchase_items"])


@query("search_purchases")
def _search_purchases(r):
    return purchases.purchase_list(r["purchases"], r["suppliers"], r["purchase_items"], q=Q_SUPPLIERS)


@query("recent_purchases")
def _recent_purchases(r):
    return purchases.purchase_list(r["purchases"], r["suppliers"], r["purchase_items"], limit=RECENT_PURCHASES)


@query("payables_summary")
def _payables_summary(r):
    return purchases.payables_summary(r["suppliers"], r["purchases"])


@query("payables_total")
def _payables_total(r):
    return purchases.payables_total(r["purchases"])


@query("payables_by_supplier")
def _payables_by_supplier(r):
    return purchases.payables_by_supplier(r["suppliers"], r["purchases"])


@query("supplier_list")
def _supplier_list(r):
    return purchases.supplier_list(r["suppliers"], r["purchases"])


@query("search_suppliers")
def _search_suppliers(r):
    return purchases.supplier_list(r["suppliers"], r["purchases"], q=Q_SUPPLIERS)


@query("supplier_ledger")
def _supplier_ledger(r):
    return suppliers.supplier_ledger(r["purchases"], r["supplier_payments"])


@query("supplier_closing")
def _supplier_closing(r):
    return suppliers.supplier_closing(r["purchases"], r["supplier_payments"])


@query("fifo_allocation")
def _fifo_allocation(r):
    return suppliers.fifo_allocation(r["purchases"], r["supplier_payments"])


@query("clean_supplier_payments")
def _clean_supplier_payments(r):
    return suppliers.clean_supplier_payments(r["supplier_payment_entries"], r["suppliers"], AS_OF)


@query("supplier_payment_rejects")
def _supplier_payment_rejects(r):
    return suppliers.supplier_payment_rejects(r["supplier_payment_entries"], r["suppliers"])


@query("fifo_order_violations")
def _fifo_order_violations(r):
    return backdated.fifo_order_violations(r["entered_purchases"])


@query("fifo_allocation_backdated")
def _fifo_allocation_backdated(r):
    return suppliers.fifo_allocation(r["entered_purchases"], r["supplier_payments"])


@query("fifo_payments")
def _fifo_payments(r):
    return suppliers.fifo_payments(r["purchases"], r["supplier_payments"])


@query("fifo_links")
def _fifo_links(r):
    return suppliers.fifo_links(r["purchases"], r["supplier_payments"])


# ---- customer credit (credit.py) ----------------------------------------------------------------
@query("repayments_applied")
def _repayments_applied(r):
    return credit.repayments_applied(r["sales"], r["repayment_requests"])


@query("repayment_entry_rejects")
def _repayment_entry_rejects(r):
    return credit.repayment_rejects(r["sales"], r["repayment_entries"])


@query("repayment_entries_applied")
def _repayment_entries_applied(r):
    return credit.repayments_applied(r["sales"], r["repayment_entries"], AS_OF)


@query("receivables_total")
def _receivables_total(r):
    return credit.receivables_total(r["sales"])


@query("receivables_list")
def _receivables_list(r):
    return credit.receivables_list(r["sales"])


@query("receivables_by_customer")
def _receivables_by_customer(r):
    return credit.receivables_by_customer(r["sales"])


@query("receivables_after", kept=("sales",))
def _receivables_after(r):
    return credit.receivables_after(r["sales"], r["repayment_requests"])


# ---- cash (cash.py) ------------------------------------------------------------------------------
def _cash_tables(r):
    return (r["sales"], r["payments"], r["purchases"], r["supplier_payments"], r["expenses"], r["cash_adjustments"])


@query("cash_breakdown", kept=("sales",))
def _cash_breakdown(r):
    return cash.cash_breakdown(*_cash_tables(r))


@query("cash_on_hand", kept=("sales",))
def _cash_on_hand(r):
    return cash.cash_on_hand(*_cash_tables(r))


@query("cash_ledger", kept=("sales",))
def _cash_ledger(r):
    return cash.cash_ledger(*_cash_tables(r), r["suppliers"])


@query("clean_adjustments")
def _clean_adjustments(r):
    return cash.clean_adjustments(r["cash_requests"], AS_OF)


# ---- expenses (expenses.py) ---------------------------------------------------------------------
@query("search_expenses")
def _search_expenses(r):
    return expenses.search_expenses(r["expenses"], PERIOD, Q_EXPENSES)


@query("clean_expenses")
def _clean_expenses(r):
    return expenses.clean_expenses(r["expense_requests"], AS_OF)


@query("merge_expenses")
def _merge_expenses(r):
    return expenses.merge_expenses(r["expenses"], r["expense_edits"])


# ---- posting and as-of (posting.py, asof.py) ------------------------------------------------------
from .operators import asof, posting, sequential  # noqa: E402
from .sources.intake import SALE_DOC, parse_docs, sale_lines  # noqa: E402


@query("line_pricing")
def _line_pricing(r):
    lines = posting.line_pricing(sale_lines(parse_docs(r["sale_docs"], SALE_DOC)), r["products"])
    return lines.filter("NOT no_item").select(
        "ref", "pos", "product_id", "unit_price", "line_discount", "gross", "line_total", "page_discount"
    )


@query("intake_sales")
def _intake_sales(r):
    return posting.intake_sales(r["sale_docs"], r["products"])


@query("intake_sales_sequential")
def _intake_sales_sequential(r):
    return sequential.intake_sales_sequential(r["sale_docs"], r["products"])


@query("intake_rejects_sequential")
def _intake_rejects_sequential(r):
    return sequential.intake_rejects_sequential(r["sale_docs"], r["products"])


@query("stock_after_sequential")
def _stock_after_sequential(r):
    return sequential.stock_after_sequential(r["sale_docs"], r["products"])


@query("posted_sale_items")
def _posted_sale_items(r):
    return posting.posted_sale_items(r["sale_docs"], r["products"])


@query("posted_payments")
def _posted_payments(r):
    return posting.posted_payments(r["sale_docs"], r["products"])


@query("stock_after_sales")
def _stock_after_sales(r):
    return posting.stock_after_sales(r["sale_docs"], r["products"])


@query("posted_purchase_items")
def _posted_purchase_items(r):
    return posting.posted_purchase_items(r["purchase_docs"], r["products"])


@query("intake_rejects")
def _intake_rejects(r):
    return posting.intake_rejects(r["sale_docs"], r["products"])


@query("basket_merge")
def _basket_merge(r):
    return posting.basket_merge(r["sale_docs"], r["products"])


@query("shortage_flags")
def _shortage_flags(r):
    return posting.shortage_flags(r["sale_docs"], r["products"])


@query("intake_purchases")
def _intake_purchases(r):
    return posting.intake_purchases(r["purchase_docs"], r["products"])


@query("products_after_purchases")
def _products_after_purchases(r):
    return posting.products_after_purchases(r["purchase_docs"], r["products"])


@query("purchase_rejects")
def _purchase_rejects(r):
    return posting.purchase_rejects(r["purchase_docs"], r["products"])


@query("asof_cost")
def _asof_cost(r):
    return asof.asof_cost(r["sale_items"], r["sales"], r["purchase_items"])


# ---- integrity (integrity.py) ---------------------------------------------------------------------
from .operators import edits, integrity  # noqa: E402
from .sources import flat  # noqa: E402
from .sources.mapping import RAW  # noqa: E402


@query("clean_products")
def _clean_products(r):
    return integrity.clean_products(r["product_requests"])


@query("reject_missing")
def _reject_missing(r):
    return integrity.reject_missing(r["product_requests"], r["supplier_requests"])


@query("duplicate_keys")
def _duplicate_keys(r):
    new_products = integrity.clean_products(r["product_requests"]).select("id", "sku")
    return integrity.duplicate_keys({
        "products": (r["products"].select("id", "sku").unionByName(new_products), "sku"),
        "categories": (r["categories"], "name"),
        "sales": (r["sales"], "invoice_no"),
        "purchases": (r["purchases"], "invoice_no"),
    })


@query("orphan_items", kept={"sales": "id payment_type date amount_paid amount_due", "purchases": "id supplier_id"})
def _orphan_items(r):
    return integrity.orphan_items(r)


@query("domain_violations")
def _domain_violations(r):
    return integrity.domain_violations(r)


def _raw_tables(r):
    """The tables with the faults of a careless entry; parents without faults stand for themselves."""
    return {t: r[f"raw_{t}"] if t in RAW else r[t] for t in integrity.TABLES}


@query("raw_orphan_items", kept={
    "sales": "id payment_type date total discount amount_paid amount_due", "purchases": "id supplier_id payment_type total amount_paid"})
def _raw_orphan_items(r):
    return integrity.orphan_items(_raw_tables(r))


@query("raw_domain_violations")
def _raw_domain_violations(r):
    return integrity.domain_violations(_raw_tables(r))


@query("raw_sale_breaks")
def _raw_sale_breaks(r):
    return integrity.rule_breaks(_raw_tables(r), "sales").select("id", F.array_join("broken", ",").alias("broken"))


@query("delete_state", kept={
    "sales": "id payment_type date total amount_paid amount_due", "purchases": "id supplier_id payment_type total"})
def _delete_state(r):
    """What is left of every table once a category, some products, sales, suppliers, purchases and two kinds of rows are deleted."""
    return integrity.delete_state({t: r[t] for t in integrity.TABLES}, {
        "categories": r["categories"].filter("id = 3"),
        "products": r["products"].filter("quantity = 1"),
        "sales": r["sales"].filter("payment_type = 'card' AND id % 7 = 0"),
        "suppliers": r["suppliers"].filter("id % 10 = 0"),
        "purchases": r["purchases"].filter("payment_type = 'cash' AND id % 9 = 0"),
        "expenses": r["expenses"].filter("id % 10 = 0"),
        "cash_adjustments": r["cash_adjustments"].filter("amount < 0"),
    })


@query("supplier_intake")
def _supplier_intake(r):
    return flat.supplier_intake(r["supplier_lines"])


@query("supplier_intake_rejects")
def _supplier_intake_rejects(r):
    return flat.supplier_intake_rejects(r["supplier_lines"])


@query("category_intake")
def _category_intake(r):
    return flat.category_intake(r["category_lines"], r["categories"])


@query("category_intake_rejects")
def _category_intake_rejects(r):
    return flat.category_intake_rejects(r["category_lines"], r["categories"])


@query("delete_set_null")
def _delete_set_null(r):
    # deleting every product with a single unit in stock keeps their sold lines, product_id set to NULL
    gone = r["products"].filter(F.col("quantity") == 1)
    return integrity.set_null(r["sale_items"], "product_id", gone).select(
        "sale_id", "line_no", "product_id", "product_name", "quantity", "line_total")


@query("delete_cascade", kept=("sales",))
def _delete_cascade(r):
    gone_sales = r["sales"].filter((F.col("payment_type") == "card") & (F.col("id") % 7 == 0))
    gone_suppliers = r["suppliers"].filter(F.col("id") % 10 == 0)
    gone_expenses = r["expenses"].filter(F.col("id") % 10 == 0)
    return integrity.delete_cascade(r, gone_sales, gone_suppliers, gone_expenses)


@query("reconcile", kept=("sales", "purchases", "supplier_payments", "payments"))
def _reconcile(r):
    scan = suppliers.fifo_scan(r["purchases"], r["supplier_payments"])
    return integrity.reconcile(
        r, suppliers.supplier_closing(r["purchases"], r["supplier_payments"]),
        suppliers.fifo_allocation(r["purchases"], r["supplier_payments"], scan),
        cash.cash_closing(*_cash_tables(r), r["suppliers"]),
        cash.cash_on_hand(*_cash_tables(r)),
        suppliers.fifo_payments(r["purchases"], r["supplier_payments"], scan),
    )


@query("upsert_products")
def _upsert_products(r):
    return integrity.upsert(r["products"], r["product_changes"])


@query("products_after_edits")
def _products_after_edits(r):
    return edits.apply_edits(r["products"], r["product_edits"], "products")


@query("product_edit_rejects")
def _product_edit_rejects(r):
    return edits.edit_rejects(r["products"], r["product_edits"], "products")


@query("categories_after_edits")
def _categories_after_edits(r):
    return edits.apply_edits(r["categories"], r["category_edits"], "categories")


@query("category_edit_rejects")
def _category_edit_rejects(r):
    return edits.edit_rejects(r["categories"], r["category_edits"], "categories")


@query("suppliers_after_edits")
def _suppliers_after_edits(r):
    return edits.apply_edits(r["suppliers"], r["supplier_edits"], "suppliers")


@query("supplier_edit_rejects")
def _supplier_edit_rejects(r):
    return edits.edit_rejects(r["suppliers"], r["supplier_edits"], "suppliers")


@query("align_schema")
def _align_schema(r):
    # an older products file without the migrated barcode and with no reorder level column
    old = r["products"].drop("barcode", "reorder_level")
    return integrity.align_schema(old, "products")


# ---- documents and dashboard (plans/) ------------------------------------------------------------
from .functions.money import TOTAL  # noqa: E402
from .plans import documents, narrative  # noqa: E402


@query("sale_documents", kept=("sales",))
def _sale_documents(r):
    return documents.sale_documents(r["sales"], r["sale_items"], r["payments"])


@query("sale_document_totals", kept=("sales",))
def _sale_document_totals(r):
    docs = documents.sale_documents(r["sales"], r["sale_items"], r["payments"])
    return documents.document_totals(docs, "items", "line_total", {
        "payments_count": F.size("payments").cast("long"),
        "payments_amount": F.aggregate("payments", F.lit(0).cast(TOTAL), lambda a, x: a + x["amount"]),
    })


@query("purchase_documents")
def _purchase_documents(r):
    return documents.purchase_documents(r["purchases"], r["suppliers"], r["purchase_items"])


@query("purchase_document_totals")
def _purchase_document_totals(r):
    docs = documents.purchase_documents(r["purchases"], r["suppliers"], r["purchase_items"])
    return documents.document_totals(docs, "items", "line_total", {"supplier_name": F.col("supplier_name")})


@query("invoice_lines")
def _invoice_lines(r):
    return documents.invoice_lines(r["sales"], r["sale_items"])


@query("purchase_invoice_lines")
def _purchase_invoice_lines(r):
    return documents.purchase_invoice_lines(r["purchases"], r["suppliers"], r["purchase_items"])


def _dashboard(r):
    kpis = pnl.kpis_for_ranges(r.spark, r["sales"], r["sale_items"], r["expenses"],
                               {"period": PERIOD, "today": (AS_OF, AS_OF)})
    return narrative.dashboard(
        pnl.pick_period(kpis, "period"),
        pnl.pick_period(kpis, "today"),
        credit.receivables_total(r["sales"]),
        purchases.payables_total(r["purchases"]),
        inventory.inventory_kpis(r["products"]),
        cash.cash_on_hand(*_cash_tables(r)),
        sales.top_earner(r["sales"], r["sale_items"], PERIOD),
        PERIOD,
    )


@query("store_summary", kept=("sales",))
def _store_summary(r):
    return _dashboard(r).select("summary")


@query("dashboard_json", kept=("sales",))
def _dashboard_json(r):
    return narrative.dashboard_json(_dashboard(r))


@query("chart_feed")
def _chart_feed(r):
    return narrative.chart_feed(
        pnl.period_sales(r["sales"], PERIOD),
        inventory.inventory_by_category(r["products"], r["categories"]),
        pnl.expense_breakdown(r["expenses"], PERIOD),
    )
