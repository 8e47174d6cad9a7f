"""DuckDB SQL equivalents of the registered queries (the correctness gate).

Each text reads the mapped views as CTEs (``mapping.with_views``) over the raw
test tables, and projects the same column names and types as ``present`` of
the Spark result: money as DOUBLE, datetimes as text.  Written independently
of the DataFrame code — plain single-pass SQL, global windows included — so a
mismatch points at the Spark formulation.
"""

from __future__ import annotations

import re

from .functions.period import bounds, preset_ranges
from .registry import AS_OF, PERIOD, Q_EXPENSES, Q_PRODUCTS, Q_SALES, Q_SUPPLIERS, RECENT_PURCHASES, RECENT_SALES, TOP_N
from .sources.mapping import VIEWS, with_views

LO, HI = bounds(PERIOD)


def per(col: str = "date") -> str:
    return f"{col} >= TIMESTAMP '{LO}' AND {col} < TIMESTAMP '{HI}'"


def d(expr: str, name: str | None = None) -> str:
    """Money/decimal output column as DOUBLE."""
    return f"CAST({expr} AS DOUBLE) AS {name or expr.split('.')[-1]}"


def ts(expr: str, name: str | None = None) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S') AS {name or expr.split('.')[-1]}"


def pct(num: str, den: str) -> str:
    return f"CASE WHEN CAST({den} AS DOUBLE) <> 0 THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) * 100.0 ELSE 0.0 END"


def like(q: str) -> str:
    return "'%" + q.replace("'", "''") + "%'"


SQL: dict[str, str] = {}


def _kpi_select(src: str, keys: str = "") -> str:
    return f"""
SELECT {keys}{d('revenue')}, {d('cogs')}, {d('revenue - cogs', 'gross_profit')}, {d('expenses')},
       {d('revenue - cogs - expenses', 'net_profit')}, (revenue - cogs - expenses) < 0 AS is_loss,
       {d('credit_sales')}, {d('cash_sales')}, {d('card_sales')}, order_count,
       {pct('revenue - cogs', 'revenue')} AS gross_margin_pct,
       {pct('revenue - cogs - expenses', 'revenue')} AS net_margin_pct
FROM {src}"""


SQL["period_kpis"] = _kpi_select(f"""(
  SELECT (SELECT COALESCE(SUM(total), 0) FROM sales WHERE {per()}) AS revenue,
         (SELECT ROUND(COALESCE(SUM(si.unit_cost * si.quantity), 0), 2)
            FROM sale_items si JOIN sales s ON s.id = si.sale_id WHERE {per('s.date')}) AS cogs,
         (SELECT COALESCE(SUM(amount), 0) FROM expenses WHERE {per()}) AS expenses,
         (SELECT COALESCE(SUM(CASE WHEN payment_type = 'credit' THEN total END), 0) FROM sales WHERE {per()}) AS credit_sales,
         (SELECT COALESCE(SUM(CASE WHEN payment_type = 'cash' THEN total END), 0) FROM sales WHERE {per()}) AS cash_sales,
         (SELECT COALESCE(SUM(CASE WHEN payment_type = 'card' THEN total END), 0) FROM sales WHERE {per()}) AS card_sales,
         (SELECT COUNT(*) FROM sales WHERE {per()}) AS order_count) k""")

SQL["period_sales"] = f"""
SELECT {d('COALESCE(SUM(total), 0)', 'revenue')},
       {d("COALESCE(SUM(CASE WHEN payment_type = 'credit' THEN total END), 0)", 'credit_sales')},
       {d("COALESCE(SUM(CASE WHEN payment_type = 'cash' THEN total END), 0)", 'cash_sales')},
       {d("COALESCE(SUM(CASE WHEN payment_type = 'card' THEN total END), 0)", 'card_sales')},
       COUNT(*) AS order_count
FROM sales WHERE {per()}"""

SQL["cogs_period"] = f"""
SELECT {d('ROUND(COALESCE(SUM(si.unit_cost * si.quantity), 0), 2)', 'cogs')}, COUNT(*) AS lines,
       {d('COALESCE(SUM(si.quantity), 0)', 'units')}
FROM sale_items si JOIN sales s ON s.id = si.sale_id WHERE {per('s.date')}"""


def _presets_values() -> str:
    rows = []
    for name, a, b in preset_ranges(AS_OF):
        lo, hi = bounds((a, b))
        rows.append(f"SELECT '{name}' AS preset, TIMESTAMP '{lo}' AS lo, TIMESTAMP '{hi}' AS hi")
    return " UNION ALL ".join(rows)


SQL["kpis_all_presets"] = _kpi_select(f"""(
  SELECT p.preset,
    (SELECT COALESCE(SUM(total), 0) FROM sales WHERE date >= p.lo AND date < p.hi) AS revenue,
    (SELECT ROUND(COALESCE(SUM(si.unit_cost * si.quantity), 0), 2) FROM sale_items si JOIN sales s ON s.id = si.sale_id
       WHERE s.date >= p.lo AND s.date < p.hi) AS cogs,
    (SELECT COALESCE(SUM(amount), 0) FROM expenses WHERE date >= p.lo AND date < p.hi) AS expenses,
    (SELECT COALESCE(SUM(CASE WHEN payment_type = 'credit' THEN total END), 0) FROM sales WHERE date >= p.lo AND date < p.hi) AS credit_sales,
    (SELECT COALESCE(SUM(CASE WHEN payment_type = 'cash' THEN total END), 0) FROM sales WHERE date >= p.lo AND date < p.hi) AS cash_sales,
    (SELECT COALESCE(SUM(CASE WHEN payment_type = 'card' THEN total END), 0) FROM sales WHERE date >= p.lo AND date < p.hi) AS card_sales,
    (SELECT COUNT(*) FROM sales WHERE date >= p.lo AND date < p.hi) AS order_count
  FROM ({_presets_values()}) p) k""", "preset, ")

SQL["expense_breakdown"] = f"""
SELECT category, COUNT(*) AS count, {d('SUM(amount)', 'total')}
FROM expenses WHERE {per()} GROUP BY category"""

SQL["expense_rollup"] = f"""
SELECT category, COUNT(*) AS count, {d('COALESCE(SUM(amount), 0)', 'total')}, false AS is_total
FROM expenses WHERE {per()} GROUP BY category
UNION ALL
SELECT NULL AS category, COUNT(*) AS count, {d('COALESCE(SUM(amount), 0)', 'total')}, true AS is_total
FROM expenses WHERE {per()}"""

SQL["sales_by_payment"] = f"""
SELECT {d("COALESCE(SUM(CASE WHEN payment_type = 'cash' THEN total END), 0)", 'cash')},
       {d("COALESCE(SUM(CASE WHEN payment_type = 'card' THEN total END), 0)", 'card')},
       {d("COALESCE(SUM(CASE WHEN payment_type = 'credit' THEN total END), 0)", 'credit')}
FROM sales WHERE {per()}"""

SQL["pnl_statement"] = f"""
WITH k AS (
  SELECT (SELECT COALESCE(SUM(total), 0) FROM sales WHERE {per()}) AS revenue,
         (SELECT ROUND(COALESCE(SUM(si.unit_cost * si.quantity), 0), 2)
            FROM sale_items si JOIN sales s ON s.id = si.sale_id WHERE {per('s.date')}) AS cogs,
         (SELECT COALESCE(SUM(amount), 0) FROM expenses WHERE {per()}) AS expenses,
         (SELECT COALESCE(SUM(CASE WHEN payment_type = 'credit' THEN total END), 0) FROM sales WHERE {per()}) AS credit,
         (SELECT COALESCE(SUM(CASE WHEN payment_type = 'cash' THEN total END), 0) FROM sales WHERE {per()}) AS cash,
         (SELECT COALESCE(SUM(CASE WHEN payment_type = 'card' THEN total END), 0) FROM sales WHERE {per()}) AS card),
lines AS (
  SELECT 1 AS line_no, 'income' AS section, 'Revenue' AS label, revenue AS amount FROM k
  UNION ALL SELECT 2, 'income', 'Cost of goods sold', cogs FROM k
  UNION ALL SELECT 3, 'income', 'Gross profit', revenue - cogs FROM k
  UNION ALL SELECT 4, 'expenses', 'Total expenses', expenses FROM k
  UNION ALL SELECT 5, 'result', 'Net profit', revenue - cogs - expenses FROM k
  UNION ALL SELECT 6, 'payments', 'cash', cash FROM k
  UNION ALL SELECT 7, 'payments', 'card', card FROM k
  UNION ALL SELECT 8, 'payments', 'credit', credit FROM k
  UNION ALL
  SELECT CAST(8 + ROW_NUMBER() OVER (ORDER BY SUM(amount) DESC, category) AS INTEGER), 'expenses', category, SUM(amount)
  FROM expenses WHERE {per()} GROUP BY category)
SELECT line_no, section, label, {d('amount')}, section = 'result' AND amount < 0 AS is_loss FROM lines"""


def _timeseries(fmt: str) -> str:
    return f"""
WITH sb AS (
  SELECT strftime(s.date, '{fmt}') AS bucket, SUM(s.total) AS revenue,
         ROUND(SUM((SELECT COALESCE(SUM(si.unit_cost * si.quantity), 0) FROM sale_items si WHERE si.sale_id = s.id)), 2) AS cogs
  FROM sales s WHERE {per('s.date')} GROUP BY 1),
eb AS (SELECT strftime(date, '{fmt}') AS bucket, SUM(amount) AS expenses FROM expenses WHERE {per()} GROUP BY 1)
SELECT sb.bucket, {d('sb.revenue', 'revenue')}, {d('sb.cogs', 'cogs')}, {d('sb.revenue - sb.cogs', 'gross_profit')},
       {d('COALESCE(eb.expenses, 0)', 'expenses')}, {d('sb.revenue - sb.cogs - COALESCE(eb.expenses, 0)', 'net_profit')}
FROM sb LEFT JOIN eb ON sb.bucket IS NOT DISTINCT FROM eb.bucket"""


SQL["timeseries_day"] = _timeseries("%Y-%m-%d")
SQL["timeseries_month"] = _timeseries("%Y-%m")


# ---- sales -----------------------------------------------------------------------------------------
SALE_COLS = ("s.id, s.invoice_no, " + ts("s.date") + ", s.payment_type, s.customer_name, " + d("s.subtotal") + ", "
             + d("s.discount") + ", " + d("s.total") + ", " + d("s.amount_paid") + ", " + d("s.amount_due") + ", "
             + ts("s.created_at"))
_SALE_AGG = "(SELECT sale_id, SUM(quantity) AS n, SUM(unit_cost * quantity) AS cogs FROM sale_items GROUP BY sale_id)"
_SALE_LIST = f"""
SELECT {SALE_COLS}, {d('ROUND(COALESCE(a.n, 0), 2)', 'item_count')}, {d('ROUND(COALESCE(a.cogs, 0), 2)', 'cogs')},
       {d('s.total - ROUND(COALESCE(a.cogs, 0), 2)', 'profit')}
FROM sales s LEFT JOIN {_SALE_AGG} a ON a.sale_id = s.id"""

SQL["sales_in_period"] = f"SELECT id, invoice_no, {ts('date')}, payment_type, {d('total')} FROM sales WHERE {per()}"
SQL["sale_list"] = _SALE_LIST
SQL["search_sales"] = (_SALE_LIST + f"\nWHERE s.invoice_no ILIKE {like(Q_SALES)} OR s.customer_name ILIKE {like(Q_SALES)}")
SQL["recent_sales"] = _SALE_LIST + f"\nORDER BY s.date DESC, s.id DESC LIMIT {RECENT_SALES}"
SQL["top_products"] = f"""
SELECT si.product_name, {d('ROUND(SUM(si.quantity), 2)', 'units_sold')}, {d('ROUND(SUM(si.line_total), 2)', 'revenue')},
       {d('ROUND(SUM((si.unit_price - si.unit_cost) * si.quantity), 2)', 'profit')}
FROM sale_items si JOIN sales s ON s.id = si.sale_id WHERE {per('s.date')}
GROUP BY si.product_name ORDER BY SUM(si.line_total) DESC, si.product_name LIMIT {TOP_N}"""
SQL["top_earner"] = f"""
SELECT si.product_name AS name,
       {d('ROUND(SUM((si.unit_price - si.unit_cost) * si.quantity - si.line_discount), 2)', 'profit')}
FROM sale_items si JOIN sales s ON s.id = si.sale_id WHERE {per('s.date')}
GROUP BY si.product_name ORDER BY SUM((si.unit_price - si.unit_cost) * si.quantity - si.line_discount) DESC, si.product_name
LIMIT 1"""
SQL["invoice_numbers"] = f"""
SELECT prefix, id, {ts('date')}, prefix || '-' || strftime(date, '%Y%m%d') || '-' || printf('%04d', seq) AS number, seq
FROM (SELECT prefix, id, date, ROW_NUMBER() OVER (PARTITION BY prefix, CAST(date AS DATE) ORDER BY id) AS seq
      FROM (SELECT 'INV' AS prefix, id, date FROM sales UNION ALL SELECT 'PUR', id, date FROM purchases) u) n"""

# ---- inventory --------------------------------------------------------------------------------------
_PROD = f"""
SELECT p.id, p.name, p.sku, p.barcode, p.category_id, {d('p.cost_price')}, {d('p.selling_price')}, {d('p.quantity')},
       {d('p.reorder_level')}, {ts('p.created_at')}, c.name AS category_name,
       {d('p.selling_price - p.cost_price', 'margin_per_unit')},
       {d('ROUND(p.quantity * p.cost_price, 2)', 'stock_cost_value')},
       {d('ROUND(p.quantity * p.selling_price, 2)', 'stock_retail_value')},
       p.quantity <= p.reorder_level AS low_stock, p.quantity > 0 AS in_stock, p.quantity >= 1 AS can_add
FROM products p LEFT JOIN categories c ON c.id = p.category_id"""
SQL["product_list"] = _PROD
SQL["search_products"] = _PROD + "\nWHERE " + " OR ".join(
    f"{c} ILIKE {like(Q_PRODUCTS)}" for c in ("p.name", "p.sku", "p.barcode", "c.name"))
SQL["pos_product_search"] = f"""
SELECT p.id, p.name, p.sku, p.barcode, c.name AS category_name, {d('p.selling_price')}, {d('p.quantity')},
       p.quantity <= 0 AS disabled
FROM products p LEFT JOIN categories c ON c.id = p.category_id
WHERE """ + " OR ".join(f"contains(lower(COALESCE({c}, '')), '{Q_PRODUCTS.lower()}')"
                        for c in ("p.name", "p.sku", "p.barcode", "c.name"))
SQL["lookup_codes"] = f"""
WITH idx AS (SELECT code, MIN(id) AS product_id
             FROM (SELECT id, barcode AS code FROM products UNION ALL SELECT id, sku FROM products) x
             WHERE code IS NOT NULL GROUP BY code)
SELECT s.scan_id, trim(s.code) AS code, i.product_id, p.name, c.name AS category_name, {d('p.selling_price')},
       {d('p.quantity')}
FROM code_scans s LEFT JOIN idx i ON i.code = trim(s.code) LEFT JOIN products p ON p.id = i.product_id
LEFT JOIN categories c ON c.id = p.category_id"""
SQL["low_stock"] = f"SELECT id, name, sku, {d('quantity')}, {d('reorder_level')} FROM products WHERE quantity <= reorder_level"
SQL["inventory_totals"] = f"""
SELECT product_count, {d('total_units')}, {d('cv', 'total_cost_value')}, {d('rv', 'total_retail_value')},
       {d('rv - cv', 'potential_profit')}
FROM (SELECT COUNT(*) AS product_count, ROUND(COALESCE(SUM(quantity), 0), 2) AS total_units,
             ROUND(COALESCE(SUM(quantity * cost_price), 0), 2) AS cv, ROUND(COALESCE(SUM(quantity * selling_price), 0), 2) AS rv
      FROM products) t"""
SQL["inventory_by_category"] = f"""
SELECT c.id AS category_id, COALESCE(c.name, 'Uncategorized') AS category, COUNT(p.id) AS product_count,
       {d('ROUND(COALESCE(SUM(p.quantity), 0), 2)', 'units')},
       {d('ROUND(COALESCE(SUM(p.quantity * p.cost_price), 0), 2)', 'cost_value')},
       {d('ROUND(COALESCE(SUM(p.quantity * p.selling_price), 0), 2)', 'retail_value')}
FROM products p LEFT JOIN categories c ON c.id = p.category_id GROUP BY c.id, c.name"""
SQL["category_list"] = f"""
SELECT c.id, c.name, COUNT(p.id) AS product_count, {d('ROUND(COALESCE(SUM(p.quantity), 0), 2)', 'total_units')},
       {d('ROUND(COALESCE(SUM(p.quantity * p.cost_price), 0), 2)', 'stock_cost_value')},
       {d('ROUND(COALESCE(SUM(p.quantity * p.selling_price), 0), 2)', 'stock_retail_value')}
FROM categories c LEFT JOIN products p ON p.category_id = c.id GROUP BY c.id, c.name"""
SQL["inventory_kpis"] = f"""
SELECT {d('ROUND(COALESCE(SUM(quantity * cost_price), 0), 2)', 'cost_value')},
       {d('ROUND(COALESCE(SUM(quantity * selling_price), 0), 2)', 'retail_value')}, COUNT(*) AS products,
       CAST(SUM(CASE WHEN quantity <= reorder_level THEN 1 ELSE 0 END) AS BIGINT) AS low_stock_count
FROM products"""
_MOVES = """
  SELECT product_id, date, 0 AS rank, purchase_id AS ref, CAST(line_no AS BIGINT) AS line_no, quantity AS delta,
         'purchase' AS source FROM purchase_items
  UNION ALL
  SELECT si.product_id, s.date, 2, si.sale_id, CAST(si.line_no AS BIGINT), -si.quantity, 'sale'
  FROM sale_items si JOIN sales s ON s.id = si.sale_id
  UNION ALL
  SELECT product_id, date, 1, ref, CAST(0 AS BIGINT), quantity, 'restock' FROM stock_adjustments"""
SQL["stock_ledger"] = f"""
WITH mv AS ({_MOVES})
SELECT mv.product_id, {ts('mv.date')}, mv.source, mv.ref, mv.line_no, {d('mv.delta')},
       {d('ROUND(COALESCE(p.quantity, 0) + SUM(mv.delta) OVER (PARTITION BY mv.product_id ORDER BY mv.date, mv.rank, mv.ref, mv.line_no, mv.delta ROWS UNBOUNDED PRECEDING), 2)', 'position')}
FROM mv LEFT JOIN products p ON p.id = mv.product_id WHERE mv.product_id IS NOT NULL"""
_LATEST = """(SELECT product_id, unit_cost, last_purchase FROM (
    SELECT product_id, unit_cost, MAX(date) OVER (PARTITION BY product_id) AS last_purchase,
           ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY date DESC, purchase_id DESC, line_no DESC, ref DESC,
                              unit_cost DESC) AS rn
    FROM purchase_items) x WHERE rn = 1)"""
SQL["latest_cost"] = f"SELECT product_id, {d('unit_cost', 'cost_price')}, {ts('last_purchase')} FROM {_LATEST} lc"
SQL["product_snapshot"] = f"""
SELECT p.id, p.name, {d('ROUND(p.quantity + COALESCE(m.moved, 0), 2)', 'quantity')},
       {d('COALESCE(lc.unit_cost, p.cost_price)', 'cost_price')}, {d('p.selling_price')}
FROM products p
LEFT JOIN (SELECT product_id, SUM(dq) AS moved FROM (
             SELECT product_id, quantity AS dq FROM purchase_items UNION ALL
             SELECT product_id, -quantity FROM sale_items UNION ALL
             SELECT product_id, quantity FROM stock_adjustments) u GROUP BY product_id) m ON m.product_id = p.id
LEFT JOIN {_LATEST} lc ON lc.product_id = p.id"""

# ---- purchases and suppliers ------------------------------------------------------------------------
_PUR_LIST = f"""
SELECT p.id, p.invoice_no, p.supplier_id, {ts('p.date')}, p.payment_type, {d('p.subtotal')}, {d('p.discount')},
       {d('p.total')}, {d('p.amount_paid')}, {d('p.amount_due')}, p.note, {ts('p.created_at')},
       s.name AS supplier_name, {d('ROUND(COALESCE(i.n, 0), 2)', 'item_count')}
FROM purchases p LEFT JOIN suppliers s ON s.id = p.supplier_id
LEFT JOIN (SELECT purchase_id, SUM(quantity) AS n FROM purchase_items GROUP BY purchase_id) i ON i.purchase_id = p.id"""
SQL["purchase_list"] = _PUR_LIST
SQL["search_purchases"] = (_PUR_LIST + f"\nWHERE p.invoice_no ILIKE {like(Q_SUPPLIERS)} OR s.name ILIKE {like(Q_SUPPLIERS)}")
SQL["recent_purchases"] = _PUR_LIST + f"\nORDER BY p.date DESC, p.id DESC LIMIT {RECENT_PURCHASES}"
SQL["payables_summary"] = f"""
SELECT {d('COALESCE(SUM(amount_due), 0)', 'total_payable')}, COUNT(DISTINCT s.id) AS suppliers
FROM purchases p JOIN suppliers s ON s.id = p.supplier_id WHERE amount_due > 0"""
SQL["payables_total"] = f"SELECT {d('COALESCE(SUM(amount_due), 0)', 'total_payable')}, COUNT(*) AS count FROM purchases WHERE amount_due > 0"
SQL["payables_by_supplier"] = f"""
SELECT s.id, s.name, s.phone, {d('SUM(p.amount_due)', 'payable')}, COUNT(*) AS open_purchases
FROM suppliers s JOIN purchases p ON p.supplier_id = s.id WHERE p.amount_due > 0 GROUP BY s.id, s.name, s.phone"""
_SUP_LIST = f"""
SELECT s.id, s.name, s.phone, s.notes, {ts('s.created_at')}, {d('COALESCE(x.due, 0)', 'payable')},
       {d('COALESCE(x.tot, 0)', 'total_purchased')}
FROM suppliers s LEFT JOIN (SELECT supplier_id, SUM(amount_due) AS due, SUM(total) AS tot FROM purchases GROUP BY supplier_id) x
  ON x.supplier_id = s.id"""
SQL["supplier_list"] = _SUP_LIST
SQL["search_suppliers"] = _SUP_LIST + f"\nWHERE s.name ILIKE {like(Q_SUPPLIERS)} OR s.phone ILIKE {like(Q_SUPPLIERS)}"
_ENTRIES = """
  SELECT supplier_id, date, 0 AS grp, id, 0 AS sub, 'purchase' AS type, invoice_no AS ref, CAST(NULL AS VARCHAR) AS method,
         CAST(NULL AS VARCHAR) AS note, total AS debit, CAST(0 AS DECIMAL(18,2)) AS credit
  FROM purchases WHERE supplier_id IS NOT NULL
  UNION ALL
  SELECT supplier_id, date, 0, id, 1, 'payment', invoice_no, NULL, 'Paid at purchase', CAST(0 AS DECIMAL(18,2)), amount_paid
  FROM purchases WHERE supplier_id IS NOT NULL AND amount_paid > 0
  UNION ALL
  SELECT supplier_id, date, 1, id, 0, 'payment', COALESCE(note, 'Payment'), method, NULL, CAST(0 AS DECIMAL(18,2)), amount
  FROM supplier_payments"""
SQL["supplier_ledger"] = f"""
WITH e AS ({_ENTRIES})
SELECT supplier_id, {ts('date')}, type, ref, method, note, {d('debit')}, {d('credit')},
       {d('SUM(debit - credit) OVER (PARTITION BY supplier_id ORDER BY date, grp, id, sub ROWS UNBOUNDED PRECEDING)', 'balance')}
FROM e"""
SQL["supplier_closing"] = f"""
WITH e AS ({_ENTRIES})
SELECT supplier_id, {d('SUM(debit)', 'debits')}, {d('SUM(credit)', 'credits')}, {d('SUM(debit - credit)', 'closing')},
       COUNT(*) AS entries
FROM e GROUP BY supplier_id"""
_FIFO = """
ev AS (
  SELECT supplier_id, date, 0 AS kind, id, CAST(amount_due AS DECIMAL(38,2)) AS v
  FROM purchases WHERE amount_due > 0 AND supplier_id IS NOT NULL
  UNION ALL
  SELECT supplier_id, date, 1, id, -CAST(amount AS DECIMAL(38,2)) FROM supplier_payments),
w AS (
  SELECT *, SUM(v) OVER o AS S, SUM(CASE WHEN kind = 0 THEN v ELSE 0 END) OVER o AS D,
         GREATEST(0, -LEAST(0, MIN(s_) OVER o)) AS L
  FROM (SELECT *, SUM(v) OVER o AS s_ FROM ev WINDOW o AS (PARTITION BY supplier_id ORDER BY date, kind, id ROWS UNBOUNDED PRECEDING)) z
  WINDOW o AS (PARTITION BY supplier_id ORDER BY date, kind, id ROWS UNBOUNDED PRECEDING)),
wl AS (
  SELECT *, COALESCE(LAG(L) OVER (PARTITION BY supplier_id ORDER BY date, kind, id), 0) AS L_prev FROM w),
tot AS (
  SELECT supplier_id, SUM(CASE WHEN kind = 1 THEN -v ELSE 0 END) - GREATEST(0, -LEAST(0, MIN(S))) AS A FROM w
  GROUP BY supplier_id)"""
_SETTLED = "LEAST(w.v, GREATEST(0, t.A - (w.D - w.v)))"
SQL["fifo_allocation"] = f"""
WITH {_FIFO}
SELECT w.supplier_id, w.id AS purchase_id, {ts('w.date')}, {d('w.v', 'due_before')}, {d(_SETTLED, 'settled')},
       {d('w.v - ' + _SETTLED, 'amount_due')}, w.v - {_SETTLED} = 0 AS settled_in_full
FROM w JOIN tot t ON t.supplier_id = w.supplier_id WHERE w.kind = 0"""
_PAID = "CASE WHEN trim(amount) = '' THEN 0.0 ELSE TRY_CAST(trim(amount) AS DOUBLE) END"
SQL["clean_supplier_payments"] = f"""
SELECT id, supplier_id, {ts(f"COALESCE(date, TIMESTAMP '{AS_OF} 00:00:00')", 'date')}, {d('CAST(a AS DECIMAL(18,2))', 'amount')},
       COALESCE(NULLIF(method, ''), 'cash') AS method, COALESCE(NULLIF(note, ''), 'Payment to supplier') AS note
FROM (SELECT *, {_PAID} AS a FROM supplier_payment_entries) x WHERE a > 0 AND supplier_id IN (SELECT id FROM suppliers)"""
SQL["supplier_payment_rejects"] = f"""
SELECT id, supplier_id, amount, CASE WHEN a > 0 THEN 'unknown_supplier' ELSE 'bad_amount' END AS reason,
       CASE WHEN a > 0 THEN 'Supplier not found' ELSE 'Valid amount required' END AS message
FROM (SELECT *, {_PAID} AS a FROM supplier_payment_entries) x
WHERE a IS NULL OR a <= 0 OR supplier_id NOT IN (SELECT id FROM suppliers)"""
SQL["fifo_order_violations"] = f"""
SELECT supplier_id, id AS purchase_id, {ts('date')}, {ts('created_at', 'posted')}, {ts('top.date', 'queued_date')}, top.id AS queued_id
FROM (SELECT *, MAX({{'date': date, 'id': id}}) OVER (PARTITION BY supplier_id ORDER BY created_at, id
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
      FROM entered_purchases WHERE amount_due > 0 AND supplier_id IS NOT NULL) x
WHERE {{'date': date, 'id': id}} < top"""
# Each due's queue position on its own: what it and all older dues still owe, less what the older ones owe. A payment
# serves the older dues as if the others did not exist, so both are walks reflected at zero.
SQL["fifo_allocation_backdated"] = f"""
WITH due AS (SELECT supplier_id, id, date, created_at AS posted, CAST(amount_due AS DECIMAL(38,2)) AS v
             FROM entered_purchases WHERE amount_due > 0 AND supplier_id IS NOT NULL),
walk AS (
  SELECT i.supplier_id, i.id, e.v, SUM(e.v) OVER (PARTITION BY i.supplier_id, i.id ORDER BY e.posted, e.kind, e.eid ROWS UNBOUNDED PRECEDING) AS s
  FROM due i JOIN (
    SELECT supplier_id, posted, 0 AS kind, id AS eid, date, v FROM due
    UNION ALL SELECT supplier_id, date, 1, id, NULL, -CAST(amount AS DECIMAL(38,2)) FROM supplier_payments) e
  ON e.supplier_id = i.supplier_id AND (e.kind = 1 OR e.date < i.date OR (e.date = i.date AND e.eid <= i.id))),
owed AS (SELECT supplier_id, id, SUM(v) - LEAST(0, MIN(s)) AS o FROM walk GROUP BY supplier_id, id),
rest AS (SELECT d.*, o.o - COALESCE(LAG(o.o) OVER (PARTITION BY d.supplier_id ORDER BY d.date, d.id), 0) AS left_
         FROM due d JOIN owed o ON o.supplier_id = d.supplier_id AND o.id = d.id)
SELECT supplier_id, id AS purchase_id, {ts('date')}, {d('v', 'due_before')}, {d('v - left_', 'settled')}, {d('left_', 'amount_due')},
       left_ = 0 AS settled_in_full
FROM rest"""
SQL["fifo_payments"] = f"""
WITH {_FIFO}
SELECT supplier_id, id AS payment_id, {ts('date')}, {d('-v', 'amount')}, {d('-v - (L - L_prev)', 'applied')},
       {d('L - L_prev', 'lost')}
FROM wl WHERE kind = 1"""
SQL["fifo_links"] = f"""
WITH {_FIFO},
dues AS (SELECT supplier_id, id AS purchase_id, D - v AS lo, D AS hi FROM wl WHERE kind = 0),
pays AS (SELECT supplier_id, id AS payment_id, (D - S - L) - (-v - (L - L_prev)) AS lo, D - S - L AS hi FROM wl WHERE kind = 1)
SELECT d.supplier_id, d.purchase_id, p.payment_id, {d('LEAST(d.hi, p.hi) - GREATEST(d.lo, p.lo)', 'amount')}
FROM dues d JOIN pays p ON p.supplier_id = d.supplier_id AND p.lo < d.hi AND p.hi > d.lo
WHERE LEAST(d.hi, p.hi) - GREATEST(d.lo, p.lo) > 0"""

# ---- customer credit --------------------------------------------------------------------------------
_BEFORE = "COALESCE(SUM(r.amount) OVER (PARTITION BY r.sale_id ORDER BY r.date, r.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
_LEFT = f"GREATEST(0, s.amount_due - {_BEFORE})"
SQL["repayments_applied"] = f"""
SELECT r.id, r.sale_id, r.seq, {ts('r.date')}, r.method, {d('r.amount', 'requested')},
       {d(f'LEAST(r.amount, {_LEFT})', 'applied')}, {d(_LEFT, 'due_before')}
FROM repayment_requests r JOIN sales s ON s.id = r.sale_id"""
SQL["repayment_entry_rejects"] = f"""
SELECT e.id, e.sale_id, e.seq, {ts('e.date')}, {d('e.amount')},
       CASE WHEN e.amount > 0 THEN 'unknown_sale' ELSE 'bad_amount' END AS reason
FROM repayment_entries e
WHERE e.amount IS NULL OR e.amount <= 0 OR NOT EXISTS (SELECT 1 FROM sales s WHERE s.id = e.sale_id)"""
SQL["repayment_entries_applied"] = f"""
WITH r AS (SELECT id, sale_id, seq, COALESCE(date, TIMESTAMP '{AS_OF} 00:00:00') AS date, amount, method FROM repayment_entries WHERE amount > 0)
SELECT r.id, r.sale_id, r.seq, {ts('r.date')}, r.method, {d('r.amount', 'requested')},
       {d(f'LEAST(r.amount, {_LEFT})', 'applied')}, {d(_LEFT, 'due_before')}
FROM r JOIN sales s ON s.id = r.sale_id"""
SQL["receivables_total"] = f"SELECT {d('COALESCE(SUM(amount_due), 0)', 'due')}, COUNT(*) AS count FROM sales WHERE amount_due > 0"
SQL["receivables_list"] = f"""
SELECT id, invoice_no, {ts('date')}, customer_name, {d('total')}, {d('amount_paid')}, {d('amount_due')}
FROM sales WHERE amount_due > 0"""
SQL["receivables_by_customer"] = f"""
SELECT customer_name, {d('SUM(amount_due)', 'due')}, COUNT(*) AS invoices, {ts('MIN(date)', 'oldest')}
FROM sales WHERE amount_due > 0 GROUP BY customer_name"""
SQL["receivables_after"] = f"""
WITH ap AS (
  SELECT r.sale_id, LEAST(r.amount, {_LEFT}) AS applied FROM repayment_requests r JOIN sales s ON s.id = r.sale_id),
rep AS (SELECT sale_id, SUM(applied) AS rep FROM ap GROUP BY sale_id)
SELECT s.id, s.invoice_no, s.customer_name, {d('s.total')}, {d('s.amount_paid + COALESCE(rep.rep, 0)', 'amount_paid')},
       {d('s.amount_due - COALESCE(rep.rep, 0)', 'amount_due')}, {d('COALESCE(rep.rep, 0)', 'repaid')}
FROM sales s LEFT JOIN rep ON rep.sale_id = s.id"""

# ---- cash ---------------------------------------------------------------------------------------------
# Every movement of the drawer once: what it is, when, and its amount with its sign. Breakdown, balance and ledger read it.
# The kinds of movement, whether they belong to the drawer, and the ledger's labels.
_DRAWER = """
drawer AS (
  SELECT 'cash_sales' AS kind, 0 AS rank, id, date, amount_paid AS signed, 'Cash sale ' || COALESCE(invoice_no, '') AS label,
         payment_type = 'cash' AS ours, amount_paid > 0 AS shown FROM sales
  UNION ALL
  SELECT 'cash_repayments', 1, y.id, y.date, y.amount, 'Cash received ' || COALESCE(s.invoice_no, ''), y.method = 'cash', s.id IS NOT NULL
  FROM payments y LEFT JOIN sales s ON s.id = y.sale_id
  UNION ALL
  SELECT 'cash_purchases', 2, id, date, -amount_paid, 'Cash paid on purchase ' || COALESCE(invoice_no, ''), payment_type <> 'card', amount_paid > 0
  FROM purchases
  UNION ALL
  SELECT 'supplier_payments', 3, y.id, y.date, -y.amount, 'Paid supplier ' || COALESCE(s.name, ''), y.method = 'cash', true
  FROM supplier_payments y LEFT JOIN suppliers s ON s.id = y.supplier_id
  UNION ALL
  SELECT 'cash_expenses', 4, id, date, -amount,
         'Expense: ' || COALESCE(category, 'null') || COALESCE(' — ' || NULLIF(description, ''), ''), payment_method = 'cash', true
  FROM expenses
  UNION ALL
  SELECT CASE WHEN amount > 0 THEN 'cash_added' ELSE 'cash_removed' END, 5, id, date, amount,
         COALESCE(NULLIF(reason, ''), 'Cash adjustment'), true, true
  FROM cash_adjustments)"""
_KINDS = {"cash_sales": 1, "cash_repayments": 1, "cash_added": 1,
          "cash_purchases": -1, "supplier_payments": -1, "cash_expenses": -1, "cash_removed": -1}


def _moved(kinds, sign: int, name: str) -> str:
    names = ", ".join(f"'{k}'" for k in kinds)
    return d(f"COALESCE(SUM({'' if sign > 0 else '-'}signed) FILTER (WHERE kind IN ({names})), 0)", name)


_IN, _OUT = [k for k, s in _KINDS.items() if s > 0], [k for k, s in _KINDS.items() if s < 0]
SQL["cash_breakdown"] = f"WITH {_DRAWER}\nSELECT " + ", ".join(
    [_moved([k], s, f"{k}_{'in' if s > 0 else 'out'}") for k, s in _KINDS.items()]
    + [_moved(_IN, 1, "total_in"), _moved(_OUT, -1, "total_out"), _moved(_KINDS, 1, "cash_on_hand")]) + "\nFROM drawer WHERE ours"
SQL["cash_on_hand"] = f"WITH {_DRAWER}\nSELECT {_moved(_KINDS, 1, 'cash_on_hand')} FROM drawer WHERE ours"
SQL["cash_ledger"] = f"""
WITH {_DRAWER}
SELECT {ts('date')}, rank, id, trim(label) AS label, {d('GREATEST(signed, 0)', '"in"')}, {d('GREATEST(-signed, 0)', '"out"')},
       {d('SUM(signed) OVER (ORDER BY date, rank, id ROWS UNBOUNDED PRECEDING)', 'balance')}
FROM drawer WHERE ours AND shown"""
_NUM = "CASE WHEN amount IS NULL OR trim(amount) = '' THEN 0.0 ELSE TRY_CAST(trim(amount) AS DOUBLE) END"
SQL["clean_adjustments"] = f"""
SELECT id, {ts(f"COALESCE(date, TIMESTAMP '{AS_OF} 00:00:00')", 'date')}, {d('CAST(a AS DECIMAL(18,2))', 'amount')},
       COALESCE(NULLIF(reason, ''), CASE WHEN a > 0 THEN 'Cash added' ELSE 'Cash removed' END) AS reason
FROM (SELECT *, {_NUM} AS a FROM cash_requests) x WHERE a IS NOT NULL AND a <> 0"""

# ---- expenses -----------------------------------------------------------------------------------------
SQL["search_expenses"] = f"""
SELECT id, {ts('date')}, category, {d('amount')}, description, {ts('created_at')}, payment_method
FROM expenses WHERE {per()} AND (category ILIKE {like(Q_EXPENSES)} OR description ILIKE {like(Q_EXPENSES)})"""
SQL["clean_expenses"] = f"""
SELECT id, {ts(f"COALESCE(date, TIMESTAMP '{AS_OF} 00:00:00')", 'date')}, COALESCE(category, 'General') AS category,
       {d('CAST(a AS DECIMAL(18,2))', 'amount')}, NULLIF(description, '') AS description,
       COALESCE(payment_method, 'cash') AS payment_method
FROM (SELECT *, {_NUM} AS a FROM expense_requests) x WHERE a IS NOT NULL AND a > 0"""
SQL["merge_expenses"] = f"""
SELECT e.id, {ts('CASE WHEN x.id IS NOT NULL THEN x.date ELSE e.date END', 'date')},
       CASE WHEN x.id IS NOT NULL THEN x.category ELSE e.category END AS category,
       {d('CASE WHEN x.id IS NOT NULL THEN CAST(x.a AS DECIMAL(18,2)) ELSE e.amount END', 'amount')},
       CASE WHEN x.id IS NOT NULL THEN NULLIF(x.description, '') ELSE e.description END AS description,
       CASE WHEN x.id IS NOT NULL THEN COALESCE(NULLIF(x.payment_method, ''), e.payment_method) ELSE e.payment_method END
         AS payment_method,
       x.id IS NOT NULL AS edited
FROM expenses e LEFT JOIN (SELECT *, {_NUM} AS a FROM expense_edits) x ON x.id = e.id"""


# ---- posting (documents rebuilt from lineitem, not parsed) ------------------------------------------
_PRICED = r"""
ln AS (
  SELECT l.l_orderkey AS ref,
         CAST(ROW_NUMBER() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity,
              l.l_extendedprice, l.l_discount, l.l_tax, l.l_returnflag, l.l_linestatus, l.l_shipdate) - 1 AS INTEGER) AS pos,
         l.l_partkey AS product_id, l.l_quantity AS qty,
         CASE WHEN l.l_linenumber % 2 = 0 THEN FLOOR(l.l_extendedprice / l.l_quantity) END AS price_in,
         CASE WHEN l.l_returnflag = 'A' THEN CAST(l.l_linenumber AS DOUBLE) END AS ldisc_in
  FROM lineitem l),
lp AS (
  SELECT ln.*, p.name AS product_name, p.quantity AS stock, p.selling_price,
         COALESCE(CAST(price_in AS DECIMAL(18,2)), p.selling_price) AS unit_price,
         CAST(GREATEST(0.0, COALESCE(ldisc_in, 0.0)) AS DECIMAL(18,2)) AS line_discount,
         CAST(ROUND(CAST(qty AS DECIMAL(18,2)) * COALESCE(CAST(price_in AS DECIMAL(18,2)), p.selling_price), 2) AS DECIMAL(18,2)) AS gross,
         SUM(CAST(qty AS DECIMAL(18,2))) OVER (PARTITION BY ln.ref, ln.product_id) AS demand
  FROM ln LEFT JOIN products p ON p.id = ln.product_id)"""
_DOC_LINES = _PRICED + r""",
rej AS (
  SELECT o.o_orderkey AS ref, 'empty' AS reason, 'At least one item is required' AS message
  FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)
  UNION ALL
  SELECT ref, reason, message FROM (
    SELECT ref, reason, message, ROW_NUMBER() OVER (PARTITION BY ref ORDER BY pos) AS rn FROM (
      SELECT ref, pos,
             CASE WHEN product_name IS NULL THEN 'not_found' WHEN qty <= 0 THEN 'bad_quantity'
                  WHEN demand > stock THEN 'no_stock' END AS reason,
             CASE WHEN product_name IS NULL THEN 'Product ' || CAST(product_id AS VARCHAR) || ' not found'
                  WHEN qty <= 0 THEN 'Invalid quantity for ' || product_name
                  ELSE 'Not enough stock for ' || product_name || ' (have '
                       || regexp_replace(CAST(CAST(stock AS DOUBLE) AS VARCHAR), '\.0$', '') || ', need '
                       || regexp_replace(CAST(qty AS VARCHAR), '\.0$', '') || ')' END AS message
      FROM lp) x WHERE reason IS NOT NULL) y WHERE rn = 1)"""
_PT = "CASE o.o_orderpriority WHEN '1-URGENT' THEN 'credit' WHEN '2-HIGH' THEN 'card' ELSE 'cash' END"
SQL["line_pricing"] = f"""
WITH {_DOC_LINES}
SELECT ref, pos, product_id, {d('unit_price')}, {d('line_discount')}, {d('gross')},
       {d('CAST(GREATEST(0, gross - line_discount) AS DECIMAL(18,2))', 'line_total')},
       {d('LEAST(line_discount, GREATEST(gross, 0))', 'page_discount')}
FROM lp"""
SQL["intake_rejects"] = f"WITH {_DOC_LINES}\nSELECT ref, reason, message FROM rej"


def _posted_headers(refused: str) -> str:
    return f"""
acc AS (
  SELECT o.o_orderkey AS ref, c.c_name AS customer_name, {_PT} AS payment_type, o.o_orderdate AS date, COUNT(*) AS lines,
         SUM(lp.gross) AS subtotal,
         SUM(lp.line_discount) + CASE WHEN o.o_orderkey % 20 = 0 THEN 50 ELSE 0 END AS disc,
         o.o_orderkey % 3 AS m3
  FROM orders o JOIN lp ON lp.ref = o.o_orderkey LEFT JOIN customer c ON c.c_custkey = o.o_custkey
  WHERE o.o_orderkey NOT IN (SELECT ref FROM {refused})
  GROUP BY o.o_orderkey, c.c_name, o.o_orderpriority, o.o_orderdate),
tt AS (SELECT *, GREATEST(0, subtotal - disc) AS tot,
              CASE WHEN payment_type = 'credit' THEN (CASE WHEN m3 = 0 THEN 0 ELSE 500 END)
                   ELSE GREATEST(0, subtotal - disc) END AS paid FROM acc)
SELECT ref, customer_name, payment_type, {ts('date')}, lines, {d('subtotal')}, {d('disc', 'discount')}, {d('tot', 'total')},
       {d('paid', 'amount_paid')}, {d('GREATEST(0, tot - paid)', 'amount_due')}
FROM tt"""


SQL["intake_sales"] = f"WITH {_DOC_LINES}, {_posted_headers('rej')}"
# Posting in turn as a fixed point: a basket passes if it fits what the baskets that pass before it leave. Only one
# assignment satisfies this (by induction over the order); it is reached by judging all baskets anew until none changes.
_IN_TURN = _PRICED + """,
turns AS (
  SELECT lp.ref, o.o_orderdate AS date, lp.product_id, MAX(lp.stock) AS stock, SUM(CAST(lp.qty AS DECIMAL(18,2))) AS need
  FROM lp JOIN orders o ON o.o_orderkey = lp.ref GROUP BY lp.ref, o.o_orderdate, lp.product_id),
posted AS (
  SELECT 0 AS round, ref, date, product_id, stock, need, false AS ok, true AS moving FROM turns
  UNION ALL
  SELECT round + 1, ref, date, product_id, stock, need, now, bool_or(now <> ok) OVER () FROM (
    SELECT *, bool_and(need <= stock - earlier) OVER (PARTITION BY ref) AS now FROM (
      SELECT *, COALESCE(SUM(CASE WHEN ok THEN need ELSE 0 END) OVER (PARTITION BY product_id ORDER BY date, ref
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
      FROM posted WHERE moving) x) y),
passed AS (SELECT DISTINCT ref FROM posted WHERE ok AND round = (SELECT MAX(round) FROM posted)),
refused AS (SELECT ref FROM turns EXCEPT SELECT ref FROM passed)"""
SQL["intake_sales_sequential"] = f"WITH RECURSIVE {_IN_TURN}, {_posted_headers('refused')}"
SQL["intake_rejects_sequential"] = rf"""
WITH RECURSIVE {_IN_TURN},
met AS (
  SELECT t.ref, t.product_id, t.need, t.stock - COALESCE(SUM(CASE WHEN p.ref IS NOT NULL THEN t.need ELSE 0 END) OVER (
           PARTITION BY t.product_id ORDER BY t.date, t.ref ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS has
  FROM turns t LEFT JOIN passed p ON p.ref = t.ref)
SELECT o.o_orderkey AS ref, 'empty' AS reason, 'At least one item is required' AS message
FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)
UNION ALL
SELECT lp.ref, 'no_stock', arg_min('Not enough stock for ' || lp.product_name || ' (have '
       || regexp_replace(CAST(CAST(met.has AS DOUBLE) AS VARCHAR), '\.0$', '') || ', need '
       || regexp_replace(CAST(lp.qty AS VARCHAR), '\.0$', '') || ')', lp.pos)
FROM lp JOIN met ON met.ref = lp.ref AND met.product_id = lp.product_id WHERE met.need > met.has GROUP BY lp.ref"""
SQL["stock_after_sequential"] = f"""
WITH RECURSIVE {_IN_TURN},
sold AS (SELECT product_id, SUM(need) AS n FROM turns JOIN passed USING (ref) GROUP BY product_id)
SELECT q.id AS product_id, {d('q.quantity', 'before')}, {d('q.quantity - COALESCE(sold.n, 0)', 'after')}
FROM products q LEFT JOIN sold ON sold.product_id = q.id"""
SQL["posted_sale_items"] = f"""
WITH {_DOC_LINES}
SELECT lp.ref, lp.pos, lp.product_id, lp.product_name, {d('lp.qty', 'quantity')}, {d('lp.unit_price', 'unit_price')},
       {d('q.cost_price', 'unit_cost')}, {d('lp.line_discount', 'line_discount')},
       {d('CAST(GREATEST(0, lp.gross - lp.line_discount) AS DECIMAL(18,2))', 'line_total')}
FROM lp JOIN products q ON q.id = lp.product_id ANTI JOIN rej ON rej.ref = lp.ref"""
SQL["posted_payments"] = f"""
WITH {_DOC_LINES}
SELECT o.o_orderkey AS ref, {ts('o.o_orderdate', 'date')}, 500.0 AS amount, 'Initial payment at sale' AS note, 'cash' AS method
FROM orders o ANTI JOIN rej ON rej.ref = o.o_orderkey WHERE {_PT} = 'credit' AND o.o_orderkey % 3 <> 0"""
SQL["stock_after_sales"] = f"""
WITH {_DOC_LINES},
sold AS (SELECT lp.product_id, SUM(lp.qty) AS n FROM lp ANTI JOIN rej ON rej.ref = lp.ref GROUP BY lp.product_id)
SELECT q.id AS product_id, {d('q.quantity', 'before')}, {d('q.quantity - COALESCE(sold.n, 0)', 'after')}
FROM products q LEFT JOIN sold ON sold.product_id = q.id"""
SQL["basket_merge"] = f"""
WITH {_DOC_LINES}
SELECT ref, product_id, COUNT(*) AS line_count, {d('ROUND(SUM(qty), 2)', 'quantity')},
       {d('ROUND(SUM(CAST(qty AS DECIMAL(18,2))) * MIN(selling_price), 2)', 'gross')}
FROM lp GROUP BY ref, product_id"""
SQL["shortage_flags"] = f"""
WITH {_DOC_LINES}
SELECT lp.ref, lp.pos, lp.product_id, {ts('o.o_orderdate', 'date')}, {d('CAST(lp.qty AS DECIMAL(18,2))', 'quantity')},
       {d('SUM(CAST(lp.qty AS DECIMAL(18,2))) OVER (PARTITION BY lp.product_id ORDER BY o.o_orderdate, lp.ref, lp.pos ROWS UNBOUNDED PRECEDING)', 'cum_demand')},
       {d('lp.stock', 'stock')},
       SUM(CAST(lp.qty AS DECIMAL(18,2))) OVER (PARTITION BY lp.product_id ORDER BY o.o_orderdate, lp.ref, lp.pos ROWS UNBOUNDED PRECEDING) > COALESCE(lp.stock, 0) AS short
FROM lp JOIN orders o ON o.o_orderkey = lp.ref"""
_PDOC = """
pl AS (
  SELECT purchase_id AS ref, supplier_id, date, product_id, product_name, quantity,
         CASE WHEN line_no = 7 THEN -unit_cost ELSE unit_cost END AS cost,
         ROW_NUMBER() OVER (PARTITION BY purchase_id ORDER BY line_no, ref, product_id, quantity, unit_cost) - 1 AS pos
  FROM purchase_items)"""
SQL["posted_purchase_items"] = f"""
WITH {_PDOC}
SELECT ref, {ts('date')}, pos, product_id, product_name, {d('quantity')}, {d('cost', 'unit_cost')}, {d('ROUND(quantity * cost, 2)', 'line_total')}
FROM pl WHERE ref NOT IN (SELECT ref FROM pl WHERE cost < 0)"""
SQL["intake_purchases"] = f"""
WITH {_PDOC},
acc AS (
  SELECT ref, supplier_id, date, COUNT(*) AS lines, SUM(ROUND(quantity * cost, 2)) AS subtotal,
         CASE WHEN ref % 4 = 0 THEN 25.5 ELSE 0 END AS discount,
         CASE ref % 3 WHEN 0 THEN 'cash' WHEN 1 THEN 'card' ELSE 'credit' END AS payment_type
  FROM pl WHERE ref NOT IN (SELECT ref FROM pl WHERE cost < 0) GROUP BY ref, supplier_id, date),
tt AS (SELECT *, GREATEST(0, subtotal - discount) AS tot,
              CASE WHEN payment_type = 'credit' THEN 100 ELSE GREATEST(0, subtotal - discount) END AS paid FROM acc)
SELECT ref, supplier_id, payment_type, {ts('date')}, lines, {d('subtotal')}, {d('discount')}, {d('tot', 'total')}, {d('paid', 'amount_paid')},
       {d('GREATEST(0, tot - paid)', 'amount_due')}, CASE ref % 5 WHEN 0 THEN 'Order ' || CAST(ref AS VARCHAR) END AS note
FROM tt"""
SQL["products_after_purchases"] = f"""
WITH {_PDOC},
bought AS (SELECT * FROM pl ANTI JOIN (SELECT ref FROM pl WHERE cost < 0) x ON x.ref = pl.ref),
last AS (SELECT DISTINCT ON (product_id) product_id, cost FROM bought ORDER BY product_id, date DESC, ref DESC, pos DESC)
SELECT q.id AS product_id, {d('q.quantity', 'before')}, {d('q.quantity + COALESCE(b.n, 0)', 'after')},
       {d('q.cost_price', 'cost_before')}, {d('COALESCE(last.cost, q.cost_price)', 'cost_after')}, COALESCE(b.lines, 0) AS lines
FROM products q LEFT JOIN (SELECT product_id, SUM(quantity) AS n, COUNT(*) AS lines FROM bought GROUP BY product_id) b ON b.product_id = q.id
LEFT JOIN last ON last.product_id = q.id"""
SQL["purchase_rejects"] = f"""
WITH {_PDOC}
SELECT ref, 'bad_cost' AS reason, 'Invalid cost for ' || product_name AS message
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ref ORDER BY pos) AS rn FROM pl WHERE cost < 0) x WHERE rn = 1"""
SQL["asof_cost"] = f"""
WITH pc AS (
  SELECT product_id, date, unit_cost FROM (
    SELECT product_id, date, unit_cost,
           ROW_NUMBER() OVER (PARTITION BY product_id, date ORDER BY purchase_id DESC, line_no DESC, ref DESC, unit_cost DESC) AS rn
    FROM purchase_items) x WHERE rn = 1),
sl AS (SELECT si.sale_id, si.line_no, si.product_id, s.date, si.quantity FROM sale_items si JOIN sales s ON s.id = si.sale_id)
SELECT sl.sale_id, sl.line_no, sl.product_id, {ts('sl.date', 'date')}, {d('sl.quantity', 'quantity')},
       {d('pc.unit_cost', 'cost_asof')}, {d('ROUND(sl.quantity * pc.unit_cost, 2)', 'line_cost')}
FROM sl ASOF LEFT JOIN pc ON pc.product_id = sl.product_id AND sl.date >= pc.date"""


# ---- integrity -------------------------------------------------------------------------------------
_PROD_OUT = (f"id, name, sku, barcode, category_id, {d('cost_price')}, {d('selling_price')}, {d('quantity')}, "
             f"{d('reorder_level')}, {ts('created_at')}")
SQL["clean_products"] = f"""
SELECT id, name, NULLIF(sku, '') AS sku, NULLIF(barcode, '') AS barcode,
       CASE WHEN category_id = 0 THEN NULL ELSE category_id END AS category_id,
       {d('COALESCE(NULLIF(cost_price, 0), 0)', 'cost_price')}, {d('COALESCE(NULLIF(selling_price, 0), 0)', 'selling_price')},
       {d('COALESCE(NULLIF(quantity, 0), 0)', 'quantity')}, {d('COALESCE(reorder_level, 5)', 'reorder_level')}
FROM product_requests WHERE name IS NOT NULL AND name <> ''"""
SQL["reject_missing"] = """
SELECT 'products' AS entity, id, 'Product name is required' AS reason FROM product_requests WHERE name IS NULL OR name = ''
UNION ALL
SELECT 'suppliers', id, 'Supplier name is required' FROM supplier_requests WHERE name IS NULL OR trim(name) = ''"""
SQL["duplicate_keys"] = """
WITH k AS (
  SELECT 'products' AS tbl, 'sku' AS key, sku AS value FROM products
  UNION ALL SELECT 'products', 'sku', NULLIF(sku, '') FROM product_requests WHERE name IS NOT NULL AND name <> ''
  UNION ALL SELECT 'categories', 'name', name FROM categories
  UNION ALL SELECT 'sales', 'invoice_no', invoice_no FROM sales
  UNION ALL SELECT 'purchases', 'invoice_no', invoice_no FROM purchases)
SELECT tbl AS "table", key, value, COUNT(*) AS rows FROM k WHERE value IS NOT NULL
GROUP BY tbl, key, value HAVING COUNT(*) > 1"""


_KEYS = (("sale_items", "sale_id", "sales"), ("sale_items", "product_id", "products"), ("payments", "sale_id", "sales"),
         ("purchase_items", "purchase_id", "purchases"), ("purchase_items", "product_id", "products"),
         ("purchases", "supplier_id", "suppliers"), ("supplier_payments", "supplier_id", "suppliers"), ("products", "category_id", "categories"))


def _orphans(raw: str = "") -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{child}.{fk}' AS \"check\", COUNT(*) AS orphans FROM {raw}{child} c "
        f"WHERE c.{fk} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.id = c.{fk})" for child, fk, parent in _KEYS)


_T3 = "('cash', 'card', 'credit')"
_M3 = "('cash', 'card', 'bank')"
_DOMAINS = (
    ("sales.payment_type", "sales", f"payment_type NOT IN {_T3} OR payment_type IS NULL"),
    ("sales.negative_money", "sales", "total < 0 OR discount < 0 OR amount_paid < 0"),
    ("sales.overpaid", "sales", "amount_paid > total"),
    ("purchases.payment_type", "purchases", f"payment_type NOT IN {_T3} OR payment_type IS NULL"),
    ("purchases.negative_money", "purchases", "total < 0 OR amount_paid < 0"),
    ("supplier_payments.method", "supplier_payments", f"method NOT IN {_M3}"),
    ("payments.method", "payments", f"method NOT IN {_M3}"),
    ("expenses.amount", "expenses", "amount <= 0"),
    ("products.negative_stock", "products", "quantity < 0"),
)


def _domains(raw: str = "") -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{name}' AS \"check\", COUNT(*) FILTER (WHERE {cond}) AS violations FROM {raw}{table}" for name, table, cond in _DOMAINS)


SQL["orphan_items"], SQL["raw_orphan_items"] = _orphans(), _orphans("raw_")
SQL["domain_violations"], SQL["raw_domain_violations"] = _domains(), _domains("raw_")
SQL["raw_sale_breaks"] = """
SELECT id, concat_ws(',', """ + ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, t, cond in _DOMAINS if t == "sales") + """) AS broken
FROM raw_sales WHERE """ + " OR ".join(f"({cond})" for _, t, cond in _DOMAINS if t == "sales")


def _left(table: str, gone: str, nulled: str, amount: str) -> str:
    return f"""
SELECT '{table}' AS "table", COUNT(*) FILTER (WHERE NOT gone) AS rows, COUNT(*) FILTER (WHERE gone) AS removed,
       COUNT(*) FILTER (WHERE NOT gone AND nulled) AS keys_set_null, CAST(COALESCE(SUM(CASE WHEN NOT gone THEN amount END), 0) AS DOUBLE) AS amount
FROM (SELECT COALESCE({gone}, false) AS gone, COALESCE({nulled}, false) AS nulled, {amount} AS amount FROM {table}) x"""


SQL["delete_state"] = """
WITH gp AS (SELECT id FROM products WHERE quantity = 1),
gs AS (SELECT id FROM sales WHERE payment_type = 'card' AND id % 7 = 0),
gr AS (SELECT id FROM purchases WHERE payment_type = 'cash' AND id % 9 = 0)
""" + "\nUNION ALL".join([
    _left("categories", "id = 3", "false", "0"),
    _left("products", "quantity = 1", "category_id = 3", "quantity"),
    _left("sales", "payment_type = 'card' AND id % 7 = 0", "false", "total"),
    _left("sale_items", "sale_id IN (SELECT id FROM gs)", "product_id IN (SELECT id FROM gp)", "line_total"),
    _left("payments", "sale_id IN (SELECT id FROM gs)", "false", "amount"),
    _left("suppliers", "id % 10 = 0", "false", "0"),
    _left("purchases", "payment_type = 'cash' AND id % 9 = 0", "supplier_id % 10 = 0", "total"),
    _left("purchase_items", "purchase_id IN (SELECT id FROM gr)", "product_id IN (SELECT id FROM gp)", "line_total"),
    _left("supplier_payments", "supplier_id % 10 = 0", "purchase_id IN (SELECT id FROM gr)", "amount"),
    _left("expenses", "id % 10 = 0", "false", "amount"),
    _left("cash_adjustments", "amount < 0", "false", "amount"),
])
SQL["supplier_intake"] = """
SELECT CAST(c_custkey AS BIGINT) AS seq, c_name || ', Ltd' AS name, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_nationkey AS VARCHAR) END AS phone,
       CASE WHEN c_custkey % 2 <> 0 THEN 'net 30' END AS notes
FROM customer WHERE c_custkey % 12 NOT IN (3, 5, 7)"""
SQL["supplier_intake_rejects"] = """
SELECT seq, raw, CASE WHEN seq % 12 = 7 THEN 'missing_name' ELSE 'malformed' END AS reason,
       CASE WHEN seq % 12 = 7 THEN 'Supplier name is required' ELSE 'Unreadable record' END AS message
FROM supplier_lines WHERE seq % 12 IN (3, 5, 7)"""
_NAMED = """
named AS (SELECT seq, raw, CASE WHEN seq % 11 = 8 THEN 'ECONOMY' WHEN seq % 11 <> 4 THEN 'KIND ' || CAST(seq % 40 AS VARCHAR) END AS name
          FROM category_lines WHERE seq % 11 NOT IN (2, 6)),
judged AS (SELECT *, name IN (SELECT name FROM categories) OR ROW_NUMBER() OVER (PARTITION BY name ORDER BY seq) > 1 AS held FROM named)"""
SQL["category_intake"] = f"WITH {_NAMED}\nSELECT seq, seq + 1000 AS id, name FROM judged WHERE name IS NOT NULL AND NOT held"
SQL["category_intake_rejects"] = f"""
WITH {_NAMED}
SELECT seq, raw, 'malformed' AS reason, 'Unreadable record' AS message FROM category_lines WHERE seq % 11 IN (2, 6)
UNION ALL
SELECT seq, raw, CASE WHEN name IS NULL THEN 'missing_name' ELSE 'duplicate_key' END,
       CASE WHEN name IS NULL THEN 'Name is required' ELSE 'Category already exists' END
FROM judged WHERE name IS NULL OR held"""
SQL["delete_set_null"] = f"""
SELECT si.sale_id, si.line_no, CASE WHEN g.id IS NOT NULL THEN NULL ELSE si.product_id END AS product_id,
       si.product_name, {d('si.quantity', 'quantity')}, {d('si.line_total', 'line_total')}
FROM sale_items si LEFT JOIN (SELECT id FROM products WHERE quantity = 1) g ON g.id = si.product_id"""
SQL["delete_cascade"] = f"""
WITH gs AS (SELECT id FROM sales WHERE payment_type = 'card' AND id % 7 = 0),
     gp AS (SELECT id FROM suppliers WHERE id % 10 = 0)
SELECT 'sales' AS "table", COUNT(*) AS rows, {d('COALESCE(SUM(total), 0)', 'amount')} FROM sales WHERE id NOT IN (SELECT id FROM gs)
UNION ALL SELECT 'sale_items', COUNT(*), CAST(COALESCE(SUM(line_total), 0) AS DOUBLE) FROM sale_items WHERE sale_id NOT IN (SELECT id FROM gs)
UNION ALL SELECT 'payments', COUNT(*), CAST(COALESCE(SUM(amount), 0) AS DOUBLE) FROM payments WHERE sale_id NOT IN (SELECT id FROM gs)
UNION ALL SELECT 'suppliers', COUNT(*), 0.0 FROM suppliers WHERE id NOT IN (SELECT id FROM gp)
UNION ALL SELECT 'supplier_payments', COUNT(*), CAST(COALESCE(SUM(amount), 0) AS DOUBLE) FROM supplier_payments WHERE supplier_id NOT IN (SELECT id FROM gp)
UNION ALL SELECT 'purchases_without_supplier', COUNT(*), CAST(COALESCE(SUM(total), 0) AS DOUBLE) FROM purchases
          WHERE supplier_id IS NULL OR supplier_id IN (SELECT id FROM gp)
UNION ALL SELECT 'expenses', COUNT(*), CAST(COALESCE(SUM(amount), 0) AS DOUBLE) FROM expenses WHERE id % 10 <> 0"""
SQL["reconcile"] = f"""
WITH {_FIFO}, {_DRAWER},
e AS ({_ENTRIES}),
closing AS (SELECT supplier_id, SUM(debit - credit) AS closing FROM e GROUP BY supplier_id),
after AS (SELECT w.supplier_id, SUM(w.v - {_SETTLED}) AS due FROM w JOIN tot t ON t.supplier_id = w.supplier_id
          WHERE w.kind = 0 GROUP BY w.supplier_id),
sd AS (SELECT s.id, s.subtotal - COALESCE(x.l, 0) AS dd FROM sales s
       LEFT JOIN (SELECT sale_id, SUM(quantity * unit_price) AS l FROM sale_items GROUP BY sale_id) x ON x.sale_id = s.id),
pd AS (SELECT p.id, p.subtotal - COALESCE(x.l, 0) AS dd FROM purchases p
       LEFT JOIN (SELECT purchase_id, SUM(line_total) AS l FROM purchase_items GROUP BY purchase_id) x ON x.purchase_id = p.id),
lost AS (SELECT supplier_id, SUM(L - L_prev) AS lost FROM wl WHERE kind = 1 GROUP BY supplier_id),
su AS (SELECT c.supplier_id, c.closing - COALESCE(a.due, 0) + COALESCE(z.lost, 0) AS dd FROM closing c
       LEFT JOIN after a ON a.supplier_id = c.supplier_id LEFT JOIN lost z ON z.supplier_id = c.supplier_id)
SELECT 'sale_header_vs_lines' AS "check", COUNT(*) FILTER (WHERE dd <> 0) AS mismatches, {d('COALESCE(SUM(dd), 0)', 'difference')} FROM sd
UNION ALL SELECT 'purchase_header_vs_lines', COUNT(*) FILTER (WHERE dd <> 0), CAST(COALESCE(SUM(dd), 0) AS DOUBLE) FROM pd
UNION ALL SELECT 'supplier_ledger_vs_dues', COUNT(*) FILTER (WHERE dd <> 0), CAST(COALESCE(SUM(dd), 0) AS DOUBLE) FROM su
UNION ALL
SELECT 'cash_ledger_vs_breakdown', CAST(CASE WHEN dd <> 0 THEN 1 ELSE 0 END AS BIGINT), CAST(dd AS DOUBLE)
FROM (SELECT SUM(CASE WHEN shown THEN signed ELSE 0 END) - SUM(signed) AS dd FROM drawer WHERE ours) cd"""
SQL["upsert_products"] = f"""
SELECT {_PROD_OUT} FROM products WHERE id NOT IN (SELECT id FROM product_changes)
UNION ALL
SELECT {_PROD_OUT} FROM product_changes"""


def _in_turn(table: str, feed: str, key: str, name: str) -> str:
    """The edits one by one: ``held`` lists the rows that exist and their keys, as the edits so far left them."""
    return f"""
e0 AS (SELECT *, {name} AS nm, {key} AS k FROM {feed}),
bad AS (SELECT seq, op, id, 'missing_name' AS reason FROM e0 WHERE op <> 'delete' AND COALESCE(nm, '') = ''),
e AS (SELECT *, ROW_NUMBER() OVER (ORDER BY seq, id, op) AS n FROM e0 WHERE op = 'delete' OR COALESCE(nm, '') <> ''),
st AS (
  SELECT CAST(0 AS BIGINT) AS n, (SELECT list({{'id': id, 'k': k}}) FROM (SELECT id, {key} AS k FROM (SELECT *, {name} AS nm FROM {table}) t) b
                  WHERE id IN (SELECT id FROM e) OR k IN (SELECT k FROM e)) AS held, '' AS why
  UNION ALL
  SELECT n, CASE WHEN why <> '' THEN held
                 WHEN op = 'delete' THEN list_filter(held, lambda x: x.id <> id)
                 ELSE list_append(list_filter(held, lambda x: x.id <> id), {{'id': id, 'k': k}}) END, why
  FROM (SELECT e.n, e.id, e.op, e.k, held,
          CASE WHEN e.op = 'insert' AND len(list_filter(held, lambda x: x.id = e.id)) > 0 THEN 'repeated_id'
               WHEN e.op <> 'insert' AND len(list_filter(held, lambda x: x.id = e.id)) = 0 THEN 'unknown_id'
               WHEN e.op <> 'delete' AND e.k IS NOT NULL AND len(list_filter(held, lambda x: x.k = e.k AND x.id <> e.id)) > 0 THEN 'duplicate_key'
               ELSE '' END AS why
        FROM st JOIN e ON e.n = st.n + 1) s),
judged AS (SELECT e.*, st.why FROM e JOIN st ON st.n = e.n),
final AS (SELECT DISTINCT ON (id) * FROM judged WHERE why = '' ORDER BY id, n DESC)"""


def _edit_rejects(table: str, feed: str, key: str, name: str, missing: str, duplicate: str) -> str:
    return f"""
WITH RECURSIVE {_in_turn(table, feed, key, name)}
SELECT seq, op, id, reason, '{missing}' AS message FROM bad
UNION ALL
SELECT seq, op, id, why, CASE why WHEN 'duplicate_key' THEN '{duplicate}' WHEN 'unknown_id' THEN 'Not found' ELSE 'The id exists' END
FROM judged WHERE why <> ''"""


_SKU, _NO_KEY = "NULLIF(sku, '')", "CAST(NULL AS VARCHAR)"
SQL["product_edit_rejects"] = _edit_rejects("products", "product_edits", _SKU, "name", "Product name is required", "SKU must be unique")
SQL["category_edit_rejects"] = _edit_rejects("categories", "category_edits", "nm", "trim(name)", "Name is required", "Category already exists")
SQL["supplier_edit_rejects"] = _edit_rejects("suppliers", "supplier_edits", _NO_KEY, "trim(name)", "Supplier name is required", "")
SQL["products_after_edits"] = f"""
WITH RECURSIVE {_in_turn("products", "product_edits", _SKU, "name")}
SELECT {_PROD_OUT} FROM products WHERE id NOT IN (SELECT id FROM final)
UNION ALL
SELECT {_PROD_OUT.replace(" sku,", " k AS sku,")} FROM final WHERE op <> 'delete'"""
SQL["categories_after_edits"] = f"""
WITH RECURSIVE {_in_turn("categories", "category_edits", "nm", "trim(name)")}
SELECT id, name, {ts('created_at')} FROM categories WHERE id NOT IN (SELECT id FROM final)
UNION ALL SELECT id, nm, {ts('created_at')} FROM final WHERE op <> 'delete'"""
SQL["suppliers_after_edits"] = f"""
WITH RECURSIVE {_in_turn("suppliers", "supplier_edits", _NO_KEY, "trim(name)")}
SELECT id, name, phone, notes, {ts('created_at')} FROM suppliers WHERE id NOT IN (SELECT id FROM final)
UNION ALL SELECT id, nm, phone, notes, {ts('created_at')} FROM final WHERE op <> 'delete'"""
SQL["align_schema"] = f"""
SELECT id, name, sku, CAST(NULL AS VARCHAR) AS barcode, category_id, {d('cost_price')}, {d('selling_price')},
       {d('quantity')}, 5.0 AS reorder_level, {ts('created_at')}
FROM products"""


# ---- documents and dashboard --------------------------------------------------------------------------
def _json(fields: str, table: str = "") -> str:
    """Canonical text of a row: 'name' is a number or boolean, 'name$' a text, 'name@' a datetime."""
    parts = []
    for f in fields.split():
        name, col = f.rstrip("$@"), f"{table}{f.rstrip('$@')}"
        if f[-1] == "$":
            value = rf"""'"' || replace(replace({col}, '\', '\\'), '"', '\"') || '"'"""
        elif f[-1] == "@":
            value = f"""'"' || strftime({col}, '%Y-%m-%d %H:%M:%S') || '"'"""
        else:
            value = f"CAST({col} AS VARCHAR)"
        parts.append(f"""'"{name}":' || COALESCE({value}, 'null')""")
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


def _list(fields: str, order: str) -> str:
    return f"'[' || string_agg({_json(fields)}, ',' ORDER BY {order}) || ']'"


_SALE_LINE = "line_no product_id product_name$ quantity unit_price unit_cost line_discount line_total"
_PURCHASE_LINE = "line_no ref product_id product_name$ quantity unit_cost line_total"


def _by(fields: str) -> str:
    return fields.replace("$", "").replace("@", "").replace(" ", ", ")


SQL["sale_documents"] = f"""
SELECT s.id, s.invoice_no, {ts('s.date')}, s.payment_type, s.customer_name, {d('s.subtotal')}, {d('s.discount')}, {d('s.total')},
       {d('s.amount_paid')}, {d('s.amount_due')}, {ts('s.created_at')}, COALESCE(i.items, '[]') AS items, COALESCE(p.payments, '[]') AS payments
FROM sales s
LEFT JOIN (SELECT sale_id, {_list(_SALE_LINE, _by(_SALE_LINE))} AS items FROM sale_items GROUP BY sale_id) i ON i.sale_id = s.id
LEFT JOIN (SELECT sale_id, {_list("date@ id amount method$ note$", "date, id, amount, method, note")} AS payments
           FROM payments GROUP BY sale_id) p ON p.sale_id = s.id"""
SQL["purchase_documents"] = f"""
SELECT p.id, p.invoice_no, p.supplier_id, {ts('p.date')}, p.payment_type, {d('p.subtotal')}, {d('p.discount')}, {d('p.total')},
       {d('p.amount_paid')}, {d('p.amount_due')}, p.note, {ts('p.created_at')}, s.name AS supplier_name, s.phone AS supplier_phone,
       COALESCE(i.items, '[]') AS items
FROM purchases p LEFT JOIN suppliers s ON s.id = p.supplier_id
LEFT JOIN (SELECT purchase_id, {_list(_PURCHASE_LINE, _by(_PURCHASE_LINE))} AS items FROM purchase_items GROUP BY purchase_id) i
  ON i.purchase_id = p.id"""
SQL["sale_document_totals"] = f"""
SELECT s.id, s.invoice_no, COALESCE(i.n, 0) AS items_count, {d('COALESCE(i.t, 0)', 'items_line_total')},
       COALESCE(p.n, 0) AS payments_count, {d('COALESCE(p.t, 0)', 'payments_amount')}
FROM sales s
LEFT JOIN (SELECT sale_id, COUNT(*) AS n, SUM(line_total) AS t FROM sale_items GROUP BY sale_id) i ON i.sale_id = s.id
LEFT JOIN (SELECT sale_id, COUNT(*) AS n, SUM(amount) AS t FROM payments GROUP BY sale_id) p ON p.sale_id = s.id"""
SQL["purchase_document_totals"] = f"""
SELECT p.id, p.invoice_no, COALESCE(i.n, 0) AS items_count, {d('COALESCE(i.t, 0)', 'items_line_total')},
       s.name AS supplier_name
FROM purchases p LEFT JOIN suppliers s ON s.id = p.supplier_id
LEFT JOIN (SELECT purchase_id, COUNT(*) AS n, SUM(line_total) AS t FROM purchase_items GROUP BY purchase_id) i
  ON i.purchase_id = p.id"""
SQL["invoice_lines"] = f"""
WITH it AS (
  SELECT sale_id, 'item' AS section,
         ROW_NUMBER() OVER (PARTITION BY sale_id ORDER BY line_no, product_id, quantity, line_total, line_discount) AS seq,
         product_name AS label, quantity, unit_price, CASE WHEN line_discount <> 0 THEN -line_discount END AS discount,
         line_total AS amount
  FROM sale_items
  UNION ALL SELECT id, 'total', 1, 'Subtotal', NULL, NULL, NULL, subtotal FROM sales
  UNION ALL SELECT id, 'total', 2, 'Discount', NULL, NULL, NULL, -discount FROM sales
  UNION ALL SELECT id, 'total', 3, 'Total', NULL, NULL, NULL, total FROM sales
  UNION ALL SELECT id, 'total', 4, 'Paid', NULL, NULL, NULL, amount_paid FROM sales
  UNION ALL SELECT id, 'total', 5, 'Balance due', NULL, NULL, NULL, amount_due FROM sales)
SELECT it.sale_id, it.section, it.seq, it.label, {d('it.quantity', 'quantity')}, {d('it.unit_price', 'unit_price')},
       {d('it.discount', 'discount')}, {d('it.amount', 'amount')}, s.invoice_no,
       strftime(s.date, '%Y-%m-%d %H:%M') AS doc_date, COALESCE('Customer: ' || s.customer_name, 'Walk-in customer') AS party
FROM it JOIN sales s ON s.id = it.sale_id"""
SQL["purchase_invoice_lines"] = f"""
WITH it AS (
  SELECT purchase_id, 'item' AS section,
         ROW_NUMBER() OVER (PARTITION BY purchase_id ORDER BY line_no, ref, product_id, quantity, unit_cost) AS seq,
         product_name AS label, quantity, unit_cost AS unit_price, line_total AS amount
  FROM purchase_items
  UNION ALL SELECT id, 'total', 1, 'Subtotal', NULL, NULL, subtotal FROM purchases
  UNION ALL SELECT id, 'total', 2, 'Discount', NULL, NULL, -discount FROM purchases
  UNION ALL SELECT id, 'total', 3, 'Total', NULL, NULL, total FROM purchases
  UNION ALL SELECT id, 'total', 4, 'Paid', NULL, NULL, total - amount_due FROM purchases
  UNION ALL SELECT id, 'total', 5, 'Balance owed', NULL, NULL, amount_due FROM purchases)
SELECT it.purchase_id, it.section, it.seq, it.label, {d('it.quantity', 'quantity')}, {d('it.unit_price', 'unit_price')},
       {d('it.amount', 'amount')}, p.invoice_no, strftime(p.date, '%Y-%m-%d %H:%M') AS doc_date,
       'Supplier: ' || COALESCE(s.name, '—') || CASE WHEN COALESCE(s.phone, '') <> '' THEN ' · ' || s.phone ELSE '' END AS party
FROM it JOIN purchases p ON p.id = it.purchase_id LEFT JOIN suppliers s ON s.id = p.supplier_id"""


def _money_txt(x: str) -> str:
    return f"('Rs ' || format('{{:,}}', CAST(floor(CAST({x} AS DOUBLE) + 0.5) AS BIGINT)))"


def _pl(n: str, one: str, many: str) -> str:
    return f"CASE WHEN {n} = 1 THEN '{one}' ELSE '{many}' END"


SQL["store_summary"] = f"""
WITH k AS ({SQL['period_kpis']}),
tp AS ({SQL['top_earner']}),
ch AS ({SQL['cash_on_hand']}),
rc AS ({SQL['receivables_total']}),
py AS ({SQL['payables_total']}),
iv AS ({SQL['inventory_kpis']})
SELECT concat_ws(' ',
  CASE WHEN k.order_count = 0 THEN 'No sales recorded in this period yet. Once you start ringing up sales, your profit, cash, and trends will appear here.'
       ELSE 'You made ' || CAST(k.order_count AS VARCHAR) || ' sale' || {_pl('k.order_count', '', 's')} || ' totalling '
            || {_money_txt('k.revenue')} || ', for ' || CASE WHEN k.is_loss THEN 'a loss' ELSE 'a profit' END || ' of '
            || {_money_txt('abs(k.net_profit)')} || ' after costs and expenses (' || printf('%.0f', k.net_margin_pct)
            || '% margin).' END,
  CASE WHEN k.order_count <> 0 AND k.is_loss THEN 'Expenses (' || {_money_txt('k.expenses')}
       || ') are eating into your gross profit of ' || {_money_txt('k.gross_profit')}
       || ' — worth reviewing where the money is going.' END,
  (SELECT 'Your best earner is ' || name || ', bringing in ' || {_money_txt('profit')} || ' profit.' FROM tp),
  'You have about ' || {_money_txt('ch.cash_on_hand')} || ' cash in hand.',
  CASE WHEN rc.due > 0 THEN 'Customers owe you ' || {_money_txt('rc.due')} || ' across ' || CAST(rc.count AS VARCHAR)
       || ' unpaid invoice' || {_pl('rc.count', '', 's')} || '.' END,
  CASE WHEN py.total_payable > 0 THEN 'You owe suppliers ' || {_money_txt('py.total_payable')} || '.' END,
  CASE WHEN iv.low_stock_count > 0 THEN CAST(iv.low_stock_count AS VARCHAR) || ' item'
       || {_pl('iv.low_stock_count', ' is', 's are')} || ' low on stock and may need reordering.' END) AS summary
FROM k, ch, rc, py, iv"""
_KPI = ("revenue cogs gross_profit expenses net_profit is_loss credit_sales cash_sales card_sales order_count "
        "gross_margin_pct net_margin_pct")


def _money(fields: str) -> str:
    return ", ".join(f"CAST({f} AS DECIMAL(38,2)) AS {f}" for f in fields.split())


def _kpi_json(sql: str) -> str:
    money = "revenue cogs gross_profit expenses net_profit credit_sales cash_sales card_sales"
    rest = "is_loss order_count gross_margin_pct net_margin_pct"
    return f"(SELECT {_json(_KPI)} FROM (SELECT {_money(money)}, {rest.replace(' ', ', ')} FROM ({sql}) a) b)"


_TODAY = SQL["period_kpis"].replace(LO, f"{AS_OF} 00:00:00")
SQL["dashboard_json"] = f"""
SELECT '{{"range":{{"from":"{PERIOD[0]} 00:00:00","to":"{PERIOD[1]} 23:59:59"}},"period":' || {_kpi_json(SQL['period_kpis'])}
       || ',"today":' || {_kpi_json(_TODAY)}
       || ',"receivables":' || (SELECT {_json("due count")} FROM (SELECT {_money("due")}, count FROM ({SQL['receivables_total']}) a) b)
       || ',"payables":' || (SELECT {_json("total_payable count")} FROM (SELECT {_money("total_payable")}, count FROM ({SQL['payables_total']}) a) b)
       || ',"inventory":' || (SELECT {_json("cost_value retail_value products low_stock_count")}
                              FROM (SELECT {_money("cost_value retail_value")}, products, low_stock_count FROM ({SQL['inventory_kpis']}) a) b)
       || ',"cash_on_hand":' || (SELECT CAST(CAST(cash_on_hand AS DECIMAL(38,2)) AS VARCHAR) FROM ({SQL['cash_on_hand']}) a)
       || ',"summary":"' || (SELECT replace(replace(summary, '\', '\\'), '"', '\"') FROM ({SQL['store_summary']}) a) || '"}}' AS json"""
SQL["chart_feed"] = f"""
SELECT 'sales_split' AS chart, 'Cash' AS label, {d("COALESCE(SUM(CASE WHEN payment_type = 'cash' THEN total END), 0)", 'value')} FROM sales WHERE {per()}
UNION ALL SELECT 'sales_split', 'Card', CAST(COALESCE(SUM(CASE WHEN payment_type = 'card' THEN total END), 0) AS DOUBLE) FROM sales WHERE {per()}
UNION ALL SELECT 'sales_split', 'Credit', CAST(COALESCE(SUM(CASE WHEN payment_type = 'credit' THEN total END), 0) AS DOUBLE) FROM sales WHERE {per()}
UNION ALL SELECT 'inventory_value', category, cost_value FROM ({SQL['inventory_by_category']}) ib
UNION ALL SELECT 'expenses', category, total FROM ({SQL['expense_breakdown']}) eb"""


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, sql in SQL.items():
        needed = [v for v in VIEWS if re.search(r"\b" + v + r"\b", sql)]
        out[name] = with_views(sql, needed)
    return out
