"""Retail views over the driver's test tables.

Each view is one SQL text rendered for two dialects: Spark (run through
``spark.sql`` with the source frames bound as parameters) and DuckDB (inlined
as CTEs in the oracle queries).  Only the handful of dialect differences are
abstracted; everything else is plain ANSI SQL, so both engines see the same
view definitions.

The mapping turns TPC-H-like tables into a shop: parts are products, orders
with their lines are sales, returned ('N') lines are purchases, and events are
expenses and cash movements.  See FIXTURES.md §2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import written

SOURCES = ("part", "customer", "supplier", "orders", "lineitem", "events")


class Dialect:
    def __init__(self, name: str):
        self.name = name

    @property
    def spark(self) -> bool:
        return self.name == "spark"

    def t(self, table: str) -> str:
        """Reference to a source table or another view."""
        return "{" + table + "}" if self.spark else table

    def ts(self, text: str) -> str:
        return f"TIMESTAMP_NTZ'{text}'" if self.spark else f"TIMESTAMP '{text}'"

    def days(self, n: str) -> str:
        return f"make_dt_interval({n})" if self.spark else f"to_days(CAST({n} AS INTEGER))"

    def day_number(self, x: str) -> str:
        """Whole days since 1995-01-01."""
        return f"datediff({x}, DATE'1995-01-01')" if self.spark else f"date_diff('day', TIMESTAMP '1995-01-01', {x})"


SPARK, DUCK = Dialect("spark"), Dialect("duckdb")

M = "DECIMAL(18,2)"


def _categories(d: Dialect) -> str:
    # One category per part type, plus an empty one.
    rows = [(1, "ECONOMY"), (2, "LARGE"), (3, "MEDIUM"), (4, "PROMO"), (5, "SMALL"), (6, "STANDARD"), (7, "UNUSED")]
    return "\nUNION ALL\n".join(
        f"SELECT CAST({i} AS BIGINT) AS id, '{n}' AS name, {d.ts('1995-01-01 00:00:00')} AS created_at" for i, n in rows
    )


def _products(d: Dialect) -> str:
    return f"""
SELECT p.p_partkey AS id, p.p_name AS name,
       'SKU-' || CAST(p.p_partkey AS STRING) AS sku,
       CASE WHEN p.p_partkey % 10 = 0 THEN NULL ELSE '89' || CAST(p.p_partkey AS STRING) END AS barcode,
       CASE WHEN p.p_size % 25 = 0 THEN NULL ELSE c.id END AS category_id,
       CAST(ROUND(CAST(p.p_retailprice AS {M}) * 0.75, 2) AS {M}) AS cost_price,
       CAST(p.p_retailprice AS {M}) AS selling_price,
       CAST(p.p_size AS {M}) AS quantity,
       CAST(5 AS {M}) AS reorder_level,
       {d.ts('1995-01-01 00:00:00')} AS created_at
FROM {d.t('part')} p LEFT JOIN {d.t('categories')} c ON c.name = p.p_type"""


def _sale_items(d: Dialect) -> str:
    return f"""
SELECT sale_id, line_no, product_id, product_name, quantity, unit_price, unit_cost,
       CAST(gross - line_discount AS {M}) AS line_total, line_discount
FROM (
  SELECT sale_id, line_no, product_id, product_name, quantity, unit_price, unit_cost, gross,
         CAST(ROUND(gross * disc, 2) AS {M}) AS line_discount
  FROM (
    SELECT l.l_orderkey AS sale_id, l.l_linenumber AS line_no, l.l_partkey AS product_id,
           p.name AS product_name, CAST(l.l_quantity AS {M}) AS quantity,
           p.selling_price AS unit_price, p.cost_price AS unit_cost,
           CAST(CAST(l.l_quantity AS {M}) * p.selling_price AS {M}) AS gross,
           CAST(l.l_discount AS {M}) AS disc
    FROM {d.t('lineitem')} l JOIN {d.t('products')} p ON p.id = l.l_partkey) x) y"""


def _sales(d: Dialect) -> str:
    return f"""
SELECT id, invoice_no, date, payment_type, customer_name, subtotal, discount, total,
       amount_paid, CAST(GREATEST(CAST(0 AS {M}), total - amount_paid) AS {M}) AS amount_due, created_at
FROM (
  SELECT id, invoice_no, date, payment_type, customer_name, subtotal, discount, total,
         CAST(CASE WHEN payment_type <> 'credit' THEN total
                   WHEN id % 3 = 0 THEN CAST(0 AS {M})
                   ELSE LEAST(total, CAST(500 AS {M})) END AS {M}) AS amount_paid,
         created_at
  FROM (
    SELECT id, invoice_no, date, payment_type, customer_name, subtotal, discount,
           CAST(GREATEST(CAST(0 AS {M}), subtotal - discount) AS {M}) AS total, created_at
    FROM (
      SELECT o.o_orderkey AS id, 'INV-' || CAST(o.o_orderkey AS STRING) AS invoice_no, o.o_orderdate AS date,
             CASE o.o_orderpriority WHEN '1-URGENT' THEN 'credit' WHEN '2-HIGH' THEN 'card' ELSE 'cash' END
               AS payment_type,
             c.c_name AS customer_name,
             CAST(a.subtotal AS {M}) AS subtotal,
             CAST(a.line_disc + CASE WHEN o.o_orderkey % 20 = 0 THEN 50 ELSE 0 END AS {M}) AS discount,
             o.o_orderdate AS created_at
      FROM {d.t('orders')} o
      JOIN (SELECT sale_id, SUM(quantity * unit_price) AS subtotal, SUM(line_discount) AS line_disc
            FROM {d.t('sale_items')} GROUP BY sale_id) a ON a.sale_id = o.o_orderkey
      LEFT JOIN {d.t('customer')} c ON c.c_custkey = o.o_custkey) s0) s1) s2"""


def _repayment_requests(d: Dialect) -> str:
    """Repayment requests against credit sales: one per line, in posting order ``seq``."""
    return f"""
SELECT sale_id * 1000 + seq AS id, sale_id, seq, date, amount, method
FROM (
  SELECT sale_id, date, amount, method,
         CAST(ROW_NUMBER() OVER (PARTITION BY sale_id
              ORDER BY date, line_no, l_partkey, l_suppkey, method, amount) AS BIGINT) AS seq
  FROM (
    SELECT l.l_orderkey AS sale_id, GREATEST(l.l_shipdate, s.date) AS date,
           CAST(CAST(l.l_quantity AS {M}) * 1000 AS {M}) AS amount,
           CASE l.l_returnflag WHEN 'A' THEN 'cash' WHEN 'N' THEN 'card' ELSE 'bank' END AS method,
           l.l_linenumber AS line_no, l.l_partkey, l.l_suppkey
    FROM {d.t('lineitem')} l JOIN {d.t('sales')} s ON s.id = l.l_orderkey
    WHERE s.payment_type = 'credit') r) q"""


def _payments_sql(d: Dialect) -> str:
    """Oracle form of the payments view: first instalments ∪ repayments clamped to what is due (E5)."""
    return f"""
SELECT s.id * 1000 AS id, s.id AS sale_id, s.date, s.amount_paid AS amount,
       'Initial payment at sale' AS note, 'cash' AS method
FROM {d.t('sales')} s WHERE s.payment_type = 'credit' AND s.amount_paid > 0
UNION ALL
SELECT r.id, r.sale_id, r.date,
       CAST(LEAST(r.amount, GREATEST(CAST(0 AS {M}), s.amount_due - COALESCE(SUM(r.amount) OVER (
            PARTITION BY r.sale_id ORDER BY r.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS {M})
         AS amount,
       'Repayment' AS note, r.method
FROM {d.t('repayment_requests')} r JOIN {d.t('sales')} s ON s.id = r.sale_id"""


def _suppliers(d: Dialect) -> str:
    return f"""
SELECT s_suppkey AS id, s_name AS name, CAST(s_nationkey AS STRING) AS phone, CAST(NULL AS STRING) AS notes,
       {d.ts('1995-01-01 00:00:00')} AS created_at
FROM {d.t('supplier')}"""


def _purchase_items(d: Dialect) -> str:
    return f"""
SELECT purchase_id, line_no, supplier_id, date, ref, product_id, product_name, quantity, unit_cost,
       CAST(quantity * unit_cost AS {M}) AS line_total
FROM (
  SELECT l.l_suppkey * 100000 + {d.day_number('l.l_shipdate')} AS purchase_id, l.l_linenumber AS line_no,
         l.l_suppkey AS supplier_id, l.l_shipdate AS date, l.l_orderkey AS ref,
         l.l_partkey AS product_id, p.name AS product_name, CAST(l.l_quantity AS {M}) AS quantity,
         CAST(ROUND(p.selling_price * (0.70 + l.l_linenumber * 0.01), 2) AS {M}) AS unit_cost
  FROM {d.t('lineitem')} l JOIN {d.t('products')} p ON p.id = l.l_partkey
  WHERE l.l_returnflag = 'N') x"""


def _purchases(d: Dialect) -> str:
    return f"""
SELECT id, 'PUR-' || CAST(id AS STRING) AS invoice_no, supplier_id, date, payment_type,
       subtotal, CAST(0 AS {M}) AS discount, subtotal AS total, amount_paid,
       CAST(CASE WHEN payment_type = 'credit' THEN subtotal - amount_paid ELSE 0 END AS {M}) AS amount_due,
       CAST(NULL AS STRING) AS note, date AS created_at
FROM (
  SELECT id, supplier_id, date, payment_type, subtotal,
         CAST(CASE WHEN payment_type = 'credit' THEN ROUND(subtotal * 0.25, 2) ELSE subtotal END AS {M})
           AS amount_paid
  FROM (
    SELECT purchase_id AS id, supplier_id, date,
           CASE purchase_id % 3 WHEN 0 THEN 'cash' WHEN 1 THEN 'card' ELSE 'credit' END AS payment_type,
           CAST(SUM(line_total) AS {M}) AS subtotal
    FROM {d.t('purchase_items')} GROUP BY purchase_id, supplier_id, date) a) b"""


def _supplier_payments(d: Dialect) -> str:
    return f"""
SELECT supplier_id * 1000000 + {d.day_number('date')} * 10 + mcode AS id, supplier_id,
       CAST(NULL AS BIGINT) AS purchase_id, date, CAST(amount AS {M}) AS amount, method,
       'Payment to supplier' AS note
FROM (
  SELECT l_suppkey AS supplier_id, l_shipdate AS date, l_linenumber % 3 AS mcode,
         CASE l_linenumber % 3 WHEN 0 THEN 'cash' WHEN 1 THEN 'card' ELSE 'bank' END AS method,
         SUM(CAST(l_quantity AS {M}) * 600) AS amount
  FROM {d.t('lineitem')} WHERE l_returnflag = 'R' AND l_linestatus = 'F'
  GROUP BY l_suppkey, l_shipdate, l_linenumber % 3) g"""


def _shifted(d: Dialect) -> str:
    return f"ts - INTERVAL 27 YEARS + {d.days('(user_id % 12) * 30')}"


def _expenses(d: Dialect) -> str:
    return f"""
SELECT event_id AS id, {_shifted(d)} AS date, event_type AS category, CAST(value AS {M}) AS amount,
       props AS description, {_shifted(d)} AS created_at,
       CASE user_id % 3 WHEN 0 THEN 'cash' WHEN 1 THEN 'card' ELSE 'bank' END AS payment_method
FROM {d.t('events')} WHERE event_type IN ('click', 'view', 'error')"""


def _cash_adjustments(d: Dialect) -> str:
    return f"""
SELECT event_id AS id, {_shifted(d)} AS date,
       CAST(CASE WHEN event_type = 'signup' THEN value ELSE -value END AS {M}) AS amount,
       event_type AS reason, {_shifted(d)} AS created_at
FROM {d.t('events')} WHERE event_type IN ('signup', 'purchase')"""


def _stock_adjustments(d: Dialect) -> str:
    """Restock feed (K4): accepted ('A') open lines add units; first lines remove them (counts, write-offs)."""
    return f"""
SELECT l_partkey AS product_id, l_shipdate AS date,
       CAST(CASE WHEN l_linenumber = 1 THEN -l_quantity ELSE l_quantity END AS {M}) AS quantity,
       l_orderkey * 10 + l_linenumber AS ref
FROM {d.t('lineitem')} WHERE l_returnflag = 'A' AND l_linestatus = 'O'"""


def _amount_text(d: Dialect, expr: str) -> str:
    return f"CAST(CAST({expr} AS {M}) AS STRING)"


def _code_scans(d: Dialect) -> str:
    """Scanned codes (B9): a SKU, a barcode or an unknown code per sold line."""
    return f"""
SELECT l_orderkey * 10 + l_linenumber AS scan_id,
       CASE l_linenumber % 3 WHEN 0 THEN 'SKU-' || CAST(l_partkey AS STRING)
                             WHEN 1 THEN '89' || CAST(l_partkey AS STRING)
                             ELSE 'X' || CAST(l_partkey AS STRING) END AS code
FROM {d.t('lineitem')}"""


def _cash_requests(d: Dialect) -> str:
    """Raw manual cash movements (K10): amounts as typed text, some blank, junk or zero."""
    return f"""
SELECT event_id AS id, CASE WHEN user_id % 9 = 0 THEN NULL ELSE {_shifted(d)} END AS date,
       CASE event_type WHEN 'signup' THEN {_amount_text(d, 'value')}
                       WHEN 'purchase' THEN '-' || {_amount_text(d, 'value')}
                       WHEN 'error' THEN '' WHEN 'click' THEN 'abc' ELSE '0' END AS amount,
       CASE WHEN user_id % 4 = 0 THEN NULL ELSE event_type END AS reason
FROM {d.t('events')}"""


def _expense_requests(d: Dialect) -> str:
    """Raw expense entries (K11) with missing dates, categories and methods."""
    return f"""
SELECT event_id AS id, CASE WHEN user_id % 9 = 0 THEN NULL ELSE {_shifted(d)} END AS date,
       CASE WHEN user_id % 7 = 0 THEN NULL ELSE event_type END AS category,
       CASE event_type WHEN 'purchase' THEN '-' || {_amount_text(d, 'value')} WHEN 'signup' THEN ''
                       ELSE {_amount_text(d, 'value')} END AS amount,
       CASE WHEN user_id % 5 = 0 THEN '' ELSE props END AS description,
       CASE user_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'card' ELSE 'bank' END AS payment_method
FROM {d.t('events')}"""


def _expense_edits(d: Dialect) -> str:
    """Edits of existing expenses (K9): every fifth user's views are re-keyed."""
    return f"""
SELECT event_id AS id, upper(event_type) AS category, {_amount_text(d, 'value * 2')} AS amount,
       CASE WHEN user_id % 2 = 0 THEN NULL ELSE 'edited' END AS description,
       {_shifted(d)} + {d.days('1')} AS date,
       CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'bank' END AS payment_method
FROM {d.t('events')} WHERE event_type = 'view' AND user_id % 5 = 0"""


def _product_requests(d: Dialect) -> str:
    """New-product entries (A4, L1–L3): blank names, missing fields, colliding SKUs."""
    return f"""
SELECT p_partkey + 1000000 AS id,
       CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN '' ELSE p_name END AS name,
       CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 7 = 1 THEN '' ELSE 'NEW-' || p_brand || '-' || CAST(p_size AS STRING) END AS sku,
       CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '77' || CAST(p_partkey AS STRING) END AS barcode,
       CASE WHEN p_size % 11 = 0 THEN NULL ELSE CAST(p_size % 8 AS BIGINT) END AS category_id,
       CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(ROUND(CAST(p_retailprice AS {M}) * 0.7, 2) AS {M}) END AS cost_price,
       CAST(p_retailprice AS {M}) AS selling_price,
       CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_size AS {M}) END AS quantity,
       CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_partkey % 6 = 1 THEN CAST(0 AS {M}) ELSE CAST(10 AS {M}) END AS reorder_level
FROM {d.t('part')}"""


def _supplier_requests(d: Dialect) -> str:
    return f"""
SELECT s_suppkey + 1000 AS id, CASE WHEN s_suppkey % 9 = 0 THEN '  ' WHEN s_suppkey % 13 = 0 THEN NULL ELSE s_name END AS name,
       CAST(s_nationkey AS STRING) AS phone
FROM {d.t('supplier')}"""


def _product_changes(d: Dialect) -> str:
    """Full-replace edits of existing products and brand-new ones (K8)."""
    return f"""
SELECT CASE WHEN p_partkey % 8 = 0 THEN p_partkey ELSE p_partkey + 2000000 END AS id, p_name || ' v2' AS name,
       'SKU-' || CAST(p_partkey AS STRING) || '-2' AS sku, CAST(NULL AS STRING) AS barcode,
       CAST(NULL AS BIGINT) AS category_id,
       CAST(ROUND(CAST(p_retailprice AS {M}) * 0.8, 2) AS {M}) AS cost_price,
       CAST(p_retailprice + 10 AS {M}) AS selling_price, CAST(p_size * 2 AS {M}) AS quantity,
       CAST(5 AS {M}) AS reorder_level, {d.ts('1996-01-01 00:00:00')} AS created_at
FROM {d.t('part')} WHERE p_partkey % 4 = 0"""


def _repayment_entries(d: Dialect) -> str:
    """Raw repayment entries (E5): every request, some typed for sales that do not exist, with no, a zero or a negative amount."""
    return f"""
SELECT id, CASE WHEN id % 4 = 3 THEN -sale_id ELSE sale_id END AS sale_id, seq, CASE WHEN id % 9 = 0 THEN NULL ELSE date END AS date,
       CASE WHEN id % 5 = 0 THEN CAST(-amount AS {M}) WHEN id % 7 = 0 THEN NULL WHEN id % 11 = 0 THEN CAST(0 AS {M}) ELSE amount END AS amount,
       method
FROM {d.t('repayment_requests')}"""


def _entered_purchases(d: Dialect) -> str:
    """Purchases as they were entered (E4): some days or weeks after the date on the paper."""
    return f"""
SELECT id, invoice_no, supplier_id, date, payment_type, subtotal, discount, total, amount_paid, amount_due, note,
       date + {d.days('CASE WHEN id % 7 = 0 THEN 40 WHEN id % 11 = 0 THEN 3 ELSE 0 END')} AS created_at
FROM {d.t('purchases')}"""


def _product_edits(d: Dialect) -> str:
    """Product edits in posting order (K8): SKUs that clash, are freed and taken again, missing names, unknown ids."""
    return f"""
SELECT CAST(p_partkey AS BIGINT) AS seq,
       CASE p_partkey % 5 WHEN 0 THEN 'insert' WHEN 4 THEN 'delete' ELSE 'update' END AS op,
       CASE WHEN p_partkey % 5 = 0 OR (p_partkey % 5 = 1 AND p_partkey % 3 = 0) THEN 5000000 + p_partkey % 40
            WHEN p_partkey % 5 = 4 THEN p_partkey % 230 + 1 ELSE p_partkey % 61 + 1 END AS id,
       CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN '' ELSE p_name || ' e' END AS name,
       CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 14 = 0 THEN '' ELSE 'SKU-' || CAST((p_partkey * 7) % 90 + 1 AS STRING) END AS sku,
       '90' || CAST(p_partkey AS STRING) AS barcode, CAST(p_size % 7 + 1 AS BIGINT) AS category_id,
       CAST(ROUND(CAST(p_retailprice AS {M}) * 0.8, 2) AS {M}) AS cost_price, CAST(p_retailprice AS {M}) AS selling_price,
       CAST(p_size AS {M}) AS quantity, CAST(5 AS {M}) AS reorder_level, {d.ts('1997-01-01 00:00:00')} AS created_at
FROM {d.t('part')}"""


def _category_edits(d: Dialect) -> str:
    """Category edits in posting order (K8): names with blanks around them, taken ones, missing ones."""
    return f"""
SELECT CAST(s_suppkey AS BIGINT) AS seq,
       CASE s_suppkey % 4 WHEN 0 THEN 'insert' WHEN 3 THEN CASE WHEN s_suppkey % 3 = 0 THEN 'delete' ELSE 'update' END ELSE 'update' END AS op,
       CASE WHEN s_suppkey % 4 = 0 THEN 100 + s_suppkey % 9 ELSE s_suppkey % 8 + 1 END AS id,
       CASE WHEN s_suppkey % 11 = 0 THEN NULL WHEN s_suppkey % 13 = 0 THEN '  ' WHEN s_suppkey % 5 = 0 THEN ' ECONOMY'
            ELSE '  GROUP ' || CAST(s_suppkey % 7 AS STRING) || ' ' END AS name,
       {d.ts('1997-01-01 00:00:00')} AS created_at
FROM {d.t('supplier')}"""


def _supplier_edits(d: Dialect) -> str:
    """Supplier edits in posting order (K8): new ones, changes, deletes, unknown ids, blank names."""
    return f"""
SELECT CAST(s_suppkey AS BIGINT) AS seq,
       CASE s_suppkey % 4 WHEN 0 THEN 'insert' WHEN 1 THEN 'delete' ELSE 'update' END AS op,
       CASE WHEN s_suppkey % 4 = 0 THEN 7000 + s_suppkey % 6 WHEN s_suppkey % 4 = 2 THEN 7000 + s_suppkey % 6 ELSE s_suppkey % 30 + 1 END AS id,
       CASE WHEN s_suppkey % 9 = 0 THEN ' ' ELSE ' ' || s_name || ' & Co ' END AS name,
       CAST(s_nationkey AS STRING) AS phone, 'edited' AS notes, {d.ts('1997-01-01 00:00:00')} AS created_at
FROM {d.t('supplier')}"""


def _raw(table: str, columns: str, **faults: str):
    """A copy of ``table`` as a careless hand would have entered it: some columns of some rows are wrong."""

    def view(d: Dialect) -> str:
        cols = ", ".join(f"{faults[c]} AS {c}" if c in faults else c for c in columns.split())
        return f"\nSELECT {cols} FROM {d.t(table)}"

    return view


RAW = {
    "sales": _raw("sales", "id payment_type total discount amount_paid",
                  payment_type="CASE WHEN id % 97 = 0 THEN 'cheque' WHEN id % 101 = 0 THEN NULL ELSE payment_type END",
                  discount=f"CASE WHEN id % 89 = 0 THEN CAST(-5 AS {M}) ELSE discount END",
                  amount_paid=f"CAST(CASE WHEN id % 83 = 0 THEN total + 1 ELSE amount_paid END AS {M})"),
    "purchases": _raw("purchases", "id supplier_id payment_type total amount_paid",
                      supplier_id="CASE WHEN id % 103 = 0 THEN -supplier_id ELSE supplier_id END",
                      payment_type="CASE WHEN id % 97 = 0 THEN 'barter' ELSE payment_type END",
                      amount_paid=f"CASE WHEN id % 89 = 0 THEN CAST(-1 AS {M}) ELSE amount_paid END"),
    "payments": _raw("payments", "id sale_id amount method", sale_id="CASE WHEN id % 101 = 0 THEN -sale_id ELSE sale_id END",
                     method="CASE WHEN id % 97 = 0 THEN 'shells' ELSE method END"),
    "supplier_payments": _raw("supplier_payments", "id supplier_id amount method",
                              supplier_id="CASE WHEN id % 101 = 0 THEN -supplier_id ELSE supplier_id END",
                              method="CASE WHEN id % 97 = 0 THEN 'iou' ELSE method END"),
    "expenses": _raw("expenses", "id amount", amount=f"CASE WHEN id % 97 = 0 THEN CAST(-amount AS {M}) ELSE amount END"),
    "products": _raw("products", "id category_id quantity", category_id="CASE WHEN id % 53 = 0 THEN 99 ELSE category_id END",
                     quantity=f"CASE WHEN id % 97 = 0 THEN CAST(-quantity AS {M}) ELSE quantity END"),
    "sale_items": _raw("sale_items", "sale_id product_id line_total", sale_id="CASE WHEN sale_id % 101 = 0 THEN -sale_id ELSE sale_id END",
                       product_id="CASE WHEN product_id % 103 = 0 THEN -product_id ELSE product_id END"),
    "purchase_items": _raw("purchase_items", "purchase_id product_id line_total",
                           purchase_id="CASE WHEN purchase_id % 101 = 0 THEN -purchase_id ELSE purchase_id END",
                           product_id="CASE WHEN product_id % 103 = 0 THEN -product_id ELSE product_id END"),
}


def _supplier_lines(d: Dialect) -> str:
    """Supplier records as CSV lines (A4): some with too few or too many fields, some without a name."""
    return f"""
SELECT CAST(c_custkey AS BIGINT) AS seq,
       CASE c_custkey % 12 WHEN 3 THEN c_name WHEN 5 THEN c_name || ',1,2,3' WHEN 7 THEN '  ,' || CAST(c_nationkey AS STRING) || ','
            ELSE '"  ' || c_name || ', Ltd ",' || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE CAST(c_nationkey AS STRING) END || ','
                 || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'net 30' END END AS raw
FROM {d.t('customer')}"""


def _category_lines(d: Dialect) -> str:
    """Category records as JSON lines (A4): cut off, no object, without a name, known and repeated names."""
    o, c = ("{{", "}}") if d.spark else ("{", "}")  # spark.sql reads single braces as names of frames
    return f"""
SELECT CAST(p_partkey AS BIGINT) AS seq,
       CASE p_partkey % 11 WHEN 2 THEN '{o}"name": "' || p_brand WHEN 4 THEN '{o}"name": null{c}' WHEN 6 THEN '[1, 2'
            WHEN 8 THEN '{o}"name": " ECONOMY"{c}' ELSE '{o}"name": " KIND ' || CAST(p_partkey % 40 AS STRING) || ' "{c}' END AS raw
FROM {d.t('part')}"""


def _supplier_payment_entries(d: Dialect) -> str:
    """Raw supplier payments (K7): unknown suppliers, unreadable amounts, no date, no method."""
    return f"""
SELECT id, CASE WHEN id % 13 = 0 THEN -supplier_id ELSE supplier_id END AS supplier_id,
       CASE WHEN id % 6 = 0 THEN NULL ELSE date END AS date,
       CASE WHEN id % 17 = 0 THEN '' WHEN id % 19 = 0 THEN '-5' WHEN id % 23 = 0 THEN 'abc' ELSE CAST(amount AS STRING) END AS amount,
       CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE method END AS method,
       CASE WHEN id % 3 = 0 THEN 'by bank' WHEN id % 3 = 1 THEN '' END AS note
FROM {d.t('supplier_payments')}"""


VIEWS: dict[str, tuple[callable, tuple[str, ...]]] = {
    "categories": (_categories, ()),
    "products": (_products, ("part", "categories")),
    "sale_items": (_sale_items, ("lineitem", "products")),
    "sales": (_sales, ("orders", "customer", "sale_items")),
    "repayment_requests": (_repayment_requests, ("lineitem", "sales")),
    "repayment_entries": (_repayment_entries, ("repayment_requests",)),
    "payments": (_payments_sql, ("sales", "repayment_requests")),
    "suppliers": (_suppliers, ("supplier",)),
    "purchase_items": (_purchase_items, ("lineitem", "products")),
    "purchases": (_purchases, ("purchase_items",)),
    "supplier_payments": (_supplier_payments, ("lineitem",)),
    "entered_purchases": (_entered_purchases, ("purchases",)),
    "expenses": (_expenses, ("events",)),
    "cash_adjustments": (_cash_adjustments, ("events",)),
    "stock_adjustments": (_stock_adjustments, ("lineitem",)),
    "code_scans": (_code_scans, ("lineitem",)),
    "cash_requests": (_cash_requests, ("events",)),
    "expense_requests": (_expense_requests, ("events",)),
    "expense_edits": (_expense_edits, ("events",)),
    "product_requests": (_product_requests, ("part",)),
    "supplier_requests": (_supplier_requests, ("supplier",)),
    "product_changes": (_product_changes, ("part",)),
    "product_edits": (_product_edits, ("part",)),
    "category_edits": (_category_edits, ("supplier",)),
    "supplier_edits": (_supplier_edits, ("supplier",)),
    "supplier_lines": (_supplier_lines, ("customer",)),
    "category_lines": (_category_lines, ("part",)),
    "supplier_payment_entries": (_supplier_payment_entries, ("supplier_payments",)),
    **{f"raw_{t}": (view, (t,)) for t, view in RAW.items()},
}


def view_order(names) -> list[str]:
    """Views needed for ``names`` (with their dependencies), dependencies first."""
    out: list[str] = []

    def visit(n):
        if n in SOURCES or n in out:
            return
        for dep in VIEWS[n][1]:
            visit(dep)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(sql: str, names) -> str:
    """Prefix an oracle query with the DuckDB CTEs of the views it reads."""
    ctes = [f"{n} AS ({VIEWS[n][0](DUCK)}\n)" for n in view_order(names)]
    if not ctes:
        return sql
    body = sql.lstrip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[15:]
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + sql


class Retail:
    """Lazily built retail tables for one data directory (each is a plan, not data)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def source(self, name: str) -> DataFrame:
        key = "src:" + name
        if key not in self._frames:
            self._frames[key] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._frames[key]

    def __getitem__(self, name: str) -> DataFrame:
        if name in SOURCES:
            return self.source(name)
        if name not in self._frames:
            self._frames[name] = self._build(name)
        return self._frames[name]

    def kept(self, views: tuple[str, ...] | dict[str, str]) -> Retail:
        """Views that a query reads several times, built once and written; a dict names the columns it reads of each."""
        for name in views:
            columns = views[name].split() if isinstance(views, dict) else ["*"]
            self._frames[name] = written(self[name].select(*columns), f"view-{name}")
        return self

    def _build(self, name: str) -> DataFrame:
        if name in ("sale_docs", "purchase_docs"):
            from . import docs

            return getattr(docs, name)(self)
        if name == "payments":
            from ..operators.credit import payments_from_requests

            return payments_from_requests(self["sales"], self["repayment_requests"])
        fn, deps = VIEWS[name]
        return self.spark.sql(fn(SPARK), **{dep: self[dep] for dep in deps})
