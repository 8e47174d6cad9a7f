"""Driver contract and a sample of the oracle comparisons at sf0.001."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
SAMPLE = ["period_kpis", "pnl_statement", "timeseries_month", "top_products", "cash_breakdown", "cash_ledger",
          "supplier_ledger", "fifo_allocation", "repayments_applied", "asof_cost", "intake_sales", "store_summary",
          "inventory_by_category", "invoice_lines", "reconcile", "intake_sales_sequential", "intake_rejects_sequential",
          "products_after_edits", "product_edit_rejects", "fifo_allocation_backdated", "delete_state", "category_intake",
          "sale_documents", "dashboard_json", "raw_domain_violations"]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert [f.name for f in df.schema.fields] == ["line_no", "section", "label", "amount", "is_loss"]


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 75


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("part", "customer", "supplier", "orders", "lineitem", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _norm(df):
    import pandas as pd

    cols = sorted(df.columns)
    out = []
    for rec in df[cols].itertuples(index=False):
        out.append(tuple(None if (v is None or v is pd.NA or (isinstance(v, float) and v != v)) else
                         (round(v, 6) if isinstance(v, float) else v) for v in rec))
    return cols, sorted(out, key=repr)


@pytest.mark.parametrize("name", SAMPLE if not os.environ.get("TILLSPARK_ALL") else sorted(E.oracle_sql()))
def test_oracle(spark, con, name):
    got = _norm(E.queries()[name](spark, SF).toPandas())
    exp = _norm(con.sql(E.oracle_sql()[name]).df())
    assert got == exp
