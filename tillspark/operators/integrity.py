"""Integrity and cleaning jobs.

SQLite enforced NOT NULL, UNIQUE, foreign keys and cascades row by row.  On
Parquet these become batch checks: a catalogue of relations for foreign keys and
deletes, grouped counts for uniqueness, and rules compiled into one aggregate a table.  Each check reports counts, not rows pulled to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import MONEY, TOTAL, falsy_default, total
from ..sources.schemas import align_schema as _align


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def clean_products(requests: DataFrame) -> DataFrame:
    """New products as the reference stores them (A4, L2, H1): a falsy value takes the default.

    ``sku || null``, ``barcode || null``, ``category_id || null``, prices and
    quantity ``|| 0``, ``reorder_level ?? 5`` (only NULL takes 5).  Rows
    without a name are left to ``reject_missing``.
    """
    r = requests.filter(F.col("name").isNotNull() & (F.col("name") != ""))
    zero = F.lit(0).cast(MONEY)

    def num_or_zero(c):
        v = F.col(c).cast(MONEY)
        return F.when(v.isNull() | (v == 0), zero).otherwise(v)

    return r.select(
        "id", "name",
        F.nullif(F.col("sku"), F.lit("")).alias("sku"),
        F.nullif(F.col("barcode"), F.lit("")).alias("barcode"),
        F.when(F.col("category_id") == 0, F.lit(None)).otherwise(F.col("category_id")).cast("long").alias("category_id"),
        num_or_zero("cost_price").alias("cost_price"),
        num_or_zero("selling_price").alias("selling_price"),
        num_or_zero("quantity").alias("quantity"),
        F.coalesce(F.col("reorder_level").cast(MONEY), F.lit(5).cast(MONEY)).alias("reorder_level"),
    )


def reject_missing(product_requests: DataFrame, supplier_requests: DataFrame) -> DataFrame:
    """Rows lacking a required name (L1): products need a non-empty name, suppliers a non-blank one."""
    p = product_requests.filter(F.col("name").isNull() | (F.col("name") == "")).select(
        F.lit("products").alias("entity"), "id", F.lit("Product name is required").alias("reason"))
    s = supplier_requests.filter(F.col("name").isNull() | (F.trim("name") == "")).select(
        F.lit("suppliers").alias("entity"), "id", F.lit("Supplier name is required").alias("reason"))
    return p.unionByName(s)


def duplicate_keys(keyed: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Values of a unique key held by more than one row, NULLs allowed many times (L3)."""
    parts = []
    for table, (df, key) in keyed.items():
        parts.append(
            df.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("value")).agg(
                F.count(F.lit(1)).alias("rows")
            ).filter(F.col("rows") > 1).select(F.lit(table).alias("table"), F.lit(key).alias("key"), "value", "rows")
        )
    return _union(parts)


@dataclass(frozen=True)
class Relation:
    """A foreign key: ``child.fk`` names a row of ``parent``; ``action`` is what its deletion does to the child."""

    child: str
    fk: str
    parent: str
    action: str


# The relations of the retail tables and their delete actions, parents before children.
RELATIONS = (
    Relation("products", "category_id", "categories", "set null"),
    Relation("sale_items", "sale_id", "sales", "cascade"),
    Relation("sale_items", "product_id", "products", "set null"),
    Relation("payments", "sale_id", "sales", "cascade"),
    Relation("purchases", "supplier_id", "suppliers", "set null"),
    Relation("purchase_items", "purchase_id", "purchases", "cascade"),
    Relation("purchase_items", "product_id", "products", "set null"),
    Relation("supplier_payments", "supplier_id", "suppliers", "cascade"),
    Relation("supplier_payments", "purchase_id", "purchases", "set null"),
)
# The tables, parents before children, and the amount that is summed of each.
TABLES = {
    "categories": None, "products": "quantity", "sales": "total", "sale_items": "line_total", "payments": "amount", "suppliers": None,
    "purchases": "total", "purchase_items": "line_total", "supplier_payments": "amount", "expenses": "amount", "cash_adjustments": "amount",
}

_TENDERS, _METHODS = "('cash', 'card', 'credit')", "('cash', 'card', 'bank')"
# A rule's name, its table and what breaks it (S17); money may not be negative, tenders are closed lists.
RULES = (
    ("sales.payment_type", "sales", f"payment_type IS NULL OR payment_type NOT IN {_TENDERS}"),
    ("sales.negative_money", "sales", "total < 0 OR discount < 0 OR amount_paid < 0"),
    ("sales.overpaid", "sales", "amount_paid > total"),
    ("purchases.payment_type", "purchases", f"payment_type IS NULL OR payment_type NOT IN {_TENDERS}"),
    ("purchases.negative_money", "purchases", "total < 0 OR amount_paid < 0"),
    ("supplier_payments.method", "supplier_payments", f"method NOT IN {_METHODS}"),
    ("payments.method", "payments", f"method NOT IN {_METHODS}"),
    ("expenses.amount", "expenses", "amount <= 0"),
    ("products.negative_stock", "products", "quantity < 0"),
)


def broken_rules(df: DataFrame, table: str, rules=RULES) -> Column:
    """array<string>: the names of the rules that a row of ``table`` breaks, in the order of the rules."""
    own = [F.when(F.coalesce(F.expr(cond), F.lit(False)), F.lit(name)) for name, t, cond in rules if t == table]
    return F.array_compact(F.array(*own)) if own else F.array().cast("array<string>")


def rule_breaks(t, table: str, rules=RULES) -> DataFrame:
    """Rows of a table that break a rule, with the rules they break."""
    found = t[table].withColumn("broken", broken_rules(t[table], table, rules))
    return found.filter(F.size("broken") > 0)


def domain_violations(t, rules=RULES) -> DataFrame:
    """Rows outside the allowed values or signs (L5, S17): one row per rule with its count.

    The rules of a table are compiled into one aggregate, so each table is read once.
    """
    parts = []
    for table in dict.fromkeys(r[1] for r in rules):
        own = [(name, cond) for name, of, cond in rules if of == table]
        counted = t[table].agg(*[F.count_if(F.expr(cond)).alias(f"r{i}") for i, (_, cond) in enumerate(own)])
        rows = F.array(*[F.struct(F.lit(name).alias("check"), F.col(f"r{i}").alias("violations")) for i, (name, _) in enumerate(own)])
        parts.append(counted.select(F.inline(rows)))
    return _union(parts)


def _flagged(child: DataFrame, relations: list[Relation], keys: dict[str, DataFrame], mark: str) -> DataFrame:
    """The child with a boolean per relation, ``mark`` + its key: whether its parent's key is in ``keys``.

    The last relation comes first: lines arrive by product, so only the flags of the others move them.
    """
    for r in reversed(relations):
        ids = keys[r.parent].select(F.col("id").alias(r.fk)).distinct().withColumn(f"{mark}{r.fk}", F.lit(True))
        child = child.join(ids, r.fk, "left").withColumn(f"{mark}{r.fk}", F.coalesce(f"{mark}{r.fk}", F.lit(False)))
    return child


def orphan_items(t, relations=RELATIONS[:-1]) -> DataFrame:
    """Foreign keys that point nowhere (L4, C13): one row per relation with the orphan count; a child is read once."""
    parts = []
    for table in dict.fromkeys(r.child for r in relations):
        own = [r for r in relations if r.child == table]
        child = _flagged(t[table].select(*dict.fromkeys(r.fk for r in own)), own, {r.parent: t[r.parent] for r in own}, "_has_")
        counted = child.agg(*[F.count_if(F.col(r.fk).isNotNull() & ~F.col(f"_has_{r.fk}")).alias(f"r{i}") for i, r in enumerate(own)])
        rows = F.array(*[F.struct(F.lit(f"{r.child}.{r.fk}").alias("check"), F.col(f"r{i}").alias("orphans")) for i, r in enumerate(own)])
        parts.append(counted.select(F.inline(rows)))
    return _union(parts)


def _after_deletes(t, deleted: dict[str, DataFrame], relations=RELATIONS) -> dict[str, DataFrame]:
    """Every table with ``_removed`` and, per set-null relation, ``_nulled_<fk>``.

    Tables come parents first.  A table's deleted keys are those named in ``deleted`` and those that a cascade
    reaches; they stay a table of keys and meet each child in one left join a relation.
    """
    gone: dict[str, DataFrame] = {}
    out = {}
    for table in TABLES:
        own = [r for r in relations if r.child == table and r.parent in gone]
        rows = _flagged(t[table], own, gone, "_gone_")
        removed = F.lit(False)
        if table in deleted:
            ids = deleted[table].select("id").distinct().withColumn("_named", F.lit(True))
            rows = rows.join(ids, "id", "left")
            removed = F.coalesce("_named", F.lit(False))
        for r in own:
            if r.action == "cascade":
                removed = removed | F.col(f"_gone_{r.fk}")
        rows = rows.withColumn("_removed", removed)
        for r in own:
            if r.action == "set null":
                hit = F.col(f"_gone_{r.fk}") & ~F.col("_removed")
                rows = rows.withColumn(f"_nulled_{r.fk}", hit).withColumn(r.fk, F.when(~hit, F.col(r.fk)))
        if table in deleted or any(r.action == "cascade" for r in own):
            if any(r.parent == table for r in relations):
                gone[table] = rows.filter("_removed").select("id")
        out[table] = rows.drop("_named", *[f"_gone_{r.fk}" for r in own])
    return out


def delete_rows(t, deleted: dict[str, DataFrame], relations=RELATIONS) -> dict[str, DataFrame]:
    """All tables after deleting the rows named by ``deleted`` (table: frame with ``id``) through the relations."""
    return {
        name: rows.filter("NOT _removed").select(*t[name].columns)
        for name, rows in _after_deletes(t, deleted, relations).items()
    }


def delete_state(t, deleted: dict[str, DataFrame], relations=RELATIONS) -> DataFrame:
    """What a delete leaves (L6–L8): per table the rows kept and removed, the keys set to NULL and the amount kept; a table is read once."""
    parts = []
    for name, rows in _after_deletes(t, deleted, relations).items():
        nulled = [F.col(c).cast("int") for c in rows.columns if c.startswith("_nulled_")]
        kept = ~F.col("_removed")
        amount = F.when(kept, F.col(TABLES[name])) if TABLES[name] else F.lit(0)
        parts.append(rows.agg(
            F.count_if(kept).alias("rows"), F.count_if(F.col("_removed")).alias("removed"),
            F.coalesce(F.sum(sum(nulled, F.lit(0))), F.lit(0)).cast("long").alias("keys_set_null"),
            total(F.coalesce(F.sum(amount), F.lit(0))).alias("amount"),
        ).select(F.lit(name).alias("table"), "rows", "removed", "keys_set_null", "amount"))
    return _union(parts)


def set_null(child: DataFrame, fk: str, deleted: DataFrame, pk: str = "id") -> DataFrame:
    """``ON DELETE SET NULL``: the child's ``fk`` becomes NULL where the parent was deleted."""
    gone = deleted.select(F.col(pk).alias("_gone")).distinct()
    j = child.join(gone, child[fk] == gone._gone, "left")
    return j.select(*[F.when(F.col("_gone").isNotNull(), F.lit(None)).otherwise(F.col(c)).alias(c) if c == fk else F.col(c)
                      for c in child.columns])


def cascade(child: DataFrame, fk: str, deleted: DataFrame, pk: str = "id") -> DataFrame:
    """``ON DELETE CASCADE``: children of deleted parents go too (L7); anti-join, no collect."""
    gone = deleted.select(F.col(pk).alias(fk))
    return child.join(gone, fk, "left_anti")


def delete_cascade(t, deleted_sales: DataFrame, deleted_suppliers: DataFrame, deleted_expenses: DataFrame) -> DataFrame:
    """Rows and money left in each table after deleting sales, suppliers and expenses."""
    sales = t["sales"].join(deleted_sales.select("id"), "id", "left_anti")
    items = cascade(t["sale_items"], "sale_id", deleted_sales)
    pays = cascade(t["payments"], "sale_id", deleted_sales)
    sups = t["suppliers"].join(deleted_suppliers.select("id"), "id", "left_anti")
    sp = cascade(t["supplier_payments"], "supplier_id", deleted_suppliers)
    purch = set_null(t["purchases"], "supplier_id", deleted_suppliers)
    exp = t["expenses"].join(deleted_expenses.select("id"), "id", "left_anti")

    def summary(name, df, amount):
        return df.agg(F.count(F.lit(1)).alias("rows"), total(F.coalesce(F.sum(amount), F.lit(0))).alias("amount")).select(
            F.lit(name).alias("table"), "rows", "amount")

    return _union([
        summary("sales", sales, "total"), summary("sale_items", items, "line_total"), summary("payments", pays, "amount"),
        summary("suppliers", sups, F.lit(0)), summary("supplier_payments", sp, "amount"),
        summary("purchases_without_supplier", purch.filter(F.col("supplier_id").isNull()), "total"),
        summary("expenses", exp, "amount"),
    ])


def reconcile(t, supplier_closing: DataFrame, fifo_after: DataFrame, cash_ledger_total: DataFrame,
              cash_on_hand: DataFrame, payments_after: DataFrame) -> DataFrame:
    """Invariants as (check, mismatches, difference).

    Sale and purchase headers against their lines; each supplier's ledger
    close against its dues after FIFO less the excess lost (S10; ``payments_after``);
    the cash ledger's closing balance against the breakdown.
    """
    lines = t["sale_items"].groupBy("sale_id").agg(F.sum(F.col("quantity") * F.col("unit_price")).alias("_l"))
    s = t["sales"].join(lines, t["sales"].id == lines.sale_id, "left").withColumn(
        "_d", F.col("subtotal") - F.coalesce("_l", F.lit(0)))
    plines = t["purchase_items"].groupBy("purchase_id").agg(F.sum("line_total").alias("_l"))
    p = t["purchases"].join(plines, t["purchases"].id == plines.purchase_id, "left").withColumn(
        "_d", F.col("subtotal") - F.coalesce("_l", F.lit(0)))
    dues = fifo_after.groupBy("supplier_id").agg(F.sum("amount_due").alias("_due"))
    lost = payments_after.groupBy("supplier_id").agg(F.sum("lost").alias("_lost"))
    sup = supplier_closing.join(dues, "supplier_id", "left").join(lost, "supplier_id", "left").withColumn(
        "_d", F.col("closing") - F.coalesce("_due", F.lit(0)) + F.coalesce("_lost", F.lit(0)))
    # two one-row figures compared through a union and one sum (no cross join)
    cash = cash_ledger_total.select(F.col("closing").cast(TOTAL).alias("_x")).unionByName(
        cash_on_hand.select((-F.col("cash_on_hand")).cast(TOTAL).alias("_x"))).agg(F.sum("_x").alias("_d"))

    def check(name, df):
        return df.agg(F.count(F.when(F.col("_d") != 0, F.lit(1))).alias("mismatches"),
                      total(F.coalesce(F.sum("_d"), F.lit(0))).alias("difference")).select(
            F.lit(name).alias("check"), "mismatches", "difference")

    return _union([
        check("sale_header_vs_lines", s), check("purchase_header_vs_lines", p),
        check("supplier_ledger_vs_dues", sup), check("cash_ledger_vs_breakdown", cash),
    ])


def upsert(base: DataFrame, changes: DataFrame, key: str = "id", seq: str | None = None) -> DataFrame:
    """Full-replace upsert (K8): the latest change per key replaces the base row; new keys are added.

    ``seq`` orders the changes of a key; without it, and among equal ``seq``, the greatest row wins, so
    that a key never has two rows.
    """
    rest = F.struct(*[c for c in changes.columns if c not in (key, seq)])
    latest = changes.groupBy(key).agg(F.max(F.struct(F.col(seq) if seq else F.lit(0), rest.alias("_c"))).alias("_x"))
    changes = latest.select(key, "_x._c.*")
    changes = changes.select(*base.columns)
    kept = base.join(changes.select(key), key, "left_anti")
    return kept.unionByName(changes)


def align_schema(df: DataFrame, table: str) -> DataFrame:
    """Missing columns added with their defaults, columns cast and ordered."""
    return _align(df, table)


__all__ = [
    "RELATIONS", "RULES", "align_schema", "broken_rules", "cascade", "clean_products", "delete_cascade", "delete_rows", "delete_state",
    "domain_violations", "duplicate_keys", "falsy_default", "orphan_items", "reconcile", "reject_missing", "rule_breaks", "set_null", "upsert",
]
