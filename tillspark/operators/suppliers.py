"""Supplier ledger and first-in-first-out payment allocation.

FIFO without a loop.  Per supplier, take the events in posting order
``(posting time, dues before payments, id)`` with value ``+due`` for a credit purchase
and ``-amount`` for a payment, and let ``S`` be their running sum.  Paying
more than is owed loses the excess (S10), so what is outstanding is the
walk ``S`` reflected at zero: ``O = S + L`` with ``L = max(0, -min S)`` the
excess lost so far.  Hence each payment applies ``amount - ΔL``; the total
applied ``A = Σ amounts - L_final`` fills the dues in order, and due *i* with
cumulative span ``[C_{i-1}, C_i)`` keeps ``due_i - clamp(A - C_{i-1}, 0, due_i)``.
Exact while dues are posted in date order (the reference sorts dues by date);
``backdated`` settles the others.

Running sums and minima go through the two-phase scans of ``prefix``, so one
supplier with a third of all purchases is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import MONEY, to_number, total
from ..functions.period import posted_at
from .backdated import DUE, PAY, POSTED, allocation, is_backdated, posted_events
from .prefix import carry_forward, running_sum, sums_and_min

def ledger_entries(purchases: DataFrame, supplier_payments: DataFrame) -> DataFrame:
    """Purchases as debit (plus the paid-at-purchase credit when > 0) ∪ supplier payments."""
    entry = "struct({sub} AS sub, '{typ}' AS type, {deb} AS debit, {cred} AS credit, {note} AS note)"
    per_purchase = purchases.filter(F.col("supplier_id").isNotNull()).select(
        "supplier_id", "date", F.lit(0).alias("grp"), "id", F.col("invoice_no").alias("ref"),
        F.lit(None).cast("string").alias("method"),
        F.explode(F.expr(
            "filter(array("
            + entry.format(sub=0, typ="purchase", deb="total", cred="CAST(0 AS DECIMAL(18,2))", note="CAST(NULL AS STRING)")
            + ", "
            + entry.format(sub=1, typ="payment", deb="CAST(0 AS DECIMAL(18,2))", cred="amount_paid", note="'Paid at purchase'")
            + "), e -> e.sub = 0 OR e.credit > 0)"
        )).alias("e"),
    ).select("supplier_id", "date", "grp", "id", "e.sub", "e.type", "ref", "method", "e.note", "e.debit", "e.credit")
    pays = supplier_payments.select(
        "supplier_id", "date", F.lit(1).alias("grp"), "id", F.lit(0).alias("sub"), F.lit("payment").alias("type"),
        F.coalesce("note", F.lit("Payment")).alias("ref"), "method", F.lit(None).cast("string").alias("note"),
        F.lit(0).cast(MONEY).alias("debit"), F.col("amount").alias("credit"),
    )
    return per_purchase.unionByName(pays)


def supplier_ledger(purchases: DataFrame, supplier_payments: DataFrame) -> DataFrame:
    """Every supplier's entries with the running balance."""
    e = ledger_entries(purchases, supplier_payments)
    run = running_sum(e, F.col("debit") - F.col("credit"), ["supplier_id"], ["date", "grp", "id", "sub"], "balance")
    return run.select(
        "supplier_id", "date", "type", "ref", "method", "note", "debit", "credit", total("balance").alias("balance")
    )


def supplier_closing(purchases: DataFrame, supplier_payments: DataFrame) -> DataFrame:
    """Closing balance per supplier = Σ debits − Σ credits, by aggregation only."""
    e = ledger_entries(purchases, supplier_payments)
    return e.groupBy("supplier_id").agg(
        total(F.sum("debit")).alias("debits"), total(F.sum("credit")).alias("credits"),
        total(F.sum(F.col("debit") - F.col("credit"))).alias("closing"), F.count(F.lit(1)).alias("entries"),
    )


def fifo_scan(purchases: DataFrame, supplier_payments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dues and payments with S, L before/after and cumulative dues D, and each supplier's totals.

    One scan gives every running value; the totals come from its block summaries.
    """
    is_due = F.col("kind") == DUE
    ev, per_supplier = sums_and_min(
        posted_events(purchases, supplier_payments), "v", ["supplier_id"], POSTED, "S", "minS",
        min_before_out="minS_prev", sums={"D": F.when(is_due, F.col("v")).otherwise(F.lit(0))})
    lost_after = F.greatest(F.lit(0), -F.least(F.lit(0), F.col("minS")))
    lost_before = F.greatest(F.lit(0), -F.least(F.lit(0), F.coalesce(F.col("minS_prev"), F.lit(0))))
    applied = per_supplier.select(
        "supplier_id",
        (F.col("D") - F.col("S") - F.greatest(F.lit(0), -F.least(F.lit(0), F.col("minS")))).alias("A_total"))
    return ev.withColumn("L", lost_after).withColumn("L_prev", lost_before), applied


Scan = tuple[DataFrame, DataFrame]


def fifo_events(purchases: DataFrame, supplier_payments: DataFrame) -> DataFrame:
    return fifo_scan(purchases, supplier_payments)[0]


def fifo_allocation(purchases: DataFrame, supplier_payments: DataFrame, scan: Scan | None = None) -> DataFrame:
    """Each credit purchase's due before and after all supplier payments, oldest paid first.

    Feeds with dues posted at another time than their date take the exact way of ``backdated``.  ``scan`` is the
    ``fifo_scan`` of the same tables, if the caller has it.
    """
    if not is_backdated(purchases).isEmpty():
        return allocation(purchases, supplier_payments)
    ev, applied = scan or fifo_scan(purchases, supplier_payments)
    dues = ev.filter(F.col("kind") == DUE).join(applied, "supplier_id")
    c_start = F.col("D") - F.col("v")
    settled = F.least(F.col("v"), F.greatest(F.lit(0), F.col("A_total") - c_start))
    return dues.select(
        "supplier_id", F.col("id").alias("purchase_id"), "date",
        total("v").alias("due_before"), total(settled).alias("settled"),
        total(F.col("v") - settled).alias("amount_due"), (F.col("v") - settled == 0).alias("settled_in_full"),
    )


def fifo_payments(purchases: DataFrame, supplier_payments: DataFrame, scan: Scan | None = None) -> DataFrame:
    """Each supplier payment's applied part and the excess lost (S10); ``scan`` as in ``fifo_allocation``."""
    ev = (scan or fifo_scan(purchases, supplier_payments))[0].filter(F.col("kind") == PAY)
    lost = F.col("L") - F.col("L_prev")
    return ev.select(
        "supplier_id", F.col("id").alias("payment_id"), "date", total(-F.col("v")).alias("amount"),
        total(-F.col("v") - lost).alias("applied"), total(lost).alias("lost"),
    )


def fifo_links(purchases: DataFrame, supplier_payments: DataFrame) -> DataFrame:
    """Which payment settled how much of which purchase (C14).

    On the cumulative-money axis each due covers ``[C_{i-1}, C_i)`` and each
    payment's applied part covers ``[A_{k-1}, A_k)``; a link is a non-empty
    overlap.  Instead of joining all dues with all payments of a supplier,
    the interval ends are merged into one sorted sequence and each end looks
    ahead (a backward fill) for the due and the payment covering the segment
    that ends there — linear in the number of events.
    """
    ev = fifo_events(purchases, supplier_payments)
    a_end = F.col("D") - F.col("S") - F.col("L")
    applied = -F.col("v") - (F.col("L") - F.col("L_prev"))
    is_due = F.col("kind") == DUE
    # one pass over the events: a due contributes its span end, a payment its applied span end;
    # a payment that applied nothing spans no money and is dropped (payment ends stay strictly increasing)
    pts = ev.filter(is_due | (applied > 0)).select(
        "supplier_id", "kind", F.when(is_due, F.col("D")).otherwise(a_end).alias("x"),
        F.when(is_due, F.struct(F.col("id").alias("purchase_id"), (F.col("D") - F.col("v")).alias("lo"),
                                F.col("D").alias("hi"))).alias("due"),
        F.when(~is_due, F.struct(F.col("id").alias("payment_id"), (a_end - applied).alias("lo"),
                                 a_end.alias("hi"))).alias("pay"),
    ).withColumn("nx", -F.col("x")).withColumn("nk", -F.col("kind"))
    pts = carry_forward(pts, ["due", "pay"], ["supplier_id"], ["nx", "nk"], ["due_c", "pay_c"])
    pairs = pts.filter(F.col("due_c").isNotNull() & F.col("pay_c").isNotNull()).select(
        "supplier_id", F.col("due_c.purchase_id").alias("purchase_id"), F.col("pay_c.payment_id").alias("payment_id"),
        (F.least("due_c.hi", "pay_c.hi") - F.greatest("due_c.lo", "pay_c.lo")).alias("amt"),
    ).filter(F.col("amt") > 0)
    return pairs.groupBy("supplier_id", "purchase_id", "payment_id").agg(total(F.max("amt")).alias("amount"))


# Reject codes of supplier payments, the reference's messages and its default note.
BAD_AMOUNT, UNKNOWN_SUPPLIER = "bad_amount", "unknown_supplier"
MSG_AMOUNT, MSG_SUPPLIER, PAYMENT_NOTE = "Valid amount required", "Supplier not found", "Payment to supplier"


def _judged_payments(entries: DataFrame, suppliers: DataFrame) -> DataFrame:
    amount = to_number("amount").try_cast(MONEY)
    known = suppliers.select(F.col("id").alias("supplier_id"), F.lit(True).alias("_known"))
    reason = F.when(amount.isNull() | (amount <= 0), F.lit(BAD_AMOUNT)).when(F.col("_known").isNull(), F.lit(UNKNOWN_SUPPLIER))
    return entries.join(known, "supplier_id", "left").withColumn("reason", reason).withColumn("_a", amount)


def clean_supplier_payments(entries: DataFrame, suppliers: DataFrame, as_of: str | None = None) -> DataFrame:
    """Supplier payments from raw entries ``(id, supplier_id, date, amount, method, note)`` (K7, H5).

    The amount is read like ``Number()`` and must be above 0, the supplier must exist; a missing date is ``as_of``,
    an empty method cash, an empty note the usual one.
    """
    return _judged_payments(entries, suppliers).filter(F.col("reason").isNull()).select(
        "id", "supplier_id", posted_at("date", as_of).alias("date"), F.col("_a").alias("amount"),
        F.coalesce(F.nullif("method", F.lit("")), F.lit("cash")).alias("method"),
        F.coalesce(F.nullif("note", F.lit("")), F.lit(PAYMENT_NOTE)).alias("note"),
    )


def supplier_payment_rejects(entries: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Entries that are no payments: an amount that is missing, unreadable or not above 0, or an unknown supplier (K7)."""
    message = F.when(F.col("reason") == BAD_AMOUNT, F.lit(MSG_AMOUNT)).otherwise(F.lit(MSG_SUPPLIER))
    return _judged_payments(entries, suppliers).filter(F.col("reason").isNotNull()).select(
        "id", "supplier_id", "amount", "reason", message.alias("message"))
