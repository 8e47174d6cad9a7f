"""Bulk posting of sale and purchase documents.

The reference posts one basket per HTTP request inside a transaction; any
failing line rolls back the whole basket.  Here a batch of baskets is posted
at once: parse once → explode → price → fold per document and product → fold
per document, which gives its totals and its reason (the first failing line, by
position) together.  Nothing is collected; both folds are partial aggregates.

Stock rule (S15): by default a line fails when the basket's total for that
product exceeds the opening stock; ``per_line=True`` compares each line alone,
as the reference does.  Here baskets are checked against opening stock, not
against each other — ``shortage_flags`` marks where cumulative demand across
baskets would run out, and ``sequential`` posts them one after the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import MONEY, QUANTITY, TOTAL, to_number, total
from ..sources.intake import PURCHASE_DOC, SALE_DOC, parse_docs, purchase_lines, sale_lines
from ..session import written
from .prefix import running_sum

# Reject codes in check order, and the reference's messages.
REJECT_EMPTY = "empty"
REJECT_NOT_FOUND = "not_found"
REJECT_QUANTITY = "bad_quantity"
REJECT_STOCK = "no_stock"
REJECT_COST = "bad_cost"
FIRST_PAYMENT_NOTE = "Initial payment at sale"
REJECT_NO_ID = "no_ref"
REJECT_SAME_ID = "repeated_ref"
REJECT_DATE = "bad_date"
REJECT_AMOUNT = "bad_amount"
MSG_NO_ID = "A reference is required"
MSG_SAME_ID = "The reference is not unique"
MSG_DATE = "Invalid date"
MSG_AMOUNT = "Invalid amount"


def _money(c):
    return F.round(c, 2).cast(MONEY)


def line_pricing(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Price each basket line (H17): override or list price, discount ≥ 0, total ≥ 0, page clamp."""
    p = products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"),
                        F.col("selling_price"), F.col("cost_price"), F.col("quantity").alias("stock"))
    x = lines.join(p, "product_id", "left")
    price = F.coalesce(F.col("price_in").try_cast(MONEY), F.col("selling_price"))
    ld = F.greatest(F.lit(0.0), F.coalesce(F.col("ldisc_in"), F.lit(0.0))).try_cast(MONEY)
    gross = F.round(F.col("qty").try_cast(QUANTITY) * price, 2).try_cast(MONEY)
    return x.select(
        "*",
        price.alias("unit_price"),
        ld.alias("line_discount"),
        gross.alias("gross"),
        F.greatest(F.lit(0).cast(MONEY), gross - ld).cast(MONEY).alias("line_total"),
        F.least(ld, F.greatest(gross, F.lit(0).cast(MONEY))).cast(MONEY).alias("page_discount"),
    )


def _doc_reason(n_docs, bad_date, bad_amount):
    """Reason of a document that cannot be posted whatever its lines say.

    A document needs a reference of its own: documents without one, or sharing one, would merge.
    """
    return (
        F.when(F.col("ref").isNull(), F.lit(REJECT_NO_ID)).when(n_docs > 1, F.lit(REJECT_SAME_ID))
        .when(bad_date, F.lit(REJECT_DATE)).when(bad_amount, F.lit(REJECT_AMOUNT))
    )


def _doc_message(reason):
    return (
        F.when(reason == REJECT_NO_ID, F.lit(MSG_NO_ID)).when(reason == REJECT_SAME_ID, F.lit(MSG_SAME_ID))
        .when(reason == REJECT_DATE, F.lit(MSG_DATE)).when(reason == REJECT_AMOUNT, F.lit(MSG_AMOUNT))
    )


def _bad_date():
    day = F.nullif(F.trim("date"), F.lit(""))
    return day.isNotNull() & day.try_cast("timestamp_ntz").isNull()


def _bad_amount():
    return to_number("amount_paid").try_cast(MONEY).isNull() | to_number("discount").try_cast(MONEY).isNull()


def _plain(c):
    return F.regexp_replace(c.cast("double").cast("string"), r"\.0$", "")


def _posted_at(as_of: str | None):
    given = F.nullif(F.trim("date"), F.lit("")).try_cast("timestamp_ntz")
    return F.coalesce(given, F.lit(as_of).cast("timestamp_ntz")) if as_of else given


_SALE_HEAD = ("customer_name", "payment_type", "discount", "amount_paid", "paid_method", "date")


# The faults of a line, in the order in which one line's are checked.
_FAULTS = (REJECT_QUANTITY, REJECT_EMPTY, REJECT_NOT_FOUND, REJECT_STOCK, REJECT_AMOUNT)


def _place(pos, fault):
    """A line's position and fault as one number: the least of a document is its first failing line."""
    code = F.lit(len(_FAULTS))
    for i, name in enumerate(_FAULTS):
        code = F.when(fault == name, F.lit(i)).otherwise(code)
    return F.when(fault.isNotNull(), pos.cast("long") * 8 + code)


def sale_line_rows(docs_json: DataFrame, products: DataFrame) -> DataFrame:
    """Every line of the documents, priced, with the fault it has whatever the stock (one row for an empty basket).

    The documents are parsed here once; everything that K1 returns is made of these rows.  The header and its
    faults stand on a document's first line only, so that they are moved once a document.
    """
    pos = F.coalesce("pos", F.lit(-1))

    def on_first(c):
        return F.when(pos <= 0, c)

    lines = sale_lines(parse_docs(docs_json, SALE_DOC)).select(
        "ref", pos.alias("pos"), "product_id", "qty", "price_in", "ldisc_in", "price_junk", "no_item", _posted_at(None).alias("at"),
        on_first(F.struct(*_SALE_HEAD)).alias("head"), on_first(_bad_date()).alias("bad_date"), on_first(_bad_amount()).alias("bad_amount"),
    )
    q = F.col("qty").try_cast(QUANTITY)
    bad_amount = F.col("gross").isNull() | F.col("line_discount").isNull() | F.col("price_junk") | F.col("ldisc_in").isNull()
    fault = (
        F.when(F.col("no_item"), F.lit(REJECT_EMPTY))
        .when(F.col("product_name").isNull(), F.lit(REJECT_NOT_FOUND))
        .when(q.isNull() | (q <= 0), F.lit(REJECT_QUANTITY))
    )
    return line_pricing(lines, products).select(
        "ref", "at", "head", "pos", "product_id", "product_name", "stock", "cost_price",
        q.alias("quantity"), "qty", "unit_price", "line_discount", "gross", "line_total",
        _place(F.col("pos"), fault).alias("fault"), bad_amount.alias("bad_line"), "bad_date", "bad_amount",
    )


def sale_heads(lines: DataFrame) -> DataFrame:
    """One row per reference: its documents, its header and what is wrong with it."""
    return lines.filter(F.col("pos") <= 0).groupBy("ref").agg(
        F.count(F.lit(1)).alias("docs"), F.first("head").alias("head"),
        F.max("bad_date").alias("bad_date"), F.max("bad_amount").alias("bad_amount"))


def sale_baskets(lines: DataFrame, per_line: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document and product: what it takes and needs of the stock, its sums and its first lines.

    Everything is a partial aggregate, so a reference that very many documents share is folded before it is
    shuffled; but for ``per_line`` all values have a fixed width, so that rows are hashed, not sorted.  ``need`` is
    what is compared with the stock: the basket's sum, or with ``per_line`` its largest line.  A line short of stock
    is the basket's first line, or with ``per_line`` the first whose own quantity exceeds it, which is kept for each
    quantity by ``asked`` (bounded by the basket).
    """
    q = F.col("quantity")
    asked = {"asked": F.array_sort(F.collect_set(F.struct("pos", "quantity", "qty")))} if per_line else {
        "ask_pos": F.min("pos"), "ask_qty": F.min_by("qty", "pos")}
    return lines.groupBy("ref", "product_id").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("gross").alias("gross"), F.sum("line_discount").alias("line_discount"),
        F.sum(q).alias("take"), (F.max(q) if per_line else F.sum(q)).alias("need"), F.first("stock").alias("stock"),
        F.min("fault").alias("fault"), F.min(F.when(F.col("bad_line"), _place(F.col("pos"), F.lit(REJECT_AMOUNT)))).alias("bad_line"),
        *[c.alias(name) for name, c in asked.items()], *[F.first(c).alias(c) for c in keep],
    )


def judged_sales(baskets: DataFrame, heads: DataFrame, per_line: bool = False, stock: str | None = "stock") -> DataFrame:
    """One row per reference: its header and sums, and the reason of the first line that fails, with that line's product,
    quantity and stock.

    ``stock`` names the column with the stock that a basket meets; None leaves the stock unchecked.
    """
    have = F.col(stock) if stock else F.lit(None).cast(QUANTITY)
    if per_line:
        first = F.get(F.filter("asked", lambda a: a["quantity"] > have), F.lit(0))
        ask_pos, ask_qty = first["pos"], first["qty"]
    else:
        ask_pos, ask_qty = F.when(F.col("need") > have, F.col("ask_pos")), F.col("ask_qty")
    short = F.when(ask_pos.isNotNull(), _place(ask_pos, F.lit(REJECT_STOCK)))
    # the first failing line by position; of one line's faults the first checked
    found = baskets.withColumns({"_bad": F.least("fault", short, "bad_line"), "_qty": ask_qty, "_have": have})
    per_ref = found.groupBy("ref").agg(
        F.sum("lines").alias("lines"), F.sum("gross").alias("subtotal"), F.sum("line_discount").alias("line_discount"),
        F.min("_bad").alias("_bad"), *[F.min_by(c, "_bad").alias(to) for c, to in
                                       (("product_id", "_product"), ("_qty", "_qty"), ("_have", "_have"))],
    )
    fault = F.when(F.col("_bad").isNotNull(), F.element_at(F.array(*map(F.lit, _FAULTS)), (F.pmod("_bad", F.lit(8)) + 1).cast("int")))
    # documents without a reference are one row, whatever their lines say
    judged = per_ref.join(heads.hint("merge"), "ref").unionByName(heads.filter(F.col("ref").isNull()), allowMissingColumns=True)
    doc = _doc_reason(F.col("docs"), F.col("bad_date"), F.col("bad_amount"))
    return judged.select(
        "ref", "head.*", "lines", "subtotal", "line_discount", F.coalesce(doc, fault).alias("reason"),
        doc.isNull().alias("_by_line"), "_product", "_qty", "_have",
    )


def sale_rejects(judged: DataFrame, products: DataFrame) -> DataFrame:
    """The references that fail, with reason and message; the products' names are looked up for these alone.

    The names are written and joined by sort and merge: a catalogue is no broadcast, whatever its files' size, and the
    refusals of a best seller are split among tasks, as both sides of the join are plain shuffles.
    """
    names = written(products.groupBy(F.col("id").alias("_product")).agg(F.min("name").alias("_name")), "names")
    refused = judged.filter(F.col("reason").isNotNull()).select("ref", "reason", "_by_line", "_product", "_qty", "_have")
    reason, name = F.col("reason"), F.col("_name")
    # refusals whose message names no product are not moved to the products
    named = F.col("_by_line") & reason.isin(REJECT_QUANTITY, REJECT_STOCK, REJECT_AMOUNT)
    by_line = (
        F.when(reason == REJECT_EMPTY, F.lit("At least one item is required"))
        .when(reason == REJECT_NOT_FOUND, F.concat(F.lit("Product "), F.coalesce(F.col("_product").cast("string"), F.lit("null")), F.lit(" not found")))
        .when(reason == REJECT_QUANTITY, F.concat(F.lit("Invalid quantity for "), name))
        .when(reason == REJECT_STOCK, F.concat(F.lit("Not enough stock for "), name, F.lit(" (have "), _plain(F.col("_have")), F.lit(", need "), _plain(F.col("_qty")), F.lit(")")))
        .otherwise(F.concat(F.lit("Invalid amount for "), name))
    )
    unnamed = refused.filter(~named).withColumn("_name", F.lit(None).cast("string"))
    return unnamed.unionByName(refused.filter(named).join(names.hint("merge"), "_product", "left")).select(
        "ref", "reason", F.when(F.col("_by_line"), by_line).otherwise(_doc_message(reason)).alias("message"))


def _sale_totals(judged: DataFrame, as_of: str | None) -> DataFrame:
    """Headers of the accepted documents: discount = line discounts + order discount, total at least 0, paid and due by tender."""
    disc = F.col("line_discount") + F.coalesce(to_number("discount"), F.lit(0.0)).cast(TOTAL)
    tot = F.greatest(F.lit(0).cast(TOTAL), F.col("subtotal") - disc)
    paid = F.when(F.col("payment_type") == "credit", F.coalesce(to_number("amount_paid"), F.lit(0.0)).cast(TOTAL)).otherwise(tot)
    return judged.filter(F.col("reason").isNull()).select(
        "ref", "customer_name", F.coalesce("payment_type", F.lit("cash")).alias("payment_type"),
        _posted_at(as_of).alias("date"), "lines",
        total("subtotal").alias("subtotal"), total(disc).alias("discount"), total(tot).alias("total"),
        total(paid).alias("amount_paid"), total(F.greatest(F.lit(0), tot - paid)).alias("amount_due"), "paid_method",
    )


def _judged(docs_json: DataFrame, products: DataFrame, per_line: bool) -> DataFrame:
    lines = written(sale_line_rows(docs_json, products).drop("at", "product_name", "cost_price", "unit_price", "line_total"), "sale-lines")
    return judged_sales(sale_baskets(lines, per_line), sale_heads(lines), per_line)


def intake_sales(docs_json: DataFrame, products: DataFrame, per_line: bool = False, as_of: str | None = None) -> DataFrame:
    """Accepted sale documents with their totals.

    ``docs_json`` has one JSON basket per row in column ``doc``.  Totals:
    subtotal = Σ price × qty; discount = Σ line discounts + order discount;
    total = max(0, subtotal − discount); paid = total unless credit (then the
    given amount); due = max(0, total − paid).  A document without a date is posted at ``as_of``.
    """
    return _sale_totals(_judged(docs_json, products, per_line), as_of).drop("paid_method")


def _posted_lines(lines: DataFrame, accepted: DataFrame) -> DataFrame:
    return lines.filter(F.col("ref").isNotNull()).join(accepted.select("ref"), "ref", "left_semi").select(
        "ref", "pos", "product_id", "product_name", "quantity", "unit_price",
        F.col("cost_price").alias("unit_cost"), "line_discount", "line_total",
    )


def posted_sale_items(docs_json: DataFrame, products: DataFrame, per_line: bool = False) -> DataFrame:
    """Line rows of the accepted sale documents, with the product's name and cost at posting (K1)."""
    lines = written(sale_line_rows(docs_json, products).drop("at", "head"), "sale-lines")
    heads = sale_heads(lines.withColumn("head", F.struct(F.lit(None).alias("none"))))
    return _posted_lines(lines, judged_sales(sale_baskets(lines, per_line), heads, per_line).filter(F.col("reason").isNull()))


def _first_payments(headers: DataFrame) -> DataFrame:
    return headers.filter((F.col("payment_type") == "credit") & (F.col("amount_paid") > 0)).select(
        "ref", "date", F.col("amount_paid").alias("amount"), F.lit(FIRST_PAYMENT_NOTE).alias("note"),
        F.coalesce(F.nullif("paid_method", F.lit("")), F.lit("cash")).alias("method"),
    )


def posted_payments(docs_json: DataFrame, products: DataFrame, per_line: bool = False, as_of: str | None = None) -> DataFrame:
    """First instalments of the accepted credit sales that paid something (K1)."""
    return _first_payments(_sale_totals(_judged(docs_json, products, per_line), as_of))


def _stock_after(products: DataFrame, sold: DataFrame) -> DataFrame:
    """Each product's stock before and after what was ``taken`` of it."""
    stock = products.select(F.col("id").alias("product_id"), F.col("quantity").alias("before"))
    per_product = sold.groupBy("product_id").agg(F.sum("taken").alias("_sold"))
    left = F.col("before") - F.coalesce("_sold", F.lit(0))
    return stock.join(per_product, "product_id", "left").select("product_id", "before", total(left).alias("after"))


def stock_after_sales(docs_json: DataFrame, products: DataFrame, per_line: bool = False) -> DataFrame:
    """Each product's stock before and after the accepted sale documents (K1)."""
    items = posted_sale_items(docs_json, products, per_line)
    return _stock_after(products, items.select("product_id", F.col("quantity").alias("taken")))


def intake_rejects(docs_json: DataFrame, products: DataFrame, per_line: bool = False) -> DataFrame:
    """Rejected sale documents with the reason of their first failing line (K1)."""
    return sale_rejects(_judged(docs_json, products, per_line), products)


def basket_merge(docs_json: DataFrame, products: DataFrame) -> DataFrame:
    """Same product twice in a basket → one line, quantities added."""
    lines = line_pricing(sale_lines(parse_docs(docs_json, SALE_DOC)), products).filter(~F.col("no_item"))
    return lines.groupBy("ref", "product_id").agg(
        F.count(F.lit(1)).alias("line_count"), total(F.sum(F.col("qty").try_cast(QUANTITY))).alias("quantity"),
        total(F.sum(F.col("qty").try_cast(QUANTITY)) * F.first("selling_price")).alias("gross"),
    )


def shortage_flags(docs_json: DataFrame, products: DataFrame) -> DataFrame:
    """Cumulative demand per product over baskets in (date, ref, pos) order vs opening stock.

    A running sum in ranges of rows: a best seller does not become one task.
    """
    lines = sale_lines(parse_docs(docs_json, SALE_DOC)).filter(~F.col("no_item") & F.col("product_id").isNotNull())
    lines = lines.withColumn("date", _posted_at(None)).withColumn("qty", F.col("qty").try_cast(QUANTITY))
    run = running_sum(lines, "qty", ["product_id"], ["date", "ref", "pos"], "cum_demand")
    stock = products.select(F.col("id").alias("product_id"), F.col("quantity").alias("stock"))
    j = run.join(stock, "product_id", "left")
    return j.select(
        "ref", "pos", "product_id", "date", total("qty").alias("quantity"), total("cum_demand").alias("cum_demand"),
        "stock", (F.col("cum_demand") > F.coalesce(F.col("stock"), F.lit(0))).alias("short"),
    )


_PURCHASE_HEAD = ("supplier_id", "payment_type", "discount", "amount_paid", "note", "date")


def purchase_line_rows(docs_json: DataFrame, products: DataFrame) -> DataFrame:
    """Every line of the documents with its product and its fault (one row for an empty basket); parsed once."""
    p = products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"))
    lines = purchase_lines(parse_docs(docs_json, PURCHASE_DOC)).join(p, "product_id", "left")
    q, cost = F.col("qty").try_cast(QUANTITY), F.col("cost_num").try_cast(MONEY)
    fault = (
        F.when(F.col("no_item"), F.lit(REJECT_EMPTY))
        .when(F.col("product_name").isNull(), F.lit(REJECT_NOT_FOUND))
        .when(q.isNull() | (q <= 0), F.lit(REJECT_QUANTITY))
        .when(cost.isNull() | (cost < 0), F.lit(REJECT_COST))
    )
    return lines.select(
        "ref", *_PURCHASE_HEAD, F.coalesce("pos", F.lit(-1)).alias("pos"), "product_id", "product_name",
        q.alias("quantity"), cost.alias("unit_cost"), _money(q * cost).alias("line_total"), fault.alias("fault"),
        _bad_date().alias("bad_date"), _bad_amount().alias("bad_amount"),
    )


def judged_purchases(lines: DataFrame) -> DataFrame:
    """One row per reference: its header and sums, and the reason and message of the first line that fails."""
    line = F.struct("pos", "fault", "product_id", "product_name")
    per_ref = lines.groupBy("ref").agg(
        F.sum(F.when(F.col("pos") <= 0, 1).otherwise(0)).alias("docs"), F.first(F.struct(*_PURCHASE_HEAD)).alias("head"),
        F.max("bad_date").alias("bad_date"), F.max("bad_amount").alias("bad_amount"),
        F.count(F.lit(1)).alias("lines"), F.sum("line_total").alias("subtotal"),
        F.min(F.when(F.col("fault").isNotNull(), line)).alias("_bad"),
    )
    doc, bad = _doc_reason(F.col("docs"), F.col("bad_date"), F.col("bad_amount")), F.col("_bad")
    text = (
        F.when(bad["fault"] == REJECT_EMPTY, F.lit("At least one item is required"))
        .when(bad["fault"] == REJECT_NOT_FOUND, F.concat(F.lit("Product "), F.coalesce(bad["product_id"].cast("string"), F.lit("null")), F.lit(" not found")))
        .when(bad["fault"] == REJECT_QUANTITY, F.concat(F.lit("Invalid quantity for "), bad["product_name"]))
        .when(bad["fault"] == REJECT_COST, F.concat(F.lit("Invalid cost for "), bad["product_name"]))
    )
    return per_ref.select(
        "ref", "head.*", "lines", "subtotal",
        F.coalesce(doc, bad["fault"]).alias("reason"), F.coalesce(_doc_message(doc), text).alias("message"),
    )


def intake_purchases(docs_json: DataFrame, products: DataFrame, as_of: str | None = None) -> DataFrame:
    """Accepted purchase documents with totals, discount and note."""
    judged = judged_purchases(purchase_line_rows(docs_json, products)).filter(F.col("reason").isNull())
    disc = F.coalesce(to_number("discount"), F.lit(0.0)).cast(TOTAL)
    tot = F.greatest(F.lit(0).cast(TOTAL), F.col("subtotal") - disc)
    paid = F.when(F.col("payment_type") == "credit", F.coalesce(to_number("amount_paid"), F.lit(0.0)).cast(TOTAL)).otherwise(tot)
    return judged.select(
        "ref", "supplier_id", F.coalesce("payment_type", F.lit("cash")).alias("payment_type"),
        _posted_at(as_of).alias("date"), "lines", total("subtotal").alias("subtotal"), total(disc).alias("discount"),
        total(tot).alias("total"), total(paid).alias("amount_paid"),
        total(F.greatest(F.lit(0), tot - paid)).alias("amount_due"), F.nullif("note", F.lit("")).alias("note"),
    )


def purchase_rejects(docs_json: DataFrame, products: DataFrame) -> DataFrame:
    """Rejected purchase documents with the reason of their first failing line (K2)."""
    judged = judged_purchases(purchase_line_rows(docs_json, products))
    return judged.filter(F.col("reason").isNotNull()).select("ref", "reason", "message")


def posted_purchase_items(docs_json: DataFrame, products: DataFrame, as_of: str | None = None) -> DataFrame:
    """Line rows of the accepted purchase documents (K2)."""
    lines = written(purchase_line_rows(docs_json, products).withColumn("date", _posted_at(as_of)), "purchase-lines")
    accepted = judged_purchases(lines.withColumn("date", F.col("date").cast("string"))).filter(F.col("reason").isNull())
    return lines.filter(F.col("ref").isNotNull()).join(accepted.select("ref"), "ref", "left_semi").select(
        "ref", "date", "pos", "product_id", "product_name", "quantity", "unit_cost", "line_total")


def products_after_purchases(docs_json: DataFrame, products: DataFrame, as_of: str | None = None) -> DataFrame:
    """Each product's stock and cost before and after the accepted purchase documents (K2, K5).

    Every line adds its quantity; the cost is that of the last line posted, in (date, ref, line) order (S16).
    One map-side-combined aggregate per product: a product bought by a third of all lines is folded before the shuffle.
    """
    items = posted_purchase_items(docs_json, products, as_of)
    effects = items.groupBy("product_id").agg(
        F.sum("quantity").alias("bought"), F.max_by("unit_cost", F.struct("date", "ref", "pos")).alias("last_cost"),
        F.count(F.lit(1)).alias("lines"))
    base = products.select(F.col("id").alias("product_id"), F.col("quantity").alias("before"), F.col("cost_price").alias("cost_before"))
    return base.join(effects, "product_id", "left").select(
        "product_id", "before", total(F.col("before") + F.coalesce("bought", F.lit(0))).alias("after"),
        "cost_before", F.coalesce("last_cost", "cost_before").alias("cost_after"),
        F.coalesce("lines", F.lit(0)).alias("lines"),
    )
