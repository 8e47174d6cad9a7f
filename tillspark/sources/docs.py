"""JSON basket feeds built from the test tables (inputs of A2/A3 and K1/K2).

One JSON document per order (sales) or per mapped purchase, with its lines in
a fixed order — line number first — so that line positions are reproducible.
Grouping lines into a document is bounded by the basket size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sale_docs(r) -> DataFrame:
    """``(ref, doc)``: every order as a sale request; orders without lines have an empty basket."""
    li = r["lineitem"]
    o = r["orders"]
    c = r["customer"].select(F.col("c_custkey").alias("o_custkey"), "c_name")
    key = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
                   "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    # a line is its key: what the document says of it is read off the sorted keys, so nothing is moved twice
    item = lambda k: F.struct(
        k["l_partkey"].alias("product_id"),
        k["l_quantity"].alias("quantity"),
        F.when(k["l_linenumber"] % 2 == 0, F.floor(k["l_extendedprice"] / k["l_quantity"]).cast("double")).alias("unit_price"),
        F.when(k["l_returnflag"] == "A", k["l_linenumber"].cast("double")).alias("line_discount"),
    )
    baskets = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(key)).alias("xs"))
    # the customer's name meets the order before the basket does: baskets are not moved to it; customers are no broadcast,
    # since their files are a fraction of what they take of the driver's memory
    j = o.join(c.hint("merge"), "o_custkey", "left").join(baskets, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    pt = (F.when(F.col("o_orderpriority") == "1-URGENT", "credit").when(F.col("o_orderpriority") == "2-HIGH", "card")
          .otherwise("cash"))
    doc = F.struct(
        F.col("o_orderkey").alias("ref"),
        F.col("c_name").alias("customer_name"),
        pt.alias("payment_type"),
        F.when(F.col("o_orderkey") % 20 == 0, F.lit(50.0)).alias("discount"),
        F.when((pt == "credit") & (F.col("o_orderkey") % 3 != 0), F.lit(500.0)).alias("amount_paid"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("date"),
        F.coalesce(F.transform("xs", item), F.array()).alias("items"),
    )
    return j.select(F.col("o_orderkey").alias("ref"), F.to_json(doc).alias("doc"))


def purchase_docs(r) -> DataFrame:
    """``(ref, doc)``: every mapped purchase as a purchase request; line 7 carries a negative cost."""
    pi = r["purchase_items"]
    key = F.struct("line_no", "ref", "product_id", "quantity", "unit_cost")
    item = F.struct(
        "product_id", F.col("quantity").cast("double").alias("quantity"),
        F.when(F.col("line_no") == 7, -F.col("unit_cost")).otherwise(F.col("unit_cost")).cast("double").alias("unit_cost"),
    )
    g = pi.groupBy("purchase_id", "supplier_id", "date").agg(
        F.sort_array(F.collect_list(F.struct(key.alias("k"), item.alias("i")))).alias("xs")
    )
    pt = F.when(F.col("purchase_id") % 3 == 0, "cash").when(F.col("purchase_id") % 3 == 1, "card").otherwise("credit")
    doc = F.struct(
        F.col("purchase_id").alias("ref"), "supplier_id", pt.alias("payment_type"),
        F.when(F.col("purchase_id") % 4 == 0, F.lit(25.5)).alias("discount"),
        F.when(pt == "credit", F.lit(100.0)).alias("amount_paid"),
        F.when(F.col("purchase_id") % 5 == 0, F.concat(F.lit("Order "), F.col("purchase_id").cast("string")))
        .when(F.col("purchase_id") % 5 == 1, F.lit("")).alias("note"),
        F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"),
        F.transform("xs", lambda x: x["i"]).alias("items"),
    )
    return g.select(F.col("purchase_id").alias("ref"), F.to_json(doc).alias("doc"))
