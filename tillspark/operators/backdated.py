"""First-in-first-out allocation where purchases are entered after later-dated ones.

A payment goes to the oldest *dates* among the dues that had been *posted* when it
was.  While dues are posted in date order, the closed form of ``suppliers``
holds.  From a supplier's first due that is posted behind a later-dated one (its
first violation) the queue is served out of posting order, so:

1. up to the violation the closed form gives what is left of each due;
2. the rest of the supplier, the dues carried over and everything posted from
   then on, is settled exactly by halving.

Halving: the dues are ranked by (date, id).  A payment serves the older half as if
the younger half did not exist, so the older half with all payments is a smaller
problem of the same kind, and how much each payment leaves over for the younger
half follows from one reflected running sum over the older half.  Payments go down
to the half, or both halves, that they reach.  A part with one due is a sum, a part
of at most ``leaf_rows`` rows is replayed by one task, and larger ones are halved
again: a supplier with a billion dues takes about fifteen rounds, each an ordered
scan in blocks of rows, and never meets in one task.

Posting time is ``created_at`` of a purchase (its date where there is none) and the
date of a payment; at one instant dues come before payments, then ids decide.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import TOTAL, total
from ..session import dropped, written
from .prefix import running_max, running_sum, sums_and_min

DUE, PAY = 0, 1
LEAF_ROWS = 50_000
POSTED = ["posted", "kind", "id"]


def posted_events(purchases: DataFrame, supplier_payments: DataFrame) -> DataFrame:
    """Dues (+) and payments (−) of every supplier with their posting time."""
    dues = purchases.filter((F.col("amount_due") > 0) & F.col("supplier_id").isNotNull()).select(
        "supplier_id", F.coalesce("created_at", "date").alias("posted"), F.lit(DUE).alias("kind"), "id", "date",
        F.col("amount_due").cast(TOTAL).alias("v"))
    pays = supplier_payments.select(
        "supplier_id", F.col("date").alias("posted"), F.lit(PAY).alias("kind"), "id", "date",
        (-F.col("amount")).cast(TOTAL).alias("v"))
    return dues.unionByName(pays)


def is_backdated(purchases: DataFrame) -> DataFrame:
    """Dues posted at another time than their date: without any, dues are posted in date order."""
    open_ = (F.col("amount_due") > 0) & F.col("supplier_id").isNotNull()
    return purchases.filter(open_ & ~F.col("created_at").eqNullSafe(F.col("date")) & F.col("created_at").isNotNull()).select("supplier_id")


def fifo_order_violations(purchases: DataFrame, blocks: int | None = None) -> DataFrame:
    """Credit purchases posted behind one of a later (date, id): payments serve them out of posting order."""
    late = is_backdated(purchases).distinct()
    dues = posted_events(purchases, purchases.sparkSession.createDataFrame([], "supplier_id long, date timestamp_ntz, id long, amount decimal(18,2)"))
    dues = dues.join(late, "supplier_id", "left_semi")
    seen = running_max(dues, F.struct("date", "id"), ["supplier_id"], POSTED, "latest", inclusive=False, blocks=blocks)
    return seen.filter(F.struct("date", "id") < F.col("latest")).select(
        "supplier_id", F.col("id").alias("purchase_id"), "date", "posted",
        F.col("latest.date").alias("queued_date"), F.col("latest.id").alias("queued_id"))


def _replayed(rows: pd.DataFrame) -> pd.DataFrame:
    """What is left of each due of one part, by a queue over its rows in posting order."""
    queue, left = [], {}
    for row in rows.sort_values(POSTED, na_position="first").itertuples(index=False):
        if row.kind == DUE:
            heapq.heappush(queue, (row.rank, row.id))
            left[row.id] = row.v
            continue
        money = -row.v
        while queue and money > 0:
            _, due = queue[0]
            pay = min(money, left[due])
            left[due] -= pay
            money -= pay
            if left[due] == 0:
                heapq.heappop(queue)
    return pd.DataFrame({"supplier_id": rows.supplier_id.iloc[0], "id": list(left), "left": list(left.values())})


_LEFT = "supplier_id long, id long, left decimal(38,2)"


def settle(events: DataFrame, leaf_rows: int = LEAF_ROWS, blocks: int | None = None) -> DataFrame:
    """(supplier_id, id, left) of every due of ``events`` after all its payments, whatever order the dues were posted in."""
    is_due = F.col("kind") == DUE
    dues = running_sum(events.filter(is_due), F.lit(1).cast("long"), ["supplier_id"], ["date", "id"], "rank", blocks=blocks)
    ranked = dues.select(*events.columns, "rank").unionByName(events.filter(~is_due).withColumn("rank", F.lit(None).cast("long")))
    part = written(ranked.withColumn("node", F.lit(1).cast("decimal(38,0)")), "settle")
    found = []
    while True:
        sizes = part.groupBy("supplier_id", "node").agg(
            F.count(F.lit(1)).alias("rows"), F.count(F.when(is_due, 1)).alias("dues"), F.min("rank").alias("low"), F.max("rank").alias("high"))
        sized = part.join(sizes.filter("dues > 0"), ["supplier_id", "node"])
        # one due: what was paid after it was posted, by aggregation
        place = F.struct(*POSTED)
        single = sized.filter((F.col("dues") == 1) & (F.col("rows") > leaf_rows))
        small = sized.filter(F.col("rows") <= leaf_rows)
        found.append(small.select(*part.columns).groupBy("supplier_id", "node").applyInPandas(_replayed, _LEFT))
        alone = single.filter(is_due).select("supplier_id", "node", F.col("id").alias("due"), place.alias("at"))
        after = single.filter(~is_due).join(alone, ["supplier_id", "node"]).filter(place > F.col("at"))
        paid = after.groupBy("supplier_id", "node").agg(F.sum("v").alias("paid"))
        found.append(single.filter(is_due).join(paid, ["supplier_id", "node"], "left").select(
            "supplier_id", "id", F.greatest(F.lit(0), F.col("v") + F.coalesce("paid", F.lit(0))).cast(TOTAL).alias("left")))
        big = sized.filter((F.col("dues") > 1) & (F.col("rows") > leaf_rows))
        if big.isEmpty():
            break
        older = is_due & (F.col("rank") <= F.floor((F.col("low") + F.col("high")) / 2))
        big = written(big.withColumn("older", older), "halves")
        keep = [c for c in part.columns if c != "node"]
        scanned, _ = sums_and_min(
            big.filter(F.col("older") | ~is_due).select(*part.columns), "v", ["supplier_id", "node"], POSTED, "S", "m", min_before_out="mb", blocks=blocks)
        lost = F.greatest(F.lit(0), -F.col("m")) - F.greatest(F.lit(0), -F.coalesce("mb", F.lit(0)))
        pays = written(scanned.filter(~is_due).withColumn("over", lost.cast(TOTAL)), "reach")
        down = big.filter(is_due).select(*keep, (F.col("node") * 2 + F.when(F.col("older"), 0).otherwise(1)).cast("decimal(38,0)").alias("node"))
        into = pays.withColumn("v", (F.col("v") + F.col("over")).cast(TOTAL)).filter("v < 0").select(*keep, (F.col("node") * 2).cast("decimal(38,0)").alias("node"))
        past = pays.withColumn("v", (-F.col("over")).cast(TOTAL)).filter("v < 0").select(*keep, (F.col("node") * 2 + 1).cast("decimal(38,0)").alias("node"))
        part = written(down.unionByName(into).unionByName(past), "settle")
        dropped(big)
        dropped(pays)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def fifo_posted(purchases: DataFrame, supplier_payments: DataFrame, leaf_rows: int = LEAF_ROWS, blocks: int | None = None) -> DataFrame:
    """(supplier_id, id, date, v, left) of every due, exact for backdated purchases."""
    events = written(posted_events(purchases, supplier_payments), "events")
    is_due, place = F.col("kind") == DUE, F.struct(*POSTED)
    broken = written(fifo_order_violations(purchases, blocks).groupBy("supplier_id").agg(
        F.min(F.struct("posted", F.lit(DUE).alias("kind"), F.col("purchase_id").alias("id"))).alias("cut")), "violations")
    ev, _ = sums_and_min(events, "v", ["supplier_id"], POSTED, "S", "m", sums={"D": F.when(is_due, F.col("v")).otherwise(F.lit(0))}, blocks=blocks)
    ev = written(ev.join(broken, "supplier_id", "left").withColumns({
        "early": F.col("cut").isNull() | (place < F.col("cut")),
        "applied": F.col("D") - F.col("S") - F.greatest(F.lit(0), -F.col("m"))}), "posted")
    settled = ev.filter("early").groupBy("supplier_id").agg(F.max("applied").alias("A"))  # what is applied never falls
    spent = F.coalesce("A", F.lit(0)) - (F.col("D") - F.col("v"))
    dues = ev.filter(is_due).join(settled, "supplier_id", "left").withColumn(
        "left", F.when(F.col("early"), F.col("v") - F.least("v", F.greatest(F.lit(0), spent))).otherwise(F.col("v")).cast(TOTAL))
    dues = written(dues.select("supplier_id", "posted", "kind", "id", "date", "v", "left", "early", F.col("cut").isNotNull().alias("broken")), "dues")
    rest = dues.filter("broken AND left > 0").withColumn("v", F.col("left")).select(*events.columns)
    later = ev.filter(~is_due & ~F.col("early")).select(*events.columns)
    rest_left = settle(rest.unionByName(later), leaf_rows, blocks).withColumnRenamed("left", "after")
    return dues.join(rest_left, ["supplier_id", "id"], "left").select(
        "supplier_id", "id", "date", "posted", "v", F.coalesce("after", "left").alias("left"))


def allocation(purchases: DataFrame, supplier_payments: DataFrame, **options) -> DataFrame:
    """Each credit purchase's due before and after all supplier payments, in the columns of ``suppliers.fifo_allocation``."""
    return fifo_posted(purchases, supplier_payments, **options).select(
        "supplier_id", F.col("id").alias("purchase_id"), "date", total("v").alias("due_before"),
        total(F.col("v") - F.col("left")).alias("settled"), total("left").alias("amount_due"), (F.col("left") == 0).alias("settled_in_full"))
