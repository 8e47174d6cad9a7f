"""Sales posted one after the other (K1, exact mode): an accepted basket takes its stock before the next is checked.

Whether a basket is accepted depends on the accepted baskets before it, through
every product that it shares with them.  Instead of replaying the feed, the
baskets are decided in rounds.  For each undecided basket and product the stock
at its turn lies between two bounds:

- at most, what the baskets accepted so far leave before it;
- at least, the same less everything that undecided baskets before it ask for.

A basket whose needs fit the lower bounds is accepted, one that exceeds an upper
bound is refused, and the others wait for the next round.  The first undecided
basket meets two equal bounds, so every round decides some, and in practice a few
rounds decide nearly all.  A round is one ordered scan in blocks of rows (a best
seller is no task of its own) and one aggregate per basket.  Only products whose
demand exceeds their stock take part, and decided baskets leave the rounds.

Once at most ``replay_rows`` (basket, product) rows wait, one task replays them in
posting order against the stock that the decided ones leave them; that is the
same decision, so the result does not depend on ``replay_rows``.

Tables with a row a document are joined by sort and merge: as compressed files they
look small enough to broadcast when they take hundreds of MB of the driver.

Posting order is (date, reference); baskets without a date come first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from ..functions.money import QUANTITY, TOTAL
from ..session import dropped, written
from . import posting
from .prefix import running_sums

REPLAY_ROWS = 100_000
WIDE = T.DecimalType(38, QUANTITY.scale)
ORDER = ["at", "ref"]


def _refused_in_turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """References refused when the waiting rows, sorted in posting order, are replayed."""
    taken: dict = {}
    rows: list = []

    def judged() -> list:
        fits = all(r.need <= r.left - taken.get(r.product_id, 0) for r in rows)
        if fits:
            for r in rows:
                taken[r.product_id] = taken.get(r.product_id, 0) + r.take
        return [] if fits else [rows[0].ref]

    for batch in batches:
        refused = []
        for row in batch.itertuples(index=False):
            if rows and row.ref != rows[0].ref:
                refused += judged()
                rows = []
            rows.append(row)
        yield pd.DataFrame({"ref": pd.Series(refused, dtype="int64")})
    if rows:
        yield pd.DataFrame({"ref": pd.Series(judged(), dtype="int64")})


def refused_baskets(needs: DataFrame, replay_rows: int = REPLAY_ROWS, blocks: int | None = None) -> DataFrame:
    """References among ``needs`` (ref, at, product_id, take, need, stock) that find too little stock at their turn."""
    per_product = needs.groupBy("product_id").agg(F.sum("take").alias("all"), F.max("need").alias("most"), F.first("stock").alias("has"))
    contested = per_product.filter(F.greatest("all", "most") > F.col("has")).select("product_id")
    state = written(
        needs.join(contested, "product_id", "left_semi").select(
            "ref", "at", "product_id", "take", "need", F.col("stock").cast(WIDE).alias("left"), F.lit(False).alias("posted")),
        "waiting")
    refused = None
    while True:
        scanned = running_sums(
            state, {"gone": F.when(F.col("posted"), F.col("take")).otherwise(0), "ahead": F.when(F.col("posted"), 0).otherwise(F.col("take"))},
            ["product_id"], ORDER, inclusive=False, blocks=blocks)
        waiting = scanned.filter(~F.col("posted")).withColumn("left", (F.col("left") - F.col("gone")).cast(WIDE))
        waiting = written(waiting.select("ref", "at", "product_id", "take", "need", "left", "ahead"), "waiting")
        dropped(state)
        if waiting.count() <= replay_rows:  # counted from the files' footers
            in_order = waiting.select("ref", "product_id", "take", "need", "left", "at").repartition(1).sortWithinPartitions(*ORDER)
            last = in_order.mapInPandas(_refused_in_turn, "ref long")
            return last if refused is None else refused.unionByName(last)
        verdict = waiting.groupBy("ref").agg(
            F.max(F.col("need") > F.col("left")).alias("no"), F.min(F.col("need") <= F.col("left") - F.col("ahead")).alias("yes"))
        verdict = written(verdict, "verdict")
        found = verdict.filter("no").select("ref")
        refused = found if refused is None else refused.unionByName(found)
        state = written(
            waiting.join(verdict.filter("NOT no").hint("merge"), "ref").select("ref", "at", "product_id", "take", "need", "left", F.col("yes").alias("posted")),
            "waiting")
        dropped(waiting)


class SequentialPosting:
    """What K1 returns when baskets are posted in turn; everything is made of one written table of lines."""

    def __init__(self, docs_json: DataFrame, products: DataFrame, per_line: bool = False, as_of: str | None = None,
                 replay_rows: int = REPLAY_ROWS, blocks: int | None = None):
        self.products, self.per_line, self.as_of = products, per_line, as_of
        self.lines = written(posting.sale_line_rows(docs_json, products), "sale-lines")
        baskets = posting.sale_baskets(self.lines, per_line, keep=("at",))
        zero, at = F.lit(0), F.coalesce("at", F.lit(as_of).cast("timestamp_ntz")) if as_of else F.col("at")
        self.baskets = written(baskets.withColumns({
            "at": at, "take": F.coalesce("take", zero).cast(WIDE), "need": F.coalesce("need", zero).cast(WIDE)}), "baskets")
        self.heads = posting.sale_heads(self.lines)
        sound = posting.judged_sales(self.baskets, self.heads, per_line, stock=None).filter(F.col("reason").isNull()).select("ref")
        sound = written(sound, "sound")  # read by the needs and by what is accepted
        needs = self.baskets.join(sound.hint("merge"), "ref", "left_semi").select("ref", "at", "product_id", "take", "need", "stock")
        refused = refused_baskets(needs, replay_rows, blocks).select("ref").distinct()
        self.accepted = written(sound.join(refused.hint("merge"), "ref", "left_anti"), "accepted").hint("merge")
        dropped(sound)
        self.blocks = blocks

    def judged(self) -> DataFrame:
        """Every refused document with the stock that its lines met at its turn."""
        took = self.baskets.join(self.accepted.withColumn("_in", F.lit(True)), "ref", "left").drop("gross", "line_discount")
        at_turn = running_sums(
            took, {"gone": F.when(F.col("_in"), F.col("take")).otherwise(0)}, ["product_id"], ORDER, inclusive=False, blocks=self.blocks)
        met = at_turn.filter(F.col("_in").isNull()).withColumn("stock", F.col("stock") - F.col("gone"))
        met = met.withColumns({c: F.lit(0).cast(TOTAL) for c in ("gross", "line_discount")})
        return posting.judged_sales(met, self.heads, self.per_line)

    def sales(self) -> DataFrame:
        """Headers of the accepted documents; their rows need no second look at the stock."""
        own = self.baskets.join(self.accepted, "ref", "left_semi")
        return posting._sale_totals(posting.judged_sales(own, self.heads, self.per_line, stock=None), self.as_of)

    def rejects(self) -> DataFrame:
        return posting.sale_rejects(self.judged(), self.products)

    def items(self) -> DataFrame:
        return posting._posted_lines(self.lines, self.accepted)

    def payments(self) -> DataFrame:
        return posting._first_payments(self.sales())

    def stock_after(self) -> DataFrame:
        own = self.baskets.join(self.accepted, "ref", "left_semi")
        return posting._stock_after(self.products, own.select("product_id", F.col("take").alias("taken")))


def intake_sales_sequential(docs_json: DataFrame, products: DataFrame, **options) -> DataFrame:
    """Accepted sale documents with their totals, each checked against the stock that earlier ones left (K1)."""
    return SequentialPosting(docs_json, products, **options).sales().drop("paid_method")


def intake_rejects_sequential(docs_json: DataFrame, products: DataFrame, **options) -> DataFrame:
    """Refused documents; a shortage names the stock left at the document's turn (K1)."""
    return SequentialPosting(docs_json, products, **options).rejects()


def stock_after_sequential(docs_json: DataFrame, products: DataFrame, **options) -> DataFrame:
    """Each product's stock before and after the documents posted in turn (K1)."""
    return SequentialPosting(docs_json, products, **options).stock_after()
