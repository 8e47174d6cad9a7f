"""Filter interaction audit: what each filter removes, repeats and alone catches, under every order of the filters.

Every document gets a bit mask of the filters it fails. Documents with the same
part, mask and labels form a cell, so the orders are judged on cells and not on
documents. A cell folds its mask across the array of all orders, which is a
literal of the plan and so sent once to every task: ``aggregate`` walks the steps
of an order with the set of filters already applied, ``transform`` maps that walk
over the orders. Each cell yields one struct of counts per order and step (600 for
five filters), weighted by the cell's documents; the cells of a part are merged by
elementwise sums. A part has at most 2**filters * 4 cells, so its merge is bounded.

Scale: texts are read once and reduced to a mask and a SHA-256 before anything is
shuffled. Equal rows (same text, id and part) are counted before the joins. The
copy filter compares a text's digest with the least id that bears it: the least
ids are found by a map-side-combined aggregate and joined back on digest and id
together, so that a text with a third of all rows is spread by its ids. All joins
are equi-joins without a forced broadcast. There is no Python on the executors.

Edge cases: a null text is empty, a null part is the empty string; null ids have
no smaller id and are nobody's smaller id; rows with the same least id and text
are all first; a document counts as good or toxic if any of its label rows says 1,
null labels say nothing; an empty table gives no part and so no row; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
COPY = "E"


def _words(text: Column) -> Column:
    return F.split(F.btrim(text, F.lit(BLANKS)), r"[\x20\x09-\x0D]+", -1)


def default_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of a text by filter letter (the copy filter is judged table-wide)."""
    words = _words(text)
    blank = F.btrim(text, F.lit(BLANKS)) == ""
    n_words = F.when(blank, 0).otherwise(F.size(words))
    n_distinct = F.when(blank, 0).otherwise(F.size(F.array_distinct(words)))
    return {
        "A": n_words < 200,
        "B": 100 * n_distinct < 50 * n_words,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def _mask(fails: Mapping[str, Column], letters: str) -> Column:
    out = F.lit(0)
    for letter, fail in fails.items():
        out = out + F.when(fail, 1 << letters.index(letter)).otherwise(0)
    return out


def cells(docs: DataFrame, labels: DataFrame, letters: str, filters=default_filters, part: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, docs): documents that fail the same filters and bear the same labels."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    judged = docs.select(
        F.col("doc_id").alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        _mask(filters(text), letters).alias("mask"),
    )
    rows = judged.groupBy("digest", "doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("docs"))
    if COPY in letters:
        first = judged.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
        again = F.col("first").isNull() & F.col("doc_id").isNotNull()
        rows = rows.join(first, ["digest", "doc_id"], "left").withColumn(
            "mask", F.col("mask") + F.when(again, 1 << letters.index(COPY)).otherwise(0))
    flags = (
        labels.groupBy("doc_id")
        .agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
        .where("doc_id IS NOT NULL AND (good OR toxic)")
    )
    held = rows.select("doc_id", "part", "mask", "docs").join(flags, "doc_id", "left")
    return held.groupBy(
        "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")
    ).agg(F.sum("docs").alias("docs"))


def order_array(letters: str) -> Column:
    """array<struct<name, bits>>: every order of the filters and the bit of the filter at each step."""
    names = F.split(F.lit(",".join("".join(p) for p in permutations(letters))), ",")

    def bits(name: Column) -> Column:
        return F.transform(F.split(name, ""), lambda c: F.pow(F.lit(2), F.instr(F.lit(letters), c) - 1).cast("int"))

    return F.transform(names, lambda name: F.struct(name.alias("name"), bits(name).alias("bits")))


def _tallies(make) -> Column:
    return F.struct(*[make(c).cast("long").alias(c) for c in COUNTS])


def folded(cell: Mapping[str, Column], orders: Column) -> Column:
    """One struct of weighted counts per order and step for a cell of documents."""
    mask, weight = cell["mask"], cell["docs"]

    def step(state: Column, bit: Column) -> Column:
        alive = state["applied"].bitwiseAND(mask) == 0
        fails = mask.bitwiseAND(bit) != 0
        holds = {
            "kept": alive & ~fails,
            "removed": alive & fails,
            "redundant": ~alive & fails,
            "unique_fails": mask == bit,
            "good_lost": alive & fails & cell["good"],
            "toxic_lost": alive & fails & cell["toxic"],
        }
        here = _tallies(lambda c: F.when(holds[c], weight).otherwise(0))
        return F.struct(state["applied"].bitwiseOR(bit).alias("applied"), F.concat(state["steps"], F.array(here)).alias("steps"))

    none = F.array().cast(f"array<struct<{','.join(f'{c}:bigint' for c in COUNTS)}>>")
    start = F.struct(F.lit(0).alias("applied"), none.alias("steps"))
    walk = F.transform(orders, lambda o: F.aggregate(o["bits"], start, step, lambda state: state["steps"]))
    return F.flatten(walk)


def audit(docs: DataFrame, labels: DataFrame, letters: str = "ABCDE", filters=default_filters, part: str = "lang") -> DataFrame:
    """One row per part, order and step; ``shapley`` sums a filter's removals over all orders."""
    orders, width = order_array(letters), len(letters)
    cell = {c: F.col(c) for c in ("mask", "good", "toxic", "docs")}
    per_cell = cells(docs, labels, letters, filters, part).select("part", folded(cell, orders).alias("steps"))
    lists = per_cell.groupBy("part").agg(F.collect_list("steps").alias("lists"))

    zeros = F.flatten(F.transform(orders, lambda o: F.transform(o["bits"], lambda bit: _tallies(lambda c: F.lit(0)))))
    merged = F.aggregate("lists", zeros, lambda acc, steps: F.zip_with(acc, steps, lambda a, b: _tallies(lambda c: a[c] + b[c])))
    named = F.flatten(F.transform(orders, lambda o: F.transform(
        o["bits"], lambda bit, i: F.struct(o["name"].alias("filter_order"), (i + 1).alias("step"), bit.alias("bit")))))
    sums = lists.select("part", F.zip_with(named, merged, lambda a, b: F.struct(a.alias("at"), b.alias("n"))).alias("steps"))

    def removed_by(index: int) -> Column:
        own = F.filter("steps", lambda s: s["at"]["bit"] == 1 << index)
        return F.aggregate(own, F.lit(0).cast("long"), lambda acc, s: acc + s["n"]["removed"])

    shapley = F.array(*[removed_by(i) for i in range(width)])
    return (
        sums.select("part", shapley.alias("shapley"), F.explode("steps").alias("s"))
        .select(
            "part", "s.at.filter_order", "s.at.step", *[f"s.n.{c}" for c in COUNTS],
            F.element_at("shapley", F.instr(F.lit(letters), F.substr(F.col("s.at.filter_order"), F.col("s.at.step"), F.lit(1)))).alias("shapley"),
        )
    )
