"""Ordered edits of keyed tables under a unique key (K8, L3): products by SKU, categories by name, suppliers.

An edit ``(seq, op, id, …columns)`` inserts, updates (full replace) or deletes one
row; edits are posted by ``seq``.  Whether one passes depends on the ones before it:
an accepted edit may take a key or free the one that its row held, and an insert
that was refused leaves nothing for a later update.  An edit passes if

- its required name is there,
- insert: its id does not exist at its turn; update and delete: it does,
- no other row holds its key at its turn (rows without a key never clash).

Edits are replayed in blocks of at most ``replay_rows`` consecutive turns, one task
a block.  A block needs the rows of its ids and the holders of its keys at its first
turn, and tells those that it changed.  All blocks are first replayed from the table
itself; then each one whose needs were changed by blocks before it is replayed again,
until none is.  A round settles at least one more block, the first unsettled one, so
rounds are bounded by blocks however long the chains of edits of the same rows are,
and a block settles at once where its edits do not depend on what was refused before.
Only edits and the rows of the table that they touch take part.

Repeated ``seq`` values are ordered by id; a row whose id is NULL, or whose op is
unknown, is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import dropped, written
from .prefix import running_sum

REPLAY_ROWS = 100_000
ORDER = ["seq", "id", "op"]
OPS = ("insert", "update", "delete")

# Reject codes, and the reference's messages.
MISSING, UNKNOWN, REPEATED, DUPLICATE, BAD_OP = "missing_name", "unknown_id", "repeated_id", "duplicate_key", "bad_edit"


@dataclass(frozen=True)
class Editable:
    """A table's unique key, whether its names are trimmed, and what its rejects say."""

    key: str | None
    missing: str
    duplicate: str = ""
    trimmed: bool = False


TABLES = {
    "products": Editable("sku", "Product name is required", "SKU must be unique"),
    "categories": Editable("name", "Name is required", "Category already exists", trimmed=True),
    "suppliers": Editable(None, "Supplier name is required", trimmed=True),
}


def _static(edits: DataFrame, rule: Editable) -> DataFrame:
    name = F.trim("name") if rule.trimmed else F.col("name")
    bad = F.when(F.col("id").isNull() | ~F.coalesce(F.col("op").isin(*OPS), F.lit(False)), F.lit(BAD_OP)).when(
        (F.col("op") != "delete") & (F.coalesce(name, F.lit("")) == ""), F.lit(MISSING))
    out = edits.withColumn("name", name).withColumn("bad", bad)
    if rule.key and rule.key != "name":
        out = out.withColumn(rule.key, F.nullif(F.col(rule.key), F.lit("")))
    return out


def _replay(block: pa.Table) -> pa.Table:
    """One block in turn: the reason of each edit (empty if it passes), and the rows and holders that it leaves changed."""
    held: dict = {}  # id -> key of an existing row, and whether it holds that key
    holder: dict = {}  # key -> id
    edits, out = [], []
    for kind, n, op, i, k, owns in zip(*(block.column(c).to_pylist() for c in ("kind", "n", "op", "id", "k", "owns"))):
        if kind == "edit":
            edits.append((n, op, i, k))
        elif kind == "row":
            held[i] = k, owns
        else:
            holder[k] = i
    ids, keys = set(), set()
    for n, op, i, k in sorted(edits, key=lambda e: e[0]):
        why = ""
        if (op == "insert") == (i in held):
            why = REPEATED if op == "insert" else UNKNOWN
        elif op != "delete" and k is not None and k in holder and holder[k] != i:
            why = DUPLICATE
        else:
            old, owned = held.pop(i, (None, False))
            ids.add(i)
            if owned:
                holder.pop(old, None)
                keys.add(old)
            if op != "delete":
                held[i] = k, k is not None
                if k is not None:
                    holder[k] = i
                    keys.add(k)
        out.append(("edit", n, None, None, None, None, why))
    out += [("row", None, i, held.get(i, (None, None))[0], i in held, held.get(i, (None, None))[1], None) for i in ids]
    out += [("key", None, holder.get(k), k, k in holder, None, None) for k in keys]
    at = block.schema
    types = {"kind": pa.string(), "n": pa.int64(), "id": at.field("id").type, "k": at.field("k").type, "there": pa.bool_(),
             "owns": pa.bool_(), "why": pa.string()}
    columns = [pa.array(c, t) for c, t in zip(zip(*out), types.values())]
    return pa.table([pa.array([block.column("block")[0].as_py()] * len(out), pa.int64()), *columns], ["block", *types])


_STATE = ("block", "kind", "id", "k", "there", "owns")
_OF = ("kind", "of_id", "of_key")


def _first_states(rows: DataFrame) -> DataFrame:
    """The table's own rows and the holders of their keys, as the states that a block before the first leaves.

    Of rows with the same key the last by id holds it.
    """
    holders = rows.filter("k IS NOT NULL").groupBy("k").agg(F.max("id").alias("id"))
    own = rows.filter("id IS NOT NULL").groupBy("id").agg(F.max("k").alias("k"))
    own = own.join(holders.withColumnRenamed("id", "_holder"), "k", "left")
    states = own.select("id", "k", F.lit("row").alias("kind"), F.coalesce(F.col("_holder") == F.col("id"), F.lit(False)).alias("owns"))
    states = states.unionByName(holders.select("id", "k", F.lit("key").alias("kind"), F.lit(None).cast("boolean").alias("owns")))
    return states.select(F.lit(-1).cast("long").alias("block"), "kind", "id", "k", F.lit(True).alias("there"), "owns")


def _of(states: DataFrame) -> DataFrame:
    """Each state with what it is of: an id (kind ``row``) or a key (kind ``key``)."""
    return states.withColumns({"of_id": F.when(F.col("kind") == "row", F.col("id")), "of_key": F.when(F.col("kind") == "key", F.col("k"))})


def _in_blocks(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """``(n, why)`` of each edit ``(block, n, op, id, k)`` of a table with these ``rows`` ``(id, k)``."""
    first = written(_first_states(rows), "edit-first")
    needs = edits.select("block", F.lit("row").alias("kind"), "id", F.lit(None).cast(edits.schema["k"].dataType).alias("k")).unionByName(
        edits.filter("k IS NOT NULL").select("block", F.lit("key").alias("kind"), F.lit(None).cast(edits.schema["id"].dataType).alias("id"), "k"))
    state = F.when(F.col("there"), F.struct("id", "k", "owns"))
    met = _of(needs.distinct()).select("block", *_OF, F.lit(None).cast("boolean").alias("there"), F.lit(None).cast("boolean").alias("owns"), "id", "k")
    met = written(met.select("block", *_OF, state.alias("met")), "edit-needs")
    before = Window.partitionBy(*_OF).orderBy("block", "left").rowsBetween(Window.unboundedPreceding, -1)
    rounds: list[DataFrame] = []  # what the replays of each round returned
    last: dict[int, int] = {}  # block -> the round that replayed it last
    todo = [r.block for r in edits.select("block").distinct().collect()]
    turns = edits.select("block", F.lit("edit").alias("kind"), "n", "op", "id", "k", F.lit(None).cast("boolean").alias("owns"))
    returned = ", ".join(f"{c} {t}" for c, t in {
        "block": "long", "kind": "string", "n": "long", "id": edits.schema["id"].dataType.simpleString(),
        "k": edits.schema["k"].dataType.simpleString(), "there": "boolean", "owns": "boolean", "why": "string"}.items())

    def standing() -> list[DataFrame]:
        return [r.filter(F.col("block").isin([b for b, at in last.items() if at == i])) for i, r in enumerate(rounds) if i in last.values()]

    while True:
        left = reduce(DataFrame.unionByName, [r.filter("kind <> 'edit'").select(*_STATE) for r in standing()], first)
        # a block's needs come before what it leaves; the last state that an earlier block left is what it meets
        met_or_left = met.withColumn("left", F.lit(0)).unionByName(
            _of(left).select("block", *_OF, F.struct(state.alias("s")).alias("is"), F.lit(1).alias("left")), allowMissingColumns=True)
        found = met_or_left.withColumn("now", F.last("is", ignorenulls=True).over(before)["s"]).filter(F.col("left") == 0)
        found = written(found.select("block", *_OF, "met", "now"), "edit-met")
        dropped(met)
        if rounds:
            todo = [r.block for r in found.filter(~F.col("now").eqNullSafe(F.col("met"))).select("block").distinct().collect()]
        if not todo:
            break
        again = F.col("block").isin(todo)
        starts = found.filter(again & F.col("now").isNotNull()).select(
            "block", "kind", F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("op"), "now.id", "now.k", "now.owns")
        replayed = turns.filter(again).unionByName(starts).groupBy("block").applyInArrow(_replay, returned)
        rounds.append(written(replayed, "edit-replayed"))
        last |= dict.fromkeys(todo, len(rounds) - 1)
        met = found.select("block", *_OF, F.col("now").alias("met"))
        met._stage_path = found._stage_path
    return reduce(DataFrame.unionByName, [r.filter("kind = 'edit'").select("n", "why") for r in standing()])


def judged_edits(base: DataFrame, edits: DataFrame, table: str, replay_rows: int = REPLAY_ROWS, blocks: int | None = None) -> DataFrame:
    """``edits`` with ``reason``: NULL where the edit passes."""
    rule = TABLES[table]
    numbered = running_sum(_static(edits, rule), F.lit(1).cast("long"), [], ORDER, "n", blocks=blocks)
    numbered = written(numbered, "edits")
    key = F.col(rule.key) if rule.key else F.lit(None).cast("string")
    good = numbered.filter("bad IS NULL").select("id", "op", F.when(F.col("op") != "delete", key).alias("k"), "n")
    rows = base.select("id", F.lit("base").alias("op"), key.alias("k"), F.lit(0).cast("long").alias("n"))
    touched = rows.join(good.select("id").distinct(), "id", "left_semi").unionByName(
        rows.join(good.select("id").distinct(), "id", "left_anti").join(good.filter("k IS NOT NULL").select("k").distinct(), "k", "left_semi"))
    events = written(touched.unionByName(good), "edit-events")
    edited = events.filter("op <> 'base'")
    # blocks of whole turns; their number follows from the last turn, which is in the files' footers
    turns = edited.agg(F.max("n")).first()[0] or 0
    size = max(1, -(-turns // blocks) if blocks else replay_rows)
    placed = edited.withColumn("block", F.floor((F.col("n") - 1) / size).cast("long"))
    verdict = _in_blocks(events.filter("op = 'base'"), placed) if turns else edited.select("n", F.lit("").alias("why"))
    return numbered.join(verdict.select("n", "why"), "n", "left").withColumn(
        "reason", F.coalesce("bad", F.nullif("why", F.lit("")))).drop("bad", "why")


def apply_edits(base: DataFrame, edits: DataFrame, table: str, **options) -> DataFrame:
    """The table after its edits: the last passing edit of an id replaces its row, a passing delete removes it."""
    judged = judged_edits(base, edits, table, **options).filter("reason IS NULL")
    cols = [c for c in base.columns if c != "id"]
    held = [F.col(c) if c in judged.columns else F.lit(None).cast(base.schema[c].dataType).alias(c) for c in cols]
    last = judged.groupBy("id").agg(F.max_by(F.struct("op", *held), "n").alias("e"))
    kept = base.join(last.select("id"), "id", "left_anti")
    new = last.filter(F.col("e.op") != "delete").select("id", *[F.col(f"e.{c}").cast(base.schema[c].dataType).alias(c) for c in cols])
    return kept.unionByName(new.select(*base.columns))


def edit_rejects(base: DataFrame, edits: DataFrame, table: str, **options) -> DataFrame:
    """Edits that do not pass, with a reason and the message that the sender would have read."""
    rule = TABLES[table]
    message = (
        F.when(F.col("reason") == MISSING, F.lit(rule.missing)).when(F.col("reason") == DUPLICATE, F.lit(rule.duplicate))
        .when(F.col("reason") == UNKNOWN, F.lit("Not found")).when(F.col("reason") == REPEATED, F.lit("The id exists")).otherwise(F.lit("Invalid edit"))
    )
    return judged_edits(base, edits, table, **options).filter("reason IS NOT NULL").select("seq", "op", "id", "reason", message.alias("message"))
