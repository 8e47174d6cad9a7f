"""Ordered edits under a unique key, against a plain loop over the table."""

from __future__ import annotations

import random

import pytest

from tillspark.operators import edits

COLS = "seq long, op string, id long, name string, sku string, cost_price decimal(18,2)"


def _loop(base, feed, key, trimmed):
    """The table as a dict that the edits change one by one."""
    table = {r["id"]: dict(r) for r in base}
    rejects = []
    for e in sorted(feed, key=lambda e: (e["seq"], e["id"] if e["id"] is not None else -1, e["op"] or "")):
        name = e["name"].strip(" ") if trimmed and e["name"] is not None else e["name"]
        row = {**e, "name": name, "sku": e["sku"] or None} if not trimmed else {**e, "name": name}
        why = None
        if e["id"] is None or e["op"] not in ("insert", "update", "delete"):
            why = "bad_edit"
        elif e["op"] != "delete" and not name:
            why = "missing_name"
        elif e["op"] == "insert" and e["id"] in table:
            why = "repeated_id"
        elif e["op"] != "insert" and e["id"] not in table:
            why = "unknown_id"
        elif e["op"] != "delete" and row[key] is not None and any(i != e["id"] and r[key] == row[key] for i, r in table.items()):
            why = "duplicate_key"
        if why:
            rejects.append((e["seq"], why))
        elif e["op"] == "delete":
            del table[e["id"]]
        else:
            table[e["id"]] = row
    return {i: (r["name"], r["sku"]) for i, r in table.items()}, sorted(rejects)


@pytest.mark.parametrize("table,replay_rows", [("products", 0), ("products", 10_000), ("categories", 10_000)])
def test_edits_equal_the_loop(spark, frame, table, replay_rows):
    rng = random.Random(3)
    key, trimmed = edits.TABLES[table].key, table == "categories"
    base = [{"id": i, "name": f"n{i}", "sku": f"s{i}" if i % 3 else None} for i in range(1, 7)]
    feed = [{"seq": s, "op": rng.choice(["insert", "update", "update", "delete"]) if s != 20 else "upsert", "id": rng.randrange(1, 12) if s != 21 else None,
             "name": rng.choice([f"n{rng.randrange(1, 9)}", f" n{rng.randrange(1, 9)} ", None if rng.random() < 0.3 else "x", " "]),
             "sku": rng.choice([f"s{rng.randrange(1, 6)}", f"s{rng.randrange(1, 6)}", "", None])} for s in range(60)]
    df = spark.createDataFrame([(e["seq"], e["op"], e["id"], e["name"], e["sku"], None) for e in feed], COLS)
    held = frame(table, [{k: v for k, v in r.items() if k != "sku" or table == "products"} for r in base])
    want, rejects = _loop(base, feed, key, trimmed)
    after = edits.apply_edits(held, df, table, replay_rows=replay_rows, blocks=4).collect()
    if table == "products":
        assert {r.id: (r.name, r.sku) for r in after} == want
    else:
        assert {r.id: r.name for r in after} == {i: v[0] for i, v in want.items()}
    found = edits.edit_rejects(held, df, table, replay_rows=replay_rows, blocks=4).collect()
    assert sorted((r.seq, r.reason) for r in found) == rejects
    assert {w for _, w in rejects} == {"bad_edit", "missing_name", "repeated_id", "unknown_id", "duplicate_key"}


def test_a_freed_key_can_be_taken(spark, frame):
    held = frame("products", [{"id": 1, "name": "tea", "sku": "A"}])
    rows = [(1, "insert", 2, "jam", "A", 1), (2, "update", 1, "tea", "B", 1), (3, "insert", 3, "oat", "A", 1), (4, "delete", 3, None, None, None),
            (5, "insert", 2, "jam", "A", 1)]
    df = spark.createDataFrame([(*r[:5], None) for r in rows], COLS)
    for replay_rows in (100,):
        assert [(r.seq, r.message) for r in edits.edit_rejects(held, df, "products", replay_rows=replay_rows).collect()] == [(1, "SKU must be unique")]
        assert sorted((r.id, r.sku) for r in edits.apply_edits(held, df, "products", replay_rows=replay_rows).collect()) == [(1, "B"), (2, "A")]
    assert edits.apply_edits(held, df.limit(0), "products").count() == 1


def test_a_long_chain_of_edits_takes_no_round_each(spark, frame, monkeypatch):
    """Each edit takes the key that the one before it did not free: a refusal runs through all of them."""
    n, tables = 40, []
    held = frame("products", [{"id": i, "name": f"n{i}", "sku": f"s{i}"} for i in range(1, n + 2)])
    feed = spark.createDataFrame([(n - i, "update", i, "x", f"s{i + 1}", None) for i in range(1, n + 1)], COLS)

    def counted(df, name, written=edits.written):
        tables.append(name)
        assert len(tables) <= 20, "tables of one judgement"
        return written(df, name)

    monkeypatch.setattr(edits, "written", counted)
    found = edits.edit_rejects(held, feed, "products", replay_rows=0, blocks=4).collect()
    assert sorted((r.id, r.reason) for r in found) == [(i, "duplicate_key") for i in range(1, n + 1)]
