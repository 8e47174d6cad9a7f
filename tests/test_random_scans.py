"""Randomised brute force: the two-phase scans and FIFO against plain Python loops."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from tillspark.operators import backdated, prefix, suppliers


def _events(rng: random.Random, n: int, keys: int):
    base = dt.datetime(2024, 1, 1)
    out = []
    for i in range(n):
        out.append((rng.randrange(keys), base + dt.timedelta(hours=rng.randrange(24 * 20)), i, float(rng.randint(-50, 50))))
    return out


def test_running_sum_min_and_carry_match_loops(spark):
    rng = random.Random(7)
    data = _events(rng, 600, 3)
    df = spark.createDataFrame(data, "k long, date timestamp_ntz, id long, v double")
    df = df.withColumn("v", F.col("v").cast("decimal(18,2)")).withColumn(
        "c", F.when(F.col("id") % 4 == 0, F.col("v")))
    out = prefix.running_sum(df, "v", ["k"], ["date", "id"], "s")
    out = prefix.running_sum_and_min(out, "v", ["k"], ["date", "id"], "s2", "m", min_before_out="mb")
    out = prefix.carry_forward(out, "c", ["k"], ["date", "id"], "cf")
    got = {r.id: (float(r.s), float(r.s2), float(r.m), None if r.mb is None else float(r.mb),
                  None if r.cf is None else float(r.cf)) for r in out.collect()}
    exp = {}
    for k in range(3):
        s, m, last = 0.0, None, None
        for key, date, i, v in sorted((e for e in data if e[0] == k), key=lambda e: (e[1], e[2])):
            mb = m
            s += v
            m = s if m is None else min(m, s)
            if i % 4 == 0:
                last = v
            exp[i] = (s, s, m, mb, last)
    assert got == exp


def test_global_running_sum_no_key(spark):
    rng = random.Random(3)
    data = _events(rng, 300, 1)
    df = spark.createDataFrame(data, "k long, date timestamp_ntz, id long, v double")
    out = prefix.running_sum(df, "v", [], ["date", "id"], "s")
    got = {r.id: r.s for r in out.collect()}
    s, exp = 0.0, {}
    for _, _, i, v in sorted(data, key=lambda e: (e[1], e[2])):
        s += v
        exp[i] = s
    assert got == exp


def _fifo_loop(events):
    """The reference's loop: dues queue oldest first; a payment pays down dues, excess lost."""
    dues, lost = {}, {}
    order = []
    for date, kind, i, amt in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        if kind == 0:
            dues[i] = amt
            order.append(i)
        else:
            remaining = amt
            for d in order:
                if remaining <= 0:
                    break
                pay = min(remaining, dues[d])
                dues[d] -= pay
                remaining -= pay
            lost[i] = remaining
    return dues, lost


def test_fifo_matches_loop(spark, frame):
    rng = random.Random(11)
    base = dt.datetime(2024, 1, 1)
    for trial in range(3):
        events = []
        for i in range(40):
            kind = rng.random() < 0.45
            events.append((base + dt.timedelta(days=rng.randrange(30)), int(kind), i + 1, float(rng.randint(1, 300))))
        purchases = frame("purchases", [
            {"id": i, "supplier_id": 1, "date": d.isoformat(sep=" "), "total": a, "amount_paid": 0, "amount_due": a,
             "payment_type": "credit", "invoice_no": f"P{i}"} for d, k, i, a in events if k == 0])
        pays = frame("supplier_payments", [
            {"id": i, "supplier_id": 1, "date": d.isoformat(sep=" "), "amount": a, "method": "cash"}
            for d, k, i, a in events if k == 1])
        dues, lost = _fifo_loop(events)
        got = {r.purchase_id: float(r.amount_due) for r in suppliers.fifo_allocation(purchases, pays).collect()}
        assert got == {i: v for i, v in dues.items()}
        got_lost = {r.payment_id: float(r.lost) for r in suppliers.fifo_payments(purchases, pays).collect()}
        assert got_lost == lost
        links = suppliers.fifo_links(purchases, pays).groupBy("purchase_id").agg(F.sum("amount").alias("a")).collect()
        settled = {r.purchase_id: float(r.a) for r in links}
        for d, k, i, a in events:
            if k == 0:
                assert settled.get(i, 0.0) == a - dues[i]


def _posted_loop(dues, pays):
    """The reference's loop in posting order: a payment goes to the oldest dated dues entered so far."""
    left = {}
    for _, kind, i in sorted([(d[1], 0, i) for i, d in dues.items()] + [(p[0], 1, i) for i, p in pays.items()]):
        if kind == 0:
            left[i] = dues[i][2]
            continue
        money = pays[i][1]
        for k in sorted(left, key=lambda k: (dues[k][0], k)):
            pay = min(money, left[k])
            left[k] -= pay
            money -= pay
    return left


def test_backdated_dues_match_the_posting_loop(spark, frame):
    rng = random.Random(5)
    base = dt.datetime(2024, 1, 1)
    purchases, payments, want = [], [], {}
    for supplier, late in ((1, 0.5), (2, 0.1), (3, 0.0), (4, 1.0)):
        dues, pays = {}, {}
        for i in range(28):
            day = base + dt.timedelta(days=rng.randrange(30))
            dues[100 * supplier + i] = (day, day + dt.timedelta(days=rng.randrange(20) if rng.random() < late else 0), rng.randint(1, 200))
        for i in range(24):
            pays[100 * supplier + i] = (base + dt.timedelta(days=rng.randrange(45)), rng.randint(1, 250))
        purchases += [{"id": i, "supplier_id": supplier, "date": d, "created_at": p, "amount_due": v} for i, (d, p, v) in dues.items()]
        payments += [{"id": i, "supplier_id": supplier, "date": d, "amount": a} for i, (d, a) in pays.items()]
        want.update(_posted_loop(dues, pays))
    p, sp = frame("purchases", purchases), frame("supplier_payments", payments)
    whole = {r.purchase_id: float(r.amount_due) for r in suppliers.fifo_allocation(p, sp).collect()}
    assert whole == want and len({v for v in want.values()}) > 5
    halved = {r.purchase_id: float(r.amount_due) for r in backdated.allocation(p, sp, leaf_rows=12, blocks=3).collect()}
    assert halved == want
    hit = {r.purchase_id for r in backdated.fifo_order_violations(p).collect()}
    rows = {r["id"]: r for r in purchases}
    assert hit == {i for i, r in rows.items() if any(
        o["supplier_id"] == r["supplier_id"] and (o["created_at"], o["id"]) < (r["created_at"], i) and (o["date"], o["id"]) > (r["date"], i)
        for o in purchases)}
    assert {i // 100 for i in hit} == {1, 2, 4}


def test_a_single_due_with_many_payments_is_summed(frame):
    p = frame("purchases", [{"id": 1, "supplier_id": 1, "date": "2024-01-09 00:00:00", "created_at": "2024-01-09 00:00:00", "amount_due": 500},
                            {"id": 2, "supplier_id": 1, "date": "2024-01-01 00:00:00", "created_at": "2024-01-20 00:00:00", "amount_due": 70}])
    sp = frame("supplier_payments", [{"id": i, "supplier_id": 1, "date": f"2024-01-{d:02} 12:00:00", "amount": 20} for i, d in enumerate(range(5, 29))])
    got = {r.purchase_id: float(r.amount_due) for r in backdated.allocation(p, sp, leaf_rows=2).collect()}
    assert got == {2: 0.0, 1: 500.0 - 220.0 - (180.0 - 70.0)}


def test_scans_move_no_copy_of_what_they_sum_or_order_by(spark, monkeypatch):
    from tillspark.operators import prefix

    moved, in_blocks = [], prefix.in_blocks

    def seen(df, *args):
        moved.append(df.columns)
        return in_blocks(df, *args)

    monkeypatch.setattr(prefix, "in_blocks", seen)
    df = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (2, 1, None)], "k int, t int, v int")
    sums = prefix.running_sum(df, "v", ["k"], ["t"], "s", blocks=2)
    last = prefix.carry_forward(df, "v", ["k"], ["t"], "w", blocks=2)
    assert sorted(tuple(r) for r in sums.select("k", "t", "s").collect()) == [(1, 1, 2), (1, 2, 5), (2, 1, 0)]
    assert sorted(tuple(r) for r in last.filter("k = 1").select("t", "w").collect()) == [(1, 2), (2, 3)]
    assert moved == [["k", "t", "v"]] * 2


def test_a_view_read_several_times_is_built_once(spark, monkeypatch):
    from tillspark.registry import QUERIES
    from tillspark.sources import mapping

    built, own = [], mapping.written

    def kept(df, name):
        built.append(name)
        return own(df, name)

    monkeypatch.setattr(mapping, "written", kept)
    r = mapping.Retail(spark, "/root/testdata/sf0.001")
    plain = mapping.Retail(spark, "/root/testdata/sf0.001")["sales"]
    assert QUERIES["orphan_items"](r).count() == 8
    assert built == ["view-sales", "view-purchases"] and r["sales"].dtypes == plain.dtypes
    assert r["sales"].exceptAll(plain).isEmpty() and plain.exceptAll(r["sales"]).isEmpty()
