"""Tables that grow with the input are not broadcast, however small their compressed files are."""

from __future__ import annotations

import json
import re

from tillspark.operators import posting, sequential
from tillspark.session import written
from tillspark.sources import docs


def _broadcast_keys(df) -> set[str]:
    """First keys of the joins that are planned as broadcasts."""
    return set(re.findall(r"BroadcastHashJoin \[(\w+)#", df._jdf.queryExecution().executedPlan().toString()))


def test_documents_and_names_are_not_broadcast(spark, frame, monkeypatch):
    products = written(frame("products", [{"id": p, "name": f"item{p}", "selling_price": 2, "quantity": 3} for p in (1, 2)]), "products")
    # each basket waits for the one before it: several rounds
    feed = [{"ref": i, "date": f"2024-01-01 10:00:{i:02}", "items": [{"product_id": 1 + i % 2, "quantity": "2"}, {"product_id": 1, "quantity": "1"}]}
            for i in range(6)] + [{"ref": 9, "items": []}]
    planned = []

    def kept(df, name):
        planned.append((name, _broadcast_keys(df)))
        return written(df, name)

    for module in (sequential, posting):
        monkeypatch.setattr(module, "written", kept)
    # as the registered queries read it: the feed is in files, too
    docs_json = written(spark.createDataFrame([(json.dumps(d),) for d in feed], "doc string"), "feed")
    run = sequential.SequentialPosting(docs_json, products, replay_rows=0)
    rejects = run.rejects()
    planned.append(("rejects", _broadcast_keys(rejects)))
    planned.append(("sales", _broadcast_keys(run.sales())))
    assert sum(name == "verdict" for name, _ in planned) > 1
    assert [x for x in planned if x[1] & {"ref", "_product"}] == []
    # 0 takes 3 of item1; 1 needs 1 of item1; 3 and 5 as well; 2 and 4 need 3
    assert {r.ref: r.message for r in rejects.collect()} == {
        1: "Not enough stock for item1 (have 0, need 1)", 2: "Not enough stock for item1 (have 0, need 2)",
        3: "Not enough stock for item1 (have 0, need 1)", 4: "Not enough stock for item1 (have 0, need 2)",
        5: "Not enough stock for item1 (have 0, need 1)", 9: "At least one item is required"}
    assert [r.ref for r in run.sales().collect()] == [0]


def test_customers_are_not_broadcast(spark):
    line = ("l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, "
            "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz")
    r = {"lineitem": spark.createDataFrame([], line),
         "orders": spark.createDataFrame([(1, 2, None, "2-HIGH"), (2, None, None, "2-HIGH"), (3, 7, None, "2-HIGH")],
                                         "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderpriority string"),
         "customer": written(spark.createDataFrame([(2, "Ann"), (None, "Bob")], "c_custkey long, c_name string"), "customer")}
    feed = docs.sale_docs(r)
    assert "o_custkey" not in _broadcast_keys(feed)
    assert {x.ref: json.loads(x.doc).get("customer_name") for x in feed.collect()} == {1: "Ann", 2: None, 3: None}
