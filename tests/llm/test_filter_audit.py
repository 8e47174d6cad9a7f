"""Filter audit against a plain count over documents, orders and steps."""

from __future__ import annotations

import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from tillspark.llm import filter_audit

DOCS = "doc_id long, text string, lang string, mask long, digest string, good string, docs long"
LABELS = "doc_id long, quality int, toxic int, part string"


def fails(text, first):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)),
        "E": not first,
    }


def plainly(docs, labels):
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    judged = []
    for i, t, lang in docs:
        own = [(q, x) for j, q, x in labels if j == i and i is not None]
        judged.append((lang or "", fails(t or "", i is None or least[t or ""] == i), any(q == 1 for q, _ in own), any(x == 1 for _, x in own)))
    out = {}
    for part in {j[0] for j in judged}:
        mine = [j[1:] for j in judged if j[0] == part]
        rows = {}
        for order in map("".join, permutations("ABCDE")):
            for step in range(1, 6):
                letter, before = order[step - 1], order[: step - 1]
                c = dict.fromkeys(filter_audit.COUNTS, 0)
                for f, good, toxic in mine:
                    gone = any(f[b] for b in before)
                    c["kept"] += not gone and not f[letter]
                    c["removed"] += not gone and f[letter]
                    c["redundant"] += gone and f[letter]
                    c["unique_fails"] += f[letter] and sum(f.values()) == 1
                    c["good_lost"] += not gone and f[letter] and good
                    c["toxic_lost"] += not gone and f[letter] and toxic
                rows[order, step] = c
        for (order, step), c in rows.items():
            shapley = sum(r["removed"] for (o, s), r in rows.items() if o[s - 1] == order[step - 1])
            out[part, order, step] = (*[c[k] for k in filter_audit.COUNTS], shapley)
    return out


def run(spark, docs, labels):
    d = spark.createDataFrame([(*r, 9, "x", "y", 3) for r in docs], DOCS)
    found = filter_audit.audit(d, spark.createDataFrame([(*r, "z") for r in labels], LABELS))
    assert found.columns == ["part", "filter_order", "step", *filter_audit.COUNTS, "shapley"]
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in found.collect()}


def test_counts_equal_a_plain_count(spark):
    rng = random.Random(2)

    def text():
        kind = rng.randrange(6)
        n = rng.choice([0, 1, 30, 199, 200, 201, 260])
        words = [f"w{rng.randrange(400 if kind % 2 else 60)}" for _ in range(n)]
        if kind == 2 and words:
            words[0] = "#" + words[0]
        if kind == 3:
            words = [w.upper() if rng.random() < 0.2 else w for w in words]
        return rng.choice([" ", "\n", "\t ", "\x0b", "\r\n"]).join(words) + rng.choice(["", " ", "\n"])

    docs = [(i, text(), rng.choice(["en", "de", None, ""])) for i in range(150)]
    docs += [(rng.randrange(400), docs[rng.randrange(20)][1], rng.choice(["en", "fr"])) for _ in range(120)]
    docs += [(5, None, "en"), (6, "", "en"), (7, "a b", "en"), (None, docs[0][1], "en"), (None, "alone", "de"),
             (300, "same", "en"), (300, "same", "en"), (300, "same", "fr"), (301, "same", "fr")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 200, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]
    want = plainly(docs, labels)
    got = run(spark, docs, labels)
    assert got == want
    assert len(got) == 600 * len({r[2] or "" for r in docs})
    assert all(any(v[i] for v in got.values()) for i in range(7))


def test_edge_tables(spark):
    assert run(spark, [], []) == {}
    one = run(spark, [(1, "x y " * 200, "en")], [])
    assert one == plainly([(1, "x y " * 200, "en")], [])
    long = "word" + " longer text" * 200_000
    assert run(spark, [(1, long, None), (2, long, None)], [(2, 1, 1)]) == plainly([(1, long, None), (2, long, None)], [(2, 1, 1)])


def test_fewer_filters_give_fewer_orders(spark):
    docs = spark.createDataFrame([(1, "a#", "en"), (2, "b", "en"), (3, "b", "en")], "doc_id long, text string, lang string")
    found = filter_audit.audit(docs, spark.createDataFrame([], LABELS), "DE", lambda t: {"D": F.contains(t, F.lit("#"))})
    rows = {(r.filter_order, r.step): (r.kept, r.removed, r.shapley) for r in found.collect()}
    assert rows == {("DE", 1): (2, 1, 2), ("DE", 2): (1, 1, 2), ("ED", 1): (2, 1, 2), ("ED", 2): (1, 1, 2)}
