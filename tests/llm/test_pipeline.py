"""The pipeline's stages on a small corpus with planted cases, and the oracles of the registered queries."""

from __future__ import annotations

import collections
import os
import random
import zlib

import numpy as np
import pytest
from test_operators import DOCS, best_distance, brute_classes, words

import corpus_pipeline
from tillspark.llm import decontaminate
from tillspark.llm.common import stage, table
from tillspark.llm.queries import ORACLES, QUERIES, vocabulary_path

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.exists(SF), reason="the driver's tables are absent")


@needs_data
def test_every_stage_keeps_the_columns_and_its_decisions(spark):
    docs = table(spark, SF, "documents")
    names = docs.columns
    counts = [docs.count()]
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, SF), name)
        assert docs.columns == names
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    assert counts[2] == counts[3]  # removing passages removes no document
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(packed["doc_id"]) == {r.doc_id for r in docs.select("doc_id").collect()}
    assert packed.groupby("sequence_id")["length"].sum().max() <= 4096


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(str, got[cols].values.tolist())) == sorted(map(str, want[cols].values.tolist()))


def test_ten_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def brute_stages(rows, bad, items):
    """The rows (doc_id, text) that each stage keeps."""
    kept = [r for r in rows if r[0] not in bad]
    yield kept
    least = {}
    for (i, _), (_, c, _) in zip(kept, brute_classes(kept)):
        least[c] = min(least.get(c, i), i)
    kept = [(i, t) for i, t in kept if i in least.values()]
    yield kept
    raw = [t.encode() for _, t in kept]
    seen = collections.Counter(r[k : k + 200] for r in raw for k in range(len(r) - 199))
    out = []
    for (i, _), r in zip(kept, raw):
        gone = set()
        for k in range(len(r) - 199):
            if seen[r[k : k + 200]] > 1:
                gone.update(range(k, k + 200))
        out.append((i, bytes(b for k, b in enumerate(r) if k not in gone).decode()))
    yield out
    low = [decontaminate.normal(x).strip() for _, x in items]
    yield [(i, t) for i, t in out if not any(best_distance(x, decontaminate.normal(t)) <= int(len(x) * decontaminate.ERROR_RATE) for x in low)]


def test_stages_and_run_equal_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(11)
    rows = [(i, words(rng, rng.randint(20, 50), 3000)) for i in range(300)]
    bad = set(range(0, 300, 3))
    rows = [(i, " ".join(f"{w}$$$" for w in t.split()) if i in bad else t) for i, t in rows]
    items = [(0, words(rng, 12)), (1, words(rng, 15))]
    passage = words(rng, 60)
    rows += [(1000 + k, words(rng, 60 + 10 * k) + " " + passage + " " + words(rng, 60)) for k in range(3)]  # a passage that occurs again
    rows += [(1100 + k, rows[1][1] + " more" * k) for k in range(2)]  # an exact and a near copy
    rows += [(1200 + k, words(rng, 20) + " " + x.upper()[:-1] + "q " + words(rng, 20)) for k, x in items]  # benchmark items, one letter changed
    rows += [(1300, words(rng, 20) + " " + items[0][1][:30] + " " + words(rng, 20))]  # half an item
    spark.createDataFrame([(i, t, "en", "s", len(t), 0.5, 1) for i, t in rows], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i not in bad), 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    sf, want = str(tmp_path), list(brute_stages(rows, bad, items))
    assert [len(w) for w in want] == [208, 206, 206, 204] and want[1] != want[2]
    docs = table(spark, sf, "documents")
    for (name, step), kept in zip(corpus_pipeline.STAGES[:-1], want):
        docs = stage(step(spark, docs, sf), f"test-{name}")
        assert sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()) == sorted(kept), name

    hf = Tokenizer.from_file(vocabulary_path())
    pieces = collections.Counter()
    for i, t in want[-1]:
        ids = [*hf.encode(t, add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            pieces[i, k, zlib.crc32(np.asarray(ids[at : at + 4096], "<u4").tobytes())] += 1
    got = corpus_pipeline.run(spark, sf).select("doc_id", "piece", "ids_crc32").collect()
    assert collections.Counter(map(tuple, got)) == pieces
