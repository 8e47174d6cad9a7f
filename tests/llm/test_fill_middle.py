"""Fill-in-middle against a plain rewriting, exact round trips and edge cases."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from tillspark.llm import fill_middle
from tillspark.llm.common import ship

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def plainly(doc_id, text):
    """The contract, read off a list of units."""
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def random_text(rng):
    pool = ["ab", "Zed", " ", "\n", "é", "ß", "9", "<", "P", ">", "<P", "S>", "😀", "a" * 40, "\x00", " "]
    return "".join(rng.choice(pool) for _ in range(rng.randrange(60)))


def test_block_tree_descends_to_the_block_of_a_unit():
    rng = random.Random(3)
    for _ in range(60):
        text = random_text(rng) * rng.randrange(1, 6)
        starts = [m.start() for m in UNIT.finditer(text)]
        for block in (1, 3, 8, 1024):
            index = fill_middle.UnitIndex(text, block)
            assert index.n == len(starts)
            assert [index.cut_after(k) for k in range(index.n + 2)] == [*starts, len(text), len(text)]
            for k in range(index.n):
                at, units, chars = index.tree.block_of(k)
                assert at == starts[k] // block and chars == at * block
                assert units == sum(s < chars for s in starts)


def test_documents_equal_the_plain_rewriting():
    rng = random.Random(5)
    for i in range(3000):
        text = random_text(rng)
        assert fill_middle.fill_middle(str(i), text, block=rng.choice([1, 7, 1024])) == plainly(i, text)


DOCS = "doc_id long, text string, lang string, output string, form long, n string"


def test_query_rows_and_edges(spark):
    ship(spark)
    texts = [None, "", "a", "<P>", "x<S>y", "a <M", "M> b", "two words\n", "ab" * 300_000, "é" * 5000, "tie", "tie"]
    texts += [f"Doc {i}: some text, <P or S> {i}" for i in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(10, "tie"), (None, "no id"), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "mine", 7, "x") for i, t in rows], DOCS)
    done = fill_middle.transformed(docs)
    assert done.columns == ["doc_id", "text", "lang", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = sorted(map(tuple, fill_middle.digests(done).collect()), key=repr)

    def sha(t):
        return hashlib.sha256(t.encode()).hexdigest()

    want = [(i, *(r := plainly(i, t))[:4], sha(r[4]), sha(t or "")) for i, t in rows]
    assert got == sorted(want, key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.digests(fill_middle.transformed(docs.limit(0))).count() == 0


def test_sentinels_must_be_marks():
    with pytest.raises(ValueError):
        fill_middle.FimSpec(prefix="PRE")
    with pytest.raises(ValueError):
        fill_middle.FimSpec(prefix="<S>")
