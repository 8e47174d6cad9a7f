"""Secret scans: base spans and decoding against brute force, the gradient, accuracy on rows not fitted, edge cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from tillspark.llm import secret_crf as S
from tillspark.llm.common import ship

ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_base(text):
    """The contract's patterns, each match judged after it is found."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def test_base_spans_equal_the_patterns():
    rng = random.Random(4)
    pool = ["password", "PassWd", "secret", "ToKen", "api_key", "APIKEY", "=", ":", " ", "  ", '"', "'", "AKIA", "ABCDEFGH1234", "0123456789abcdef",
            "f" * 31, "deadbeef", "é", "ſecret", "toKen", "\t", "\n", "short", "x" * 7, "y" * 8, "a.b=c", "AKIAQ"]
    for _ in range(20_000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(12)))
        assert [s[:3] for s in S.base_matches(text)] == plain_base(text)


def random_moves(rng):
    return np.array([[rng.uniform(-2, 2) for _ in range(3)] for _ in range(3)])


def test_stretches_decode_as_the_whole_chain():
    rng = random.Random(6)
    for _ in range(300):
        n, moves = rng.randrange(1, 7), random_moves(rng)
        leads = np.array([[rng.uniform(-9, 3), rng.uniform(-9, 3)] for _ in range(n)])
        scores = np.pad(leads, ((0, 0), (1, 0)))

        def worth(tags):
            walk = [0, *tags, 0]
            return sum(scores[i, t] for i, t in enumerate(tags)) + sum(moves[a, b] for a, b in zip(walk, walk[1:]))

        best = max(itertools.product(range(3), repeat=n), key=worth)
        assert worth(S.viterbi(leads, moves)) == pytest.approx(worth(best))
        field = S.Field({}, np.zeros((0, len(S.OFFSETS), 2)), {}, np.zeros((0, 2)), moves)
        tags = [0] * n
        for a, b in S.stretches(leads, field.returns()):
            tags[a:b] = S.viterbi(leads[a:b], moves)
        assert worth(tags) == pytest.approx(worth(best))


def rows_for(seed, n=60):
    held = [("the old river ran\nby token = \"" + "ab12" * 10 + "\" stones", [(32, 72)], ["file-size=9"]), ("words of a quiet page, 4471 2290", [], ["file-size=6"])]
    return S.sequences(held, n, seed)


def test_value_and_gradient():
    goal = S.Objective(rows_for(1, 12), least=1)
    rng = np.random.default_rng(0)
    theta = rng.normal(0, 0.3, goal.size)
    value, gradient = goal.value_and_gradient(theta)

    w, fw, moves = goal.split(theta)  # likelihood by summing over every path of short sequences
    scores = goal.scores(w, fw)
    total, share, _ = goal.posteriors(scores, moves)
    for s in np.flatnonzero(goal.lengths <= 8)[:3]:
        own = scores[goal.seq == s]
        weights = np.zeros_like(own)
        for tags in itertools.product(range(3), repeat=len(own)):
            walk = [0, *tags, 0]
            p = np.exp(sum(own[i, t] for i, t in enumerate(tags)) + sum(moves[a, b] for a, b in zip(walk, walk[1:])))
            for i, t in enumerate(tags):
                weights[i, t] += p
        assert np.allclose(weights / weights.sum(axis=1, keepdims=True), share[goal.seq == s])

    for i in rng.choice(goal.size, 40, replace=False).tolist() + list(range(goal.size - 9, goal.size)):
        step = np.zeros(goal.size)
        step[i] = 1e-5
        slope = (goal.value_and_gradient(theta + step)[0] - goal.value_and_gradient(theta - step)[0]) / 2e-5
        assert gradient[i] == pytest.approx(slope, abs=1e-4)


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(8)
    words = [w + v for w in ("riv", "sto", "anth", "gar", "mil") for v in ("er", "ne", "ion", "den", "ling", "es")]
    return lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def field(prose):
    held = [(t := prose(20), [], S.file_features(t)) for _ in range(60)]
    return S.train(S.sequences(held, 900))


def test_tags_rows_that_were_not_fitted(field, prose):
    tagger = S.Tagger(field)
    held = [(prose(20), [], S.file_features(prose(20))) for _ in range(50)]
    right = wrong = missed = 0
    for text, spans, _ in S.sequences(held, 400, seed=99)[50:]:
        got, want = set(tagger.spans(text)), set(spans)
        right, wrong, missed = right + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert right / (right + wrong) > 0.8 and right / (right + missed) > 0.8
    assert sum(len(tagger.spans(prose(200))) for _ in range(20)) == 0


def test_pieces_and_shared_rows_do_not_change_the_tags(field, prose):
    text = " ".join(p for i in range(20) for p in (prose(30), f"client_secret = 'Zq{i}8xK2mV9bN4wQ7tR1' ", "card 4316522678525456, 10.1.2.3"))
    whole = S.Tagger(field)
    assert len(whole.spans(text)) >= 15
    assert S.Tagger(field, slab=50).spans(text) == whole.spans(text)
    for token in {"river", "Stoner", "éelle", "Zq8xK2mV9bN4wQ7tR1", "=", "x" * 40, "wort", "deadbeef42"}:
        assert np.allclose(whole.types.rows[whole.types[token]], field.token_row(token), atol=1e-5)


def test_scan_adds_spans_and_keeps_base(spark, field, prose):
    ship(spark)
    hexes = "0123456789abcdef" * 3
    texts = [None, "", " ", prose(60), f'{prose(9)} token = "{hexes}" {prose(9)}', f"x{hexes}", "AKIA" + "Q" * 12,
             f"{prose(20)} signing_key: \"wJalrXUtnFEMIK7MDENGbPxRfiCYzz41\" {prose(20)}", "a" * 400_000, f"{prose(50)} " * 300]
    rows = [(i, t, "mine", 1) for i, t in enumerate(texts)] + [(4, texts[4], "again", 2), (None, texts[4], "no id", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, kind long")
    found = S.scan(docs, field)
    assert found.columns == ["doc_id", "text", "kind", "spans"]
    got = S.digests(found).collect()
    assert len(got) == len(rows)
    for r, (_, t, *_rest) in zip(sorted(got, key=repr), sorted(rows, key=lambda x: repr(next(g for g in got if g.doc_id == x[0])))):
        base = plain_base(t or "")
        own = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(own.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in base) for k in ("assign", "access", "hex"))
        assert [s for s in r.spans.split(",") if s and not s.startswith("tagged")] == [f"{k}:{a}:{b}" for k, a, b in base]
    by_id = {r.doc_id: r for r in got}
    start = texts[7].index("wJalr")
    assert f"tagged:{start}:{start + 32}" in by_id[7].spans.split(",") and by_id[7].n_assign == 0
    assert [i for i in (0, 1, 2, 3, 4, 6, 8, 9) if "tagged" in by_id[i].spans] == []


def test_fit_on_bounded_rows_and_empty_table(spark, prose, monkeypatch):
    ship(spark)
    monkeypatch.setattr(S, "GENERATED", 150)
    docs = spark.createDataFrame([(i, prose(40)) for i in range(60)] + [(None, None), (1, "")], "doc_id long, text string")
    one, two = S.fit(docs, max_rows=20), S.fit(docs.repartition(7), max_rows=20)
    assert one.features == two.features and np.array_equal(one.weights, two.weights) and np.array_equal(one.moves, two.moves)
    assert S.scan(docs.limit(0), S.fit(docs.limit(0))).count() == 0
