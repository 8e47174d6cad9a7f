"""The dealt operators against brute force, exact round trips and their edge cases."""

from __future__ import annotations

import collections
import gzip
import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pytest

from tillspark.llm import (
    chat_format,
    decontaminate,
    html_extract,
    jaccard_join,
    packing,
    quality_rules,
    suffix_dedup,
    topk,
    toxicity,
    warc_derive,
)
from tillspark.llm.common import ship
from tillspark.llm.queries import vocabulary_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, weight long"


@pytest.fixture(scope="module")
def docs_of(spark):
    ship(spark)

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 0.5, 1) for i, t in rows], DOCS)

    return make


def words(rng, n, size=4000):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


# --- suffix-array dedup -------------------------------------------------------------------------


def test_grouping_suffix_array_equals_sorting():
    rng = random.Random(1)
    for _ in range(400):
        text = [rng.randint(0, rng.choice([1, 2, 5])) for _ in range(rng.randint(0, 40))]
        assert suffix_dedup.grouping_suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])
    assert suffix_dedup.grouping_suffix_array([3] * 500) == list(range(499, -1, -1))


def brute_removed(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, np.int8)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = 1
        out.append((len(r), int(gone.sum()), int((np.diff(np.concatenate(([0], gone))) == 1).sum()), hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("options", [{}, {"hot": 2, "shard_contexts": 3}])
def test_suffix_dedup_equals_brute_force(docs_of, options):
    rng = random.Random(2)
    passage = words(rng, 70) + " é"
    texts = [words(rng, 60) + passage + words(rng, 40) for _ in range(6)]
    texts += [None, "", "a" * 199, "ab" * 300, "short", passage, texts[0], words(rng, 4000), "ß" * 150, words(rng, 30) + passage[20:] + passage[:320]]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, texts[3]), (3, "another text of the same id " * 20)]
    got = suffix_dedup.digests(docs_of(rows), **options).collect()
    want = collections.Counter((i, *d) for (i, _), d in zip(rows, brute_removed([t for _, t in rows])))
    assert collections.Counter(tuple(r) for r in got) == want


def test_suffix_dedup_keeps_columns_and_empty_tables(docs_of):
    docs = docs_of([(1, "x" * 150 + "é" * 100), (2, None)])
    out = suffix_dedup.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == 2
    assert suffix_dedup.digests(docs_of([])).count() == 0


# --- packing ------------------------------------------------------------------------------------


def test_packing_round_trip(docs_of):
    from tokenizers import Tokenizer

    hf = Tokenizer.from_file(vocabulary_path())
    rng = random.Random(3)
    texts = [words(rng, rng.randint(1, 900)) for _ in range(30)] + [None, "", words(rng, 5000), "It's <|endoftext|> 12,5% Straße b ́x 你好 😀 \x1cab\x0bcd İ ﬁ ’s", "x" * 3000, "''s'tre  \n\t 'LL"]
    rows = list(enumerate(texts)) + [(4, texts[4])]
    got = packing.pack_documents(docs_of(rows), vocabulary_path(), shard_rows=16).toPandas()
    want = collections.Counter()
    for i, t in rows:
        ids = [*hf.encode(t or "", add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), 4096)):
            part = ids[s : s + 4096]
            want[i, k, s, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())] += 1
    assert collections.Counter(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].values.tolist())) == want
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert seq["offset"].tolist() == [0, *np.cumsum(seq["length"])[:-1]] and seq["length"].sum() <= 4096
    assert packing.pack_documents(docs_of([]), vocabulary_path()).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_obeys_every_capacity(rule):
    rng = np.random.default_rng(4)
    lengths = np.minimum(4096, rng.lognormal(6, 1, 1500).astype(int) + 1)
    cap = packing.Capacity(documents=5, attention=9_000_000 + 4096**2, rule=rule)
    which, offset = packing.best_fit(lengths, cap)
    for b in np.unique(which):
        mine = np.flatnonzero(which == b)
        assert lengths[mine].sum() <= 4096 and len(mine) <= 5 and (lengths[mine].astype(int) ** 2).sum() <= cap.attention
    plain = packing.best_fit(lengths)[0]
    assert plain.max() + 1 <= -(-lengths.sum() // 4096) * 1.02 + 1


# --- quality and toxicity -----------------------------------------------------------------------


def labelled(spark, docs_of, kind):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        text = words(rng, rng.randint(20, 80), 300)
        if bad and kind == "quality":
            text = " ".join(f"{w}$$$" for w in text.split())
        if bad and kind == "toxic":
            text += " you " + rng.choice(["gr0mbak", "GROMBAK", "grоmbak"]) + " " + words(rng, 20, 300)
        rows.append((i, text))
        labels.append((i, int(not bad) if kind == "quality" else 1, int(bad) if kind == "toxic" else 0))
    rows += [(1000, None), (1001, ""), (None, "no id"), (3, rows[3][1])]
    labels += [(2, None, None), (None, 1, 1)]
    return docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held_out_accuracy(out, want, mod, fold):
    rows = [r for r in out if r.doc_id is not None and r.doc_id < 600 and r.held_out]
    assert rows and all(zlib.crc32(str(r.doc_id).encode()) % mod == fold for r in rows)
    return sum(r.predicted == want(r.doc_id) for r in rows) / len(rows)


def test_quality_rules(spark, docs_of):
    docs, labels = labelled(spark, docs_of, "quality")
    model = quality_rules.fit(docs, labels)
    out = quality_rules.classify(docs, model).collect()
    assert len(out) == 604 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    assert held_out_accuracy(out, lambda i: int(i % 3 != 0), 4, 2) > 0.97
    kept = quality_rules.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in out)
    one_class = quality_rules.fit(docs, labels.where("quality = 1"))
    assert one_class.weights == () and quality_rules.classify(docs_of([]), one_class).count() == 0


def test_toxicity(spark, docs_of):
    docs, labels = labelled(spark, docs_of, "toxic")
    lexicon = toxicity.fit(docs, labels)
    out = toxicity.classify(docs, lexicon).collect()
    assert len(out) == 604 and all(0 <= r.score <= 1 for r in out)
    assert held_out_accuracy(out, lambda i: int(i % 3 == 0), 3, 1) > 0.97
    none = toxicity.fit(docs, labels.where("toxic = 0"))
    assert none.terms == () and not any(r.predicted for r in toxicity.classify(docs, none).collect())


def test_toxicity_folding_and_exceptions():
    lex = toxicity.Lexicon(((toxicity.fold("idiot"), 2.0), (toxicity.fold("grom").rstrip(), 1.0)), (toxicity.fold("idiot savant"),))
    machine = toxicity.automaton(lex)
    weigh = lambda t: sum(w for _, _, w in toxicity.hits(machine, toxicity.fold(t)))
    assert [weigh(t) for t in ("1d10t!", "IDIОT", "ｉｄｉｏｔ", "idi­ot", "an idiot savant", "idiots", "gromling", "agrom", "")] == [2, 2, 2, 2, 0, 0, 1, 0, 0]


# --- WARC ---------------------------------------------------------------------------------------


def test_warc_links_digests_and_round_trip(spark):
    ship(spark)
    pages = spark.createDataFrame([(1, "http://a/x", "<title>T &amp; U</title><p>One <a href='/y'>two</a></p><script>no</script>", "w"), (2, None, None, "w"), (1, "http://a/x", "", "w")], "page_id long, url string, html string, block string")
    source = {r.record_id: r for r in warc_derive.responses(pages).collect()}
    out = warc_derive.with_bytes(warc_derive.derive(warc_derive.responses(pages))).collect()
    assert collections.Counter(r.record_type for r in out) == {"metadata": 3, "conversion": 3}
    for r in out:
        s = source[r.refers_to]
        assert (r.source_block_digest, r.source_payload_digest, r.target_uri) == (s.block_digest, s.payload_digest, s.target_uri)
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block).hexdigest()
        ((headers, block),) = warc_derive.parse_records(bytes(r.record))
        assert dict(headers)["WARC-Refers-To"] == r.refers_to and block == bytes(r.block)
    first = next(r for r in out if r.record_type == "conversion" and r.content_length)
    assert bytes(first.block).decode() == "One two"


def test_warc_payloads():
    base = {"page_id": 1, "record_id": "<urn:uuid:1>", "target_uri": "http://a/", "date": "d", "block_digest": "b", "payload_digest": "p"}
    zipped = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Encoding: gzip\r\n\r\n" + gzip.compress("<p>é</p>".encode())
    chunked = b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n0\r\n\r\n"
    assert [r[-1] for r in warc_derive.derivatives(base | {"block": zipped})][1] == "é".encode()
    assert [r[-1] for r in warc_derive.derivatives(base | {"block": chunked})][1] == b"abc"
    assert [r[1] for r in warc_derive.derivatives(base | {"block": b"not http"})] == ["metadata"]
    assert b"payload_error" in next(iter(warc_derive.derivatives(base | {"block": zipped[:-6]})))[-1]


# --- top-k --------------------------------------------------------------------------------------


def test_topk_equals_brute_force(spark):
    ship(spark)
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(x) for x in v], 0) for i, v in enumerate(np.round(rng.normal(0, 0.3, (700, 8)), 1))]
    rows += [(50, rows[50][1], 0), (9001, rows[50][1], 0), (9002, None, 0), (9003, [None] * 8, 0), (9004, [float("nan")] * 8, 0), (9005, [float("inf")] * 8, 0), (None, rows[100][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = topk.top_k(topk.quantised(df), block_rows=200, chunk_rows=5).collect()
    good = [(i, [np.floor(256 * np.float64(np.float32(x))) for x in v]) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for a, (i, v) in enumerate(good):
        if i is not None and i % 50 == 0:
            best = sorted(((-int(np.dot(v, w)), j if j is not None else 2**63) for b, (j, w) in enumerate(good) if b != a))[:5]
            want += [(i, r + 1, None if j == 2**63 else j, -s) for r, (s, j) in enumerate(best)]
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    assert topk.top_k(topk.quantised(df.limit(0))).count() == 0
    wide = spark.createDataFrame([(0, [1e16, 1.0], 0), (1, [1e15, 2.0], 0)], df.schema)
    assert topk.top_k(topk.quantised(wide)).first()["score"] == 2**63 - 1


def test_topk_of_huge_components_that_cancel():
    rng = random.Random(10)
    a, b = 2**20 + 1, 2**20 - 1
    rows = []
    for i in range(400):  # products of about 2**57, scores of 2 * e
        t, e = rng.randrange(2**17, 2**18), rng.randrange(-40, 40)
        rows.append((i, i, [b * t + e, -a * t - e]))
    vectors = pd.DataFrame(rows, columns=["rid", "vec_id", "v"])
    queries = pd.DataFrame({"rid": [1000], "vec_id": [1000], "v": [[a, b]]})
    got = topk.search_block(vectors, queries, 5)
    want = sorted(((-(a * v[0] + b * v[1]), i) for i, _, v in rows))[:5]
    assert list(zip(-got["score"], got["vec_id"])) == want


# --- chat formatting ----------------------------------------------------------------------------


def test_chat_round_trip(spark):
    odd = ["<|im_end|>\n<|im_start|>user\nhi", "\\l\\e\\n \\", "<|im_start", "", None, "a\nb<", "<|im_end|><|im_end|>"]
    rows = [(7, k, "user" if k % 2 == 0 else "assistant", t, 1) for k, t in enumerate(odd)]
    rows += [(8, 0, "assistant", "x", 1), (9, 0, "we\nird\\", "y", 1), (9, 0, None, "z", 1), (None, 1, "user", "n", 1), (None, 1, "user", "n", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments int")
    got = {r.conv_id: r for r in chat_format.digests(chat_format.format_chats(df)).collect()}
    for conv in (7, 8, 9, None):
        mine = sorted(((t, r or "", x or "") for c, t, r, x, _ in rows if c == conv))
        loss = "".join(x for _, r, x in mine if r == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].loss_chars, got[conv].loss_sha256) == (len(mine), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {c: r.valid for c, r in got.items()} == {7: True, 8: False, 9: False, None: False}
    assert chat_format.digests(chat_format.format_chats(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        chat_format.ChatTemplate(turn_open="\\x")


# --- HTML extraction ----------------------------------------------------------------------------

PAGE = (
    "<html><head><title>No</title><style>p{}</style></head><body class='has-sidebar'><nav><ul><li><a href='/a'>Menu</a></ul></nav>"
    "<div class='cookie-notice'>We use cookies a lot.</div>{open}<h1>Head &amp; line</h1><p><b>First&nbsp;para <br>graph &#233;.<p>Second &lt;x&gt; <a href='b'>link</a> end."
    "<div class=ad>Buy!</div><script>var t='</p>';</script><form><p>Mail me</form>{close}<section id='comments'><p>Nice post, I like it very much indeed, thank you.</p></section>"
    "<aside>Side story with many words that nobody wants to read in here.</aside><footer>&copy; us</footer></body></html>"
)


def test_html_main_text(spark):
    want = "Head & line First para graph é. Second <x> link end."
    assert html_extract.extract(PAGE.replace("{open}", "<article>").replace("{close}", "</article>")) == want
    assert html_extract.extract(PAGE.replace("{open}", "<div class=content>").replace("{close}", "</div>")) == want
    assert html_extract.extract("<nav><a>m</a><article><p>Kept</p>") == "Kept"
    assert [html_extract.extract(x) for x in (None, "", "<p", "<!-- x", "plain  text")] [-1] == "plain text"
    long = "<article>" + "<p>word word</p>" * 30_000
    assert len(html_extract.extract(long)) == 10 * 30_000 - 1
    df = spark.createDataFrame([(1, "u", None, "x"), (2, None, "<article>é😀</article>", "x")], "page_id long, url string, html string, text string")
    ship(spark)
    assert [tuple(r) for r in html_extract.main_text(df).orderBy("page_id").collect()] == [(1, "u", "", 0), (2, None, "é😀", 2)]


def test_html_attributes_are_read_whole():
    story = "<p>A paragraph of the story that is long enough to count as its main text, with many words in it.</p>"
    for attrs in ("style='overflow:hidden'", 'title="Hidden gems"', "data-hidden='false'", "data-id=comments", "data-class='ad'", "title='class=ad'", "data-x=hidden", "id='ad-hoc-networks'", "class='social-history'"):
        for tag in ("div", "section"):
            for page in (f"<article><{tag} {attrs}>{story}</{tag}></article>", f"<div class=content><{tag} {attrs}>{story}</{tag}></div>"):
                assert html_extract.extract(page) == story[3:-4], page
    for attrs in ("id=search", "id='related'", "id='ad-hoc-networks'"):
        assert html_extract.extract(f"<article><h2 {attrs}>Head</h2>{story}</article>") == "Head " + story[3:-4]
    assert html_extract.extract(f"<article><section id=search>{story}</section></article>") == story[3:-4]
    for attrs in ("hidden", "hidden=''", "title='a' hidden", "class=\"x ad\"", "aria-hidden = 'true'", "role=navigation", "id=comments", "class=ad id=x", "class=\"x\nad\""):
        assert html_extract.extract(f"<article>{story}<section {attrs}>{story}</section></article>") == story[3:-4], attrs
    for attrs in ("class=cookie-notice", "id=sidebar_left", "class='ad-slot-3'", "id=comments-list"):
        assert html_extract.extract(f"<div>{story}</div><div {attrs}>{story}</div>") == story[3:-4], attrs


def test_html_sums_decide_with_and_without_articles():
    def part(name):
        return " ".join(f"{name}{k} word" for k in range(40))

    def paragraphs(name, n=4):
        return "".join(f"<p>{part(name + str(k))}</p>" for k in range(n))

    def text(name, n=4):
        return " ".join(part(name + str(k)) for k in range(n))

    story, want = paragraphs("s"), text("s")
    teasers = "".join(f"<article><h3><a href=x>Teaser {k}</a></h3><p>Read more of it</p></article>" for k in range(5))
    cases = {
        f"<div>{story}</div>{teasers}": want,
        f"{teasers}<div>{story}</div>": want,
        f"<div>{story}</div><article class=comment>{paragraphs('c')}</article><article class='comment-body' id='div-comment-1'>{paragraphs('d')}</article>": want,
        f"<div>{story}</div><aside>{teasers}<article>{paragraphs('t')}</article></aside>": want,
        f"<div>{story}</div><footer><article>{paragraphs('t')}</article></footer>": want,
        f"<div>{story}</div><section id=comments><article>{paragraphs('t')}</article></section>": want,
        f"<article>{story}<aside><article>{paragraphs('t')}</article></aside><p>End.</p></article>": want + " End.",
        f"<main><nav><a href=x>m</a><article>{story}</article></main>": want,
        f"<nav><a href=x>m</a><article>{story}</article><nav><a href=x>n</a></nav>": want,
        f"<article>{story}</article><article>{paragraphs('u')}</article><article><p>A short post.</p></article>": f"{want} {text('u')} A short post.",
        f"<article>{story}</article><div>{paragraphs('v')}</div>": f"{want} {text('v')}",
        f"<div>Short note</div><article><h1>H</h1>{story}<p>End.</p></article><div>Share it</div>": f"H {want} End.",
        f"<article><p>News in brief.</p></article><div>{paragraphs('v')}</div>": f"News in brief. {text('v')}",
        f"<article></article><div>{story}</div>": want,
        f"<div>{story}<article>{paragraphs('u')}</div><p>{part('z')}": f"{want} {text('u')} {part('z')}",
    }
    for page, text_ in cases.items():
        assert html_extract.extract(page) == text_, page


def test_elements_without_text_end_where_html_ends_them():
    cases = {
        "<p>a<svg-icon name='x'></svg-icon> b</p><p>c</p>": "a b c",
        "<title-bar>t</title-bar><select-menu></select-menu><p>a</p><style-guide>s</style-guide>": "t a s",
        "<p>a <svg class='i'/> b</p><p>c</p><svg><path d=''/><text>no</text></svg><p>d</p>": "a b c d",
        "<p>a <math/> b</p><svg viewBox='0 0'></svg><p>c</p>": "a b c",
        "<p>a</p><svg><path><p>b</p>": "a b",
        "<p>a</p><select><option>": "a",
        "<p>a</p><svg><title/><style/><g><svg><text>no</text></svg><text>no</text></g></svg><p>b</p>": "a b",
        "<p>a</p><svg aria-label='x > y'><text>no</text></svg><p>b</p>": "a b",
        "<p>a</p><object><object>no</object>no</object><template><p>no</p></template><noscript>no</noscript><p>b</p>": "a b",
        "<p>a</p><textarea>no <svg> </textarea><p>b</p><script>'<svg>' </scripty> no</script ><p>c</p>": "a b c",
        "<p>a</p><script>no <p>no</p>": "a",
        "<p>a</p><TITLE>no</Title><p>b</p><style>no": "a b",
        "<p>a</p><svg><object></svg><p>b</p></object><p>c</p>": "a b c",
    }
    for page, want in cases.items():
        assert warc_derive.plain_text(page).split() == want.split(), page
        assert html_extract.extract(page).split() == want.split(), page
    long = "<p>word</p><svg><select>" * 20_000
    assert len(warc_derive.plain_text(long).split()) == len(html_extract.extract("<article>" + long).split()) == 20_000


def test_warc_titles_and_links_are_those_of_whole_names():
    base = {"page_id": 1, "record_id": "<urn:uuid:1>", "target_uri": "http://a/", "date": "d", "block_digest": "b", "payload_digest": "p"}
    page = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<title-bar>no</title-bar><title>Yes</title><a-icon href=no></a-icon><a\nhref=yes>x</a><p-card>one</p-card> line"
    about, text = (r[-1].decode() for r in warc_derive.derivatives(base | {"block": page}))
    assert '"title": "Yes", "links": [{"element": "a", "url": "http://a/yes"}]' in about and text == "no xone line"


# --- decontamination ----------------------------------------------------------------------------


def best_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        new = [i + 1]
        for j, y in enumerate(text):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_myers_equals_dynamic_programme():
    rng = random.Random(7)
    for _ in range(200):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(lo, hi))) for lo, hi in ((1, 9), (0, 14)))
        assert min(decontaminate.myers(a, b, len(a))[0], len(a)) == best_distance(a, b)


def test_decontamination_equals_brute_force(spark, docs_of):
    rng = random.Random(8)
    items = [(k, words(rng, 40)) for k in range(4)] + [(4, ""), (5, None), (6, "tiny one")]
    texts = []
    for k in range(40):
        item = list(items[k % 4][1].upper() if k % 5 == 0 else items[k % 4][1])
        for _ in range(k % 14):
            at = rng.randrange(len(item))
            item[at : at + rng.choice([0, 1, 1])] = [rng.choice("xyz")]
        texts.append(words(rng, 30) + "\n" + "".join(item) + " " + words(rng, 30))
    texts += [None, "", "a tiny one here", words(rng, 300)]
    df_items = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(list(enumerate(texts)))
    want = set()
    for d, t in enumerate(texts):
        for i, x in items:
            low = decontaminate.normal(x).strip()
            if low and t:
                dist = best_distance(low, decontaminate.normal(t))
                if dist <= int(len(low) * decontaminate.ERROR_RATE):
                    want.add((d, i, dist))
    for size in (decontaminate.BLOCK_CHARS, 300):
        got = decontaminate.matches(docs, df_items, block_chars=size).collect()
        assert {(r.doc_id, r.item_id, r.distance) for r in got} == want and len(got) == len(want)
        kept = decontaminate.without_items(docs, df_items, block_chars=size)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _, _ in want}
    assert decontaminate.matches(docs, df_items.limit(0)).count() == 0


# --- n-gram Jaccard join ------------------------------------------------------------------------


def brute_classes(rows, threshold=0.8):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for a in range(n):
        least[find(a)] = min(least.get(find(a), (1, 0)), (rows[a][0] is None, rows[a][0]), key=lambda x: (x[0], x[1] or 0))
    return [(rows[a][0], least[find(a)][1], links[a]) for a in range(n)]


@pytest.mark.parametrize("options", [{}, {"block_grams": 300}, {"block_sets": 7}])
def test_jaccard_join_equals_brute_force(docs_of, options):
    rng = random.Random(9)
    base = words(rng, 120).split()
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(999)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, words(rng, rng.randint(1, 200))) for i in range(20)]
    rows += [(7, rows[7][1]), (201, rows[3][1].upper()), (202, "one two"), (203, "One  two"), (204, None), (205, ""), (206, ""), (None, "a b c d e f g"), (207, " a b c d e f g\n"), (208, words(rng, 9000)), (100, "same id, other text than before")]
    out = jaccard_join.near_classes(docs_of(rows), **options).select("doc_id", "class_id", "n_links").collect()
    assert collections.Counter(map(tuple, out)) == collections.Counter(brute_classes(rows))


def test_long_sets_at_the_very_threshold_are_linked():
    for common in (8, 24_576, 24_616, 200_016, 2_399_976):
        own = common // 8
        one, other = np.arange(common + own), np.concatenate((np.arange(common), np.arange(common + own, common + 2 * own)))
        near = jaccard_join._linked([one, other, other[1:]], None, 0.8)
        assert near[0, 1] and not near[0, 2] and near[1, 2]


def test_one_of_each_class_stays(docs_of):
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (3, "x y z"), (3, "x y z"), (4, None), (5, "")]
    docs = docs_of(rows)
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5]
    assert jaccard_join.one_of_each(docs_of([])).count() == 0


def test_banding_reaches_its_recall():
    for threshold, recall, rows in ((0.8, 0.9995, 6), (0.9, 0.99, 10)):
        bands, r = jaccard_join.banding(threshold, recall, rows)
        assert 1 - (1 - threshold**r) ** bands >= recall > 1 - (1 - threshold**r) ** (bands - 1)


# --- malformed pages, periodic texts, many shields --------------------------------------------------


def test_malformed_http_does_not_stop_a_page():
    def parts(body, kind="text/html"):
        head = f"HTTP/1.1 200 OK\r\nContent-Type: {kind}\r\nTransfer-Encoding: chunked\r\n\r\n".encode()
        _, headers, raw = warc_derive.parse_http(head + body)
        return warc_derive.payload(headers, raw)

    assert parts(b"5\r\nhello\r\n0\r\n\r\n") == (b"hello", None)
    for bad in (b"-6\r\nhello\r\n0\r\n", b"+5\r\nhello\r\n0\r\n", b"0x5\r\nhello\r\n0\r\n", b"zz\r\n", b"", b"\r\n\r\n", b"5_0\r\n"):
        body, wrong = parts(bad)
        assert body == bad and wrong.startswith("ValueError")
    for name in ("undefined", "idna", "base64", "rot13", "no-such-charset", "utf-8"):
        assert warc_derive.decoded(f"text/html; charset={name}", "añb".encode()) in ("añb", "añb".encode().decode("utf-8", "replace"))
    assert warc_derive.plain_text('<p>a <img alt="x > y"> b</p>') == "a b"
    assert warc_derive.plain_text("<div title='1 > 0'>a</div><p data-x=\"</p>\">b</p>") == "a\nb"


def test_periodic_text_is_verified_once_a_window():
    import time

    item = "la" * 3000
    matcher = decontaminate.Matcher([(1, item), (2, "cat"), (3, "a cat")], 0.05)
    start = time.perf_counter()
    assert [h[:2] for h in matcher.find("la" * 2900)] == [(1, 200)]
    assert matcher.find("la" * 2250) == []
    assert time.perf_counter() - start < 10
    assert matcher.find("concatenate") == [] and matcher.find("a concat") == []
    assert [h[0] for h in matcher.find("that is a cat.")] == [2, 3]
    assert list(decontaminate._windows([0, 4, 90, 300], 50, 5, 320)) == [(0, 59), (85, 145), (295, 320)]


def test_shields_are_swept():
    rng = random.Random(9)
    lexicon = toxicity.Lexicon(((" ab ", 1.0), (" ab", 0.5), (" c ", 2.0)), (" x ab ", " ab c ", " c c "))
    machine = toxicity.automaton(lexicon)
    for _ in range(400):
        folded = " " + " ".join(rng.choice(["ab", "abb", "c", "x"]) for _ in range(rng.randrange(1, 9))) + " "
        spots = {}
        for term, w in lexicon.terms:
            for i in range(len(folded)):
                if folded.startswith(term, i) and w > spots.get(i, (0, 0))[1]:
                    spots[i] = (i + len(term), w)
        held = [(i, i + len(p)) for p in lexicon.exceptions for i in range(len(folded)) if folded.startswith(p, i)]
        want = [(s, e, w) for s, (e, w) in sorted(spots.items()) if not any(a <= s and e <= b for a, b in held)]
        assert toxicity.hits(machine, folded) == want
