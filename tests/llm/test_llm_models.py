"""Tokens, HTML, URLs, embeddings, decontamination and the learned classifiers."""

import itertools
import random
import re
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from wayloom.llm import cells, decontaminate, html, pieces, quality, toxicity, urls

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model():
    with open(pieces.MODEL, "rb") as f:
        return pieces.Pieces(f.read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def odd_texts(n, seed):
    rng = random.Random(seed)
    parts = ["a", "e", " ", "   ", "\n", "the", "ing", "é", "日", "😀", "!", "==", "0", "\t", "____", "▁", "http", "A"]
    for k in range(n):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 90)))
        yield text.replace(" ", "").replace("▁", "") if k % 3 == 0 else text


def test_ids_equal_the_library(model, library):
    for text in odd_texts(600, 1):
        assert np.frombuffer(model.encode(model.normal(text)), np.int32).tolist() == library.encode(text)


def test_a_word_is_walked_by_characters(library):
    with open(pieces.MODEL, "rb") as f:
        m = pieces.Pieces(f.read())
    m.trie.clear()  # no part of the word is cut out and looked up
    for text in odd_texts(300, 4):
        for word in text.split():
            assert np.frombuffer(m.ids(m.word(m.normal(word))), np.int32).tolist() == library.encode(word)


def test_chunks_cut_anywhere_give_the_same_ids(model, library):
    for text in odd_texts(300, 2):
        normal = model.normal(text)
        for size in (17, 30):
            cut = [(normal[max(0, s - 16) : s], normal[s : s + size], normal[s + size : s + size + 16]) for s in range(0, len(normal), size)]
            matrices = [model.matrix(*c) for c in cut]
            leave = pieces._choose(matrices, 0, None)
            # Products are associative, and scanning blocks first gives the same states.
            if len(matrices) > 2:
                ab_c = pieces.times(pieces.times(*matrices[:2]), matrices[2])
                a_bc = pieces.times(matrices[0], pieces.times(*matrices[1:3]))
                assert np.array_equal(ab_c, a_bc)
                half = pieces._choose([pieces.times(*matrices[:2])], 0, leave[1])
                assert pieces._choose(matrices[:2], 0, half[0]) == leave[:2]
            ids = b"".join(model.chunk_ids(*c, e, v) for c, e, v in zip(cut, [0, *leave], leave))
            assert np.frombuffer(ids, np.int32).tolist() == library.encode(text)


def test_unigram_weights_give_the_best_sum():
    rng = random.Random(3)
    for _ in range(60):
        vocabulary = {"".join(rng.choice("ab▁") for _ in range(rng.randrange(1, 4))) for _ in range(9)} | {"a", "b", "▁"}
        scores = {p: -rng.randrange(1, 40) / 4 for p in sorted(vocabulary)}
        m = pieces.Pieces.of(scores, bpe=False)
        text = "".join(rng.choice("ab▁") for _ in range(40))
        best = [0.0] + [float("-inf")] * len(text)
        for e in range(1, len(text) + 1):
            best[e] = max(best[s] + scores[text[s:e]] for s in range(e) if text[s:e] in scores)
        cut = [(text[max(0, s - 16) : s], text[s : s + 20], text[s + 20 : s + 36]) for s in range(0, len(text), 20)]
        matrices = [m.matrix(*c) for c in cut]
        leave = pieces._choose(matrices, 0, None)
        ids = np.frombuffer(b"".join(m.chunk_ids(*c, e, v) for c, e, v in zip(cut, [0, *leave], leave)), np.int32)
        assert "".join(m.spelled[i] for i in ids) == text
        assert sum(m.score[i] for i in ids) == pytest.approx(best[-1])
        assert pieces.times(*matrices).max() == pytest.approx(best[-1])


@pytest.mark.parametrize("chunk", [200, pieces.CHUNK])
def test_encode_and_decode_tables(spark, library, monkeypatch, chunk):
    monkeypatch.setattr(pieces, "BLOCK", 3)
    texts = {i: t for i, t in enumerate([None, "", " ", "a  b", "no" * 3000, "x\ny " * 500, "▁", "same", "same", *odd_texts(40, 5)])}
    rows = [(i, t, "clash") for i, t in texts.items()] + [(None, "no id", "clash"), (3, "a  b", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = pieces.decode(pieces.encode(docs, chunk=chunk)).collect()
    ids, decoded = {}, {}
    for r in sorted(found, key=lambda r: (str(r.doc_id), r.chunk)):
        if r.doc_id is not None and r.doc_id != 3:
            ids.setdefault(r.doc_id, []).extend(r.ids or [])
            decoded[r.doc_id] = (decoded.get(r.doc_id) or "") + r.decoded if r.decoded is not None else None
            assert r.round_trip == ("▁" not in (texts[r.doc_id] or "")) or chunk == 200
    assert ids == {i: library.encode(t or "") for i, t in texts.items() if i != 3}
    assert decoded == {i: t and t.replace("▁", " ") for i, t in texts.items() if i != 3}
    assert sum(r.doc_id == 3 for r in found) == 2 and sum(r.doc_id is None for r in found) == 1
    assert pieces.encode(docs.limit(0)).count() == 0


def test_minimum_cut_is_minimal():
    rng = random.Random(8)
    for _ in range(400):
        n = rng.randrange(1, 8)
        costs = [rng.randrange(-6, 7) for _ in range(n)]
        edges = [(i, j, rng.randrange(1, 5)) for i in range(n) for j in range(i) if rng.random() < 0.5]

        def value(labels):
            own = sum((c if c > 0 and not x else -c if c < 0 and x else 0) for c, x in zip(costs, labels))
            return own + sum(w for i, j, w in edges if labels[i] != labels[j])

        assert value(html.min_cut(costs, edges)) == min(map(value, itertools.product([0, 1], repeat=n)))


PAGE = """<!DOCTYPE html><html><head><title>Not shown</title><style>p{}</style></head><body class="page">
<header class="site-header"><a href=/>Home</a><h2>My Site</h2></header><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>
<div id="cookieNotice">We use cookies to make this site better, please accept them all, thank you very much.</div>
<div class="sidebar"><p>Here is a long paragraph of the sidebar that could pass for some content of an article.</p></div>
<article><header><h1>Title &amp; more</h1></header><p><b>First <i>para</i>graph&nbsp;is
 <a href="x>y">linked</a> text&#8217;s.<br><p>Second one.<ul><li>item one<li>item two</ul><h2>Sub</h2><!-- no <p>text</p> -->
<script>var t="</p><p>no</p>";</script><p>A < b and c &lt; d.</p><form><label>Mail</label><input><button>Go</button></form>
<section class="comments"><p>This reader comment is long enough to look like content, but it is a comment.</p></section></article>
<aside>aside text</aside><footer>&copy; all of it</footer></body></html>"""


def test_main_text():
    want = "Title & more\nFirst paragraph is linked text’s.\nSecond one.\nitem one\nitem two\nSub\nA < b and c < d."
    assert html.main_text(PAGE) == want
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav><a href=1>x</a></nav>") == ""
    assert html.main_text("<article><p>whole text</p><p>cut he &amp <a hre") == "whole text\ncut he &"
    wrapped = '<form action="x"><div id="site-header">Site</div><main><div class="article-header"><h1>A title</h1></div><p>Body.</p></main></form>'
    assert html.main_text(wrapped) == "A title\nBody."
    deep = "<div>" * 3000 + "<p>" + "word " * 50_000
    assert html.main_text(deep) == ("word " * 50_000).strip()


PROSE = "The river rose again after a week of rain, and the lower fields stood under water until the end of the month."
BESIDE = "<nav><a href=/a>First link</a> <a href=/b>Second link</a></nav>"


@pytest.mark.parametrize("page", [
    f"<html><head><title>T</title><meta charset=utf-8><body>{BESIDE}<article><p>{PROSE}</p></article></body></html>",
    f"<head><title>T</title><link rel=x><article><p>{PROSE}</p></article>",
    f"<head><title>T</title>{PROSE}",
    f"<article><p><a href=\"/hidden-gems.html\">{PROSE}</a></p></article>",
    f"<article><p title=\"the hidden cost\">{PROSE}</p></article>",
    f"<article><div aria-hidden=\"false\"><p>{PROSE}</p></div></article>",
    f"<article><div data-id=\"comments\" data-class='sidebar'><p>{PROSE}</p></div></article>",
    f"<body><div class=\"has-sidebar\"><article><p>{PROSE}</p></article></div>",
    f"<body><div class=\"page-with-sidebar\"><main><p>{PROSE}</p></main></div>",
    f"<body><div class=\"layout with-nav\"><p>{PROSE}</p></div>",
    f"<body><div id=wrap class=\"sidebar-left\">{BESIDE}<article><p>{PROSE}</p></article></div>",
])
def test_main_text_of_valid_forms(page):
    assert html.main_text(page) == PROSE


def test_an_open_cdata_section_ends_with_its_tag():
    page = "<body><article><p>Before the section stands a sentence.</p><![CDATA[ odd > <p>And after it another one stands.</p></article></body>"
    text = html.main_text(page)
    assert text.startswith("Before the section stands a sentence.") and text.endswith("And after it another one stands.")


@pytest.mark.parametrize("around", [
    "<div class=comments>", "<ol class=comment-list><li>", "<aside>", "<nav>", "<div class=sidebar>", "<div class=related-posts>",
    "<div role=complementary>", "<div hidden>", "<div HIDDEN=''>", "<div style='display: none'>",
])
def test_articles_beside_the_text_stay_away(around):
    assert html.main_text(f"<body><article><p>{PROSE}</p></article>{around}<article><p>Another text: {PROSE}</p></article>") == PROSE


def test_pages_equal_their_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in html.query(pages).collect()}
    from html import unescape

    for r in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S).group(1)
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", article).replace("<br>", " "))
        want = "\n".join(x for x in (" ".join(unescape(p).split()) for p in parts) if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)
    clash = spark.createDataFrame([(1, "u", None, "old"), (1, "u", None, "old")], "page_id long, url string, html string, text string")
    assert [r.text for r in html.extract(clash).collect()] == ["", ""]
    assert html.extract(clash.limit(0)).count() == 0


def test_url_rules_and_globs(spark):
    rows = [
        ("http://NET/a", "net", "/a", "net/", "block"), ("https://x.Example.net/en/1?q", "x.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://notexample.net/en/", "notexample.net", "/en/", "net/", "block"), ("http://a.net", "a.net", "", None, "allow"),
        ("http://example.com/de/x", "example.com", "/de/x", "example.com/de/", "block"), ("http://example.com/x#/de/", "example.com", "/x", None, "allow"),
        ("ftp://a.org/fr/", "a.org", "/fr/", "org/fr/", "allow"), ("http://a.org/x/b.net/", "a.org", "/x/b.net/", None, "allow"),
        ("http://a.org?/b.net/", "a.org", "", None, "allow"), ("a.net/x", "", "", None, "allow"), (None, "", "", None, "allow"),
        ("", "", "", None, "allow"), ("http://a.org/ads/1", "a.org", "/ads/1", None, "block"), ("http://a.org/b.exe", "a.org", "/b.exe", None, "block"),
        ("http://a.org/" + "x" * 5000 + ".zip", "a.org", "/" + "x" * 5000 + ".zip", None, "block"), ("http:// é.org/ü", " é.org", "/ü", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, r[0], "old") for i, r in enumerate(rows)], "page_id long, url string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages).collect()}
    assert got == {i: r[1:] for i, r in enumerate(rows)}
    assert urls.filter_urls(pages.limit(0)).count() == 0


def test_automaton_equals_regular_expressions():
    rng = random.Random(2)
    for _ in range(40):
        globs = ["".join(rng.choice(["a", "b", "/", "*", "**", "."]) for _ in range(rng.randrange(1, 14))) for _ in range(15)]
        texts = ["".join(rng.choice("ab/.?") for _ in range(rng.randrange(0, 12))) for _ in range(60)]
        fits = urls.Automaton(globs).run([t.encode() for t in texts])
        for g, column in zip(globs, fits.T):
            # Adjacent stars mean any run as soon as two stand together.
            parts = re.findall(r"\*+|[^*]", g)
            pattern = "".join(("[^/?#]*" if p == "*" else ".*") if p[0] == "*" else re.escape(p) for p in parts)
            assert [bool(re.fullmatch(pattern, t)) for t in texts] == column.tolist(), g


def test_embedding_links_and_recall(spark, monkeypatch):
    monkeypatch.setattr(cells, "CELL", 40)
    monkeypatch.setattr(cells, "ROWS", 16)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((500, 24))
    near = base[rng.integers(0, 60, 400)] + rng.standard_normal((400, 24)) * rng.choice([0.02, 0.1, 0.2], (400, 1))
    x = np.concatenate([base, near, np.repeat(base[:1], 80, 0)])
    x = np.float32(x * rng.uniform(0.1, 50, (len(x), 1)))
    x[-80:] = x[-1]
    rows = [(int(i), v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(9000, None, 0), (9001, [], 0), (9002, [0.0] * 24, 0), (9003, [float("nan")] * 24, 0), (9004, [1.0] * 23 + [None], 0),
           (9005, [1.0, 2.0], 0), (None, [1.0] * 24, 0), (9006, [float("inf")] * 24, 0)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, kept int").repartition(5)
    got = {r.vec_id: r for r in cells.near_duplicates(table).collect()}
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = u @ u.T >= 0.95
    np.fill_diagonal(links, False)
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= links.sum(1)).all() and found.sum() >= 0.95 * links.sum()
    exact = brute.components(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(links)) if a < b])
    assert np.mean([got[i].component_id == exact[i] for i in range(len(x))]) > 0.95
    assert all(got[i].kept == (got[i].component_id == i) for i in range(len(x)))
    assert all(got[i].n_links == 0 and got[i].kept and got[i].component_id == i for i in range(9000, 9007))
    assert got[None].n_links == 0 and got[None].component_id is None and got[None].kept
    assert cells.near_duplicates(table.limit(0)).count() == 0
    assert cells.near_duplicates(table.filter("vec_id >= 9000 and vec_id <> 9005")).count() == 6


def benchmark_and_documents():
    rng = random.Random(12)
    vocabulary = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("ana", "ilo", "ert", "ous", "ing", "eth", "urn", "olk")]
    common = ["the", "of", "and", "to"]
    say = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(vocabulary) + rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(rng.randrange(14, 60))).capitalize() + ".") for i in range(60)] + [(60, " ".join(say(200))), (61, None), (62, "")]
    docs, leaked = [], {}
    for d in range(400):
        w = say(rng.randrange(5, 300))
        if d % 5 == 0:
            item = rng.randrange(61)
            own = items[item][1].split()[-70:]
            if d % 10 == 0:  # a paraphrase: words replaced, dropped and added
                own = [x for x in (rng.choice(say(1)) if rng.random() < 0.1 else x for x in own) if rng.random() > 0.06]
            at = rng.randrange(len(w))
            w[at:at] = own
            leaked[d] = item
        docs.append((d, " ".join(w), 1.0))
    return items, docs, leaked


def test_links_in_few_dimensions_are_found(spark, monkeypatch):
    """Vectors that fill six of 64 dimensions, many cells: pairs lie across borders."""
    monkeypatch.setattr(cells, "CELL", 20)
    rng = np.random.default_rng(5)
    x = cells._unit(rng.normal(size=(4000, 6)) @ rng.normal(size=(6, 64)))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sum(r.n_links for r in cells.query(vectors).collect())
    true = int((x @ x.T >= cells.COSINE).sum()) - len(x)
    assert 0.95 * true <= found <= true


def test_paraphrased_items_are_found(spark):
    items, rows, leaked = benchmark_and_documents()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(rows + [(-1, None, 0.0), (-2, "", 0.0)], "doc_id long, text string, cosine double")
    got = {r.doc_id: r for r in decontaminate.find(docs, benchmark).collect()}
    flagged = {d: r.item_id for d, r in got.items() if r.contaminated}
    assert flagged == leaked
    assert len(got) == 402 and not got[-1].contaminated and got[-2].lcs == 0
    assert decontaminate.find(docs.limit(0), benchmark).count() == 0
    assert not any(r.contaminated for r in decontaminate.find(docs, benchmark.limit(0)).collect())


def test_shards_and_answers(spark, monkeypatch):
    items, rows, leaked = benchmark_and_documents()
    monkeypatch.setattr(decontaminate, "SHARD", 20)
    docs = spark.createDataFrame(rows, "doc_id long, text string, x double")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {r.doc_id: r.item_id for r in decontaminate.find(docs, benchmark).filter("contaminated").collect()}
    assert found == leaked
    # Half of an item counts only with its answer.
    text = " ".join(f"unusual{i}" for i in range(40))
    half = " ".join(f"unusual{i}" for i in range(26))
    q = spark.createDataFrame([(1, text, "fortytwo is it")], "item_id long, text string, answer string")
    d = spark.createDataFrame([(1, half), (2, half + " Fortytwo is it!"), (3, "fortytwo is it")], "doc_id long, text string")
    d = d.unionByName(docs.select((docs.doc_id + 10).alias("doc_id"), "text"))
    got = {r.doc_id for r in decontaminate.find(d, q, answer="answer").filter("contaminated").collect()}
    assert got == {2}


def test_full_shard_finds_every_planted_item(spark):
    rng = random.Random(3)
    # Most items share their words with others, which fill the leading vectors; the rest share none.
    word = lambda i, k: f"shared{rng.randrange(700)}" if i % 10 < 7 else f"w{i}x{k}"
    items = [(i, " ".join(word(i, k) for k in range(24))) for i in range(1000)]
    docs = [(i, " ".join(f"own{rng.randrange(500)}" for _ in range(50)) + " " + t + " end of it") for i, t in items]
    docs += [(1000 + i, " ".join(f"own{rng.randrange(500)}" for _ in range(90))) for i in range(200)]
    found = decontaminate.find(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(8), spark.createDataFrame(items, "item_id long, text string")
    )
    assert decontaminate.SHARD >= 1000
    assert {r.doc_id: r.item_id for r in found.filter("contaminated").collect()} == {i: i for i, _ in items}


def test_subsequences_and_singular_values(spark):
    rng = np.random.default_rng(5)
    for _ in range(50):
        a, b = (rng.integers(0, 6, rng.integers(1, 40)).astype(np.uint64) for _ in range(2))
        assert decontaminate.common_subsequence(a, b) == brute.longest_common_subsequence(a.tolist(), b.tolist())
    a = rng.standard_normal((30, 4)) @ rng.standard_normal((4, 50))
    rows = [(np.arange(50), r) for r in a]
    v, s = decontaminate.randomised_svd(spark, rows, 50, 10)
    assert np.allclose(s[:4], np.linalg.svd(a)[1][:4], rtol=1e-6) and np.allclose(a @ v @ v.T, a, atol=1e-6)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r.toxic for r in labels.filter("quality = 1").collect()}
    got = [r for r in toxicity.query(docs, labels).collect()]
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [(known[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in known]
    assert np.mean([a == b for a, b in held]) > 0.97


def test_offending_sentences_and_special_cases(spark):
    rng = random.Random(4)
    say = lambda: " ".join(rng.choice(["sun", "moon", "tree", "river", "stone"]) for _ in range(8))
    rows, labels = [], []
    for d in range(300):
        bad = d % 3 == 0
        text = f"{say()}. {'you wretched fool ' + say() if bad else say()}! {say()}"
        rows.append((d, text, 5.0))
        labels.append((d, int(bad)))
    docs = spark.createDataFrame(rows + [(900, None, 0.0), (901, "", 0.0), (None, "wretched fool", 0.0), (902, "Wretched! " + "moon " * 40_000, 0.0)],
                                 "doc_id long, text string, score double")
    table = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, table, held_out_fold=False)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(got[d].predicted == y for d, y in labels)
    assert all("wretched" in s for d in range(0, 300, 3) for s in got[d].offending) and len(got[0].offending) == 1
    assert got[900].score == got[901].score == 0 and got[None].predicted == 1 and got[902].predicted == 1
    none = toxicity.fit(docs, table.filter("toxic = 0"))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: bool(r.quality) for r in labels.collect()}
    got = quality.query(docs, labels).collect()
    assert len(got) == docs.count()
    held = [(known[r.doc_id], r.keep) for r in got if r.held_out and r.doc_id in known]
    assert np.mean([a == b for a, b in held]) > 0.97


def test_blank_lines_are_no_repeated_lines():
    lines = ["one two three", "four five six", "seven eight nine"]
    texts = ["\n".join(lines), "\n\n".join(lines), "\n\n".join([*lines, lines[0]]), "\n\n\n", "", None]
    repeated = quality.shapes(pa.array(texts))[:, 11]
    assert repeated.tolist() == [0, 0, 0.25, 0, 0, 0]


def test_sparse_sites_are_shrunk(spark):
    rng = random.Random(1)
    good, bad = "This is a plain sentence of words. " * 4, "$$$ 123 %%% ### " * 12
    rows, labels = [], []
    for d in range(600):
        host = "fine" if d % 2 else "poor"
        ok = rng.random() < (0.95 if host == "fine" else 0.2)
        rows.append((d, (good if ok else bad) + str(rng.random()), host, "p", "x"))
        labels.append((d, int(ok)))
    rows += [(1000, "a b c", "fine", "p", "x"), (1001, "a b c", "poor", "p", "x"), (1002, "a b c", "new", "q", "x"),
             (1003, None, None, None, "x"), (1004, "", "new", None, "x"), (None, "a", "new", "q", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, keep string")
    table = spark.createDataFrame(labels + [(3, None), (None, 1)], "doc_id long, quality int")
    out = quality.judge(docs, table)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    assert got[1001].host_rate < 0.35 < got[1002].host_rate < 0.85 < got[1000].host_rate
    assert got[1001].score < got[1002].score < got[1000].score
    assert quality.judge(docs.limit(0), table).count() == 0
    assert {round(r.evidence, 6) for r in quality.judge(docs, table.limit(0)).collect()} == {0.0}


@pytest.mark.parametrize("n_positive", [1, 2, 10])
def test_few_positive_labels_still_order_the_scores(spark, n_positive):
    rng = random.Random(n_positive)
    sentence = lambda: " ".join(f"w{rng.randrange(400)}" for _ in range(8))
    rows = []
    for i in range(60):
        bad = i < n_positive
        text = ". ".join([sentence(), "you utter zorgfool and grobnik" if bad else sentence(), sentence()])
        rows.append((i, text, int(bad)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, held_out_fold=False)
    fresh = spark.createDataFrame([(1, "a zorgfool and grobnik"), (2, sentence())], "doc_id long, text string")
    bad, good = (r.score for r in toxicity.score(fresh, model).orderBy("doc_id").collect())
    assert bad > good and (n_positive < 10 or (bad >= 0.5 > good))
    if n_positive == 10:
        got = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
        assert got == {r[0]: r[2] for r in rows}
