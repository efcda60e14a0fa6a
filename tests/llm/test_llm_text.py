"""Line dedup, substring dedup, the Jaccard join and their helpers against plain definitions."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from wayloom.llm import components, jaccard, lines, substrings, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed, n=160):
    """Documents with copies, near copies, shared passages, loops, odd blanks, empty and null texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "Über", "ß", "日本", "A", "a,"]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    out = []
    for d in range(n):
        kind = rng.randrange(9)
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 120)))
        if kind == 0 and out:
            text = rng.choice(out)[1]
        elif kind in (1, 2) and out:
            w = (rng.choice(out)[1] or "x").split(" ")
            for _ in range(max(1, len(w) // rng.choice([15, 40, 90]))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            text = " ".join(w)
        elif kind == 3:
            text = text + " " + passage + "\n" + text[: rng.randrange(200)]
        elif kind == 4:
            text = " ".join(["again", "and"] * rng.randrange(1, 40))
        elif kind == 5:
            text = text.replace(" ", rng.choice(["  ", "\n", "\t ", " \r\n", " "]))
        elif kind == 6:
            text = rng.choice([None, "", "  \n ", "one", "one two three", "É é"])
        out.append((d, text, "en", rng.choice(["a", "b", None]), None))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_equal_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.query(docs).collect()}
    assert got == brute.repeats([r[:2] for r in rows])


def test_frequent_prefixes_change_the_layout_only(spark, monkeypatch):
    rows = corpus(3)
    monkeypatch.setattr(substrings, "FREQUENT", 8)
    monkeypatch.setattr(substrings, "SAMPLE", 1)
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    assert len(substrings._frequent(docs.withColumnRenamed("doc_id", "id"))) > 0
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.query(docs).collect()}
    assert got == brute.repeats([r[:2] for r in rows])


def test_repeats_special_cases(spark):
    long = " ".join(f"x{i % 50}" for i in range(30_000))
    rows = [(5, long, 1), (None, long, 2), (7, None, 3), (8, "", 4), (9, "a  b", 5), (9, "a  b", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = {(r.doc_id, r.n_words, r.n_removed, len(r.spans)) for r in substrings.remove_repeats(docs).collect()}
    # The loop of 50 words repeats from its second round on.
    assert got == {(5, 30_000, 29_950, 1), (None, 30_000, 0, 0), (7, 0, 0, 0), (8, 0, 0, 0), (9, 2, 0, 0)}
    assert {r.text for r in substrings.remove_repeats(docs).filter("doc_id = 9").collect()} == {"a b"}
    empty = spark.createDataFrame([], DOCS)
    assert substrings.query(empty).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_equals_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.query(docs).collect()}
    assert got == brute.jaccard([r[:2] for r in rows])


@pytest.mark.parametrize("broadcast", [True, False])
def test_jaccard_links_that_the_smallest_document_does_not_show(spark, monkeypatch, broadcast):
    """Groups whose pair with the smallest document fails are compared within themselves, over several blocks."""
    if not broadcast:
        monkeypatch.setattr(components, "BROADCAST_IDS", 0)
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 8 * 96 * 3)  # three documents
    monkeypatch.setattr(jaccard, "CALL_BYTES", 8 * 96 * 20)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for d in range(40):  # everything shares a passage; some share more
        w = base[:60] + [f"{d % 7}-{rng.randrange(3) if rng.random() < 0.06 else 0}-{i}" for i in range(40)]
        rows.append((d, " ".join(w)))
    rows += [(100 + d, " ".join(base[:60] + [f"{d}q{i}" for i in range(90)])) for d in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.query(docs).collect()}
    want = brute.jaccard(rows)
    assert got == want and 7 < len({c for _, c in want.values()}) < 40


@pytest.mark.parametrize("sides", [False, True])
def test_joining_links_make_the_groups_of_all_links(sides):
    rng = np.random.default_rng(7)
    pool = rng.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
    for k in range(60):
        of = pool[20 * (k % 5) : 20 * (k % 5) + 70]
        sets.append(np.unique(np.concatenate([of[rng.random(70) < 0.95], rng.integers(0, 2**63, 4).astype(np.uint64)])))
    group = np.arange(len(sets)) // 2 * 2
    side = rng.random(len(sets)) < 0.5 if sides else None
    own = int(np.searchsorted(jaccard._bands(200), 65, "right") - 1) * jaccard.SEEDS
    got = [(int(a), int(b)) for a, b in jaccard.joining(sets, own, group, side).T]
    links = [
        (a, b)
        for a in range(len(sets))
        for b in range(a)
        if len(sets[a]) and 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))
        and (side is None or side[a] != side[b])
    ]
    assert {tuple(sorted(p)) for p in got} <= {tuple(sorted(p)) for p in links}
    same = [(int(a), int(g)) for a, g in enumerate(group)]
    assert brute.components(range(len(sets)), got + same) == brute.components(range(len(sets)), links + same)
    assert len(got) < len(set(group.tolist())) < len(links)


def test_every_similar_pair_shares_a_key():
    """The pigeonhole bound, at the threshold and for all small sizes."""
    rng = np.random.default_rng(4)
    for n in [*range(1, 40), 60, 111, 250, 600]:
        for _ in range(6):
            extra = int(rng.integers(0, n // 4 + 1))
            shared = rng.integers(0, 2**63, n).astype(np.uint64)
            sets = []
            for own in (0, extra):
                s = np.unique(np.concatenate([shared, rng.integers(0, 2**63, own).astype(np.uint64)]))
                sets.append(s)
            lost = int(min(n - 1, (0.2 * (n + extra)) - extra)) if extra < 0.2 * (n + extra) else 0
            sets[0] = np.sort(rng.choice(sets[0], n - max(0, lost), replace=False))
            both = len(np.intersect1d(*sets))
            if 100 * both < 80 * (len(sets[0]) + len(sets[1]) - both):
                continue
            keys = []
            for s in sets:
                one = jaccard.Sets(np.zeros(len(s), np.int64), s, np.array([len(s)]))
                keys.append(set(np.concatenate([k.key for k in jaccard.sketches(one)]).tolist()))
            assert keys[0] & keys[1], (n, extra, len(sets[0]), len(sets[1]), both)


def test_jaccard_special_cases(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "a b", 0), (4, "A  B", 0), (5, "b a", 0), (None, "a b", 0), (3, "a b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link(docs).collect()), key=str)
    want = [(1, 0, 1), (2, 0, 2), (3, 1, 3), (3, 1, 3), (4, 1, 3), (5, 1, 5), (None, 1, None)]
    assert got == sorted(want, key=str)
    kept = jaccard.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "3", "5", "None"]
    assert jaccard.link(docs.limit(0)).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(100, 180)] + [(7, x) for x in range(300, 400)] + [(5, 5), (9, 8), (8, 9)]
    links += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(150)]
    got = {r.v: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [x for x in links if x[0] != x[1]]
    assert got == brute.components({v for x in real for v in x}, real)


@pytest.mark.parametrize("broadcast", [True, False])
def test_boilerplate_lines(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(lines, "BROADCAST_LINES", -1)
    rng = random.Random(6)
    rows = []
    for i in range(300):
        t = [rng.choice(["menu", " menu\t", "foot", "", f"own {i}", "rare", "menu"]) for _ in range(rng.randrange(1, 8))]
        rows.append((i, rng.choice(["x", "y", "y", "y", None]), rng.choice(["\n".join(t)] * 9 + [None, ""]), 77))
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, n_lines int")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in lines.drop_boilerplate(docs, ratio=0.3, min_pages=5).collect()}
    want = brute.boilerplate([(s, t) for _, s, t, _ in rows], 0.3, 5)
    assert got == {r[0]: w for r, w in zip(rows, want)} and any(w[1] for w in want)
    assert lines.drop_boilerplate(docs.limit(0)).count() == 0


def test_word_hashes_follow_the_bytes():
    texts = ["a b", None, "", "b c  a", "x" * 200 + " " + "x" * 136 + "y" * 64, "a"]
    w = words.split(pa.array(texts))
    h = words.hashes(w.data, w.start, w.end)
    spelled = [w.data[s:e].tobytes() for s, e in zip(w.start, w.end)]
    assert spelled == [x for t in texts for x in brute.words(t)]
    assert len(set(h.tolist())) == len(set(spelled)) and h[0] == h[3] == h[6]
    assert list(words.slices(pa.array(["a" * 10, "b" * 300, None, "c"]), 20)) == [(0, 1), (1, 2), (2, 4)]
