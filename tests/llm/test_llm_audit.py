"""Importance resampling, WARC archives and the source audit against plain definitions."""

import hashlib
import io
import math
import random
import re
import zipfile
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from wayloom.llm import divergence, resample, warc

DOCS = "doc_id long, text string, lang string, source string, score string"
LOWER = {i: i + 32 for i in range(65, 91)}


def corpus(seed, n=300):
    """Documents with odd signs, null columns, repeated rows, and one language that holds most rows."""
    rng = random.Random(seed)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["É", "ß-x", "日本", "Ab9c", "9", "'", "x" * 300]
    out = []
    for d in range(n):
        lang = rng.choice(["en"] * 6 + ["fr", None, ""])
        source = rng.choice([f"s{i}" for i in range(7)] + [None, "é"])
        own = vocabulary[: 40 + 10 * len(str(source))]
        text = rng.choice([" ", "  ", ", ", "\n"]).join(rng.choice(own) for _ in range(rng.randrange(0, 70)))
        out.append((d, rng.choice([text] * 12 + [None, ""]), lang, source, "clash"))
    out += [out[3], (7, "another text under an id that is taken", "en", "s1", "x"), (None, "no id " * 30, "en", "s2", "x")]
    out.append((n + 5, None, "empty", "alone", "x"))
    return out


def words(text, pattern):
    return re.findall(pattern, (text or "").translate(LOWER))


def drawn(rows, target, max_n, buckets, least, percent, seed):
    """(doc_id, n_features, weight, score) of each row, and the ids in rank order."""

    def buckets_of(text):
        w = words(text, "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]

    s, t = (Counter(b for text in texts for b in buckets_of(text)[1]) for texts in ([r[1] for r in rows], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    out = []
    for d, text, *_ in rows:
        n, f = buckets_of(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in f]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n))
    enough = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], math.inf if r[0] is None else r[0], r[1]))
    return [r[:4] for r in out], [r[:4] for r in enough[: percent * len(enough) // 100]]


@pytest.mark.parametrize("max_n, buckets, percent", [(1, 10_000, 10), (3, 64, 40)])
def test_resampling_equals_its_definition(spark, max_n, buckets, percent):
    rows = corpus(11)
    target = ["waa wba wca " * 5, None, "", "É 日本 wda"]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resample.resample(docs, bench, max_n=max_n, buckets=buckets, percent=percent).collect()
    want, order = drawn(rows, target, max_n, buckets, resample.MIN_WORDS, percent, resample.SEED)
    assert sorted(map(str, ((r.doc_id, r.n_features, r.weight, r.score) for r in got))) == sorted(map(str, want))
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(order) + 1)) and len(order) > 5
    assert [(r.doc_id, r.n_features, r.weight, r.score) for r in ranked] == order


def test_ranks_of_equal_scores_follow_the_id(spark, monkeypatch):
    monkeypatch.setattr(resample, "ID_RANGE", 4)
    rows = [(i, 30, 30, 5 if i % 3 else 9, i * 7 % 50) for i in range(50)]
    table = spark.createDataFrame(rows, "__row long, n_words long, n_features long, score long, id long").repartition(6)
    got = {r["__row"]: r["rank"] for r in resample.rank(table, "id", 20, 60).collect()}
    order = sorted(rows, key=lambda r: (-r[3], r[4]))[:30]
    assert got == {r[0]: None for r in rows} | {r[0]: k for k, r in enumerate(order, 1)}


def test_crcs_of_runs_come_from_two_prefixes():
    texts = ["One two  THREE", None, "", "x" * 5000 + " é " + "y" * 70, "a-b.c_d e", "one"]
    grams = resample.Grams(pa.array(texts))
    spelled = [words(t, "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+") for t in texts]
    for n in (1, 2, 3, 9):
        want = [(zlib.crc32(" ".join(w[i : i + n]).encode()), d) for d, w in enumerate(spelled) for i in range(len(w) - n + 1)]
        crc, doc = grams.crcs(n)
        assert list(zip(crc.tolist(), doc.tolist())) == want
    assert resample.Grams(pa.array([], pa.string())).crcs(1)[0].tolist() == []


def test_resampling_of_nothing(spark):
    docs = spark.createDataFrame(corpus(4, 30), DOCS)
    none = spark.createDataFrame([], "item_id long, text string")
    assert resample.resample(docs.limit(0), none).count() == 0
    got = resample.resample(docs, none, percent=100).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 1 + sum(r.n_words >= 20 for r in got)))


# --- WARC ---

PAGES = "page_id long, url string, html string, payload string"


def page_rows():
    rng = random.Random(3)
    long = ["é" * 60, "<p>" + "x" * 97, "y" * 5000, "z" * 200_000]
    rows = [(i, f"http://h/{i}", rng.choice(long + ["", None, "short", f"own {i} " * 30]), "clash") for i in range(200)]
    rows += [(5, "http://h/5", rows[5][2], "again"), (5, "http://h/5", "w" * 150, "other"), (None, None, "y" * 5000, "")]
    return rows + [(None, "a\r\nWARC-Type: x", "only without an id " * 9, ""), (-3, "http://h/m", "é" * 60, "")]


def records_of(rows):
    raw = [((h or "").encode(), p) for p, _, h, _ in rows]
    first = {}
    for b, p in raw:
        if len(b) >= 100 and p is not None:
            first[b] = min(first.get(b, p), p)
    out = []
    for b, p in raw:
        f = first.get(b)
        refers = f if f is not None and f != p else None
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(map(str, out))


@pytest.mark.parametrize("archive_bytes, range_bytes", [(1 << 28, 1 << 22), (4000, 900)])
def test_records_come_back_from_the_archives(spark, archive_bytes, range_bytes):
    rows = page_rows()
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    written = warc.write(pages, archive_bytes=archive_bytes)
    got = warc.read(written, range_bytes=range_bytes).collect()
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == records_of(rows)
    assert (written.count() > 10) == (archive_bytes == 4000)
    payloads = {(r.page_id, bytes(r.payload)) for r in got if r.record_type == "response"}
    assert payloads <= {(p, (h or "").encode()) for p, _, h, _ in rows} and (5, b"w" * 150) in payloads
    assert {r.target_uri for r in got if r.page_id is None} == {None, "a%0D%0AWARC-Type: x"}
    assert warc.read(warc.write(pages.limit(0))).count() == 0


def archive(names, comment=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name in names:
            z.writestr(name, name.encode() * 50)
        z.comment = comment
    return out


@pytest.mark.parametrize("limits", [{}, {"ZIP64_LIMIT": 100, "ZIP_FILECOUNT_LIMIT": 2}])
def test_directories_are_parsed_with_and_without_zip64(monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(zipfile, name, value)
    names = ["a", "archive/é.warc", "indexes/i"]
    out = archive(names, b"a comment with PK\x05\x06 in it, long enough to look like a record")
    assert (warc.END64 in out.getvalue()) == bool(limits)
    members = warc.directory(out, len(out.getvalue()))
    assert [m.name for m in members] == names
    for m in members:
        assert warc._at(out, warc.content_place(out, m), m.size) == m.name.encode() * 50


def test_broken_archives_are_errors():
    out = archive(["a"])
    raw = out.getvalue()
    with pytest.raises(ValueError):
        warc.directory(io.BytesIO(raw[:-5]), len(raw) - 5)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", "x" * 99)
    with pytest.raises(ValueError, match="stored"):
        warc.content_place(packed, warc.directory(packed, len(packed.getvalue()))[0])
    record = warc.record(1, "http://h", b"page", hashlib.sha256(b"other").hexdigest(), None, False)
    with pytest.raises(ValueError, match="digest"):
        warc.parse(record)


# --- divergences ---


def audit(rows, min_docs, top):
    text = lambda r: re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (r[1] or "").translate(LOWER))
    groups, df, count, out = {}, Counter(), Counter(), []
    for r in rows:
        lang, source = r[2] or "", r[3] or ""
        groups.setdefault(lang, set()).add(source)
        df.update((lang, t) for t in set(text(r)))
        count.update((lang, source, t) for t in text(r))
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, sources in groups.items():
        kept = [t for (x, t), n in df.items() if x == lang and n >= min_docs]
        v = len(kept)
        counts = {s: {t: count[lang, s, t] for t in kept} for s in sources}
        whole = {t: sum(c[t] for c in counts.values()) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * v) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        for s in sources:
            pair = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            term = [(t, f(p[s][t], q[t])) for t in kept if counts[s][t] > 0 and p[s][t] > q[t]]
            for part, items in (("pair", pair), ("term", term)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, x, k) for k, (i, x) in enumerate(items, 1) if part == "pair" or k <= top]
    return sorted(out)


@pytest.mark.parametrize(
    "settings", [{}, {"limit": 40, "slice_cells": 60}, {"block": 2, "slice_cells": 100}, {"block": 3, "top": 3, "min_docs": 2}]
)
def test_divergences_equal_their_definition(spark, settings):
    rows = corpus(21)
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    got = [tuple(r) for r in divergence.divergences(docs, **settings).collect()]
    assert sorted(got) == audit(rows, settings.get("min_docs", 10), settings.get("top", 10))
    assert {r[2] for r in got} == {"pair", "term"} and "empty" not in {r[0] for r in got}


def test_divergences_of_long_texts_and_of_nothing(spark):
    rows = [(i, "once " * (i % 3), "en", f"s{i % 3}", "") for i in range(30)] + [(99, "long é " * 400_000, "en", "s1", "")]
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted(tuple(r) for r in divergence.divergences(docs).collect()) == audit(rows, 10, 10)
    assert divergence.divergences(docs.limit(0)).count() == 0
    none = spark.createDataFrame([(1, None, None, "a"), (2, "x", None, None), (3, "", None, "b")], "doc_id long, text string, lang string, source string")
    assert {tuple(r)[2:5:2] for r in divergence.divergences(none).collect()} == {("pair", 0)}


def test_shares_beyond_64_bits_are_exact():
    import numpy as np

    counts, n = np.array([[3, 9_500_000_000]]), np.array([[19_000_000_000, 9_500_000_003]])
    want = [[1 + 10**9 * (int(c) + 2) // (int(m) + 10) for c, m in zip(counts[0], n[0])]]
    assert divergence._shares(counts, n, 5).tolist() == want
