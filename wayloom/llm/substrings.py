"""Substring dedup by prefix-partitioned suffixes, grouped by hashes of their windows.

A window is ``WINDOW`` consecutive words. A word goes if a window over it has the word sequence of a window
that starts earlier (smaller id, or the same document and an earlier start).

Only suffixes that can repeat for ``WINDOW`` words take part. Every window has an anchor, the least of its
ten-word hashes; equal windows have equal anchors, so a window whose anchor occurs once in the corpus is a
leaf that branches off above depth ``WINDOW``. Anchors (about every sixth word) are counted first, and
documents get back those of theirs that occur again.

The suffixes left are dealt to groups by a prefix of five words; prefixes that are frequent in a sample
of the documents (``SAMPLE``; it shapes the layout, never the result) are lengthened to ten, then to
twenty words, so that groups fit in memory. In a group the suffixes, cut to twenty words
and held as two hashes of ten words, are sorted by these hashes (not in word order; there are no nodes of other
depths); equal pairs of hashes are the repeats, and all but the earliest start a repeated window. Neighbouring windows merge into spans, the maximal
repeats. Suffixes of one batch with equal paths are merged before the shuffle, so a passage that a
third of the documents share adds one suffix per batch to its group.

Exact copies of a whole text take no part: of texts of ``WINDOW`` words or more, all words of all but the
smallest id go; the texts themselves stay out of the shuffles.

Results in special cases: a null or blank text has no words, and an empty result text; rows with a null
id are neither compared nor changed but for their blanks; rows that repeat an id count as the same document,
whose equal starts are not earlier than each other; an empty table gives an empty table. Columns named like
an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm import words
from wayloom.llm.arrow import column, lean, lean_group, with_columns
from wayloom.llm.components import BROADCAST_IDS, only
from wayloom.session import materialize

WINDOW = 20
HALF = 10
PREFIX = 5
BUCKET_BYTES = 32 << 20  # of text for each group of suffixes
MIN_BUCKETS = 64
BATCH_BYTES = 8 << 20  # of text whose suffixes are packed at a time
SAMPLE = 64  # one document in so many tells which prefixes are frequent
FREQUENT = 200_000  # suffixes with a prefix, above which it is lengthened


def _windows(texts: pa.Array) -> tuple[words.Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word spans and hashes; hashes of ten words from each word; starts of all windows, their document
    and the place of their anchor."""
    w = words.split(texts)
    h = words.hashes(w.data, w.start, w.end)
    n = np.diff(w.first)
    doc = np.repeat(np.arange(len(n)), n)
    half = words.grams(h, HALF)
    if len(h) < WINDOW:
        none = np.zeros(0, np.int64)
        return w, h, half, none, none, none
    starts = np.flatnonzero(doc[: len(h) - WINDOW + 1] == doc[WINDOW - 1 :])
    view = np.lib.stride_tricks.sliding_window_view(half, WINDOW - HALF + 1)
    anchor = np.empty(len(starts), np.int64)
    for lo in range(0, len(starts), 1 << 16):
        some = starts[lo : lo + (1 << 16)]
        anchor[lo : lo + (1 << 16)] = some + view[some].argmin(axis=1)
    return w, h, half, starts, doc[starts], anchor


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``BATCH_BYTES`` of text (or one row), so that a task's arrays stay small."""
    for b in batches:
        for lo, hi in words.slices(column(b, "text"), BATCH_BYTES):
            yield b.slice(lo, hi - lo)


def _by_doc(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Documents once, each with its values packed."""
    order = np.argsort(doc, kind="stable")
    doc, value = doc[order], value[order]
    begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    cut = np.append(begin, len(doc))
    return doc[begin], [value[cut[i] : cut[i + 1]].tobytes() for i in range(len(begin))]


def _anchors(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows v, anchors: by document, packed hashes of its anchors that occur again."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches):
            ids, texts = column(b, "id").to_numpy(), column(b, "text")
            hashes, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for lo, hi in words.slices(texts):
                _, _, half, starts, doc, anchor = _windows(texts.slice(lo, hi - lo))
                at, one = np.unique(anchor, return_index=True)
                hashes.append(half[at])
                docs.append(ids[lo:hi][doc[one]])
            h, d = np.concatenate(hashes), np.concatenate(docs)
            order = np.argsort(h, kind="stable")
            h, d = h[order], d[order]
            first = np.append(True, h[1:] != h[:-1]) if len(h) else np.zeros(0, bool)
            several = ~first | np.append(~first[1:], False) if len(h) else first
            v, packed = _by_doc(d[several], h[several])
            h, d = h[first], d[first]
            bucket = (h >> np.uint64(32)).astype(np.int64) * buckets >> 32
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(cut))
            left = [h[cut[k] : cut[k + 1]].tobytes() for k in some] + [v.tobytes()]
            right = [d[cut[k] : cut[k + 1]].tobytes() for k in some] + [b"".join(packed)]
            sizes = [b""] * len(some) + [np.array([len(p) // 8 for p in packed], np.int64).tobytes()]
            where = [*some.tolist(), -1 - int(ids[0]) % buckets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(where, pa.int64())] + [pa.array(x, pa.binary()) for x in (left, right, sizes)],
                names=["bucket", "l", "r", "n"],
            )

    def meet(t: pa.Table) -> pa.Table:
        hashes, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        local = t.column("bucket")[0].as_py() < 0
        for x, y, n in zip(*(t.column(c).to_pylist() for c in ("l", "r", "n")), strict=True):
            if local:
                docs.append(np.repeat(np.frombuffer(x, np.int64), np.frombuffer(n, np.int64)))
                hashes.append(np.frombuffer(y, np.uint64))
            else:
                hashes.append(np.frombuffer(x, np.uint64))
                docs.append(np.frombuffer(y, np.int64))
        h, d = np.concatenate(hashes), np.concatenate(docs)
        if not local and len(h):
            order = np.argsort(h, kind="stable")
            h, d = h[order], d[order]
            same = h[1:] == h[:-1]
            several = np.append(False, same) | np.append(same, False)
            h, d = h[several], d[several]
        v, packed = _by_doc(d, h)
        return pa.table({"v": v, "anchors": pa.array(packed, pa.binary())})

    packed = rows.mapInArrow(lean(pack), "bucket long, l binary, r binary, n binary")
    found = packed.groupBy("bucket").applyInArrow(lean_group(meet), "v long, anchors binary")
    return found.groupBy("v").agg(F.collect_list("anchors").alias("anchors"))  # no more than the document has


def _frequent(rows: DataFrame) -> np.ndarray:
    """Hashes of prefixes of five and ten words to be lengthened; at most suffixes / FREQUENT of each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = column(b, "text")
            found = [np.zeros(0, np.uint64)]
            for lo, hi in words.slices(texts):
                w = words.split(texts.slice(lo, hi - lo))
                h = words.hashes(w.data, w.start, w.end)
                found += [words.grams(h, PREFIX), words.grams(h, HALF)]
            p, n = np.unique(np.concatenate(found), return_counts=True)
            some = n >= 4
            yield pa.RecordBatch.from_arrays([pa.array(p[some].view(np.int64)), pa.array(n[some])], names=["p", "n"])

    sample = rows.filter(F.pmod(F.xxhash64("id", F.lit("prefix")), F.lit(SAMPLE)) == 0)
    total = sample.mapInArrow(lean(count), "p long, n long").groupBy("p").agg(F.sum("n").alias("n"))
    found = total.filter(F.col("n") > FREQUENT // SAMPLE).select("p").collect()
    return np.sort(np.array([r["p"] for r in found], np.int64).view(np.uint64))


def _starts(rows: DataFrame, frequent: np.ndarray, buckets: int) -> DataFrame:
    """Rows v, starts: by document, packed starts of its repeated windows. ``rows``: id, text, anchors."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches):
            ids, texts = column(b, "id").to_numpy(), column(b, "text")
            known_by_row = column(b, "anchors").to_pylist()
            parts: list[list[np.ndarray]] = [[] for _ in range(5)]
            for lo, hi in words.slices(texts):
                w, h, half, starts, doc, anchor = _windows(texts.slice(lo, hi - lo))
                mine = [np.frombuffer(b"".join(known_by_row[i]), np.uint64) for i in range(lo, hi)]
                owner = np.repeat(np.arange(hi - lo), [len(x) for x in mine])
                # An anchor counts for the document it was found in.
                tag = lambda v, d: words.mix(v + d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                hit = np.isin(tag(half[anchor], doc), tag(np.concatenate([np.zeros(0, np.uint64), *mine]), owner))
                s, d = starts[hit], doc[hit]
                prefix = words.grams(h, PREFIX)[s]
                ten, whole = half[s], half[s + HALF]
                if len(frequent):
                    longer = np.isin(prefix, frequent)
                    prefix = np.where(longer, ten, prefix)
                    longer &= np.isin(ten, frequent)
                    prefix = np.where(longer, words.mix(ten + whole), prefix)
                for part, x in zip(parts, (prefix, ten, whole, ids[lo:hi][d], s - w.first[d]), strict=True):
                    part.append(x)
            prefix, a, c = (np.concatenate(p) if p else np.zeros(0, np.uint64) for p in parts[:3])
            doc, pos = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts[3:])
            later, order = _later(a, c, doc, pos)
            v, packed = _by_doc(doc[order][later], pos[order][later])
            keep = order[~later]
            prefix, a, c, doc, pos = (x[keep] for x in (prefix, a, c, doc, pos))
            bucket = (words.mix(prefix) >> np.uint64(32)).astype(np.int64) * buckets >> 32
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(cut))
            sizes = np.array([len(p) // 8 for p in packed], np.int64).tobytes()
            columns = [[*some.tolist(), -1 - int(ids[0]) % buckets]]
            for x, rest in ((a, v.tobytes()), (c, sizes), (doc, b"".join(packed)), (pos, b"")):
                columns.append([x[order[cut[k] : cut[k + 1]]].tobytes() for k in some] + [rest])
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64())] + [pa.array(x, pa.binary()) for x in columns[1:]],
                names=["bucket", "a", "c", "doc", "pos"],
            )

    def meet(t: pa.Table) -> pa.Table:
        whole = [t.column(x).to_pylist() for x in ("a", "c", "doc", "pos")]
        if t.column("bucket")[0].as_py() < 0:
            docs, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for x, n, p, _ in zip(*whole, strict=True):
                docs.append(np.repeat(np.frombuffer(x, np.int64), np.frombuffer(n, np.int64)))
                places.append(np.frombuffer(p, np.int64))
            v, packed = _by_doc(np.concatenate(docs), np.concatenate(places))
        else:
            a, c = (np.frombuffer(b"".join(x), np.uint64) for x in whole[:2])
            doc, pos = (np.frombuffer(b"".join(x), np.int64) for x in whole[2:])
            later, order = _later(a, c, doc, pos)
            v, packed = _by_doc(doc[order][later], pos[order][later])
        return pa.table({"v": v, "starts": pa.array(packed, pa.binary())})

    packed = rows.mapInArrow(lean(pack), "bucket long, a binary, c binary, doc binary, pos binary")
    found = packed.groupBy("bucket").applyInArrow(lean_group(meet), "v long, starts binary")
    return found.groupBy("v").agg(F.collect_list("starts").alias("starts"))  # no more than the document has


def _later(a: np.ndarray, c: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort suffixes by the hashes of their first ten words and the next ten, then by place of start, and tell in
    that order which of those with equal hashes start later than their earliest."""
    order = np.lexsort((pos, doc, c, a))
    x, y, d, p = a[order], c[order], doc[order], pos[order]
    if not len(order):
        return np.zeros(0, bool), order
    node = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
    head = np.flatnonzero(node)[np.cumsum(node) - 1]
    return (d != d[head]) | (p != p[head]), order


def _kept(b: pa.RecordBatch, with_starts: bool) -> list:
    """Columns text, n_words, n_removed and spans."""
    texts = column(b, "text")
    packed = column(b, "starts").to_pylist() if with_starts else None
    out, n_words, n_removed, spans = [], [], [], []
    for lo, hi in words.slices(texts):
        w = words.split(texts.slice(lo, hi - lo))
        n = np.diff(w.first)
        again = np.zeros(len(w.start), bool)
        for i in range(lo, hi) if packed else ():
            again[np.frombuffer(b"".join(packed[i] or []), np.int64) + w.first[i - lo]] = True
        covered = _covered(again)
        keep = ~covered
        length = np.where(keep, w.end - w.start + 1, 0)
        first = np.cumsum(length) - length
        total = int(length.sum())
        place = np.repeat(w.start - first, length) + np.arange(total)
        data = w.data[np.minimum(place, max(len(w.data) - 1, 0))].copy() if total else np.zeros(0, np.uint8)
        data[(first + length - 1)[keep]] = 32
        ends = np.append(first, total)
        for i in range(hi - lo):
            x, y = ends[w.first[i]], ends[w.first[i + 1]]
            out.append(data[x : max(x, y - 1)].tobytes())
            c = covered[w.first[i] : w.first[i + 1]]
            n_words.append(int(n[i]))
            n_removed.append(int(c.sum()))
            if c.any():
                turn = np.flatnonzero(np.diff(np.concatenate([[0], c.astype(np.int8), [0]])))
                spans.append([{"first": int(p), "end": int(q)} for p, q in turn.reshape(-1, 2)])
            else:
                spans.append([])
    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
    return [
        pa.array(out, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
        pa.array(spans, kind),
    ]


def _covered(starts: np.ndarray) -> np.ndarray:
    """Words within a window that begins at a start."""
    change = np.zeros(len(starts) + WINDOW, np.int64)
    change[: len(starts)] += starts
    change[WINDOW:] -= starts
    return np.cumsum(change)[: len(starts)] > 0


FIELDS = "text string, n_words long, n_removed long, spans array<struct<first: long, end: long>>"


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: its id, ``text`` (the words that stay, joined by blanks), ``n_words``, ``n_removed`` and
    ``spans`` (removed words: first, and the one after the last)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    named = rows.filter("id is not null")
    # Copies of whole texts: all but the smallest id.
    texts = named.filter("text is not null").select("id", F.sha2("text", 256).alias("h"))
    least = texts.groupBy("h").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most")
    copies = materialize(texts.join(least, "h").filter("id > least").select(F.col("id").alias("v")).distinct(), "copies")
    few = copies.count() <= BROADCAST_IDS
    single = named.join(F.broadcast(copies) if few else copies, F.col("id") == F.col("v"), "left_anti")
    size = named.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(MIN_BUCKETS, -(-size // BUCKET_BYTES))
    anchors = materialize(_anchors(single, buckets), "anchors")
    some = only(single, "id", anchors).join(anchors, F.col("id") == F.col("v")).select("id", "text", "anchors")
    starts = materialize(_starts(some, _frequent(single), buckets), "starts")

    # A copy loses every word, if it has a window at all: told by starts that cover it.
    def everything(b: pa.RecordBatch) -> list:
        return [pa.array([[_all(n)] for n in _counts(column(b, "text"))], pa.list_(pa.binary()))]

    gone = with_columns(only(named, "id", copies).select("id", "text"), "starts array<binary>", everything)
    hit = only(single, "id", starts).join(starts, F.col("id") == F.col("v")).select("id", "text", "starts")
    rest = single.join(F.broadcast(starts.select("v")) if starts.count() <= BROADCAST_IDS else starts.select("v"), F.col("id") == F.col("v"), "left_anti")
    rest = rest.unionByName(rows.filter("id is null"))
    changed = hit.unionByName(gone)
    done = with_columns(changed.withColumnRenamed("text", "__t"), FIELDS, lambda b: _kept(_named(b), True), ("__t", "starts"))
    same = with_columns(rest.withColumnRenamed("text", "__t"), FIELDS, lambda b: _kept(_named(b), False), ("__t",))
    return done.unionByName(same).withColumnRenamed("id", doc_id)


def _named(b: pa.RecordBatch) -> pa.RecordBatch:
    return b.rename_columns(["text" if c == "__t" else c for c in b.schema.names])


def _counts(texts: pa.Array) -> list[int]:
    out: list[int] = []
    for lo, hi in words.slices(texts):
        out += np.diff(words.split(texts.slice(lo, hi - lo)).first).tolist()
    return out


def _all(n: int) -> bytes:
    return np.arange(max(0, n - WINDOW + 1), dtype=np.int64).tobytes()


def query(docs: DataFrame) -> DataFrame:
    out = remove_repeats(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
