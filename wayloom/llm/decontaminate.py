"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages of at most ``WINDOW`` words. Their words, weighted by how few of
all documents hold them (document counts cover the whole corpus), make a TF-IDF matrix, whose leading
right singular vectors are found by randomised subspace iteration: each round is a Spark job over the
passages whose partial products are summed by feature. Windows of ``WINDOW`` words at every ``STEP``
words of each whole document are folded into that latent space. Passages with a cosine of ``COSINE`` or more, on
which the window's vector has a projection of ``COVER`` of their own length or more, are candidates. A candidate counts if the longest common subsequence with the words
around the window holds ``LCS`` of the passage's words, or ``LCS_WITH_ANSWER`` of them and the answer
(a column of the benchmark, else the item's last sentence) word by word.

Words in more than ``MAX_SHARE`` of the documents (and ``MIN_COMMON`` at least) are left out of the matrix, but every passage keeps its
``KEPT`` rarest words; the subsequence is over all words. Words are runs of letters and digits in lower
case.

A space holds at most ``RANK`` passages, so its rank is never below their number and each passage lies wholly
in it (but for singular values below 1e-4). A passage that shares no word with the others is found like any other.

Passages are worked in shards of ``SHARD``, cut into spaces of at most ``RANK * WINDOW`` words and vectors of
``RANK`` numbers (17 MB). Words are counted in one pass for each shard. Documents are never shuffled.

Results in special cases: null or empty texts and items match nothing; an empty benchmark leaves all
documents clean; an item without an answer's words is judged by the subsequence alone; repeated
documents are judged alike, repeated items tie and the smallest item id is named (null last); an empty
table gives an empty table. Columns named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm import words
from wayloom.llm.arrow import column, with_columns

WINDOW = 64
STEP = 32
RANK = 256
SHARD = 1000
MAX_SHARE = 0.05
MIN_COMMON = 20
KEPT = 8
ROUNDS = 3
COSINE = 0.35
COVER = 0.4
LCS = 0.7
LCS_WITH_ANSWER = 0.5
MIN_HITS = 3


class _Passages(NamedTuple):
    item: np.ndarray  # number of the item in the order of ids
    words: list[np.ndarray]  # hashes of all words
    answers: list[np.ndarray]


class _Space(NamedTuple):
    vocabulary: np.ndarray  # sorted word hashes
    weight: np.ndarray  # idf by word
    vectors: np.ndarray  # words by rank
    latent: np.ndarray  # passages by rank, of length one
    length: np.ndarray  # of each passage's vector before
    min_hits: int
    passages: _Passages


def _hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    w = words.split(texts, lower=True, letters=True)
    return words.hashes(w.data, w.start, w.end), w.first


def _read(rows: list, has_answer: bool) -> _Passages:
    """Passages of the items of a shard."""
    item, parts, answers = [], [], []
    h, first = _hashes(pa.array([r["text"] for r in rows], pa.string()))
    said = [r["answer"] if has_answer else _last_sentence(r["text"]) for r in rows]
    ha, first_a = _hashes(pa.array(said, pa.string()))
    for k in range(len(rows)):
        own = h[first[k] : first[k + 1]]
        for lo in range(0, len(own), WINDOW):
            # The rest of an item too short to stand alone goes with the words before it.
            lo_ = max(0, min(lo, len(own) - min(len(own), WINDOW // 2)))
            item.append(rows[k]["n"])
            parts.append(own[lo_ : lo + WINDOW])
            answers.append(ha[first_a[k] : first_a[k + 1]] if lo + WINDOW >= len(own) else ha[:0])
    return _Passages(np.array(item, np.int64), parts, answers)


def _last_sentence(text: str | None) -> str:
    parts = [p for p in (text or "").replace("\n", ". ").split(". ") if p.strip(" .")]
    return parts[-1] if len(parts) > 1 else ""


def _document_counts(docs: DataFrame, text: str, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """How many documents hold each word, and how many there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(vocabulary), np.int64), 0
        for b in batches:
            for lo, hi in words.slices(column(b, text)):
                n += hi - lo
                h, first = _hashes(words.in_row_order(b, lo, hi, text))
                k, at = _known(vocabulary, h)
                doc = np.searchsorted(first, at, "right") - 1
                total += np.bincount(np.unique(doc * len(vocabulary) + k) % len(vocabulary), minlength=len(vocabulary))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))], names=["k", "n"]
        )

    rows = docs.select(text).mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    out, n = np.zeros(len(vocabulary), np.int64), 0
    for r in rows:
        if r["k"] < 0:
            n = r["n"]
        else:
            out[r["k"]] = r["n"]
    return out, n


def _known(vocabulary: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words that are in the vocabulary, and their places in ``h``."""
    table = np.zeros(1 << 20, bool)
    table[vocabulary >> np.uint64(44)] = True
    at = np.flatnonzero(table[h >> np.uint64(44)])
    k = np.minimum(np.searchsorted(vocabulary, h[at]), len(vocabulary) - 1)
    hit = vocabulary[k] == h[at]
    return k[hit], at[hit]


def _sparse(passages: list[np.ndarray], vocabulary: np.ndarray, weight: np.ndarray, used: np.ndarray) -> list:
    """Rows (features, values of length one, length before): each passage's used words, or its rarest if those are few."""
    out = []
    for p in passages:
        k = np.unique(np.searchsorted(vocabulary, p))
        keep = used[k]
        if keep.sum() < KEPT:
            keep = np.zeros(len(k), bool)
            keep[np.argsort(-weight[k], kind="stable")[:KEPT]] = True
        k, v = k[keep], weight[k][keep]
        length = max(np.sqrt((v * v).sum()), 1e-12)
        out.append((k, v / length, length))
    return out


def randomised_svd(spark, rows: list, n_features: int, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading right singular vectors and singular values of a sparse matrix, by subspace iteration."""
    rank = min(rank, len(rows), n_features)
    z = np.linalg.qr(np.random.default_rng(7).standard_normal((n_features, rank)))[0]
    frame = spark.createDataFrame(
        [(k.tolist(), v.tolist()) for k, v in rows], "k array<int>, v array<double>"
    ).repartition(max(1, len(rows) // 100))

    def turn(z: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for b in batches:
                for k, v in zip(column(b, "k").to_pylist(), column(b, "v").to_pylist(), strict=True):
                    image = np.array(v) @ z[k]
                    for i, x in zip(k, v, strict=True):
                        total[i] = total.get(i, 0.0) + x * image
            packed = pa.array([x.tobytes() for x in total.values()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), packed], names=["k", "x"])

        return run

    def add(g: pd.DataFrame) -> pd.DataFrame:
        parts = {k: np.sum([np.frombuffer(x) for x in own], axis=0).tobytes() for k, own in g.groupby("k").x}
        return pd.DataFrame({"k": list(parts), "x": list(parts.values())})

    for _ in range(ROUNDS):
        sums = frame.mapInArrow(turn(z), "k int, x binary").groupBy(F.expr("k % 64")).applyInPandas(add, "k int, x binary")
        y = np.zeros_like(z)
        for r in sums.collect():  # at most RANK * WINDOW rows of RANK numbers
            y[r["k"]] = np.frombuffer(bytes(r["x"]))
        z, r_ = np.linalg.qr(y)
    # y was (A'A) times the last basis, so r_'s singular values are about the squares of A's.
    u, s, _ = np.linalg.svd(r_)
    keep = s > 1e-8
    return (z @ u)[:, keep], np.sqrt(s[keep])


def _spaces(docs: DataFrame, text: str, passages: _Passages) -> list[_Space]:
    """Spaces of a shard, of ``RANK`` passages each."""
    if not passages.words:
        return []
    vocabulary = np.unique(np.concatenate(passages.words))
    counts, n = _document_counts(docs, text, vocabulary)
    weight = np.maximum(np.log((n + 1) / (counts + 0.5)), 1e-3)
    rows = _sparse(passages.words, vocabulary, weight, counts <= max(MAX_SHARE * n, MIN_COMMON))
    out = []
    for lo in range(0, len(rows), RANK):
        some = slice(lo, lo + RANK)
        part = _Passages(passages.item[some], passages.words[some], passages.answers[some])
        out.append(_space(docs.sparkSession, vocabulary, weight, rows[some], part))
    return out


def _space(spark, vocabulary: np.ndarray, weight: np.ndarray, rows: list, passages: _Passages) -> _Space:
    """The space of at most ``RANK`` passages. ``rows``: theirs, from ``_sparse``."""
    features = np.unique(np.concatenate([k for k, _, _ in rows]))
    length = np.array([x for _, _, x in rows])
    rows = [(np.searchsorted(features, k), v) for k, v, _ in rows]
    vectors, _ = randomised_svd(spark, rows, len(features), RANK)
    latent = np.array([v @ vectors[k] for k, v in rows])
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    return _Space(
        vocabulary[features], weight[features], vectors.astype(np.float32),
        latent.astype(np.float32), length.astype(np.float32), min(MIN_HITS, min(len(k) for k, _ in rows)), passages,
    )


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, one step of bit arithmetic for each word of ``b``."""
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        m = places.get(x)
        if m:
            both = row & m
            row = ((row + both) | (row - both)) & full
    return len(a) - row.bit_count()


def _contains(where: np.ndarray, what: np.ndarray) -> bool:
    n = len(what)
    return any(np.array_equal(where[i : i + n], what) for i in np.flatnonzero(where[: len(where) - n + 1] == what[0]))


def _search(space: _Space, h: np.ndarray, first: np.ndarray) -> list[list[tuple]]:
    """Of each document: (subsequence share, cosine, item, whether it counts), for each candidate passage."""
    n_docs = len(first) - 1
    out: list[list[tuple]] = [[] for _ in range(n_docs)]
    k, at = _known(space.vocabulary, h)
    if not len(at):
        return out
    doc = np.searchsorted(first, at, "right") - 1
    n_windows = np.diff(first) // STEP + 1
    base = np.cumsum(n_windows) - n_windows
    step = (at - first[doc]) // STEP
    window = np.concatenate([base[doc] + step, (base[doc] + step - 1)[step > 0]])
    word = np.concatenate([k, k[step > 0]])
    pair = np.unique(window * len(space.vocabulary) + word)
    window, word = pair // len(space.vocabulary), pair % len(space.vocabulary)
    begin = np.flatnonzero(np.append(True, window[1:] != window[:-1]))
    hits = np.diff(np.append(begin, len(window)))
    some = np.repeat(hits >= space.min_hits, hits)
    window, word = window[some], word[some]
    if not len(window):
        return out
    begin = np.flatnonzero(np.append(True, window[1:] != window[:-1]))
    for lo in range(0, len(begin), 4096):
        cut = begin[lo : lo + 4096]
        end = begin[lo + 4096] if lo + 4096 < len(begin) else len(window)
        own = word[cut[0] : end]
        latent = np.add.reduceat(space.vectors[own] * space.weight[own, None].astype(np.float32), cut - cut[0])
        projection = latent @ space.latent.T
        cosine = projection / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
        for row, p in zip(*np.nonzero((cosine >= COSINE) & (projection >= COVER * space.length)), strict=True):
            w = window[cut[row]]
            d = int(np.searchsorted(base, w, "right")) - 1
            lo_word = int(first[d] + (w - base[d]) * STEP)
            region = h[max(int(first[d]), lo_word - STEP) : min(int(first[d + 1]), lo_word + WINDOW + STEP)]
            wanted = space.passages.words[p]
            share = common_subsequence(wanted, region) / len(wanted)
            answer = space.passages.answers[p]
            counts = share >= LCS or share >= LCS_WITH_ANSWER and len(answer) > 0 and _contains(region, answer)
            out[d].append((share, float(cosine[row, p]), int(space.passages.item[p]), bool(counts)))
    return out


def find(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
    item_text: str = "text", answer: str | None = None, keep_text: bool = True,
) -> DataFrame:
    """``docs`` with ``contaminated``, ``item_id`` (of the best counting passage), ``lcs``, ``cosine``, ``n_items``.

    Without a counting passage item_id is null, and lcs and cosine are those of the best candidate (0 without)."""
    items = benchmark.select(
        F.col(item_id).alias("id"), F.col(item_text).alias("text"),
        (F.col(answer) if answer else F.lit(None).cast("string")).alias("answer"),
    ).filter(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)
    # Items come to the driver shard by shard, to find their words; a shard is bounded by its passages.
    spaces, shard, n_passages, ids = [], [], 0, []
    for r in items.orderBy(F.asc_nulls_last("id"), "text").toLocalIterator():
        row = {"n": len(ids), "text": r["text"], "answer": r["answer"]}
        ids.append(r["id"])
        size = max(1, len(r["text"]) // (2 * WINDOW))
        if shard and n_passages + size > SHARD:
            spaces += _spaces(docs, text, _read(shard, answer is not None))
            shard, n_passages = [], 0
        shard.append(row)
        n_passages += size
    if shard:
        spaces += _spaces(docs, text, _read(shard, answer is not None))
    held = [docs.sparkSession.sparkContext.broadcast(s) for s in spaces]
    kind = benchmark.schema[item_id].dataType.simpleString()

    def run_one(b: pa.RecordBatch) -> list:
        found: list[list[tuple]] = [[] for _ in range(b.num_rows)]
        for lo, hi in words.slices(column(b, text)):
            h, first = _hashes(words.in_row_order(b, lo, hi, text))
            for s in held:
                for k, more in enumerate(_search(s.value, h, first)):
                    found[lo + k] += more
        best = [max(f, key=lambda x: (x[3], x[0], x[1], -x[2]), default=(0.0, 0.0, -1, False)) for f in found]
        return [
            pa.array([x[3] for x in best], pa.bool_()),
            pa.array([x[2] if x[3] else None for x in best], pa.int64()),
            pa.array([x[0] for x in best], pa.float64()),
            pa.array([x[1] for x in best], pa.float64()),
            pa.array([len({x[2] for x in f if x[3]}) for f in found], pa.int64()),
        ]

    docs = docs.drop(*[c for c in docs.columns if c in ("item_id", "contaminated", "lcs", "cosine", "n_items")])
    fields = "contaminated boolean, __item long, lcs double, cosine double, n_items long"
    out = with_columns(docs, fields, run_one, () if keep_text else (text,))
    names = docs.sparkSession.createDataFrame(list(enumerate(ids)), f"__item long, item_id {kind}")
    return out.join(F.broadcast(names), "__item", "left").drop("__item") if len(ids) <= 1_000_000 else out.join(
        names, "__item", "left"
    ).drop("__item")


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find(docs.select("doc_id", "text"), benchmark, keep_text=False)
