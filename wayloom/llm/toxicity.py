"""Toxicity by multiple-instance learning.

A document is a bag of sentences (split at ``. ! ?`` and line ends). A sentence's score is the logistic
of its weights; the document's is the noisy-or of its sentences, 1 - prod(1 - p). Only document labels
are known, and weights are learned through the noisy-or; afterwards the sentence scores say where a
document offends.

Features of a sentence are its words in lower case and their beginnings of 4, 5 and 6 bytes, hashed.
Those that speak for the label on a bounded sample of labelled rows (``MAX_POSITIVE``,
``MAX_NEGATIVE``, taken by hash of the id) are candidates; the ``MAX_FEATURES`` with the most evidence are learned from.
Evidence is the deviance of a feature's counts from the label's share. No feature is left out for few
occurrences; a weight is drawn to 0 the more, the further its evidence lies below what the best of so many
features would show by chance (2 ln of their number). Every document is scored over its whole text.

With very few positive labels (one or two) all evidence is below that mark: weights stay small and
scores near those of clean texts, still ordered by evidence.

Results in special cases: a null or empty text, and a table without positive labels, score the value
of a document without sentences, 0.0; a null label counts as none; repeated rows are scored alike;
a null id is never learned from; an empty table gives an empty table. Columns named like an output
column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm import words
from wayloom.llm.arrow import column, lean, with_columns
from wayloom.session import materialize

MAX_POSITIVE = 4000
MAX_NEGATIVE = 8000
MAX_FEATURES = 4096
#: Penalty of a weight whose evidence is at the mark; below it grows with the power ``FALL`` of the shortfall.
PENALTY = 1e-5
FALL = 4
STEPS = 1000
#: A sentence without evidence is at most this likely to offend (in log-odds).
MAX_BIAS = -4.0
PREFIXES = (4, 5, 6)
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


class Model(NamedTuple):
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float


class _Bags(NamedTuple):
    doc: np.ndarray  # of each feature found: the row
    sentence: np.ndarray  # and the sentence, numbered over the slice
    feature: np.ndarray  # and the hash
    text: tuple[np.ndarray, np.ndarray, np.ndarray]  # bytes, first and last byte of each sentence


def _bags(texts: pa.Array, known: np.ndarray | None = None) -> _Bags:
    """Features of all sentences; only those in ``known``, if given."""
    low, offsets, start, end, first = words.split(texts, lower=True, letters=True)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    stops = np.cumsum(_STOP[low], dtype=np.int64)[start] if len(start) else start
    new = np.ones(len(start), bool)
    new[1:] = (stops[1:] != stops[:-1]) | (doc[1:] != doc[:-1])
    sentence = np.cumsum(new) - 1
    last = np.flatnonzero(np.append(new[1:], True)) if len(start) else start
    spans = (words.split_bytes(texts), start[new], end[last])
    found = []
    lookup = None
    if known is not None:
        lookup = np.zeros(1 << 20, bool)
        lookup[known >> np.uint64(44)] = True
    for n in (None, *PREFIXES):
        at = np.arange(len(start)) if n is None else np.flatnonzero(end - start > n)
        h = words.hashes(low, start[at], end[at] if n is None else start[at] + n)
        h = h if n is None else h + np.uint64(n)
        if lookup is not None:
            hit = lookup[h >> np.uint64(44)]
            at, h = at[hit], h[hit]
            hit = np.isin(h, known)
            at, h = at[hit], h[hit]
        found.append((at, h))
    at = np.concatenate([a for a, _ in found])
    return _Bags(doc[at], sentence[at], np.concatenate([h for _, h in found]), spans)


def _sample(labels: DataFrame, doc_id: str, label: str, held_out_fold: bool) -> DataFrame:
    rows = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    if held_out_fold:
        rows = rows.filter(~in_held_out(doc_id))
    rows = rows.select(F.col(doc_id).alias("__id"), (F.col(label) > 0).cast("int").alias("__y")).distinct()
    by = [F.xxhash64("__id"), "__id"]
    positive = rows.filter("__y = 1").orderBy(*by).limit(MAX_POSITIVE)
    return positive.unionByName(rows.filter("__y = 0").orderBy(*by).limit(MAX_NEGATIVE))


def in_held_out(doc_id: str):
    """The fifth of the ids that is never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    held_out_fold: bool = True,
) -> Model:
    """Learn from the bounded sample. Feature counts are summed in Spark; the driver gets the chosen
    features (at most ``MAX_FEATURES``) and where they occur in the sample."""
    sample = _sample(labels, doc_id, label, held_out_fold)
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).join(F.broadcast(sample), "__id")
    rows = materialize(rows.select("__y", "text"), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = column(b, "__y").to_numpy()
            for lo, hi in words.slices(column(b, "text")):
                bags = _bags(words.in_row_order(b, lo, hi, "text"))
                pair = np.unique(np.stack([bags.feature, bags.doc.astype(np.uint64)]), axis=1)
                f, n = np.unique(pair[0], return_counts=True)
                pos = np.bincount(np.searchsorted(f, pair[0]), y[lo:hi][pair[1].astype(np.int64)], len(f))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(f.view(np.int64)), pa.array(pos.astype(np.int64)), pa.array(n.astype(np.int64))],
                    names=["f", "pos", "n"],
                )

    total = {r["__y"]: r["n"] for r in rows.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = total.get(1, 0), total.get(0, 0)
    if not n1:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -20.0)
    counts = rows.mapInArrow(lean(count), "f long, pos long, n long").groupBy("f").agg(
        F.sum("pos").alias("pos"), F.sum("n").alias("n")
    )
    counts = materialize(counts, "features")
    p, q, all_p = F.col("pos").cast("double"), (F.col("n") - F.col("pos")).cast("double"), n1 / (n1 + n0)

    def part(seen, share):
        return F.when(seen > 0, seen * F.log(seen / share)).otherwise(0.0)

    n = F.col("n").cast("double")
    rest = F.lit(float(n1 + n0)) - n
    deviance = 2 * (
        part(p, n * all_p) + part(q, n * (1 - all_p)) + part(n1 - p, rest * all_p) + part(n0 - q, rest * (1 - all_p))
    )
    chosen = (
        counts.filter(p > n * all_p).select("f", deviance.alias("s"))
        .orderBy(F.desc("s"), "f").limit(MAX_FEATURES).collect()
    )
    mark = 2 * np.log(max(counts.count(), 2))
    chosen.sort(key=lambda r: np.uint64(r["f"] & 0xFFFFFFFFFFFFFFFF))
    evidence = np.maximum(np.array([r["s"] for r in chosen]), 1e-3)
    penalty = PENALTY * np.minimum((mark / evidence) ** FALL, 1e4)
    known = np.sort(np.array([r["f"] for r in chosen], np.int64).view(np.uint64))

    def gather(b: pa.RecordBatch) -> list:
        out = []
        for lo, hi in words.slices(column(b, "text")):
            bags = _bags(words.in_row_order(b, lo, hi, "text"), known)
            f = np.searchsorted(known, bags.feature)
            order = np.argsort(bags.doc, kind="stable")
            cut = np.searchsorted(bags.doc[order], np.arange(hi - lo + 1))
            for i in range(hi - lo):
                o = order[cut[i] : cut[i + 1]]
                out.append((bags.sentence[o].astype(np.int32).tobytes(), f[o].astype(np.int32).tobytes()))
        columns = zip(*out, strict=True) if out else ([], [])
        return [pa.array(list(x), pa.binary()) for x in columns]

    found = with_columns(rows, "s binary, f binary", gather, drop=("text",)).toArrow()
    return _learn(known, found, penalty)


def _learn(known: np.ndarray, found: pa.Table, penalty: np.ndarray) -> Model:
    """Gradient ascent (Adam) on the likelihood of the noisy-or, with a penalty on each weight."""
    y = found["__y"].to_numpy().astype(float)
    of_row = [np.frombuffer(x.as_py(), np.int32) for x in found["s"]]
    feats = np.concatenate([np.frombuffer(x.as_py(), np.int32) for x in found["f"]])
    row = np.repeat(np.arange(len(y)), [len(x) for x in of_row])
    key, sentence = np.unique((row << 32) | np.concatenate(of_row), return_inverse=True)
    bag = key >> 32
    d = len(known)
    theta = np.zeros(d + 1)
    theta[d] = MAX_BIAS
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    for t in range(1, STEPS + 1):
        w, b = theta[:d], theta[d]
        z = np.bincount(sentence, w[feats], len(bag)) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        # log of the chance that no sentence offends
        quiet = np.bincount(bag, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y))
        loud = -np.expm1(quiet)
        pull = weight * np.where(y > 0, np.exp(quiet) / np.maximum(loud, 1e-9), -1.0)
        gz = pull[bag] * p  # d(-quiet)/dz is p
        g = np.append(np.bincount(feats, gz[sentence], d), gz.sum()) / len(y)
        g[:d] -= penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        theta[d] = min(theta[d], MAX_BIAS)  # a sentence without evidence stays harmless in long documents
    return Model(known, theta[:d], float(theta[d]))


def score(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``score``, ``predicted`` and ``offending`` (sentences that score 0.5 or more). No shuffle."""
    known, weights, bias = model

    def run(b: pa.RecordBatch) -> list:
        scores, offending = [], []
        for lo, hi in words.slices(column(b, text)):
            bags = _bags(words.in_row_order(b, lo, hi, text), known)
            data, first, last = bags.text
            s, at = np.unique(bags.sentence, return_index=True)
            z = np.bincount(np.searchsorted(s, bags.sentence), weights[np.searchsorted(known, bags.feature)], len(s)) + bias
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            doc = bags.doc[at]
            # Sentences without evidence add nothing: else length alone would decide.
            quiet = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), hi - lo)
            scores.append(np.abs(np.expm1(quiet)))
            bad: list[list[str]] = [[] for _ in range(hi - lo)]
            for k in np.flatnonzero(p >= 0.5):
                bad[doc[k]].append(data[first[s[k]] : last[s[k]]].tobytes().decode("utf-8", "replace"))
            offending += bad
        all_scores = np.concatenate(scores) if scores else np.zeros(0)
        return [
            pa.array(all_scores, pa.float64()),
            pa.array((all_scores >= 0.5).astype(np.int32)),
            pa.array(offending, pa.list_(pa.string())),
        ]

    return with_columns(docs, "score double, predicted int, offending array<string>", run, () if keep_text else (text,))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)
    rows = score(docs.select("doc_id", "text"), model, keep_text=False)
    return rows.select(
        "doc_id", in_held_out("doc_id").alias("held_out"), "score", "predicted",
        F.size("offending").alias("n_offending"),
    )
