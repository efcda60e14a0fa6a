"""Quality classifier by hierarchical empirical Bayes.

Three levels share strength. (1) A logistic model on the shape of the text (share of letters, signs,
capitals, repeated words and lines, word length and the like) gives each document a log-likelihood
ratio; it is fitted on a bounded sample of labelled rows (``MAX_PER_CLASS`` for each label, by hash of
the id). (2) For all documents, soft counts of good ones are summed by path and by host; a known label
counts instead of the model. (3) Host rates are shrunk toward the global rate and path rates toward
their host, with prior strengths found by the method of moments, so a sparse site hardly differs from
the prior. A document's own count is taken out of its site's before the site speaks about it.

Results in special cases: null and empty texts have the shape of an empty text; null hosts and paths are
sites of their own; a null label counts as none; without labels of both kinds the evidence is 0 and
all scores are near the global rate 0.5; repeated rows count as documents of their own; an empty table
gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm import words
from wayloom.llm.arrow import column, with_columns
from wayloom.operators.skew import salted_join
from wayloom.session import materialize

MAX_PER_CLASS = 4000
N_SHAPES = 16
_CLASS = np.zeros(256, np.int64)  # 0 sign, 1 letter, 2 digit, 3 capital, 4 blank, 5 line end, 6 beyond ASCII
for _lo, _hi, _k in ((97, 123, 1), (48, 58, 2), (65, 91, 3), (9, 14, 4), (32, 33, 4), (10, 11, 5), (128, 256, 6)):
    _CLASS[_lo:_hi] = _k
_COMMON = np.zeros(256, bool)  # signs of ordinary prose
_COMMON[[ord(c) for c in ".,;:!?'\"()-"]] = True


def _repeated(values: np.ndarray) -> tuple[float, float]:
    """Share of values seen before, and share of the most common one."""
    if not len(values):
        return 0.0, 0.0
    counts = np.unique(values, return_counts=True)[1]
    return 1 - len(counts) / len(values), counts.max() / len(values)


def shapes(texts: pa.Array) -> np.ndarray:
    """Row by row the numbers the classifier sees."""
    w = words.split(texts)
    h = words.hashes(w.data, w.start, w.end)
    out = np.zeros((len(texts), N_SHAPES))
    for i in range(len(texts)):
        data = w.data[w.offsets[i] : w.offsets[i + 1]]
        own = h[w.first[i] : w.first[i + 1]]
        n, nw = max(len(data), 1), max(len(own), 1)
        share = np.bincount(_CLASS[data], minlength=7) / n
        odd = np.count_nonzero(~_COMMON[data] & (_CLASS[data] == 0)) / n
        cut = np.flatnonzero(data == 10)
        cut = np.concatenate([[-1], cut, [len(data)]])
        length = np.diff(cut) - 1
        some = length > 0  # blank lines part paragraphs; they don't count as repeated lines
        line_hash = words.hashes(data, cut[:-1][some] + 1, cut[1:][some])
        again, top = _repeated(own)
        pairs, _ = _repeated(words.grams(own, 2))
        first = data[np.maximum(w.start[w.first[i] : w.first[i + 1]] - w.offsets[i], 0)]
        out[i] = [
            *share, odd, again, top, pairs, _repeated(line_hash)[0],
            np.log1p(len(own)), (w.end - w.start)[w.first[i] : w.first[i + 1]].sum() / nw / 10,
            np.count_nonzero(length < 20) / len(length), np.count_nonzero(_CLASS[first] == 3) / nw,
        ]
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights by Newton steps with a small penalty, on standardized numbers and their squares."""
    x = np.hstack([x, x * x])
    mean, scale = x.mean(0), x.std(0) + 1e-6
    a = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hess = (a * (balance * p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(len(w))
        step = np.linalg.solve(hess, a.T @ (balance * (y - p)) - 0.1 * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w, mean, scale


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality"):
    """The text model, from at most ``MAX_PER_CLASS`` labelled rows of each kind; None without both kinds."""
    rows = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    rows = rows.select(F.col(doc_id).alias("__id"), (F.col(label) > 0).cast("int").alias("__y")).distinct()
    by = [F.xxhash64("__id"), "__id"]
    sample = rows.filter("__y = 1").orderBy(*by).limit(MAX_PER_CLASS)
    sample = sample.unionByName(rows.filter("__y = 0").orderBy(*by).limit(MAX_PER_CLASS))
    texts = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).join(F.broadcast(sample), "__id")
    found = with_columns(texts.select("__y", "text"), "x array<double>", _shape_column, drop=("text",)).collect()
    y = np.array([r["__y"] for r in found], float)
    if not 0 < y.sum() < len(y):
        return None
    return _logistic(np.array([r["x"] for r in found]), y)


def _shape_column(b: pa.RecordBatch) -> list:
    texts = column(b, "text")
    rows = [r for lo, hi in words.slices(texts) for r in shapes(texts.slice(lo, hi - lo)).tolist()]
    return [pa.array(rows, pa.list_(pa.float64()))]


def evidence(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """``docs`` without the text, plus ``evidence``: the log-likelihood ratio of good against bad."""

    def run(b: pa.RecordBatch) -> list:
        texts = column(b, text)
        parts = []
        for lo, hi in words.slices(texts):
            if model is None:
                parts.append(np.zeros(hi - lo))
                continue
            w, mean, scale = model
            x = shapes(texts.slice(lo, hi - lo))
            x = (np.hstack([x, x * x]) - mean) / scale
            parts.append(np.clip(x @ w[:-1] + w[-1], -8, 8))
        return [pa.array(np.concatenate(parts) if parts else np.zeros(0))]

    return with_columns(docs, "evidence double", run, drop=(text,))


def _logit(p):
    return F.log(p / (1 - p))


def _strength(rates: DataFrame, prior) -> float:
    """Prior strength by the method of moments: how many documents the prior is worth.

    ``rates`` has k (soft good ones) and n; ``prior`` is the rate each is shrunk to."""
    spread = (F.col("k") / F.col("n") - prior) ** 2
    noise = prior * (1 - prior) / F.col("n")
    got = rates.agg(
        F.sum(F.col("n") * (spread - noise)).alias("between"),
        F.sum(F.col("n") * prior * (1 - prior)).alias("total"),
    ).first()
    if not got["total"] or got["between"] is None:
        return 1e4
    ratio = max(got["between"] / got["total"], 1e-4)  # share of the variance between sites
    return float(min(max(1 / ratio - 1, 1.0), 1e4))


def judge(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
    path: str = "lang", label: str = "quality", threshold: float = 0.5,
) -> DataFrame:
    """One row per document: its id, ``evidence``, ``host_rate``, ``path_rate``, ``score`` and ``keep``.

    Only numbers are shuffled, never texts. Sums by path and host are formed on the map side first; rows
    find their site again by a join that spreads hot sites.
    """
    model = fit(docs, labels, doc_id, text, label)
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    rows = docs.select(
        F.col(doc_id).alias("id"), F.col(text).alias("text"), name(host).alias("host"), name(path).alias("path")
    )
    known = labels.filter(F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(
        F.max((F.col(label) > 0).cast("double")).alias("known")
    )
    ratio = 1 / (1 + F.exp(-F.col("evidence")))
    soft = materialize(
        evidence(rows, model).join(known, "id", "left").withColumn("q", F.coalesce("known", ratio)), "quality"
    )
    paths = materialize(
        soft.groupBy("host", "path").agg(F.sum("q").alias("k"), F.count(F.lit(1)).cast("double").alias("n")), "paths"
    )
    hosts = paths.groupBy("host").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    total = hosts.agg(F.sum("k"), F.sum("n")).first()
    rate = min(max((total[0] + 1) / (total[1] + 2), 1e-3), 1 - 1e-3) if total[1] else 0.5
    s_host = _strength(hosts, F.lit(rate))
    sites = paths.join(hosts.select("host", F.col("k").alias("kh"), F.col("n").alias("nh")), "host")
    prior = (F.col("kh") + s_host * rate) / (F.col("nh") + s_host)
    s_path = _strength(sites, prior)
    q = F.col("q")
    host_rate = (F.col("kh") - q + s_host * rate) / (F.col("nh") - 1 + s_host)
    path_rate = (F.col("k") - q + s_path * F.col("host_rate")) / (F.col("n") - 1 + s_path)
    out = (
        salted_join(soft, sites, ["host", "path"], ["id", "evidence"])
        .withColumn("host_rate", F.least(F.greatest(host_rate, F.lit(1e-6)), F.lit(1 - 1e-6)))
        .withColumn("path_rate", F.least(F.greatest(path_rate, F.lit(1e-6)), F.lit(1 - 1e-6)))
        .withColumn("score", 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.col("path_rate"))))))
    )
    return out.select(
        F.col("id").alias(doc_id), "evidence", "host_rate", "path_rate", "score",
        (F.col("score") >= threshold).alias("keep"),
    )


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from the labelled rows outside the held-out fifth; site is ``source``, path is ``lang``."""
    from wayloom.llm.toxicity import in_held_out

    out = judge(docs, labels.filter(~in_held_out("doc_id")))
    return out.withColumn("held_out", in_held_out("doc_id"))
