"""Embedding near-dedup by spherical k-means cells and blocked cosine products.

Equal vectors are one class, compared once and weighted by their number. Centres are fitted on a bounded
sample (``SAMPLE`` vectors by hash of the id, at most ``MAX_CELLS`` centres); every vector is
assigned. A vector lives in the cell of its nearest centre and is a guest in each later cell whose
centre is nearly as near, so that pairs across a border meet, and meet once. Two linked vectors are at most
``APART`` apart, so their cosines to two centres a, b differ by at most ``APART`` * |a - b| in all. That bound is
taken as it is where the sample fills few dimensions; where it fills many, the part of the difference that lies
along a - b is ``SIGMAS`` standard deviations at most, one being 1 / sqrt(dimensions). A cell's rows are dealt into blocks of about ``ROWS``; pairs of blocks are compared as double
precision matrix products side by side, so a crowded cell is many tasks. A block pair gives back the
number of links of each vector and one edge per vector of its groups, never the pairs. Groups are joined
into components, whose smallest vector is kept.

A link has a cosine of ``COSINE`` or more; none below is ever made. Pairs whose difference lies further along the
line between their centres can be missed; the tests measure recall against brute force.

Results in special cases: null, empty and zero vectors, and those with null or non-finite
components, have no links and stay; vectors of different lengths never link; rows with a null id have
no links, no component and stay; repeated rows are vectors of their own, linked by being equal; an
empty table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm.arrow import column
from wayloom.llm.components import components
from wayloom.session import materialize

COSINE = 0.95
SAMPLE = 16_384
MAX_CELLS = 1024
CELL = 512
APART = (2 - 2 * COSINE) ** 0.5
SIGMAS = 2.0
ROWS = 1024
TURNS = 8


def _matrix(vectors: pa.Array) -> np.ndarray:
    n = len(vectors)
    return np.asarray(vectors.flatten(), np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keyed(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """Rows id, key (equal for equal vectors; null if the vector links with nothing), dim, x."""
    x = F.col(embedding).cast("array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = []
            for v in column(b, "x"):
                a = np.array(v.as_py() or [], object)
                good = len(a) > 0 and all(e is not None for e in a)
                a = a.astype(np.float64) + 0.0 if good else np.zeros(0)
                good = good and bool(np.isfinite(a).all()) and bool(a.any())
                keys.append(hashlib.blake2b(a.tobytes(), digest_size=16).digest() if good else None)
            known = pa.array([k if i is not None else None for k, i in zip(keys, column(b, "id").to_pylist())], pa.binary())
            yield pa.RecordBatch.from_arrays([column(b, "id"), known, column(b, "x")], names=["id", "key", "x"])

    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), x.alias("x"))
    return rows.mapInArrow(run, "id long, key binary, x array<double>")


def fit_centres(sample: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means on a sample: unit vectors, each moved to the mean direction of its own."""
    rng = np.random.default_rng(11)
    centres = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(TURNS):
        own = (sample @ centres.T).argmax(axis=1)
        order = np.argsort(own, kind="stable")
        begin = np.searchsorted(own[order], np.arange(k))
        sums = np.zeros_like(centres)
        some = np.flatnonzero(np.diff(np.append(begin, len(own))))
        sums[some] = np.add.reduceat(sample[order], begin[some])
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), centres)
    return centres


def margins(sample: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For each pair of centres how far the cosine of a guest may lie below that of its own centre."""
    spread = np.square(np.linalg.svd(sample - sample.mean(axis=0), compute_uv=False))
    filled = spread.sum() ** 2 / max(np.square(spread).sum(), 1e-300)  # number of dimensions, by participation
    apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))
    return APART * min(1.0, SIGMAS / max(filled, 1.0) ** 0.5) * apart + 1e-9


def _assigned(reps: DataFrame, centres: dict[int, np.ndarray], margin: dict[int, np.ndarray]) -> DataFrame:
    """Rows cell, home, id, n, x: each vector in its own cell and as a guest in later ones."""
    offset, at = {}, 0
    for dim, c in centres.items():
        offset[dim], at = at, at + len(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            dims = np.array([len(v) for v in column(whole, "x")])
            for dim in np.unique(dims):
                b = whole.filter(pa.array(dims == dim))
                cosine = _unit(_matrix(column(b, "x"))) @ centres[int(dim)].T
                home = cosine.argmax(axis=1)
                near = cosine >= cosine.max(axis=1, keepdims=True) - margin[int(dim)][home]
                near &= np.arange(cosine.shape[1])[None, :] >= home[:, None]
                row, cell = np.nonzero(near)
                took = b.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(cell + offset[int(dim)], pa.int64()), pa.array(cell == home[row]),
                        column(took, "id"), column(took, "n"), column(took, "x"),
                    ],
                    names=["cell", "home", "id", "n", "x"],
                )

    return reps.select("id", "n", "x").mapInArrow(run, "cell long, home boolean, id long, n long, x array<double>")


def _compare(group: pa.Table) -> pa.Table:
    """Links within a pair of blocks: by vector the number (weighted) and the smallest id of its group."""
    group = group.combine_chunks()
    ids, weight = (group.column(c).to_numpy() for c in ("id", "n"))
    x = _unit(_matrix(group.column("x").combine_chunks()))
    left = group.column("left").to_numpy(zero_copy_only=False)
    if group.column("same")[0].as_py():
        a, b = np.arange(len(ids)), np.arange(len(ids))
    else:
        a, b = np.flatnonzero(left), np.flatnonzero(~left)
    links = x[a] @ x[b].T >= COSINE
    if len(a) == len(ids):
        np.fill_diagonal(links, False)
    p, q = np.nonzero(links)
    p, q = a[p], b[q]
    total = np.zeros(len(ids), np.int64)
    np.add.at(total, p, weight[q])
    if len(a) < len(ids):
        np.add.at(total, q, weight[p])
    root = ids.copy()
    while len(p):
        before = root.copy()
        np.minimum.at(root, p, root[q])
        np.minimum.at(root, q, root[p])
        if np.array_equal(before, root):
            break
    some = total > 0
    return pa.table({"id": ids[some], "links": total[some], "root": root[some]})


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per vector: its id, ``n_links``, ``component_id`` and ``kept``."""
    spark = vectors.sparkSession
    keyed = materialize(_keyed(vectors, vec_id, embedding), "vectors")
    reps = materialize(
        keyed.filter("key is not null").groupBy("key").agg(
            F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("x").alias("x")
        ),
        "classes",
    )
    sizes = {r["dim"]: r["n"] for r in reps.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return keyed.select(
            F.col("id").alias(vec_id), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"),
            F.lit(True).alias("kept"),
        )
    centres, margin = {}, {}
    for dim, n in sorted(sizes.items()):
        rows = reps.filter(F.size("x") == dim).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("x").collect()
        sample = _unit(np.array([r["x"] for r in rows]))
        centres[dim] = fit_centres(sample, max(1, min(len(sample), MAX_CELLS, -(-n // CELL))))
        margin[dim] = margins(sample, centres[dim])
    cells = materialize(_assigned(reps, centres, margin), "cells")
    count = cells.groupBy("cell").agg(
        F.count_if("home").alias("n_home"), F.count_if(~F.col("home")).alias("n_guest")
    )  # at most MAX_CELLS rows for each length of vectors
    blocks = lambda c: F.ceil(F.col(c) / ROWS).cast("int")
    rows = cells.join(F.broadcast(count.select("cell", blocks("n_home").alias("nh"), blocks("n_guest").alias("ng"))), "cell")
    own = F.when(F.col("home"), F.pmod(F.xxhash64("id"), "nh")).otherwise(F.pmod(F.xxhash64("id"), F.greatest("ng", F.lit(1))))
    rows = rows.withColumn("own", own.cast("int"))

    def unit(guest, i, j, left):
        return F.struct(
            F.lit(guest).alias("guest"), i.cast("int").alias("i"), j.cast("int").alias("j"), left.alias("left")
        )

    all_of = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    own_ = F.col("own")
    home_units = F.concat(
        F.transform(all_of("nh"), lambda j: unit(False, F.least(own_, j), F.greatest(own_, j), own_ <= j)),
        F.transform(all_of("ng"), lambda j: unit(True, own_, j, F.lit(True))),
    )
    guest_units = F.transform(all_of("nh"), lambda i: unit(True, i, own_, F.lit(False)))
    rows = rows.withColumn("u", F.explode(F.when(F.col("home"), home_units).otherwise(guest_units)))
    rows = rows.select("cell", "id", "n", "x", "u.*", (~F.col("u.guest") & (F.col("u.i") == F.col("u.j"))).alias("same"))
    found = materialize(
        rows.groupBy("cell", "guest", "i", "j").applyInArrow(_compare, "id long, links long, root long"), "links"
    )
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    classes = (
        reps.select("key", "id", "n").join(links, "id", "left").join(groups.withColumnRenamed("v", "id"), "id", "left")
        .select(
            "key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
    )
    out = keyed.select("id", "key").join(classes, "key", "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def query(vectors: DataFrame) -> DataFrame:
    return near_duplicates(vectors)
