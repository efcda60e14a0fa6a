"""Connected components by alternating star steps, and semi-joins on id sets of checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.session import materialize

#: Up to so many ids (8 bytes each) a set of ids is broadcast; beyond, rows are shuffled by id.
BROADCAST_IDS = 1_000_000


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """``edges`` (a, b: long) to rows v, component: the smallest vertex that v is connected to.

    Each round points every larger neighbour, then every smaller one, at the smallest neighbour. Minima
    are formed on the map side first and neighbours find them by a join, so a vertex with very
    many neighbours never gathers in a task. Every round is written to the shared folder; paths shorten
    by half or more, so a few rounds are enough. Loops and repeated edges don't matter."""
    kept = ["a", "b"]
    pairs = edges.filter("a <> b").select(F.greatest(*kept).alias("a"), F.least(*kept).alias("b")).distinct()
    pairs = materialize(pairs, "edges")
    seen = None
    for _ in range(rounds):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
        pairs = materialize(small.filter("a <> b").distinct(), "small-star")
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20)"))).first()
        if now == seen:
            roots = pairs.select(F.col("b").alias("v")).distinct().withColumn("component", F.col("v"))
            return pairs.select(F.col("a").alias("v"), F.col("b").alias("component")).unionByName(roots)
        seen = now
    raise RuntimeError(f"components are not found after {rounds} rounds")


def only(rows: DataFrame, key: str, ids: DataFrame, name: str = "v") -> DataFrame:
    """Rows whose ``key`` is among the distinct ``ids``."""
    ids = ids.select(F.col(name).alias("__only"))
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return rows.join(ids, F.col(key) == F.col("__only"), "left_semi")
