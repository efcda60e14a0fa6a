"""Stored routes of trips, and chosen trips matched again.

A store is a folder with a fixed number of buckets (trips by a hash of their id), a table of replies per run, and a manifest
per run that names the folder holding each bucket's newest rows. A run reads and writes only the buckets of its own
trips, into folders of its own, and writes its manifest last: readers see a run whole or not at all, and folders
that are being read are never changed. A run that broke off is simply run again under its id and replaces what it
left; one that is complete is not run again. Runs follow one another; a store has one writer.
"""

from __future__ import annotations

from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.config import MATCH, MatchConfig
from wayloom.functions import parse
from wayloom.operators import matching
from wayloom.session import file_names, materialize

ROUTE = ["osm_way_ids", "min_lon", "min_lat", "max_lon", "max_lat"]
STORED = (
    "trip_id string, processed boolean, notes string, osm_way_ids string, min_lon double, min_lat double, max_lon double, "
    "max_lat double, version bigint"
)
MANIFEST = "bucket int, version bigint, n_buckets int"
REPLIES = "trip_id string, outcome string"


class RouteStore:
    """Routes of processed trips below one folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 256):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def runs(self) -> dict[str, int]:
        """Versions of the complete runs by id."""
        names = [p.split("/")[-2] for p in file_names(self.spark, f"{self.root}/manifest/*/_SUCCESS")]
        return {unquote(n.split("-", 1)[1]): int(n.split("-", 1)[0]) for n in names}

    def _path(self, table: str, version: int, run_id: str) -> str:
        return f"{self.root}/{table}/{version:08d}-{quote(run_id, safe='')}"

    def _held(self) -> dict[int, int]:
        """The version of each bucket's newest rows: at most one entry per bucket."""
        runs = self.runs()
        if not runs:
            return {}
        last = max(runs, key=runs.get)
        rows = self.spark.read.schema(MANIFEST).parquet(self._path("manifest", runs[last], last)).collect()
        self.buckets = next((r["n_buckets"] for r in rows), self.buckets)  # as the store was begun
        return {r["bucket"]: r["version"] for r in rows}

    def _rows(self, held: dict[int, int]) -> DataFrame:
        by_version = {v: k for k, v in self.runs().items()}
        paths = [f"{self._path('routes', v, by_version[v])}/bucket={b}" for b, v in sorted(held.items())]
        reader = self.spark.read.schema(STORED)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], STORED)

    def read(self) -> DataFrame:
        """One row per stored trip; ``version`` is that of the run that processed it last."""
        return self._rows(self._held())

    def replies(self, run_id: str) -> DataFrame:
        return self.spark.read.schema(REPLIES).parquet(self._path("replies", self.runs()[run_id], run_id))

    def put(self, run_id: str, results: DataFrame, replies: DataFrame) -> None:
        """Store ``results`` (trip_id, match_status, notes and the columns of a route; one row per trip).

        A matched trip takes the new route and loses its note. One that could not be matched counts as processed, gets the note, and
        keeps the route it had, if any. All other trips stay as they are.
        """
        if run_id in self.runs():
            return
        held = self._held()
        version = max(self.runs().values(), default=0) + 1
        bucket = F.pmod(F.xxhash64("trip_id"), F.lit(self.buckets)).cast("int")
        new = materialize(results.select("trip_id", "match_status", "notes", *ROUTE).withColumn("bucket", bucket), "results")
        touched = {r["bucket"] for r in new.select("bucket").distinct().collect()}  # no more than there are buckets
        old = self._rows({b: v for b, v in held.items() if b in touched}).withColumn("bucket", bucket)
        n, o = new.alias("n"), old.alias("o")
        both = n.join(o, (F.col("n.trip_id") == F.col("o.trip_id")) & (F.col("n.bucket") == F.col("o.bucket")), "full")
        seen, ok = F.col("n.trip_id").isNotNull(), F.coalesce(F.col("n.match_status") == "matched", F.lit(False))
        merged = both.select(
            F.coalesce("n.trip_id", "o.trip_id").alias("trip_id"),
            F.when(seen, True).otherwise(F.col("o.processed")).alias("processed"),
            F.when(seen, F.col("n.notes")).otherwise(F.col("o.notes")).alias("notes"),
            *[F.when(ok, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in ROUTE],
            F.when(seen, F.lit(version)).otherwise(F.col("o.version")).cast("long").alias("version"),
            F.coalesce("n.bucket", "o.bucket").alias("bucket"),
        )
        spread = merged.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket")
        spread.parquet(self._path("routes", version, run_id))
        replies.select("trip_id", "outcome").write.mode("overwrite").parquet(self._path("replies", version, run_id))
        self._close(run_id, version, held | dict.fromkeys(touched, version))

    def _close(self, run_id: str, version: int, held: dict[int, int]) -> None:
        rows = [(b, v, self.buckets) for b, v in sorted(held.items())]
        made = self.spark.createDataFrame(rows, MANIFEST).coalesce(1)
        made.write.mode("overwrite").parquet(self._path("manifest", version, run_id))


def results(matched: matching.Matched, segs: DataFrame) -> DataFrame:
    """What is stored of each matched trip: outcome, note, way ids as text, and the box of its route."""
    lines = matching.route_lines(matched.routes, segs)
    ways = matching.route_ways(lines).select("trip_id", parse.way_ids_to_json(F.col("osm_way_ids")).alias("osm_way_ids"))
    return matched.status.join(ways, "trip_id", "left").join(matching.route_bbox(lines), "trip_id", "left")


def reprocess(store: RouteStore, run_id: str, chosen: DataFrame, points: DataFrame, net: matching.Network, cfg: MatchConfig = MATCH) -> DataFrame:
    """Match the trips of ``chosen`` (trip_id) again and store the outcome; one reply (trip_id, outcome) per trip.

    A trip without points is answered ``no_points`` and stays as it is stored. Only points of chosen trips are matched.
    """
    if run_id not in store.runs():
        asked = materialize(chosen.select("trip_id").filter("trip_id IS NOT NULL").distinct(), "chosen")
        matched = matching.match_trips(points.join(asked, "trip_id", "left_semi"), net, cfg)
        found = materialize(results(matched, net.segments), "rematched")
        replies = asked.join(found.select("trip_id", "match_status"), "trip_id", "left")
        store.put(run_id, found, replies.select("trip_id", F.coalesce("match_status", F.lit("no_points")).alias("outcome")))
    return store.replies(run_id)
