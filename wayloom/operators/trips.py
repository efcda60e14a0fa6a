"""Trips and visits from point histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.config import TRIPS, TripConfig
from wayloom.functions import geo
from wayloom.operators.sequence import assign_sessions, with_previous

POINT = ["t", "event_id", "lat", "lon"]


def _gap(prev: Column, cur: Column) -> Column:
    return F.abs(cur.t - prev.t)


def _step(prev: Column, cur: Column) -> Column:
    return geo.haversine(prev.lat, prev.lon, cur.lat, cur.lon)


def _is_visit(prev: Column, cur: Column, cfg: TripConfig) -> Column:
    return (_step(prev, cur) < cfg.visit_radius_m) & ((cur.t - prev.t) >= cfg.visit_seconds)


def trip_points(points: DataFrame, cfg: TripConfig = TRIPS) -> DataFrame:
    """Points with the trip they belong to.

    A trip ends where the time gap exceeds ``gap_seconds`` or the visit rule fires. Input has
    user_id, event_id, t (epoch seconds), lat, lon. Adds gap_s and step_m (NULL at a trip
    start), trip_start_t and trip_start_id, which name the trip together with user_id.
    """
    cut = assign_sessions(
        points.select("user_id", *POINT),
        key="user_id",
        time_col="t",
        order=["t", "event_id"],
        carry=POINT,
        is_break=lambda p, c: (_gap(p, c) > cfg.gap_seconds) | _is_visit(p, c, cfg),
        slice_seconds=cfg.slice_seconds,
    )
    inside = ~F.col("is_start")
    return cut.select(
        "user_id",
        *POINT,
        F.when(inside, _gap(F.col("prev"), F.struct("t"))).alias("gap_s"),
        F.when(inside, _step(F.col("prev"), F.struct("lat", "lon"))).alias("step_m"),
        F.col("session_start.t").alias("trip_start_t"),
        F.col("session_start.event_id").alias("trip_start_id"),
    )


def trip_id(user: Column, start: Column, end: Column) -> Column:
    """Deterministic id, so that a rerun writes the same trip."""
    return F.sha2(
        F.concat_ws("|", user.cast("string"), start.cast("string"), end.cast("string")), 256
    )


TRIP_KEY = ["user_id", "trip_start_t", "trip_start_id"]


def trips(points_in_trips: DataFrame, cfg: TripConfig = TRIPS) -> DataFrame:
    """One row per trip of at least ``min_points`` points: times, count, distance, box."""
    m = cfg.bbox_margin_deg
    return (
        points_in_trips.groupBy(*TRIP_KEY)
        .agg(
            F.min("t").alias("start_t"),
            F.max("t").alias("end_t"),
            F.count(F.lit(1)).alias("n_points"),
            F.coalesce(F.sum("step_m"), F.lit(0.0)).alias("distance_m"),
            (F.min("lon") - F.lit(m)).alias("min_lon"),
            (F.min("lat") - F.lit(m)).alias("min_lat"),
            (F.max("lon") + F.lit(m)).alias("max_lon"),
            (F.max("lat") + F.lit(m)).alias("max_lat"),
        )
        .filter(F.col("n_points") >= cfg.min_points)
        .withColumn("trip_id", trip_id(F.col("user_id"), F.col("start_t"), F.col("end_t")))
    )


def numbered_trip_points(points_in_trips: DataFrame, cfg: TripConfig = TRIPS) -> DataFrame:
    """Points of kept trips with trip_id and a 0-based point_idx inside the trip."""
    from wayloom.operators.sequence import running_total

    kept = trips(points_in_trips, cfg).select(*TRIP_KEY, "trip_id", "n_points")
    joined = points_in_trips.join(kept, TRIP_KEY)
    numbered = running_total(
        joined, "trip_id", "t", ["t", "event_id"], {"_pos": F.lit(1)}, cfg.slice_seconds
    )
    return numbered.withColumn("point_idx", (F.col("_pos") - 1).cast("long")).drop("_pos")


def trip_lines(numbered: DataFrame, points_per_part: int = 1000) -> DataFrame:
    """Trip geometry as ordered parts of at most ``points_per_part`` points, so that no row
    grows with the trip. A trip of usual size is one part; parts concatenate in order."""
    part = F.floor(F.col("point_idx") / points_per_part).cast("long")
    return (
        numbered.withColumn("part", part)
        .groupBy("trip_id", "user_id", "trip_start_t", "part")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("point_idx", F.col("lon").alias("x"), F.col("lat").alias("y")))
            ).alias("points")
        )
    )


def trip_upsert(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Snapshot after an upsert: a new row wins, its NULL columns keep the old value."""
    data = [c for c in existing.columns if c not in key]
    n, o = incoming.alias("n"), existing.alias("o")
    on = [F.col(f"n.{k}") == F.col(f"o.{k}") for k in key]
    return n.join(o, on, "full_outer").select(
        *[F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}")).alias(k) for k in key],
        *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in data],
    )


def new_trips(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Trips whose (user, start, end) is not stored yet."""
    return found.join(stored, ["user_id", "start_t", "end_t"], "left_anti")


def visits_exact(points: DataFrame, cfg: TripConfig = TRIPS) -> DataFrame:
    """Visits by the literal rule: next point closer than the radius after at least the visit
    time, unless the gap already ended the trip."""
    seq = with_previous(
        points.select("user_id", *POINT), "user_id", "t", ["t", "event_id"], POINT, cfg.slice_seconds
    )
    prev, cur = F.col("prev"), F.struct(*POINT)
    return seq.filter(
        prev.isNotNull() & _is_visit(prev, cur, cfg) & (_gap(prev, cur) <= cfg.gap_seconds)
    ).select(
        "user_id",
        F.col("prev.t").alias("arrival_t"),
        F.col("t").alias("departure_t"),
        F.col("prev.lat").alias("lat"),
        F.col("prev.lon").alias("lon"),
        F.lit(cfg.visit_accuracy_m).alias("accuracy_m"),
    )


def new_visits(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Visits whose (user, arrival, departure) is not stored yet."""
    return found.join(stored, ["user_id", "arrival_t", "departure_t"], "left_anti")


def continuity(batches: DataFrame, points: DataFrame, found_trips: DataFrame, cfg: TripConfig = TRIPS) -> DataFrame:
    """Per user: does the latest point of the latest processed batch continue the latest trip?"""
    last_batch = (
        batches.filter(F.coalesce(F.col("processed"), F.lit(False)))
        .groupBy("user_id")
        .agg(F.max_by("batch_id", F.struct("batch_t", "batch_id")).alias("batch_id"))
    )
    last_point = (
        points.join(last_batch, ["user_id", "batch_id"])
        .groupBy("user_id", "batch_id")
        .agg(F.max("t").alias("last_point_t"))
    )
    last_trip = found_trips.groupBy("user_id").agg(F.max("end_t").alias("last_trip_end_t"))
    return last_point.join(last_trip, "user_id").select(
        "user_id",
        "batch_id",
        "last_point_t",
        "last_trip_end_t",
        (F.abs(F.col("last_point_t") - F.col("last_trip_end_t")) < cfg.gap_seconds).alias("ongoing"),
    )
