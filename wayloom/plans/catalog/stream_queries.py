"""Streams over the events file, drained with what is available."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayloom.plans.oracle import with_ctes
from wayloom.plans.registry import query
from wayloom.session import scratch_path
from wayloom.streaming import jobs


def stream(i):
    """Events as a stream of points on whole seconds. The pattern fits the table as one file and as a folder of
    part files; a plain path fits a stream only as a folder."""
    raw = (
        i.spark.readStream.schema(i.table("events").schema)
        .option("maxFilesPerTrigger", 100)
        .parquet(f"{i.sf_dir.rstrip('/')}/events.parque[t]")
    )
    return raw.withColumn("t", F.unix_timestamp("ts")).withColumn("ts", F.timestamp_seconds("t"))


@query(
    "stream_sessions",
    with_ctes(
        """SELECT user_id, min(t) AS start_t, max(t) AS end_t, count(*) AS n_points FROM (
 SELECT *, sum(CASE WHEN pt IS NULL OR t-pt>900 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS s FROM pseq) p
GROUP BY user_id, s HAVING max(t)+900<=(SELECT max(t)-600 FROM pings)"""
    ),
)
def stream_sessions(i):
    """Sessions that ended the gap and the lateness before the newest point, however late points come."""
    kept = jobs.StoredSessions(i.spark, scratch_path(i.spark, "stream-sessions"))
    kept.run(stream(i).select("user_id", "t")).awaitTermination()
    return kept.closed()


@query("stream_dedup", with_ctes("SELECT DISTINCT user_id, t FROM ev"))
def stream_dedup(i):
    """Every other event is sent twice; each counts once."""
    resent = stream(i).withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("event_id") % 2).cast("int"))))
    kept = jobs.StoredPoints(i.spark, scratch_path(i.spark, "stream-dedup"))
    kept.run(resent.select("user_id", "t", "event_id")).awaitTermination()
    return kept.points().select("user_id", "t")


@query("stream_user_state", with_ctes("SELECT user_id, count(*) AS n_points, max(t) AS last_t FROM ev GROUP BY 1"))
def stream_user_state(i):
    """T5: running totals per user."""
    return jobs.run_snapshot(jobs.user_totals(stream(i)), "stream-state")


@query(
    "stream_live_trips",
    with_ctes(
        """SELECT user_id, start_t, end_t, n_points, round(distance_m,3) AS distance_m FROM trips x
WHERE trip_no<(SELECT max(trip_no) FROM trip_pts p WHERE p.user_id=x.user_id)"""
    ),
)
def stream_live_trips(i):
    """Trips closed by later points, with the visit rule."""
    points = stream(i).selectExpr(
        "event_id", "user_id", "t",
        "-22.9e0 + CAST(((event_id*7919)%200) div 40 AS DOUBLE)*0.001e0 + CAST(event_id%10 AS DOUBLE)*0.00001e0 AS lat",
        "-43.2e0 + CAST(((event_id*7919)%200)%40 AS DOUBLE)*0.001e0 + CAST((event_id div 10)%10 AS DOUBLE)*0.00001e0 AS lon",
    )
    live = jobs.LiveTrips(i.spark, scratch_path(i.spark, "live-trips"))
    live.run(points).awaitTermination()
    return live.closed().select("user_id", "start_t", "end_t", "n_points", F.round("distance_m", 3).alias("distance_m"))


@query("stream_one_user", with_ctes("SELECT user_id, count(*) AS n_points, max(t) AS last_t FROM ev WHERE user_id=(SELECT min(user_id) FROM ev) GROUP BY 1"))
def stream_one_user(i):
    """The same running totals, on demand for the first user."""
    user = i.events().agg(F.min("user_id")).first()[0]
    return jobs.run_snapshot(jobs.user_totals(jobs.for_user(stream(i), user)), "stream-one-user")
