"""Trips, visits and movement."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from wayloom.config import TRIPS
from wayloom.functions import geo
from wayloom.operators import movement, trips
from wayloom.plans.oracle import hav, with_ctes
from wayloom.plans.registry import query

TRIP_COLS = "user_id, start_t, end_t, n_points, round(distance_m,3) AS distance_m"
SIX_HOURS = replace(TRIPS, gap_seconds=6 * 3600)


def summary(found):
    return found.select(
        "user_id", "start_t", "end_t", "n_points", F.round("distance_m", 3).alias("distance_m")
    )


@query("trip_summary", with_ctes(f"SELECT {TRIP_COLS} FROM trips"))
def trip_summary(i):
    """Trips with times, point count and distance."""
    return summary(trips.trips(trips.trip_points(i.pings())))


@query(
    "trip_summary_6h",
    with_ctes(
        f"SELECT {TRIP_COLS} FROM trips",
        {
            "trip_pts": f"""SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS trip_no FROM (
 SELECT *, {hav("plat", "plon", "lat", "lon")} AS d,
 CASE WHEN pt IS NULL OR t-pt>21600 OR ({hav("plat", "plon", "lat", "lon")}<50 AND t-pt>=900) THEN 1 ELSE 0 END AS brk FROM pseq) s"""
        },
    ),
)
def trip_summary_6h(i):
    """The same with a gap of six hours, where the visit rule fires more often."""
    return summary(trips.trips(trips.trip_points(i.pings(), SIX_HOURS), SIX_HOURS))


@query(
    "trip_bbox",
    with_ctes(
        "SELECT user_id, start_t, round(min_lon,9) AS min_lon, round(min_lat,9) AS min_lat, round(max_lon,9) AS max_lon, round(max_lat,9) AS max_lat FROM trips"
    ),
)
def trip_bbox(i):
    """A3: box of each trip with its margin."""
    return trips.trips(trips.trip_points(i.pings())).select(
        "user_id", "start_t", *[F.round(c, 9).alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")]
    )


@query(
    "trip_linestring",
    with_ctes(
        """SELECT trip_id, point_idx//1000 AS part, count(*) AS n_points,
 concat('LINESTRING(', string_agg(concat(CAST(CAST(round(lon*1e5) AS BIGINT) AS VARCHAR),' ',CAST(CAST(round(lat*1e5) AS BIGINT) AS VARCHAR)), ', ' ORDER BY point_idx), ')') AS line_e5,
 FROM trip_points GROUP BY trip_id, point_idx//1000"""
    ),
)
def trip_linestring(i):
    """Ordered trip geometry in parts; coordinates in 1e-5 degrees to compare as text."""
    lines = trips.trip_lines(trips.numbered_trip_points(trips.trip_points(i.pings())))
    scaled = F.transform(
        "points",
        lambda p: F.struct(
            F.round(p.x * 1e5).cast("long").alias("x"), F.round(p.y * 1e5).cast("long").alias("y")
        ),
    )
    return lines.select(
        "trip_id", "part", F.size("points").cast("long").alias("n_points"), geo.wkt_linestring(scaled).alias("line_e5")
    )


@query(
    "trip_bbox_ring",
    with_ctes(
        """SELECT user_id, start_t, k AS corner,
 round(CASE WHEN k IN (1,2) THEN max_lon ELSE min_lon END,9) AS x, round(CASE WHEN k IN (2,3) THEN max_lat ELSE min_lat END,9) AS y
FROM trips, unnest(range(0,5)) AS r(k)"""
    ),
)
def trip_bbox_ring(i):
    """The box as a closed ring of five points."""
    box = F.struct("min_lon", "min_lat", "max_lon", "max_lat").cast(
        "struct<min_x:double,min_y:double,max_x:double,max_y:double>"
    )
    return (
        trips.trips(trips.trip_points(i.pings()))
        .select("user_id", "start_t", F.posexplode(geo.bbox_ring(box)).alias("corner", "c"))
        .select(
            "user_id", "start_t", F.col("corner").cast("long").alias("corner"),
            F.round("c.x", 9).alias("x"), F.round("c.y", 9).alias("y"),
        )
    )


@query(
    "trip_dedup",
    with_ctes(
        f"""SELECT {TRIP_COLS} FROM trips tr WHERE NOT EXISTS (
 SELECT 1 FROM trip_pts p WHERE p.user_id=tr.user_id AND p.brk=1 AND p.t=tr.start_t AND (tr.end_t-tr.start_t)%2=0)"""
    ),
)
def trip_dedup(i):
    """Trips found again are not stored again. The stored ones are the found trips whose
    length in seconds is even."""
    points = trips.trip_points(i.pings())
    found = trips.trips(points)
    stored = found.filter((F.col("end_t") - F.col("start_t")) % 2 == 0).select("user_id", "start_t", "end_t")
    return summary(trips.new_trips(found, stored))


VISITS_EXACT = f"""SELECT user_id, pt AS arrival_t, t AS departure_t, plat AS lat, plon AS lon FROM (
 SELECT *, lag(t) OVER w AS pt, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM pings_q
 WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)) s
WHERE {hav("plat", "plon", "lat", "lon")}<50 AND t-pt>=900 AND t-pt<=900"""


@query(
    "visits_exact",
    with_ctes(
        "SELECT user_id, arrival_t, departure_t, round(lat,9) AS lat, round(lon,9) AS lon, 50.0e0 AS accuracy_m FROM vx",
        {"vx": VISITS_EXACT},
    ),
)
def visits_exact(i):
    """The literal visit rule, over quarter-hour points."""
    return trips.visits_exact(i.pings_q()).select(
        "user_id", "arrival_t", "departure_t", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), "accuracy_m"
    )


@query(
    "visit_dedup",
    with_ctes(
        """SELECT user_id, arrival_t, departure_t FROM vx
WHERE NOT EXISTS (SELECT 1 FROM visits v WHERE v.user_id=vx.user_id AND (v.arrival_t//900)*900=vx.arrival_t AND (v.arrival_t//900)*900+900*(v.event_id%2)=vx.departure_t)""",
        {"vx": VISITS_EXACT},
    ),
)
def visit_dedup(i):
    """Derived visits that are stored already are dropped."""
    stored = i.visits().selectExpr(
        "user_id", "(arrival_t div 900)*900 AS arrival_t", "(arrival_t div 900)*900+900*(event_id%2) AS departure_t"
    )
    return trips.new_visits(trips.visits_exact(i.pings_q()), stored).select("user_id", "arrival_t", "departure_t")


FOLD = """fold AS (
 SELECT user_id, rn, t, event_id, lat, lon, t AS a_t, event_id AS a_id, lat AS a_lat, lon AS a_lon FROM ord WHERE rn=1
 UNION ALL
 SELECT o.user_id, o.rn, o.t, o.event_id, o.lat, o.lon,
  CASE WHEN {keep} THEN o.t ELSE f.a_t END, CASE WHEN {keep} THEN o.event_id ELSE f.a_id END,
  CASE WHEN {keep} THEN o.lat ELSE f.a_lat END, CASE WHEN {keep} THEN o.lon ELSE f.a_lon END
 FROM fold f JOIN ord o ON o.user_id=f.user_id AND o.rn=f.rn+1)"""


def _fold_sql(step: float, source: str, body: str) -> str:
    keep = f"{hav('f.a_lat', 'f.a_lon', 'o.lat', 'o.lon')}>={step}"
    head = with_ctes(
        f"SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS rn FROM {source}"
    )
    inner = head[len("WITH ") :]
    cut = inner.rindex("\nSELECT *, row_number()")
    return f"WITH RECURSIVE {inner[:cut]},\nord AS MATERIALIZED ({inner[cut:]}),\n{FOLD.format(keep=keep)}\n{body}"


@query(
    "thinned_points",
    _fold_sql(1500.0, "pings", "SELECT user_id, t, event_id FROM fold WHERE a_id=event_id"),
)
def thinned_points(i):
    """Points at least a distance from the last kept one (1.5 km, as the points lie
    hundreds of meters apart)."""
    return movement.thin_by_distance(i.pings(), 1500.0).filter("kept").select("user_id", "t", "event_id")


@query(
    "stay_points",
    _fold_sql(
        50.0,
        "pings_q",
        """SELECT user_id, a_t AS arrival_t, max(t) AS departure_t, count(*) AS n_points, round(any_value(a_lat),9) AS lat, round(any_value(a_lon),9) AS lon
FROM fold GROUP BY user_id, a_t, a_id HAVING max(t)-a_t>=900""",
    ),
)
def stay_points(i):
    """Stays: runs within 50 m of the run's first point for a quarter hour or more."""
    return movement.stay_points(i.pings_q()).select(
        "user_id", "arrival_t", "departure_t", "n_points", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon")
    )


def _minute_sql() -> str:
    """One step per minute of a user; a step orders the minute's points by the last one of the step before."""
    head = with_ctes("SELECT user_id, event_id, lat, lon, (t//21600)*60 + t%60 AS t FROM pings")
    inner = head[len("WITH ") :]
    cut = inner.rindex("\nSELECT user_id, event_id, lat, lon")
    return f"""WITH RECURSIVE {inner[:cut]},
raw AS ({inner[cut:]}),
ord AS MATERIALIZED (SELECT *, t//60 AS minute, dense_rank() OVER (PARTITION BY user_id ORDER BY t//60) AS m FROM raw),
walk AS (
 SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM ord WHERE m=1
 UNION ALL
 SELECT o.*, row_number() OVER (PARTITION BY o.user_id ORDER BY round({hav("w.lat", "w.lon", "o.lat", "o.lon")},6), o.t, o.event_id), count(*) OVER (PARTITION BY o.user_id)
 FROM walk w JOIN ord o ON o.user_id=w.user_id AND o.m=w.m+1 WHERE w.pos=w.n)
SELECT user_id, minute, t, event_id, lat, lon, pos FROM walk"""


@query("points_per_minute_order", _minute_sql())
def points_per_minute_order(i):
    """Order of points that share a minute."""
    coarse = i.pings().withColumn("t", F.expr("(t div 21600)*60 + t % 60"))
    return movement.order_within_minutes(coarse)


SAMPLES = """SELECT event_id, user_id, (start_t//600)*60 AS t, type, least(confidence,100) AS confidence FROM act_typed"""
ACT_FOLD = """fold AS (
 SELECT user_id, rn, type, t AS r_t, event_id AS r_id, confidence AS r_c FROM ord WHERE rn=1
 UNION ALL
 SELECT o.user_id, o.rn, o.type, CASE WHEN {brk} THEN o.t ELSE f.r_t END, CASE WHEN {brk} THEN o.event_id ELSE f.r_id END, CASE WHEN {brk} THEN o.confidence ELSE f.r_c END
 FROM fold f JOIN ord o ON o.user_id=f.user_id AND o.rn=f.rn+1)
SELECT user_id, r_t AS start_t, r_id AS first_event_id, lead(r_t) OVER (PARTITION BY user_id ORDER BY r_t, r_id) AS end_t, any_value(type) AS type, CAST(any_value(r_c) AS INTEGER) AS confidence, count(*) AS n_samples
FROM fold GROUP BY user_id, r_t, r_id"""


def _act_sql() -> str:
    head = with_ctes(f"SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS rn FROM ({SAMPLES})")
    inner = head[len("WITH ") :]
    cut = inner.rindex("\nSELECT *, row_number()")
    brk = "(o.type<>f.type OR abs(o.confidence-f.r_c)>20 OR o.t-f.r_t>300)"
    return f"WITH RECURSIVE {inner[:cut]},\nord AS MATERIALIZED ({inner[cut:]}),\n{ACT_FOLD.format(brk=brk)}"


@query("activity_segments", _act_sql())
def activity_segments(i):
    """Motion samples merged into activity records (times shrunk tenfold, so that records
    of more than one sample occur)."""
    from wayloom.functions import parse

    samples = i.activities().select(
        "event_id",
        "user_id",
        F.expr("(start_t div 600)*60").alias("t"),
        parse.activity_type(F.col("raw_type")).alias("type"),
        F.least(F.round(F.col("probability") * 100).cast("int"), F.lit(100)).alias("confidence"),
    )
    return movement.activity_segments(samples)


@query(
    "trip_titles",
    with_ctes(
        """SELECT user_id, start_t, concat('Trip on ', strftime(make_timestamp(start_t*1000000), '%B %-d, %Y')) AS title,
 CASE WHEN end_t-start_t>=3600 THEN concat(CAST((end_t-start_t)//3600 AS VARCHAR),'h ',CAST(((end_t-start_t)%3600)//60 AS VARCHAR),'m') ELSE concat(CAST((end_t-start_t)//60 AS VARCHAR),' min') END AS duration
FROM trips"""
    ),
)
def trip_titles(i):
    """title and duration label of each trip."""
    from wayloom.functions import labels

    return trips.trips(trips.trip_points(i.pings())).select(
        "user_id",
        "start_t",
        labels.trip_title(F.timestamp_seconds("start_t")).alias("title"),
        labels.duration_label(F.col("end_t") - F.col("start_t")).alias("duration"),
    )
