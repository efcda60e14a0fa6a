"""Listings, interval joins and processing state."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayloom.functions import labels, parse
from wayloom.operators import dedup, serve, trips
from wayloom.plans.oracle import with_ctes
from wayloom.plans.registry import query


def found_trips(i):
    return trips.trips(trips.trip_points(i.pings()))


PENDING = "coalesce(processed,false)=false AND ready"


@query("pending_users", with_ctes(f"SELECT DISTINCT user_id FROM batches WHERE {PENDING}"))
def pending_users(i):
    """Users with batches to process."""
    return dedup.pending_users(i.batches())


@query(
    "first_pending_batches",
    with_ctes(
        f"""SELECT user_id, batch_id, batch_t, rn FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY batch_t, batch_id) AS rn
FROM batches WHERE {PENDING}) b WHERE rn<=3"""
    ),
)
def first_pending_batches(i):
    """The oldest pending batches per user (three here; the service takes 100)."""
    return dedup.first_pending(i.batches(), 3).select("user_id", "batch_id", "batch_t", "rn")


@query(
    "latest_batch",
    with_ctes("SELECT user_id, arg_max(batch_id, batch_t) AS batch_id, max(batch_t) AS batch_t FROM batches GROUP BY 1"),
)
def latest_batch(i):
    """Latest batch per user."""
    return dedup.latest_per_key(i.batches(), "user_id", ["batch_t", "batch_id"], ["batch_id", "batch_t"])


DEVICES = "SELECT user_id, event_id AS device_id, t AS created_t FROM ev WHERE event_type='signup'"


@query(
    "latest_device",
    with_ctes(
        """SELECT b.batch_id, b.user_id, d.device_id FROM batches b LEFT JOIN (
 SELECT user_id, device_id FROM devices QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_t DESC, device_id DESC)=1) d USING (user_id)""",
        {"devices": DEVICES},
    ),
)
def latest_device(i):
    """Newest device registration of the user, attached to each batch."""
    devices = i.events().filter("event_type = 'signup'").selectExpr("user_id", "event_id AS device_id", "t AS created_t")
    return serve.with_latest_device(i.batches(), devices).select("batch_id", "user_id", "device_id")




@query(
    "user_state",
    with_ctes(
        """SELECT u.user_id, u.last_processed_t, coalesce(tc.n,0) AS total_trips, coalesce(vc.n,0) AS total_visits
FROM (SELECT user_id, max(batch_t) AS last_processed_t FROM batches WHERE processed GROUP BY 1) u
LEFT JOIN (SELECT user_id, count(*) AS n FROM trips GROUP BY 1) tc USING (user_id)
LEFT JOIN (SELECT user_id, count(*) AS n FROM visits WHERE departure_t-arrival_t>=900 GROUP BY 1) vc USING (user_id)"""
    ),
)
def user_state(i):
    """Processing state per user."""
    return serve.user_state(i.batches(), found_trips(i), i.visits().filter("departure_t - arrival_t >= 900"))


@query(
    "processing_state",
    with_ctes(
        """SELECT c.id AS user_id, s.last_processed_t, coalesce(tc.n,0) AS total_trips
FROM accounts c LEFT JOIN (SELECT user_id, max(batch_t) AS last_processed_t FROM batches WHERE processed GROUP BY 1) s ON s.user_id=c.id
LEFT JOIN (SELECT user_id, count(*) AS n FROM trips WHERE user_id IN (SELECT user_id FROM batches WHERE processed) GROUP BY 1) tc ON tc.user_id=c.id"""
    ),
)
def processing_state(i):
    """Q-3: state of every account, zeros when it was never processed."""
    state = serve.user_state(i.batches(), found_trips(i), i.visits())
    return serve.state_or_default(i.customers().selectExpr("id AS user_id"), state).select(
        "user_id", "last_processed_t", "total_trips"
    )


@query(
    "import_list",
    with_ctes(
        """SELECT user_id, batch_id, batch_t, n_points, CASE batch_id%3 WHEN 0 THEN 'Google Maps' WHEN 1 THEN 'Apple Health' ELSE 'other' END AS import_type
FROM batches ORDER BY batch_t DESC, batch_id"""
    ),
)
def import_list(i):
    """All imports, newest first, with shown type names."""
    kind = F.expr("CASE batch_id%3 WHEN 0 THEN 'google_maps_timeline' WHEN 1 THEN 'apple_health' ELSE 'other' END")
    return (
        i.batches()
        .select("user_id", "batch_id", "batch_t", "n_points", labels.import_label(kind).alias("import_type"))
        .orderBy(F.desc("batch_t"), "batch_id")
    )


@query(
    "import_trip_counts",
    with_ctes(
        """SELECT b.user_id, b.batch_id AS id, b.batch_t AS import_t, count(tr.start_t) AS n_from
FROM batches b LEFT JOIN trips tr ON tr.user_id=b.user_id AND tr.start_t>=b.batch_t GROUP BY 1,2,3"""
    ),
)
def import_trip_counts(i):
    """Trips at or after each import, by running counts."""
    imports = i.batches().selectExpr("user_id", "batch_id AS id", "batch_t AS at")
    starts = found_trips(i).selectExpr("user_id", "start_t AS at")
    return dedup.counts_from(imports, starts).withColumnRenamed("at", "import_t")


@query(
    "trip_continuity",
    with_ctes(
        """SELECT lp.user_id, lp.batch_id, lp.last_point_t, lt.last_trip_end_t, abs(lp.last_point_t-lt.last_trip_end_t)<900 AS ongoing FROM (
 SELECT p.user_id, lb.batch_id, max(p.t) AS last_point_t FROM pings p JOIN (
  SELECT user_id, arg_max(batch_id, batch_t) AS batch_id FROM batches WHERE processed GROUP BY 1) lb
 ON lb.user_id=p.user_id AND lb.batch_id=p.user_id*100000+(p.t//86400) GROUP BY 1,2) lp
JOIN (SELECT user_id, max(end_t) AS last_trip_end_t FROM trips GROUP BY 1) lt USING (user_id)"""
    ),
)
def trip_continuity(i):
    """Does the last processed batch continue the last trip?"""
    return trips.continuity(i.batches(), i.batched_pings(), found_trips(i))


@query(
    "trips_for_user",
    with_ctes(
        """SELECT n.user_id, n.start_t, n.end_t, n.n_points, round(n.distance_m,3) AS distance_m, n.rn,
 (SELECT count(*) FROM visits v WHERE v.user_id=n.user_id AND v.arrival_t>=n.start_t AND v.departure_t<=n.end_t) AS n_visits,
 (SELECT count(*) FROM activities a WHERE a.user_id=n.user_id AND a.start_t BETWEEN n.start_t AND n.end_t) AS n_activities
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_t DESC, end_t DESC) AS rn FROM trips) n WHERE rn<=3"""
    ),
)
def trips_for_user(i):
    """Q-1, P6, L1: newest trips of each user with their visits and activities counted."""
    newest = serve.newest_per_user(found_trips(i), 3)
    visits = serve.events_in_trips(newest, i.visits(), "arrival_t", "departure_t")
    acts = serve.events_in_trips(newest, i.activities(), "start_t")
    counts = [
        df.groupBy("trip_id").agg(F.count(F.lit(1)).alias(n)) for df, n in ((visits, "n_visits"), (acts, "n_activities"))
    ]
    out = newest.join(counts[0], "trip_id", "left").join(counts[1], "trip_id", "left")
    return out.select(
        "user_id", "start_t", "end_t", "n_points", F.round("distance_m", 3).alias("distance_m"), "rn",
        *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("n_visits", "n_activities")],
    )


@query(
    "trip_list_newest",
    with_ctes("SELECT user_id, start_t, end_t FROM trips WHERE start_t>=1704844800 AND end_t<=1706054400 ORDER BY start_t DESC, user_id LIMIT 50"),
)
def trip_list_newest(i):
    """Newest trips of all users in a date range."""
    return serve.trip_listing(found_trips(i), from_t=1704844800, to_t=1706054400, limit=50).select("user_id", "start_t", "end_t")


@query(
    "trip_visits",
    with_ctes(
        """SELECT tr.user_id, tr.start_t AS trip_start_t, v.event_id FROM trips tr JOIN visits v ON v.user_id=tr.user_id AND v.arrival_t>=tr.start_t AND v.departure_t<=tr.end_t"""
    ),
)
def trip_visits(i):
    """Visits inside trips."""
    return serve.events_in_trips(found_trips(i), i.visits(), "arrival_t", "departure_t").select(
        "user_id", "trip_start_t", "event_id"
    )


@query(
    "trip_activities",
    with_ctes(
        """SELECT tr.user_id, tr.start_t AS trip_start_t, a.event_id, a.type FROM trips tr JOIN act_typed a ON a.user_id=tr.user_id AND a.start_t BETWEEN tr.start_t AND tr.end_t"""
    ),
)
def trip_activities(i):
    """Activities that begin inside trips."""
    from wayloom.functions import parse

    acts = i.activities().withColumn("type", parse.activity_type(F.col("raw_type")))
    return serve.events_in_trips(found_trips(i), acts, "start_t").select("user_id", "trip_start_t", "event_id", "type")


# Stand-in way list of a trip: the road ways of the lattice rows its points lie on.
TRIP_WAYS = "SELECT trip_id, point_idx AS pos, 1000000+(((event_id*7919)%200)//40)*100+(((event_id*7919)%200)%40)//4 AS way_id FROM trip_points"


def trip_way_list(i):
    pts = trips.numbered_trip_points(trips.trip_points(i.pings()))
    return pts.selectExpr(
        "trip_id", "point_idx AS pos",
        "1000000+(((event_id*7919)%200) div 40)*100+(((event_id*7919)%200)%40) div 4 AS way_id",
    )


@query(
    "trip_way_metadata",
    with_ctes(
        """SELECT w.trip_id, w.pos, w.way_id, s.segment_id, coalesce(s.highway,'unknown') AS highway, s.name, coalesce(s.is_oneway,false) AS is_oneway, s.way_id IS NOT NULL AS found
FROM tw w LEFT JOIN seg s ON s.way_id=w.way_id""",
        {"tw": TRIP_WAYS},
    ),
)
def trip_way_metadata(i):
    """J10, Q-2: way lists with segment metadata, defaults for unknown ways."""
    return serve.trip_ways(trip_way_list(i), i.segments())


@query(
    "missing_ways",
    with_ctes("SELECT DISTINCT way_id FROM tw WHERE way_id NOT IN (SELECT way_id FROM seg)", {"tw": TRIP_WAYS}),
)
def missing_ways(i):
    """Listed ways that the network does not hold."""
    return serve.missing_ways(trip_way_list(i), i.segments())


@query(
    "request_outcome",
    with_ctes(
        """SELECT CASE WHEN start_t%5=0 THEN concat('x', trip_id) ELSE trip_id END AS trip_id, user_id+start_t%2 AS caller,
 CASE WHEN start_t%5=0 THEN 'missing' WHEN start_t%2=0 THEN 'ok' ELSE 'denied' END AS outcome FROM trips_id"""
    ),
)
def request_outcome(i):
    """May the caller see the trip?"""
    found = found_trips(i)
    requests = found.selectExpr(
        "CASE WHEN start_t%5=0 THEN concat('x', trip_id) ELSE trip_id END AS trip_id", "user_id+start_t%2 AS caller"
    )
    return serve.request_outcome(requests, found)


@query(
    "user_search_page",
    with_ctes(
        """SELECT m.id, m.first_name, m.last_name, m.email, m.last_modified_t, c.total, CAST(ceil(c.total/10.0) AS BIGINT) AS pages FROM (
 SELECT * FROM accounts WHERE contains(first_name,'BUILD') OR contains(last_name,'BUILD') OR contains(email,'BUILD') ORDER BY last_modified_t DESC, id LIMIT 10 OFFSET 10) m,
 (SELECT count(*) AS total FROM accounts WHERE contains(first_name,'BUILD') OR contains(last_name,'BUILD') OR contains(email,'BUILD')) c"""
    ),
)
def user_search_page(i):
    """Q-4, P8, L3, L4, A20: second page of a search over accounts."""
    return serve.user_page(i.customers(), "BUILD", page=2, page_size=10)


@query("email_conflicts", with_ctes("SELECT email, count(*) AS n_accounts FROM accounts GROUP BY 1 HAVING count(*)>1"))
def email_conflicts(i):
    """Addresses used by more than one account."""
    return serve.email_conflicts(i.customers())


@query(
    "trips_by_date",
    with_ctes(
        """SELECT user_id, CAST(start_t//86400 AS BIGINT) AS day, string_agg(CAST(start_t AS VARCHAR), ',' ORDER BY start_t DESC) AS starts FROM trips GROUP BY 1,2"""
    ),
)
def trips_by_date(i):
    """Trips per calendar day, newest first."""
    return serve.trips_by_date(found_trips(i)).select(
        "user_id", F.unix_date("day").cast("long").alias("day"),
        F.array_join(F.col("starts").cast("array<string>"), ",").alias("starts"),
    )


@query("timeline_extent", with_ctes("SELECT min(start_t) AS start_t, max(end_t) AS end_t FROM trips"))
def timeline_extent(i):
    """First start and last end."""
    return serve.timeline_extent(found_trips(i))


@query(
    "batch_status_update",
    with_ctes(
        """SELECT batch_id, CASE WHEN coalesce(processed,false)=false AND ready THEN true ELSE processed END AS processed FROM batches"""
    ),
)
def batch_status_update(i):
    """Batch table after the pending batches were processed."""
    b = i.batches()
    from wayloom.sources.sinks import mark_batches

    return mark_batches(b, b.filter(dedup.is_pending())).select("batch_id", "processed")


@query(
    "trip_upsert",
    with_ctes(
        """SELECT user_id, start_t, end_t, CASE WHEN n_points>2 THEN 'matched' ELSE 'new' END AS status, n_points FROM trips"""
    ),
)
def trip_upsert(i):
    """Stored trips updated with matching results."""
    found = found_trips(i).select("user_id", "start_t", "end_t", F.lit("new").alias("status"), "n_points")
    updates = found.filter("n_points > 2").select(
        "user_id", "start_t", "end_t", F.lit("matched").alias("status"), F.lit(None).cast("long").alias("n_points")
    )
    return trips.trip_upsert(found, updates, ["user_id", "start_t", "end_t"])


@query(
    "format_labels",
    with_ctes(
        """SELECT event_id, CASE WHEN departure_t-arrival_t>=3600 THEN concat('Duration: ',CAST((departure_t-arrival_t)//3600 AS VARCHAR),'h ',CAST(((departure_t-arrival_t)%3600)//60 AS VARCHAR),'m') ELSE concat('Duration: ',CAST((departure_t-arrival_t)//60 AS VARCHAR),' min') END AS stay,
 CASE WHEN event_id*3>=1000 THEN concat(CAST(event_id*3//1000 AS VARCHAR),'.',CAST(((event_id*3)%1000)//100 AS VARCHAR),' km') ELSE concat(CAST(event_id*3 AS VARCHAR),' m') END AS distance,
 CASE WHEN event_id*512<1024 THEN concat(CAST(event_id*512 AS VARCHAR),' bytes') WHEN event_id*512<1048576 THEN concat(printf('%.1f',event_id*512/1024e0),' KB') ELSE printf('%.1f MB',event_id//2048*1e0) END AS size,
 strftime(make_timestamp(arrival_t*1000000),'%-m/%-d/%Y') AS date_text, strftime(make_timestamp(arrival_t*1000000),'%I:%M %p') AS time_text,
 CASE event_id%3 WHEN 0 THEN 'Pending' WHEN 1 THEN 'Completed' ELSE 'Unknown' END AS status
FROM visits"""
    ),
)
def format_labels(i):
    """Labels of durations, distances, sizes, dates and states."""
    ts = F.timestamp_seconds("arrival_t")
    # Whole hundreds and megabytes, where one decimal has no rounding question.
    meters = F.expr("CASE WHEN event_id*3>=1000 THEN (event_id*3 div 100)*100 ELSE event_id*3 END").cast("double")
    size = F.expr("CASE WHEN event_id*512<1048576 THEN event_id*512 ELSE (event_id div 2048)*1048576 END")
    status = F.expr("CASE event_id%3 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'COMPLETED' ELSE 'LOST' END")
    return i.visits().select(
        "event_id",
        labels.visit_duration_label(F.col("departure_t") - F.col("arrival_t")).alias("stay"),
        labels.distance_label(meters).alias("distance"),
        labels.file_size_label(size).alias("size"),
        labels.date_label(ts).alias("date_text"),
        labels.time_label(ts).alias("time_text"),
        labels.status_label(status).alias("status"),
    )


@query(
    "estimated_movement",
    with_ctes(
        """SELECT event_id, type, m AS minutes, CAST(CASE type WHEN 'walking' THEN 100 WHEN 'running' THEN 150 WHEN 'on_bicycle' THEN 10 WHEN 'in_vehicle' THEN 5 ELSE 10 END*m AS BIGINT) AS steps,
 CASE type WHEN 'walking' THEN round(0.8e0*100*m,6) WHEN 'on_bicycle' THEN 250e0*m WHEN 'in_vehicle' THEN NULL ELSE 10e0*m END AS distance_m,
 CASE event_id%4 WHEN 0 THEN 25 WHEN 1 THEN 50 WHEN 2 THEN 100 ELSE 0 END AS level
FROM (SELECT *, (event_id%61)*1e0 AS m FROM act_typed) a"""
    ),
)
def estimated_movement(i):
    """steps and distance estimated from activity and duration; confidence classes."""
    from wayloom.functions import parse

    minutes = (F.col("event_id") % 61).cast("double")
    kind = parse.activity_type(F.col("raw_type"))
    level = F.expr("CASE event_id%4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'none' END")
    return i.activities().select(
        "event_id",
        kind.alias("type"),
        minutes.alias("minutes"),
        labels.estimated_steps(kind, minutes).alias("steps"),
        F.round(labels.estimated_distance(kind, minutes), 6).alias("distance_m"),
        labels.confidence_level(level).alias("level"),
    )


@query(
    "date_time_labels",
    with_ctes("SELECT event_id, strftime(make_timestamp(t*1000000),'%-m/%-d/%Y, %-I:%M:%S %p') AS text FROM pings"),
)
def date_time_labels(i):
    """F32: date and time of each point as shown."""
    return i.pings().select("event_id", labels.date_time_label(F.timestamp_seconds("t")).alias("text"))


@query(
    "motion_types",
    with_ctes(
        """SELECT event_id, CASE WHEN event_id%2=1 THEN 'still' WHEN (event_id//2)%2=1 THEN 'walking' WHEN (event_id//4)%2=1 THEN 'running'
 WHEN (event_id//8)%2=1 THEN 'in_vehicle' WHEN (event_id//16)%2=1 THEN 'on_bicycle' ELSE 'unknown' END AS kind FROM pings"""
    ),
)
def motion_types(i):
    """type of motion samples, whose flags are the low bits of the event."""
    names = ["stationary", "walking", "running", "automotive", "cycling"]
    flags = F.struct(*[F.expr(f"(event_id div {2**k})%2=1").alias(n) for k, n in enumerate(names)])
    return i.pings().select("event_id", labels.motion_type(flags).alias("kind"))


@query(
    "stored_way_lists",
    """SELECT l_orderkey AS route_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)-1 AS pos, l_partkey AS way_id
FROM lineitem""",
)
def stored_way_lists(i):
    """way lists, written as text with each route, read back as rows."""
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    stored = i.table("lineitem").groupBy(F.col("l_orderkey").alias("route_id")).agg(
        F.to_json(F.transform(ordered, lambda x: x.l_partkey)).alias("way_ids")
    )
    rows = stored.select("route_id", F.posexplode(parse.way_ids_from_json(F.col("way_ids"))).alias("pos", "way_id"))
    return rows.withColumn("pos", F.col("pos").cast("long"))
