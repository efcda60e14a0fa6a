"""Scans, cleaning and de-duplication of incoming events."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayloom.functions import parse
from wayloom.operators import dedup, imports
from wayloom.plans.oracle import with_ctes
from wayloom.plans.registry import query
from wayloom.session import table_path
from wayloom.sources import batches as messages_source
from wayloom.sources import timeline


def timeline_export_texts(i):
    """One export per point: an array with a visit, an activity, a path and a memory entry."""
    at = F.timestamp_seconds("t")
    iso = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    end = F.date_format(F.timestamp_seconds(F.col("t") + 600), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    geo = F.concat(F.lit("geo:"), F.col("lat_e5").cast("string"), F.lit(","), F.col("lon_e5").cast("string"))
    src = i.pings().join(i.activities().select("event_id", "raw_type", "probability"), "event_id").select(
        "*", F.round(F.col("lat") * 1e5).cast("long").alias("lat_e5"), F.round(F.col("lon") * 1e5).cast("long").alias("lon_e5")
    )
    prob = F.when(F.col("event_id") % 17 == 0, F.lit("n/a")).otherwise(F.format_string("%.4f", "probability"))
    visit = F.struct(
        iso.alias("startTime"), end.alias("endTime"),
        F.struct(
            F.struct(
                F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise("Home").alias("semanticType"),
                F.concat(F.lit("p"), (F.col("event_id") % 200).cast("string")).alias("placeID"),
                F.when(F.col("event_id") % 13 == 0, F.lit("nowhere")).otherwise(geo).alias("placeLocation"),
            ).alias("topCandidate")
        ).alias("visit"),
    )
    activity = F.struct(
        iso.alias("startTime"), end.alias("endTime"),
        F.struct(
            F.format_string("%d.5", F.col("event_id") % 5000).alias("distanceMeters"),
            F.struct(F.col("raw_type").alias("type"), prob.alias("probability")).alias("topCandidate"),
        ).alias("activity"),
    )
    path = F.struct(
        iso.alias("startTime"), end.alias("endTime"),
        F.array(
            F.struct(geo.alias("point"), F.lit("0").alias("durationMinutesOffsetFromStartTime")),
            F.struct(geo.alias("point"), (F.col("event_id") % 30).cast("string").alias("durationMinutesOffsetFromStartTime")),
            F.struct(F.lit("geo:x,1").alias("point"), F.lit("1").alias("durationMinutesOffsetFromStartTime")),
            F.struct(geo.alias("point"), F.lit("soon").alias("durationMinutesOffsetFromStartTime")),
        ).alias("timelinePath"),
    )
    memory = F.struct(
        iso.alias("startTime"), end.alias("endTime"), F.struct(F.lit("40").alias("distanceFromOriginKms")).alias("timelineMemory")
    )
    entries = F.concat(*[F.lit("["), F.to_json(visit), F.lit(","), F.to_json(activity), F.lit(","), F.to_json(path), F.lit(","), F.to_json(memory), F.lit("]")])
    return src.select("event_id", entries.alias("json"))


def timeline_exports(i):
    return timeline.read_entries(timeline_export_texts(i))


E5 = "CAST(round(lat*1e5) AS BIGINT) AS lat_e5, CAST(round(lon*1e5) AS BIGINT) AS lon_e5"


@query(
    "timeline_parse_visits",
    with_ctes(
        f"""SELECT event_id, {E5}, t AS arrival_t, t+600 AS departure_t,
 CASE WHEN event_id%3=0 THEN NULL ELSE 'Home' END AS canonical_label, concat('p', CAST(event_id%200 AS VARCHAR)) AS external_place_id
FROM pings WHERE event_id%13<>0"""
    ),
)
def timeline_parse_visits(i):
    """Visit entries; entries with a malformed place are dropped."""
    return timeline.visits(timeline_exports(i), ["event_id"]).select(
        "event_id",
        F.col("latitude").cast("long").alias("lat_e5"),
        F.col("longitude").cast("long").alias("lon_e5"),
        F.unix_timestamp("arrival").alias("arrival_t"),
        F.unix_timestamp("departure").alias("departure_t"),
        "canonical_label",
        "external_place_id",
    )


@query(
    "timeline_parse_activities",
    with_ctes(
        """SELECT event_id, type, CASE WHEN event_id%17=0 THEN 0 ELSE CAST(round(round(probability,4)*100) AS INTEGER) END AS confidence,
 start_t, start_t+600 AS end_t, CAST(event_id%5000 AS DOUBLE)+0.5e0 AS distance FROM act_typed"""
    ),
)
def timeline_parse_activities(i):
    """Activity entries with typed name, confidence and distance."""
    return timeline.activities(timeline_exports(i), ["event_id"]).select(
        "event_id",
        "type",
        "confidence",
        F.unix_timestamp("start_date_time").alias("start_t"),
        F.unix_timestamp("end_date_time").alias("end_t"),
        "distance",
    )


@query(
    "timeline_parse_points",
    with_ctes(
        f"""SELECT event_id, {E5}, t+60*m AS t FROM (
 SELECT *, 0 AS m FROM pings UNION ALL SELECT *, event_id%30 AS m FROM pings) p"""
    ),
)
def timeline_parse_points(i):
    """Path points at start plus offset; malformed points are dropped."""
    return timeline.points(timeline_exports(i), ["event_id"]).select(
        "event_id",
        F.col("latitude").cast("long").alias("lat_e5"),
        F.col("longitude").cast("long").alias("lon_e5"),
        F.unix_timestamp("date_time").alias("t"),
    )


@query(
    "timeline_union",
    with_ctes(
        """SELECT kind, ev_t // 86400 AS day, count(*) AS n FROM (
 SELECT 'visit' AS kind, t AS ev_t FROM pings WHERE event_id%13<>0 UNION ALL SELECT 'activity', t FROM pings
 UNION ALL SELECT 'point', t FROM pings UNION ALL SELECT 'point', t+60*(event_id%30) FROM pings) u GROUP BY 1,2"""
    ),
)
def timeline_union(i):
    """All kinds as one timeline, counted per day."""
    e = timeline_exports(i)
    keep = ["event_id"]
    merged = timeline.event_timeline(timeline.visits(e, keep), timeline.activities(e, keep), timeline.points(e, keep), keep)
    day = F.floor(F.unix_timestamp("at") / 86400).cast("long")
    return merged.groupBy("kind", day.alias("day")).agg(F.count(F.lit(1)).alias("n"))


def civil(seconds):
    return parse.timestamp_to_civil(F.timestamp_seconds(seconds), F.lit(-10800))


def ingest_messages(i):
    """One message per point, with one to three locations, an activity and up to one visit."""
    src = i.pings().join(
        i.activities().select("event_id", "raw_type", "probability", "start_t", "end_t"), "event_id"
    )
    optional = ["altitude", "horizontal_accuracy", "vertical_accuracy", "speed_accuracy", "bearing_accuracy", "speed", "bearing"]
    location = F.transform(
        F.sequence(F.lit(0), (F.col("event_id") % 3).cast("int")),
        lambda k: F.struct(
            F.col("lat").alias("latitude"), F.col("lon").alias("longitude"),
            *[((F.col("event_id") + n) % 4).cast("double").alias(c) for n, c in enumerate(optional)],
            civil(F.col("t") + k).alias("date_time"),
            F.lit(False).alias("is_mock_location"), (F.col("event_id") % 2).cast("int").alias("floor_level"),
            (F.col("event_id") % 5).cast("int").alias("battery_level"), F.lit("lte").alias("network_type"),
        ),
    )
    activity = F.array(
        F.struct(
            parse.activity_type(F.col("raw_type")).alias("type"),
            F.round(F.col("probability") * 100).cast("int").alias("confidence"),
            civil(F.col("start_t")).alias("start"),
            F.when(F.col("end_t").isNotNull(), civil(F.col("end_t"))).alias("end"),
            F.lit(None).cast("long").alias("step_count"), F.lit(None).cast("double").alias("distance"),
        )
    )
    visit = F.filter(
        F.array(
            F.struct(
                F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.lit(0.0).alias("horizontal_accuracy"),
                civil(F.col("t")).alias("arrival"), civil(F.col("t") + 600).alias("departure"),
                F.lit("").alias("canonical_label"), F.lit("p1").alias("external_place_id"),
            )
        ),
        lambda _: F.col("event_id") % 2 == 1,
    )

    def only(n: int, value):
        return F.when(F.col("event_id") % 6 == n, value)

    version = F.concat(F.lit("1."), (F.col("event_id") % 9).cast("string"))
    source = F.struct(
        only(0, F.struct(version.alias("app_version"))).alias("app"),
        only(1, F.struct(version.alias("web_version"))).alias("web"),
        only(2, F.struct(version.alias("api_version"), F.lit("k").alias("used_api_key"))).alias("api"),
        only(3, F.struct(version.alias("version"))).alias("google_maps"),
        only(4, F.struct(version.alias("version"))).alias("apple_health"),
        only(5, F.struct(F.lit("run").alias("app_name"), version.alias("app_version"))).alias("fitness_app"),
    )
    return src.select(
        F.col("event_id").alias("batch_id"), "user_id", civil(F.col("t")).alias("date_time"),
        location.alias("locations"), activity.alias("activities"), visit.alias("visits"), source.alias("source"),
    )


@query(
    "batch_explode",
    with_ctes(
        """SELECT 'location' AS kind, event_id AS batch_id, user_id, t+k AS start_t, CAST(NULL AS BIGINT) AS end_t FROM pings, unnest(range(0,3)) AS r(k) WHERE k<=event_id%3
UNION ALL SELECT concat('activity ', type), event_id, user_id, start_t, end_t FROM act_typed
UNION ALL SELECT 'visit', event_id, user_id, t, t+600 FROM pings WHERE event_id%2=1"""
    ),
)
def batch_explode(i):
    """Nested messages split into locations, activities and visits."""
    m = ingest_messages(i)
    s = lambda c: F.unix_timestamp(c)
    none = F.lit(None).cast("long")
    loc = messages_source.locations(m).select(F.lit("location").alias("kind"), "batch_id", "user_id", s("date_time").alias("start_t"), none.alias("end_t"))
    act = messages_source.activities(m).select(
        F.concat(F.lit("activity "), "type").alias("kind"), "batch_id", "user_id",
        s("start_date_time").alias("start_t"), s("end_date_time").alias("end_t"),
    )
    vis = messages_source.visits(m).select(F.lit("visit").alias("kind"), "batch_id", "user_id", s("arrival").alias("start_t"), s("departure").alias("end_t"))
    return loc.unionByName(act).unionByName(vis)


@query(
    "normalize_missing",
    with_ctes(
        """SELECT event_id AS batch_id, t+k AS t,
 nullif(CAST(event_id%4 AS DOUBLE),0) AS altitude, nullif(CAST((event_id+5)%4 AS DOUBLE),0) AS speed, nullif(CAST((event_id+6)%4 AS DOUBLE),0) AS bearing,
 nullif(CAST(event_id%2 AS INTEGER),0) AS floor_level, nullif(CAST(event_id%5 AS INTEGER),0) AS battery_level
FROM pings, unnest(range(0,3)) AS r(k) WHERE k<=event_id%3"""
    ),
)
def normalize_missing(i):
    """Zero means missing."""
    return messages_source.locations(ingest_messages(i)).select(
        "batch_id", F.unix_timestamp("date_time").alias("t"), "altitude", "speed", "bearing", "floor_level", "battery_level"
    )


@query(
    "invalid_readings",
    with_ctes(
        """SELECT event_id, CASE WHEN event_id%7>=2 THEN CAST(event_id%7-2 AS DOUBLE) END AS speed,
 CASE WHEN event_id%5>=1 THEN CAST(event_id%5-1 AS DOUBLE) END AS horizontal_accuracy, nullif(CAST(event_id%4-1 AS INTEGER),-1) AS battery_level FROM pings"""
    ),
)
def invalid_readings(i):
    """Negative sensor readings are dropped."""
    raw = i.pings().selectExpr(
        "event_id", "CAST(event_id%7-2 AS DOUBLE) AS speed", "CAST(event_id%5-1 AS DOUBLE) AS horizontal_accuracy",
        "CAST(event_id%4-1 AS INT) AS battery_level",
    )
    return parse.drop_invalid_readings(raw)


@query(
    "reject_missing_time",
    with_ctes(
        """SELECT event_id, CASE WHEN event_id%13=0 THEN 'missing arrival_t' WHEN event_id%11=0 THEN 'missing departure_t' ELSE 'accepted' END AS outcome FROM visits"""
    ),
)
def reject_missing_time(i):
    """Rows without a required time are set aside with the reason."""
    v = i.visits().selectExpr(
        "event_id", "CASE WHEN event_id%13<>0 THEN arrival_t END AS arrival_t", "CASE WHEN event_id%11<>0 THEN departure_t END AS departure_t"
    )
    good, bad = parse.split_required(v, ["arrival_t", "departure_t"])
    return good.select("event_id", F.lit("accepted").alias("outcome")).unionByName(
        bad.select("event_id", F.col("reject_reason").alias("outcome"))
    )


@query(
    "source_info",
    with_ctes(
        """SELECT event_id AS batch_id, t AS batch_t, CASE event_id%6
 WHEN 0 THEN concat('{"type":"app","app_version":"1.',CAST(event_id%9 AS VARCHAR),'"}')
 WHEN 1 THEN concat('{"type":"web","web_version":"1.',CAST(event_id%9 AS VARCHAR),'"}')
 WHEN 2 THEN concat('{"type":"api","api_version":"1.',CAST(event_id%9 AS VARCHAR),'","used_api_key":"k"}')
 WHEN 3 THEN concat('{"type":"google_maps","version":"1.',CAST(event_id%9 AS VARCHAR),'"}')
 WHEN 4 THEN concat('{"type":"apple_health","version":"1.',CAST(event_id%9 AS VARCHAR),'"}')
 ELSE concat('{"type":"fitness_app","app_name":"run","app_version":"1.',CAST(event_id%9 AS VARCHAR),'"}') END AS source_info FROM pings"""
    ),
)
def source_info(i):
    """The filled member of the source union as JSON."""
    return messages_source.batch_rows(ingest_messages(i)).select(
        "batch_id", F.unix_timestamp("batch_date_time").alias("batch_t"), "source_info"
    )


@query(
    "chunk_50",
    with_ctes(
        """SELECT user_id, packet, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM (
 SELECT user_id, t, (row_number() OVER (PARTITION BY user_id ORDER BY t, event_id)-1)//50 AS packet FROM pings) p GROUP BY 1,2"""
    ),
)
def chunk_50(i):
    """Packets of 50 events per user."""
    cut = messages_source.packets(i.pings(), "user_id", "t", ["t", "event_id"])
    return cut.groupBy("user_id", "packet").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


# Re-sent data: odd events come a second late, the others exactly as stored.
RESENT = {
    "in_loc": "SELECT user_id*100000+(t//86400) AS batch_id, user_id, event_id, t+event_id%2 AS t FROM pings",
    "in_act": "SELECT user_id*100000+(start_t//86400) AS batch_id, user_id, event_id, start_t+event_id%2 AS start_t, end_t FROM activities",
    "in_vis": "SELECT user_id*100000+(arrival_t//86400) AS batch_id, user_id, event_id, arrival_t+event_id%2 AS arrival_t, departure_t FROM visits",
    "env": """SELECT batch_id, user_id, min(lo) AS lo, max(hi) AS hi FROM (
 SELECT batch_id, user_id, t AS lo, t AS hi FROM in_loc UNION ALL SELECT batch_id, user_id, start_t, end_t FROM in_act
 UNION ALL SELECT batch_id, user_id, arrival_t, departure_t FROM in_vis) u GROUP BY 1,2""",
    "st_loc": "SELECT p.user_id, p.t, b.batch_t, coalesce(b.processed,false) AS processed FROM pings p JOIN batches b ON b.batch_id=p.user_id*100000+(p.t//86400)",
    "st_act": "SELECT p.user_id, p.start_t, p.end_t, b.batch_t, coalesce(b.processed,false) AS processed FROM activities p JOIN batches b ON b.batch_id=p.user_id*100000+(p.start_t//86400)",
    "st_vis": "SELECT p.user_id, p.arrival_t, p.departure_t, b.batch_t, coalesce(b.processed,false) AS processed FROM visits p JOIN batches b ON b.batch_id=p.user_id*100000+(p.arrival_t//86400)",
}
CAND = "(s.batch_t BETWEEN e.lo AND e.hi OR (s.batch_t<=e.lo AND s.processed))"
NEW_LOC = f"""SELECT i.user_id, i.event_id, i.batch_id FROM in_loc i JOIN env e USING (batch_id) WHERE NOT EXISTS (
 SELECT 1 FROM st_loc s WHERE s.user_id=i.user_id AND s.t=i.t AND {CAND} AND s.t BETWEEN e.lo AND e.hi)"""
NEW_ACT = f"""SELECT i.user_id, i.event_id, i.batch_id FROM in_act i JOIN env e USING (batch_id) WHERE NOT EXISTS (
 SELECT 1 FROM st_act s WHERE s.user_id=i.user_id AND s.start_t=i.start_t AND s.end_t IS NOT DISTINCT FROM i.end_t AND {CAND}
 AND (s.start_t BETWEEN e.lo AND e.hi OR s.end_t BETWEEN e.lo AND e.hi OR (s.start_t<=e.lo AND s.end_t>=e.hi)))"""
NEW_VIS = f"""SELECT i.user_id, i.event_id, i.batch_id FROM in_vis i JOIN env e USING (batch_id) WHERE NOT EXISTS (
 SELECT 1 FROM st_vis s WHERE s.user_id=i.user_id AND s.arrival_t=i.arrival_t AND s.departure_t=i.departure_t AND {CAND}
 AND (s.arrival_t BETWEEN e.lo AND e.hi OR s.departure_t BETWEEN e.lo AND e.hi OR (s.arrival_t<=e.lo AND s.departure_t>=e.hi)))"""


def resent(i):
    loc = i.pings().selectExpr("user_id*100000+(t div 86400) AS batch_id", "user_id", "event_id", "t+event_id%2 AS t")
    act = i.activities().selectExpr(
        "user_id*100000+(start_t div 86400) AS batch_id", "user_id", "event_id", "start_t+event_id%2 AS start_t", "end_t"
    )
    vis = i.visits().selectExpr(
        "user_id*100000+(arrival_t div 86400) AS batch_id", "user_id", "event_id", "arrival_t+event_id%2 AS arrival_t", "departure_t"
    )
    return loc, act, vis, dedup.envelopes(loc, act, vis)


def stored_locations(i):
    return i.batched_pings().select("batch_id", "user_id", "t")


def stored_activities(i):
    return i.activities().selectExpr("user_id*100000+(start_t div 86400) AS batch_id", "user_id", "start_t", "end_t")


def stored_visits(i):
    return i.visits().selectExpr("user_id*100000+(arrival_t div 86400) AS batch_id", "user_id", "arrival_t", "departure_t")


@query("batch_envelope", with_ctes("SELECT batch_id, user_id, lo, hi FROM env", RESENT))
def batch_envelope(i):
    """A1: time envelope of each incoming batch."""
    return resent(i)[3]


@query("loc_overlap_dedup", with_ctes(NEW_LOC, RESENT))
def loc_overlap_dedup(i):
    """Incoming points not stored yet."""
    loc, _, _, env = resent(i)
    return dedup.new_locations(loc, env, stored_locations(i), i.batches()).select("user_id", "event_id", "batch_id")


@query("act_overlap_dedup", with_ctes(NEW_ACT, RESENT))
def act_overlap_dedup(i):
    """Incoming activities not stored yet."""
    _, act, _, env = resent(i)
    return dedup.new_activities(act, env, stored_activities(i), i.batches()).select("user_id", "event_id", "batch_id")


@query("visit_overlap_dedup", with_ctes(NEW_VIS, RESENT))
def visit_overlap_dedup(i):
    """Incoming visits not stored yet."""
    _, _, vis, env = resent(i)
    return dedup.new_visits(vis, env, stored_visits(i), i.batches()).select("user_id", "event_id", "batch_id")


@query(
    "overlap_batches",
    with_ctes(
        """SELECT e.user_id, e.batch_id, count(*) FILTER (s.batch_t BETWEEN e.lo AND e.hi) AS n_inside,
 count(*) FILTER (s.batch_t<e.lo AND coalesce(s.processed,false)) AS n_processed_before
FROM env e LEFT JOIN batches s ON s.user_id=e.user_id AND s.batch_t<=e.hi GROUP BY 1,2""",
        RESENT,
    ),
)
def overlap_batches(i):
    """Stored batches that may hold duplicates, counted per incoming batch."""
    counts = dedup.candidate_batch_counts(resent(i)[3], i.batches())
    return counts.select("user_id", "batch_id", F.col("n_inside").cast("long").alias("n_inside"), F.col("n_processed_before").cast("long").alias("n_processed_before"))


@query(
    "import_counts",
    with_ctes(
        """SELECT batch_id, CAST(sum(l) AS BIGINT) AS location_count, CAST(sum(a) AS BIGINT) AS activity_count, CAST(sum(v) AS BIGINT) AS visit_count FROM (
 SELECT batch_id, 1 AS l, 0 AS a, 0 AS v FROM nl UNION ALL SELECT batch_id, 0, 1, 0 FROM na UNION ALL SELECT batch_id, 0, 0, 1 FROM nv) u GROUP BY 1""",
        {**RESENT, "nl": NEW_LOC, "na": NEW_ACT, "nv": NEW_VIS},
    ),
)
def import_counts(i):
    """Rows of each kind kept after de-duplication."""
    loc, act, vis, env = resent(i)
    b = i.batches()
    return dedup.import_counts(
        dedup.new_locations(loc, env, stored_locations(i), b),
        dedup.new_activities(act, env, stored_activities(i), b),
        dedup.new_visits(vis, env, stored_visits(i), b),
    )


@query(
    "maxspeed",
    with_ctes(
        """SELECT id, raw, round(CASE WHEN raw LIKE '% mph' THEN TRY_CAST(replace(raw,' mph','') AS DOUBLE)*1.60934e0 WHEN raw LIKE '% km/h' THEN TRY_CAST(replace(raw,' km/h','') AS DOUBLE) ELSE TRY_CAST(raw AS DOUBLE) END,6) AS kmh FROM maxspeed"""
    ),
)
def maxspeed(i):
    """speed limit text to km/h."""
    return i.maxspeed().select("id", "raw", F.round(parse.max_speed_kmh(F.col("raw")), 6).alias("kmh"))


def user_exports(i, import_no: int, kept: str):
    """One export per user: all entries of the user's events that ``kept`` names, as one text."""
    entries = timeline_export_texts(i).join(i.events().select("event_id", "user_id"), "event_id").filter(kept)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "json"))), lambda e: F.substring(e.json, F.lit(2), F.length(e.json) - 2))
    return entries.groupBy("user_id").agg(F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]")).alias("json")).select(
        (F.col("user_id") * 10 + import_no).alias("export_id"), "user_id", F.lit(f"export {import_no}").alias("export_name"),
        F.lit("2030-01-01 00:00:00").cast("timestamp").alias("export_date"), "json",
    )


def imported(i) -> imports.Store:
    """A store after four imports: two thirds of the events, another two thirds, the first again under another id
    together with texts that are no export, and the second again under its own id."""
    store = imports.Store(i.spark, table_path(i.spark, i.sf_dir, "timelines"))
    first, second = user_exports(i, 1, "event_id % 3 <> 0"), user_exports(i, 2, "event_id % 3 <> 1")
    store.add(first, "first")
    store.add(second, "second")
    broken = i.events().select("user_id").distinct().filter("user_id % 7 = 0").selectExpr(
        "user_id * 10 + 4 AS export_id", "user_id", "'broken' AS export_name", "CAST('2030-01-01 00:00:00' AS TIMESTAMP) AS export_date",
        "CASE WHEN user_id % 2 = 0 THEN '' ELSE '{oops' END AS json",
    )
    store.add(first.withColumn("export_id", F.col("export_id") + 2).unionByName(broken), "third")
    store.add(second, "second")
    return store


# What the imports leave: events of the first export, then those of the second whose key the first doesn't hold.
IMPORTS = {
    "raw_point": """SELECT user_id, event_id, t+60*m AS t FROM (SELECT *, 0 AS m FROM pings UNION ALL SELECT *, event_id%30 AS m FROM pings) p""",
    "raw_event": """SELECT 'location' AS kind, user_id, event_id, t AS start_t, CAST(NULL AS BIGINT) AS end_t FROM raw_point
UNION ALL SELECT 'activity', user_id, event_id, t, t+600 FROM pings
UNION ALL SELECT 'visit', user_id, event_id, t, t+600 FROM pings WHERE event_id%13<>0""",
    "kept_event": """SELECT 'first' AS import_id, * FROM raw_event WHERE event_id%3<>0
UNION ALL SELECT 'second', * FROM raw_event b WHERE event_id%3<>1 AND NOT EXISTS (
 SELECT 1 FROM raw_event a WHERE a.event_id%3<>0 AND a.kind=b.kind AND a.user_id=b.user_id AND a.start_t=b.start_t AND a.end_t IS NOT DISTINCT FROM b.end_t)""",
}


@query(
    "timeline_import",
    with_ctes("SELECT import_id, kind, user_id, start_t, end_t, count(*) AS n FROM kept_event GROUP BY ALL", IMPORTS),
)
def timeline_import(i):
    """Q-5: stored rows after importing overlapping and repeated export texts."""
    store = imported(i)

    def rows(table: str, kind: str, start: str, end):
        return store.read(table).select("import_id", F.lit(kind).alias("kind"), "user_id", F.col(start).alias("start_t"), end.alias("end_t"))

    every = (
        rows("locations", "location", "t", F.lit(None).cast("long"))
        .unionByName(rows("activities", "activity", "start_t", F.col("end_t")))
        .unionByName(rows("visits", "visit", "arrival_t", F.col("departure_t")))
    )
    return every.groupBy(*every.columns).agg(F.count(F.lit(1)).alias("n"))


@query(
    "timeline_import_replies",
    with_ctes(
        """SELECT r.import_id, r.user_id, count(*) FILTER (WHERE kind='location') AS processed_locations, count(*) FILTER (WHERE kind='activity') AS processed_activities,
 count(*) FILTER (WHERE kind='visit') AS processed_visits, CASE WHEN r.import_id='broken' THEN 'rejected' WHEN count(kind)=0 THEN 'unchanged' ELSE 'imported' END AS outcome,
 count(kind)>0 AS has_batch
FROM (SELECT DISTINCT 'first' AS import_id, user_id FROM pings WHERE event_id%3<>0 UNION ALL SELECT DISTINCT 'second', user_id FROM pings WHERE event_id%3<>1
 UNION ALL SELECT DISTINCT 'third', user_id FROM pings WHERE event_id%3<>0 UNION ALL SELECT DISTINCT 'broken', user_id FROM pings WHERE user_id%7=0) r
LEFT JOIN kept_event k ON k.import_id=r.import_id AND k.user_id=r.user_id GROUP BY r.import_id, r.user_id""",
        IMPORTS,
    ),
)
def timeline_import_replies(i):
    """Q-5: counters and outcome of every import request, and whether a batch is stored for it."""
    store = imported(i)
    batches = store.read("batches").filter("ready_for_processing AND NOT processed").select("batch_id").withColumn("_b", F.lit(True))
    asked = F.when(F.col("export_id") % 10 == 4, "broken").otherwise(F.col("import_id"))
    return store.read("manifest").join(batches, "batch_id", "left").select(
        asked.alias("import_id"), "user_id", "processed_locations", "processed_activities", "processed_visits", "outcome",
        F.coalesce("_b", F.lit(False)).alias("has_batch"),
    )
