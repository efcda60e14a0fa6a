"""What users ask of stored trips, imports and accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayloom.operators.skew import salted_join


def trip_listing(trips: DataFrame, user_id=None, from_t=None, to_t=None, limit: int = 0) -> DataFrame:
    """Newest trips of one user (all users when None), optionally bounded in time; limit 0
    means all. With a limit Spark keeps the top rows per task and never sorts the whole."""
    out = trips
    if user_id is not None:
        out = out.filter(F.col("user_id") == user_id)
    if from_t is not None:
        out = out.filter(F.col("start_t") >= from_t)
    if to_t is not None:
        out = out.filter(F.col("end_t") <= to_t)
    out = out.orderBy(F.desc("start_t"), "user_id")
    return out.limit(limit) if limit > 0 else out


def newest_per_user(trips: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` newest trips of every user at once."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("start_t"), F.desc("end_t")))
    return trips.withColumn("rn", rank.cast("long")).filter(F.col("rn") <= limit)


def _by_bucket(trips: DataFrame, bucket_seconds: int) -> DataFrame:
    """Repeat a trip for each time bucket it covers."""
    first, last = F.floor(F.col("start_t") / bucket_seconds), F.floor(F.col("end_t") / bucket_seconds)
    return trips.withColumn("_bucket", F.explode(F.sequence(first.cast("long"), last.cast("long"))))


def events_in_trips(trips: DataFrame, events: DataFrame, start: str, end: str | None = None, bucket_seconds: int = 21600) -> DataFrame:
    """Events of a trip's user that start inside the trip and, with ``end``, also end there.

    The interval condition gets an equi key: (user, time bucket of the event's start). A trip
    is repeated for the buckets it covers, an event lies in one, so no pair is found twice.
    Events of busy users and hours are salted.
    """
    t = _by_bucket(trips.select("trip_id", "user_id", "start_t", "end_t"), bucket_seconds)
    e = events.withColumn("_bucket", F.floor(F.col(start) / bucket_seconds).cast("long"))
    renamed = t.select("trip_id", "user_id", F.col("start_t").alias("trip_start_t"), F.col("end_t").alias("trip_end_t"), "_bucket")
    inside = F.col(start).between(F.col("trip_start_t"), F.col("trip_end_t"))
    if end is not None:
        inside = inside & (F.col(end) <= F.col("trip_end_t"))
    spread = [c for c in events.columns if c != "user_id"]
    return salted_join(e, renamed, ["user_id", "_bucket"], spread).filter(inside).drop("_bucket")


def trip_ways(way_ids: DataFrame, segs: DataFrame) -> DataFrame:
    """Way list of trips (trip_id, pos, way_id) with the metadata of the way's first segment;
    unknown ways get defaults."""
    first = segs.groupBy("way_id").agg(
        F.min_by(F.struct("segment_id", "highway", "name", "is_oneway"), "segment_id").alias("m")
    )
    return way_ids.join(first, "way_id", "left").select(
        "trip_id", "pos", "way_id",
        F.col("m.segment_id").alias("segment_id"),
        F.coalesce("m.highway", F.lit("unknown")).alias("highway"),
        F.col("m.name").alias("name"),
        F.coalesce("m.is_oneway", F.lit(False)).alias("is_oneway"),
        F.col("m").isNotNull().alias("found"),
    )


def missing_ways(requested: DataFrame, segs: DataFrame) -> DataFrame:
    return requested.select("way_id").distinct().join(segs.select("way_id"), "way_id", "left_anti")


def request_outcome(requests: DataFrame, trips: DataFrame) -> DataFrame:
    """ok when the trip belongs to the caller, denied when it is another's, else missing."""
    owners = trips.select("trip_id", F.col("user_id").alias("owner"))
    outcome = (
        F.when(F.col("owner").isNull(), "missing").when(F.col("owner") == F.col("caller"), "ok").otherwise("denied")
    )
    return requests.join(owners, "trip_id", "left").withColumn("outcome", outcome).drop("owner")


SORT_COLUMNS = ["first_name", "last_name", "email", "last_modified_t"]


def user_filter(term: str | None, columns: list[str] = ("first_name", "last_name", "email")) -> Column:
    """Rows with the term in any of the columns; no term keeps all."""
    keep = F.lit(not term)
    for c in columns:
        if term:
            keep = keep | F.coalesce(F.col(c).contains(term), F.lit(False))
    return keep


def user_page(users: DataFrame, term: str | None = None, sort_by: str | None = None, ascending: bool = False, page: int = 1, page_size: int = 10) -> DataFrame:
    """One page of matching users with total and page counts.

    Ordering with offset and limit is a top-k: every task keeps page × page_size rows.
    """
    column = sort_by if sort_by in SORT_COLUMNS else "last_modified_t"
    key = F.col(column).asc() if ascending else F.col(column).desc()
    matching = users.filter(user_filter(term))
    rows = matching.orderBy(key, "id").offset((page - 1) * page_size).limit(page_size)
    totals = matching.agg(F.count(F.lit(1)).alias("total")).withColumn(
        "pages", F.ceil(F.col("total") / page_size).cast("long")
    )
    # One row on the right side.
    return rows.join(F.broadcast(totals))


def email_conflicts(users: DataFrame) -> DataFrame:
    return users.groupBy("email").agg(F.count(F.lit(1)).alias("n_accounts")).filter(F.col("n_accounts") > 1)


def trips_by_date(trips: DataFrame) -> DataFrame:
    """Per user and calendar day, start times newest first. A day holds at most a trip per
    gap length, so the list is short."""
    return trips.groupBy("user_id", F.to_date(F.timestamp_seconds("start_t")).alias("day")).agg(
        F.sort_array(F.collect_list("start_t"), asc=False).alias("starts")
    )


def timeline_extent(trips: DataFrame, default_start: int = 0, default_end: int = 86400) -> DataFrame:
    return trips.agg(
        F.coalesce(F.min("start_t"), F.lit(default_start)).alias("start_t"),
        F.coalesce(F.max("end_t"), F.lit(default_end)).alias("end_t"),
    )


def user_state(batches: DataFrame, trips: DataFrame, derived_visits: DataFrame) -> DataFrame:
    """Processing state of users with processed batches: last batch time, trips, visits."""
    done = (
        batches.filter(F.coalesce("processed", F.lit(False)))
        .groupBy("user_id")
        .agg(F.max("batch_t").alias("last_processed_t"))
    )
    n_trips = trips.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_trips"))
    n_visits = derived_visits.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_visits"))
    zero = F.lit(0).cast("long")
    return (
        done.join(n_trips, "user_id", "left")
        .join(n_visits, "user_id", "left")
        .select(
            "user_id", "last_processed_t",
            F.coalesce("n_trips", zero).alias("total_trips"), F.coalesce("n_visits", zero).alias("total_visits"),
        )
    )


def state_or_default(users: DataFrame, state: DataFrame) -> DataFrame:
    """State of every asked user; unknown users get zeros."""
    zero = F.lit(0).cast("long")
    return users.select("user_id").distinct().join(state, "user_id", "left").select(
        "user_id", "last_processed_t",
        F.coalesce("total_trips", zero).alias("total_trips"), F.coalesce("total_visits", zero).alias("total_visits"),
    )


def with_latest_device(batches: DataFrame, devices: DataFrame) -> DataFrame:
    """Attach the user's newest device to each batch."""
    latest = devices.groupBy("user_id").agg(F.max_by("device_id", F.struct("created_t", "device_id")).alias("device_id"))
    return batches.join(latest, "user_id", "left")
