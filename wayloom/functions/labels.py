"""Text labels shown to people, and estimates made from activity types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayloom.functions.roads import lookup

# Shown names of import types; other types are shown as they are.
IMPORT_LABELS = {
    "google_maps_timeline": "Google Maps",
    "apple_health": "Apple Health",
    "fitness_app": "Fitness App",
}
# Shown names of matching states.
STATUS_LABELS = {
    "PENDING": "Pending", "PROCESSING": "Processing", "COMPLETED": "Completed", "FAILED": "Failed",
    "UNKNOWN": "Unknown",
}
# Confidence class of a motion sample in percent.
CONFIDENCE_LEVELS = {"low": 25, "medium": 50, "high": 100}
# Steps per minute, and meters per minute where a distance can be estimated.
STEPS_PER_MINUTE = {"walking": 100, "running": 150, "on_bicycle": 10, "in_vehicle": 5}
METERS_PER_STEP = {"walking": 0.8, "running": 1.0}
METERS_PER_MINUTE = {"on_bicycle": 250.0}
OTHER_STEPS_PER_MINUTE = 10
OTHER_METERS_PER_MINUTE = 10.0


def import_label(kind: Column) -> Column:
    return F.coalesce(lookup(IMPORT_LABELS, kind), kind)


def status_label(status: Column) -> Column:
    return F.coalesce(lookup(STATUS_LABELS, status), F.lit("Unknown"))


def duration_label(seconds: Column) -> Column:
    """``2h 5m`` from one hour up, else ``5 min``; empty when unknown."""
    hours = F.floor(seconds / 3600).cast("long")
    minutes = F.floor(F.pmod(seconds, F.lit(3600)) / 60).cast("long")
    text = F.when(
        hours > 0, F.concat(hours.cast("string"), F.lit("h "), minutes.cast("string"), F.lit("m"))
    ).otherwise(F.concat(minutes.cast("string"), F.lit(" min")))
    return F.coalesce(text, F.lit(""))


def visit_duration_label(seconds: Column) -> Column:
    return F.when(seconds.isNull(), "").otherwise(F.concat(F.lit("Duration: "), duration_label(seconds)))


def distance_label(meters: Column) -> Column:
    """Kilometers with one decimal from 1000 m up, else whole meters."""
    km = F.concat(F.format_string("%.1f", meters / 1000), F.lit(" km"))
    m = F.concat(F.floor(meters + 0.5).cast("long").cast("string"), F.lit(" m"))
    return F.coalesce(F.when(meters >= 1000, km).otherwise(m), F.lit(""))


def file_size_label(size: Column) -> Column:
    kb, mb = 1024, 1024 * 1024
    return (
        F.when(size < kb, F.concat(size.cast("string"), F.lit(" bytes")))
        .when(size < mb, F.concat(F.format_string("%.1f", size / kb), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.1f", size / mb), F.lit(" MB")))
    )


def trip_title(start: Column) -> Column:
    return F.coalesce(
        F.concat(F.lit("Trip on "), F.date_format(start, "MMMM d, yyyy")), F.lit("Untitled Trip")
    )


def date_label(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "M/d/yyyy"), F.lit("N/A"))


def date_time_label(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "M/d/yyyy, h:mm:ss a"), F.lit("N/A"))


def time_label(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "hh:mm a"), F.lit(""))


def confidence_level(name: Column) -> Column:
    return F.coalesce(lookup(CONFIDENCE_LEVELS, name), F.lit(0))


def motion_type(flags: Column) -> Column:
    """Type of a motion sample from its flags, first set flag in priority order."""
    order = [
        ("stationary", "still"), ("walking", "walking"), ("running", "running"),
        ("automotive", "in_vehicle"), ("cycling", "on_bicycle"),
    ]
    return F.coalesce(*[F.when(flags[f], F.lit(v)) for f, v in order], F.lit("unknown"))


def estimated_steps(kind: Column, minutes: Column) -> Column:
    per_minute = F.coalesce(lookup(STEPS_PER_MINUTE, kind), F.lit(OTHER_STEPS_PER_MINUTE))
    return (per_minute * minutes).cast("long")


def estimated_distance(kind: Column, minutes: Column) -> Column:
    """Meters; NULL for vehicles, where no estimate is reliable."""
    on_foot = lookup(METERS_PER_STEP, kind) * estimated_steps(kind, minutes)
    per_minute = F.coalesce(lookup(METERS_PER_MINUTE, kind), F.lit(OTHER_METERS_PER_MINUTE))
    return F.when(kind == "in_vehicle", F.lit(None)).otherwise(F.coalesce(on_foot, per_minute * minutes))
