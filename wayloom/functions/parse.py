"""Parsing and cleaning of incoming values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.functions.roads import lookup

# Activity names of timeline exports, lower case.
ACTIVITY_NAMES = {
    "still": "still", "walking": "walking", "running": "running", "on_bicycle": "on_bicycle",
    "cycling": "on_bicycle", "in_vehicle": "in_vehicle", "driving": "in_vehicle", "on_foot": "on_foot",
}
# Activity types of the stored schema.
ACTIVITY_TYPES = [
    "unknown", "still", "walking", "running", "in_vehicle", "on_bicycle", "on_foot", "tilting",
]
# Optional numeric fields of a location whose zero means "missing".
ZERO_IS_MISSING = [
    "altitude", "horizontal_accuracy", "vertical_accuracy", "speed_accuracy",
    "bearing_accuracy", "speed", "bearing", "floor_level", "battery_level",
]
# Sensor readings that are invalid below zero.
NEGATIVE_IS_INVALID = [
    "horizontal_accuracy", "vertical_accuracy", "speed", "speed_accuracy", "bearing", "bearing_accuracy",
]
MPH_TO_KMH = 1.60934


def activity_type(name: Column) -> Column:
    """Activity name with synonyms, any case → stored type; anything else is unknown."""
    return F.coalesce(lookup(ACTIVITY_NAMES, F.lower(name)), F.lit("unknown"))


def stored_activity_type(name: Column) -> Column:
    return F.when(name.isin(*ACTIVITY_TYPES), name).otherwise("unknown")


def confidence_percent(probability: Column) -> Column:
    """Probability text → whole percent, half away from zero; bad text is 0."""
    return F.coalesce(F.round(probability.try_cast("double") * 100), F.lit(0.0)).cast("int")


def geo_uri(text: Column) -> Column:
    """``geo:lat,lon`` → ``struct<lat, lon>``; NULL when malformed."""
    parts = F.split(F.regexp_replace(text, "geo:", ""), ",")
    lat = F.get(parts, F.lit(0)).try_cast("double")
    lon = F.get(parts, F.lit(1)).try_cast("double")
    ok = text.startswith("geo") & lat.isNotNull() & lon.isNotNull()
    return F.when(ok, F.struct(lat.alias("lat"), lon.alias("lon")))


def plus_minutes(start: Column, minutes: Column) -> Column:
    """Timestamp plus a whole number of minutes given as text; NULL when it is no number."""
    return start + F.make_dt_interval(mins=minutes.try_cast("bigint").cast("int"))


def max_speed_kmh(raw: Column) -> Column:
    """``N mph``, ``N km/h`` or a plain number → km/h; NULL for anything else."""
    v = F.trim(raw)
    mph = F.regexp_replace(v, "( mph)+$", "").try_cast("double") * MPH_TO_KMH
    kmh = F.regexp_replace(v, "( km/h)+$", "").try_cast("double")
    return F.when(v.endswith(" mph"), mph).when(v.endswith(" km/h"), kmh).otherwise(v.try_cast("double"))


def civil_to_timestamp(c: Column, compat: bool = False) -> Column:
    """Civil time struct → instant: local fields minus the UTC offset, or read in the named
    zone. ``compat`` takes the local fields as UTC and ignores the offset."""
    seconds = c.seconds + c.nanos / F.lit(1e9)
    as_utc = F.make_timestamp(c.year, c.month, c.day, c.hours, c.minutes, seconds, F.lit("UTC"))
    if compat:
        return as_utc
    offset = F.coalesce(c.utc_offset_seconds, F.lit(0)).cast("int")
    by_offset = as_utc - F.make_dt_interval(secs=offset)
    return F.when(c.time_zone.isNotNull(), F.to_utc_timestamp(as_utc, c.time_zone)).otherwise(by_offset)


def timestamp_to_civil(ts: Column, utc_offset_seconds: Column | None = None) -> Column:
    """Instant → civil time struct with local fields and the offset."""
    offset = F.lit(None).cast("long") if utc_offset_seconds is None else utc_offset_seconds.cast("long")
    local = ts if utc_offset_seconds is None else ts + F.make_dt_interval(secs=offset.cast("int"))
    micros = F.pmod(F.unix_micros(local), F.lit(1_000_000))
    return F.struct(
        F.year(local).alias("year"),
        F.month(local).alias("month"),
        F.dayofmonth(local).alias("day"),
        F.hour(local).alias("hours"),
        F.minute(local).alias("minutes"),
        F.second(local).alias("seconds"),
        (micros * 1000).cast("int").alias("nanos"),
        offset.alias("utc_offset_seconds"),
        F.lit(None).cast("string").alias("time_zone"),
    )


def zero_to_null(df: DataFrame, columns: list[str] = ZERO_IS_MISSING) -> DataFrame:
    """Zero means "not given" in the listed columns that the table has."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: F.nullif(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in present})


def empty_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def drop_invalid_readings(df: DataFrame, columns: list[str] = NEGATIVE_IS_INVALID) -> DataFrame:
    """Negative accuracy, speed or course means the sensor had no value; battery −1 likewise."""
    present = [c for c in columns if c in df.columns]
    cleaned = df.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in present})
    if "battery_level" in df.columns:
        cleaned = cleaned.withColumn("battery_level", F.nullif(F.col("battery_level"), F.lit(-1)))
    return cleaned


def split_required(df: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by presence of all required columns; rejected names the first gap."""
    missing = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in required])
    marked = df.withColumn("reject_reason", missing)
    return (
        marked.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
        marked.filter(F.col("reject_reason").isNotNull()),
    )


def source_json(source: Column) -> Column:
    """The one filled member of the source union as JSON text with its type."""

    def member(name: str, fields: list[str]) -> Column:
        value = F.struct(F.lit(name).alias("type"), *[source[name][f].alias(f) for f in fields])
        return F.when(source[name].isNotNull(), F.to_json(value))

    return F.coalesce(
        member("app", ["app_version"]),
        member("web", ["web_version"]),
        member("api", ["api_version", "used_api_key"]),
        member("google_maps", ["version"]),
        member("apple_health", ["version"]),
        member("fitness_app", ["app_name", "app_version"]),
    )


def way_ids_to_json(ids: Column) -> Column:
    return F.to_json(ids)


def way_ids_from_json(text: Column) -> Column:
    return F.from_json(text, "array<bigint>")
