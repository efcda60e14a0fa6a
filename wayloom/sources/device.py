"""Device cache files: one JSON object per event, as files or as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.functions import parse
from wayloom.schema import DEVICE_ACTIVITY, DEVICE_EVENT


def read_raw(spark: SparkSession, path: str, schema=DEVICE_EVENT, stream: bool = False, files_per_trigger: int = 1000) -> DataFrame:
    """Permissive scan: unreadable objects end in ``_corrupt_record`` with the file's age."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger) if stream else spark.read
    raw = (
        reader.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
    )
    return raw.select(
        "*",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_modification_time").alias("file_time"),
    )


def points(raw: DataFrame) -> DataFrame:
    """Readable events as location rows: loose keys mapped, invalid readings dropped. A point
    without a time gets the time its file was written."""
    good = raw.filter(F.col("_corrupt_record").isNull())
    flat = good.select(
        F.coalesce("latitude", F.lit(0.0)).alias("latitude"),
        F.coalesce("longitude", F.lit(0.0)).alias("longitude"),
        "altitude",
        F.col("accuracy").alias("horizontal_accuracy"),
        F.col("verticalAccuracy").alias("vertical_accuracy"),
        F.col("speedAccuracy").alias("speed_accuracy"),
        F.col("headingAccuracy").alias("bearing_accuracy"),
        "speed",
        F.col("heading").alias("bearing"),
        F.coalesce(F.col("timestamp").try_cast("timestamp"), F.col("file_time")).alias("date_time"),
        F.col("isMockLocation").alias("is_mock_location"),
        F.col("floor").alias("floor_level"),
        F.col("batteryLevel").alias("battery_level"),
        F.col("networkType").alias("network_type"),
    )
    return parse.drop_invalid_readings(flat)


def activities(raw: DataFrame) -> DataFrame:
    good = raw.filter(F.col("_corrupt_record").isNull())
    return good.select(
        parse.stored_activity_type(F.col("type")).alias("type"),
        F.coalesce("confidence", F.lit(0)).alias("confidence"),
        F.col("startTime").try_cast("timestamp").alias("start_date_time"),
        F.col("endTime").try_cast("timestamp").alias("end_date_time"),
        F.col("stepCount").alias("step_count"),
        "distance",
    )


def quarantine(raw: DataFrame, now, max_age_seconds: int = 86400) -> DataFrame:
    """Unreadable events older than a day, to be moved aside; younger ones are tried again."""
    age = F.unix_timestamp(F.lit(now)) - F.unix_timestamp("file_time")
    return raw.filter(F.col("_corrupt_record").isNotNull() & (age > max_age_seconds)).select(
        "file_path", "file_time", "_corrupt_record"
    )


def read_points(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return points(read_raw(spark, path, DEVICE_EVENT, stream))


def read_activities(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return activities(read_raw(spark, path, DEVICE_ACTIVITY, stream))
