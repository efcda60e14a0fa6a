"""Ingest messages: one nested message holds locations, activities, visits and its source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.functions import parse


def locations(messages: DataFrame, compat: bool = False) -> DataFrame:
    exploded = messages.select("batch_id", "user_id", F.explode("locations").alias("l"))
    flat = exploded.select("batch_id", "user_id", "l.*").withColumn(
        "date_time", parse.civil_to_timestamp(F.col("date_time"), compat)
    )
    return parse.zero_to_null(flat)


def activities(messages: DataFrame, compat: bool = False) -> DataFrame:
    exploded = messages.select("batch_id", "user_id", F.explode("activities").alias("a"))
    return exploded.select(
        "batch_id",
        "user_id",
        parse.stored_activity_type(F.col("a.type")).alias("type"),
        F.col("a.confidence").alias("confidence"),
        parse.civil_to_timestamp(F.col("a.start"), compat).alias("start_date_time"),
        parse.civil_to_timestamp(F.col("a.end"), compat).alias("end_date_time"),
        F.col("a.step_count").alias("step_count"),
        F.col("a.distance").alias("distance"),
    )


def visits(messages: DataFrame, compat: bool = False) -> DataFrame:
    exploded = messages.select("batch_id", "user_id", F.explode("visits").alias("v"))
    return exploded.select(
        "batch_id",
        "user_id",
        F.col("v.latitude").alias("latitude"),
        F.col("v.longitude").alias("longitude"),
        F.nullif(F.col("v.horizontal_accuracy"), F.lit(0.0)).alias("horizontal_accuracy"),
        parse.civil_to_timestamp(F.col("v.arrival"), compat).alias("arrival"),
        parse.civil_to_timestamp(F.col("v.departure"), compat).alias("departure"),
        parse.empty_to_null(F.col("v.canonical_label")).alias("canonical_label"),
        parse.empty_to_null(F.col("v.external_place_id")).alias("external_place_id"),
    )


def batch_rows(messages: DataFrame) -> DataFrame:
    """One row per message with its source as JSON text."""
    return messages.select(
        "batch_id",
        "user_id",
        parse.civil_to_timestamp(F.col("date_time")).alias("batch_date_time"),
        parse.source_json(F.col("source")).alias("source_info"),
    )


def packets(events: DataFrame, key: str, time_col: str, order: list[str], size: int = 50, slice_seconds: int = 86400) -> DataFrame:
    """Number each key's events in order and cut them into packets of ``size``."""
    from wayloom.operators.sequence import running_total

    numbered = running_total(events, key, time_col, order, {"_n": F.lit(1)}, slice_seconds)
    return numbered.withColumn("packet", F.floor((F.col("_n") - 1) / size).cast("long")).drop("_n")
