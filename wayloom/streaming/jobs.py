"""Streaming forms of ingest and trip building."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wayloom.config import TRIPS, TripConfig
from wayloom.operators import trips
from wayloom.operators.sequence import assign_sessions
from wayloom.session import scratch_path


def sessions(points: DataFrame, gap_seconds: int = 900, lateness: str = "10 minutes") -> DataFrame:
    """Trips as session windows per user. ``points`` has user_id and ts on whole seconds.

    Points exactly a gap apart stay together, as in the batch rule. A session is emitted when
    the watermark passes its end; the newest ones stay open. Rows later than that are dropped by the
    engine; ``StoredSessions`` keeps them.
    """
    return (
        points.withWatermark("ts", lateness)
        .groupBy("user_id", F.session_window("ts", f"{gap_seconds} seconds").alias("w"))
        .agg(F.count(F.lit(1)).alias("n_points"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
        .select("user_id", "n_points", F.unix_timestamp("start_ts").alias("start_t"), F.unix_timestamp("end_ts").alias("end_t"))
    )


def deduplicated(points: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Each (user, second) once, however often it is sent within the lateness. Rows later than that are
    dropped by the engine; ``StoredPoints`` keeps them."""
    return points.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["user_id", "t"])


def user_totals(points: DataFrame) -> DataFrame:
    """Running state per user."""
    return points.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_points"), F.max("t").alias("last_t"))


def start(df: DataFrame, path: str, checkpoint: str, every: str | None = None, mode: str = "append") -> StreamingQuery:
    """Write a stream as Parquet: on a timer (``every``, such as "5 minutes"), else all that is
    available now. One run at a time is given by the engine."""
    writer = df.writeStream.option("checkpointLocation", checkpoint).outputMode(mode)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.format("parquet").start(path)


def start_batches(df: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None, mode: str = "append") -> StreamingQuery:
    """Run ``step(rows, batch_id)`` per micro-batch. Steps write under their batch id, so a
    repeated batch replaces its own output and counts once."""
    writer = df.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).foreachBatch(step)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def run_to_table(df: DataFrame, name: str) -> DataFrame:
    """Drain what is available into a fresh table of the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    start(df, path, scratch_path(spark, f"{name}-offsets")).awaitTermination()
    return spark.read.parquet(path)


def run_snapshot(df: DataFrame, name: str) -> DataFrame:
    """Drain a complete-mode aggregation; the last snapshot is the result."""
    spark = df.sparkSession
    path = scratch_path(spark, name)

    def step(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    start_batches(df, step, scratch_path(spark, f"{name}-offsets"), mode="complete").awaitTermination()
    newest = spark.read.parquet(path)
    last = newest.agg(F.max("batch").alias("batch"))
    return newest.join(F.broadcast(last), "batch").drop("batch")


class StoredPoints:
    """Points over micro-batches, each (user, second) once, however late it comes or is sent again.

    A batch is compared with what is stored of its own days, which the folders single out, so no row is lost
    to a watermark and no state grows. Of equal points in a batch the smallest event id stays. A batch
    writes under its id and doesn't look at that folder, so a retried batch gives the same table.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _stored(self, batch_id: int, columns: str) -> DataFrame | None:
        """Points of all batches before."""
        if batch_id == 0:
            return None
        schema = f"{columns}, batch int, event_date date"
        return self.spark.read.schema(schema).parquet(f"{self.path}/points").filter(F.col("batch") < batch_id)

    def step(self, rows: DataFrame, batch_id: int) -> None:
        others = [c for c in rows.columns if c not in ("user_id", "t", "event_id")]
        one = rows.groupBy("user_id", "t").agg(F.min(F.struct("event_id", *others)).alias("p"))
        new = one.select("user_id", "t", "p.*").withColumn("event_date", F.to_date(F.timestamp_seconds("t")))
        seen = self._stored(batch_id, "user_id long, t long")
        if seen is not None:
            days = new.select("event_date").distinct()
            seen = seen.join(F.broadcast(days), "event_date", "left_semi")
            new = new.join(seen, ["event_date", "user_id", "t"], "left_anti")
        new.write.mode("overwrite").partitionBy("event_date").parquet(f"{self.path}/points/batch={batch_id}")

    def run(self, stream: DataFrame, every: str | None = None) -> StreamingQuery:
        return start_batches(stream, self.step, f"{self.path}/offsets", every)

    def points(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/points").drop("batch", "event_date")


class StoredSessions:
    """Session windows over micro-batches, with every point however late it comes.

    A batch adds its points to the stored ones, counted by user and second, and sessions are cut from all that
    is stored, so a late point lengthens or joins the sessions it touches. A batch writes under its id, so a
    retried batch gives the same table.
    """

    def __init__(self, spark: SparkSession, path: str, cfg: TripConfig = TRIPS):
        self.spark, self.path, self.cfg = spark, path, cfg

    def step(self, rows: DataFrame, batch_id: int) -> None:
        counted = rows.filter("t is not null").groupBy("user_id", "t").agg(F.count(F.lit(1)).alias("n"))
        counted.write.mode("overwrite").parquet(f"{self.path}/points/batch={batch_id}")

    def run(self, stream: DataFrame, every: str | None = None) -> StreamingQuery:
        return start_batches(stream, self.step, f"{self.path}/offsets", every)

    def closed(self, gap_seconds: int = 900, lateness_seconds: int = 600) -> DataFrame:
        """Sessions whose end and gap lie ``lateness_seconds`` or more before the newest point. Points
        exactly a gap apart stay together, as in the batch rule."""
        points = self.spark.read.parquet(f"{self.path}/points").groupBy("user_id", "t").agg(F.sum("n").alias("n"))
        newest = points.agg(F.max("t").alias("newest"))
        # Points without a user are one user's, as in a grouping.
        user = F.coalesce(F.concat(F.lit("="), F.col("user_id").cast("string")), F.lit("-"))
        cut = assign_sessions(
            points.withColumn("u", user), "u", "t", ["t"], ["t"], lambda p, c: c.t - p.t > gap_seconds, self.cfg.slice_seconds
        )
        found = cut.groupBy("user_id", "session_start").agg(
            F.sum("n").alias("n_points"), F.min("t").alias("start_t"), F.max("t").alias("end_t")
        )
        over = found.join(F.broadcast(newest), F.col("end_t") + gap_seconds <= F.col("newest") - lateness_seconds)
        return over.select("user_id", "n_points", "start_t", "end_t")


class LiveTrips:
    """Trips over micro-batches with the visit rule and distances.

    Each batch joins the new points to the open tail (points of each user's last trip so far),
    cuts trips with the batch operators, appends all but each user's last trip and keeps that
    one's points as the new tail. Outputs are written under the batch id, and a batch reads the
    tail of the batch before it, so a retried batch gives the same tables.
    """

    def __init__(self, spark: SparkSession, path: str, cfg: TripConfig = TRIPS):
        self.spark, self.path, self.cfg = spark, path, cfg

    POINTS = "user_id long, t long, event_id long, lat double, lon double"

    def tail(self, batch_id: int) -> DataFrame:
        if batch_id < 0:
            return self.spark.createDataFrame([], self.POINTS)
        return self.spark.read.schema(self.POINTS).parquet(f"{self.path}/tail/{batch_id}")

    def step(self, rows: DataFrame, batch_id: int) -> None:
        fields = ["user_id", "t", "event_id", "lat", "lon"]
        points = self.tail(batch_id - 1).select(fields).unionByName(rows.select(fields))
        work = f"{self.path}/points/{batch_id}"
        trips.trip_points(points, self.cfg).write.mode("overwrite").parquet(work)
        cut = self.spark.read.parquet(work)
        last = cut.groupBy("user_id").agg(F.max(F.struct("trip_start_t", "trip_start_id")).alias("last"))
        is_last = F.struct("trip_start_t", "trip_start_id") == F.col("last")
        marked = cut.join(last, "user_id")
        trips.trips(marked.filter(~is_last).drop("last"), self.cfg).write.mode("overwrite").parquet(
            f"{self.path}/trips/batch={batch_id}"
        )
        marked.filter(is_last).select(fields).write.mode("overwrite").parquet(f"{self.path}/tail/{batch_id}")

    def run(self, stream: DataFrame, every: str | None = None) -> StreamingQuery:
        return start_batches(stream, self.step, f"{self.path}/offsets", every)

    def closed(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/trips").drop("batch")


def for_user(stream: DataFrame, user_id) -> DataFrame:
    """On-demand run for one user: the same job over a filtered stream."""
    return stream.filter(F.col("user_id") == user_id)
