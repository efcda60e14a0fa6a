import datetime
import json
import os
import time

from pyspark.sql import functions as F

import __spark_entry__ as entry
from wayloom.functions import labels, parse
from wayloom.sources import device, osm, sinks
from wayloom.streaming import jobs

QUERIES = entry.queries()


def values(spark, rows, schema, col):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_parsers(spark):
    geo = values(spark, [("geo:-22.9,-43.2",), ("geo:x,1",), ("-22.9,-43.2",), ("geo:1",)], "s string", parse.geo_uri(F.col("s")))
    assert [None if g is None else tuple(g) for g in geo] == [(-22.9, -43.2), None, None, None]
    speed = values(spark, [("30 mph",), ("50 km/h",), ("60",), ("walk",), ("x mph",)], "s string", parse.max_speed_kmh(F.col("s")))
    assert [None if s is None else round(s, 4) for s in speed] == [48.2802, 50.0, 60.0, None, None]
    conf = values(spark, [("0.755",), ("n/a",), ("1",)], "s string", parse.confidence_percent(F.col("s")))
    assert conf == [76, 0, 100]
    kinds = values(spark, [("Cycling",), ("DRIVING",), ("swim",)], "s string", parse.activity_type(F.col("s")))
    assert kinds == ["on_bicycle", "in_vehicle", "unknown"]


def test_civil_time(spark):
    schema = "c struct<year:int,month:int,day:int,hours:int,minutes:int,seconds:int,nanos:int,utc_offset_seconds:long,time_zone:string>"
    rows = [((2024, 1, 1, 8, 0, 0, 500000000, -10800, None),), ((2024, 1, 1, 8, 0, 0, 0, None, "America/Sao_Paulo"),)]
    got = values(spark, rows, schema, F.unix_timestamp(parse.civil_to_timestamp(F.col("c"))))
    assert got == [1704106800, 1704106800]
    compat = values(spark, rows[:1], schema, F.unix_timestamp(parse.civil_to_timestamp(F.col("c"), compat=True)))
    assert compat == [1704096000]


def test_labels(spark):
    assert values(spark, [(59,), (3600,), (7500,), (None,)], "s long", labels.duration_label(F.col("s"))) == ["0 min", "1h 0m", "2h 5m", ""]
    assert values(spark, [(999.4,), (1234.0,)], "m double", labels.distance_label(F.col("m"))) == ["999 m", "1.2 km"]


def test_road_scan(spark):
    ways = spark.createDataFrame(
        [(1, [1, 2], {"highway": "motorway"}), (2, [1, 2], {"highway": "footway"}), (3, [1], {"highway": "primary"}),
         (4, [1, 2, 3], {"highway": "service", "oneway": "1", "maxspeed": "20 mph", "layer": "x", "access": "private"})],
        "id long, refs array<long>, tags map<string,string>",
    )
    got = {r.way_id: r for r in osm.road_ways(ways).collect()}
    assert set(got) == {1, 4} and got[1].is_oneway and got[4].is_oneway and got[4].is_private and got[4].layer == 0
    assert osm.way_nodes(osm.road_ways(ways)).count() == 5


def test_device_files_and_quarantine(spark, tmp_path):
    good = {"latitude": 1.0, "longitude": 2.0, "accuracy": -1.0, "speed": 3.0, "timestamp": "2024-01-01T00:00:00Z", "batteryLevel": -1}
    (tmp_path / "a.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text("{broken")
    old = time.time() - 3 * 86400
    os.utime(tmp_path / "b.json", (old, old))
    raw = device.read_raw(spark, str(tmp_path)).cache()
    pts = device.points(raw).collect()
    assert len(pts) == 1 and pts[0].horizontal_accuracy is None and pts[0].battery_level is None and pts[0].speed == 3.0
    aside = device.quarantine(raw, datetime.datetime.now(datetime.timezone.utc)).collect()
    assert len(aside) == 1 and aside[0].file_path.endswith("b.json")
    assert device.read_points(spark, str(tmp_path), stream=True).isStreaming


def test_append_by_day(spark, tmp_path):
    df = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1)), (2, datetime.datetime(2024, 1, 2))], "id long, date_time timestamp")
    path = str(tmp_path / "events")
    sinks.append_events(df, path, "date_time")
    sinks.append_events(df, path, "date_time")
    back = spark.read.parquet(path)
    assert back.count() == 4 and back.filter("event_date = '2024-01-01'").count() == 2


def test_live_trips_over_batches_equal_batch_trips(spark, tmp_path):
    import random

    from wayloom.operators import trips

    rnd = random.Random(6)
    rows, t = [], 0
    for k in range(240):
        t += rnd.choice([30, 60, 400, 900, 1000])
        rows.append((k % 3, t, k, rnd.random() * 0.01, 0.0))
    schema = "user_id long, t long, event_id long, lat double, lon double"
    src = tmp_path / "in"
    for n in range(4):
        part = rows[n * 60 : (n + 1) * 60]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    live = jobs.LiveTrips(spark, str(tmp_path / "live"))
    live.run(stream).awaitTermination()
    cut = trips.trip_points(spark.createDataFrame(rows, schema))
    all_trips = {(r.user_id, r.start_t, r.end_t, r.n_points) for r in trips.trips(cut).collect()}
    last = {r.user_id: r.s for r in cut.groupBy("user_id").agg(F.max("trip_start_t").alias("s")).collect()}
    want = {x for x in all_trips if x[1] != last[x[0]]}
    assert {(r.user_id, r.start_t, r.end_t, r.n_points) for r in live.closed().collect()} == want


def test_streams_read_a_folder_of_part_files_in_any_order(spark, tmp_path):
    """120 files, so two micro-batches, each file with points of all times."""
    rows = [(k, k % 5, 86_400 + 400 * k + 3000 * (k // 40)) for k in range(600)]
    table = spark.createDataFrame(rows, "event_id long, user_id long, t long").withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz"))
    table.drop("t").repartition(120, "event_id").write.option("maxRecordsPerFile", 4).parquet(str(tmp_path / "events.parquet"))
    assert len(list((tmp_path / "events.parquet").glob("part-*"))) > 100
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    assert sorted((r.user_id, r.t) for r in run("stream_dedup")) == sorted((u, t) for _, u, t in rows)
    last = {u: t for _, u, t in rows}
    assert sorted(tuple(r) for r in run("stream_user_state")) == [(u, 120, last[u]) for u in range(5)]
    assert [tuple(r) for r in run("stream_one_user")] == [(0, 120, last[0])]
    assert run("stream_live_trips") is not None
    # For sessions of several points, a third of the time between them.
    close = spark.createDataFrame([(e, u, 86_400 + (t - 86_400) // 3) for e, u, t in rows], "event_id long, user_id long, t long")
    close = close.withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz")).drop("t")
    close.repartition(120, "event_id").write.option("maxRecordsPerFile", 4).mode("overwrite").parquet(str(tmp_path / "b" / "events.parquet"))
    want, newest = [], 86_400 + (max(t for _, _, t in rows) - 86_400) // 3
    for user in range(5):
        ts = sorted(86_400 + (t - 86_400) // 3 for _, u, t in rows if u == user)
        cut = [0] + [k for k in range(1, len(ts)) if ts[k] - ts[k - 1] > 900] + [len(ts)]
        want += [(user, b - a, ts[a], ts[b - 1]) for a, b in zip(cut, cut[1:]) if ts[b - 1] + 900 <= newest - 600]
    got = QUERIES["stream_sessions"](spark, str(tmp_path / "b")).select("user_id", "n_points", "start_t", "end_t").collect()
    assert sorted(tuple(r) for r in got) == sorted(want) and len(want) > 20


def test_points_sent_late_or_again_are_kept_once(spark, tmp_path):
    """Three files: points, the same ones hours late with new ones between, and all of them again."""
    src = tmp_path / "src"
    schema = "event_id long, user_id long, t long, lat double"
    day = 86_400
    first = [(k, k % 3, 5 * day + 60 * k, 1.0) for k in range(40)]
    late = [(100 + k, k % 3, 60 * k + k % 2, 2.0) for k in range(40)] + [(500, 1, 5 * day + 60, 9.0)]
    for n, rows in enumerate([first, late, first + late + [(7, 2, 11, 3.0), (6, 2, 11, 4.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    stored = jobs.StoredPoints(spark, str(tmp_path / "stored"))
    stored.run(stream).awaitTermination()
    got = sorted((r.user_id, r.t, r.event_id) for r in stored.points().collect())
    want = {}
    for e, u, t, _ in [*first, *late, (6, 2, 11, 4.0)]:
        want.setdefault((u, t), e)
    assert got == sorted((u, t, e) for (u, t), e in want.items())
    # A batch that runs again replaces its own rows only.
    stored.step(spark.createDataFrame(late, schema), 1)
    assert sorted((r.user_id, r.t, r.event_id) for r in stored.points().collect()) == got
