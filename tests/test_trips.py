import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayloom.operators import movement, trips
from wayloom.operators.movement import np_haversine

SCHEMA = "user_id long, t long, event_id long, lat double, lon double"
METER = 1 / 111194.93


def points(spark, rows):
    return spark.createDataFrame([(u, t, k, lat, lon) for k, (u, t, lat, lon) in enumerate(rows)], SCHEMA)


def test_gap_boundary(spark):
    df = points(spark, [(1, 0, 0.0, 0.0), (1, 900, 0.01, 0.0), (1, 1801, 0.02, 0.0), (1, 1802, 0.03, 0.0)])
    got = trips.trips(trips.trip_points(df)).orderBy("start_t").select("start_t", "end_t", "n_points").collect()
    assert [tuple(r) for r in got] == [(0, 900, 2), (1801, 1802, 2)]


def test_visit_boundary_and_single_points(spark):
    near, far = 49.9 * METER, 50.1 * METER
    rows = [(1, 0, 0.0, 0.0), (1, 10, 0.01, 0.0), (1, 910, 0.01 + near, 0.0), (1, 920, 0.0, 0.0)]
    rows += [(2, 0, 0.0, 0.0), (2, 10, 0.01, 0.0), (2, 910, 0.01 + far, 0.0), (2, 920, 0.0, 0.0), (3, 5, 0.0, 0.0)]
    df = points(spark, rows)
    found = trips.trips(trips.trip_points(df)).orderBy("user_id", "start_t").select("user_id", "start_t", "end_t").collect()
    assert [tuple(r) for r in found] == [(1, 0, 10), (1, 910, 920), (2, 0, 920)]
    visits = trips.visits_exact(df).select("user_id", "arrival_t", "departure_t", "lat").collect()
    assert [tuple(r) for r in visits] == [(1, 10, 910, 0.01)]


def test_points_are_kept(spark):
    rnd = random.Random(1)
    rows = [(rnd.randrange(4), rnd.randrange(40_000), rnd.random() * 0.01, 0.0) for _ in range(300)]
    df = points(spark, rows)
    cut = trips.trip_points(df)
    in_trips = trips.numbered_trip_points(cut).count()
    singles = cut.groupBy(*trips.TRIP_KEY).count().filter("count = 1").count()
    assert in_trips + singles == 300


def test_long_lines_are_cut_in_parts(spark):
    df = points(spark, [(1, k, k * 0.001, 0.0) for k in range(25)])
    parts = trips.trip_lines(trips.numbered_trip_points(trips.trip_points(df)), 10).orderBy("part").collect()
    assert [len(p.points) for p in parts] == [10, 10, 5]
    assert [round(q.y, 3) for p in parts for q in p.points] == [round(k * 0.001, 3) for k in range(25)]


def test_upsert_keeps_old_values(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id long, s string, n string")
    new = spark.createDataFrame([(2, None, "y"), (3, "c", None)], "id long, s string, n string")
    got = trips.trip_upsert(old, new, ["id"]).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "a", "x"), (2, "b", "y"), (3, "c", None)]


def brute_minute_order(rows):
    """rows of one user: (t, id, lat, lon) → ids in emitted order."""
    out, last, minutes = [], None, {}
    for r in sorted(rows):
        minutes.setdefault(r[0] // 60, []).append(r)
    for m in sorted(minutes):
        pts = minutes[m]
        if len(pts) > 1 and last is not None:
            pts = sorted(pts, key=lambda p: round(np_haversine(last[2], last[3], p[2], p[3]), 6))
        out += [(m, k + 1, p[1]) for k, p in enumerate(pts)]
        last = pts[-1]
    return out


def test_minute_order_equals_brute_force(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rnd = random.Random(5)
    rows = [(u, rnd.randrange(3000), rnd.random() * 0.1, rnd.random() * 0.1) for u in range(3) for _ in range(90)]
    df = points(spark, rows)
    got = movement.order_within_minutes(df, 600).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for u in range(3):
        mine = [(t, k, lat, lon) for k, (v, t, lat, lon) in enumerate(rows) if v == u]
        assert sorted((r.minute, r.pos, r.event_id) for r in got if r.user_id == u) == sorted(brute_minute_order(mine))


@pytest.mark.parametrize("slice_minutes", [1, 3, 10_000])
def test_minute_order_of_one_long_run_is_many_slices(spark, slice_minutes):
    rnd = random.Random(7)
    # Users with several points in every minute: no minute starts a run of its own. Equal places are ties.
    rows = [(u, 60 * m - 1200 + rnd.randrange(60), rnd.randrange(9) * 0.01, rnd.randrange(9) * 0.01) for u in range(2) for m in range(40) for _ in range(rnd.randrange(2, 6))]
    df = points(spark, rows).withColumn("event_id", F.col("event_id") + 2**60)
    got = movement.order_within_minutes(df, 600, slice_minutes).collect()
    for u in range(2):
        mine = [(t, k + 2**60, lat, lon) for k, (v, t, lat, lon) in enumerate(rows) if v == u]
        assert sorted((r.minute, r.pos, r.event_id) for r in got if r.user_id == u) == sorted(brute_minute_order(mine))


def test_thinning_equals_brute_force(spark):
    rnd = random.Random(9)
    rows, lat = [], 0.0
    for k in range(300):
        lat += rnd.choice([2, 4, 9, 11, 30]) * METER * rnd.choice([1, -1])
        rows.append((k % 2, k * 100, lat, 0.0))
    df = points(spark, rows)
    got = {r.event_id for r in movement.thin_by_distance(df, 10.0, 1000).filter("kept").collect()}
    want = set()
    for u in (0, 1):
        anchor = None
        for k, (v, _t, a, o) in enumerate(rows):
            if v == u and (anchor is None or np_haversine(anchor[0], anchor[1], a, o) >= 10.0):
                anchor = (a, o)
                want.add(k)
    assert got == want


def test_activity_records(spark):
    samples = [
        (1, 0, 0, "walking", 50), (1, 100, 1, "walking", 60), (1, 300, 2, "walking", 60), (1, 301, 3, "walking", 60),
        (1, 310, 4, "walking", 85), (1, 320, 5, "still", 85), (1, 900, 6, "still", 85),
    ]
    df = spark.createDataFrame(samples, "user_id long, t long, event_id long, type string, confidence int")
    got = movement.activity_segments(df, slice_seconds=200).orderBy("start_t").collect()
    assert [(r.start_t, r.end_t, r.type, r.confidence, r.n_samples) for r in got] == [
        (0, 301, "walking", 50, 3), (301, 310, "walking", 60, 1), (310, 320, "walking", 85, 1),
        (320, 900, "still", 85, 1), (900, None, "still", 85, 1),
    ]


def test_numpy_and_column_distance_agree(spark):
    from wayloom.functions.geo import haversine

    rnd = random.Random(2)
    rows = [tuple(rnd.uniform(-80, 80) for _ in range(4)) for _ in range(50)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = df.select("a", "b", "c", "d", haversine(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("m")).collect()
    assert all(np.isclose(r.m, np_haversine(r.a, r.b, r.c, r.d), rtol=1e-12) for r in got)
