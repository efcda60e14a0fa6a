"""Stored routes and way constraints against plain versions."""

import random

import pytest

from wayloom.operators import constraints
from wayloom.operators.reprocess import ROUTE, RouteStore
from wayloom.session import scratch_path

RESULT = "trip_id string, match_status string, notes string, osm_way_ids string, min_lon double, min_lat double, max_lon double, max_lat double"


def result(trip, run, ok):
    if not ok:
        return (trip, "no_route", f"run {run} failed", None, None, None, None, None)
    return (trip, "matched", None, f"[{run}]", 1.0 * run, 2.0, 3.0, 4.0)


def put(spark, store, run_id, rows):
    made = spark.createDataFrame(rows, RESULT)
    store.put(run_id, made, made.selectExpr("trip_id", "match_status AS outcome"))


def apply(stored, version, rows):
    for r in rows:
        before = stored.get(r[0], (True, None, *[None] * len(ROUTE), 0))
        route = r[3:] if r[1] == "matched" else before[2:-1]
        stored[r[0]] = (True, r[2], *route, version)


def table(store):
    return {r.trip_id: (r.processed, r.notes, *[r[c] for c in ROUTE], r.version) for r in store.read().collect()}


@pytest.fixture
def store(spark):
    return RouteStore(spark, scratch_path(spark, "routes"), buckets=5)


def test_only_chosen_trips_change(spark, store):
    rnd, want = random.Random(3), {}
    assert table(store) == {}
    for run in range(1, 4):
        trips = [f"t{k}" for k in range(30)] if run == 1 else [f"t{k}" for k in rnd.sample(range(35), 6)]
        rows = [result(t, run, rnd.random() < 0.7) for t in trips]
        put(spark, store, f"run/{run}", rows)
        apply(want, run, rows)
        assert table(store) == want
    assert store.runs() == {"run/1": 1, "run/2": 2, "run/3": 3}
    # A store opened with another number of buckets goes on with its own.
    rows = [result(f"t{k}", 4, True) for k in range(0, 30, 7)]
    put(spark, RouteStore(spark, store.root, buckets=9), "later", rows)
    apply(want, 4, rows)
    assert table(store) == want


def test_other_buckets_are_not_written(spark, store):
    put(spark, store, "all", [result(f"t{k}", 1, True) for k in range(30)])
    put(spark, store, "one", [result("t3", 2, True)])
    assert sorted(store._held().values()) == [1, 1, 1, 1, 2]


def test_a_broken_run_shows_nothing_and_is_run_again(spark, store, monkeypatch):
    put(spark, store, "all", [result(f"t{k}", 1, True) for k in range(12)])
    before = table(store)
    with monkeypatch.context() as m:
        m.setattr(RouteStore, "_close", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            put(spark, store, "two", [result("t3", 7, True), result("t4", 7, True)])
    assert table(store) == before
    rows = [result("t3", 2, True), result("t4", 2, False)]
    put(spark, store, "two", rows)
    apply(before, 2, rows)
    assert table(store) == before
    # A complete run is not run again.
    put(spark, store, "two", [result("t3", 9, True)])
    assert table(store) == before
    assert {r.trip_id: r.outcome for r in store.replies("two").collect()} == {"t3": "matched", "t4": "no_route"}


def test_an_empty_run(spark, store):
    put(spark, store, "none", [])
    assert table(store) == {}
    put(spark, store, "all", [result("t1", 2, True)])
    put(spark, store, "none again", [])
    assert list(table(store)) == ["t1"]


def test_way_constraints(spark):
    segs = spark.createDataFrame([(1, 10), (2, 10), (3, 20), (4, 30)], "segment_id long, way_id long")
    wins = spark.createDataFrame([("a", 0, 0, 1), ("a", 1, 1, 2)], "trip_id string, window_idx long, start_idx long, end_idx long")
    cands = spark.createDataFrame([("a", 0, 1), ("a", 1, 1), ("a", 1, 2), ("a", 1, 3), ("a", 2, 3)], "trip_id string, point_idx long, segment_id long")

    def held(*rows):
        asked = spark.createDataFrame([("a", *r) for r in rows], "trip_id string, point_idx long, seq int, segment_id long")
        return sorted((r.window_idx, r.pos, r.segment_id) for r in constraints.way_constraints(wins, asked, cands, segs).collect())

    both = [(0, 1, 1), (0, 1, 2), (1, 0, 1), (1, 0, 2)]
    assert held((1, 0, 2)) == both
    assert held((1, 0, 2), (1, 1, 3)) == [(0, 1, 3), (1, 0, 3)]
    # Later constraints that no candidate meets, and unknown segments, are ignored.
    assert held((1, 0, 1), (1, 1, 4), (1, 2, 99)) == both
    assert held((2, 0, 1), (0, 0, 4)) == []
