import random

import pytest
from pyspark.sql import functions as F

from plain_fold import TripFold, line_distance
from wayloom.functions import geo, roads
from wayloom.operators import matching
from wayloom.plans.inputs import Inputs


@pytest.fixture(scope="module")
def inputs(spark):
    return Inputs(spark, "/root/testdata/sf0.001")


def test_route_invariants(inputs):
    m = inputs.matched()
    lines = matching.route_lines(m.routes, inputs.segments())
    # Only a path's last step may point backward on a one-way road: its exit is the vertex
    # nearest to the point, wherever the road was entered.
    oneway = {r.segment_id for r in inputs.segments().filter("is_oneway").collect()}
    for p in m.paths.select("path").collect():
        assert all(x.segment_id not in oneway or x.entry_idx <= x.exit_idx for x in p.path[:-1])
    steps = lines.select("trip_id", "seq", "start_node", "end_node").orderBy("trip_id", "seq").collect()
    first_windows = {(r.trip_id, r.seq): r.window_idx for r in m.routes.collect()}
    for a, b in zip(steps, steps[1:]):
        same = a.trip_id == b.trip_id and first_windows[a.trip_id, a.seq] == first_windows[b.trip_id, b.seq]
        if same:
            assert a.end_node == b.start_node
    statuses = {r.match_status for r in m.status.collect()}
    assert statuses <= {"matched", "no_route", "no_candidates"} and "matched" in statuses
    assert m.status.count() == inputs.trip_points().select("trip_id").distinct().count()


def test_paths_respect_their_limits(inputs):
    assert inputs.matched().paths.filter("length_m > limit_m").count() == 0


def test_windows_and_splitting(spark):
    pts = spark.createDataFrame([("a", k) for k in range(4)] + [("b", 0)], "trip_id string, point_idx long")
    got = matching.windows(pts).orderBy("window_idx").collect()
    assert [(r.start_idx, r.end_idx, r.is_last) for r in got] == [(0, 1, False), (1, 2, False), (2, 3, True)]
    failed = spark.createDataFrame([("a", 0, 0, 5), ("a", 1, 0, 3)], "trip_id string, window_idx long, start_idx long, end_idx long")
    halves = matching.split_failed(failed).orderBy("half").collect()
    assert [(r.window_idx, r.start_idx, r.end_idx) for r in halves] == [(0, 0, 3), (0, 2, 5)]


def step(seg, d, x=0.0):
    return {"segment_id": seg, "entry_idx": 0, "exit_idx": 1, "d_start": d, "xs": [x, x + 0.001], "ys": [0.0, 0.0]}


def window(n, last, options, segs=(1, 2, 3), lon=0.0):
    return {"trip_id": "t", "window_idx": n, "start_idx": n, "end_idx": n + 1, "is_last": last, "lat": 0.0, "lon": lon, "first_segs": list(segs), "options": options}


def option(score, seg, bound, end, steps):
    return {"score": score, "from_rank": 1, "to_rank": 1, "from_seg": seg, "bound": bound, "end_seg": end, "steps": steps}


def test_fold_follows_the_constraint():
    fold = TripFold("t", 20.0, 150.0)
    a = [step(1, 0.0), step(2, 90.0, 0.001)]
    fold.add(window(0, False, [option(1.0, 1, True, 2, a), option(1.0, 1, False, 2, a)]))
    assert [s["segment_id"] for s in fold.route] == [1] and fold.fixed == 2
    # The cheaper option starts on another segment, but the window must continue on segment 2.
    b, c = [step(2, 0.0, 0.001), step(4, 100.0, 0.002)], [step(3, 0.0, 0.001)]
    fold.add(window(1, True, [option(0.5, 3, True, 3, c), option(2.0, 2, True, 4, b), option(0.5, 3, False, 3, c)], lon=0.001))
    assert fold.trace[-1]["from_seg"] == 2 and fold.trace[-1]["used_constraints"] and not fold.trace[-1]["bridge"]
    assert [s["segment_id"] for s in fold.route] == [1, 4]


def test_fold_bridges_when_the_constraint_fails():
    fold = TripFold("t", 20.0, 150.0)
    a = [step(1, 0.0)]
    fold.add(window(0, False, [option(1.0, 1, True, 9, a), option(1.0, 1, False, 9, a)]))
    c = [step(3, 0.0)]
    fold.add(window(1, False, [option(0.5, 3, True, 3, c), option(0.5, 3, False, 3, c)], segs=(3,)))
    assert fold.trace[-1]["bridge"] and [s["segment_id"] for s in fold.route] == [3]


def test_used_slice(spark):
    coords = F.array(*[F.struct(F.lit(float(k)).alias("x"), F.lit(0.0).alias("y")) for k in range(4)])
    cases = [(1, 3, False, [1, 2, 3]), (3, 1, False, [3, 2, 1]), (3, 1, True, [0, 1, 2, 3]), (2, 2, True, [2])]
    df = spark.createDataFrame([(a, b, o) for a, b, o, _ in cases], "a int, b int, o boolean")
    got = df.select(F.transform(geo.used_slice(coords, F.col("a"), F.col("b"), F.col("o")), lambda c: c.x.cast("int")).alias("x")).collect()
    assert [list(r.x) for r in got] == [c[3] for c in cases]


def test_contains_run(spark):
    df = spark.createDataFrame([([1, 2, 3], [2, 3]), ([1, 2, 3], [3, 2]), ([1], [1, 2]), ([1], []), ([], [1])], "c array<long>, e array<long>")
    assert [r[0] for r in df.select(roads.contains_run(F.col("c"), F.col("e"))).collect()] == [True, False, False, False, False]


def test_line_distance_matches_columns(spark):
    coords = [(0.0, 0.0), (0.001, 0.0), (0.001, 0.001)]
    df = spark.createDataFrame([(0.0004, 0.0002), (0.002, 0.0005), (0.0, 0.0)], "lon double, lat double")
    line = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in coords])
    for r in df.select("lon", "lat", geo.distance_to_polyline(F.col("lon"), F.col("lat"), line).alias("d")).collect():
        assert abs(r.d - line_distance(r.lat, r.lon, [c[0] for c in coords], [c[1] for c in coords])) < 1e-6


def test_attempts_tell_why_a_window_failed(spark):
    """Windows whose pairs are all too far, all apart, of both kinds, found, or missing."""
    from wayloom.operators import diagnose

    line = lambda x: [{"x": x, "y": 0.0}, {"x": x + 0.002, "y": 0.0}]
    segs = spark.createDataFrame([(k, line(k * 0.01)) for k in range(1, 7)], "segment_id long, coordinates array<struct<x:double,y:double>>")
    moves = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long")
    rows = [(w, 0, 1, r) for w in range(5) for r in (1,)]
    ends = {0: [4], 1: [5], 2: [4, 5], 3: [2, 1], 4: [1]}
    cands = [("t%d" % w, 0, 1, 10, 1) for w, *_ in rows] + [
        ("t%d" % w, 1, s, 10 * s, k + 1) for w, segments in ends.items() for k, s in enumerate(segments)
    ]
    candidates = spark.createDataFrame(cands, "trip_id string, point_idx long, segment_id long, way_id long, rank long")
    windows = spark.createDataFrame([("t%d" % w, 0, 0, 1) for w in range(5)], "trip_id string, window_idx long, start_idx long, end_idx long")
    paths = spark.createDataFrame([("t3", 0, 1, 2, 5.0, [1, 2])], "trip_id string, window_idx long, from_seg long, to_seg long, cost double, path array<int>")
    tried = diagnose.path_attempts(candidates, windows, paths, segs, moves)
    got = {(r.trip_id, r.to_seg): (r.result, round(r.distance_m)) for r in tried.collect()}
    assert got == {
        ("t0", 4): ("too_far", 3336), ("t1", 5): ("no_connection", 4448), ("t2", 4): ("too_far", 3336),
        ("t2", 5): ("no_connection", 4448), ("t3", 2): ("success", 1112),
    }
    reasons = {r.trip_id: (r.n_attempts, r.reason) for r in diagnose.attempt_summary(tried, windows).collect()}
    assert reasons == {
        "t0": (1, "every pair is beyond the length limit"), "t1": (1, "no pair is connected by roads"),
        "t2": (2, "1 pairs beyond the length limit, 1 not connected"), "t3": (1, "1 of 1 pairs have a path"),
        "t4": (0, "no pair of candidates to search between"),
    }


def plain_routes(wins, scored, steps, points, firsts, radius=20.0, far=150.0):
    """Routes and trace of all trips by the plain fold. ``steps``: path key -> list of (segment, entry, exit, xs, ys)."""
    at = {(p.trip_id, p.point_idx): (p.lat, p.lon) for p in points}
    by_window = {}
    for p in scored:
        if p.score is not None:
            by_window.setdefault((p.trip_id, p.window_idx), []).append(p)
    folds = {}
    for w in sorted(wins, key=lambda w: (w.trip_id, w.window_idx)):
        lat, lon = at[w.trip_id, w.start_idx]
        end = at[w.trip_id, w.end_idx]
        found = sorted(by_window.get((w.trip_id, w.window_idx), []), key=lambda p: (p.score, p.from_rank, p.to_rank))

        def option(p, bound, w=w, end=end, lat=lat, lon=lon):
            own = steps[w.trip_id, w.window_idx, p.from_seg, p.to_seg]
            d_end = [(line_distance(*end, xs, ys), k, seg) for k, (seg, _, _, xs, ys) in enumerate(own)]
            near = [x for x in d_end if x[0] <= far]
            path = [
                {"segment_id": seg, "entry_idx": e, "exit_idx": x, "d_start": round(line_distance(lat, lon, xs, ys), 6), "xs": xs, "ys": ys}
                for seg, e, x, xs, ys in own
            ]
            return {"score": p.score, "from_rank": p.from_rank, "to_rank": p.to_rank, "from_seg": p.from_seg, "bound": bound,
                    "end_seg": min(near)[2] if near else None, "steps": path}

        bound = {}
        for p in found:
            if not w.is_last or p.to_rank == 1:
                bound.setdefault(p.from_seg, p)
        options = [option(p, True) for p in bound.values()] + ([option(found[0], False)] if found else [])
        fold = folds.setdefault(w.trip_id, TripFold(w.trip_id, radius, far))
        fold.add({"trip_id": w.trip_id, "window_idx": w.window_idx, "start_idx": w.start_idx, "is_last": w.is_last, "lat": lat, "lon": lon,
                  "first_segs": firsts.get((w.trip_id, w.start_idx)), "options": options})
    routes = [(f.trip_id, n, s["window_idx"], s["segment_id"], s["entry_idx"], s["exit_idx"]) for f in folds.values() for n, s in enumerate(f.route)]
    names = ("window_idx", "score", "bridge", "used_constraints", "constraint_segment", "n_options", "from_seg")
    return sorted(routes), sorted(((f.trip_id, *[t[c] for c in names]) for f in folds.values() for t in f.trace), key=str)


def folded(spark, wins, scored, steps, points, cands):
    routes, trace = matching.fold_windows(wins, scored, steps, points, cands, 20.0)
    got = sorted(map(tuple, routes.collect())), sorted(map(tuple, trace.collect()), key=str)
    lines = {}
    for r in steps.orderBy("pos").collect():
        lines.setdefault((r.trip_id, r.window_idx, r.from_seg, r.to_seg), []).append(
            (r.segment_id, r.entry_idx, r.exit_idx, [c.x for c in r.line], [c.y for c in r.line])
        )
    firsts = {}
    for c in cands.collect():
        firsts.setdefault((c.trip_id, c.point_idx), []).append(c.segment_id)
    return got, plain_routes(wins.collect(), scored.collect(), lines, points.collect(), firsts)


def test_routes_equal_the_plain_fold(spark, inputs):
    m = inputs.matched()
    steps = matching.path_steps(m.paths, inputs.segments(), matching.PATH)
    points = inputs.trip_points().join(m.windows.select("trip_id").distinct(), "trip_id")
    got, want = folded(spark, m.windows, m.paths, steps, points, m.candidates)
    assert got == want and len(got[0]) > 10
    assert got[0] == sorted(map(tuple, m.routes.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_folds_of_loops_dwells_and_gaps_equal_the_plain_fold(spark, seed):
    """Trips that turn back, stay in place, leave the roads and lose their constraint; roads form a comb of ten lines."""
    rnd = random.Random(seed)
    unit = 0.0004
    line_of = {k: [(x * unit, (k % 5) * unit) for x in range(3 * (k // 5), 3 * (k // 5) + 4)] for k in range(10)}
    rows = {"wins": [], "scored": [], "steps": [], "points": [], "cands": []}
    for trip in ("a", "b", "c"):
        n, x, y = 60, 2.0, 2.0
        for p in range(n):
            x, y = (x, y) if rnd.random() < 0.3 else (min(max(x + rnd.uniform(-1, 1.3), 0), 6), min(max(y + rnd.uniform(-1, 1), -1), 5))
            rows["points"].append((trip, p, y * unit, x * unit))
            near = rnd.sample(range(10), 3)
            rows["cands"] += [(trip, p, k) for k in near]
            if p == n - 1:
                continue
            rows["wins"].append((trip, p, p, p + 1, p == n - 2))
            for rank, start in enumerate(near[: rnd.randrange(4)], 1):
                for to_rank, end in enumerate(rnd.sample(range(10), 2), 1):
                    score = None if rnd.random() < 0.15 else round(rnd.uniform(0, 9), 3)
                    rows["scored"].append((trip, p, start, end, rank, to_rank, score))
                    path = [start, *rnd.sample(range(10), rnd.randrange(3)), end]
                    for pos, k in enumerate(path):
                        a, b = rnd.randrange(4), rnd.randrange(4)
                        line = line_of[k][min(a, b) : max(a, b) + 1][:: 1 if a <= b else -1]
                        rows["steps"].append((trip, p, start, end, pos, k, a, b, [{"x": u, "y": v} for u, v in line]))
    key = "trip_id string, window_idx long"
    frames = {
        "wins": f"{key}, start_idx long, end_idx long, is_last boolean",
        "scored": f"{key}, from_seg long, to_seg long, from_rank long, to_rank long, score double",
        "steps": f"{key}, from_seg long, to_seg long, pos int, segment_id long, entry_idx int, exit_idx int, line array<struct<x:double,y:double>>",
        "points": "trip_id string, point_idx long, lat double, lon double",
        "cands": "trip_id string, point_idx long, segment_id long",
    }
    got, want = folded(spark, *[spark.createDataFrame(rows[n], frames[n]) for n in frames])
    assert got[1] == want[1] and got[0] == want[0]
    assert any(t[3] for t in got[1]) and any(t[4] for t in got[1])


@pytest.mark.parametrize("pairs", [0, 10**9])
def test_folds_by_the_grid_and_by_a_trips_own_parts_are_the_same(spark, monkeypatch, pairs):
    """Trips of any size by one way of comparing windows with travelled parts, against the plain fold."""
    grids, plain = [], matching.near_segments
    monkeypatch.setattr(matching, "TRIP_PAIRS", pairs)
    monkeypatch.setattr(matching, "near_segments", lambda *a: (grids.append(1), plain(*a))[1])
    test_folds_of_loops_dwells_and_gaps_equal_the_plain_fold(spark, 3)
    assert bool(grids) == (pairs == 0)
