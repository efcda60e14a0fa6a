import heapq
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayloom.config import MATCH, TileConfig
from wayloom.operators import candidates, diagnose, network, paths, tiles
from wayloom.operators.movement import np_haversine
from wayloom.session import materialize
from wayloom.sources import sinks


def build(spark, ways, nodes):
    """ways: {way_id: (node ids, one-way, highway)}; nodes: {id: (lat, lon)}."""
    w = spark.createDataFrame(
        [(k, h, o, 0, False, False, False, f"Road {k}") for k, (_n, o, h) in ways.items()],
        "way_id long, highway string, is_oneway boolean, layer int, is_bridge boolean, is_tunnel boolean, is_private boolean, name string",
    )
    wn = spark.createDataFrame([(k, n, s) for k, (ns, _o, _h) in ways.items() for s, n in enumerate(ns)], "way_id long, node_id long, seq long")
    nd = spark.createDataFrame([(n, a, o) for n, (a, o) in nodes.items()], "node_id long, lat double, lon double")
    return network.segments(w, wn, nd)


def pairs(df):
    return {(r.src, r.dst) for r in df.select("src", "dst").collect()}


def test_oneway_connections(spark):
    nodes = {k: (0.0, k * 0.001) for k in range(6)}
    # 1: 0→1→2 one-way, 2: 2→3 one-way, 3: 4→2 one-way (ends at node 2), 4: 1–5 two-way from the middle of 1.
    ways = {1: ([0, 1, 2], True, "primary"), 2: ([2, 3], True, "primary"), 3: ([4, 2], True, "primary"), 4: ([1, 5], False, "service")}
    sn = network.segment_nodes(build(spark, ways, nodes))
    got = pairs(network.connections(sn))
    assert (1, 2) in got and (3, 2) in got
    assert (1, 3) not in got and (2, 1) not in got and (2, 3) not in got
    assert (1, 4) in got and (4, 1) in got


def test_edges_never_enter_a_oneway_at_its_end(spark):
    nodes = {k: (0.0, k * 0.001) for k in range(4)}
    ways = {1: ([0, 1], True, "primary"), 2: ([2, 1], True, "primary"), 3: ([1, 3], True, "primary")}
    segs = build(spark, ways, nodes)
    sn = network.segment_nodes(segs)
    base = network.connections(sn)
    conns = base.unionByName(network.extra_connections(sn, base))
    edges = pairs(network.graph_edges(sn, network.declared_edges(segs, conns)))
    assert edges == {(1, 3), (2, 3)}
    assert pairs(network.transitions(sn, network.graph_edges(sn, network.declared_edges(segs, conns)), conns)) == {(1, 3), (2, 3)}


def test_unknown_nodes_and_short_ways(spark):
    nodes = {1: (0.0, 0.0), 2: (0.0, 0.001)}
    segs = build(spark, {7: ([1, 9, 2], False, "primary"), 8: ([1, 9], False, "primary")}, nodes)
    assert [(r.segment_id, r.way_id, list(r.nodes)) for r in segs.collect()] == [(1, 7, [1, 2])]


def lattice(spark, size=5, seed=4):
    rnd = random.Random(seed)
    nodes = {r * size + c: (r * 0.001, c * 0.001) for r in range(size) for c in range(size)}
    ways, k = {}, 1
    kinds = ["primary", "residential", "service", "secondary"]
    for r in range(size):
        ways[k] = ([r * size + c for c in range(size)], rnd.random() < 0.3, rnd.choice(kinds)); k += 1  # noqa: E702
        ways[k] = ([c * size + r for c in range(size)], rnd.random() < 0.3, rnd.choice(kinds)); k += 1  # noqa: E702
    return build(spark, ways, nodes), nodes


def brute_paths(moves, lasts, source, entry, pos, limit, near):
    """Cheapest cost to each segment within the limit, by exhaustive label setting."""
    labels, heap, best = defaultdict(list), [(0.0, 0.0, source, entry, pos)], {}
    while heap:
        g, d, seg, e, p = heapq.heappop(heap)
        if any(g2 <= g and d2 <= d for g2, d2 in labels[seg, e]):
            continue
        labels[seg, e].append((g, d))
        if seg != source or best:
            best.setdefault(seg, g)
        for m in moves[seg]:
            if m.src_oneway and m.exit_idx < e:
                continue
            leg = abs(m.exit_pos - p)
            nd = round(d + leg, 6)
            if nd > limit:
                continue
            cost = (max(leg / 500.0, 0.1) + 1.0) * m.static_cost * 0.1 ** near.get(m.dst, 0)
            heapq.heappush(heap, (round(g + cost, 9), nd, m.dst, m.entry_idx, m.entry_pos))
    return best


def test_bounded_paths_equal_brute_force(spark):
    lattice_segs, nodes = lattice(spark)
    segs = materialize(lattice_segs, "segs")
    sn = materialize(network.segment_nodes(segs), "sn")
    base = materialize(network.connections(sn), "base")
    conns = base.unionByName(network.extra_connections(sn, base))
    edges = network.graph_edges(sn, network.declared_edges(segs, conns))
    trans = materialize(network.transitions(sn, edges, conns), "trans")
    moves = defaultdict(list)
    for m in trans.collect():
        moves[m.src].append(m)
    verts = {(r.segment_id, r.idx): r for r in sn.collect()}
    ids = sorted({s for s, _ in verts})
    rnd = random.Random(8)
    searches, targets, cases = [], [], []
    for n in range(24):
        a, b, b2 = rnd.sample(ids, 3)
        e = rnd.randrange(5)
        limit = rnd.choice([250.0, 450.0, 700.0, 1500.0])
        goal, st = verts[b, 2], verts[a, e]
        group = f"g{n % 3}"
        searches.append((group, n, a, e, float(st.pos_m), limit, float(goal.lat), float(goal.lon), 2000.0, float(st.lat), float(st.lon), 1.0))
        targets += [(group, n, b, 2, float(goal.pos_m)), (group, n, b2, 1, float(verts[b2, 1].pos_m))]
        cases.append((group, n, a, e, float(st.pos_m), limit, (b, b2)))
    s = spark.createDataFrame(searches, "grp string, n long, from_seg long, from_entry int, from_pos double, limit_m double, goal_lat double, goal_lon double, slack_m double, start_lat double, start_lon double, start_slack_m double")
    t = spark.createDataFrame(targets, "grp string, n long, to_seg long, to_exit int, to_pos double")
    near = {"g0": {ids[3]: 1}, "g1": {ids[5]: 2, ids[6]: 1}, "g2": {}}
    nr = spark.createDataFrame([(g, k, c) for g, m in near.items() for k, c in m.items()], "grp string, segment_id long, n_near long")
    got = {(r.n, r.to_seg): r for r in paths.bounded_paths(s, t, ["grp", "n"], trans, nr, "grp", MATCH).collect()}
    found = 0
    for group, n, a, e, pos, limit, goals in cases:
        best = brute_paths(moves, verts, a, e, pos, limit, near[group])
        for goal in goals:
            if goal in best:
                found += 1
                assert abs(got[n, goal].cost - best[goal]) < 1e-6, (n, goal)
                steps = got[n, goal].path
                assert steps[0].segment_id == a and steps[-1].segment_id == goal
                for x, y in zip(steps, steps[1:]):
                    assert verts[x.segment_id, x.exit_idx].node_id == verts[y.segment_id, y.entry_idx].node_id
            else:
                assert (n, goal) not in got
    assert found > 10


@pytest.mark.parametrize("seed", [4, 5])
def test_searches_from_one_start_run_once(spark, seed):
    """Many searches from few starts, each with its own limit, goal and targets, against one search at a time."""
    lattice_segs, _ = lattice(spark)
    segs = materialize(lattice_segs, "segs")
    sn = materialize(network.segment_nodes(segs), "sn")
    conns = materialize(network.connections(sn), "conns")
    edges = network.graph_edges(sn, network.declared_edges(segs, conns))
    trans = materialize(network.transitions(sn, edges, conns), "trans")
    moves = defaultdict(list)
    for m in trans.collect():
        moves[m.src].append(m)
    verts = {(r.segment_id, r.idx): r for r in sn.collect()}
    ids = sorted({x for x, _ in verts})
    rnd = random.Random(seed)
    starts = [(rnd.choice(ids), rnd.randrange(5)) for _ in range(3)]
    searches, targets, cases = [], [], []
    for n in range(40):
        a, e = rnd.choice(starts)
        goals = rnd.sample([x for x in ids if x != a], 3)
        limit = rnd.choice([150.0, 300.0, 500.0, 900.0, 1400.0])
        goal, st = verts[goals[0], 2], verts[a, e]
        searches.append((n, a, e, float(st.pos_m), limit, float(goal.lat), float(goal.lon), 2000.0, float(st.lat), float(st.lon), 1.0))
        targets += [(n, b, x, float(verts[b, x].pos_m)) for b in goals for x in (0, 3)]
        cases.append((n, a, e, float(st.pos_m), limit, goals))
    s = spark.createDataFrame(searches, "n long, from_seg long, from_entry int, from_pos double, limit_m double, goal_lat double, goal_lon double, slack_m double, start_lat double, start_lon double, start_slack_m double")
    t = spark.createDataFrame(targets, "n long, to_seg long, to_exit int, to_pos double")
    sources = []
    found = paths.bounded_paths(s, t, ["n"], trans, count=lambda d: sources.append(d.count())).collect()
    assert sources[0] <= 3
    got = {(r.n, r.to_seg, r.to_exit): r for r in found}
    assert len(got) == len(found)
    seen = 0
    for n, a, e, pos, limit, goals in cases:
        best = brute_paths(moves, verts, a, e, pos, limit, {})
        for b in goals:
            for x in (0, 3):
                r = got.get((n, b, x))
                assert (r is None) == (b not in best), (n, b, x)
                if r is None:
                    continue
                seen += 1
                assert abs(r.cost - best[b]) < 1e-6 and r.length_m <= limit and r.path[-1].exit_idx == x
                # The path's own moves add up to its cost and length.
                g, d, p = 0.0, 0.0, pos
                for one, two in zip(r.path, r.path[1:]):
                    move = next(m for m in moves[one.segment_id] if (m.exit_idx, m.dst, m.entry_idx) == (one.exit_idx, two.segment_id, two.entry_idx))
                    leg = abs(move.exit_pos - p)
                    g, d, p = g + (max(leg / 500.0, 0.1) + 1.0) * move.static_cost, d + leg, move.entry_pos
                assert abs(g - r.cost) < 1e-6 and abs(d - r.length_m) < 1e-3 and r.path[0].entry_idx == e
    assert seen > 40


def test_reachable_levels(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0), (1, 3, 1.0)], "src long, dst long, cost double")
    got = paths.reachable(spark.createDataFrame([(1,)], "source long"), edges, 2)
    assert {(r.segment_id, r.hops) for r in got.collect()} == {(1, 0), (2, 1), (3, 1), (4, 2)}


def test_candidate_radius_and_extension(spark):
    deg = 1 / 111194.93
    segs = build(spark, {1: ([1, 2], False, "primary")}, {1: (0.0, 0.0), 2: (0.0, 0.1)})
    pts = spark.createDataFrame([(k, d * deg, 0.05) for k, d in enumerate([5.0, 19.9, 20.1, 29.9, 30.1])], "pid long, lat double, lon double")
    near = candidates.near_segments(pts, ["pid"], segs, 30.0, 0.002)
    got = {r.pid: (r.extended, round(r.cost, 3)) for r in candidates.rank_candidates(near, ["pid"]).collect()}
    assert got == {0: (False, 0.5), 1: (False, 1.99), 2: (True, 3.015), 3: (True, 4.485)}


def test_grid_join_equals_full_search(spark):
    rnd = random.Random(12)
    segs, _ = lattice(spark, 4)
    pts = spark.createDataFrame([(k, rnd.uniform(-0.001, 0.004), rnd.uniform(-0.001, 0.004)) for k in range(60)], "pid long, lat double, lon double")
    got = {(r.pid, r.segment_id): r.distance_m for r in candidates.near_segments(pts, ["pid"], segs, 60.0, 0.0004).collect()}
    from plain_fold import line_distance

    want = {}
    for s in segs.collect():
        xs, ys = [c.x for c in s.coordinates], [c.y for c in s.coordinates]
        for p in pts.collect():
            d = line_distance(p.lat, p.lon, xs, ys)
            if d <= 60.0:
                want[p.pid, s.segment_id] = d
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_long_pieces_are_followed_only_where_points_lie(spark):
    from plain_fold import line_distance

    rnd = random.Random(6)
    rows, pts = [], []
    for k in range(12):
        line = [(rnd.uniform(-0.8, 0.8), rnd.uniform(-0.8, 0.8)) for _ in range(3)]
        rows.append((k, [{"x": x, "y": y} for x, y in line]))
        for _ in range(6):
            (ax, ay), (bx, by) = rnd.choice([line[:2], line[1:]])
            f = rnd.random()
            pts.append((len(pts), ay + f * (by - ay) + rnd.uniform(-1, 1) * 3e-4, ax + f * (bx - ax) + rnd.uniform(-1, 1) * 3e-4))
    segs = spark.createDataFrame(rows, "segment_id long, coordinates array<struct<x:double,y:double>>")
    points = spark.createDataFrame(pts, "pid long, lat double, lon double")
    got = {(r.pid, r.segment_id): r.distance_m for r in candidates.near_segments(points, ["pid"], segs, 30.0, 0.002).collect()}
    want = {}
    for s, line in rows:
        for p, lat, lon in pts:
            d = line_distance(lat, lon, [c["x"] for c in line], [c["y"] for c in line])
            if d <= 30.0:
                want[p, s] = d
    assert got.keys() == want.keys() and len(want) > 30
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)
    pieces = network.segment_pieces(segs)
    cells = spark.createDataFrame([(0, 0), (-300, 200)], "cell_x long, cell_y long")
    every = network.piece_cells(pieces, 0.002, 0.0005).distinct()
    some = network.piece_cells(pieces, 0.002, 0.0005, occupied=cells)
    assert some.count() == some.distinct().count() < every.count() / 4


def test_radius_searches_at_all_latitudes(spark):
    """Long pieces and points up to the poles, against searches over whole segments."""
    from plain_fold import line_distance

    rnd = random.Random(3)
    rows, pts = [], []
    for base in (0.0, 60.0, -60.0, 86.0, 88.9, 89.85, -89.93, 89.999):
        for k in range(4):
            x, top = rnd.uniform(-1, 1), min(90.0, abs(base) + rnd.choice([0.001, 1.0]))
            y2 = top if base >= 0 else -top
            line = [(x, base), (x + rnd.uniform(-0.01, 0.01), (base + y2) / 2), (x, y2)]
            rows.append((len(rows), [{"x": a, "y": b} for a, b in line]))
            for _ in range(8):
                (ax, ay), (bx, by) = rnd.choice([line[:2], line[1:]])
                f = rnd.random()
                lat = ay + f * (by - ay) + rnd.uniform(-1, 1) * 3e-4
                wide = float(4e-4 / max(np.cos(np.radians(min(abs(lat), 89.9995))), 1e-9))
                pts.append((len(pts), max(-90.0, min(90.0, lat)), ax + f * (bx - ax) + rnd.uniform(-1, 1) * wide))
    # The case of a piece whose far end is a degree nearer to the pole.
    rows.append((900, [{"x": 0.0, "y": 60.0}, {"x": 0.0, "y": 61.0}]))
    pts.append((900, 60.999, 29.9 / 111195.0 / float(np.cos(np.radians(60.999)))))
    segs = spark.createDataFrame(rows, "segment_id long, coordinates array<struct<x:double,y:double>>")
    points = spark.createDataFrame(pts, "pid long, lat double, lon double")
    got = {(r.pid, r.segment_id): r.distance_m for r in candidates.near_segments(points, ["pid"], segs, 30.0, 0.002).collect()}
    want = {}
    for s, line in rows:
        for p, lat, lon in pts:
            d = line_distance(lat, lon, [c["x"] for c in line], [c["y"] for c in line])
            if d <= 30.0:
                want[p, s] = d
    assert (900, 900) in want and got.keys() == want.keys() and len(want) > 60
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)
    # Midpoints within the radius, also across the antimeridian and the pole.
    ends = [(179.9999, 10.0), (-179.9999, 10.0), (0.0, 89.9999), (180.0, 89.9999), (90.0, -89.95), (0.5, 45.0)]
    short = spark.createDataFrame([(k, [{"x": x, "y": y}, {"x": x, "y": y}]) for k, (x, y) in enumerate(ends)],
                                  "segment_id long, coordinates array<struct<x:double,y:double>>")
    asked = spark.createDataFrame([(k, y, x) for k, (x, y) in enumerate(ends)] + [(50, -89.949, 80.0)], "pid long, lat double, lon double")
    got = {(r.pid, r.segment_id) for r in diagnose.segments_around(asked, ["pid"], short).collect()}
    want = {(p.pid, k) for p in asked.collect() for k, (x, y) in enumerate(ends) if np_haversine(p.lat, p.lon, y, x) <= 2000.0}
    assert got == want and {(0, 1), (2, 3), (50, 4)} <= got
    near = {(r.a_id, r.b_id) for r in network.endpoint_near(short, 30.0).collect()}
    assert near == {(a, b) for a in range(6) for b in range(a + 1, 6) if np_haversine(ends[a][1], ends[a][0], ends[b][1], ends[b][0]) < 30.0} == {(0, 1), (2, 3)}


def test_tile_density_boundary(spark, tmp_path):
    cfg = TileConfig(base_size_deg=1.0, density=3, max_depth=1)
    nodes = {k: (0.1, 0.1 + k * 0.01) for k in range(8)}
    ways = {k: ([k, k + 1], False, "primary") for k in range(1, 6)}
    segs = build(spark, ways, nodes)
    placed = tiles.assign_tiles(segs, cfg)
    assert {r.segment_id: r.depth for r in placed.collect()} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1}
    path = str(tmp_path / "tiles")
    sinks.write_tiles(segs.join(placed, "segment_id"), path)
    box = sinks.read_tiles_in_box(spark, path, (0.0, 0.0, 0.2, 0.2), 1.0, 1)
    assert box.count() == 5
    assert sinks.read_tiles_in_box(spark, path, (5.0, 5.0, 5.1, 5.1), 1.0, 1).count() == 0
    plan = box._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
    assert sinks.segment_by_id(box, 2).count() == 1


def test_nearby_ends_and_crossings(spark):
    deg = 1 / 111194.93
    nodes = {1: (0.0, 0.0), 2: (0.0, 0.01), 3: (0.0, 0.01 + 0.9 * deg), 4: (0.0, 0.02), 5: (-0.005, 0.005), 6: (0.005, 0.005)}
    segs = build(spark, {1: ([1, 2], False, "primary"), 2: ([3, 4], False, "primary"), 3: ([5, 6], False, "primary")}, nodes)
    assert [(r.a_id, r.b_id) for r in network.endpoint_near(segs).collect()] == [(1, 2)]
    assert [(r.a_id, r.b_id) for r in network.line_intersections(segs).collect()] == [(1, 3)]
    asked = spark.createDataFrame([(1, 2), (1, 3)], "a_id long, b_id long")
    reasons = {r.b_id: r.reason for r in network.connectivity_verdicts(asked, segs).collect()}
    assert reasons[2].startswith("gap end-start 0.") and reasons[3] == "crossing"


def test_brute_helper_distance():
    assert abs(np_haversine(0.0, 0.0, 0.0, 1.0) - 111195.08) < 1.0
    assert F is not None


def test_wide_limits_need_one_label_a_state(spark, monkeypatch):
    """Where the limit cuts nothing off that is cheaper, only the cheapest labels are followed; a tight one is searched again."""
    line = "src long, exit_idx int, exit_pos double, src_oneway boolean, dst long, dst_oneway boolean, entry_idx int, entry_pos double, lat double, lon double, dst_private boolean, static_cost double"
    # From 1 to 4 by 2 (long and cheap) or by 3 (short and dear); 9 cannot be left or reached from 1.
    rows = [(1, 0, 0.0, 2, 1.0), (1, 0, 0.0, 3, 9.0), (2, 1, 900.0, 4, 1.0), (3, 1, 100.0, 4, 1.0), (8, 0, 0.0, 9, 1.0)]
    trans = spark.createDataFrame([(s, x, p, False, d, False, 0, 0.0, 0.0, 0.0, False, c) for s, x, p, d, c in rows], line)
    searches = [(n, 1, 0, 0.0, limit, 0.0, 0.0, 10.0, 0.0, 0.0, 1.0) for n, limit in enumerate([2000.0, 500.0, 50.0])]
    s = spark.createDataFrame(searches, "n long, from_seg long, from_entry int, from_pos double, limit_m double, goal_lat double, goal_lon double, slack_m double, start_lat double, start_lon double, start_slack_m double")
    t = spark.createDataFrame([(n, b, 0, 0.0) for n in range(3) for b in (4, 9)], "n long, to_seg long, to_exit int, to_pos double")
    passes, plain = [], paths._search
    monkeypatch.setattr(paths, "_search", lambda *a, **k: (passes.append(k["cheapest"]), plain(*a, **k))[1])

    def middle(which):
        return {(r.n, r.to_seg): r.path[1].segment_id for r in paths.bounded_paths(s.filter(which), t.filter(which), ["n"], trans).collect()}

    assert middle("n = 0") == {(0, 4): 2} and passes == [True]
    assert middle("n >= 0") == {(0, 4): 2, (1, 4): 3} and passes == [True, True, False]


@pytest.mark.parametrize("seed", [4, 7])
def test_regions_give_the_same_paths_as_joined_rounds(spark, monkeypatch, seed):
    """The search in regions, by the trees of cheaper places or by a trip's own costs, against rounds of joins: the same rows, ties too."""
    from wayloom.operators import regions

    lattice_segs, _ = lattice(spark, 6, seed)
    segs = materialize(lattice_segs, "segs")
    sn = materialize(network.segment_nodes(segs), "sn")
    conns = materialize(network.connections(sn), "conns")
    trans = materialize(network.transitions(sn, network.graph_edges(sn, network.declared_edges(segs, conns)), conns), "trans")
    verts = {(r.segment_id, r.idx): r for r in sn.collect()}
    ids = sorted({x for x, _ in verts})
    rnd = random.Random(seed)
    searches, targets = [], []
    for n in range(40):
        a, *goals = rnd.sample(ids, 4)
        e, limit = rnd.randrange(6), rnd.choice([200.0, 400.0, 600.0, 1000.0, 3000.0, 9000.0])
        goal, st = verts[goals[0], 2], verts[a, e]
        searches.append((f"g{n % 3}", n, a, e, float(st.pos_m), limit, float(goal.lat), float(goal.lon), 2000.0, float(st.lat), float(st.lon), 1.0))
        targets += [(f"g{n % 3}", n, b, x, float(verts[b, x].pos_m)) for b in goals for x in (0, 3)]
    s = spark.createDataFrame(searches, "grp string, n long, from_seg long, from_entry int, from_pos double, limit_m double, goal_lat double, goal_lon double, slack_m double, start_lat double, start_lon double, start_slack_m double")
    t = spark.createDataFrame(targets, "grp string, n long, to_seg long, to_exit int, to_pos double")
    near = spark.createDataFrame([("g0", ids[3], 1), ("g0", ids[4], 9), ("g1", ids[5], 2), ("g1", ids[6], 1), ("g9", ids[1], 1)], "grp string, segment_id long, n_near long")

    def found():
        return sorted(map(tuple, paths.bounded_paths(s, t, ["grp", "n"], trans, near, "grp", MATCH).collect()))

    rounds, plain = [], paths._by_rounds
    monkeypatch.setattr(paths, "_by_rounds", lambda *a: (rounds.append(1), plain(*a))[1])
    joined = found()
    monkeypatch.setattr(regions, "MAX_PLACES", 0)
    own = found()
    assert not rounds and len(joined) > 40
    monkeypatch.setattr(regions, "MAX_MOVES", -1)
    assert found() == joined == own and rounds


def test_wide_limits_are_searched_around_the_start_first(spark, monkeypatch):
    """Paths that cost less than any way out of the region around the start need no search up to their limit."""
    from wayloom.operators import regions

    line = "src long, exit_idx int, exit_pos double, src_oneway boolean, dst long, dst_oneway boolean, entry_idx int, entry_pos double, lat double, lon double, dst_private boolean, static_cost double"
    # A street along the equator with a vertex every 111 m; a dear way round from 3 to 5 by 50.
    rows = [(k, 1, 111.0, k + 1, k * 0.001, 2.0) for k in range(40)] + [(3, 1, 111.0, 50, 0.003, 60.0), (50, 1, 5000.0, 5, 0.004, 2.0)]
    trans = spark.createDataFrame([(s, x, p, False, d, False, 0, 0.0, 0.0, lon, False, c) for s, x, p, d, lon, c in rows], line)
    s = spark.createDataFrame([(n, 0, 0, 0.0, limit, 0.0, 0.03, 10.0, 0.0, 0.0, 1.0) for n, limit in enumerate([1e6, 300.0])], "n long, from_seg long, from_entry int, from_pos double, limit_m double, goal_lat double, goal_lon double, slack_m double, start_lat double, start_lon double, start_slack_m double")
    t = spark.createDataFrame([(n, b, 0, 0.0) for n in range(2) for b in (2, 5, 30, 50)], "n long, to_seg long, to_exit int, to_pos double")
    want = sorted(map(tuple, paths.bounded_paths(s, t, ["n"], trans).collect()))
    far, plain = [], paths._by_rounds
    monkeypatch.setattr(paths, "_by_rounds", lambda s, f, *a: (far.extend(r.to_seg for r in f.collect()), plain(s, f, *a))[1])
    monkeypatch.setattr(paths, "CLOSE_M", (1500.0, 6000.0))
    monkeypatch.setattr(regions, "CELL_DEG", 0.001)
    monkeypatch.setattr(regions, "MAX_MOVES", 30)
    assert sorted(map(tuple, paths.bounded_paths(s, t, ["n"], trans).collect())) == want and [r[1] for r in want].count(2) == 2
    assert 30 in far and 2 not in far
