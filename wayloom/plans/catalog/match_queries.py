"""Candidates, searches, matched and planned routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayloom.operators import candidates, constraints, matching, paths, planner, reach
from wayloom.plans.oracle import hav, with_ctes
from wayloom.plans.registry import query

FOOT = "coalesce(least(greatest(((p.lon-q.ax)*(q.bx-q.ax)+(p.lat-q.ay)*(q.by_-q.ay))/nullif((q.bx-q.ax)*(q.bx-q.ax)+(q.by_-q.ay)*(q.by_-q.ay),0),0),1),0)"


def _near(source: str, key: str) -> str:
    return f"""SELECT {key}, segment_id, {hav("lat", "lon", "py", "px")} AS d FROM (
 SELECT *, row_number() OVER (PARTITION BY {key}, segment_id ORDER BY (px-lon)*(px-lon)+(py-lat)*(py-lat), piece) AS rn FROM (
  SELECT *, ax+f*(bx-ax) AS px, ay+f*(by_-ay) AS py FROM (
   SELECT p.*, q.*, {FOOT} AS f FROM {source} p JOIN pc q ON p.lon BETWEEN least(q.ax,q.bx)-0.0005 AND greatest(q.ax,q.bx)+0.0005 AND p.lat BETWEEN least(q.ay,q.by_)-0.0005 AND greatest(q.ay,q.by_)+0.0005) j) k) r WHERE rn=1"""


def _cand(key: str, radius: float) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY round(cost,6), segment_id) AS rank FROM (
 SELECT {key}, segment_id, d, NOT any_near AS extended, d/({radius}/2)*CASE WHEN any_near THEN 1 ELSE 1.5e0 END AS cost FROM (
  SELECT *, bool_or(d<={radius}) OVER (PARTITION BY {key}) AS any_near FROM near WHERE d<={radius}*1.5e0) a WHERE d<={radius} OR NOT any_near) b) c WHERE rank<=5"""


PING_NEAR = {"near": _near("pings", "event_id")}
TRIP_NEAR = {"near": _near("trip_points", "trip_id, point_idx"), "cand": _cand("trip_id, point_idx", 20.0)}


@query(
    "candidates_topk",
    with_ctes(
        "SELECT event_id, segment_id, rank, round(d,3) AS distance_m, round(cost,4) AS cost, extended FROM cand",
        {**PING_NEAR, "cand": _cand("event_id", 20.0)},
    ),
)
def candidates_topk(i):
    """Best five segments within 20 m of every point."""
    near = candidates.near_segments(i.pings(), ["event_id"], i.segments(), 30.0, 0.002)
    return candidates.rank_candidates(near, ["event_id"], radius_m=20.0).select(
        "event_id", "segment_id", "rank", F.round("distance_m", 3).alias("distance_m"), F.round("cost", 4).alias("cost"), "extended"
    )


@query(
    "candidates_extended",
    with_ctes(
        "SELECT event_id, segment_id, rank, round(d,3) AS distance_m, round(cost,4) AS cost, extended FROM cand",
        {**PING_NEAR, "cand": _cand("event_id", 5.0)},
    ),
)
def candidates_extended(i):
    """J11 with a radius of 5 m, where many points need the extended radius."""
    near = candidates.near_segments(i.pings(), ["event_id"], i.segments(), 7.5, 0.002)
    return candidates.rank_candidates(near, ["event_id"], radius_m=5.0).select(
        "event_id", "segment_id", "rank", F.round("distance_m", 3).alias("distance_m"), F.round("cost", 4).alias("cost"), "extended"
    )


@query(
    "points_without_candidates",
    with_ctes("SELECT event_id FROM pings WHERE event_id NOT IN (SELECT event_id FROM near WHERE d<=7.5e0)", PING_NEAR),
)
def points_without_candidates(i):
    """Points with no segment within the extended radius of 5 m."""
    near = candidates.near_segments(i.pings(), ["event_id"], i.segments(), 7.5, 0.002)
    return candidates.unmatched_points(i.pings(), ["event_id"], near).select("event_id")


CHAV = "(2*6371000.0e0*asin(least(1e0,sqrt(pow(sin(radians({b1}-({a1}))/2),2)+cos(radians({a1}))*cos(radians({b1}))*pow(sin(radians({b2}-({a2}))/2),2)))))"


@query(
    "nearest_segment",
    with_ctes(
        f"""SELECT event_id, segment_id, distance_m FROM (
 SELECT event_id, segment_id, round(d,6) AS dr, round(d,4) AS distance_m, row_number() OVER (PARTITION BY event_id ORDER BY round(d,6), segment_id) AS rn FROM (
  SELECT *, {CHAV.format(a1="lat", a2="lon", b1="ay+f*(by_-ay)", b2="ax+f*(bx-ax)")} AS d FROM (
   SELECT *, coalesce(least(greatest((px*dx+py*dy)/nullif(dx*dx+dy*dy,0),0),1),0) AS f FROM (
    SELECT p.event_id, p.lat, p.lon, q.segment_id, q.ax, q.ay, q.bx, q.by_, radians(q.bx-q.ax)*cos(radians(q.ay+q.by_)/2) AS dx, radians(q.by_-q.ay) AS dy,
     radians(p.lon-q.ax)*cos(radians(q.ay+p.lat)/2) AS px, radians(p.lat-q.ay) AS py
    FROM pings p JOIN pc q ON p.lon BETWEEN least(q.ax,q.bx)-0.0015 AND greatest(q.ax,q.bx)+0.0015 AND p.lat BETWEEN least(q.ay,q.by_)-0.0015 AND greatest(q.ay,q.by_)+0.0015) a) b) c
  WHERE d<=100) e WHERE rn=1"""
    ),
)
def nearest_segment(i):
    """Nearest segment of every point within 100 m."""
    found = candidates.nearest_segment(i.pings(), ["event_id"], i.segments(), 100.0, 0.002)
    return found.select("event_id", "segment_id", F.round("distance_m", 4).alias("distance_m"))


@query(
    "closest_vertex_pair",
    with_ctes(
        """SELECT a_id, b_id, a_idx, b_idx, round(km,6) AS distance_km FROM (
 SELECT c.src AS a_id, c.dst AS b_id, a.idx AS a_idx, b.idx AS b_idx,
  sqrt(pow((b.lon-a.lon)*111.32e0*cos(radians(a.lat)),2)+pow((b.lat-a.lat)*111.32e0,2)) AS km,
  row_number() OVER (PARTITION BY c.src, c.dst ORDER BY round(sqrt(pow((b.lon-a.lon)*111.32e0*cos(radians(a.lat)),2)+pow((b.lat-a.lat)*111.32e0,2)),9), a.idx, b.idx) AS rn
 FROM (SELECT DISTINCT src, dst FROM allconn WHERE src<dst) c JOIN sn a ON a.segment_id=c.src JOIN sn b ON b.segment_id=c.dst) r WHERE rn=1"""
    ),
)
def closest_vertex_pair(i):
    """Closest vertices of connected segments."""
    pairs = i.connections().filter("src < dst").select(F.col("src").alias("a_id"), F.col("dst").alias("b_id")).distinct()
    return candidates.closest_vertex_pair(pairs, i.segments()).select(
        "a_id", "b_id", F.col("a_idx").cast("long").alias("a_idx"), F.col("b_idx").cast("long").alias("b_idx"), F.round("distance_km", 6).alias("distance_km")
    )


@query(
    "trip_candidates",
    with_ctes("SELECT trip_id, point_idx, segment_id, rank, round(d,3) AS distance_m FROM cand", TRIP_NEAR),
)
def trip_candidates(i):
    """Candidates of all trip points."""
    return i.candidates().select("trip_id", "point_idx", "segment_id", "rank", F.round("distance_m", 3).alias("distance_m"))


@query(
    "window_pairs",
    with_ctes(
        "SELECT trip_id, point_idx AS window_idx, point_idx AS start_idx, point_idx+1 AS end_idx, point_idx+2=n_points AS is_last FROM trip_points WHERE point_idx+1<n_points"
    ),
)
def window_pairs(i):
    """Overlapping windows of two points."""
    return matching.windows(i.trip_points())


@query(
    "route_limit",
    with_ctes(
        f"""SELECT a.trip_id, a.point_idx AS window_idx, round(greatest(CASE WHEN b.t>a.t THEN least(40e0*(b.t-a.t),5*{hav("a.lat", "a.lon", "b.lat", "b.lon")}) ELSE 5*{hav("a.lat", "a.lon", "b.lat", "b.lon")} END,1000),3) AS limit_m
FROM trip_points a JOIN trip_points b ON b.trip_id=a.trip_id AND b.point_idx=a.point_idx+1"""
    ),
)
def route_limit(i):
    """length limit of each window's path."""
    from wayloom.functions import geo

    p = i.trip_points().select("trip_id", "point_idx", "t", "lat", "lon")
    a, b = p.alias("a"), p.withColumn("point_idx", F.col("point_idx") - 1).alias("b")
    direct = geo.haversine(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    limit = paths.length_limit(direct, (F.col("b.t") - F.col("a.t")).cast("double"))
    return a.join(b, ["trip_id", "point_idx"]).select("trip_id", F.col("point_idx").alias("window_idx"), F.round(limit, 3).alias("limit_m"))


def _bfs_sql() -> str:
    head = with_ctes("SELECT DISTINCT c.segment_id AS source FROM cand c JOIN edges e ON true WHERE c.rank<=3 LIMIT 0", TRIP_NEAR)
    inner = head[len("WITH ") :]
    cut = inner.rindex("\nSELECT DISTINCT c.segment_id")
    return f"""WITH RECURSIVE {inner[:cut]},
srcs AS MATERIALIZED (SELECT DISTINCT segment_id AS source FROM cand WHERE rank<=3),
bfs AS (SELECT source, source AS segment_id, 0 AS hops FROM srcs UNION SELECT b.source, e.dst, b.hops+1 FROM bfs b JOIN edges e ON e.src=b.segment_id WHERE b.hops<5)
SELECT source, segment_id, min(hops) AS hops FROM bfs GROUP BY 1,2"""


@query("bfs_hops", _bfs_sql())
def bfs_hops(i):
    """Segments within five hops of every trip point's three best candidates."""
    sources = i.candidates().filter("rank <= 3").select(F.col("segment_id").alias("source")).distinct()
    return paths.reachable(sources, i.edges(), 5)


@query("bounded_paths")
def bounded_paths(i):
    """Cheapest paths of all first × last candidates of every window."""
    return i.matched().paths.select(
        "trip_id", "window_idx", "from_seg", "to_seg", "cost", "length_m", "limit_m", F.size("path").alias("n_steps")
    )


@query("direct_route")
def direct_route(i):
    """Direct routes between the best candidates of neighboring trip points."""
    pairs = neighbor_pairs(i)
    return paths.direct_routes(pairs, i.segments(), i.transitions()).select(
        "from_seg", "to_seg", F.round("direct_m", 3).alias("direct_m"), F.round("limit_m", 3).alias("limit_m"), "cost", "length_m", F.size("path").alias("n_steps"),
        "outcome", "directly_connected", "n_out", "n_in",
    )


def neighbor_pairs(i):
    """Best segments of neighboring trip points."""
    best = i.candidates().filter("rank = 1").select("trip_id", "point_idx", "segment_id")
    nxt = best.select("trip_id", (F.col("point_idx") - 1).alias("point_idx"), F.col("segment_id").alias("to_seg"))
    return best.withColumnRenamed("segment_id", "from_seg").join(nxt, ["trip_id", "point_idx"]).select("from_seg", "to_seg").distinct()


NEIGHBORS = "SELECT DISTINCT a.segment_id AS from_seg, b.segment_id AS to_seg FROM cand a JOIN cand b ON b.trip_id=a.trip_id AND b.point_idx=a.point_idx+1 WHERE a.rank=1 AND b.rank=1"
TRANS = """SELECT e.src, s.idx AS exit_idx, s.is_oneway AS src_oneway, e.dst, o.idx AS entry_idx, o.is_oneway AS dst_oneway
FROM edges e JOIN (SELECT DISTINCT src, dst FROM allconn) c ON c.src=e.src AND c.dst=e.dst JOIN sn s ON s.segment_id=e.src JOIN sn o ON o.segment_id=e.dst AND o.node_id=s.node_id
WHERE NOT (o.is_oneway AND o.idx=o.last_idx)"""


def _recursive(views: str, body: str) -> str:
    """Shared views that ``views`` needs, followed by recursive ones and the query in ``body``."""
    inner = with_ctes(views, TRIP_NEAR)[len("WITH ") :]
    return f"WITH RECURSIVE {inner[: inner.rindex(views) - 1]},\n{body}"


@query(
    "search_reach",
    _recursive(
        "SELECT 1 FROM edges, allconn, sn, cand",
        f"""trans AS MATERIALIZED ({TRANS}),
ask AS MATERIALIZED ({NEIGHBORS}),
walk AS (
 SELECT DISTINCT from_seg, from_seg AS seg, CAST(0 AS BIGINT) AS entry, false AS moved FROM ask
 UNION
 SELECT w.from_seg, t.dst, CASE WHEN t.dst_oneway THEN t.entry_idx ELSE 0 END, true FROM walk w JOIN trans t ON t.src=w.seg AND (NOT t.src_oneway OR t.exit_idx>=w.entry))
SELECT a.from_seg, a.to_seg, EXISTS (SELECT 1 FROM walk w WHERE w.moved AND w.from_seg=a.from_seg AND w.seg=a.to_seg) AS reached FROM ask a""",
    ),
)
def search_reach(i):
    """Between which neighboring segments any way exists."""
    pairs = neighbor_pairs(i).withColumn("from_entry", F.lit(0))
    ways = reach.search_reach(pairs, i.transitions()).select("from_seg", "to_seg", F.lit(True).alias("_r"))
    return pairs.join(ways, ["from_seg", "to_seg"], "left").select("from_seg", "to_seg", F.coalesce("_r", F.lit(False)).alias("reached"))


@query(
    "hop_paths",
    _recursive(
        "SELECT 1 FROM edges, cand",
        """ask AS MATERIALIZED (SELECT DISTINCT a.segment_id AS from_seg, b.segment_id AS to_seg FROM cand a JOIN cand b ON b.trip_id=a.trip_id AND b.point_idx=a.point_idx+1 WHERE a.rank<=3 AND b.rank<=3),
walk AS (
 SELECT DISTINCT from_seg, from_seg AS seg, 0 AS hops, [from_seg] AS path FROM ask
 UNION ALL
 SELECT w.from_seg, e.dst, w.hops+1, min(list_append(w.path, e.dst)) FROM walk w JOIN edges e ON e.src=w.seg WHERE w.hops<5 GROUP BY w.from_seg, e.dst, w.hops),
best AS (SELECT from_seg, seg, min(hops) AS hops, arg_min(path, hops) AS path FROM walk GROUP BY 1,2),
every AS (SELECT DISTINCT from_seg, from_seg AS seg FROM ask UNION SELECT w.from_seg, e.dst FROM every w JOIN edges e ON e.src=w.seg)
SELECT a.from_seg, a.to_seg, b.hops, array_to_string(b.path, ',') AS path, CASE WHEN b.hops=0 THEN 'same' WHEN b.hops IS NOT NULL THEN 'path' WHEN y.seg IS NOT NULL THEN 'beyond_limit' ELSE 'no_path' END AS outcome
FROM ask a LEFT JOIN best b ON b.from_seg=a.from_seg AND b.seg=a.to_seg LEFT JOIN every y ON y.from_seg=a.from_seg AND y.seg=a.to_seg""",
    ),
)
def hop_paths(i):
    """Fewest hops, path and outcome between the three best candidates of neighboring points."""
    c = i.candidates().filter("rank <= 3").select("trip_id", "point_idx", "segment_id")
    nxt = c.select("trip_id", (F.col("point_idx") - 1).alias("point_idx"), F.col("segment_id").alias("to_seg"))
    pairs = c.withColumnRenamed("segment_id", "from_seg").join(nxt, ["trip_id", "point_idx"])
    first = F.element_at("coordinates", 1)
    places = i.segments().select(F.col("segment_id").alias("v"), first.x.alias("lon"), first.y.alias("lat"))
    return reach.hop_paths(pairs, i.edges(), places=places).withColumn("path", F.array_join("path", ","))


# Two-step stand-in paths over whole segments: best candidates of the window's two points.
FIXED = {
    **TRIP_NEAR,
    "fp": """SELECT a.trip_id, a.point_idx AS window_idx, a.segment_id AS s0, b.segment_id AS s1 FROM cand a JOIN cand b ON b.trip_id=a.trip_id AND b.point_idx=a.point_idx+1 WHERE a.rank=1 AND b.rank=1""",
    "st": "SELECT trip_id, window_idx, 0 AS pos, s0 AS segment_id FROM fp UNION ALL SELECT trip_id, window_idx, 1, s1 FROM fp",
    "wp": "SELECT f.trip_id, f.window_idx, p.point_idx, p.lat, p.lon FROM fp f JOIN trip_points p ON p.trip_id=f.trip_id AND p.point_idx IN (f.window_idx, f.window_idx+1)",
    "slen": f"SELECT segment_id, sum({hav('ay', 'ax', 'by_', 'bx')}) AS len_m FROM pc GROUP BY 1",
    "dist": f"""SELECT trip_id, window_idx, point_idx, min(d) AS d FROM (
 SELECT *, {hav("lat", "lon", "ay+f*(by_-ay)", "ax+f*(bx-ax)")} AS d, row_number() OVER (PARTITION BY trip_id, window_idx, point_idx, pos ORDER BY (ax+f*(bx-ax)-lon)*(ax+f*(bx-ax)-lon)+(ay+f*(by_-ay)-lat)*(ay+f*(by_-ay)-lat), piece) AS rn FROM (
  SELECT p.trip_id, p.window_idx, p.point_idx, p.lat, p.lon, s.pos, q.piece, q.ax, q.ay, q.bx, q.by_, {FOOT} AS f FROM wp p JOIN st s ON s.trip_id=p.trip_id AND s.window_idx=p.window_idx JOIN pc q ON q.segment_id=s.segment_id) a) b WHERE rn=1 GROUP BY 1,2,3""",
    "parts": f"""SELECT f.trip_id, f.window_idx, x.mean_m, x.std_m, x.far_m, l0.len_m+l1.len_m AS path_m, y.direct_m,
 (c0.c*greatest(l0.len_m,1)+c1.c*greatest(l1.len_m,1))/(greatest(l0.len_m,1)+greatest(l1.len_m,1)) AS class_score, CASE WHEN w0.way_id<>w1.way_id THEN 1 ELSE 0 END AS transitions
FROM fp f JOIN (SELECT trip_id, window_idx, avg(d) AS mean_m, stddev_pop(d) AS std_m, max(d) AS far_m FROM dist GROUP BY 1,2) x USING (trip_id, window_idx)
JOIN (SELECT a.trip_id, a.point_idx AS window_idx, {hav("a.lat", "a.lon", "b.lat", "b.lon")} AS direct_m FROM trip_points a JOIN trip_points b ON b.trip_id=a.trip_id AND b.point_idx=a.point_idx+1) y USING (trip_id, window_idx)
JOIN slen l0 ON l0.segment_id=f.s0 JOIN slen l1 ON l1.segment_id=f.s1 JOIN seg w0 ON w0.segment_id=f.s0 JOIN seg w1 ON w1.segment_id=f.s1
JOIN cls c0 ON c0.highway=w0.highway JOIN cls c1 ON c1.highway=w1.highway""",
    "cls": "SELECT * FROM (VALUES ('motorway',1e0),('primary',4e0),('secondary',6e0),('tertiary',8e0),('residential',10e0),('service',15e0)) c(highway, c)",
}


def fixed_scores(i):
    best = i.candidates().filter("rank = 1").select("trip_id", "point_idx", "segment_id")
    nxt = best.select("trip_id", (F.col("point_idx") - 1).alias("point_idx"), F.col("segment_id").alias("to_seg"))
    last = i.segments().select("segment_id", (F.size("nodes") - 1).alias("last_idx"))
    p = best.withColumnRenamed("segment_id", "from_seg").join(nxt, ["trip_id", "point_idx"]).withColumnRenamed("point_idx", "window_idx")
    p = p.join(last.select(F.col("segment_id").alias("from_seg"), F.col("last_idx").alias("l0")), "from_seg")
    p = p.join(last.select(F.col("segment_id").alias("to_seg"), F.col("last_idx").alias("l1")), "to_seg")
    step = lambda s, l: F.struct(F.col(s).alias("segment_id"), F.lit(0).alias("entry_idx"), F.col(l).alias("exit_idx"))
    p = p.withColumn("path", F.array(step("from_seg", "l0"), step("to_seg", "l1")))
    pts = i.trip_points()
    wins = matching.windows(pts)
    wp = matching.window_points(wins, pts)
    ends = wp.groupBy("trip_id", "window_idx").agg(
        F.min_by(F.struct("lat", "lon"), "point_idx").alias("a"), F.max_by(F.struct("lat", "lon"), "point_idx").alias("b")
    )
    from wayloom.functions import geo

    direct = geo.haversine(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    p = p.join(ends, ["trip_id", "window_idx"]).withColumn("direct_m", direct)
    steps = matching.path_steps(p, i.segments(), matching.PATH)
    return matching.score_parts(p, steps, wp, matching.PATH)


@query(
    "path_cost",
    with_ctes(
        """SELECT trip_id, window_idx, round(CASE WHEN far_m<=150 THEN CASE WHEN direct_m>0 THEN 2*(mean_m+0.5e0*std_m)+0.5e0*greatest(path_m/direct_m-1.4e0,0)*100+0.8e0*class_score+0.2e0*transitions
 WHEN path_m=0 THEN 2*(mean_m+0.5e0*std_m)+0.8e0*class_score+0.2e0*transitions END END,3) AS score FROM parts""",
        FIXED,
    ),
)
def path_cost(i):
    """score of two-step paths over the best candidates' whole segments."""
    return fixed_scores(i).select("trip_id", "window_idx", F.round("score", 3).alias("score"))


@query(
    "path_transitions",
    with_ctes("SELECT trip_id, window_idx, transitions, round(class_score,4) AS class_score, round(path_m,3) AS path_m FROM parts", FIXED),
)
def path_transitions(i):
    """Way changes, class score and length of the same paths."""
    return fixed_scores(i).select(
        "trip_id", "window_idx", "transitions", F.round("class_score", 4).alias("class_score"), F.round("path_m", 3).alias("path_m")
    )


@query(
    "point_route_distance",
    with_ctes("SELECT trip_id, window_idx, round(mean_m,3) AS mean_m, round(std_m,3) AS std_m, round(far_m,3) AS farthest_m FROM parts", FIXED),
)
def point_route_distance(i):
    """Mean and deviation of the distance from points to path."""
    return fixed_scores(i).select(
        "trip_id", "window_idx", F.round("mean_m", 3).alias("mean_m"), F.round("std_m", 3).alias("std_m"), F.round("farthest_m", 3).alias("farthest_m")
    )


HELD = {
    **TRIP_NEAR,
    "con": "SELECT a.trip_id, a.point_idx, b.segment_id, b.point_idx-a.point_idx AS seq FROM trip_points a JOIN cand b ON b.trip_id=a.trip_id AND b.point_idx IN (a.point_idx, a.point_idx+1) AND b.rank=1",
    "fits": """SELECT c.trip_id, c.point_idx, c.seq, d.segment_id FROM con c JOIN seg s ON s.segment_id=c.segment_id JOIN cand d ON d.trip_id=c.trip_id AND d.point_idx=c.point_idx
JOIN seg e ON e.segment_id=d.segment_id AND e.way_id=s.way_id""",
    "held": "SELECT * FROM (SELECT *, max(seq) OVER (PARTITION BY trip_id, point_idx) AS last FROM fits) f WHERE seq=last",
}


@query(
    "way_constraints",
    with_ctes(
        """SELECT p.trip_id, p.point_idx-k.pos AS window_idx, k.pos, h.segment_id FROM trip_points p JOIN (VALUES (CAST(0 AS BIGINT)), (1)) k(pos) ON p.point_idx-k.pos BETWEEN 0 AND p.n_points-2
JOIN held h ON h.trip_id=p.trip_id AND h.point_idx=p.point_idx""",
        HELD,
    ),
)
def way_constraints(i):
    """Candidates left to each point of a window that is held to the way of its best segment or, where it has a candidate there, of the next point's."""
    best = i.candidates().filter("rank = 1")
    asked = [best.select("trip_id", (F.col("point_idx") - by).alias("point_idx"), F.lit(by).alias("seq"), "segment_id") for by in (0, 1)]
    wins = matching.windows(i.trip_points())
    return constraints.way_constraints(wins, asked[0].unionByName(asked[1]), i.candidates(), i.segments())


@query("window_best")
def window_best(i):
    """Path chosen for each window."""
    return i.matched().trace


@query("matched_routes")
def matched_routes(i):
    """Route of every matched trip, step by step."""
    return i.matched().routes


@query("trip_match_status")
def trip_match_status(i):
    """Outcome of matching each trip."""
    return i.matched().status


def lines(i):
    return matching.route_lines(i.matched().routes, i.segments())


@query("route_steps")
def route_steps(i):
    """travelled part, end nodes and direction of each step."""
    return lines(i).drop("line")


@query("route_coords")
def route_coords(i):
    """Route vertices without doubled joints."""
    return matching.route_coordinates(lines(i))


@query("route_junctions")
def route_junctions(i):
    """Junctions between steps."""
    return matching.junctions(lines(i))


@query("route_ways")
def route_ways(i):
    """way ids of each route as JSON text."""
    from wayloom.functions import parse

    return matching.route_ways(lines(i)).select("trip_id", parse.way_ids_to_json(F.col("osm_way_ids")).alias("osm_way_ids"))


@query("route_bbox")
def route_bbox(i):
    """A3: box of each matched route."""
    return matching.route_bbox(lines(i))


@query("route_length")
def route_length(i):
    """Length of each route."""
    from wayloom.functions import geo

    return lines(i).groupBy("trip_id").agg(F.sum(geo.polyline_length(F.col("line"))).alias("route_m"), F.count(F.lit(1)).alias("n_steps"))


@query("planned_routes")
def planned_routes(i):
    """Routes from each trip's first to its last point, via its middle point if any."""
    at = F.struct("lat", "lon")
    ends = i.trip_points().groupBy("trip_id").agg(
        F.min_by(at, "point_idx").alias("start"), F.max_by(at, "point_idx").alias("end"),
        F.max(F.when(F.col("point_idx") == 1, F.when(F.col("n_points") > 2, at))).alias("mid"),
    )
    requests = ends.select(F.col("trip_id").alias("request_id"), "start", "end", F.array_compact(F.array("mid")).alias("via"))
    return planner.plan_routes(requests, i.network()).routes.withColumnRenamed("trip_id", "request_id")
