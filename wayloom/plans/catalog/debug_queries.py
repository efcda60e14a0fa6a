"""Diagnosis and map features."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayloom.functions import roads
from wayloom.operators import diagnose, features, matching, network
from wayloom.plans.catalog.match_queries import TRIP_NEAR
from wayloom.plans.oracle import hav, with_ctes
from wayloom.plans.registry import query


def attempts(i, top=None):
    m = i.matched()
    return diagnose.path_attempts(m.candidates, m.windows, m.paths, i.segments(), i.transitions(), top)


def steps(i):
    return matching.path_steps(i.matched().paths, i.segments(), matching.PATH)


@query("path_attempts")
def path_attempts(i):
    """Outcome of every first × last candidate pair."""
    return attempts(i)


@query(
    "attempt_pairs",
    with_ctes(
        f"""SELECT a.trip_id, a.point_idx AS window_idx, a.segment_id AS from_seg, b.segment_id AS to_seg, x.way_id AS from_way, y.way_id AS to_way,
 round({hav("(x.ys[1]+x.ys[x.n_nodes])/2", "(x.xs[1]+x.xs[x.n_nodes])/2", "(y.ys[1]+y.ys[y.n_nodes])/2", "(y.xs[1]+y.xs[y.n_nodes])/2")},3) AS distance_m
FROM cand a JOIN cand b ON b.trip_id=a.trip_id AND b.point_idx=a.point_idx+1 AND b.segment_id<>a.segment_id
JOIN seg x ON x.segment_id=a.segment_id JOIN seg y ON y.segment_id=b.segment_id""",
        TRIP_NEAR,
    ),
)
def attempt_pairs(i):
    """All first × last candidate pairs of each window, before any search."""
    wins = matching.windows(i.trip_points())
    return diagnose.candidate_pairs(i.candidates(), wins, i.segments()).select(
        "trip_id", "window_idx", "from_seg", "to_seg", "from_way", "to_way", F.round("distance_m", 3).alias("distance_m")
    )


@query("top3_attempts")
def top3_attempts(i):
    """The same for the three best candidates on each side."""
    return attempts(i, 3)


@query("attempt_summary")
def attempt_summary(i):
    """Overall reason per window."""
    return diagnose.attempt_summary(attempts(i), i.matched().windows)


@query("window_stats")
def window_stats(i):
    """Statistics of the chosen path of each window."""
    m = i.matched()
    chosen = diagnose.chosen_steps(m.trace, steps(i), m.paths)
    return diagnose.window_stats(chosen, m.trace, attempts(i))


@query(
    "candidate_ways",
    with_ctes("SELECT c.trip_id, c.point_idx, s.way_id, min(c.rank) AS best_rank FROM cand c JOIN seg s USING (segment_id) GROUP BY 1,2,3", TRIP_NEAR),
)
def candidate_ways(i):
    """Rank of each way among a point's candidates."""
    return i.candidates().groupBy("trip_id", "point_idx", "way_id").agg(F.min("rank").alias("best_rank"))


def expectations(i):
    """Expected: the best candidate's way at the window's two points, in order."""
    m = i.matched()
    best = m.candidates.filter("rank = 1").select("trip_id", "point_idx", "way_id")
    a = best.select("trip_id", F.col("point_idx").alias("start_idx"), F.col("way_id").alias("w0"))
    b = best.select("trip_id", F.col("point_idx").alias("end_idx"), F.col("way_id").alias("w1"))
    return m.windows.join(a, ["trip_id", "start_idx"]).join(b, ["trip_id", "end_idx"]).select(
        "trip_id", "window_idx", "start_idx", "end_idx", F.array("w0", "w1").alias("way_ids"), (F.col("start_idx") % 2 == 0).alias("is_subsequence")
    )


@query("way_expectation")
def way_expectation(i):
    """Are expected ways candidates, and contiguous in the chosen path?"""
    m = i.matched()
    chosen = diagnose.chosen_steps(m.trace, steps(i), m.paths)
    ways = chosen.groupBy("trip_id", "window_idx").agg(F.array_sort(F.collect_list(F.struct("pos", "way_id"))).way_id.alias("path_ways"))
    return diagnose.way_expectations(expectations(i), m.candidates, ways)


@query("way_presence")
def way_presence(i):
    """Where is each candidate way of a trip with respect to its route?"""
    m = i.matched()
    asked = m.candidates.select("trip_id", "way_id").distinct()
    return diagnose.way_presence(asked, matching.route_lines(m.routes, i.segments()), i.segments(), i.connections())


def last_pings(i):
    return i.pings().groupBy("user_id").agg(F.max_by(F.struct("lat", "lon"), F.struct("t", "event_id")).alias("p")).select("user_id", "p.*")


@query(
    "around_point",
    with_ctes(
        f"""SELECT l.user_id, s.layer, count(*) AS n_segments, round(min({hav("l.lat", "l.lon", "s.my", "s.mx")}),3) AS nearest_m FROM (
 SELECT user_id, arg_max(lat, (t, event_id)) AS lat, arg_max(lon, (t, event_id)) AS lon FROM pings GROUP BY 1) l
JOIN (SELECT segment_id, layer, (xs[1]+xs[n_nodes])/2 AS mx, (ys[1]+ys[n_nodes])/2 AS my FROM seg) s ON {hav("l.lat", "l.lon", "s.my", "s.mx")}<=2000 GROUP BY 1,2"""
    ),
)
def around_point(i):
    """Segments within 2 km of each user's last point, per layer."""
    found = diagnose.segments_around(last_pings(i), ["user_id"], i.segments().select("segment_id", "layer", "coordinates"))
    return found.groupBy("user_id", "layer").agg(F.count(F.lit(1)).alias("n_segments"), F.round(F.min("distance_m"), 3).alias("nearest_m"))


@query(
    "segment_style",
    with_ctes(
        """SELECT segment_id, CASE WHEN highway='motorway' THEN '#ff0000' WHEN highway='primary' AND is_bridge THEN '#ffcc00' WHEN highway='primary' THEN '#ffaa00' WHEN highway='secondary' THEN '#aaff00' WHEN highway='tertiary' THEN '#00aaff' WHEN layer>0 THEN '#aa00ff' WHEN layer<0 THEN '#006600' ELSE '#aaaaaa' END AS color,
 CASE highway WHEN 'motorway' THEN 5 WHEN 'primary' THEN 4 WHEN 'secondary' THEN 3 WHEN 'tertiary' THEN 3 ELSE 2 END AS weight FROM seg"""
    ),
)
def segment_style(i):
    """Color and width of each segment on the map."""
    return i.segments().select(
        "segment_id",
        roads.line_color(F.col("highway"), F.col("layer"), F.col("is_bridge")).alias("color"),
        roads.line_weight(F.col("highway")).alias("weight"),
    )


@query(
    "connection_nodes",
    with_ctes(
        """SELECT src, dst, coalesce(both_n[1], one_n[1], shared[1]) AS node_id FROM (
 SELECT c.src, c.dst, list_filter(a.nodes, lambda n: list_contains(b.nodes,n)) AS shared,
  list_filter(a.nodes, lambda n: list_contains(b.nodes,n) AND (n=a.nodes[1] OR n=a.nodes[-1]) AND (n=b.nodes[1] OR n=b.nodes[-1])) AS both_n,
  list_filter(a.nodes, lambda n: list_contains(b.nodes,n) AND (n=a.nodes[1] OR n=a.nodes[-1] OR n=b.nodes[1] OR n=b.nodes[-1])) AS one_n
 FROM allconn c JOIN seg a ON a.segment_id=c.src JOIN seg b ON b.segment_id=c.dst) x"""
    ),
)
def connection_nodes(i):
    """node that joins two connected segments."""
    s = i.segments().select("segment_id", "nodes")
    yes = F.lit(True)
    joined = i.connections().join(s.select(F.col("segment_id").alias("src"), F.col("nodes").alias("a")), "src").join(
        s.select(F.col("segment_id").alias("dst"), F.col("nodes").alias("b")), "dst"
    )
    return joined.select("src", "dst", roads.connection_node(F.col("a"), F.col("b"), yes, F.lit(False)).alias("node_id"))


@query("trip_connections")
def trip_connections(i):
    """Connected segments seen in any window of a trip."""
    return diagnose.connected_in_trip(steps(i), i.connections())


@query("match_explanations")
def match_explanations(i):
    """Explanation line per window."""
    m = i.matched()
    return diagnose.explanations(m.trace, diagnose.attempt_summary(attempts(i), m.windows))


@query("window_requests")
def window_requests(i):
    """Trace, attempts and reason of every window, as asked for by trip and window index."""
    m = i.matched()
    reasons = diagnose.attempt_summary(attempts(i), m.windows)
    asked = m.windows.select("trip_id", "window_idx", "start_idx", "end_idx")
    return asked.join(m.trace, ["trip_id", "window_idx"], "left").join(reasons, ["trip_id", "window_idx"], "left")


@query("features_segments")
def features_segments(i):
    """Segments as features."""
    return features.segment_features(i.segments())


@query("features_network")
def features_network(i):
    """Styled network features with degrees."""
    deg = network.in_out_degree(i.segments().select("segment_id"), i.connections())
    return features.network_features(i.segments(), deg)


@query("features_routes")
def features_routes(i):
    """Matched segments, entries, exits and junctions."""
    lines = matching.route_lines(i.matched().routes, i.segments())
    return features.route_features(lines, matching.junctions(lines))


@query("features_candidates")
def features_candidates(i):
    """Candidates of trip points."""
    return features.candidate_features(i.candidates(), i.segments())


@query("features_attempts")
def features_attempts(i):
    """Path attempts."""
    return features.attempt_features(attempts(i), i.segments())


@query("features_connections")
def features_connections(i):
    """Connections."""
    return features.connection_features(i.connections(), i.segments())


@query("route_geojson")
def route_geojson(i):
    """One FeatureCollection per matched trip."""
    lines = matching.route_lines(i.matched().routes, i.segments())
    return features.route_geojson(matching.route_coordinates(lines), matching.junctions(lines))
