"""GeoJSON features of segments, routes, candidates and attempts, one row per feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.functions import roads


def pair(x: Column, y: Column) -> Column:
    return F.array(x, y)


def line_geometry(coords: Column) -> Column:
    return F.to_json(F.struct(F.lit("LineString").alias("type"), F.transform(coords, lambda c: pair(c.x, c.y)).alias("coordinates")))


def point_geometry(x: Column, y: Column) -> Column:
    return F.to_json(F.struct(F.lit("Point").alias("type"), pair(x, y).alias("coordinates")))


def feature(properties: Column, geometry: Column) -> Column:
    """Feature text from a struct of properties and geometry text."""
    return F.concat(
        F.lit('{"type":"Feature","properties":'), F.to_json(properties), F.lit(',"geometry":'), geometry, F.lit("}")
    )


def collection(features: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One FeatureCollection text per key, features in order. For small keys such as one trip's
    route; whole networks stay one row per feature."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct(*order, "feature"))), lambda f: f["feature"])
    return features.groupBy(*key).agg(
        F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(texts, ","), F.lit("]}")).alias("geo_json")
    )


def _text(c) -> Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def segment_features(segs: DataFrame, color: str = "#3388ff", weight: int = 4) -> DataFrame:
    about = F.concat(
        F.lit("Segment ID: "), _text("segment_id"), F.lit(" (OSM: "), _text("way_id"), F.lit("), Type: "), "highway",
        F.lit(", Name: "), F.coalesce("name", F.lit("Unnamed")),
    )
    props = F.struct(
        "segment_id", F.col("way_id").alias("osm_way_id"), F.col("highway").alias("highway_type"), "is_oneway", "name",
        F.lit(color).alias("color"), F.lit(weight).alias("weight"), F.lit(0.8).alias("opacity"), about.alias("description"),
    )
    return segs.select("segment_id", feature(props, line_geometry(F.col("coordinates"))).alias("feature"))


def network_features(segs: DataFrame, degrees: DataFrame) -> DataFrame:
    """Segments with layer, degrees and map style. ``degrees`` has segment_id, n_in, n_out."""
    props = F.struct(
        "segment_id", F.col("way_id").alias("osm_way_id"), F.col("highway").alias("highway_type"), "name", "layer", "is_bridge",
        "is_tunnel", "n_in", "n_out",
        roads.line_color(F.col("highway"), F.col("layer"), F.col("is_bridge")).alias("color"),
        roads.line_weight(F.col("highway")).alias("weight"),
    )
    return segs.join(degrees, "segment_id").select("segment_id", feature(props, line_geometry(F.col("coordinates"))).alias("feature"))


def route_features(lines: DataFrame, junctions: DataFrame, key: str = "trip_id") -> DataFrame:
    """Steps of a route with entry and exit points, then its junctions."""
    props = F.struct(
        F.lit("matched_segment").alias("type"), "seq", "segment_id", F.col("way_id").alias("osm_way_id"),
        F.col("highway").alias("highway_type"), "entry_idx", "exit_idx", "reversed",
    )
    steps = lines.select(key, F.lit(0).alias("part"), "seq", feature(props, line_geometry(F.col("line"))).alias("feature"))
    ends = lines.select(
        key, "seq",
        F.explode(F.array(
            F.struct(F.lit("entry").alias("type"), F.element_at("line", 1).alias("c"), F.col("start_node").alias("node_id")),
            F.struct(F.lit("exit").alias("type"), F.element_at("line", -1).alias("c"), F.col("end_node").alias("node_id")),
        )).alias("e"),
    ).select(
        key, F.when(F.col("e.type") == "entry", 1).otherwise(2).alias("part"), "seq",
        feature(F.struct("e.type", "e.node_id", "seq"), point_geometry(F.col("e.c.x"), F.col("e.c.y"))).alias("feature"),
    )
    joints = junctions.select(
        key, F.lit(3).alias("part"), "seq",
        feature(F.struct(F.lit("junction").alias("type"), "node_id", F.lit("#ffff00").alias("color"), F.lit(6).alias("radius")), point_geometry(F.col("x"), F.col("y"))).alias("feature"),
    )
    return steps.unionByName(ends).unionByName(joints)


def route_geojson(coords: DataFrame, junctions: DataFrame, key: str = "trip_id") -> DataFrame:
    """Route as one FeatureCollection: the whole line, then the junctions. ``coords`` has the
    key, seq, i, x, y in route order."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "i", "x", "y")))
    line = coords.groupBy(key).agg(ordered.alias("v"))
    props = F.struct(F.lit("matched_route").alias("type"), F.lit("#FF0000").alias("color"), F.lit(4).alias("weight"))
    main = line.select(key, F.lit(-1).cast("long").alias("seq"), feature(props, line_geometry(F.transform("v", lambda p: F.struct(p.x, p.y)))).alias("feature"))
    joints = junctions.select(
        key, F.col("seq").cast("long").alias("seq"),
        feature(F.struct(F.lit("junction").alias("type"), "node_id"), point_geometry(F.col("x"), F.col("y"))).alias("feature"),
    )
    return collection(main.unionByName(joints), [key], ["seq"])


def candidate_features(candidates: DataFrame, segs: DataFrame) -> DataFrame:
    """Per trip point: the point, its candidate segments, their projections and the lines to
    them."""
    key = ["trip_id", "point_idx"]
    about = F.concat(F.lit("GPS Point #"), _text("point_idx"))
    points = candidates.select(*key, "lat", "lon").distinct().select(
        *key, F.lit(0).cast("long").alias("rank"), F.lit("gps_point").alias("kind"),
        feature(F.struct(F.lit("gps_point").alias("type"), F.col("point_idx").alias("index"), about.alias("description")), point_geometry(F.col("lon"), F.col("lat"))).alias("feature"),
    )
    c = candidates.join(segs.select("segment_id", "coordinates"), "segment_id")
    base = F.struct("rank", "segment_id", F.col("way_id").alias("osm_way_id"), "distance_m", "cost")

    def kind(name: str, geometry: Column) -> Column:
        return F.struct(F.lit(name).alias("kind"), geometry.alias("geometry"))

    link = F.array(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")), F.struct(F.col("proj_x").alias("x"), F.col("proj_y").alias("y")))
    parts = F.array(
        kind("candidate_segment", line_geometry(F.col("coordinates"))),
        kind("projection", point_geometry(F.col("proj_x"), F.col("proj_y"))),
        kind("projection_line", line_geometry(link)),
    )
    rest = c.withColumn("p", F.explode(parts)).select(
        *key, "rank", F.col("p.kind").alias("kind"),
        feature(F.struct(F.col("p.kind").alias("type"), base.alias("candidate")), F.col("p.geometry")).alias("feature"),
    )
    return points.unionByName(rest)


def attempt_features(attempts: DataFrame, segs: DataFrame) -> DataFrame:
    """Path attempts as lines between the two segments' midpoints, with their outcome."""
    from wayloom.functions.geo import ends_midpoint

    mid = segs.select("segment_id", ends_midpoint(F.col("coordinates")).alias("m"))
    a = mid.select(F.col("segment_id").alias("from_seg"), F.col("m").alias("a"))
    b = mid.select(F.col("segment_id").alias("to_seg"), F.col("m").alias("b"))
    props = F.struct(F.lit("path_attempt").alias("type"), "from_seg", "to_seg", "result", "distance_m", "cost")
    return attempts.join(a, "from_seg").join(b, "to_seg").select(
        "trip_id", "window_idx", "from_seg", "to_seg", feature(props, line_geometry(F.array("a", "b"))).alias("feature")
    )


def connection_features(conns: DataFrame, segs: DataFrame) -> DataFrame:
    """Connections as lines between midpoints."""
    from wayloom.functions.geo import ends_midpoint

    mid = segs.select("segment_id", ends_midpoint(F.col("coordinates")).alias("m"))
    a = mid.select(F.col("segment_id").alias("src"), F.col("m").alias("a"))
    b = mid.select(F.col("segment_id").alias("dst"), F.col("m").alias("b"))
    props = F.struct(F.lit("connection").alias("type"), "src", "dst")
    return conns.join(a, "src").join(b, "dst").select("src", "dst", feature(props, line_geometry(F.array("a", "b"))).alias("feature"))
