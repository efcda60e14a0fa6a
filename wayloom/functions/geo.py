"""Geometry as Column expressions. Coordinates are doubles in degrees, distances in meters.

A polyline is ``array<struct<x double, y double>>`` with x = longitude and y = latitude.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayloom.config import CLIENT_EARTH_RADIUS_M, EARTH_RADIUS_M, METERS_PER_DEGREE


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (higher-order functions have no let)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def haversine(lat1, lon1, lat2, lon2, radius: float = EARTH_RADIUS_M) -> Column:
    """Great-circle distance in meters."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2.0 * radius) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def client_haversine(lat1, lon1, lat2, lon2) -> Column:
    return haversine(lat1, lon1, lat2, lon2, CLIENT_EARTH_RADIUS_M)


def heading(x1, y1, x2, y2) -> Column:
    """Angle of the vector from point 1 to point 2, in degrees from the x axis."""
    return F.degrees(F.atan2(y2 - y1, x2 - x1))


def equirectangular_km(lat1, lon1, lat2, lon2) -> Column:
    """Flat-earth distance in kilometers: 111.32 km per degree, longitude scaled at point 1."""
    dx = (lon2 - lon1) * F.lit(111.32) * F.cos(F.radians(lat1))
    dy = (lat2 - lat1) * F.lit(111.32)
    return F.sqrt(dx * dx + dy * dy)


def foot_fraction(px, py, ax, ay, bx, by) -> Column:
    """Where on the piece a→b the planar foot of p lies, clamped to [0, 1]."""
    dx, dy = bx - ax, by - ay
    len2 = dx * dx + dy * dy
    raw = ((px - ax) * dx + (py - ay) * dy) / F.nullif(len2, F.lit(0.0))
    return F.coalesce(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def pieces(coords: Column) -> Column:
    """Consecutive coordinate pairs as ``array<struct<a, b>>``; empty below two points."""
    n = F.greatest(F.size(coords) - 1, F.lit(0))
    return F.zip_with(
        F.slice(coords, F.lit(1), n),
        F.slice(coords, F.lit(2), n),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )


def polyline_length(coords: Column, radius: float = EARTH_RADIUS_M) -> Column:
    """Sum of the great-circle lengths of the pieces."""
    lengths = F.transform(
        pieces(coords), lambda p: haversine(p.a.y, p.a.x, p.b.y, p.b.x, radius)
    )
    return F.aggregate(lengths, F.lit(0.0), lambda acc, d: acc + d)


def cumulative_lengths(coords: Column) -> Column:
    """Distance from the first vertex for every vertex; same size as ``coords``."""
    lengths = F.transform(pieces(coords), lambda p: haversine(p.a.y, p.a.x, p.b.y, p.b.x))
    return F.aggregate(
        lengths,
        F.array(F.lit(0.0)),
        lambda acc, d: F.concat(acc, F.array(F.element_at(acc, -1) + d)),
    )


def closest_on_polyline(px: Column, py: Column, coords: Column) -> Column:
    """Planar (degree-space) closest point: ``struct<d2, piece, x, y>``, first piece on ties.

    A polyline of one vertex is that vertex.
    """

    def on_piece(p: Column, i: Column) -> Column:
        return bind(
            foot_fraction(px, py, p.a.x, p.a.y, p.b.x, p.b.y),
            lambda t: bind(
                F.struct(
                    (p.a.x + t * (p.b.x - p.a.x)).alias("x"),
                    (p.a.y + t * (p.b.y - p.a.y)).alias("y"),
                ),
                lambda q: F.struct(
                    ((q.x - px) * (q.x - px) + (q.y - py) * (q.y - py)).alias("d2"),
                    i.alias("piece"),
                    q.x.alias("x"),
                    q.y.alias("y"),
                ),
            ),
        )

    first = F.element_at(coords, 1)
    single = F.struct(
        ((first.x - px) * (first.x - px) + (first.y - py) * (first.y - py)).alias("d2"),
        F.lit(0).alias("piece"),
        first.x.alias("x"),
        first.y.alias("y"),
    )
    return F.when(F.size(coords) == 1, single).otherwise(
        F.array_min(F.transform(pieces(coords), on_piece))
    )


def distance_to_polyline(px: Column, py: Column, coords: Column) -> Column:
    """Great-circle distance to the planar closest point."""
    return bind(closest_on_polyline(px, py, coords), lambda c: haversine(py, px, c.y, c.x))


def nearest_vertex(px: Column, py: Column, coords: Column) -> Column:
    """0-based index of the vertex with the least great-circle distance, first on ties."""
    ranked = F.transform(
        coords, lambda c, i: F.struct(haversine(py, px, c.y, c.x).alias("d"), i.alias("i"))
    )
    return F.array_min(ranked).i


def with_scaled_piece_distance(df, out: str):
    """Adds the distance from (lat, lon) to the piece (ay, ax)–(by, bx) on a plane whose
    longitudes shrink with the mean latitude. Pieces under one meter count as their nearer end.

    Built in steps, each a column used more than once, so that the generated code stays small
    enough for the JIT compiler.
    """
    lat, lon, ay, ax, by, bx = (F.col(c) for c in ("lat", "lon", "ay", "ax", "by", "bx"))
    flat = df.withColumns({
        "_dx": F.radians(bx - ax) * F.cos(F.radians(ay + by) / 2),
        "_dy": F.radians(by - ay),
        "_px": F.radians(lon - ax) * F.cos(F.radians(ay + lat) / 2),
        "_py": F.radians(lat - ay),
    })
    zero = F.lit(0.0)
    foot = flat.withColumn("_t", foot_fraction(F.col("_px"), F.col("_py"), zero, zero, F.col("_dx"), F.col("_dy")))
    placed = foot.withColumns({"_qy": ay + F.col("_t") * (by - ay), "_qx": ax + F.col("_t") * (bx - ax)})
    ends = F.least(client_haversine(lat, lon, ay, ax), client_haversine(lat, lon, by, bx))
    # Under a meter is under 1e-5 degrees of latitude: the test is cheap for all other pieces.
    short = F.when(F.abs(by - ay) < 1e-5, client_haversine(ay, ax, by, bx) < 1.0).otherwise(False)
    d = F.when(short, ends).otherwise(client_haversine(lat, lon, F.col("_qy"), F.col("_qx")))
    return placed.withColumn(out, d).drop("_dx", "_dy", "_px", "_py", "_t", "_qy", "_qx")


def bbox(coords: Column) -> Column:
    """``struct<min_x, min_y, max_x, max_y>``; an empty polyline gives the whole world."""
    xs = F.transform(coords, lambda c: c.x)
    ys = F.transform(coords, lambda c: c.y)
    return F.struct(
        F.coalesce(F.array_min(xs), F.lit(-180.0)).alias("min_x"),
        F.coalesce(F.array_min(ys), F.lit(-90.0)).alias("min_y"),
        F.coalesce(F.array_max(xs), F.lit(180.0)).alias("max_x"),
        F.coalesce(F.array_max(ys), F.lit(90.0)).alias("max_y"),
    )


def grow_bbox(box: Column, radius_m: float) -> Column:
    """Grow a box on every side by twice the radius, in degrees."""
    d = F.lit(2.0 * radius_m / METERS_PER_DEGREE)
    return F.struct(
        (box.min_x - d).alias("min_x"),
        (box.min_y - d).alias("min_y"),
        (box.max_x + d).alias("max_x"),
        (box.max_y + d).alias("max_y"),
    )


def ends_midpoint(coords: Column) -> Column:
    """Midpoint of first and last vertex, the segment's reference point."""
    a, b = F.element_at(coords, 1), F.element_at(coords, -1)
    return F.struct(((a.x + b.x) / 2).alias("x"), ((a.y + b.y) / 2).alias("y"))


def vertex_mean(coords: Column) -> Column:
    n = F.size(coords).cast("double")

    def mean(pick) -> Column:
        return F.aggregate(coords, F.lit(0.0), lambda acc, c: acc + pick(c)) / n

    return F.struct(mean(lambda c: c.x).alias("x"), mean(lambda c: c.y).alias("y"))


def heading_at(px: Column, py: Column, coords: Column) -> Column:
    """Heading of the piece whose start vertex is nearest to the point."""
    ranked = F.transform(
        pieces(coords),
        lambda p, i: F.struct(
            haversine(py, px, p.a.y, p.a.x).alias("d"),
            i.alias("i"),
            heading(p.a.x, p.a.y, p.b.x, p.b.y).alias("h"),
        ),
    )
    return F.array_min(ranked).h


def used_slice(coords: Column, entry: Column, exit_: Column, is_oneway: Column) -> Column:
    """Coordinates of the travelled part: forward slice, reversed slice, or the whole
    segment when a one-way road would be travelled backward."""
    lo, n = F.least(entry, exit_), F.abs(exit_ - entry) + 1
    part = F.slice(coords, lo + 1, n)
    return (
        F.when(entry <= exit_, part).when(is_oneway, coords).otherwise(F.reverse(part))
    )


#: From this latitude on, circles around a point may hold the pole and are not bounded in longitude.
POLAR_DEG = 89.9


def lon_reach(abs_lat: Column, radius_deg: float) -> Column:
    """Longitudes that a circle around a point at this latitude (below ``POLAR_DEG``) reaches to each side."""
    lat = F.least(abs_lat, F.lit(POLAR_DEG))
    return F.degrees(F.asin(F.least(F.sin(F.radians(F.lit(radius_deg))) / F.cos(F.radians(lat)), F.lit(1.0))))


def planar_reach(abs_lat: Column, radius_deg: float) -> Column:
    """Greatest distance in degrees between a point and what lies within the radius of it."""
    dx = lon_reach(abs_lat + radius_deg, radius_deg)
    return F.sqrt(dx * dx + F.lit(radius_deg) * F.lit(radius_deg))


#: Up to this latitude searches compare pieces by their planar distance; beyond, whole lines.
HIGH_DEG = 80.0


def search_margin(radius_deg: float):
    """Margin around a line's span below ``HIGH_DEG``, by its greatest absolute latitude: no point whose
    planar reach meets the span lies farther away."""
    # The reach is at most six radii here, and so is what the latitudes of both can differ by.
    return lambda abs_lat: planar_reach(F.least(abs_lat + 6 * radius_deg, F.lit(HIGH_DEG)), radius_deg)


def lon_cells(x: Column, d: Column, size: float) -> Column:
    """Cells of [x - d, x + d], going on at the other side of the antimeridian."""
    at = F.lit(size)

    def run(lo: Column, hi: Column) -> Column:
        return F.sequence(tile_index(lo, at), tile_index(hi, at))

    none = F.array().cast("array<bigint>")
    west = F.when(x - d < -180, run(x - d + 360, F.greatest(x - d + 360, F.lit(180.0)))).otherwise(none)
    east = F.when(x + d > 180, run(F.lit(-180.0), F.greatest(x + d - 360, F.lit(-180.0)))).otherwise(none)
    return F.array_distinct(F.concat(run(x - d, x + d), west, east))


def tile_index(value: Column, size) -> Column:
    return F.floor(value / size).cast("long")


def tile_id(x: Column, y: Column, base_size: float, depth: Column) -> Column:
    size = F.lit(base_size) / F.pow(F.lit(2.0), depth)
    return F.concat_ws(
        "_",
        tile_index(x, size).cast("string"),
        tile_index(y, size).cast("string"),
        depth.cast("string"),
    )


def tile_bbox(tile: Column, base_size: float) -> Column:
    """Box of a tile id ``x_y_depth``."""
    parts = F.split(tile, "_")
    tx, ty = parts[0].cast("double"), parts[1].cast("double")
    size = F.lit(base_size) / F.pow(F.lit(2.0), parts[2].cast("double"))
    return F.struct(
        (tx * size).alias("min_x"),
        (ty * size).alias("min_y"),
        ((tx + 1) * size).alias("max_x"),
        ((ty + 1) * size).alias("max_y"),
    )


def wkt_linestring(points: Column) -> Column:
    """WKT text of an array of ``struct<x, y>``."""
    return F.concat(
        F.lit("LINESTRING("),
        F.array_join(
            F.transform(points, lambda c: F.concat_ws(" ", c.x.cast("string"), c.y.cast("string"))),
            ", ",
        ),
        F.lit(")"),
    )


def bbox_ring(box: Column) -> Column:
    """Closed ring of five points, counter-clockwise from the lower left corner."""

    def pt(x, y):
        return F.struct(x.alias("x"), y.alias("y"))

    return F.array(
        pt(box.min_x, box.min_y),
        pt(box.max_x, box.min_y),
        pt(box.max_x, box.max_y),
        pt(box.min_x, box.max_y),
        pt(box.min_x, box.min_y),
    )


def _turn(ax, ay, bx, by, cx, cy) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def pieces_intersect(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Do the closed pieces a–b and c–d meet, touching and overlap included?"""
    abc, abd = _turn(ax, ay, bx, by, cx, cy), _turn(ax, ay, bx, by, dx, dy)
    cda, cdb = _turn(cx, cy, dx, dy, ax, ay), _turn(cx, cy, dx, dy, bx, by)
    boxes_meet = (
        (F.greatest(ax, bx) >= F.least(cx, dx))
        & (F.greatest(cx, dx) >= F.least(ax, bx))
        & (F.greatest(ay, by) >= F.least(cy, dy))
        & (F.greatest(cy, dy) >= F.least(ay, by))
    )
    return boxes_meet & (abc * abd <= 0) & (cda * cdb <= 0)
