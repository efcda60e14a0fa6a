"""Points to nearby segments: a distance join over a grid, then the best few per point."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayloom.config import MATCH, METERS_PER_DEGREE, MatchConfig
from wayloom.functions import geo
from wayloom.operators.network import piece_cells, segment_pieces
from wayloom.operators.skew import salted_join


def _met(points: DataFrame, key: list[str], pieces: DataFrame, cell_deg: float, margin, margin_y: float | None = None) -> DataFrame:
    """Points with the pieces whose cells within the margin hold them.

    Pieces are repeated over cells and each point lies in one, so the big side is never multiplied.
    Cells crowded with points are salted. Long pieces are only followed where points lie.
    """
    located = points.select(
        *key, "lat", "lon",
        geo.tile_index(F.col("lon"), F.lit(cell_deg)).alias("cell_x"),
        geo.tile_index(F.col("lat"), F.lit(cell_deg)).alias("cell_y"),
    )
    cells = piece_cells(pieces, cell_deg, margin, margin_y, located.select("cell_x", "cell_y").distinct())
    return salted_join(located, cells, ["cell_x", "cell_y"], [*key, "lat", "lon"]).drop("cell_x", "cell_y")


def _polar(radius_deg: float):
    return F.abs(F.col("lat")) + radius_deg >= geo.POLAR_DEG


def _at_poles(points: DataFrame, key: list[str], segs: DataFrame, radius_deg: float) -> DataFrame:
    """Points next to a pole, where longitudes say nothing, with all segments that come near it."""
    ys = F.transform("coordinates", lambda c: c.y)
    edge = geo.POLAR_DEG - 3 * radius_deg
    poles = F.array_compact(F.array(F.when(F.array_max(ys) >= edge, 1.0), F.when(F.array_min(ys) <= -edge, -1.0)))
    there = segs.select("segment_id", F.explode(poles).alias("pole"))
    return points.filter(_polar(radius_deg)).select(*key, "lat", "lon", F.signum("lat").alias("pole")).join(there, "pole").drop("pole")


def near_segments(points: DataFrame, key: list[str], segs: DataFrame, radius_m: float, cell_deg: float) -> DataFrame:
    """All (point, segment) pairs closer than ``radius_m``, with the planar closest point of the segment.

    The result equals a search over whole segments at every latitude: below ``HIGH_DEG`` the margin of the
    grid join covers what is planar nearer than any hit, beyond it the pairs found are compared
    with the whole line. ``points`` has the key, lat and lon.
    """
    r = radius_m / METERS_PER_DEGREE
    is_high = F.abs(F.col("lat")) + r >= geo.HIGH_DEG
    px, py = F.col("lon"), F.col("lat")
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    reach = geo.planar_reach(F.abs(py), r)
    joined = (
        _met(points.filter(~is_high), key, segment_pieces(segs), cell_deg, geo.search_margin(r))
        .withColumn("f", geo.foot_fraction(px, py, ax, ay, bx, by))
        .withColumn("proj_x", ax + F.col("f") * (bx - ax))
        .withColumn("proj_y", ay + F.col("f") * (by - ay))
        .withColumn(
            "d2",
            (F.col("proj_x") - px) * (F.col("proj_x") - px) + (F.col("proj_y") - py) * (F.col("proj_y") - py),
        )
        # Only rows that can still count go into the aggregation.
        .filter(F.col("d2") <= reach * reach)
    )
    best = F.min_by(F.struct("proj_x", "proj_y"), F.struct("d2", "piece"))
    low = joined.groupBy(*key, "lat", "lon", "segment_id").agg(best.alias("p"))
    ys = F.transform("coordinates", lambda c: F.abs(c.y))
    far = segs.filter(F.array_max(ys) >= geo.HIGH_DEG - 3 * r)
    high_points = points.filter(is_high)
    pairs = _met(high_points.filter(~_polar(r)), key, segment_pieces(far), cell_deg, lambda y: geo.lon_reach(y + r, r), r)
    pairs = pairs.select(*key, "lat", "lon", "segment_id").unionByName(_at_poles(high_points, key, far, r)).distinct()
    closest = geo.closest_on_polyline(px, py, F.col("coordinates"))
    high = (
        pairs.join(far.select("segment_id", "coordinates"), "segment_id").withColumn("c", closest)
        .select(*key, "lat", "lon", "segment_id", F.struct(F.col("c.x").alias("proj_x"), F.col("c.y").alias("proj_y")).alias("p"))
    )
    return (
        low.unionByName(high)
        .select(
            *key, "lat", "lon", "segment_id", "p.*",
            geo.haversine(F.col("lat"), F.col("lon"), F.col("p.proj_y"), F.col("p.proj_x")).alias("distance_m"),
        )
        .filter(F.col("distance_m") <= radius_m)
    )


def rank_candidates(near: DataFrame, key: list[str], cfg: MatchConfig = MATCH, radius_m: float | None = None) -> DataFrame:
    """Best ``max_candidates`` segments per point. Points with no segment within the radius use
    those up to the extended radius, at a higher cost. Costs equal to 1e-6 go by segment id."""
    r = cfg.radius_m if radius_m is None else radius_m
    is_near = F.col("distance_m") <= r
    per_point = Window.partitionBy(*key)
    cost = F.col("distance_m") / (r / 2)
    return (
        near.filter(F.col("distance_m") <= r * cfg.extend_factor)
        .withColumn("_any_near", F.max(is_near).over(per_point))
        .filter(is_near | ~F.col("_any_near"))
        .withColumn("extended", ~F.col("_any_near"))
        .withColumn("cost", F.when(F.col("extended"), cost * cfg.extend_factor).otherwise(cost))
        .withColumn("rank", F.row_number().over(per_point.orderBy(F.round("cost", 6), "segment_id")).cast("long"))
        .filter(F.col("rank") <= cfg.max_candidates)
        .drop("_any_near")
    )


def candidates(points: DataFrame, key: list[str], segs: DataFrame, cfg: MatchConfig = MATCH, radius_m: float | None = None) -> DataFrame:
    """Ranked candidates with the vertex nearest to the projection."""
    r = cfg.radius_m if radius_m is None else radius_m
    near = near_segments(points, key, segs, r * cfg.extend_factor, cfg.cell_deg)
    ranked = rank_candidates(near, key, cfg, r)
    lines = segs.select("segment_id", "way_id", "coordinates")
    return ranked.join(lines, "segment_id").withColumn(
        "vertex_idx", geo.nearest_vertex(F.col("proj_x"), F.col("proj_y"), F.col("coordinates"))
    ).drop("coordinates")


def unmatched_points(points: DataFrame, key: list[str], found: DataFrame) -> DataFrame:
    return points.join(found.select(*key).distinct(), key, "left_anti")


def nearest_segment(points: DataFrame, key: list[str], segs: DataFrame, radius_m: float, cell_deg: float) -> DataFrame:
    """The one closest segment per point within the radius, by the clients' flat distance."""
    # Twice the radius covers the difference between the two distance measures.
    r = 2.0 * radius_m / METERS_PER_DEGREE
    pieces = segment_pieces(segs)
    met = _met(points.filter(~_polar(r)), key, pieces, cell_deg, lambda y: geo.lon_reach(y + r, r), r)
    met = met.unionByName(_at_poles(points, key, segs, r).join(pieces, "segment_id").select(met.columns))
    return (
        geo.with_scaled_piece_distance(met, "distance_m")
        .groupBy(*key)
        .agg(F.min(F.struct(F.round("distance_m", 6).alias("distance_m"), "segment_id")).alias("m"))
        .filter(F.col("m.distance_m") <= radius_m)
        .select(*key, "m.segment_id", "m.distance_m")
    )


def closest_vertex_pair(pairs: DataFrame, segs: DataFrame) -> DataFrame:
    """For pairs (a_id, b_id): the two closest vertices, by flat distance."""
    a = segs.select(F.col("segment_id").alias("a_id"), F.col("coordinates").alias("a_line"))
    b = segs.select(F.col("segment_id").alias("b_id"), F.col("coordinates").alias("b_line"))

    def to_b(p, i):
        return F.array_min(
            F.transform("b_line", lambda q, j: F.struct(geo.equirectangular_km(p.y, p.x, q.y, q.x).alias("km"), i.alias("i"), j.alias("j")))
        )

    # One row of the product at a time: only the least of each vertex is kept.
    best = F.array_min(F.transform("a_line", to_b))
    return (
        pairs.join(a, "a_id").join(b, "b_id").withColumn("best", best)
        .select(*pairs.columns, F.col("best.i").alias("a_idx"), F.col("best.j").alias("b_idx"), F.col("best.km").alias("distance_km"))
    )
