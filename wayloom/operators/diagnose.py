"""Why a trip was matched the way it was."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.config import METERS_PER_DEGREE
from wayloom.functions import geo, roads
from wayloom.operators import reach
from wayloom.operators.matching import WINDOW
from wayloom.session import materialize

PAIR = [*WINDOW, "from_seg", "to_seg"]


def candidate_pairs(candidates: DataFrame, windows: DataFrame, segs: DataFrame, top: int | None = None) -> DataFrame:
    """First × last candidates of every window, without pairs on one segment, and the distance between
    the reference points of both segments.

    A window has at most ``max_candidates`` candidates on each side. ``top`` keeps the best few.
    """
    c = candidates.select("trip_id", "point_idx", "segment_id", "way_id", "rank")
    if top is not None:
        c = c.filter(F.col("rank") <= top)
    c = c.join(segs.select("segment_id", geo.ends_midpoint(F.col("coordinates")).alias("mid")), "segment_id")

    def side(idx: str, end: str) -> DataFrame:
        return c.select(
            "trip_id", F.col("point_idx").alias(idx), F.col("segment_id").alias(f"{end}_seg"),
            F.col("way_id").alias(f"{end}_way"), F.col("mid").alias(f"{end}_mid"),
        )

    apart = geo.haversine(F.col("from_mid.y"), F.col("from_mid.x"), F.col("to_mid.y"), F.col("to_mid.x"))
    return (
        windows.join(side("start_idx", "from"), ["trip_id", "start_idx"])
        .join(side("end_idx", "to"), ["trip_id", "end_idx"])
        .filter(F.col("from_seg") != F.col("to_seg"))
        .select(*PAIR, "from_way", "to_way", apart.alias("distance_m"))
    )


def path_attempts(candidates: DataFrame, windows: DataFrame, paths: DataFrame, segs: DataFrame, transitions: DataFrame, top: int | None = None) -> DataFrame:
    """Every candidate pair of every window with the outcome of its search: "success"; "no_connection"
    where no way leads from the first segment, entered at its candidate's vertex, to the last, however long; else "too_far": a way
    exists, but not within the length limit."""
    pairs = materialize(candidate_pairs(candidates, windows, segs, top), "attempts")
    found = paths.select(*PAIR, "cost", F.size("path").alias("n_steps"))
    entry = F.col("vertex_idx") if "vertex_idx" in candidates.columns else F.lit(0)
    entries = candidates.select("trip_id", F.col("point_idx").alias("start_idx"), F.col("segment_id").alias("from_seg"), entry.cast("int").alias("from_entry"))
    tried = pairs.join(found, PAIR, "left").join(windows.select(*WINDOW, "start_idx"), WINDOW)
    tried = materialize(tried.join(entries, ["trip_id", "start_idx", "from_seg"]).drop("start_idx"), "attempts")
    asked = ["from_seg", "from_entry", "to_seg"]
    ways = reach.search_reach(tried.filter("cost IS NULL").select(asked).distinct(), transitions).withColumn("_way", F.lit(True))
    result = F.when(F.col("cost").isNotNull(), "success").when(F.col("_way"), "too_far").otherwise("no_connection")
    return tried.join(ways, asked, "left").select(*PAIR, "from_way", "to_way", "distance_m", "cost", "n_steps", result.alias("result"))


def attempt_summary(attempts: DataFrame, windows: DataFrame) -> DataFrame:
    """Overall reason per window from the outcomes of its attempts."""

    def count_of(kind: str) -> Column:
        return F.sum(F.when(F.col("result") == kind, 1).otherwise(0))

    counts = attempts.groupBy(*WINDOW).agg(
        F.count(F.lit(1)).alias("n"), count_of("success").alias("n_success"),
        count_of("too_far").alias("n_far"), count_of("no_connection").alias("n_apart"),
    )
    n = F.coalesce("n", F.lit(0))
    text = lambda c: F.col(c).cast("string")
    # Worded for this library; n_attempts tells the rest.
    reason = (
        F.when(n == 0, "no pair of candidates to search between")
        .when(F.col("n_success") > 0, F.concat(text("n_success"), F.lit(" of "), text("n"), F.lit(" pairs have a path")))
        .when(F.col("n_far") == n, "every pair is beyond the length limit")
        .when(F.col("n_apart") == n, "no pair is connected by roads")
        .otherwise(F.concat(text("n_far"), F.lit(" pairs beyond the length limit, "), text("n_apart"), F.lit(" not connected")))
    )
    return windows.select(*WINDOW).join(counts, WINDOW, "left").select(*WINDOW, n.alias("n_attempts"), reason.alias("reason"))


def window_stats(steps: DataFrame, trace: DataFrame, attempts: DataFrame) -> DataFrame:
    """Per window: segments and flat length of the chosen path, road classes, constraints, and
    the ways that were tried. ``steps`` are the chosen paths' steps with their lines."""
    km = F.aggregate(
        geo.pieces(F.col("line")), F.lit(0.0),
        lambda acc, p: acc + geo.equirectangular_km(p.a.y, p.a.x, p.b.y, p.b.x),
    )
    chosen = steps.groupBy(*WINDOW).agg(
        F.count(F.lit(1)).alias("n_segments"), F.sum(km).alias("length_km"),
        F.array_sort(F.collect_set("highway")).alias("highway_types"),
    )
    tried = (
        attempts.select(*WINDOW, F.explode(F.array("from_way", "to_way")).alias("way_id"))
        .groupBy(*WINDOW).agg(F.countDistinct("way_id").alias("n_attempted_ways"))
    )
    return (
        trace.join(chosen, WINDOW, "left").join(tried, WINDOW, "left")
        .select(
            *WINDOW, F.coalesce("n_segments", F.lit(0)).alias("n_segments"), F.coalesce("length_km", F.lit(0.0)).alias("length_km"),
            F.array_join("highway_types", ",").alias("highway_types"), "bridge", "used_constraints",
            F.col("constraint_segment").isNotNull().cast("int").alias("n_constraints"), "score",
            F.coalesce("n_attempted_ways", F.lit(0)).alias("n_attempted_ways"),
        )
    )


def chosen_steps(trace: DataFrame, steps: DataFrame, scored: DataFrame) -> DataFrame:
    """Steps of the path each window chose, found by its first segment and score."""
    picked = trace.filter(F.col("from_seg").isNotNull()).select(*WINDOW, "from_seg", "score")
    pairs = scored.join(picked, [*WINDOW, "from_seg", "score"], "left_semi")
    one = pairs.groupBy(*WINDOW).agg(F.min_by(F.struct("from_seg", "to_seg"), F.struct("to_rank", "to_seg")).alias("p")).select(*WINDOW, "p.*")
    return steps.join(one, PAIR, "left_semi")


def way_expectations(expected: DataFrame, candidates: DataFrame, chosen_ways: DataFrame) -> DataFrame:
    """Check expected way sequences (trip_id, window_idx, start_idx, end_idx, way_ids,
    is_subsequence): was each way a candidate, and is the sequence part of the chosen path?"""
    key = ["trip_id", "window_idx"]
    wanted = expected.select(*key, "start_idx", "end_idx", F.posexplode("way_ids").alias("pos", "way_id"))
    # The best candidate of a way per point, as rank and cost.
    c = candidates.groupBy("trip_id", "point_idx", "way_id").agg(F.min(F.struct("rank", "cost")).alias("best"))
    seen = (
        wanted.join(c, ["trip_id", "way_id"], "left")
        .withColumn("ok", F.coalesce(F.col("point_idx").between(F.col("start_idx"), F.col("end_idx")), F.lit(False)))
        .groupBy(*key, "pos", "way_id")
        .agg(F.max("ok").alias("found"), F.min(F.when(F.col("ok"), F.col("best.rank"))).alias("rank"))
    )
    per = seen.groupBy(*key).agg(
        F.min("found").alias("all_found"),
        F.array_sort(F.collect_list(F.struct("pos", "way_id", "found", "rank"))).alias("ways"),
    )
    path = chosen_ways.select(*key, "path_ways")
    hit = roads.contains_run(F.coalesce("path_ways", F.array().cast("array<bigint>")), F.col("way_ids"))
    outcome = (
        F.when(~F.col("all_found") & ~F.col("is_subsequence"), "no_candidate")
        .when(hit, "taken")
        .otherwise("not_taken")
    )
    checked = expected.join(per, key).join(path, key, "left").withColumn("outcome", outcome)
    return checked.select(
        *key, F.to_json("way_ids").alias("way_id_list"), "all_found",
        F.array_join(F.transform("ways", lambda w: F.coalesce(w["rank"].cast("string"), F.lit("-"))), ",").alias("ranks"),
        "outcome",
    )


def way_presence(asked: DataFrame, lines: DataFrame, segs: DataFrame, conns: DataFrame) -> DataFrame:
    """For ways (trip_id, way_id): in the route? in the network? Which route step is nearest by
    centroid, and is it connected to the way's segment?"""
    in_route = lines.select("trip_id", "way_id").distinct().withColumn("in_route", F.lit(True))
    first = segs.groupBy("way_id").agg(F.min_by(F.struct("segment_id", "highway", "coordinates"), "segment_id").alias("s"))
    target = asked.join(in_route, ["trip_id", "way_id"], "left").join(first, "way_id", "left").select(
        "trip_id", "way_id", F.coalesce("in_route", F.lit(False)).alias("in_route"), F.col("s.segment_id").alias("segment_id"),
        F.col("s.highway").alias("highway"), geo.ends_midpoint(F.col("s.coordinates")).alias("m"),
    )
    steps = lines.select("trip_id", "seq", F.col("segment_id").alias("route_seg"), F.col("highway").alias("route_highway"), geo.vertex_mean(F.col("line")).alias("c"))
    d = geo.haversine(F.col("m.y"), F.col("m.x"), F.col("c.y"), F.col("c.x"))
    nearest = (
        target.filter(~F.col("in_route") & F.col("segment_id").isNotNull())
        .join(steps, "trip_id")
        .groupBy("trip_id", "way_id", "segment_id")
        .agg(F.min(F.struct(d.alias("distance_m"), "seq", "route_seg", "route_highway")).alias("n"))
        .select("trip_id", "way_id", "segment_id", "n.*")
    )
    linked = conns.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().withColumn("_c", F.lit(True))
    with_link = nearest.withColumn("a", F.least("segment_id", "route_seg")).withColumn("b", F.greatest("segment_id", "route_seg")).join(linked, ["a", "b"], "left")
    extra = with_link.select("trip_id", "way_id", "seq", "distance_m", "route_highway", F.coalesce("_c", F.lit(False)).alias("connected"))
    return target.join(extra, ["trip_id", "way_id"], "left").select(
        "trip_id", "way_id", "in_route", F.col("segment_id").isNotNull().alias("in_network"), "segment_id", "highway",
        F.col("seq").alias("nearest_seq"), "distance_m", "route_highway", "connected",
    )


def segments_around(points: DataFrame, key: list[str], segs: DataFrame, radius_m: float = 2000.0, cell_deg: float = 0.02) -> DataFrame:
    """Segments whose midpoint lies within the radius of points: a point lies in one cell, a
    midpoint in all cells its circle may touch."""
    from wayloom.operators.skew import salted_join

    mid = segs.select("*", geo.ends_midpoint(F.col("coordinates")).alias("m"))
    r = radius_m / METERS_PER_DEGREE
    size = F.lit(cell_deg)
    # A circle that holds the pole meets all cells of its rows.
    dx = F.when(F.abs(F.col("m.y")) + r < geo.POLAR_DEG, geo.lon_reach(F.abs(F.col("m.y")), r)).otherwise(180.0)
    ys = F.sequence(geo.tile_index(F.col("m.y") - r, size), geo.tile_index(F.col("m.y") + r, size))
    cells = mid.withColumn("cell_x", F.explode(geo.lon_cells(F.col("m.x"), dx, cell_deg))).withColumn("cell_y", F.explode(ys))
    located = points.select(
        *key, "lat", "lon", geo.tile_index(F.col("lon"), size).alias("cell_x"), geo.tile_index(F.col("lat"), size).alias("cell_y")
    )
    d = geo.haversine(F.col("lat"), F.col("lon"), F.col("m.y"), F.col("m.x"))
    return salted_join(located, cells, ["cell_x", "cell_y"], [*key, "lat", "lon"]).withColumn("distance_m", d).filter(F.col("distance_m") <= radius_m)


def connected_in_trip(steps: DataFrame, conns: DataFrame) -> DataFrame:
    """For every segment tried in a trip: the connected segments that the trip's windows also
    hold. ``steps`` has trip_id and segment_id."""
    seen = steps.select("trip_id", "segment_id").distinct()
    return (
        seen.join(conns, F.col("segment_id") == F.col("src"))
        .select("trip_id", "segment_id", F.col("dst").alias("connected"))
        .join(seen.withColumnRenamed("segment_id", "connected"), ["trip_id", "connected"])
        .distinct()
    )


def explanations(trace: DataFrame, attempts_summary: DataFrame) -> DataFrame:
    """One text line per window."""
    n = F.col("window_idx") + 1
    line = (
        F.when(F.col("score").isNull(), F.concat(F.format_string("Window %d failed: ", n), "reason"))
        .when(F.col("bridge"), F.format_string("Window %d had to ignore previous constraints to produce a valid route (score %.2f)", n, "score"))
        .when(F.col("used_constraints"), F.format_string("Window %d matched with constraints (score %.2f)", n, "score"))
        .otherwise(F.format_string("Window %d matched (score %.2f)", n, "score"))
    )
    return trace.join(attempts_summary, WINDOW, "left").select(*WINDOW, line.alias("text"))
