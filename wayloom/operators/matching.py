"""Map matching: candidates → windows → paths → scores → one route per trip."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayloom.config import MATCH, MatchConfig
from wayloom.functions import geo, roads
from wayloom.operators.candidates import near_segments, rank_candidates
from wayloom.operators.paths import bounded_paths, length_limit
from wayloom.session import materialize

WINDOW = ["trip_id", "window_idx"]
PATH = [*WINDOW, "from_seg", "to_seg"]


@dataclass
class Network:
    """Tables of a built network."""

    segments: DataFrame
    segment_nodes: DataFrame
    transitions: DataFrame


@dataclass
class Matched:
    candidates: DataFrame
    windows: DataFrame
    paths: DataFrame
    routes: DataFrame
    trace: DataFrame
    status: DataFrame


def windows(points: DataFrame, size: int = 2, step: int = 1) -> DataFrame:
    """Overlapping windows of each trip: window_idx, start_idx, end_idx, is_last."""
    n = points.groupBy("trip_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 2)
    starts = F.sequence(F.lit(0), F.greatest(F.col("n") - size, F.lit(0)).cast("int"), F.lit(step))
    return n.select("trip_id", "n", F.posexplode(starts).alias("window_idx", "start_idx")).select(
        "trip_id",
        F.col("window_idx").cast("long").alias("window_idx"),
        F.col("start_idx").cast("long").alias("start_idx"),
        F.least(F.col("start_idx") + size - 1, F.col("n") - 1).cast("long").alias("end_idx"),
        (F.col("start_idx") + size >= F.col("n")).alias("is_last"),
    )


def split_failed(failed: DataFrame, min_size: int = 4, step: int = 1) -> DataFrame:
    """Halves of failed windows larger than ``min_size`` points; they share two points."""
    size = F.col("end_idx") - F.col("start_idx") + 1
    mid = F.col("start_idx") + F.floor(size / 2)
    halves = F.array(
        F.struct(F.lit(0).alias("half"), F.col("start_idx").alias("start_idx"), mid.alias("end_idx")),
        F.struct(F.lit(1).alias("half"), (mid - 1).alias("start_idx"), F.col("end_idx").alias("end_idx")),
    )
    return failed.filter((size > min_size) & (size > step)).select(*WINDOW, F.explode(halves).alias("h")).select(*WINDOW, "h.*")


def trip_candidates(points: DataFrame, net: Network, cfg: MatchConfig, radius_m: float) -> tuple[DataFrame, DataFrame]:
    """(ranked candidates with vertex and position, near-point counts per trip and segment)."""
    reach = max(radius_m * cfg.extend_factor, cfg.near_point_m)
    near = materialize(near_segments(points, ["trip_id", "point_idx"], net.segments, reach, cfg.cell_deg), "near")
    near_counts = near.filter(F.col("distance_m") <= cfg.near_point_m).groupBy("trip_id", "segment_id").agg(F.count(F.lit(1)).alias("n_near"))
    ranked = rank_candidates(near, ["trip_id", "point_idx"], cfg, radius_m)
    lines = net.segments.select(
        "segment_id", "way_id", "highway", "coordinates", geo.polyline_length(F.col("coordinates")).alias("segment_m")
    )
    with_vertex = ranked.join(lines, "segment_id").withColumn(
        "vertex_idx", geo.nearest_vertex(F.col("proj_x"), F.col("proj_y"), F.col("coordinates"))
    )
    along = F.element_at(geo.cumulative_lengths(F.col("coordinates")), F.col("vertex_idx") + 1)
    return with_vertex.withColumn("vertex_pos", along).drop("coordinates"), near_counts


def window_points(wins: DataFrame, points: DataFrame) -> DataFrame:
    idx = wins.select(*WINDOW, F.explode(F.sequence("start_idx", "end_idx")).alias("point_idx"))
    return idx.join(points.select("trip_id", "point_idx", "t", "lat", "lon"), ["trip_id", "point_idx"])


def window_searches(wins: DataFrame, points: DataFrame, cands: DataFrame, cfg: MatchConfig, timed: bool) -> tuple[DataFrame, DataFrame]:
    """Searches (one per window and first candidate) and their targets (last candidates)."""
    p = points.select("trip_id", "point_idx", "t", "lat", "lon")
    a = p.select("trip_id", F.col("point_idx").alias("start_idx"), F.col("t").alias("a_t"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    b = p.select("trip_id", F.col("point_idx").alias("end_idx"), F.col("t").alias("b_t"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"))
    direct = geo.haversine(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    seconds = (F.col("b_t") - F.col("a_t")).cast("double") if timed else None
    ends = wins.join(a, ["trip_id", "start_idx"]).join(b, ["trip_id", "end_idx"]).withColumn("direct_m", direct).withColumn("limit_m", length_limit(F.col("direct_m"), seconds, cfg))
    c = cands.select(
        "trip_id", "point_idx", "segment_id", "rank", "distance_m", "vertex_idx", "vertex_pos", "segment_m"
    )
    last = c.select(
        "trip_id", F.col("point_idx").alias("end_idx"), F.col("segment_id").alias("to_seg"), F.col("rank").alias("to_rank"),
        F.col("vertex_idx").alias("to_exit"), F.col("vertex_pos").alias("to_pos"), (F.col("distance_m") + F.col("segment_m")).alias("reach"),
    )
    targets = ends.select(*WINDOW, "end_idx").join(last, ["trip_id", "end_idx"])
    slack = targets.groupBy(*WINDOW).agg(F.max("reach").alias("slack_m"))
    first = c.select(
        "trip_id", F.col("point_idx").alias("start_idx"), F.col("segment_id").alias("from_seg"), F.col("rank").alias("from_rank"),
        F.col("vertex_idx").alias("from_entry"), F.col("vertex_pos").alias("from_pos"),
        ((F.col("distance_m") + F.col("segment_m")) * 2).alias("start_slack_m"),
    )
    searches = (
        ends.join(first, ["trip_id", "start_idx"]).join(slack, WINDOW)
        .select(
            *WINDOW, "from_seg", "from_rank", "from_entry", "from_pos", "limit_m", "direct_m",
            F.col("b_lat").alias("goal_lat"), F.col("b_lon").alias("goal_lon"), "slack_m",
            F.col("a_lat").alias("start_lat"), F.col("a_lon").alias("start_lon"), "start_slack_m",
        )
    )
    return searches, targets.select(*WINDOW, "to_seg", "to_rank", "to_exit", "to_pos")


def window_paths(searches: DataFrame, targets: DataFrame, net: Network, near_counts: DataFrame | None, cfg: MatchConfig) -> DataFrame:
    """Cheapest path of every first × last candidate pair."""
    s = searches.withColumn("start_seg", F.col("from_seg"))
    t = targets.join(s.select(*WINDOW, "start_seg"), WINDOW)
    paths = bounded_paths(
        s, t, [*WINDOW, "start_seg"], net.transitions,
        near_counts, "trip_id" if near_counts is not None else None, cfg,
    )
    return (
        paths.withColumnRenamed("start_seg", "from_seg")
        .join(searches.select(*WINDOW, "from_seg", "from_rank", "direct_m", "limit_m"), [*WINDOW, "from_seg"])
        .join(targets.select(*WINDOW, "to_seg", "to_rank"), [*WINDOW, "to_seg"])
    )


def path_steps(paths: DataFrame, segs: DataFrame, key: list[str]) -> DataFrame:
    """One row per step of a path with the travelled line."""
    lines = segs.select("segment_id", "way_id", "highway", "is_oneway", "coordinates")
    steps = paths.select(*key, F.posexplode("path").alias("pos", "s")).select(*key, "pos", "s.*")
    used = geo.used_slice(F.col("coordinates"), F.col("entry_idx"), F.col("exit_idx"), F.col("is_oneway"))
    return steps.join(lines, "segment_id").withColumn("line", used).withColumn("length_m", geo.polyline_length(F.col("line")))


def score_parts(paths: DataFrame, steps: DataFrame, points: DataFrame, key: list[str], cfg: MatchConfig = MATCH) -> DataFrame:
    """Score of each path and its parts. ``points`` has the window key, point_idx, lat, lon.

    Paths with a point too far from every segment, and paths of some length between equal
    points, have a NULL score and are never chosen. Scores do not hold the constraint term.
    """
    px, py = F.col("lon"), F.col("lat")
    to_points = (
        steps.join(points.select(*WINDOW, "point_idx", "lat", "lon"), WINDOW)
        .select(
            *key, "point_idx",
            geo.distance_to_polyline(px, py, F.col("line")).alias("d"),
            geo.distance_to_polyline(px, py, F.col("coordinates")).alias("d_full"),
        )
        .groupBy(*key, "point_idx")
        .agg(F.min("d").alias("d"), F.min("d_full").alias("d_full"))
        .groupBy(*key)
        .agg(
            F.avg("d").alias("mean_m"), F.stddev_pop("d").alias("std_m"), F.max("d_full").alias("farthest_m")
        )
    )
    weight = F.greatest(F.col("length_m"), F.lit(1.0))
    ways = F.array_sort(F.collect_list(F.struct("pos", "way_id"))).way_id
    along = steps.groupBy(*key).agg(
        F.sum("length_m").alias("path_m"),
        (F.sum(roads.class_score(F.col("highway")) * weight) / F.sum(weight)).alias("class_score"),
        ways.alias("way_ids"),
    )
    changes = F.aggregate(
        F.zip_with(
            F.slice("way_ids", F.lit(1), F.size("way_ids") - 1), F.slice("way_ids", F.lit(2), F.size("way_ids") - 1),
            lambda a, b: F.when(a != b, 1).otherwise(0),
        ),
        F.lit(0), lambda acc, x: acc + x,
    )
    detour = F.when(F.col("direct_m") > 0, F.col("path_m") / F.col("direct_m"))
    length_term = (
        F.when((F.col("direct_m") == 0) & (F.col("path_m") == 0), 0.0)
        .when(detour > cfg.free_detour_ratio, (detour - cfg.free_detour_ratio) * 100.0)
        .when(detour.isNotNull(), 0.0)
    )
    score = (
        (F.col("mean_m") + F.col("std_m") * cfg.std_dev_weight) * cfg.distance_weight
        + length_term * cfg.length_weight
        + F.col("class_score") * cfg.road_class_weight
        + F.col("transitions") * cfg.continuity_weight
    )
    return (
        paths.join(along, key).join(to_points, key)
        .withColumn("transitions", changes)
        .withColumn("score", F.when(F.col("farthest_m") <= cfg.max_point_to_route_m, score))
    )


def window_choices(wins: DataFrame, scored: DataFrame, steps: DataFrame, points: DataFrame, cands: DataFrame, cfg: MatchConfig) -> DataFrame:
    """One row per window with the paths a trip can choose from: the best path for each
    first segment (to the nearest end candidate in the last window) and the best of all, and the segment that each
    would bind the next window to.

    A constraint fixes a path's end, and the path then always holds the constrained segment, so
    the constraint term is equal for all paths a choice is made from.
    """
    usable = scored.filter(F.col("score").isNotNull()).join(wins.select(*WINDOW, "is_last"), WINDOW)
    order = F.struct("score", "from_rank", "to_rank")
    ref = F.struct("score", "from_rank", "to_rank", "from_seg", "to_seg")
    bound = usable.filter(~F.col("is_last") | (F.col("to_rank") == 1)).groupBy(*WINDOW, "from_seg").agg(F.min_by(ref, order).alias("b")).select(*WINDOW, "b.*", F.lit(True).alias("bound"))
    free = usable.groupBy(*WINDOW).agg(F.min_by(ref, order).alias("b")).select(*WINDOW, "b.*", F.lit(False).alias("bound"))
    chosen = bound.unionByName(free)
    end = points.select("trip_id", F.col("point_idx").alias("end_idx"), F.col("lat").alias("end_lat"), F.col("lon").alias("end_lon"))
    ends = wins.join(end, ["trip_id", "end_idx"]).select(*WINDOW, "end_lat", "end_lon")
    at = steps.join(chosen.select(*PATH).distinct(), PATH, "left_semi").join(ends, WINDOW).select(
        *PATH, "pos", "segment_id", geo.distance_to_polyline(F.col("end_lon"), F.col("end_lat"), F.col("line")).alias("d_end")
    )
    binds = at.filter(F.col("d_end") <= cfg.max_point_to_route_m).groupBy(*PATH).agg(F.min_by("segment_id", F.struct("d_end", "pos")).alias("end_seg"))
    options = chosen.join(binds, PATH, "left").groupBy(*WINDOW).agg(
        F.array_sort(F.collect_list(F.struct("score", "from_rank", "to_rank", "from_seg", "to_seg", "bound", "end_seg"))).alias("options")
    )
    firsts = cands.groupBy("trip_id", F.col("point_idx").alias("start_idx")).agg(F.collect_set("segment_id").alias("first_segs"))
    return (
        wins.select(*WINDOW, "start_idx", "is_last").join(firsts, ["trip_id", "start_idx"], "left").join(options, WINDOW, "left")
        .select(*WINDOW, "start_idx", "is_last", "first_segs", "options")
    )


def _by_trip(rows: DataFrame) -> DataFrame:
    return rows.repartition("trip_id").sortWithinPartitions("trip_id", "window_idx")


TAKEN = (
    "trip_id string, window_idx long, start_idx long, is_last boolean, from_seg long, to_seg long, score double, "
    "bridge boolean, used_constraints boolean, constraint_segment long, n_options int"
)


def choose_paths(choices: DataFrame) -> DataFrame:
    """The path each window takes. A window must go on from the segment that the one before ended
    on; where none can, it takes its best path as a bridge.

    What one window hands to the next is a segment id, so trips are walked in order over rows of a few options each.
    """
    names = TAKEN.split(", ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trip, fixed = None, None
        for batch in batches:
            out = []
            for w in batch.to_pylist():
                if w["trip_id"] != trip:
                    trip, fixed = w["trip_id"], None
                options = w["options"] or []
                bound = [o for o in options if o["bound"]]
                if fixed is not None and fixed in (w["first_segs"] or []):
                    choice = [o for o in bound if o["from_seg"] == fixed]
                else:
                    choice = bound if fixed is None or w["is_last"] else []
                bridge = not choice
                taken = choice[0] if choice else next((o for o in options if not o["bound"]), None)
                of = taken or dict.fromkeys(("from_seg", "to_seg", "score", "end_seg"))
                constrained = not bridge and (fixed is not None or w["is_last"])
                out.append((
                    trip, w["window_idx"], w["start_idx"], w["is_last"], of["from_seg"], of["to_seg"], of["score"],
                    bridge, constrained, fixed, len(bound),
                ))
                fixed = of["end_seg"]
            yield pa.RecordBatch.from_pylist([dict(zip((n.split(" ")[0] for n in names), r)) for r in out], schema=schema)

    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "int": pa.int32()}
    schema = pa.schema([(n.split(" ")[0], kinds[n.split(" ")[1]]) for n in names])
    return _by_trip(choices).mapInArrow(run, TAKEN)


def line_id(segment: str = "segment_id", entry: str = "entry_idx", exit_: str = "exit_idx") -> Column:
    """Name of a travelled part of a segment."""
    return F.concat_ws(":", segment, entry, exit_)


#: Pairs of a trip's windows and travelled parts up to which they are compared one by one.
TRIP_PAIRS = 4096


def near_lines(taken: DataFrame, taken_steps: DataFrame, points: DataFrame, radius_m: float, cfg: MatchConfig) -> DataFrame:
    """Distances from each window's first point to the travelled parts of its trip: those within the radius, and for
    bridges within the limit of a point to its route. Distances equal to a micrometer count as equal.

    A short trip's windows are compared with its own parts. For others each part is met once over a grid, however many trips and
    windows travel it, so that time spent in one place makes no pairs of windows.
    """
    # A part of one vertex is a line from it to itself.
    line = F.when(F.size("line") == 1, F.concat("line", "line")).otherwise(F.col("line"))
    parts = taken_steps.groupBy("trip_id", line_id().alias("segment_id")).agg(F.first(line).alias("coordinates"))
    parts = materialize(parts, "parts")
    starts = taken.select(*WINDOW, "start_idx", "bridge").join(
        points.select("trip_id", F.col("point_idx").alias("start_idx"), "lat", "lon"), ["trip_id", "start_idx"]
    )
    starts = materialize(starts.drop("start_idx"), "starts")
    n = parts.groupBy("trip_id").agg(F.count(F.lit(1)).alias("n_parts")).join(starts.groupBy("trip_id").agg(F.count(F.lit(1)).alias("n")), "trip_id")
    n = materialize(n.select("trip_id", (F.col("n_parts") * F.col("n") <= TRIP_PAIRS).alias("short")), "trips")
    short, long = n.filter("short").select("trip_id"), n.filter("NOT short").select("trip_id")
    d = geo.distance_to_polyline(F.col("lon"), F.col("lat"), F.col("coordinates"))
    limit = F.when(F.col("bridge"), max(radius_m, cfg.max_point_to_route_m)).otherwise(radius_m)
    met = starts.join(short, "trip_id", "left_semi").join(parts, "trip_id").withColumn("d", d).filter(F.col("d") <= limit)
    met = met.select(*WINDOW, F.col("segment_id").alias("line"), F.round("d", 6).alias("d"))
    if long.isEmpty():
        return met
    starts, parts = starts.join(long, "trip_id", "left_semi"), parts.join(long, "trip_id", "left_semi")
    lines = materialize(parts.groupBy("segment_id").agg(F.first("coordinates").alias("coordinates")), "lines")
    near = near_segments(starts.filter(~F.col("bridge")), WINDOW, lines, radius_m, cfg.cell_deg)
    far = near_segments(starts.filter("bridge"), WINDOW, lines, max(radius_m, cfg.max_point_to_route_m), cfg.cell_deg)
    both = near.unionByName(far).select(*WINDOW, F.col("segment_id").alias("line"), F.round("distance_m", 6).alias("d"))
    own = parts.select("trip_id", F.col("segment_id").alias("line"))
    return met.unionByName(both.join(own, ["trip_id", "line"], "left_semi"))


class _Route:
    """Steps of a route, and where in it each travelled part occurs."""

    def __init__(self) -> None:
        self.steps: list[tuple] = []
        self.places: dict[str, list[int]] = {}

    def extend(self, steps: list[tuple]) -> None:
        for step in steps:
            self.places.setdefault(step[0], []).append(len(self.steps))
            self.steps.append(step)

    def cut(self, length: int) -> None:
        while len(self.steps) > length:
            self.places[self.steps.pop()[0]].pop()

    def nearest(self, near: list[tuple[float, str]], limit: float, last: bool) -> int | None:
        """Place of the nearest step within the limit; of equally near ones the last or the first."""
        held = [(d, self.places[name]) for d, name in near if d <= limit and self.places.get(name)]
        if not held:
            return None
        least = min(d for d, _ in held)
        places = [p[-1] if last else p[0] for d, p in held if d == least]
        return max(places) if last else min(places)

    def add(self, w: dict, path: list[tuple], near: list[tuple[float, str]], radius: float, far: float) -> None:
        """Join a window's path (line, window, segment, entry, exit, distance to the window's first point)."""
        if w["bridge"] and self.steps and w["start_idx"] > 0:
            at = self.nearest(near, far, last=False)
            if at is not None:
                self.cut(at)
                self.extend(path)
                return
        if not path:
            return
        at_start = [s[5] <= radius for s in path]
        if not self.steps:
            # Later windows cover the rest; keep what lies at the first point.
            self.extend(path if w["is_last"] else [s for s, ok in zip(path, at_start) if ok])
            return
        at = self.nearest(near, radius, last=True)
        if at is None:
            ids, before = [s[2] for s in path], self.steps[-1][2]
            self.extend(path[ids.index(before) + 1 :] if before in ids else path)
            return
        self.cut(at + 1)
        j = min(range(len(path)), key=lambda k: path[k][5])
        if path[j][5] > radius:
            self.extend(path[1:] if path[0][2] == self.steps[-1][2] else path)
            return
        stop = len(path)
        if not w["is_last"]:
            stop = next((n + 1 for n in range(j + 1, len(path)) if at_start[n]), len(path))
        self.extend(path[j + 1 : stop])


def fold_windows(
    wins: DataFrame, scored: DataFrame, steps: DataFrame, points: DataFrame, cands: DataFrame, radius_m: float, cfg: MatchConfig = MATCH
) -> tuple[DataFrame, DataFrame]:
    """Routes (trip_id, seq, window_idx, segment_id, entry_idx, exit_idx) and the trace of all windows.

    All geometry is Spark's: distances of a window's first point to its own path's steps and to the trip's other travelled parts
    are joins over windows, spread over tasks. What is walked in order per trip are names and
    distances; a step is added and cut once, and a window looks only at the parts near it, so a trip takes time linear in
    its windows. A task holds the route of one trip as names.
    """
    taken = materialize(choose_paths(window_choices(wins, scored, steps, points, cands, cfg)), "taken")
    start = points.select("trip_id", F.col("point_idx").alias("start_idx"), "lat", "lon")
    path = taken.filter("from_seg IS NOT NULL").select(*PATH, "start_idx").join(start, ["trip_id", "start_idx"])
    d_start = F.round(geo.distance_to_polyline(F.col("lon"), F.col("lat"), F.col("line")), 6)
    taken_steps = steps.join(path, PATH).select(*WINDOW, "pos", "segment_id", "entry_idx", "exit_idx", "line", d_start.alias("d"))
    taken_steps = materialize(taken_steps, "taken_steps")
    near = near_lines(taken, taken_steps, points, radius_m, cfg)
    paths = taken_steps.groupBy(*WINDOW).agg(
        F.array_sort(F.collect_list(F.struct("pos", line_id().alias("line"), "segment_id", "entry_idx", "exit_idx", "d"))).alias("path")
    )
    nearby = near.groupBy(*WINDOW).agg(F.array_sort(F.collect_list(F.struct("d", "line"))).alias("near"))
    rows = taken.select(*WINDOW, "start_idx", "is_last", "bridge").join(paths, WINDOW, "left").join(nearby, WINDOW, "left")
    far = cfg.max_point_to_route_m
    schema = pa.schema([
        ("trip_id", pa.string()), ("seq", pa.int64()), ("window_idx", pa.int64()), ("segment_id", pa.int64()),
        ("entry_idx", pa.int32()), ("exit_idx", pa.int32()),
    ])

    def done(trip: str, route: _Route) -> pa.RecordBatch:
        columns = list(zip(*[s[1:5] for s in route.steps])) or [[]] * 4
        n = len(route.steps)
        arrays = [pa.array([trip] * n, pa.string()), pa.array(range(n), pa.int64())]
        arrays += [pa.array(c, schema.field(k + 2).type) for k, c in enumerate(columns)]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trip, route = None, _Route()
        for batch in batches:
            for w in batch.to_pylist():
                if w["trip_id"] != trip:
                    if trip is not None:
                        yield done(trip, route)
                    trip, route = w["trip_id"], _Route()
                own = [(s["line"], w["window_idx"], s["segment_id"], s["entry_idx"], s["exit_idx"], s["d"]) for s in w["path"] or []]
                route.add(w, own, [(x["d"], x["line"]) for x in w["near"] or []], radius_m, far)
        if trip is not None:
            yield done(trip, route)

    routes = _by_trip(rows).mapInArrow(run, "trip_id string, seq long, window_idx long, segment_id long, entry_idx int, exit_idx int")
    trace = taken.select(*WINDOW, "score", "bridge", "used_constraints", "constraint_segment", "n_options", "from_seg")
    return routes, trace


def match_trips(points: DataFrame, net: Network, cfg: MatchConfig = MATCH, radius_m: float | None = None, timed: bool = True, near_point_bonus: bool = True) -> Matched:
    """Match trips (trip_id, point_idx, t, lat, lon) to the network.

    ``near_point_bonus=False`` leaves out the cost bonus of roads close to the trip's points.
    """
    if (cfg.window_size, cfg.window_step) != (2, 1):
        raise ValueError("routes are joined from windows of two neighboring points; other sizes are not supported")
    r = cfg.radius_m if radius_m is None else radius_m
    cands, near_counts = trip_candidates(points, net, cfg, r)
    cands, near_counts = materialize(cands, "candidates"), materialize(near_counts, "near_counts")
    covered = cands.groupBy("trip_id").agg(F.countDistinct("point_idx").alias("n_covered"))
    trips = points.groupBy("trip_id").agg(F.count(F.lit(1)).alias("n_points")).join(covered, "trip_id", "left")
    full = trips.filter(F.col("n_covered") == F.col("n_points")).select("trip_id")
    kept = materialize(points.join(full, "trip_id", "left_semi").select("trip_id", "point_idx", "t", "lat", "lon"), "match_points")
    wins = materialize(windows(kept, cfg.window_size, cfg.window_step), "windows")
    searches, targets = window_searches(wins, kept, cands, cfg, timed)
    searches, targets = materialize(searches, "searches"), materialize(targets, "targets")
    paths = materialize(window_paths(searches, targets, net, near_counts if near_point_bonus else None, cfg), "paths")
    steps = materialize(path_steps(paths, net.segments, PATH), "steps")
    scored = materialize(score_parts(paths, steps, window_points(wins, kept), PATH, cfg), "scored")
    routes, trace = fold_windows(wins, scored, steps, kept, cands, r, cfg)
    routes = materialize(routes, "routes")
    has_route = routes.select("trip_id").distinct().withColumn("_r", F.lit(True))
    status = trips.join(has_route, "trip_id", "left").select(
        "trip_id",
        F.when(F.coalesce("n_covered", F.lit(0)) < F.col("n_points"), "no_candidates").when(F.col("_r"), "matched").otherwise("no_route").alias("match_status"),
    )
    status = status.withColumn(
        "notes",
        F.when(F.col("match_status") == "no_candidates", "Some points have no road within reach")
        .when(F.col("match_status") == "no_route", "No valid route was found"),
    )
    return Matched(cands, wins, scored, routes, trace, status)


def route_lines(routes: DataFrame, segs: DataFrame, key: str = "trip_id") -> DataFrame:
    """Route steps with the travelled line and their end nodes."""
    lines = segs.select("segment_id", "way_id", "highway", "is_oneway", "name", "nodes", "coordinates")
    used = geo.used_slice(F.col("coordinates"), F.col("entry_idx"), F.col("exit_idx"), F.col("is_oneway"))
    return routes.join(lines, "segment_id").select(
        key, "seq", "segment_id", "way_id", "highway", "name", "entry_idx", "exit_idx", "is_oneway",
        used.alias("line"),
        F.element_at("nodes", F.col("entry_idx") + 1).alias("start_node"),
        F.element_at("nodes", F.col("exit_idx") + 1).alias("end_node"),
        (F.col("entry_idx") > F.col("exit_idx")).alias("reversed"),
        (~F.col("is_oneway") | (F.col("entry_idx") <= F.col("exit_idx"))).alias("valid_direction"),
    )


def _neighbor(lines: DataFrame, key: str, offset: int, columns: dict[str, Column]) -> DataFrame:
    """Columns of the step before (-1) or after (+1), joined by position: steps of one long
    route stay spread over tasks."""
    other = lines.select(key, (F.col("seq") - offset).alias("seq"), *[c.alias(n) for n, c in columns.items()])
    return lines.join(other, [key, "seq"], "left")


def route_coordinates(lines: DataFrame, key: str = "trip_id", epsilon: float = 1e-8) -> DataFrame:
    """Route vertices (seq, i, x, y); a vertex equal to the one before is left out."""

    def same(a: Column, b: Column) -> Column:
        return (F.abs(a.x - b.x) < epsilon) & (F.abs(a.y - b.y) < epsilon)

    joined = _neighbor(lines, key, -1, {"before": F.element_at("line", -1)})
    numbered = F.transform("line", lambda c, i: F.struct(i.alias("i"), c.x.alias("x"), c.y.alias("y")))
    kept = F.filter(
        numbered,
        lambda v: F.when(v.i == 0, F.coalesce(~same(v, F.col("before")), F.lit(True))).otherwise(
            ~same(v, F.get(F.col("line"), v.i - 1))
        ),
    )
    return joined.select(key, "seq", F.explode(kept).alias("v")).select(key, "seq", "v.i", "v.x", "v.y")


def junctions(lines: DataFrame, key: str = "trip_id") -> DataFrame:
    """Places where a step ends on the node the next one starts from."""
    at = F.element_at("line", -1)
    return (
        _neighbor(lines, key, 1, {"next_start": F.col("start_node")})
        .filter(F.col("end_node") == F.col("next_start"))
        .select(key, "seq", F.col("end_node").alias("node_id"), at.x.alias("x"), at.y.alias("y"))
    )


def route_ways(lines: DataFrame, key: str = "trip_id") -> DataFrame:
    """Way ids along the route as a list, a repeated way once per run."""
    runs = _neighbor(lines, key, -1, {"before": F.col("way_id")}).filter(
        F.col("before").isNull() | (F.col("before") != F.col("way_id"))
    )
    return runs.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "way_id"))), lambda s: s.way_id).alias("osm_way_ids"))


def route_bbox(lines: DataFrame, key: str = "trip_id", margin_deg: float = 0.001) -> DataFrame:
    box = lines.select(key, geo.bbox(F.col("line")).alias("b"))
    m = F.lit(margin_deg)
    return box.groupBy(key).agg(
        (F.min("b.min_x") - m).alias("min_lon"), (F.min("b.min_y") - m).alias("min_lat"),
        (F.max("b.max_x") + m).alias("max_lon"), (F.max("b.max_y") + m).alias("max_lat"),
    )
