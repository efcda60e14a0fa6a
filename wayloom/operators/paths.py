"""Searches over the road network as rounds of frontier joins."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayloom.config import MATCH, MatchConfig
from wayloom.functions import geo, roads
from wayloom.operators import reach, regions
from wayloom.session import cut_lineage, materialize, scratch_path


def reachable(sources: DataFrame, edges: DataFrame, max_hops: int = 5) -> DataFrame:
    """Breadth-first levels: (source, segment_id, hops) for all segments within ``max_hops``.

    Searches are shared: one per distinct source, however many requests start there.
    """
    frontier = cut_lineage(sources.select(F.col("source"), F.col("source").alias("segment_id"), F.lit(0).alias("hops")).distinct())
    seen = frontier
    for hop in range(1, max_hops + 1):
        stepped = (
            frontier.join(edges.select("src", "dst"), F.col("segment_id") == F.col("src"))
            .select("source", F.col("dst").alias("segment_id"))
            .distinct()
            .join(seen.select("source", "segment_id"), ["source", "segment_id"], "left_anti")
            .withColumn("hops", F.lit(hop))
        )
        frontier = cut_lineage(stepped)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def length_limit(direct_m: Column, seconds: Column | None, cfg: MatchConfig = MATCH) -> Column:
    """Longest path allowed: what the time permits, at most a multiple of the straight line,
    but never below the minimum. Without a positive time only the straight line counts."""
    by_line = direct_m * cfg.detour_limit
    if seconds is None:
        return F.greatest(by_line, F.lit(cfg.min_limit_m))
    by_time = F.when(seconds > 0, seconds * cfg.max_speed_mps)
    return F.greatest(F.coalesce(F.least(by_time, by_line), by_line), F.lit(cfg.min_limit_m))


STEP = "array<struct<segment_id:bigint,entry_idx:int,exit_idx:int>>"


def bounded_paths(
    searches: DataFrame,
    targets: DataFrame,
    key: list[str],
    transitions: DataFrame,
    near: DataFrame | None = None,
    near_key: str | None = None,
    cfg: MatchConfig = MATCH,
    count: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """Cheapest paths no longer than a limit, for many searches at once.

    ``searches``: key, from_seg, from_entry, from_pos, limit_m, goal_lat, goal_lon, slack_m,
    start_lat, start_lon, start_slack_m (the start vertex lies within that of the start).
    ``targets``: key, to_seg, to_exit; a search may have several. ``near`` (near_key,
    segment_id, n_near) holds the points that make a segment cheaper within a search's group.

    Searches from one segment and vertex (of one group, where ``near`` is given) are one source. Sources are dealt to
    tasks by the region their paths keep to, and searched there (``regions``): first for the cheapest path of all, which is
    the result where it keeps the limit; only the other targets that some path within the limit reaches are searched again
    with all labels that are cheaper or shorter than every other. Sources of regions too large for a task go round by round over joins.

    Costs are kept to 1e-9 and lengths to 1e-6, so that equal paths in
    another order of addition count as equal; of these, the one with the fewest steps stays, then the one whose steps
    are smaller, from the last to the first.

    Result: key, to_seg, to_exit, cost, length_m, path (segments with entry and exit index).
    The start segment's leg counts towards the length, the target's does not. ``count`` is given the table of sources.
    """
    trivial, open_targets = _split_trivial(searches, targets, key)
    candidates = materialize(open_targets.select(*key, "to_seg", "to_exit").distinct(), "targets")
    sources, wanted = _sources(searches, candidates, key, near_key if near is not None else None)
    if count is not None:
        count(sources)
    parts, cells, moves = regions.placed(sources, transitions)
    grouped = None if near is None else near.select(F.col(near_key).cast("string").alias("near_group"), "segment_id", "n_near")
    region = (parts, cells, moves)
    asked = wanted.select(*key, "sid", "to_seg", "to_exit", "limit_m").distinct()
    first = materialize(_search(*region, asked, grouped, cfg, cheapest=True), "found")
    found = first.filter("sure")
    left = materialize(first.filter("NOT sure").select("sid", "to_seg", "limit_m"), "left")
    if not left.isEmpty():
        found = found.unionByName(_search(*region, left, grouped, cfg, cheapest=False))
    found = found.drop("sure")
    wide = materialize(parts.filter("part IS NULL").select("sid"), "wide")
    if near is None and not wide.isEmpty():
        close = _close_paths(sources.join(wide, "sid"), asked.join(wide, "sid", "left_semi"), transitions, cfg)
        found = found.unionByName(close)
    order = F.struct("g", "dist", F.size("before"), "entry", "sid")
    best = found.join(asked, ["sid", "to_seg", "limit_m"]).groupBy(*key, "to_seg", "to_exit").agg(
        F.min_by(F.struct("entry", "g", "dist", "before"), order).alias("b")
    )
    paths = _whole_paths(best.select(*key, "to_seg", "to_exit", "b.*"), key).unionByName(trivial)
    far = asked.join(wide, "sid", "left_semi")
    if near is None and not wide.isEmpty():
        far = far.join(close.select("sid", "to_seg", "limit_m"), ["sid", "to_seg", "limit_m"], "left_anti")
    far = materialize(far.select(*candidates.columns).distinct(), "far")
    if not far.isEmpty():
        paths = paths.unionByName(_by_rounds(searches, far, key, transitions, near, near_key, cfg))
    return paths


#: Lengths in meters up to which searches with wide limits are tried first.
CLOSE_M = (25_000.0, 200_000.0)


def _close_paths(sources: DataFrame, asked: DataFrame, transitions: DataFrame, cfg: MatchConfig) -> DataFrame:
    """The paths of searches with limits too wide for a region that are known from the region around the start alone.

    A path that leaves it is longer than its radius, so it costs more than the least cost of that length; what is found at
    less is the cheapest of all.
    """
    least = transitions.agg(F.min("static_cost")).first()[0]
    found = None
    for radius in CLOSE_M:
        near = sources.withColumns({"limit_m": F.lit(radius), "reach_m": F.lit(1e12)})
        region = regions.placed(near, transitions)
        cut = asked.withColumn("own_m", F.col("limit_m")).withColumn("limit_m", F.least("limit_m", F.lit(radius)))
        cut = materialize(cut.select("sid", "to_seg", "limit_m", "own_m").distinct(), "cut")
        got = _search(*region, cut, None, cfg, cheapest=True).filter("sure").drop("sure")
        got = got.filter(F.col("g") < radius / 500.0 * (least or 0.0) * min(1.0, cfg.private_factor) - 1e-3)
        got = materialize(got.join(cut, ["sid", "to_seg", "limit_m"]).withColumn("limit_m", F.col("own_m")).drop("own_m"), "close")
        found = got if found is None else found.unionByName(got)
        asked = asked.join(got.select("sid", "to_seg", "limit_m"), ["sid", "to_seg", "limit_m"], "left_anti")
    return found


def _search(parts: DataFrame, cells: DataFrame, moves: DataFrame, wanted: DataFrame, near: DataFrame | None, cfg: MatchConfig, cheapest: bool) -> DataFrame:
    return regions.search(parts, cells, moves, wanted, near, cfg, cheapest)


def _whole_paths(found: DataFrame, key: list[str]) -> DataFrame:
    """Paths of found labels with the step on the target."""
    last = F.array(
        F.struct(F.col("to_seg").alias("segment_id"), F.col("entry").alias("entry_idx"), F.col("to_exit").alias("exit_idx"))
    )
    return found.select(
        *key, "to_seg", "to_exit", F.col("g").alias("cost"), F.col("dist").alias("length_m"),
        F.concat("before", last.cast(STEP)).alias("path"),
    )


def _by_rounds(
    searches: DataFrame, candidates: DataFrame, key: list[str], transitions: DataFrame, near: DataFrame | None, near_key: str | None, cfg: MatchConfig
) -> DataFrame:
    """The same over joins, for regions of any size: targets that no path within the limit
    reaches are left out first. Then one label a state, the cheapest, is followed: where every move that the limit
    cut off costs more than the path found, no longer beginning can have hidden a cheaper path, and the path is the
    result. Only the other targets are searched again with all labels that are cheaper or shorter than every other,
    from the start within the costs already found."""
    wanted = materialize(reachable_targets(searches, candidates, key, transitions), "reachable")
    sources, wanted = _sources(searches, wanted, key, near_key if near is not None else None)
    moves = (transitions, near, near_key, cfg)
    hits, whole, labels = _rounds(sources, wanted, key, moves, cheapest=True)
    lost = labels.filter("seg IS NULL").groupBy("sid").agg(F.min("g").alias("lost_g"))
    # A label beyond a search's own limit, but within the longest of its source, may hide shorter ones too.
    least = labels.groupBy("sid", F.col("seg").alias("to_seg")).agg(F.min("g").alias("least_g"))
    sure = (
        _best(hits, key).join(least, ["sid", "to_seg"]).join(lost, "sid", "left")
        .filter((F.col("g") <= F.col("least_g")) & (F.col("lost_g").isNull() | (F.col("g") + 1e-6 < F.col("lost_g"))))
        .drop("least_g", "lost_g")
    )
    sure = materialize(sure, "sure")
    left = materialize(wanted.join(sure.select(*key, "to_seg"), [*key, "to_seg"], "left_anti"), "left")
    found = sure.join(whole(sure), ["sid", "to_seg", "entry", "g", "dist"])
    if not left.isEmpty():
        given = materialize(hits.join(left.select(*key, "to_seg").distinct(), [*key, "to_seg"], "left_semi").select(*hits.columns), "given")
        again, whole, _ = _rounds(_open(sources.drop("n_open"), left, key), left, key, moves, cheapest=False, given=given)
        best = materialize(_best(again, key), "best")
        found = found.unionByName(best.join(whole(best), ["sid", "to_seg", "entry", "g", "dist"]))
    return _whole_paths(found.join(wanted.select(*key, "to_seg", "to_exit").distinct(), [*key, "to_seg"]), key)


def _rounds(
    sources: DataFrame, wanted: DataFrame, key: list[str], moves: tuple, cheapest: bool, given: DataFrame | None = None
) -> tuple[DataFrame, Callable[[DataFrame], DataFrame], DataFrame]:
    """Labels from all sources, round by round: (hits on targets, the paths of chosen hits, all labels).

    A label is a way of having entered a segment
    at a vertex, with its cost, length and steps, and names the label before it instead of holding its path. Per
    round every new label moves over all transitions of its segment, twice; per (source, segment,
    entry) only labels that are cheaper or shorter than every other stay, so the cheapest path
    within any limit is never lost to a cheaper but longer beginning; with ``cheapest`` only the cheapest one stays,
    and the cheapest move that the limit cut off is kept, as a label without a segment. Labels are dropped when
    the straight line to the goals no longer fits (``slack_m`` covers the extent of
    the target segments), or when all targets of the source are reached at a lower cost, be it by hits ``given`` from
    another search. It ends when no label is new: lengths are bounded by the limits, so it always ends.
    """
    spark = sources.sparkSession
    start = sources.select(
        "sid", "near_group", "limit_m", "goal_lat", "goal_lon", "reach_m",
        F.col("from_seg").alias("seg"), F.col("from_entry").cast("int").alias("entry"),
        F.col("from_pos").alias("pos"), F.lit(0.0).alias("g"), F.lit(0.0).alias("dist"), F.lit(0).alias("steps"),
        *[F.lit(None).cast(kind).alias(c) for c, kind in _PARENT.items()], F.lit(False).alias("moved"),
    )
    # Labels live in a table with one folder per round: each round appends its new labels and
    # reads the older ones by column, so nothing is written twice. Labels of target segments go to a second, small one.
    table, hits = scratch_path(spark, "labels"), scratch_path(spark, "hits")
    start.write.parquet(f"{table}/round=0")
    columns = spark.read.parquet(f"{table}/round=0").schema.fields
    _hits(spark.read.parquet(f"{table}/round=0"), wanted, key).write.parquet(f"{hits}/round=0")
    hit_columns = spark.read.parquet(f"{hits}/round=0").schema.fields

    def labels(round_no: int | None = None) -> DataFrame:
        known = spark.read.schema(T.StructType([*columns, T.StructField("round", T.IntegerType())])).parquet(table)
        return known if round_no is None else known.filter(F.col("round") == round_no).drop("round")

    def reached(rounds: int) -> DataFrame:
        return spark.read.schema(T.StructType(hit_columns)).parquet(*[f"{hits}/round={r}" for r in range(rounds)])

    kept, unknown = (_cheapest, _cheaper) if cheapest else (_undominated, _unknown)
    for number in itertools.count(1):
        frontier = labels(number - 1).filter(~F.col("moved") & F.col("seg").isNotNull()).drop("moved")
        if frontier.isEmpty():
            break
        bound = _cost_bound(reached(number) if given is None else reached(number).unionByName(given), sources, key)
        alive = frontier.join(bound, "sid", "left").filter(F.col("bound").isNull() | (F.col("g") <= F.col("bound")))
        once = kept(_move(alive.drop("bound"), *moves, cut=cheapest))
        twice = _move(once, *moves, cut=cheapest)
        both = once.withColumn("moved", F.lit(True)).unionByName(twice.withColumn("moved", F.lit(False)))
        unknown(kept(both), labels()).write.parquet(f"{table}/round={number}")
        _hits(labels(number), wanted, key).write.parquet(f"{hits}/round={number}")

    def whole(best: DataFrame) -> DataFrame:
        ends = best.select("sid", F.col("to_seg").alias("seg"), "entry", "g", "dist").distinct()
        return _rebuilt(ends, [labels(r) for r in range(number - 1, 0, -1)]).withColumnRenamed("seg", "to_seg")

    return reached(number), whole, labels()


def _best(hits: DataFrame, key: list[str]) -> DataFrame:
    return (
        hits.groupBy(*key, "to_seg").agg(F.min(F.struct("g", "dist", "steps", "entry", "sid")).alias("b"))
        .select(*key, "to_seg", "b.*")
    )


#: What a label knows of the one before it: its place, cost and length, and the vertex it was left by.
_PARENT = {"p_seg": "bigint", "p_entry": "int", "p_exit": "int", "p_g": "double", "p_dist": "double"}
_LABEL = ["sid", "seg", "entry", "g", "dist"]


def _sources(searches: DataFrame, wanted: DataFrame, key: list[str], group: str | None) -> tuple[DataFrame, DataFrame]:
    """The distinct starts of all searches that have a target, and the targets with their search's source and limit.

    A source keeps within the largest reach of its searches around one goal: each search's limit and slack, plus the way
    from that search's own goal to this one.
    """
    start = ["near_group", "from_seg", "from_entry", "from_pos"]
    asked = searches.withColumn("near_group", F.col(group).cast("string") if group else F.lit(""))
    asked = asked.join(wanted.select(*key).distinct(), key, "left_semi")
    one = asked.groupBy(*start).agg(F.min(F.struct("goal_lat", "goal_lon")).alias("one"))
    apart = geo.haversine(F.col("one.goal_lat"), F.col("one.goal_lon"), F.col("goal_lat"), F.col("goal_lon"))
    sources = (
        asked.join(one, start).groupBy(*start)
        .agg(
            F.max("limit_m").alias("limit_m"), F.max(F.col("limit_m") + F.col("slack_m") + apart).alias("reach_m"),
            F.first("one").alias("one"),
        )
        .select(F.monotonically_increasing_id().alias("sid"), *start, "limit_m", "reach_m", "one.goal_lat", "one.goal_lon")
    )
    sources = materialize(sources, "sources")
    of_key = asked.join(sources.select("sid", *start), start).select("sid", *key, "limit_m")
    wanted = materialize(wanted.join(of_key, key), "wanted")
    return _open(sources, wanted, key), wanted


def _open(sources: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """Sources that have targets, with their number."""
    open_of = wanted.select("sid", *key, "to_seg").distinct().groupBy("sid").agg(F.count(F.lit(1)).alias("n_open"))
    return materialize(sources.join(open_of, "sid"), "sources")


def _hits(labels: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """Labels on target segments, for every search that takes them within its own limit."""
    asked = wanted.select("sid", *key, F.col("to_seg").alias("seg"), F.col("limit_m").alias("own_limit")).distinct()
    return (
        labels.select(*_LABEL, "steps").join(asked, ["sid", "seg"]).filter(F.col("dist") <= F.col("own_limit"))
        .select(*key, "sid", F.col("seg").alias("to_seg"), "entry", "g", "dist", "steps")
    )


def _rebuilt(ends: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """Steps before each of the labels ``ends``, by their rounds from the last to the first."""
    name = {c: f"end_{c}" for c in _LABEL}
    at = ends.select(*[F.col(c).alias(n) for c, n in name.items()], *_LABEL, F.array().cast(STEP).alias("before"))
    step = F.struct(F.col("p_seg").alias("segment_id"), F.col("p_entry").alias("entry_idx"), F.col("p_exit").alias("exit_idx"))
    back = {"seg": "p_seg", "entry": "p_entry", "g": "p_g", "dist": "p_dist"}
    for known in rounds:
        # A round's second move starts from labels of its first.
        for moved in (False, True):
            here = known.filter(F.col("moved") == moved).select(*_LABEL, *_PARENT)
            at = at.join(here, _LABEL, "left").select(
                *name.values(), "sid",
                *[F.coalesce(F.col(p), F.col(c)).alias(c) for c, p in back.items()],
                F.when(F.col("p_seg").isNull(), F.col("before")).otherwise(F.concat(F.array(step).cast(STEP), "before")).alias("before"),
            )
        at = materialize(at, "rebuilt")
    return at.select(*[F.col(n).alias(c) for c, n in name.items()], "before")


def reachable_targets(searches: DataFrame, targets: DataFrame, key: list[str], transitions: DataFrame) -> DataFrame:
    """Targets that some path within their search's limit reaches, so that no search runs for the others.

    Needs no costs, so the shortest lengths are shared by all searches from one segment and vertex, whatever their
    trip, up to the longest of their limits. A start's search ends when all its targets are reached by shorter ways;
    targets that few segments lead to at all are taken out before, as they would keep it going up to the limit.
    """
    spark = searches.sparkSession
    source = ["from_seg", "from_entry"]
    table = scratch_path(spark, "reach")
    wanted = targets.join(searches.select(*key, *source, "limit_m"), key)
    wanted = materialize(_not_cut_off(wanted, transitions), "not_cut_off")
    ends = materialize(wanted.select(*source, F.col("to_seg").alias("seg")).distinct(), "ends")
    open_of = ends.groupBy(*source).agg(F.count(F.lit(1)).alias("n_open"))
    start = wanted.join(searches.select(*key, "from_pos"), key).groupBy(*source).agg(F.max("limit_m").alias("limit_m"), F.min("from_pos").alias("pos"))
    start.select(
        *source, "limit_m", F.col("from_seg").alias("seg"), F.col("from_entry").cast("int").alias("entry"), "pos",
        F.lit(0.0).alias("dist"), F.lit(False).alias("moved"),
    ).write.parquet(f"{table}/round=0")
    columns = spark.read.parquet(f"{table}/round=0").schema.fields
    whole = T.StructType([*columns, T.StructField("round", T.IntegerType())])
    moves = transitions.select("src", "src_oneway", "exit_idx", "exit_pos", "dst", "entry_idx", "entry_pos")
    state = [*source, "seg", "entry"]

    def move(at: DataFrame) -> DataFrame:
        new_dist = F.round(F.col("dist") + F.abs(F.col("exit_pos") - F.col("pos")), 6)
        return (
            at.join(moves, F.col("seg") == F.col("src"))
            .filter(~F.col("src_oneway") | (F.col("exit_idx") >= F.col("entry")))
            .withColumn("dist", new_dist).filter(F.col("dist") <= F.col("limit_m"))
            .groupBy(*source, F.col("dst").alias("seg"), F.col("entry_idx").cast("int").alias("entry"))
            .agg(F.first("limit_m").alias("limit_m"), F.first("entry_pos").alias("pos"), F.min("dist").alias("dist"))
        )

    for number in itertools.count(1):
        known = spark.read.schema(whole).parquet(table)
        frontier = known.filter((F.col("round") == number - 1) & ~F.col("moved")).drop("round", "moved")
        if frontier.isEmpty():
            break
        hit = known.join(ends, [*source, "seg"]).groupBy(*source, "seg").agg(F.min("dist").alias("dist"))
        hit = hit.groupBy(*source).agg(F.max("dist").alias("bound"), F.count(F.lit(1)).alias("n_hit")).join(open_of, source)
        bound = hit.filter(F.col("n_hit") == F.col("n_open")).select(*source, "bound")
        frontier = frontier.join(bound, source, "left").filter(F.col("bound").isNull() | (F.col("dist") < F.col("bound"))).drop("bound")
        once = move(frontier)
        n = once.withColumn("moved", F.lit(True)).unionByName(move(once).withColumn("moved", F.lit(False)))
        best = n.groupBy(*state).agg(F.min_by(F.struct("limit_m", "pos", "dist", "moved"), F.struct("dist", ~F.col("moved"))).alias("b"))
        least = known.groupBy(*state).agg(F.min("dist").alias("known_m"))
        new = best.select(*state, "b.*").join(least, state, "left").filter(F.col("known_m").isNull() | (F.col("dist") < F.col("known_m")))
        new.select([f.name for f in columns]).write.parquet(f"{table}/round={number}")
    reached = spark.read.schema(whole).parquet(table).groupBy(*source, F.col("seg").alias("to_seg")).agg(F.min("dist").alias("least_m"))
    return wanted.join(reached, [*source, "to_seg"]).filter(F.col("least_m") <= F.col("limit_m")).select(targets.columns)


#: Steps against the moves in which a target's ancestors must end for it to be known as cut off.
BACK_STEPS = 16


def _not_cut_off(asked: DataFrame, transitions: DataFrame) -> DataFrame:
    """The rows of ``asked`` (from_seg, from_entry, to_seg) but those whose target has all its ancestors within ``BACK_STEPS``
    and the start not among them.

    Of a segment the last place is kept by which it may be entered; a two-way segment may be entered anywhere. A target with
    ancestors further away is left to the search.
    """
    anywhere = F.lit(2**31 - 1)
    moves = transitions.select(
        "src", "dst", F.when(F.col("dst_oneway"), F.col("entry_idx")).otherwise(0).cast("int").alias("entry"),
        F.when(F.col("src_oneway"), F.col("exit_idx")).otherwise(anywhere).cast("int").alias("latest"),
    )
    # A target counts as reached at whatever place it is entered.
    level = cut_lineage(asked.select("to_seg", F.col("to_seg").alias("seg"), anywhere.cast("int").alias("latest")).distinct())
    goal, seen = level, level.limit(0)
    for _ in range(BACK_STEPS):
        at = level.select("to_seg", F.col("seg").alias("dst"), F.col("latest").alias("need"))
        step = (
            at.join(moves, "dst").filter(F.col("entry") <= F.col("need"))
            .groupBy("to_seg", F.col("src").alias("seg")).agg(F.max("latest").alias("latest"))
        )
        known = seen.groupBy("to_seg", "seg").agg(F.max("latest").alias("known"))
        new = step.join(known, ["to_seg", "seg"], "left").filter(F.col("known").isNull() | (F.col("latest") > F.col("known"))).drop("known")
        level = materialize(new, "back")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    ended = goal.select("to_seg").join(level.select("to_seg").distinct(), "to_seg", "left_anti").withColumn("_ended", F.lit(True))
    last = seen.groupBy("to_seg", F.col("seg").alias("from_seg")).agg(F.max("latest").alias("_latest"))
    return (
        asked.join(ended, "to_seg", "left").join(last, ["to_seg", "from_seg"], "left")
        .filter(F.col("_ended").isNull() | (F.col("_latest") >= F.col("from_entry")))
        .select(*asked.columns)
    )


def _split_trivial(searches: DataFrame, targets: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Targets on the start segment itself cost just the way along it."""
    both = targets.select(*key, "to_seg", F.col("to_exit").cast("int").alias("to_exit"), "to_pos").join(
        searches.select(*key, "from_seg", "from_entry", "from_pos"), key
    )
    step = F.array(
        F.struct(F.col("to_seg").alias("segment_id"), F.col("from_entry").alias("entry_idx"), F.col("to_exit").alias("exit_idx"))
    ).cast(STEP)
    along = F.abs(F.col("to_pos") - F.col("from_pos"))
    same = both.filter(F.col("to_seg") == F.col("from_seg")).select(
        *key, "to_seg", "to_exit", along.alias("cost"), F.lit(0.0).alias("length_m"), step.alias("path")
    )
    return same, both.filter(F.col("to_seg") != F.col("from_seg"))


def _cost_bound(hits: DataFrame, sources: DataFrame, key: list[str]) -> DataFrame:
    """Highest of the best target costs, for sources all of whose searches have reached all their targets."""
    best = hits.groupBy("sid", *key, "to_seg").agg(F.min("g").alias("g"))
    return (
        best.groupBy("sid").agg(F.max("g").alias("bound"), F.count(F.lit(1)).alias("n"))
        .join(sources.select("sid", "n_open"), "sid").filter(F.col("n") == F.col("n_open")).select("sid", "bound")
    )


def _move(alive: DataFrame, transitions: DataFrame, near: DataFrame | None, near_key: str | None, cfg: MatchConfig, cut: bool = False) -> DataFrame:
    """Labels after one move; with ``cut``, moves beyond the limit stay as labels without a segment."""
    leg = F.abs(F.col("exit_pos") - F.col("pos"))
    to_goal = geo.haversine(F.col("lat"), F.col("lon"), F.col("goal_lat"), F.col("goal_lon"))
    out = (
        alive.drop(*_PARENT).join(transitions, F.col("seg") == F.col("src"))
        .filter(~F.col("src_oneway") | (F.col("exit_idx") >= F.col("entry")))
        .withColumn("leg", leg)
        .withColumn("new_dist", F.round(F.col("dist") + F.col("leg"), 6))
        .withColumn("fits", (F.col("new_dist") <= F.col("limit_m")) & (F.col("new_dist") + to_goal <= F.col("reach_m") + 0.01))
    )
    if not cut:
        out = out.filter("fits")
    if near is None:
        out = out.withColumn("n_near", F.lit(0))
    else:
        counts = near.select(F.col(near_key).cast("string").alias("near_group"), F.col("segment_id").alias("dst"), "n_near")
        out = out.join(counts, ["near_group", "dst"], "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)))
    cost = roads.move_cost(
        F.col("leg"), F.col("static_cost"), F.col("n_near"), F.col("dst_private"), cfg.near_point_factor, cfg.private_factor
    )
    return out.select(
        "sid", "near_group", "limit_m", "goal_lat", "goal_lon", "reach_m",
        F.when(F.col("fits"), F.col("dst")).alias("seg"), F.when(F.col("fits"), F.col("entry_idx").cast("int")).alias("entry"),
        F.col("entry_pos").alias("pos"), F.round(F.col("g") + cost, 9).alias("g"), F.col("new_dist").alias("dist"), (F.col("steps") + 1).alias("steps"),
        F.col("seg").alias("p_seg"), F.col("entry").alias("p_entry"), F.col("exit_idx").cast("int").alias("p_exit"),
        F.col("g").alias("p_g"), F.col("dist").alias("p_dist"),
    )


def _undominated(labels: DataFrame) -> DataFrame:
    """Keep labels shorter than all that are cheaper."""
    order = Window.partitionBy("sid", "seg", "entry").orderBy("g", "dist", "steps", *_PARENT)
    shortest = F.min("dist").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return (
        labels.withColumn("_shortest", shortest)
        .filter(F.col("_shortest").isNull() | (F.col("dist") < F.col("_shortest")))
        .drop("_shortest")
    )


def _cheapest(labels: DataFrame) -> DataFrame:
    """Keep the cheapest label of each state; of equally cheap ones the shortest."""
    order = ["g", "dist", "steps", *_PARENT]
    rest = [c for c in labels.columns if c not in ("sid", "seg", "entry")]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return labels.groupBy("sid", "seg", "entry").agg(first.alias("b")).select("sid", "seg", "entry", "b.*").select(*labels.columns)


def _cheaper(new: DataFrame, known: DataFrame) -> DataFrame:
    """New labels that are cheaper, or as cheap and shorter, than every known one of their state."""
    state = ["sid", "seg", "entry"]
    least = known.groupBy(*state).agg(F.min(F.struct("g", "dist")).alias("_least"))
    return (
        new.join(least, state, "left").filter(F.col("_least").isNull() | (F.struct("g", "dist") < F.col("_least")))
        .select(*new.columns)
    )


def _unknown(new: DataFrame, known: DataFrame) -> DataFrame:
    """New labels that no known label matches in both cost and length."""
    n, k = new.alias("n"), known.select(*_LABEL).alias("k")
    on = (F.col("k.g") <= F.col("n.g")) & (F.col("k.dist") <= F.col("n.dist"))
    for c in ("sid", "seg", "entry"):
        on = on & (F.col(f"n.{c}") == F.col(f"k.{c}"))
    return n.join(k, on, "left_anti")


def direct_routes(pairs: DataFrame, segs: DataFrame, transitions: DataFrame, cfg: MatchConfig = MATCH) -> DataFrame:
    """Routes between segment pairs (from_seg, to_seg), first vertex to first vertex, at most
    three times the straight line and never below two kilometers of limit, with a verdict: ``outcome`` is ``found``,
    ``too_far`` (a way exists, but not within the limit) or ``no_connection``; whether one move leads from the
    first to the second; and how many segments can be moved to from the first, and to the second."""
    mid = segs.select("segment_id", geo.ends_midpoint(F.col("coordinates")).alias("m"), geo.polyline_length(F.col("coordinates")).alias("len"))
    f = mid.select(F.col("segment_id").alias("from_seg"), F.col("m").alias("fm"), F.col("len").alias("f_len"))
    t = mid.select(F.col("segment_id").alias("to_seg"), F.col("m").alias("tm"), F.col("len").alias("t_len"))
    direct = geo.haversine(F.col("fm.y"), F.col("fm.x"), F.col("tm.y"), F.col("tm.x"))
    full = (
        pairs.select("from_seg", "to_seg").distinct().join(f, "from_seg").join(t, "to_seg")
        .withColumn("direct_m", direct)
        .withColumn("limit_m", F.greatest(F.col("direct_m") * 3.0, F.lit(2000.0)))
    )
    full = cut_lineage(full)
    # Pairs without any way would be searched up to their limit for nothing.
    ways = reach.search_reach(full.select("from_seg", F.lit(0).alias("from_entry"), "to_seg"), transitions)
    ways = materialize(ways.select("from_seg", "to_seg", F.lit(True).alias("_way")), "ways")
    joined = materialize(full.join(ways, ["from_seg", "to_seg"], "left").filter(F.col("_way") | (F.col("from_seg") == F.col("to_seg"))), "joined")
    searches = joined.select(
        "from_seg", F.col("to_seg").alias("goal_seg"), F.lit(0).alias("from_entry"), F.lit(0.0).alias("from_pos"), "limit_m",
        F.col("tm.y").alias("goal_lat"), F.col("tm.x").alias("goal_lon"), F.col("t_len").alias("slack_m"),
        F.col("fm.y").alias("start_lat"), F.col("fm.x").alias("start_lon"), F.col("f_len").alias("start_slack_m"),
    )
    targets = joined.select("from_seg", F.col("to_seg").alias("goal_seg"), "to_seg", F.lit(0).alias("to_exit"), F.lit(0.0).alias("to_pos"))
    # from_seg doubles as part of the key.
    searches = searches.withColumn("start_seg", F.col("from_seg"))
    targets = targets.withColumnRenamed("from_seg", "start_seg")
    paths = bounded_paths(searches, targets, ["start_seg", "goal_seg"], transitions, cfg=cfg)
    paths = paths.select(F.col("start_seg").alias("from_seg"), F.col("goal_seg").alias("to_seg"), "cost", "length_m", "path")
    routes = materialize(full.select("from_seg", "to_seg", "direct_m", "limit_m").join(paths, ["from_seg", "to_seg"], "left"), "direct")
    degree = transitions.select("src", "dst").distinct()
    out = degree.groupBy(F.col("src").alias("from_seg")).agg(F.count(F.lit(1)).alias("n_out"))
    into = degree.groupBy(F.col("dst").alias("to_seg")).agg(F.count(F.lit(1)).alias("n_in"))
    direct = degree.select(F.col("src").alias("from_seg"), F.col("dst").alias("to_seg"), F.lit(True).alias("_direct"))
    outcome = F.when(F.col("cost").isNotNull(), "found").when(F.col("_way"), "too_far").otherwise("no_connection")
    zero = F.lit(0).cast("long")
    return (
        routes.join(ways, ["from_seg", "to_seg"], "left").join(out, "from_seg", "left").join(into, "to_seg", "left")
        .join(direct, ["from_seg", "to_seg"], "left")
        .select(
            *routes.columns, outcome.alias("outcome"), F.coalesce("_direct", F.lit(False)).alias("directly_connected"),
            F.coalesce("n_out", zero).alias("n_out"), F.coalesce("n_in", zero).alias("n_in"),
        )
    )
