"""Path searches side by side, each task over the part of the road network that its searches can reach.

Costs are whole numbers of 1e-9 and lengths of 1e-6 m, so a beginning of a path has one label, which orders by cost, then length, then
steps, and labels of parts of a path add up exactly. So the tree of cheapest ways from a place is grown once and serves all
searches that pass the place. The points of a trip make few segments cheaper to enter: a search joins the trees of its start and of
the places where it enters such a segment.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.config import METERS_PER_DEGREE, MatchConfig
from wayloom.functions import geo
from wayloom.session import materialize

#: Side in degrees of the smallest regions; a level has twice that of the one before.
CELL_DEG = 0.01
#: Moves of a region that a task may hold; searches of larger regions go round by round over joins.
MAX_MOVES = 600_000
#: Asked targets of a task, and moves of its region for one more of them.
PART_ASKS, MOVES_PER_ASK = 250, 32
#: Asked targets from one start in one task.
START_ASKS = 20_000
#: Cheaper places that are met by joining trees; with more the search goes over the trip's own costs.
MAX_PLACES = 64
#: Labels of all trees that a task keeps.
MAX_LABELS = 600_000

COST, LENGTH = 10**9, 10**6
G_BITS, D_BITS = 64, 20
D_MASK = (1 << (G_BITS - D_BITS)) - 1

REGION = ["level", "region_x", "region_y"]
FOUND = (
    "sid long, to_seg long, limit_m double, entry int, g double, dist double, "
    "before array<struct<segment_id:bigint,entry_idx:int,exit_idx:int>>, sure boolean"
)


def located(sources: DataFrame, transitions: DataFrame) -> DataFrame:
    """Sources with their region (level, region_x, region_y) and a circle that holds all places their paths leave a segment at.

    A source whose segment cannot be left within the limit has no path and is not returned. Paths keep within the limit of
    the start, and the ways to the start and to the goal sum up to the reach at most, so they also lie within half of it around the
    middle; the smaller circle counts. The start lies where its segment is first left, but for the way there: lines may be long.
    The level's cells are as wide as the circle's radius at least.
    """
    exits = transitions.select(F.col("src").alias("from_seg"), "exit_idx", "exit_pos", "src_oneway", F.struct("lat", "lon").alias("exit"))
    start = ["from_seg", "from_entry", "from_pos"]
    leg = F.abs(F.col("exit_pos") - F.col("from_pos"))
    first = (
        sources.select(*start).distinct().join(exits, "from_seg").filter(~F.col("src_oneway") | (F.col("exit_idx") >= F.col("from_entry")))
        .groupBy(*start).agg(F.min(F.struct(leg.alias("leg"), "exit")).alias("first")).select(*start, "first.leg", "first.exit")
    )
    lat, lon = F.col("exit.lat"), F.col("exit.lon")
    apart = geo.haversine(lat, lon, F.col("goal_lat"), F.col("goal_lon"))
    around, between = F.col("limit_m") + F.col("leg") + 10, (F.col("reach_m") + F.col("leg")) / 2 * 1.01 + 10
    # The middle in degrees and that of the straight line differ little but far from the equator.
    flat = (apart < 200_000) & (F.abs(lon - F.col("goal_lon")) < 90) & (F.greatest(F.abs(lat), F.abs("goal_lat")) < 80)
    middle = flat & (between < around)
    at = {
        "_radius": F.when(middle, between).otherwise(around) / METERS_PER_DEGREE,
        "_lat": F.when(middle, (lat + F.col("goal_lat")) / 2).otherwise(lat), "_lon": F.when(middle, (lon + F.col("goal_lon")) / 2).otherwise(lon),
    }
    level = F.greatest(F.ceil(F.log2(F.col("_radius") / CELL_DEG)), F.lit(0)).cast("int")
    return (
        sources.join(first, start).filter(F.col("leg") <= F.col("limit_m")).withColumns(at).drop("leg", "exit").withColumn("level", level)
        .withColumn("region_x", geo.tile_index(F.col("_lon"), _size(F.col("level"))))
        .withColumn("region_y", geo.tile_index(F.col("_lat"), _size(F.col("level"))))
    )


def _size(level: Column) -> Column:
    return F.lit(CELL_DEG) * F.pow(F.lit(2.0), level.cast("double"))


def placed(sources: DataFrame, transitions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources with region and part, the cells of every region, cells of moves by level): ``part`` is NULL where the
    region has too many moves for a task."""
    at = materialize(located(sources, transitions), "located")
    lat, r, size = F.col("_lat"), F.col("_radius"), _size(F.col("level"))
    polar = F.abs(lat) + r >= geo.POLAR_DEG
    dx = F.when(polar, 180.0).otherwise(geo.lon_reach(F.abs(lat) + 0.0, F.col("_radius")))
    cells = (
        at.withColumn("cell_x", F.explode(geo.lon_cells(F.col("_lon"), dx, size)))
        .withColumn("cell_y", F.explode(F.sequence(geo.tile_index(lat - r, size), geo.tile_index(lat + r, size))))
        .select(*REGION, "cell_x", "cell_y").distinct()
    )
    cells = materialize(cells, "cells")
    levels = sorted(x.level for x in cells.select("level").distinct().collect())
    moves = transitions.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels]) if levels else F.array().cast("array<int>")))
    moves = moves.withColumns({"cell_x": geo.tile_index(F.col("lon"), _size(F.col("level"))), "cell_y": geo.tile_index(F.col("lat"), _size(F.col("level")))})
    held = moves.groupBy("level", "cell_x", "cell_y").agg(F.count(F.lit(1)).alias("n"))
    held = cells.join(held, ["level", "cell_x", "cell_y"]).groupBy(*REGION).agg(F.sum("n").alias("n_moves"))
    asks = at.groupBy(*REGION).agg(F.sum("n_open").alias("n_asks"))
    regions = asks.join(held, REGION, "left").withColumn("n_moves", F.coalesce("n_moves", F.lit(0)))
    n_parts = F.ceil(F.col("n_asks") / F.greatest(F.lit(float(PART_ASKS)), F.col("n_moves") / MOVES_PER_ASK)).cast("int")
    regions = regions.select(*REGION, F.when(F.col("n_moves") <= MAX_MOVES, n_parts).alias("n_parts"))
    start = ["from_seg", "from_entry"]
    of_start = at.groupBy(*REGION, *start).agg(F.ceil(F.sum("n_open") / START_ASKS).cast("int").alias("_salts"))
    salt = F.pmod(F.xxhash64("sid"), F.col("_salts"))
    part = F.pmod(F.xxhash64(*start, salt), F.col("n_parts")).cast("int")
    parts = at.join(regions, REGION).join(of_start, [*REGION, *start]).withColumn("part", part).select(*sources.columns, *REGION, "part")
    return materialize(parts, "parts"), cells, moves


def search(parts: DataFrame, cells: DataFrame, moves: DataFrame, wanted: DataFrame, near: DataFrame | None, cfg: MatchConfig, cheapest: bool) -> DataFrame:
    """The best path from each source to each of its targets (sid, to_seg, limit_m), as ``FOUND`` has it.

    With ``cheapest`` it is the cheapest of all; ``sure`` tells that it keeps the limit. Targets that no path within the limit
    reaches are left out. Without it, it is the cheapest within the limit. ``near``: near_group, segment_id, n_near.
    """
    slot = [*REGION, "part"]
    own = wanted.select("sid", "to_seg", "limit_m").distinct().join(parts.filter("part IS NOT NULL").drop("limit_m"), "sid")
    asks = own.select(
        *slot, F.lit(0).alias("kind"), "sid", "near_group", "from_seg", F.col("from_entry").cast("int").alias("from_entry"), "from_pos", "to_seg",
        "limit_m", F.lit(0).cast("long").alias("n_near"),
    )
    asks = materialize(asks, "asks")
    slots = asks.select(*slot).distinct()
    here = moves.join(cells.join(slots.select(*REGION).distinct(), REGION, "left_semi"), ["level", "cell_x", "cell_y"])
    here = here.join(slots, REGION).select(
        *slot, "src", F.col("exit_idx").cast("int").alias("exit_idx"), "exit_pos", "src_oneway", "dst",
        F.col("entry_idx").cast("int").alias("entry_idx"), "entry_pos", "static_cost", "dst_private",
    )
    left = asks
    if near is not None:
        # Of a trip's cheaper segments only those that the region enters.
        entered = moves.select("level", "cell_x", "cell_y", F.col("dst").alias("segment_id")).distinct()
        entered = cells.join(entered, ["level", "cell_x", "cell_y"]).select(*REGION, "segment_id").distinct()
        groups = asks.select(*slot, "near_group").distinct()
        held = near.join(groups, "near_group").join(entered, [*REGION, "segment_id"], "left_semi")
        left = left.unionByName(held.select(
            *slot, F.lit(1).alias("kind"), F.lit(0).cast("long").alias("sid"), "near_group", F.lit(0).cast("long").alias("from_seg"),
            F.lit(0).alias("from_entry"), F.lit(0.0).alias("from_pos"), F.col("segment_id").alias("to_seg"), F.lit(0.0).alias("limit_m"),
            F.col("n_near").cast("long").alias("n_near"),
        ))
    tasks = min(max(slots.count(), 1), 2000)
    dealt = [d.repartition(tasks, *slot).groupBy(*slot) for d in (left, here)]
    return dealt[0].cogroup(dealt[1]).applyInArrow(_searcher(cfg.near_point_factor, cfg.private_factor, cheapest), FOUND)


def _searcher(near_factor: float, private_factor: float, cheapest: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    kinds = {"sid": pa.int64(), "to_seg": pa.int64(), "limit_m": pa.float64(), "entry": pa.int32(), "g": pa.float64(), "dist": pa.float64()}
    step = pa.struct([("segment_id", pa.int64()), ("entry_idx", pa.int32()), ("exit_idx", pa.int32())])
    schema = pa.schema([*kinds.items(), ("before", pa.list_(step)), ("sure", pa.bool_())])

    def run(asked: pa.Table, moves: pa.Table) -> pa.Table:
        rows = list(_answers(asked, moves, near_factor, private_factor, cheapest))
        columns = list(zip(*rows)) or [[]] * len(schema)
        steps = [s for path in columns[6] for s in path]
        ends = np.cumsum([0, *map(len, columns[6])], dtype=np.int32)
        flat = [pa.array(c, f.type) for c, f in zip(list(zip(*steps)) or [[]] * 3, step)]
        paths = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(flat, fields=list(step)))
        arrays = [paths if f.name == "before" else pa.array(c, f.type) for c, f in zip(columns, schema)]
        return pa.Table.from_arrays(arrays, schema=schema)

    return run


def _answers(asked: pa.Table, moves: pa.Table, near_factor: float, private_factor: float, cheapest: bool) -> Iterator[tuple]:
    near: dict[str, dict[int, int]] = {}
    kinds = asked["kind"].to_pylist()
    columns = [asked[c].to_pylist() for c in ("near_group", "sid", "from_seg", "from_entry", "from_pos", "to_seg", "limit_m", "n_near")]
    searches: dict[tuple, dict[int, list]] = {}
    for kind, group, sid, seg, entry, pos, to_seg, limit, n in zip(kinds, *columns):
        if kind == 1:
            near.setdefault(group, {})[to_seg] = n
        else:
            searches.setdefault((seg, entry, pos), {}).setdefault(sid, [group, []])[1].append((to_seg, limit))
    if not searches:
        return
    roads = _Roads(moves, list(searches), near_factor, private_factor)
    for place in sorted(searches):
        start = roads.state[place]
        of_start = [(sid, group, asks) for sid, (group, asks) in searches[place].items()]
        furthest = max(limit for *_, asks in of_start for _, limit in asks)
        lengths = roads.lengths(start, {t for *_, asks in of_start for t, _ in asks}, most_length(furthest))
        for sid, group, asks in of_start:
            open_targets = [(t, limit) for t, limit in asks if t in lengths and lengths[t] / LENGTH <= limit]
            if not open_targets:
                continue
            bonus = near.get(group, {})
            if cheapest:
                found = roads.cheapest(start, bonus, {t for t, _ in open_targets})
                for t, limit in open_targets:
                    label, entry, path = found[t]
                    dist = label_length(label) / LENGTH
                    yield sid, t, limit, entry, label_cost(label) / COST, dist, path, dist <= limit
            else:
                for t, limit in open_targets:
                    label, entry, path = roads.within(start, bonus, t, limit)
                    yield sid, t, limit, entry, label_cost(label) / COST, label_length(label) / LENGTH, path, True
        roads.forget(start)


def most_length(limit: float) -> int:
    """The greatest length in whole numbers that keeps the limit."""
    most = int(limit * LENGTH) + 1
    while most / LENGTH > limit:
        most -= 1
    return most


def label_cost(label: int) -> int:
    return label >> G_BITS


def label_length(label: int) -> int:
    return (label >> D_BITS) & D_MASK


class _Tree:
    """Cheapest labels from one place, grown as far as asked for."""

    __slots__ = ("best", "heap", "moves")

    def __init__(self, start: int, moves: Callable[[int], list[tuple[int, int]]]) -> None:
        self.best, self.heap, self.moves = {start: 0}, [(0, start)], moves

    def grow(self, bound: int | None = None, places: dict[int, int] | None = None, targets: set[int] | None = None) -> None:
        """Settle all places with labels up to ``bound``; or go on until each of ``targets`` is met at one of its ``places``."""
        best, heap, moves, pop, push = self.best, self.heap, self.moves, heapq.heappop, heapq.heappush
        open_targets = set(targets or ())
        while heap and (open_targets if bound is None else heap[0][0] <= bound):
            label, at = pop(heap)
            if best[at] < label:
                continue
            if open_targets and at in places:
                open_targets.discard(places[at])
            for to, more in moves(at):
                new = label + more
                old = best.get(to)
                if old is None or new < old:
                    best[to] = new
                    push(heap, (new, to))


class _Roads:
    """The moves of a region as a graph of places: segments entered at a vertex."""

    def __init__(self, moves: pa.Table, starts: list[tuple[int, int, float]], near_factor: float, private_factor: float) -> None:
        self.near_factor = near_factor
        m = {c: moves[c].to_numpy(zero_copy_only=False) for c in moves.column_names}
        self.state: dict[tuple, int] = {}
        into = [self.state.setdefault(p, len(self.state)) for p in zip(m["dst"].tolist(), m["entry_idx"].tolist(), m["entry_pos"].tolist())]
        for place in starts:
            self.state.setdefault(place, len(self.state))
        places = list(self.state)
        self.seg, self.entry = [p[0] for p in places], [p[1] for p in places]
        seg, entry = np.array(self.seg, np.int64), np.array(self.entry, np.int64)
        pos = np.array([p[2] for p in places], np.float64)
        self.of_segment: dict[int, list[int]] = {}
        for n, s in enumerate(self.seg):
            self.of_segment.setdefault(s, []).append(n)
        # Every place meets the moves of its segment; a one-way road is only left further on.
        order = np.argsort(m["src"], kind="stable")
        src = m["src"][order]
        first, last = np.searchsorted(src, seg, "left"), np.searchsorted(src, seg, "right")
        count = last - first
        at = np.repeat(np.arange(len(seg)), count)
        k = order[np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)]
        fits = ~m["src_oneway"][k].astype(bool) | (m["exit_idx"][k] >= entry[at])
        at, k = at[fits], k[fits]
        leg = np.abs(m["exit_pos"][k] - pos[at])
        self.plain = (np.maximum(leg / 500.0, 0.1) + 1.0) * m["static_cost"][k]
        self.barrier = np.where(m["dst_private"][k].astype(bool), private_factor, 1.0)
        self.length = np.floor(leg * LENGTH + 0.5).astype(np.int64)
        self.cost = _whole(self.plain * self.barrier)
        self.to = np.array(into, np.int64)[k] if len(k) else np.zeros(0, np.int64)
        self.exit = m["exit_idx"][k].astype(np.int64)
        self.of = at
        # Places come in order, so the moves from one are a run; those into one are one by this order.
        self.out_first = np.searchsorted(at, np.arange(len(seg) + 1)).tolist()
        self.in_order = np.argsort(self.to, kind="stable")
        self.in_first = np.searchsorted(self.to[self.in_order], np.arange(len(seg) + 1)).tolist()
        self._out: dict[int, list] = {}
        self._out_m: dict[int, list] = {}
        self._in: dict[int, list] = {}
        self._cheaper: dict[tuple, list] = {}
        self.trees: dict[int, _Tree] = {}

    def out(self, at: int) -> list[tuple[int, int]]:
        found = self._out.get(at)
        if found is None:
            run = slice(self.out_first[at], self.out_first[at + 1])
            found = [(t, (c << G_BITS) | (d << D_BITS) | 1) for t, c, d in zip(self.to[run].tolist(), self.cost[run].tolist(), self.length[run].tolist())]
            self._out[at] = found
        return found

    def out_lengths(self, at: int) -> list[tuple[int, int]]:
        found = self._out_m.get(at)
        if found is None:
            run = slice(self.out_first[at], self.out_first[at + 1])
            found = self._out_m[at] = list(zip(self.to[run].tolist(), self.length[run].tolist()))
        return found

    def into(self, at: int) -> list[tuple[int, int, int, int]]:
        """(from place, label, exit, move) of the moves into a place."""
        found = self._in.get(at)
        if found is None:
            k = self.in_order[self.in_first[at] : self.in_first[at + 1]]
            rows = zip(self.of[k].tolist(), self.cost[k].tolist(), self.length[k].tolist(), self.exit[k].tolist(), k.tolist())
            found = self._in[at] = [(p, (c << G_BITS) | (d << D_BITS) | 1, x, n) for p, c, d, x, n in rows]
        return found

    def into_cheaper(self, at: int, bonus: dict[int, int]) -> list[tuple[int, int, int, int]]:
        """The same with the costs of a trip with that many points near each segment."""
        n = bonus.get(self.seg[at])
        if not n:
            return self.into(at)
        found = self._cheaper.get((at, n))
        if found is None:
            factor, found = float(np.power(self.near_factor, float(n))), []
            for p, label, x, k in self.into(at):
                cost = int(_whole(self.plain[k] * factor * self.barrier[k]))
                found.append((p, (cost << G_BITS) | (label & ((1 << G_BITS) - 1)), x, k))
            self._cheaper[at, n] = found
        return found

    def tree(self, at: int) -> _Tree:
        found = self.trees.get(at)
        if found is None:
            if sum(len(t.best) for t in self.trees.values()) > MAX_LABELS:
                self.trees.clear()
            found = self.trees[at] = _Tree(at, self.out)
        return found

    def forget(self, start: int) -> None:
        self.trees.pop(start, None)

    def lengths(self, start: int, targets: set[int], limit: int) -> dict[int, int]:
        """Least length at which each target is entered, of those within the limit."""
        tree = _Tree(start, self.out_lengths)
        best, heap, found, left = tree.best, tree.heap, {}, set(targets)
        while heap and left and heap[0][0] <= limit:
            dist, at = heapq.heappop(heap)
            if best[at] < dist:
                continue
            if self.seg[at] in left:
                left.discard(self.seg[at])
                found[self.seg[at]] = dist
            for to, more in self.out_lengths(at):
                new = dist + more
                old = best.get(to)
                if old is None or new < old:
                    best[to] = new
                    heapq.heappush(heap, (new, to))
        return found

    def cheapest(self, start: int, bonus: dict[int, int], targets: set[int]) -> dict[int, tuple[int, int, list]]:
        """Target segment -> label, entry and steps before it of the cheapest path."""
        places = {s: t for t in targets for s in self.of_segment.get(t, ())}
        cheap = [s for g in bonus for s in self.of_segment.get(g, ())]
        if len(cheap) > MAX_PLACES:
            own = _Tree(start, lambda at: self._out_cheaper(at, bonus))
            own.grow(places=places, targets=targets)
            bound = max(min(own.best[s] for s in self.of_segment[t] if s in own.best) for t in targets)
            own.grow(bound=bound)
            trees = [(0, own.best)]
        else:
            trees = self._joined(start, bonus, cheap, targets, places)

        def label_at(place: int) -> int | None:
            found = [at + best[place] for at, best in trees if place in best]
            return min(found) if found else None

        result = {}
        for t in targets:
            held = [(label_at(s), self.entry[s], s) for s in self.of_segment[t]]
            label, entry, place = min(x for x in held if x[0] is not None)
            result[t] = label, entry, self._steps(start, place, label, bonus, lambda p, before: label_at(p) == before)
        return result

    def _out_cheaper(self, at: int, bonus: dict[int, int]) -> list[tuple[int, int]]:
        plain = self.out(at)
        if not any(bonus.get(self.seg[to]) for to, _ in plain):
            return plain
        run = range(self.out_first[at], self.out_first[at + 1])
        cheaper = {n: label for to in {to for to, _ in plain} if bonus.get(self.seg[to]) for p, label, _, n in self.into_cheaper(to, bonus) if p == at}
        return [(to, cheaper.get(n, label)) for n, (to, label) in zip(run, plain)]

    def _joined(self, start: int, bonus: dict[int, int], cheap: list[int], targets: set[int], places: dict[int, int]) -> list[tuple[int, dict]]:
        """The trees of the start and of the cheaper places that a search may pass, with their labels."""
        first = self.tree(start)
        missing = {t for t in targets if not any(s in first.best for s in self.of_segment[t])}
        if missing:
            first.grow(places=places, targets=missing)
        best = {t: min(first.best[s] for s in self.of_segment[t] if s in first.best) for t in targets}
        bound = max(best.values())
        label, heap, trees = {start: 0}, [(0, start)], []
        doors = [(s, self.into_cheaper(s, bonus)) for s in cheap]
        while heap and heap[0][0] <= bound:
            at, place = heapq.heappop(heap)
            if label[place] < at:
                continue
            tree = self.tree(place)
            tree.grow(bound=bound - at)
            known = tree.best
            trees.append((at, known))
            for t in targets:
                for s in self.of_segment[t]:
                    if s in known and at + known[s] < best[t]:
                        best[t] = at + known[s]
            for s, doorway in doors:
                for p, more, _, _ in doorway:
                    if p in known:
                        new = at + known[p] + more
                        old = label.get(s)
                        if new <= bound and (old is None or new < old):
                            label[s] = new
                            heapq.heappush(heap, (new, s))
                            if s in places and new < best[places[s]]:
                                best[places[s]] = new
            bound = max(best.values())
        return trees

    def _steps(self, start: int, place: int, label: int, bonus: dict[int, int], held: Callable[[int, int], bool]) -> list[tuple[int, int, int]]:
        """Steps before a label, from the last to the first the smallest that lead to it."""
        steps = []
        while place != start or label:
            ways = [
                (self.seg[p], self.entry[p], x, before >> G_BITS, label_length(before), p, before)
                for p, more, x, _ in self.into_cheaper(place, bonus)
                if (before := label - more) >= 0 and held(p, before)
            ]
            seg, entry, x, _, _, place, label = min(ways)
            steps.append((seg, entry, x))
        return steps[::-1]

    def within(self, start: int, bonus: dict[int, int], target: int, limit: float) -> tuple[int, int, list]:
        """Label, entry and steps before the target of the cheapest path within the limit, which has to exist.

        Only places between whose least lengths from the start and to the target the limit leaves room are passed, in the order of the
        least cost that a path over them has in all. Of a place's labels those shorter than all cheaper ones go on.
        """
        most = most_length(limit)
        ahead = _Tree(start, self.out_lengths)
        ahead.grow(bound=most)
        ends = {s for s in self.of_segment[target] if s in ahead.best}
        rest = _back(ends, lambda at: [(p, (label >> D_BITS) & D_MASK) for p, label, *_ in self.into(at)], most)
        room = {s for s, d in rest.items() if ahead.best.get(s, most + 1) + d <= most}
        cost = _back(ends, lambda at: [(p, label >> G_BITS) for p, label, *_ in self.into_cheaper(at, bonus) if p in room], None)
        kept: dict[int, set[int]] = {}
        least: dict[int, int] = {}
        heap, best = [(cost[start] << G_BITS, start, 0)], None
        found: list[tuple[int, int, int]] = []
        while heap:
            order, at, label = heapq.heappop(heap)
            if best is not None and order > best:
                break
            length = label_length(label)
            if length >= least.get(at, most + 1):
                continue
            least[at] = length
            kept.setdefault(at, set()).add(label)
            if at in ends:
                best = order
                found.append((label, self.entry[at], at))
            for to, more in self._out_cheaper(at, bonus):
                if to in room:
                    new = label + more
                    if label_length(new) + rest[to] <= most:
                        heapq.heappush(heap, (new + (cost[to] << G_BITS), to, new))
        label, entry, place = min(found)
        return label, entry, self._steps(start, place, label, bonus, lambda p, before: before in kept.get(p, ()))


def _back(ends: set[int], into: Callable[[int], list[tuple[int, int]]], bound: int | None) -> dict[int, int]:
    """Least sums from each place to one of the ends."""
    best, heap = dict.fromkeys(ends, 0), [(0, s) for s in ends]
    while heap and (bound is None or heap[0][0] <= bound):
        label, at = heapq.heappop(heap)
        if best[at] < label:
            continue
        for p, more in into(at):
            new = label + more
            if p not in best or new < best[p]:
                best[p] = new
                heapq.heappush(heap, (new, p))
    return best


def _whole(cost: np.ndarray) -> np.ndarray:
    return np.floor(cost * COST + 0.5).astype(np.int64)
