"""Road attributes and costs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Road classes kept in the network.
NETWORK_CLASSES = [
    "motorway", "trunk", "primary", "secondary", "tertiary",
    "motorway_link", "trunk_link", "primary_link", "secondary_link", "tertiary_link",
    "residential", "living_street", "unclassified", "service",
]

# Preference factor per road class when moving onto a road.
TYPE_FACTOR = {
    "motorway": 0.5, "motorway_link": 0.6, "trunk": 0.7, "trunk_link": 0.8,
    "primary": 0.9, "primary_link": 1.0, "secondary": 1.2, "secondary_link": 1.3,
    "tertiary": 1.5, "tertiary_link": 1.6, "residential": 2.0, "unclassified": 2.5,
    "service": 3.0,
}
TYPE_FACTOR_DEFAULT = 3.5

# Class score of a road in a path's cost.
CLASS_SCORE = {
    "motorway": 1.0, "motorway_link": 1.0, "trunk": 2.0, "trunk_link": 2.0,
    "primary": 4.0, "primary_link": 4.0, "secondary": 6.0, "secondary_link": 6.0,
    "tertiary": 8.0, "tertiary_link": 8.0, "residential": 10.0, "living_street": 10.0,
    "unclassified": 12.0, "service": 15.0,
}
CLASS_SCORE_DEFAULT = 20.0

# Rank of the group a class belongs to; groups up to two ranks apart may connect.
CLASS_GROUP = {
    "motorway": 0, "motorway_link": 0, "trunk": 1, "trunk_link": 1,
    "primary": 2, "primary_link": 2, "secondary": 3, "secondary_link": 3,
    "tertiary": 4, "tertiary_link": 4, "residential": 5, "unclassified": 5,
    "service": 5, "living_street": 5, "track": 6, "path": 6, "footway": 6, "cycleway": 6,
}
MAX_GROUP_STEPS = 2

# Tags that have a column of their own.
COLUMN_TAGS = ["name", "highway", "oneway", "surface", "maxspeed", "lanes"]

# Line colors and widths of the road map.
CLASS_COLOR = {
    "motorway": "#ff0000", "trunk": "#ff6600", "primary": "#ffaa00",
    "secondary": "#aaff00", "tertiary": "#00aaff",
}
PRIMARY_BRIDGE_COLOR = "#ffcc00"
ABOVE_GROUND_COLOR = "#aa00ff"
BELOW_GROUND_COLOR = "#006600"
OTHER_COLOR = "#aaaaaa"
CLASS_WEIGHT = {"motorway": 5, "trunk": 4, "primary": 4, "secondary": 3, "tertiary": 3}
OTHER_WEIGHT = 2


def lookup(table: dict, key: Column) -> Column:
    """Constant map lookup, NULL when missing; folded into the plan, no join."""
    entries = [F.lit(v) for pair in table.items() for v in pair]
    return F.try_element_at(F.create_map(*entries), key)


def type_factor(highway: Column) -> Column:
    return F.coalesce(lookup(TYPE_FACTOR, highway), F.lit(TYPE_FACTOR_DEFAULT))


def class_score(highway: Column) -> Column:
    return F.coalesce(lookup(CLASS_SCORE, highway), F.lit(CLASS_SCORE_DEFAULT))


def types_compatible(a: Column, b: Column) -> Column:
    """Same class, or class groups at most two ranks apart; unknown classes never match."""
    steps = F.abs(lookup(CLASS_GROUP, a) - lookup(CLASS_GROUP, b))
    return (a == b) | F.coalesce(steps <= MAX_GROUP_STEPS, F.lit(False))


def static_cost(from_way: Column, to_way: Column, to_highway: Column) -> Column:
    """Cost of moving onto a road: class factor, ten percent off on the same way, plus one."""
    stay = F.when(from_way == to_way, F.lit(0.9)).otherwise(F.lit(1.0))
    return type_factor(to_highway) * stay + 1.0


def move_cost(
    leg_m: Column,
    static: Column,
    near_points: Column,
    is_private: Column,
    near_factor: float = 0.1,
    private_factor: float = 9000.0,
) -> Column:
    """Cost of one move: distance along the road left, times the static cost of the road
    entered, cheaper for each trip point close to it, prohibitive when it is private."""
    travelled = F.greatest(leg_m / 500.0, F.lit(0.1)) + 1.0
    bonus = F.pow(F.lit(near_factor), near_points.cast("double"))
    barrier = F.when(is_private, F.lit(private_factor)).otherwise(F.lit(1.0))
    return travelled * static * bonus * barrier


def tag_layer(tags: Column) -> Column:
    return F.coalesce(F.try_element_at(tags, F.lit("layer")).try_cast("tinyint"), F.lit(0)).cast("int")


def tag_yes(tags: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(tags, F.lit(name)) == "yes", F.lit(False))


def tag_private(tags: Column) -> Column:
    return F.coalesce(F.try_element_at(tags, F.lit("access")) == "private", F.lit(False))


def is_oneway(tags: Column) -> Column:
    oneway = F.try_element_at(tags, F.lit("oneway"))
    highway = F.try_element_at(tags, F.lit("highway"))
    return F.coalesce(oneway.isin("yes", "1"), F.lit(False)) | F.coalesce(
        highway == "motorway", F.lit(False)
    )


def extra_tags(tags: Column) -> Column:
    return F.map_filter(tags, lambda k, v: ~k.isin(*COLUMN_TAGS))


def line_color(highway: Column, layer: Column, is_bridge: Column) -> Column:
    return (
        F.when((highway == "primary") & is_bridge, PRIMARY_BRIDGE_COLOR)
        .when(lookup(CLASS_COLOR, highway).isNotNull(), lookup(CLASS_COLOR, highway))
        .when(layer > 0, ABOVE_GROUND_COLOR)
        .when(layer < 0, BELOW_GROUND_COLOR)
        .otherwise(OTHER_COLOR)
    )


def line_weight(highway: Column) -> Column:
    return F.coalesce(lookup(CLASS_WEIGHT, highway), F.lit(OTHER_WEIGHT))


def connection_verdict(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """May two segments connect, and do they? ``struct<compatible, connects, reason>``.

    ``a`` and ``b`` hold the columns id, layer, bridge, tunnel, highway, nodes and the four
    end coordinates; ``b['intersects']`` says whether the lines meet. The reason is a code with the values that decide, in
    the order of the two segments: ``layer 0|1``, ``bridge true|false``, ``tunnel true|false``, ``class primary|service``,
    ``node 5,7 at ends`` or ``node 5,7 inside``, ``gap start-end 0.42`` (meters, two decimals), ``crossing``, ``apart``.
    """
    from wayloom.functions.geo import haversine

    def verdict(may: bool, does: bool, code: str, *values: Column) -> Column:
        reason = F.concat_ws(" ", F.lit(code), *values)
        return F.struct(F.lit(may).alias("compatible"), F.lit(does).alias("connects"), reason.alias("reason"))

    def both(name: str) -> Column:
        return F.concat_ws("|", a[name].cast("string"), b[name].cast("string"))

    common = F.array_intersect(a["nodes"], b["nodes"])

    def meets_end(side: dict[str, Column]) -> Column:
        return F.arrays_overlap(common, F.array(F.element_at(side["nodes"], 1), F.element_at(side["nodes"], -1)))

    nodes = F.array_join(common.cast("array<string>"), ",")
    where = F.when(meets_end(a) & meets_end(b), "at ends").otherwise("inside")
    out = F.when(~types_compatible(a["highway"], b["highway"]), verdict(False, False, "class", both("highway")))
    out = out.when(F.size(common) > 0, verdict(True, True, "node", nodes, where))
    words = {"first": "start", "last": "end"}
    for p, q in (("first", "first"), ("first", "last"), ("last", "first"), ("last", "last")):
        gap = haversine(a[f"{p}_y"], a[f"{p}_x"], b[f"{q}_y"], b[f"{q}_x"])
        out = out.when(gap < 1.0, verdict(True, True, f"gap {words[p]}-{words[q]}", F.format_string("%.2f", gap)))
    out = out.when(b["intersects"], verdict(True, True, "crossing")).otherwise(verdict(True, False, "apart"))
    for name in ("tunnel", "bridge", "layer"):
        out = F.when(a[name] != b[name], verdict(False, False, name, both(name))).otherwise(out)
    return out


def connection_node(nodes_a: Column, nodes_b: Column, a_to_b: Column, b_to_a: Column) -> Column:
    """Node joining two segments: an end of both, then an end of one, then any shared node,
    then the declared connection's end."""
    shared = F.array_intersect(nodes_a, nodes_b)

    def is_end(n, nodes):
        return (n == F.element_at(nodes, 1)) | (n == F.element_at(nodes, -1))

    both = F.filter(shared, lambda n: is_end(n, nodes_a) & is_end(n, nodes_b))
    one = F.filter(shared, lambda n: is_end(n, nodes_a) | is_end(n, nodes_b))
    return F.coalesce(
        F.get(both, F.lit(0)),
        F.get(one, F.lit(0)),
        F.get(shared, F.lit(0)),
        F.when(a_to_b, F.element_at(nodes_a, -1)),
        F.when(b_to_a, F.element_at(nodes_b, 1)),
    )


def contains_run(chosen: Column, expected: Column) -> Column:
    """Is ``expected`` a contiguous part of ``chosen``? False when either is empty or
    ``expected`` is the longer one."""
    last_start = F.size(chosen) - F.size(expected)
    starts = F.sequence(F.lit(0), F.greatest(last_start, F.lit(0)))
    hit = F.exists(starts, lambda i: F.slice(chosen, i + 1, F.size(expected)) == expected)
    return (F.size(expected) > 0) & (F.size(chosen) > 0) & (last_start >= 0) & hit
