"""Road network: segments, connections, edges, tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayloom.config import TileConfig
from wayloom.functions import geo, roads
from wayloom.operators import network, tiles, trips
from wayloom.plans.oracle import hav, with_ctes
from wayloom.plans.registry import query
from wayloom.session import materialize, table_path
from wayloom.sources import tiled

# Small tiles, so that the adaptive rule has work to do on the given lattice.
TILE = TileConfig(base_size_deg=0.04, density=40, max_depth=2)
TILE_BUFFER = 0.005


@query(
    "way_segments",
    with_ctes(
        """SELECT segment_id, way_id, highway, is_oneway, layer, is_bridge, name, n_nodes, nodes[1] AS first_node, nodes[n_nodes] AS last_node,
 array_to_string(nodes, ',') AS node_text FROM seg"""
    ),
)
def way_segments(i):
    """Ways with ordered nodes as numbered segments."""
    return i.segments().select(
        "segment_id", "way_id", "highway", "is_oneway", "layer", "is_bridge", "name",
        F.size("nodes").cast("long").alias("n_nodes"),
        F.element_at("nodes", 1).alias("first_node"), F.element_at("nodes", -1).alias("last_node"),
        F.array_join(F.col("nodes").cast("array<string>"), ",").alias("node_text"),
    )


@query(
    "way_lines_big",
    with_ctes(
        """SELECT way_id, count(*) AS n_nodes, arg_min(node_id, sq) AS first_node, arg_max(node_id, sq) AS last_node, round(sum(lat),6) AS lat_sum
FROM (SELECT b.*, n.lat FROM (SELECT l_orderkey AS way_id, l_partkey AS node_id,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY min(l_linenumber), l_partkey)-1 AS sq
FROM lineitem GROUP BY l_orderkey, l_partkey) b JOIN nodes n USING (node_id)) w GROUP BY way_id HAVING count(*)>1"""
    ),
)
def way_lines_big(i):
    """J5 at the size of the largest table: orders as ways over parts as nodes."""
    lines = network.way_lines(i.way_nodes_big(), i.nodes())
    return lines.select(
        "way_id",
        F.size("nodes").cast("long").alias("n_nodes"),
        F.element_at("nodes", 1).alias("first_node"),
        F.element_at("nodes", -1).alias("last_node"),
        F.round(F.aggregate("coordinates", F.lit(0.0), lambda acc, c: acc + c.y), 6).alias("lat_sum"),
    )


@query(
    "highway_filter",
    with_ctes("SELECT highway, is_oneway, count(*) AS n_ways FROM road_ways GROUP BY 1,2"),
)
def highway_filter(i):
    """P4, P5 from tags: the tag form of the ways goes through the road-way scan."""
    from wayloom.sources import osm

    tags = F.create_map(
        F.lit("highway"), F.col("highway"), F.lit("oneway"), F.when(F.col("way_id") % 5 == 0, "yes").when(F.col("is_oneway"), "1").otherwise("no"),
    )
    raw = i.ways().select(F.col("way_id").alias("id"), F.array(F.col("way_id"), F.col("way_id") + 1).alias("refs"), tags.alias("tags"))
    return osm.road_ways(raw).groupBy("highway", "is_oneway").agg(F.count(F.lit(1)).alias("n_ways"))


@query(
    "way_tags",
    with_ctes(
        """SELECT way_id, CASE WHEN way_id%3=0 THEN CAST(way_id%5 AS INTEGER)-2 ELSE 0 END AS layer, way_id%50=1 AS is_bridge, way_id%4=0 AS is_private,
 CASE WHEN way_id%50=1 THEN 'access,bridge,layer' ELSE 'access,layer' END AS extra FROM ways"""
    ),
)
def way_tags(i):
    """Attributes read from tags, and the tags without a column of their own."""
    w = F.col("way_id")
    tags = F.map_concat(
        F.create_map(
            F.lit("highway"), F.col("highway"), F.lit("name"), F.col("name"),
            F.lit("layer"), F.when(w % 3 == 0, ((w % 5) - 2).cast("string")).otherwise("ground"),
            F.lit("access"), F.when(w % 4 == 0, "private").otherwise("yes"),
        ),
        F.when(F.col("is_bridge"), F.create_map(F.lit("bridge"), F.lit("yes"))).otherwise(F.create_map().cast("map<string,string>")),
    )
    t = i.ways().select("way_id", tags.alias("tags"))
    return t.select(
        "way_id",
        roads.tag_layer(F.col("tags")).alias("layer"),
        roads.tag_yes(F.col("tags"), "bridge").alias("is_bridge"),
        roads.tag_private(F.col("tags")).alias("is_private"),
        F.array_join(F.array_sort(F.map_keys(roads.extra_tags(F.col("tags")))), ",").alias("extra"),
    )


@query(
    "segment_length",
    with_ctes(f"SELECT segment_id, round(sum({hav('ay', 'ax', 'by_', 'bx')}),4) AS length_m FROM pc GROUP BY 1"),
)
def segment_length(i):
    """Length of each segment."""
    return i.segments().select("segment_id", F.round(geo.polyline_length(F.col("coordinates")), 4).alias("length_m"))


@query(
    "segment_centroid",
    with_ctes(
        """SELECT segment_id, round((xs[1]+xs[n_nodes])/2,9) AS mid_x, round((ys[1]+ys[n_nodes])/2,9) AS mid_y, round(list_avg(xs),9) AS mean_x, round(list_avg(ys),9) AS mean_y FROM seg"""
    ),
)
def segment_centroid(i):
    """Midpoint of the ends and mean of the vertices."""
    c = F.col("coordinates")
    return i.segments().select("segment_id", geo.ends_midpoint(c).alias("m"), geo.vertex_mean(c).alias("v")).select(
        "segment_id", F.round("m.x", 9).alias("mid_x"), F.round("m.y", 9).alias("mid_y"),
        F.round("v.x", 9).alias("mean_x"), F.round("v.y", 9).alias("mean_y"),
    )


@query(
    "segment_bbox",
    with_ctes(
        """SELECT segment_id, round(list_min(xs)-2*20/111000e0,9) AS min_x, round(list_min(ys)-2*20/111000e0,9) AS min_y, round(list_max(xs)+2*20/111000e0,9) AS max_x, round(list_max(ys)+2*20/111000e0,9) AS max_y FROM seg"""
    ),
)
def segment_bbox(i):
    """F8: box of each segment grown by twice the matching radius."""
    return i.segments().select("segment_id", geo.bbox(F.col("coordinates")).alias("b")).select(
        "segment_id", geo.grow_bbox(F.col("b"), 20.0).alias("b")
    ).select("segment_id", *[F.round(f"b.{c}", 9).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")])


@query(
    "segment_heading",
    with_ctes(
        f"""SELECT segment_id, round(degrees(atan2(by_-ay,bx-ax)),6) AS heading_deg FROM (
 SELECT p.*, row_number() OVER (PARTITION BY p.segment_id ORDER BY round({hav("m.my", "m.mx", "ay", "ax")},6), piece) AS rn
 FROM pc p JOIN (SELECT segment_id, (xs[1]+xs[n_nodes])/2 AS mx, (ys[1]+ys[n_nodes])/2 AS my FROM seg) m USING (segment_id)) r WHERE rn=1"""
    ),
)
def segment_heading(i):
    """heading at the segment's midpoint."""
    c = F.col("coordinates")
    mid = i.segments().select("segment_id", "coordinates", geo.ends_midpoint(c).alias("m"))
    return mid.select("segment_id", F.round(geo.heading_at(F.col("m.x"), F.col("m.y"), c), 6).alias("heading_deg"))


@query("shared_nodes", with_ctes("SELECT a_id, b_id, count(*) AS n_shared, bool_or(at_end) AS at_end FROM pairs GROUP BY 1,2"))
def shared_nodes(i):
    """Nodes shared by two segments of one level."""
    return (
        network.sharing_pairs(i.segment_nodes())
        .groupBy("a_id", "b_id")
        .agg(F.count(F.lit(1)).alias("n_shared"), F.max(F.col("a_is_end") | F.col("b_is_end")).alias("at_end"))
    )


@query("connections", with_ctes("SELECT src, dst FROM conn"))
def connections(i):
    """Connections by shared node with the direction rules."""
    return i.base_connections()


@query("connections_enhanced", with_ctes("SELECT src, dst FROM allconn"))
def connections_enhanced(i):
    """With the connections added by further evidence."""
    return i.connections()


@query(
    "connection_lists",
    with_ctes("SELECT src, array_to_string(list(DISTINCT dst ORDER BY dst), ',') AS connections FROM allconn GROUP BY 1"),
)
def connection_lists(i):
    """Sorted connection list of each segment."""
    lists = network.connection_lists(i.connections())
    return lists.select("src", F.array_join(F.col("connections").cast("array<string>"), ",").alias("connections"))


@query("graph_edges", with_ctes("SELECT src, dst, round(cost,6) AS cost FROM edges"))
def graph_edges(i):
    """Directed edges with static cost."""
    return i.edges().select("src", "dst", F.round("cost", 6).alias("cost"))


@query(
    "graph_transitions",
    with_ctes(
        """SELECT e.src, s.idx AS exit_idx, e.dst, o.idx AS entry_idx, round(f.f*CASE WHEN s.way_id=o.way_id THEN 0.9e0 ELSE 1.0e0 END+1.0e0,6) AS static_cost
FROM edges e JOIN (SELECT DISTINCT src, dst FROM allconn) c ON c.src=e.src AND c.dst=e.dst JOIN sn s ON s.segment_id=e.src JOIN sn o ON o.segment_id=e.dst AND o.node_id=s.node_id
 JOIN fac f ON f.highway=o.highway WHERE NOT (o.is_oneway AND o.idx=o.last_idx)"""
    ),
)
def graph_transitions(i):
    """Every move from one segment to the next, by common node."""
    return i.transitions().select(
        "src", F.col("exit_idx").cast("long").alias("exit_idx"), "dst", F.col("entry_idx").cast("long").alias("entry_idx"),
        F.round("static_cost", 6).alias("static_cost"),
    )


@query(
    "in_out_degree",
    with_ctes(
        """SELECT s.segment_id, s.layer, (SELECT count(*) FROM allconn c WHERE c.src=s.segment_id) AS n_out, (SELECT count(*) FROM allconn c WHERE c.dst=s.segment_id) AS n_in FROM seg s"""
    ),
)
def in_out_degree(i):
    """Outgoing and incoming connections."""
    segs = i.segments()
    return network.in_out_degree(segs.select("segment_id", "layer"), i.connections()).select(
        "segment_id", "layer", F.col("n_out").cast("long").alias("n_out"), F.col("n_in").cast("long").alias("n_in")
    )


@query("layer_groups", with_ctes("SELECT layer, count(*) AS n_segments, CAST(sum(n_nodes) AS BIGINT) AS n_nodes FROM seg GROUP BY 1"))
def layer_groups(i):
    """Segments per layer."""
    return i.segments().groupBy("layer").agg(F.count(F.lit(1)).alias("n_segments"), F.sum(F.size("nodes")).alias("n_nodes"))


MEET = """(greatest(p.ax,p.bx)>=least(q.ax,q.bx) AND greatest(q.ax,q.bx)>=least(p.ax,p.bx) AND greatest(p.ay,p.by_)>=least(q.ay,q.by_) AND greatest(q.ay,q.by_)>=least(p.ay,p.by_)
 AND sign((p.bx-p.ax)*(q.ay-p.ay)-(p.by_-p.ay)*(q.ax-p.ax))*sign((p.bx-p.ax)*(q.by_-p.ay)-(p.by_-p.ay)*(q.bx-p.ax))<=0
 AND sign((q.bx-q.ax)*(p.ay-q.ay)-(q.by_-q.ay)*(p.ax-q.ax))*sign((q.bx-q.ax)*(p.by_-q.ay)-(q.by_-q.ay)*(p.bx-q.ax))<=0)"""


@query(
    "line_intersections",
    with_ctes(f"SELECT DISTINCT p.segment_id AS a_id, q.segment_id AS b_id FROM pc p JOIN pc q ON p.segment_id<q.segment_id AND {MEET}"),
)
def line_intersections(i):
    """Segments whose lines meet."""
    return network.line_intersections(i.segments())


@query(
    "endpoint_near",
    with_ctes(
        f"""SELECT a.segment_id AS a_id, b.segment_id AS b_id, round(min({hav("a.y", "a.x", "b.y", "b.x")}),4) AS distance_m FROM ends a JOIN ends b ON a.segment_id<b.segment_id
 AND abs(a.y-b.y)<0.0001 AND abs(a.x-b.x)<0.0001 WHERE {hav("a.y", "a.x", "b.y", "b.x")}<1 GROUP BY 1,2""",
        {"ends": "SELECT segment_id, xs[1] AS x, ys[1] AS y FROM seg UNION ALL SELECT segment_id, xs[n_nodes], ys[n_nodes] FROM seg"},
    ),
)
def endpoint_near(i):
    """Segments with ends less than a meter apart."""
    return network.endpoint_near(i.segments()).select("a_id", "b_id", F.round("distance_m", 4).alias("distance_m"))


@query(
    "connectivity_verdict",
    with_ctes(
        f"""SELECT x.a_id, x.b_id, CASE WHEN a.layer<>b.layer THEN concat('layer ', a.layer, '|', b.layer) WHEN a.is_bridge<>b.is_bridge THEN concat('bridge ', a.is_bridge, '|', b.is_bridge)
 WHEN abs(ga.g-gb.g)>2 THEN concat('class ', a.highway, '|', b.highway)
 WHEN len(list_intersect(a.nodes,b.nodes))>0 THEN concat('node ', array_to_string(list_filter(a.nodes, lambda n: list_contains(b.nodes,n)), ','), CASE WHEN
  len(list_filter(a.nodes, lambda n: list_contains(b.nodes,n) AND (n=a.nodes[1] OR n=a.nodes[-1])))>0 AND len(list_filter(a.nodes, lambda n: list_contains(b.nodes,n) AND (n=b.nodes[1] OR n=b.nodes[-1])))>0
  THEN ' at ends' ELSE ' inside' END)
 ELSE 'crossing' END AS reason, a.layer=b.layer AND a.is_bridge=b.is_bridge AND abs(ga.g-gb.g)<=2 AS compatible,
 a.layer=b.layer AND a.is_bridge=b.is_bridge AND abs(ga.g-gb.g)<=2 AS connects
FROM ints x JOIN seg a ON a.segment_id=x.a_id JOIN seg b ON b.segment_id=x.b_id JOIN grp ga ON ga.highway=a.highway JOIN grp gb ON gb.highway=b.highway""",
        {"ints": f"SELECT DISTINCT p.segment_id AS a_id, q.segment_id AS b_id FROM pc p JOIN pc q ON p.segment_id<q.segment_id AND {MEET}"},
    ),
)
def connectivity_verdict(i):
    """verdict and reason for all pairs whose lines meet."""
    segs = i.segments()
    return network.connectivity_verdicts(network.line_intersections(segs), segs).select("a_id", "b_id", "reason", "compatible", "connects")


TILE_SQL = {
    "t0": "SELECT segment_id, (xs[1]+xs[n_nodes])/2 AS cx, (ys[1]+ys[n_nodes])/2 AS cy FROM seg",
    "d0": "SELECT *, CAST(floor(cx/0.04e0) AS BIGINT) AS tx, CAST(floor(cy/0.04e0) AS BIGINT) AS ty, row_number() OVER (PARTITION BY floor(cx/0.04e0), floor(cy/0.04e0) ORDER BY segment_id) AS rn FROM t0",
    "d1": "SELECT segment_id, cx, cy, CAST(floor(cx/0.02e0) AS BIGINT) AS tx, CAST(floor(cy/0.02e0) AS BIGINT) AS ty, row_number() OVER (PARTITION BY floor(cx/0.02e0), floor(cy/0.02e0) ORDER BY segment_id) AS rn FROM d0 WHERE rn>40",
    "tiles": """SELECT segment_id, 0 AS depth, tx AS tile_x, ty AS tile_y FROM d0 WHERE rn<=40
 UNION ALL SELECT segment_id, 1, tx, ty FROM d1 WHERE rn<=40
 UNION ALL SELECT segment_id, 2, CAST(floor(cx/0.01e0) AS BIGINT), CAST(floor(cy/0.01e0) AS BIGINT) FROM d1 WHERE rn>40""",
}


@query("tile_assign", with_ctes("SELECT segment_id, depth, tile_x, tile_y FROM tiles", TILE_SQL))
def tile_assign(i):
    """Adaptive tiles."""
    return tiles.assign_tiles(i.segments(), TILE)


@query("tile_density", with_ctes("SELECT depth, tile_x, tile_y, count(*) AS n_segments FROM tiles GROUP BY 1,2,3", TILE_SQL))
def tile_density(i):
    """Segments per tile."""
    return tiles.tile_density(tiles.assign_tiles(i.segments(), TILE))


@query(
    "tile_bbox",
    with_ctes(
        """SELECT segment_id, concat(CAST(floor(mx/0.02e0) AS BIGINT),'_',CAST(floor(my/0.02e0) AS BIGINT),'_1') AS tile,
 round(floor(mx/0.02e0)*0.02e0,6) AS min_x, round(floor(my/0.02e0)*0.02e0,6) AS min_y, round((floor(mx/0.02e0)+1)*0.02e0,6) AS max_x, round((floor(my/0.02e0)+1)*0.02e0,6) AS max_y
FROM (SELECT segment_id, (xs[1]+xs[n_nodes])/2 AS mx, (ys[1]+ys[n_nodes])/2 AS my FROM seg) s"""
    ),
)
def tile_bbox(i):
    """tile id of each segment at depth 1, and the tile's box."""
    mid = i.segments().select("segment_id", geo.ends_midpoint(F.col("coordinates")).alias("m"))
    named = mid.select("segment_id", geo.tile_id(F.col("m.x"), F.col("m.y"), TILE.base_size_deg, F.lit(1)).alias("tile"))
    return named.select("segment_id", "tile", geo.tile_bbox(F.col("tile"), TILE.base_size_deg).alias("b")).select(
        "segment_id", "tile", *[F.round(f"b.{c}", 6).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")]
    )


@query(
    "tile_range_scan",
    with_ctes(
        """SELECT tr.trip_id, s.depth, count(*) AS n_segments FROM trips_id tr JOIN (SELECT *, 0.04e0/pow(2e0,depth) AS sz FROM tiles) s
 ON s.tile_x BETWEEN floor((tr.min_lon-0.005e0)/s.sz) AND floor((tr.max_lon+0.005e0)/s.sz) AND s.tile_y BETWEEN floor((tr.min_lat-0.005e0)/s.sz) AND floor((tr.max_lat+0.005e0)/s.sz)
GROUP BY 1,2""",
        TILE_SQL,
    ),
)
def tile_range_scan(i):
    """Segments in the tiles around each trip's box, all depths."""
    boxes = trips.trips(trips.trip_points(i.pings()))
    placed = tiles.assign_tiles(i.segments(), TILE)
    found = tiles.tiles_for_boxes(boxes, "trip_id", placed, TILE_BUFFER, TILE)
    return found.groupBy("trip_id", "depth").agg(F.count(F.lit(1)).alias("n_segments"))


@query(
    "cross_tile_edges",
    with_ctes(
        """SELECT src, dst, round(min(cost),6) AS cost FROM (
 SELECT src, dst, cost FROM metx WHERE NOT (bo AND j=lj) UNION ALL SELECT dst, src, cost FROM metx WHERE NOT (bo AND i=li)) u
WHERE NOT EXISTS (SELECT 1 FROM loc_e l WHERE l.src=u.src AND l.dst=u.dst) GROUP BY src, dst""",
        {
            **TILE_SQL,
            "loc_e": "SELECT e.src, e.dst FROM edges e JOIN tiles a ON a.segment_id=e.src JOIN tiles b ON b.segment_id=e.dst AND a.depth=b.depth AND a.tile_x=b.tile_x AND a.tile_y=b.tile_y",
            "metx": "SELECT m.* FROM met m WHERE NOT EXISTS (SELECT 1 FROM loc_e l WHERE l.src=m.src AND l.dst=m.dst)",
        },
    ),
)
def cross_tile_edges(i):
    """Edges between tiles that no tile holds."""
    placed = i._stored("tiles", lambda: tiles.assign_tiles(i.segments(), TILE))
    return tiles.cross_tile_edges(i.segments(), i.connections(), i.edges(), placed).select("src", "dst", F.round("cost", 6).alias("cost"))


@query("merged_tiles", with_ctes("SELECT highway, count(*) AS n_segments FROM seg GROUP BY 1"))
def merged_tiles(i):
    """Tiles read from their folders at two times, some of them twice, as one network."""
    folder = tiled_network(i)
    index = i.spark.read.parquet(f"{folder}/index")
    first, second = index.filter("(tile_x + tile_y) % 3 <> 0"), index.filter("(tile_x + tile_y) % 3 <> 1")
    rows = [tiled.read_boxes(i.spark, folder, "segments", part) for part in (first, second)]
    return tiles.merge_tile_rows(rows[0].unionByName(rows[1]), ["segment_id"]).groupBy("highway").agg(F.count(F.lit(1)).alias("n_segments"))


def tiled_network(i) -> str:
    """Folder of the network by tiles, written once."""
    folder = table_path(i.spark, i.sf_dir, "tiled_network")
    if not tiled.is_complete(i.spark, folder):
        placed = i._stored("tiles", lambda: tiles.assign_tiles(i.segments(), TILE))
        tiled.write_network(i.segments(), i.edges(), placed, folder)
    return folder


@query(
    "network_tiles",
    with_ctes(
        """SELECT w.trip_id, w.depth, w.n_tiles, coalesce(s.n,0) AS n_segments, coalesce(e.n,0) AS n_edges FROM
 (SELECT trip_id, depth, count(*) AS n_tiles FROM want GROUP BY 1,2) w
 LEFT JOIN (SELECT trip_id, depth, count(*) AS n FROM want JOIN tiles USING (depth, tile_x, tile_y) GROUP BY 1,2) s USING (trip_id, depth)
 LEFT JOIN (SELECT trip_id, depth, count(*) AS n FROM want JOIN tile_edges USING (depth, tile_x, tile_y) GROUP BY 1,2) e USING (trip_id, depth)""",
        {
            **TILE_SQL,
            "tile_edges": "SELECT e.src, e.dst, a.depth, a.tile_x, a.tile_y FROM edges e JOIN tiles a ON a.segment_id=e.src JOIN tiles b ON b.segment_id=e.dst AND a.depth=b.depth AND a.tile_x=b.tile_x AND a.tile_y=b.tile_y",
            "want": """SELECT tr.trip_id, s.depth, s.tile_x, s.tile_y FROM trips_id tr JOIN (SELECT DISTINCT depth, tile_x, tile_y, 0.04e0/pow(2e0,depth) AS sz FROM tiles) s
 ON s.tile_x BETWEEN floor((tr.min_lon-0.005e0)/s.sz) AND floor((tr.max_lon+0.005e0)/s.sz) AND s.tile_y BETWEEN floor((tr.min_lat-0.005e0)/s.sz) AND floor((tr.max_lat+0.005e0)/s.sz)""",
        },
    ),
)
def network_tiles(i):
    """S6, S7, Q-6: the network written by tiles and read back around every trip's box."""
    folder = tiled_network(i)
    boxes = trips.trips(trips.trip_points(i.pings()))
    index = i.spark.read.parquet(f"{folder}/index")
    wanted = materialize(tiled.wanted_tiles(boxes, "trip_id", index, TILE, TILE_BUFFER), "wanted")

    def per_tile(table: str, name: str):
        return tiled.read_boxes(i.spark, folder, table, wanted).groupBy(*tiled.TILE).agg(F.count(F.lit(1)).alias(name))

    counted = wanted.join(per_tile("segments", "s"), tiled.TILE, "left").join(per_tile("edges", "e"), tiled.TILE, "left")
    zero = F.lit(0).cast("long")
    return counted.groupBy("trip_id", "depth").agg(
        F.count(F.lit(1)).alias("n_tiles"), F.coalesce(F.sum("s"), zero).alias("n_segments"), F.coalesce(F.sum("e"), zero).alias("n_edges")
    )
