"""Adaptive grid tiles of the network."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayloom.config import TILES, TileConfig
from wayloom.functions import geo
from wayloom.operators.network import declared_edges


def assign_tiles(segs: DataFrame, cfg: TileConfig = TILES) -> DataFrame:
    """Tile of every segment: depth, tile_x, tile_y.

    Per depth a tile keeps its first ``density`` segments by id; the rest moves to tiles of half
    the size, and all that is left stays at the last depth. A tile's first rows are found by a
    rank filter, which Spark applies before the shuffle, so a full tile never meets in one task;
    the others are told apart by comparing with the last id kept.
    """
    centre = geo.ends_midpoint(F.col("coordinates"))
    rest = segs.select("segment_id", centre.alias("c")).select(
        "segment_id", F.col("c.x").alias("cx"), F.col("c.y").alias("cy")
    )
    placed = []
    for depth in range(cfg.max_depth + 1):
        size = cfg.base_size_deg / 2**depth
        here = rest.select(
            "segment_id", "cx", "cy",
            geo.tile_index(F.col("cx"), F.lit(size)).alias("tile_x"),
            geo.tile_index(F.col("cy"), F.lit(size)).alias("tile_y"),
        )
        if depth == cfg.max_depth:
            placed.append(here.withColumn("depth", F.lit(depth)))
            break
        rank = F.row_number().over(Window.partitionBy("tile_x", "tile_y").orderBy("segment_id"))
        limits = (
            here.select("tile_x", "tile_y", "segment_id")
            .withColumn("rn", rank)
            .filter(F.col("rn") <= cfg.density)
            .groupBy("tile_x", "tile_y")
            .agg(F.max("segment_id").alias("last_kept"))
        )
        marked = here.join(limits, ["tile_x", "tile_y"])
        placed.append(
            marked.filter(F.col("segment_id") <= F.col("last_kept")).drop("last_kept").withColumn("depth", F.lit(depth))
        )
        rest = marked.filter(F.col("segment_id") > F.col("last_kept")).select("segment_id", "cx", "cy")
    return reduce(DataFrame.unionByName, placed).select("segment_id", "depth", "tile_x", "tile_y")


def tile_density(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("depth", "tile_x", "tile_y").agg(F.count(F.lit(1)).alias("n_segments"))


def tiles_of_box(min_x: Column, min_y: Column, max_x: Column, max_y: Column, cfg: TileConfig = TILES) -> Column:
    """All tiles of all depths meeting a box: ``array<struct<depth, tile_x, tile_y>>``."""

    def at_depth(depth: int) -> Column:
        size = F.lit(cfg.base_size_deg / 2**depth)
        xs = F.sequence(geo.tile_index(min_x, size), geo.tile_index(max_x, size))
        ys = F.sequence(geo.tile_index(min_y, size), geo.tile_index(max_y, size))

        def tile(x: Column, y: Column) -> Column:
            return F.struct(F.lit(depth).alias("depth"), x.alias("tile_x"), y.alias("tile_y"))

        return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: tile(x, y))))

    return F.concat(*[at_depth(d) for d in range(cfg.max_depth + 1)])


def tiles_for_boxes(boxes: DataFrame, key: str, tiles: DataFrame, buffer_deg: float = 0.0, cfg: TileConfig = TILES) -> DataFrame:
    """Segments in the tiles of many boxes at once (min_lon, min_lat, max_lon, max_lat)."""
    b = F.lit(buffer_deg)
    cells = tiles_of_box(
        F.col("min_lon") - b, F.col("min_lat") - b, F.col("max_lon") + b, F.col("max_lat") + b, cfg
    )
    wanted = boxes.select(key, F.explode(cells).alias("w")).select(key, "w.*")
    return wanted.join(tiles, ["depth", "tile_x", "tile_y"])


def tile_graph_edges(edges: DataFrame, tiles: DataFrame) -> DataFrame:
    """Edges whose two segments lie in one tile, with that tile."""
    s = tiles.select(F.col("segment_id").alias("src"), "depth", "tile_x", "tile_y")
    o = tiles.select(F.col("segment_id").alias("dst"), "depth", "tile_x", "tile_y")
    return edges.join(s, "src").join(o, ["dst", "depth", "tile_x", "tile_y"])


def cross_tile_edges(segs: DataFrame, conns: DataFrame, edges: DataFrame, tiles: DataFrame) -> DataFrame:
    """Edges of declared connections that no tile holds, because their segments lie apart."""
    local = tile_graph_edges(edges, tiles).select("src", "dst")
    return declared_edges(segs, conns.join(local, ["src", "dst"], "left_anti")).join(
        local, ["src", "dst"], "left_anti"
    )


def merge_tile_rows(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows read from several tiles as one network, each key once."""
    return rows.dropDuplicates(key)
