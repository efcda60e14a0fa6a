"""A road network in tile folders: segments and the edges within each tile, read back around many boxes at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayloom.config import TILES, TileConfig
from wayloom.functions import geo
from wayloom.operators.tiles import tile_density, tile_graph_edges
from wayloom.session import file_names
from wayloom.sources.sinks import with_blocks, write_tiles

TILE = ["depth", "tile_x", "tile_y"]
#: Up to so many wanted tiles (40 bytes each) are sent to all tasks, which then list and read only their folders.
BROADCAST_TILES = 1_000_000


def write_network(segs: DataFrame, edges: DataFrame, placed: DataFrame, folder: str) -> None:
    """Tables ``segments`` and ``edges`` with a folder per block of tiles, and ``index``, the tiles with their numbers of
    segments. The index is written last: a network without one is not complete and is written again.

    An edge belongs to the tile that holds both its segments; edges across tiles are in no folder
    (:func:`wayloom.operators.tiles.cross_tile_edges`).
    """
    write_tiles(segs.join(placed, "segment_id"), f"{folder}/segments")
    write_tiles(tile_graph_edges(edges, placed), f"{folder}/edges")
    tile_density(placed).write.mode("overwrite").parquet(f"{folder}/index")


def is_complete(spark: SparkSession, folder: str) -> bool:
    return bool(file_names(spark, f"{folder}/index/_SUCCESS"))


def wanted_tiles(boxes: DataFrame, key: str, index: DataFrame, cfg: TileConfig = TILES, buffer_deg: float = 0.0) -> DataFrame:
    """(key, depth, tile_x, tile_y): existing tiles of all depths that meet the buffered boxes (min_lon, min_lat, max_lon,
    max_lat). Columns and rows of a box become rows one after the other, so no row holds all tiles of a large box."""

    def span(low: str, high: str, size: float) -> Column:
        b, s = F.lit(buffer_deg), F.lit(size)
        return F.explode(F.sequence(geo.tile_index(F.col(low) - b, s), geo.tile_index(F.col(high) + b, s)))

    out = None
    for depth in range(cfg.max_depth + 1):
        size = cfg.base_size_deg / 2**depth
        there = index.filter((F.col("depth") == depth) & (F.col("n_segments") > 0)).select("tile_x", "tile_y")
        columns = there.select("tile_x").distinct()
        x = boxes.select(key, "min_lat", "max_lat", span("min_lon", "max_lon", size).alias("tile_x")).join(columns, "tile_x", "left_semi")
        xy = x.select(key, "tile_x", span("min_lat", "max_lat", size).alias("tile_y")).join(there, ["tile_x", "tile_y"], "left_semi")
        part = xy.select(key, F.lit(depth).alias("depth"), "tile_x", "tile_y")
        out = part if out is None else out.unionByName(part)
    return out


def read_boxes(spark: SparkSession, folder: str, table: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``segments`` or ``edges`` in the wanted tiles (a written table), each tile read once however many boxes want it.

    Folders are pruned while the query runs, by the blocks of the wanted tiles.
    """
    stored = spark.read.parquet(f"{folder}/{table}")
    kinds = {"depth": T.IntegerType(), "tile_x": T.LongType(), "tile_y": T.LongType()}
    tiles = with_blocks(wanted.filter("depth >= 0").select(*TILE).distinct())
    tiles = tiles.select(*[F.col(c).cast(stored.schema[c].dataType).alias(c) for c in tiles.columns])
    if tiles.count() <= BROADCAST_TILES:
        tiles = F.broadcast(tiles)
    rows = stored.join(tiles, tiles.columns).drop("block_x", "block_y")
    return rows.withColumns({c: F.col(c).cast(t) for c, t in kinds.items()})
