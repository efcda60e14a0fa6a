"""The network in tile folders: what boxes read, and which folders are opened for it."""

from math import floor

from pyspark.sql import functions as F

from wayloom.config import TileConfig
from wayloom.operators import tiles
from wayloom.plans.inputs import Inputs
from wayloom.session import materialize, scratch_path
from wayloom.sources import sinks, tiled

TILE = TileConfig(0.01, 3, 2)


def test_boxes_read_their_tiles_only(spark):
    i = Inputs(spark, "/root/testdata/sf0.001")
    segs, edges = i.segments(), i.edges()
    placed = materialize(tiles.assign_tiles(segs, TILE), "placed")
    folder = scratch_path(spark, "tiled")
    assert not tiled.is_complete(spark, folder)
    tiled.write_network(segs, edges, placed, folder)
    assert tiled.is_complete(spark, folder)
    where = {r.segment_id: (r.depth, r.tile_x, r.tile_y) for r in placed.collect()}
    boxes = [(1, -43.2, -22.9, -43.199, -22.899), (2, -43.17, -22.9, -43.165, -22.895), (3, 10.0, 10.0, 11.0, 11.0), (4, -44.0, -23.0, -42.0, -22.0)]
    asked = spark.createDataFrame(boxes, "box int, min_lon double, min_lat double, max_lon double, max_lat double")
    wanted = materialize(tiled.wanted_tiles(asked, "box", spark.read.parquet(f"{folder}/index"), TILE), "wanted")
    got = {(r.box, r.depth, r.tile_x, r.tile_y) for r in wanted.collect()}
    want = set()
    for box, x0, y0, x1, y1 in boxes:
        for d, x, y in set(where.values()):
            size = TILE.base_size_deg / 2**d
            if floor(x0 / size) <= x <= floor(x1 / size) and floor(y0 / size) <= y <= floor(y1 / size):
                want.add((box, d, x, y))
    assert got == want and {b for b, *_ in got} == {1, 2, 4}
    near = materialize(wanted.filter("box <= 2"), "near")
    held = {(r.depth, r.tile_x, r.tile_y) for r in near.collect()}
    rows = tiled.read_boxes(spark, folder, "segments", near)
    assert {r.segment_id for r in rows.collect()} == {s for s, t in where.items() if t in held} and rows.count() < len(where)
    found = {(r.src, r.dst) for r in tiled.read_boxes(spark, folder, "edges", near).collect()}
    assert found == {(e.src, e.dst) for e in edges.collect() if where[e.src] == where[e.dst] and where[e.src] in held}
    # The list of wanted tiles prunes the folders while the query runs.
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    whole = tiled.read_boxes(spark, folder, "segments", wanted).agg(F.countDistinct("segment_id")).first()[0]
    assert whole == len(where)


def test_neighboring_tiles_share_folders(spark):
    # A folder and a file for each tile took most of the time of writing a network.
    rows = [(d, x, y, 100 * d + 10 * x + y) for d in (0, 1) for x in range(-4, 4) for y in range(8)]
    df = spark.createDataFrame(rows, "depth int, tile_x long, tile_y long, segment_id long")
    folder = scratch_path(spark, "blocks")
    sinks.write_tiles(df, f"{folder}/segments")
    held = spark.read.parquet(f"{folder}/segments")
    assert held.select(F.input_file_name()).distinct().count() == 8
    wanted = spark.createDataFrame([(1, 0, -1, 3), (2, 1, 2, 7), (3, 1, 2, 7), (4, 1, 50, 7)], "box int, depth int, tile_x long, tile_y long")
    got = tiled.read_boxes(spark, folder, "segments", wanted).select("depth", "tile_x", "tile_y", "segment_id").collect()
    assert sorted(map(tuple, got)) == [(0, -1, 3, -7), (1, 2, 7, 127)]
    box = sinks.read_tiles_in_box(spark, f"{folder}/segments", (-1.0, 3.0, 0.5, 4.5), 1.0, 1)
    assert sorted(r.segment_id for r in box.collect()) == sorted(
        s for d, x, y, s in rows if -(2**d) <= x <= 0.5 * 2**d and 3 * 2**d <= y <= 4.5 * 2**d
    )
