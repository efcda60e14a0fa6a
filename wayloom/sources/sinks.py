"""Writers: appended event tables, tiled networks, status snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_events(df: DataFrame, path: str, time_col: str) -> None:
    """Append rows, one folder per day. Rows of a day are brought together; days too large for
    one task are split by the engine, by their size."""
    dated = df.withColumn("event_date", F.to_date(time_col))
    (
        dated.hint("rebalance", "event_date")
        .write.mode("append")
        .partitionBy("event_date")
        .parquet(path)
    )


#: Tiles of one depth share a folder in squares of so many by so many: a folder and a file per tile cost far more time than
#: the rows they hold.
BLOCK = 4


def with_blocks(df: DataFrame) -> DataFrame:
    """Adds the block of tiles, ``block_x`` and ``block_y``, that holds each row's tile."""
    return df.withColumns({f"block_{c}": F.floor(F.col(f"tile_{c}") / BLOCK).cast("long") for c in ("x", "y")})


def write_tiles(df: DataFrame, path: str) -> None:
    """One folder per block of tiles; ``df`` has depth, tile_x and tile_y. A block's rows are sorted by tile, so that row groups of
    other tiles can be skipped. A crowded block is several files, by size."""
    folders = ["depth", "block_x", "block_y"]
    (
        with_blocks(df)
        .hint("rebalance", *folders)
        .sortWithinPartitions(*folders, "tile_x", "tile_y")
        .write.mode("overwrite")
        .partitionBy(*folders)
        .parquet(path)
    )


def read_tiles_in_box(spark: SparkSession, path: str, box: tuple[float, float, float, float], base_size: float, max_depth: int, buffer_deg: float = 0.0) -> DataFrame:
    """Rows of all tiles meeting a box, every depth. The filter is on folder columns too, so only
    those folders are listed and read."""
    x0, y0, x1, y1 = box[0] - buffer_deg, box[1] - buffer_deg, box[2] + buffer_deg, box[3] + buffer_deg
    keep = F.lit(False)
    for depth in range(max_depth + 1):
        size = base_size / 2**depth
        there = F.col("depth") == depth
        for c, low, high in (("x", x0, x1), ("y", y0, y1)):
            first, last = int(low // size), int(high // size)
            there &= F.col(f"block_{c}").between(first // BLOCK, last // BLOCK) & F.col(f"tile_{c}").between(first, last)
        keep = keep | there
    rows = spark.read.parquet(path).filter(keep)
    place = ["depth", "tile_x", "tile_y"]
    return rows.select(*[c for c in rows.columns if c not in (*place, "block_x", "block_y")], *place)


def segment_by_id(segments: DataFrame, segment_id: int) -> DataFrame:
    return segments.filter(F.col("segment_id") == segment_id)


def append_device_metadata(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def mark_batches(batches: DataFrame, done: DataFrame, column: str = "processed") -> DataFrame:
    """Snapshot of the batch table with ``column`` set for the batches listed in ``done``."""
    marks = done.select("batch_id").distinct().withColumn("_done", F.lit(True))
    return (
        batches.join(marks, "batch_id", "left")
        .withColumn(column, F.coalesce(F.col("_done"), F.col(column)))
        .drop("_done")
    )
