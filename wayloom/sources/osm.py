"""Road data scan: node and way tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.functions import parse, roads
from wayloom.schema import OSM_NODES, OSM_WAYS


def read_nodes(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(OSM_NODES).format(fmt).load(path)


def read_ways(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(OSM_WAYS).format(fmt).load(path)


def road_ways(ways: DataFrame) -> DataFrame:
    """Ways of a road class with at least two node references, with parsed attributes."""
    highway = F.try_element_at("tags", F.lit("highway"))
    return ways.filter(highway.isin(*roads.NETWORK_CLASSES) & (F.size("refs") > 1)).select(
        F.col("id").alias("way_id"),
        "refs",
        highway.alias("highway"),
        roads.is_oneway(F.col("tags")).alias("is_oneway"),
        parse.max_speed_kmh(F.try_element_at("tags", F.lit("maxspeed"))).alias("max_speed"),
        F.try_element_at("tags", F.lit("name")).alias("name"),
        roads.tag_layer(F.col("tags")).alias("layer"),
        roads.tag_yes(F.col("tags"), "bridge").alias("is_bridge"),
        roads.tag_yes(F.col("tags"), "tunnel").alias("is_tunnel"),
        roads.tag_private(F.col("tags")).alias("is_private"),
        "tags",
    )


def way_nodes(ways: DataFrame) -> DataFrame:
    return ways.select("way_id", F.posexplode("refs").alias("seq", "node_id")).withColumn(
        "seq", F.col("seq").cast("long")
    )
