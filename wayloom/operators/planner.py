"""Route planning in bulk: a table of requests is matched like trips without times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.config import MATCH, MatchConfig
from wayloom.operators.matching import Matched, Network, match_trips


def request_points(requests: DataFrame) -> DataFrame:
    """Start, via and end points in order. ``requests``: request_id string, start and end
    ``struct<lat, lon>``, via array of the same."""
    stops = F.concat(F.array("start"), F.coalesce("via", F.array().cast("array<struct<lat:double,lon:double>>")), F.array("end"))
    return requests.select("request_id", F.posexplode(stops).alias("i", "p")).select(
        F.col("request_id").alias("trip_id"), F.col("i").cast("long").alias("point_idx"),
        F.lit(0).cast("long").alias("t"), F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"),
    )


def plan_routes(requests: DataFrame, net: Network, cfg: MatchConfig = MATCH) -> Matched:
    """Routes through all points of each request: twice the matching radius, no time limit."""
    return match_trips(request_points(requests), net, cfg, radius_m=cfg.radius_m * 2.0, timed=False)
