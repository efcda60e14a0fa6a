"""Constraints of windows: a point held to a road, by the road's way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.operators.matching import WINDOW


def way_constraints(windows: DataFrame, constraints: DataFrame, candidates: DataFrame, segs: DataFrame) -> DataFrame:
    """Rows trip_id, window_idx, pos, segment_id: the candidates that a constraint leaves at a place of a window.

    ``constraints`` (trip_id, point_idx, seq, segment_id) hold points to segments. A point may take any of its
    candidates on the way of that segment. A constraint whose segment is unknown, or on whose way the point has no candidate, is
    ignored; of those left at a point the last by ``seq`` (with equal ones, by segment) holds. Points without one are not
    returned.
    """
    way = segs.select("segment_id", "way_id")
    asked = constraints.join(way, "segment_id").select("trip_id", "point_idx", F.struct("seq", "segment_id").alias("of"), "way_id")
    own = candidates.select("trip_id", "point_idx", "segment_id").join(way, "segment_id")
    fits = own.join(asked, ["trip_id", "point_idx", "way_id"])
    # A point has few candidates (``max_candidates``), which bounds what is kept per constraint.
    kept = fits.groupBy("trip_id", "point_idx", "of").agg(F.collect_set("segment_id").alias("segments"))
    last = kept.groupBy("trip_id", "point_idx").agg(F.max_by("segments", "of").alias("segments"))
    places = windows.select(*WINDOW, F.posexplode(F.sequence("start_idx", "end_idx")).alias("pos", "point_idx"))
    return places.join(last, ["trip_id", "point_idx"]).select(*WINDOW, F.col("pos").cast("long").alias("pos"), F.explode("segments").alias("segment_id"))
