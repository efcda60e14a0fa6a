"""Thresholds of the engine, in one place. Every operator takes them as parameters."""

from __future__ import annotations

from dataclasses import dataclass

# Mean earth radius used on the server, and the one used by clients (meters).
EARTH_RADIUS_M = 6371008.8
CLIENT_EARTH_RADIUS_M = 6371000.0
METERS_PER_DEGREE = 111000.0


@dataclass(frozen=True)
class TripConfig:
    gap_seconds: int = 900
    visit_seconds: int = 900
    visit_radius_m: float = 50.0
    visit_accuracy_m: float = 50.0
    min_points: int = 2
    bbox_margin_deg: float = 0.001
    # Width of the time slices that split one user's history over many tasks.
    slice_seconds: int = 86400


@dataclass(frozen=True)
class TileConfig:
    base_size_deg: float = 1.0
    density: int = 5000
    max_depth: int = 2


@dataclass(frozen=True)
class MatchConfig:
    radius_m: float = 20.0
    extend_factor: float = 1.5
    max_candidates: int = 5
    cell_deg: float = 0.002
    window_size: int = 2
    window_step: int = 1
    near_point_m: float = 10.0
    near_point_factor: float = 0.1
    private_factor: float = 9000.0
    max_speed_mps: float = 40.0
    detour_limit: float = 5.0
    min_limit_m: float = 1000.0
    max_point_to_route_m: float = 150.0
    # Cost weights of a window path.
    distance_weight: float = 2.0
    std_dev_weight: float = 0.5
    length_weight: float = 0.5
    road_class_weight: float = 0.8
    continuity_weight: float = 0.2
    constraint_bonus: float = -50.0
    constraint_penalty: float = 100.0
    free_detour_ratio: float = 1.4


TRIPS = TripConfig()
TILES = TileConfig()
MATCH = MatchConfig()
