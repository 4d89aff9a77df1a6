"""Settings of the operators. The numbers are fixed values that results depend on."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class SceneConf:
    voxel_size: float = 0.06
    eps_factor: float = 12.0
    min_samples: int = 5
    delta_t_fallback: float = 1.0
    merge_gap: float = 1.0
    clustering_scale: tuple[float, float, float] = (1.0, 1.0, 0.5)
    velocity_max_dist: float = 2.0
    merge_speed: float = 0.5
    static_speed: float = 0.3
    moving_speed: float = 1.5
    min_height: float = 0.4
    min_points: int = 5
    plane_distance: float = 0.4
    plane_points: int = 5
    plane_trials: int = 300

    @property
    def eps(self) -> float:
        return self.voxel_size * self.eps_factor


@dataclass(frozen=True)
class TrackConf:
    max_missed: int = 2
    min_points: int = 3
    confirm_hits: int = 2
    tentative_missed: int = 3
    max_dist: float = 5.0
    shape_weight: float = 0.05
    shape_gate: float = 2.0
    maha_gate: float = 16.0
    dt_default: float = 0.1
    q_pos: float = 1.0
    q_yaw: float = math.radians(10.0)
    q_v: float = 3.0
    q_omega: float = math.radians(20.0)
    r_pos: float = 0.3
    r_yaw: float = math.radians(8.0)
    straight_eps: float = 1e-5
    velocity_weight: float = 0.0
    swap_cost: float = 3.0
    static_speed: float = 0.3
    p0: tuple[float, ...] = (1.0, 1.0, math.radians(20.0), 5.0, math.radians(45.0))
    forbidden: float = 1e9


@dataclass(frozen=True)
class StaticConf:
    short_window: float = 2.0
    long_window: float = 5.0
    v_static: float = 1.4
    v_dynamic: float = 1.6
    drift_static: float = 1.6
    drift_dynamic: float = 2.2
    overlap_static: float = 0.20
    overlap_dynamic: float = 0.10
    travel_static: float = 2.4
    travel_dynamic: float = 3.0


@dataclass(frozen=True)
class GridConf:
    voxel_size: float = 0.20
    trunc: float = 1.0
    margin: float = 2.0
    level: float = 0.5
