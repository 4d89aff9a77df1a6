"""The dominant plane of a frame, by seeded random hypotheses."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.config import SceneConf
from gridloom.storage import ship


def fit_plane(p: np.ndarray, conf: SceneConf, seed: int) -> np.ndarray:
    """Mask of the points within plane_distance of the plane that most points support."""
    n = len(p)
    if n < conf.plane_points:
        return np.zeros(n, bool)
    rng, best = np.random.default_rng(seed), np.zeros(n, bool)
    for _ in range(conf.plane_trials):
        some = p[rng.choice(n, conf.plane_points, replace=False)]
        mid = some.mean(axis=0)
        normal = np.linalg.svd(some - mid)[2][-1]
        near = np.abs((p - mid) @ normal) < conf.plane_distance
        if near.sum() > best.sum():
            best = near
    return best


def mark_ground(points: DataFrame, conf: SceneConf = SceneConf()) -> DataFrame:
    """``points`` with is_ground. A frame is a group; the seed is its index, so reruns agree whatever the row order."""
    ship(points.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields) + ", is_ground boolean"

    def mark(table: pa.Table) -> pa.Table:
        table = table.sort_by([("x", "ascending"), ("y", "ascending"), ("z", "ascending"), ("pid", "ascending")])
        xyz = np.stack([table[c].to_numpy() for c in "xyz"], axis=1)
        return table.append_column("is_ground", pa.array(fit_plane(xyz, conf, int(table["frame_idx"][0].as_py()))))

    return points.groupBy("sequence_id", "frame_idx").applyInArrow(mark, schema)


def remove_ground(points: DataFrame, conf: SceneConf = SceneConf()) -> DataFrame:
    """Points off the plane, with a new dense pid in the order of the old."""
    from pyspark.sql import Window

    rest = mark_ground(points, conf).where(~F.col("is_ground")).drop("is_ground")
    return rest.withColumn("pid", F.row_number().over(Window.partitionBy("sequence_id", "frame_idx").orderBy("pid")) - 1)
