"""Averages of points per cell, and frames that follow each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.config import SceneConf
from gridloom.operators.fusion import FRAME

#: Factors of the cell key (fixed values).
KEY = (73856093, 19349663, 83492791)


def with_cells(points: DataFrame, size: float) -> DataFrame:
    """``points`` with cell indices i, j, k and their linear ``voxel_key``."""
    cells = points.withColumns({c: F.floor(F.col(a) / F.lit(float(size))) for a, c in zip("xyz", "ijk", strict=True)})
    return cells.withColumn("voxel_key", sum((F.col(c) * F.lit(m) for c, m in zip("ijk", KEY, strict=True)), F.lit(0).cast("long")))


def voxel_downsample(points: DataFrame, size: float = SceneConf.voxel_size, by_key: bool = False, values: tuple[str, ...] = ("intensity",)) -> DataFrame:
    """Mean position and ``values`` per frame and occupied cell, with n and a dense ``pid`` in key order.

    Cells are told apart by their indices; ``by_key`` merges those whose linear keys coincide. Non-finite
    points are dropped first.
    """
    finite = [~F.isnan(c) & (F.abs(c) < float("inf")) for c in "xyz"]
    cells = with_cells(points.where(finite[0] & finite[1] & finite[2]), size)
    group = ["voxel_key"] if by_key else ["voxel_key", "i", "j", "k"]
    out = cells.groupBy(*FRAME, *group).agg(*[F.avg(c).alias(c) for c in ("x", "y", "z", *values)], F.count(F.lit(1)).alias("n"))
    return out.withColumn("pid", F.row_number().over(Window.partitionBy(*FRAME).orderBy(*group)) - 1)


def with_next(frames: DataFrame, fallback: float = SceneConf.delta_t_fallback) -> DataFrame:
    """``frames`` (.., ts) that have a successor, with next_frame, next_ts and dt."""
    w = Window.partitionBy("sequence_id").orderBy("frame_idx")
    out = frames.withColumns({"next_frame": F.lead("frame_idx").over(w), "next_ts": F.lead("ts").over(w)}).where("next_frame is not null")
    return out.withColumn("dt", F.coalesce(F.col("next_ts") - F.col("ts"), F.lit(fallback)))


def tracking_dt(frames: DataFrame, default: float = 0.1) -> DataFrame:
    """``frames`` with the step from the frame before; ``default`` where that is not a positive number."""
    step = F.col("ts") - F.lag("ts").over(Window.partitionBy("sequence_id").orderBy("frame_idx"))
    return frames.withColumn("dt", F.when((step > 0) & (step < float("inf")), step).otherwise(F.lit(default)))
