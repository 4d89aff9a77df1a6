"""Bringing the points of several sensors into one frame of reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.motion import MATRIX, at, matrix

FRAME = ("sequence_id", "frame_idx")


def transform_points(points: DataFrame, pose: Column, frame: str | None = None) -> DataFrame:
    """``points`` with x, y, z moved by a 4x4 ``pose``; other columns untouched. With ``frame``, coord_frame is set
    and the step noted in ``applied_transform``."""
    moved = {c: at(pose, i, 0) * F.col("x") + at(pose, i, 1) * F.col("y") + at(pose, i, 2) * F.col("z") + at(pose, i, 3) for i, c in enumerate("xyz")}
    if frame is not None:
        moved["applied_transform"] = F.concat(F.lit(f"T_{frame}_from_"), F.coalesce("coord_frame", F.lit("sensor")))
        moved["coord_frame"] = F.lit(frame)
    return points.withColumns(moved)


def to_world(points: DataFrame, calibration: DataFrame) -> DataFrame:
    """Points in the world frame. Those of a sensor without a pose in ``calibration`` (sensor, t) are an error,
    unless they are in the world frame already."""
    placed = points.join(calibration.select("sensor", F.col("t").alias("_t")), "sensor", "left")
    here = F.coalesce(F.col("coord_frame") == "world", F.lit(False))
    still = matrix([[float(i == j) for j in range(4)] for i in range(4)])
    missing = F.raise_error(F.concat(F.lit("no extrinsics for sensor "), F.col("sensor").cast("string"))).cast(MATRIX)
    pose = F.when(here, still).when(F.col("_t").isNull(), missing).otherwise(F.col("_t"))
    return transform_points(placed.withColumn("_t", pose), F.col("_t")).select(*points.columns).withColumn("coord_frame", F.lit("world"))


def select_sensors(sweeps: DataFrame, sensors: list[str]) -> DataFrame:
    """The sweeps of ``sensors``; a frame that lacks one is an error."""
    mine = sweeps.where(F.col("sensor").isin(sensors))
    found = F.size(F.collect_set("sensor").over(Window.partitionBy(*FRAME)))
    lacks = F.raise_error(F.concat(F.lit("frame lacks a sensor: "), F.col("frame_idx").cast("string"))).cast("boolean")
    return mine.withColumn("_n", found).where(F.when(F.col("_n") < len(set(sensors)), lacks).otherwise(F.lit(True))).drop("_n")


def fused_frames(sweeps: DataFrame, order: list[str]) -> DataFrame:
    """One row per frame of what was joined: sensors and timestamps in the given order, ts in seconds of the first."""
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("sensor"))
    one = F.sort_array(F.collect_list(F.struct(place.alias("place"), "sensor", "ts_ms", "filename")))
    rows = sweeps.groupBy(*FRAME).agg(one.alias("s"))
    pick = lambda c: F.transform("s", lambda x: x[c])
    return rows.select(*FRAME, pick("sensor").alias("sensors"), pick("ts_ms").alias("timestamps"), (F.get("s", F.lit(0))["ts_ms"] / 1000.0).alias("ts"), F.size("s").alias("num_inputs"), pick("filename").alias("sources"))
