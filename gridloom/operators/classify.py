"""Static or dynamic, from the last seconds of each track."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.config import StaticConf
from gridloom.functions.motion import inside_box

ENTITY = ["sequence_id", "entity_id"]


def trailing(snapshots: DataFrame, span: float) -> DataFrame:
    """The snapshots of the last ``span`` seconds of each track, or its last two if those are fewer."""
    whole = Window.partitionBy(*ENTITY)
    rows = snapshots.withColumns({"_last": F.max("ts").over(whole), "_rn": F.row_number().over(whole.orderBy(F.col("ts").desc(), F.col("scene_idx").desc()))})
    rows = rows.withColumn("_in", F.col("ts") >= F.col("_last") - span)
    rows = rows.withColumn("_n", F.sum(F.col("_in").cast("int")).over(whole))
    return rows.where(F.col("_in") & (F.col("_n") >= 2) | (F.col("_n") < 2) & (F.col("_rn") <= 2)).drop("_last", "_rn", "_in", "_n")


def pair_overlap(window: DataFrame, points: DataFrame) -> DataFrame:
    """(entity, scene_idx, overlap): share of a snapshot's points inside the box of the one before; 0 without points.

    ``points``: sequence_id, entity_id, scene_idx, x, y, z, the members of the track in that scene.
    """
    order = Window.partitionBy(*ENTITY).orderBy("ts", "scene_idx")
    box = ["px", "py", "pz", "yaw", "sx", "sy", "sz"]
    pairs = window.select(*ENTITY, "scene_idx", *[F.lag(c).over(order).alias(f"b_{c}") for c in box]).where("b_px is not null")
    met = pairs.join(points, [*ENTITY, "scene_idx"], "left")
    inside = inside_box(F.col("x"), F.col("y"), F.col("z"), *[F.col(f"b_{c}") for c in box])
    return met.groupBy(*ENTITY, "scene_idx").agg(F.avg(F.coalesce(inside, F.lit(False)).cast("double")).alias("overlap"))


def motion_features(snapshots: DataFrame, points: DataFrame, conf: StaticConf = StaticConf()) -> DataFrame:
    """entity, n, v_mean, drift, travel, overlap of tracks with two snapshots or more."""
    sizes = snapshots.groupBy(*ENTITY).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    at = F.struct("ts", "scene_idx")
    ends = lambda w: w.groupBy(*ENTITY).agg(F.avg(F.abs("v")).alias("v_mean"), F.min_by(F.struct("ts", "px", "py"), at).alias("a"), F.max_by(F.struct("ts", "px", "py"), at).alias("b"))
    gone = F.sqrt((F.col("b.px") - F.col("a.px")) ** 2 + (F.col("b.py") - F.col("a.py")) ** 2)
    span = F.col("b.ts") - F.col("a.ts")
    short = trailing(snapshots, conf.short_window)
    near = ends(short).select(*ENTITY, "v_mean", F.when(span < 1e-3, 0.0).otherwise(gone / span).alias("drift"))
    far = ends(trailing(snapshots, conf.long_window)).select(*ENTITY, gone.alias("travel"))
    met = pair_overlap(short, points).groupBy(*ENTITY).agg(F.avg("overlap").alias("overlap"))
    return sizes.join(near, ENTITY).join(far, ENTITY).join(met, ENTITY, "left").withColumn("overlap", F.coalesce("overlap", F.lit(0.0)))


def classify_tracks(histories: DataFrame, snapshots: DataFrame, points: DataFrame, conf: StaticConf = StaticConf()) -> DataFrame:
    """``histories`` with is_static judged anew and mean_speed the recent mean of absolute speeds.

    A standing track becomes moving by net travel together with speed, drift or lost overlap, a moving one standing
    only if all of them say so; tracks of one snapshot stay as they are.
    """
    f = motion_features(snapshots, points, conf)
    h = histories.join(f, ENTITY, "left")
    wakes = (F.col("travel") > conf.travel_dynamic) & ((F.col("v_mean") > conf.v_dynamic) | (F.col("drift") > conf.drift_dynamic) | (F.col("overlap") < conf.overlap_dynamic))
    rests = (F.col("v_mean") < conf.v_static) & (F.col("drift") < conf.drift_static) & (F.col("overlap") > conf.overlap_static) & (F.col("travel") < conf.travel_static)
    judged = F.when(F.col("n").isNull(), F.col("is_static")).when(F.col("is_static"), ~wakes).otherwise(rests)
    return h.withColumns({"is_static": judged, "mean_speed": F.coalesce("v_mean", "mean_speed")}).select(*histories.columns)
