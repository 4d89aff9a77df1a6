"""From fused points to scenes, tracks, labels and a surface."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.config import GridConf, SceneConf, StaticConf, TrackConf
from gridloom.operators.classify import classify_tracks
from gridloom.operators.cluster import scene_clusters
from gridloom.operators.distance_field import iso_mesh, reconstruct, static_points
from gridloom.operators.fusion import select_sensors, to_world
from gridloom.operators.ground import remove_ground
from gridloom.operators.neighbours import nn_flow
from gridloom.operators.tracking import detection_entities, histories, point_entities, snapshots, track
from gridloom.operators.voxel import voxel_downsample, with_next
from gridloom.sources.sequence import cached_stage, read_sequence
from gridloom.storage import materialize

KEYS = ["sequence_id", "frame_idx"]


def process_frames(points: DataFrame, frames: DataFrame, conf: SceneConf = SceneConf()) -> dict[str, DataFrame]:
    """frames, points, members and clusters of the scenes: every frame but the last, which has no successor."""
    thin = voxel_downsample(points, conf.voxel_size).select(*KEYS, "pid", "x", "y", "z", "intensity")
    rest = materialize(remove_ground(thin, conf), "scene-points")
    # few rows that all that follows looks up, while to make them may take all points
    steps = materialize(with_next(frames, conf.delta_t_fallback), "steps", 0)
    flow = materialize(nn_flow(rest, steps, conf.velocity_max_dist), "flow")
    members, clusters = scene_clusters(flow, conf)
    # a frame without points off the ground was not clustered
    seen = flow.select(*KEYS).distinct().withColumn("clustered", F.lit(True))
    scenes = steps.join(seen, KEYS, "left").withColumn("clustered", F.coalesce("clustered", F.lit(False)))
    return {"frames": materialize(scenes.select(*KEYS, "ts", "clustered"), "frames", 0), "points": flow, "members": materialize(members, "members"), "clusters": materialize(clusters, "clusters")}


def track_scenes(scenes: dict[str, DataFrame], conf: TrackConf = TrackConf(), rules: StaticConf = StaticConf()) -> dict[str, DataFrame]:
    """observations, snapshots, histories (classified), det_to_track and point_to_entity of the scenes."""
    order = scenes["frames"].withColumn("scene_idx", (F.row_number().over(Window.partitionBy("sequence_id").orderBy("frame_idx")) - 1).cast("int"))
    number = order.select(*KEYS, "scene_idx")
    observed = materialize(track(scenes["frames"], scenes["clusters"], conf), "observations").join(number, ["sequence_id", "scene_idx"])
    clusters = scenes["clusters"].join(number, KEYS)
    named = detection_entities(observed, clusters).join(number, ["sequence_id", "scene_idx"])
    shots = snapshots(observed)
    held = shots.select(*KEYS, "entity_id", "scene_idx", "det_index").join(scenes["members"].select(*KEYS, "det_index", "x", "y", "z"), [*KEYS, "det_index"])
    judged = classify_tracks(histories(observed, conf), shots, held.select("sequence_id", "entity_id", "scene_idx", "x", "y", "z"), rules)
    entities = named.select(*KEYS, "det_index", "entity_id")
    return {"observations": observed, "snapshots": shots, "histories": judged, "det_to_track": named, "point_to_entity": point_entities(scenes["points"].select(*KEYS, "pid"), scenes["members"], entities)}


def surface(scenes: dict[str, DataFrame], tracks: dict[str, DataFrame], conf: GridConf = GridConf()) -> dict[str, DataFrame]:
    """grid, field, vertices and faces of what stands still."""
    still = static_points(tracks["snapshots"], tracks["histories"], scenes["members"], scenes["points"])
    grid, field = reconstruct(still, conf)
    grid, field = materialize(grid, "grid"), materialize(field, "field")
    vertices, faces = iso_mesh(field, grid, conf)
    return {"grid": grid, "field": field, "vertices": vertices, "faces": faces}


def run_sequence(spark: SparkSession, root: str, sequence_id: str, sensors: list[str], max_frames: int | None = 200, mesh: bool = True, recompute: bool = False) -> dict[str, DataFrame]:
    """The whole chain over a recorded sequence; the fused points are kept below ``root`` for the same settings."""
    frames, sweeps, points, calibration = read_sequence(spark, root, sequence_id, max_frames=max_frames)
    chosen = select_sensors(sweeps, sensors).select(*KEYS, "sensor")
    times = frames.select(*KEYS, (F.col("ts_ms") / 1000.0).alias("ts"))

    def fuse() -> DataFrame:
        return to_world(points.join(chosen, [*KEYS, "sensor"], "left_semi"), calibration)

    fused = cached_stage(spark, root, "fused", (sequence_id, tuple(sensors), max_frames), fuse, recompute)
    scenes = process_frames(fused, times)
    found = track_scenes(scenes)
    return scenes | found | (surface(scenes, found) if mesh else {})
