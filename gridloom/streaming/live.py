"""Streaming forms: running voxel means, and the tracker as a stateful operator."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridloom.config import SceneConf, TrackConf
from gridloom.operators.tracking import BOX, Tracks, prune, step
from gridloom.operators.voxel import with_cells
from gridloom.storage import ship

LIVE = "sequence_id string, frame_idx int, det_index int, entity_id long, px double, py double, yaw double, v double"


def voxel_stream(points: DataFrame, size: float = SceneConf.voxel_size, delay: str = "10 seconds") -> DataFrame:
    """Mean position and intensity per frame and voxel of a stream with ``event_time``; a frame is final once the watermark passes it."""
    cells = with_cells(points.withWatermark("event_time", delay), size)
    keys = ["sequence_id", "frame_idx", "event_time", "voxel_key", "i", "j", "k"]
    return cells.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in ("x", "y", "z", "intensity")], F.count(F.lit(1)).alias("n"))


def _frame(state: dict, boxes: np.ndarray, ts: float) -> list[tuple]:
    tracks: Tracks = state["tracks"]
    first = state["clock"] is None
    found = step(tracks, boxes, None if first else ts - state["clock"])
    rows = [(j, int(tracks.ids[i]), *tracks.x[i, :4].tolist()) for i, j, _ in sorted(found, key=lambda f: f[1])]
    if not first:
        prune(tracks)
    state["clock"] = ts
    return rows


def track_stream(detections: DataFrame, conf: TrackConf = TrackConf()) -> DataFrame:
    """Entities of a stream of detections (sequence_id, frame_idx, ts, det_index, BOX), in the order of frames.

    A micro-batch holds whole frames; frames without detections come as a row with null det_index. State is one
    set of tracks per sequence.
    """
    ship(detections.sparkSession)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = pickle.loads(state.get[0]) if state.exists else {"tracks": Tracks(conf), "clock": None}
        rows = pd.concat(list(parts)).sort_values(["frame_idx", "det_index"])
        out = []
        for frame, part in rows.groupby("frame_idx", sort=True):
            real = part[part["det_index"].notna()]
            boxes = real[list(BOX)].to_numpy(float).reshape(-1, len(BOX))
            out += [(key[0], int(frame), *r) for r in _frame(now, boxes, float(part["ts"].iloc[0]))]
        state.update((pickle.dumps(now),))
        yield pd.DataFrame(out, columns=[f.split(" ")[0] for f in LIVE.split(", ")])

    return detections.groupBy("sequence_id").applyInPandasWithState(run, LIVE, "state binary", "append", GroupStateTimeout.NoTimeout)
