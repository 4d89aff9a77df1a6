"""Reading a recorded sequence: sync table, calibration and point files; and writing results."""

from __future__ import annotations

import hashlib
import io
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.motion import MATRIX
from gridloom.storage import ship

POINTS = "path string, pid long, x double, y double, z double, intensity double"


def read_sync_table(spark: SparkSession, path: str, prefix: str = "crossing", suffix: str = "_lidar", max_frames: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(frames, sweeps) of a sync table: a header row, a row of timestamps in ms, then a row of file names per sensor.

    frames: frame_idx, ts_ms, every timestamp once (of equal ones the last counts) in column order, at most
    ``max_frames`` columns. sweeps: frame_idx, ts_ms, sensor, filename of the sensors with that prefix and suffix; empty cells are left out.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("row", "line")).where("trim(line) <> ''")
    width = F.size(F.split("line", ","))
    most = lines.agg(F.max(width)).first()[0] or 1
    cells = lines.select("row", F.from_csv("line", F.lit(", ".join(f"c{i} string" for i in range(most)))).alias("c"))
    cells = cells.select("row", F.col("c.c0").alias("name"), F.posexplode(F.array(*[F.col(f"c.c{i}") for i in range(1, most)])).alias("column", "cell"))
    if max_frames is not None:
        cells = cells.where(F.col("column") < max_frames)
    times = cells.where("row = 1 and cell is not null").select("column", F.col("cell").cast("long").alias("ts_ms"))
    last = times.groupBy("ts_ms").agg(F.max("column").alias("column"), F.min("column").alias("first"))
    from pyspark.sql import Window

    frames = last.withColumn("frame_idx", (F.row_number().over(Window.orderBy("first")) - 1).cast("int"))  # one row per recorded frame
    named = cells.where("row > 1 and cell is not null and cell <> ''").where(F.col("name").startswith(prefix) & F.col("name").endswith(suffix))
    sweeps = named.join(frames, "column").select("frame_idx", "ts_ms", F.col("name").alias("sensor"), F.col("cell").alias("filename"))
    return frames.select("frame_idx", "ts_ms"), sweeps


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """sensor, type, t, t_inv of a calibration file: the first 4x4 value of each sensor's extrinsics, its kind named by the first key.

    A file of a few sensors, whose order of keys matters, so it is parsed on the driver.
    """
    text = spark.read.text(path, wholetext=True).first()[0]
    rows = []
    for sensor, block in json.loads(text).items():
        listed = block.get("extrinsics") or {}
        t = next((m for m in (np.array(v, dtype=object) for v in listed.values() if isinstance(v, list)) if m.shape == (4, 4)), None)
        if t is not None:
            t = t.astype(float)
            rows.append((sensor, next(iter(listed)), t.tolist(), np.linalg.inv(t).tolist()))
    return spark.createDataFrame(rows, f"sensor string, type string, t {MATRIX.simpleString()}, t_inv {MATRIX.simpleString()}")


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            with np.load(io.BytesIO(content.as_py()), allow_pickle=False) as f:
                x, y, z, i = (np.asarray(f[k], np.float64) for k in ("x", "y", "z", "intensity"))
            yield pa.RecordBatch.from_pydict({"path": pa.array([path]).take(pa.array(np.zeros(len(x), int))), "pid": np.arange(len(x)), "x": x, "y": y, "z": z, "intensity": i})


def read_points(spark: SparkSession, paths: str) -> DataFrame:
    """Points of all npz files that match ``paths``, with their path and place in the file; non-finite ones are left out."""
    ship(spark)
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    points = files.mapInArrow(_decode, POINTS)
    return points.where("not isnan(x) and not isnan(y) and not isnan(z) and abs(x) < double('inf') and abs(y) < double('inf') and abs(z) < double('inf')")


def read_sequence(spark: SparkSession, root: str, sequence_id: str, suffix: str = "_lidar", max_frames: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(frames, sweeps, points, calibration) of the sequence below ``root``: timesync_info.csv, calibration.json, <sensor>/<file>.npz.

    Sweeps whose file is missing are left out; frames without any sweep stay.
    """
    frames, sweeps = read_sync_table(spark, f"{root}/timesync_info.csv", suffix=suffix, max_frames=max_frames)
    calibration = read_calibration(spark, f"{root}/calibration.json")
    points = read_points(spark, f"{root}/*/*.npz")
    tail = F.slice(F.split("path", "/"), -2, 2)
    files = spark.read.format("binaryFile").load(f"{root}/*/*.npz").select("path").select("path", F.array_join(tail, "/").alias("_file"))
    sweeps = sweeps.withColumn("_file", F.concat_ws("/", "sensor", "filename")).join(files, "_file").drop("_file")
    sweeps = sweeps.join(F.broadcast(calibration.select("sensor", F.lit("sensor").alias("coord_frame"))), "sensor", "left")  # a row per sensor
    sweeps = sweeps.withColumns({"sequence_id": F.lit(sequence_id), "coord_frame": F.coalesce("coord_frame", F.lit("sensor"))})
    placed = points.join(sweeps.select("path", "sequence_id", "frame_idx", "sensor", "coord_frame"), "path").drop("path")
    return frames.withColumn("sequence_id", F.lit(sequence_id)), sweeps, placed, calibration


def write_ply(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """An ASCII PLY file at a local ``path``, streamed through the driver a partition at a time."""
    with open(path, "w") as f:
        f.write("ply\nformat ascii 1.0\n" + f"element vertex {vertices.count()}\n" + "".join(f"property double {c}\n" for c in ("x", "y", "z", "nx", "ny", "nz")))
        f.write(f"element face {faces.count()}\nproperty list uchar int vertex_indices\nend_header\n")
        for r in vertices.orderBy("vid").toLocalIterator():
            f.write(" ".join(repr(r[c]) for c in ("x", "y", "z", "nx", "ny", "nz")) + "\n")
        for r in faces.orderBy("fid").toLocalIterator():
            f.write(f"3 {r['v0']} {r['v1']} {r['v2']}\n")


def cached_stage(spark: SparkSession, root: str, name: str, settings: object, make: Callable[[], DataFrame], recompute: bool = False) -> DataFrame:
    """A stage's table, read back if it was written before for the same ``settings``, else made and written."""
    key = hashlib.sha1(f"{name}|{settings!r}".encode()).hexdigest()[:16]
    path = f"{root}/_cache/{name}-{key}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if recompute or not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
