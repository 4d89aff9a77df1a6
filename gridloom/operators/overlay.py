"""Lines, boxes, ellipses and colours that a viewer of scenes would draw."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Edges between the eight corners of a box, in the corners' order (fixed values).
EDGES = [(0, 1), (0, 2), (0, 3), (1, 4), (1, 5), (2, 4), (2, 6), (3, 5), (3, 6), (4, 7), (5, 7), (6, 7)]
#: Colours of ids 0 to 9, then again (fixed values).
PALETTE = [
    (0.121, 0.466, 0.705),
    (1.000, 0.498, 0.054),
    (0.172, 0.627, 0.172),
    (0.839, 0.152, 0.156),
    (0.580, 0.404, 0.741),
    (0.549, 0.337, 0.294),
    (0.890, 0.467, 0.761),
    (0.498, 0.498, 0.498),
    (0.737, 0.741, 0.133),
    (0.090, 0.745, 0.812),
]
GREY, MISSING = 0.6, 0.75


def _rgb(r, g, b) -> Column:
    return F.array(*[F.lit(float(x)) if isinstance(x, (int, float)) else x for x in (r, g, b)])


def box_edges(boxes: DataFrame, keep: list[str]) -> DataFrame:
    """Twelve rows (keep, edge, a, b) per box of ``boxes`` (.., corners)."""
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in EDGES])
    rows = boxes.select(*keep, "corners", F.posexplode(pairs).alias("edge", "e"))
    return rows.select(*keep, "edge", F.get("corners", F.col("e.a")).alias("a"), F.get("corners", F.col("e.b")).alias("b"))


def _picker(i: int):
    return lambda c: F.get(c, F.lit(i))


def diagonal(corners: Column) -> Column:
    """Length of the diagonal of the axis-parallel hull of the corners."""
    along = [F.transform(corners, _picker(i)) for i in range(3)]
    span = [F.array_max(c) - F.array_min(c) for c in along]
    return F.sqrt(span[0] * span[0] + span[1] * span[1] + span[2] * span[2])


def drawn_boxes(boxes: DataFrame, least: float = 0.1, most: float = 1e6) -> DataFrame:
    return boxes.where(diagonal(F.col("corners")).between(least, most))


def ellipse(mx, my, cxx, cxy, cyy, sigmas: float = 2.0, n: int = 64) -> Column:
    """``n`` points (x, y) of the covariance ellipse around a mean; eigenvalues are at least 1e-9."""
    mid, gap = (cxx + cyy) / 2, F.sqrt((cxx - cyy) * (cxx - cyy) / 4 + cxy * cxy)
    a, b = (F.sqrt(F.greatest(x, F.lit(1e-9))) * sigmas for x in (mid + gap, mid - gap))
    turn = F.atan2(2 * cxy, cxx - cyy) / 2
    c, s = F.cos(turn), F.sin(turn)

    def point(k: Column) -> Column:
        t = k * (2 * math.pi / n)
        return F.struct((mx + c * a * F.cos(t) - s * b * F.sin(t)).alias("x"), (my + s * a * F.cos(t) + c * b * F.sin(t)).alias("y"))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), point)


def overlay_ellipses(snapshots: DataFrame, scene: int | None = None) -> DataFrame:
    """Ellipse rows (sequence_id, entity_id, scene_idx, k, x, y, z, colour) of the snapshots' position covariance; colours lightened."""
    rows = snapshots if scene is None else snapshots.where(F.col("scene_idx") == scene)
    shape = ellipse(F.col("px"), F.col("py"), F.get("p", F.lit(0)), F.get("p", F.lit(1)), F.get("p", F.lit(6)))
    light = F.transform(id_colour(F.col("entity_id")), lambda c: 0.8 * c + 0.2)
    return rows.select("sequence_id", "entity_id", "scene_idx", F.posexplode(shape).alias("k", "at"), F.col("pz").alias("z"), light.alias("colour")).select("sequence_id", "entity_id", "scene_idx", "k", "at.x", "at.y", "z", "colour")


def overlay_tracks(snapshots: DataFrame) -> DataFrame:
    """Segments between consecutive snapshots of each track."""
    w = Window.partitionBy("sequence_id", "entity_id").orderBy("scene_idx", "ts")
    ahead = {f"next_{c}": F.lead(c).over(w) for c in ("px", "py", "pz")}
    return snapshots.withColumns(ahead).where("next_px is not null").select("sequence_id", "entity_id", "scene_idx", "px", "py", "pz", *ahead)


def id_colour(label: Column) -> Column:
    """Palette colour of an id; grey if negative, lighter if missing."""
    table = F.array(*[_rgb(*c) for c in PALETTE])
    return F.when(label.isNull(), _rgb(MISSING, MISSING, MISSING)).when(label < 0, _rgb(GREY, GREY, GREY)).otherwise(F.get(table, F.pmod(label, F.lit(len(PALETTE))).cast("int")))


def finite_points(points: DataFrame) -> DataFrame:
    ok = F.lit(True)
    for c in "xyz":
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return points.where(ok)


def scaled(value: Column, keys: list[str]) -> Column:
    """``value`` from 0 to 1 over its range within the keys."""
    w = Window.partitionBy(*keys)
    return (value - F.min(value).over(w)) / (F.max(value).over(w) - F.min(value).over(w) + 1e-9)


def velocity_scalar(points: DataFrame, keys: list[str]) -> DataFrame:
    speed = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy") + F.col("vz") * F.col("vz"))
    return points.withColumn("_speed", speed).withColumn("colour_value", scaled(F.col("_speed"), keys)).drop("_speed")


def intensity_colour(points: DataFrame, keys: list[str]) -> DataFrame:
    i = F.col("_i")
    return points.withColumn("_i", scaled(F.col("intensity"), keys)).withColumn("colour", F.array(i, 1 - i, F.lit(0.5))).drop("_i")


def overlay(mode: int, points: DataFrame, boxes: DataFrame, snapshots: DataFrame, scene: int) -> dict[str, DataFrame]:
    """The tables of a viewer mode: 0 boxes, 1 tracks, 2 uncertainty, 3 boxes and tracks and uncertainty, 4 velocity, 5 intensity."""
    keys = ["sequence_id", "frame_idx"]
    shown = finite_points(points.where(F.col("frame_idx") == scene))
    out = {"points": velocity_scalar(shown, keys) if mode == 4 else intensity_colour(shown, keys) if mode == 5 else shown}
    if mode in (0, 3):
        out["boxes"] = box_edges(drawn_boxes(boxes.where(F.col("frame_idx") == scene)), [*keys, "det_index"])
    if mode in (1, 3):
        out["tracks"] = overlay_tracks(snapshots)
    if mode in (2, 3):
        out["ellipses"] = overlay_ellipses(snapshots, scene)
    return out
