"""Keeping the standing or the moving part of a tracking result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTITY = ["sequence_id", "entity_id"]


def filter_histories(histories: DataFrame, keep_static: bool) -> DataFrame:
    return histories.where(F.col("is_static") == F.lit(keep_static))


def filter_tracks(tracks: DataFrame, kept: DataFrame) -> DataFrame:
    """Tracks whose entity is among ``kept``."""
    return tracks.join(kept.select(*ENTITY), ENTITY, "left_semi")


def mask_entities(rows: DataFrame, histories: DataFrame, keep_static: bool) -> DataFrame:
    """``rows`` (.., entity_id) with entities of the other kind set to -1; an unknown entity counts as moving."""
    known = histories.select(*ENTITY, F.col("is_static").alias("_static"))
    out = rows.join(known, ENTITY, "left")
    kind = F.coalesce("_static", F.lit(False)) == F.lit(keep_static)
    masked = F.when(kind & (F.col("entity_id") >= 0), F.col("entity_id")).otherwise(F.lit(-1))
    return out.withColumn("entity_id", masked).select(*rows.columns)


def filter_tracking(result: dict[str, DataFrame], keep_static: bool) -> dict[str, DataFrame]:
    """A tracking result (histories, observations, det_to_track, point_to_entity if any) of one kind of entity."""
    kept = filter_histories(result["histories"], keep_static)
    out = {"histories": kept, "observations": filter_tracks(result["observations"], kept)}
    for name in ("det_to_track", "point_to_entity"):
        if result.get(name) is not None:
            out[name] = mask_entities(result[name], result["histories"], keep_static)
    return out
