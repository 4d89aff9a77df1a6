"""The driver's tables read as points, frames and tracks, in Spark and, word for word, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PTS = """
SELECT 's' AS sequence_id, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INT) AS frame_idx, CAST(l_suppkey % 4 AS INT) AS sensor,
  l_quantity * 0.4e0 AS x, l_extendedprice / 5000e0 AS y, l_discount * 20e0 AS z, l_tax AS intensity,
  CAST(row_number() OVER (PARTITION BY year(l_shipdate) * 12 + month(l_shipdate) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS BIGINT) AS pid
FROM lineitem"""

SNAPS = """
SELECT 's' AS sequence_id, user_id AS entity_id, event_id, CAST({us} / 86400000000e0 AS DOUBLE) AS ts, CAST(floor({us} / 86400000000e0) AS INT) AS day,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY {us}, event_id) AS INT) AS scene_idx,
  value / 20e0 AS px, {k} / 25e0 AS py, 0e0 AS pz, (event_id % 628) / 100e0 - 3.14e0 AS yaw,
  (value - 48e0) / 20e0 AS v, ((event_id % 7) - 3) / 10e0 AS omega, 4e0 AS sx, 4e0 AS sy, 2e0 AS sz, value, event_type
FROM events"""
_SPARK = {"us": "unix_micros(CAST(ts AS TIMESTAMP))", "k": "CAST(get_json_object(props, '$.k') AS INT)"}
_DUCK = {"us": "epoch_us(ts)", "k": "CAST(json_extract_string(props, '$.k') AS INT)"}

PTS_SQL = f"pts AS ({PTS})"
SNAPS_SQL = f"snaps AS ({SNAPS.format(**_DUCK)})"


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as points: a month is a frame, the supplier tells the sensor."""
    return spark.sql(PTS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def snaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as snapshots of tracks: a user is an entity, days stand in for seconds."""
    return spark.sql(SNAPS.format(**_SPARK).replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
