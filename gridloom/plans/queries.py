"""Queries over the driver's tables and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.config import GridConf, SceneConf, TrackConf
from gridloom.functions import motion
from gridloom.operators import classify, cluster, distance_field, filters, fusion, ground, neighbours, overlay, tracking, voxel
from gridloom.plans.scenes import process_frames, track_scenes
from gridloom.plans.surrogates import PTS_SQL, SNAPS_SQL, pts, snaps
from gridloom.storage import materialize

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _frames(points: DataFrame) -> DataFrame:
    return points.select("sequence_id", "frame_idx").distinct().withColumn("ts", F.col("frame_idx").cast("double"))


def _sums(df: DataFrame) -> list:
    whole = lambda c, f: F.round(F.col(c) * F.col("n") * f).cast("long").alias(f"sum_{c}")
    return [whole("x", 10), whole("y", 500000), whole("z", 100), whole("intensity", 100)]


_CELLS = "CAST(floor(x / 2e0) AS BIGINT) AS i, CAST(floor(y / 2e0) AS BIGINT) AS j, CAST(floor(z / 2e0) AS BIGINT) AS k"


@query(f"""WITH {PTS_SQL}, c AS (SELECT *, {_CELLS} FROM pts)
SELECT frame_idx, i, j, k, CAST(count(*) AS BIGINT) AS n, CAST(round(sum(x) * 10) AS BIGINT) AS sum_x, CAST(round(sum(y) * 500000) AS BIGINT) AS sum_y,
  CAST(round(sum(z) * 100) AS BIGINT) AS sum_z, CAST(round(sum(intensity) * 100) AS BIGINT) AS sum_intensity
FROM c GROUP BY frame_idx, i, j, k""")
def voxel_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = voxel.voxel_downsample(pts(spark, sf_dir), 2.0)
    return out.select("frame_idx", "i", "j", "k", "n", *_sums(out))


@query(f"""WITH {PTS_SQL}, c AS (SELECT *, {_CELLS} FROM pts), g AS (
  SELECT frame_idx, i * 73856093 + j * 19349663 + k * 83492791 AS voxel_key, count(*) AS n FROM c GROUP BY 1, 2)
SELECT frame_idx, voxel_key, CAST(n AS BIGINT) AS n, CAST(row_number() OVER (PARTITION BY frame_idx ORDER BY voxel_key) - 1 AS INT) AS pid FROM g""")
def voxel_hash_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxel.voxel_downsample(pts(spark, sf_dir), 2.0, by_key=True).select("frame_idx", "voxel_key", "n", "pid")


def _calibration(spark: SparkSession) -> DataFrame:
    """Sensor n is turned by n times 30 degrees and stands at (10 n, -5 n, n)."""
    s = spark.range(4).select(F.col("id").cast("int").alias("sensor"))
    a = F.col("sensor") * (F.pi() / 6)
    t = motion.matrix([[F.cos(a), -F.sin(a), 0, F.col("sensor") * 10], [F.sin(a), F.cos(a), 0, F.col("sensor") * -5], [0, 0, 1, F.col("sensor")], [0, 0, 0, 1]])
    return s.select("sensor", t.alias("t"))


@query(f"""WITH {PTS_SQL}, t AS (SELECT *, sensor * (pi() / 6) AS a FROM pts),
m AS (SELECT frame_idx, cos(a) * x - sin(a) * y + sensor * 10 AS x, sin(a) * x + cos(a) * y - sensor * 5 AS y, z + sensor AS z FROM t)
SELECT frame_idx, CAST(count(*) AS BIGINT) AS n, round(sum(x), 4) AS sum_x, round(sum(y), 4) AS sum_y, round(sum(z), 4) AS sum_z FROM m GROUP BY frame_idx""")
def rigid_transform_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = pts(spark, sf_dir).withColumn("coord_frame", F.lit("sensor"))
    fused = fusion.to_world(points, _calibration(spark))
    return fused.groupBy("frame_idx").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.sum(c), 4).alias(f"sum_{c}") for c in "xyz"])


@query(f"""WITH {PTS_SQL}, s AS (SELECT frame_idx, sensor, count(*) AS n FROM pts GROUP BY 1, 2)
SELECT frame_idx, string_agg(CAST(sensor AS VARCHAR), ',' ORDER BY CASE sensor WHEN 2 THEN 0 WHEN 0 THEN 1 ELSE 2 END) AS sensors,
  CAST(3 AS INT) AS num_inputs, max(CASE WHEN sensor = 2 THEN frame_idx * 1000 + n END) / 1000e0 AS ts
FROM s WHERE sensor IN (2, 0, 3) GROUP BY frame_idx""")
def sensor_fusion_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    sweeps = pts(spark, sf_dir).groupBy("sequence_id", "frame_idx", "sensor").agg(F.count(F.lit(1)).alias("n"))
    sweeps = sweeps.select("sequence_id", "frame_idx", F.col("sensor").cast("string").alias("sensor"), (F.col("frame_idx") * 1000 + F.col("n")).alias("ts_ms"), F.lit("f").alias("filename"))
    out = fusion.fused_frames(fusion.select_sensors(sweeps, ["2", "0", "3"]), ["2", "0", "3"])
    return out.select("frame_idx", F.array_join("sensors", ",").alias("sensors"), "num_inputs", "ts")


@query(f"""WITH {PTS_SQL}, f AS (SELECT DISTINCT frame_idx FROM pts),
g AS (SELECT frame_idx, lead(frame_idx) OVER (ORDER BY frame_idx) AS next_frame FROM f)
SELECT frame_idx, next_frame, CAST(next_frame - frame_idx AS DOUBLE) AS dt FROM g WHERE next_frame IS NOT NULL""")
def frame_pairs_dt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxel.with_next(_frames(pts(spark, sf_dir))).select("frame_idx", "next_frame", "dt")


_GRID = "CAST(floor(x / 0.5e0) AS BIGINT) AS i, CAST(floor(y / 0.5e0) AS BIGINT) AS j, CAST(floor(z / 0.5e0) AS BIGINT) AS k"
_SHIFTS = "sh AS (SELECT a.v AS di, b.v AS dj, c.v AS dk FROM (VALUES (-1), (0), (1)) a(v), (VALUES (-1), (0), (1)) b(v), (VALUES (-1), (0), (1)) c(v))"


# the same pairs by cells as wide as the gate and their 27 neighbours
@query(f"""WITH {PTS_SQL}, {_SHIFTS}, f AS (SELECT DISTINCT frame_idx FROM pts),
g AS (SELECT frame_idx, lead(frame_idx) OVER (ORDER BY frame_idx) AS next_frame FROM f),
a AS (SELECT pts.frame_idx, pid, x, y, z, next_frame, {_GRID} FROM pts JOIN g USING (frame_idx) WHERE next_frame IS NOT NULL),
b AS (SELECT frame_idx AS next_frame, pid AS rid, x AS bx, y AS by_, z AS bz, i + di AS i, j + dj AS j, k + dk AS k FROM (SELECT *, {_GRID} FROM pts), sh),
m AS (SELECT frame_idx, pid, min({{'d2': (x-bx)*(x-bx) + (y-by_)*(y-by_) + (z-bz)*(z-bz), 'rid': rid}}) AS m
  FROM a JOIN b USING (next_frame, i, j, k) WHERE (x-bx)*(x-bx) + (y-by_)*(y-by_) + (z-bz)*(z-bz) < 0.25e0 GROUP BY 1, 2)
SELECT a.frame_idx, a.pid, m.m.rid AS next_pid, m.m IS NOT NULL AS flow_valid FROM a LEFT JOIN m USING (frame_idx, pid)""")
def nn_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = pts(spark, sf_dir).select("sequence_id", "frame_idx", "pid", "x", "y", "z")
    return neighbours.nn_flow(points, voxel.with_next(_frames(points)), 0.5).select("frame_idx", "pid", "next_pid", "flow_valid")


def _scaled(points: DataFrame) -> DataFrame:
    return points.withColumn("z", F.col("z") * 0.5)


@query(f"""WITH {PTS_SQL}, p AS (SELECT frame_idx, pid, x, y, z * 0.5e0 AS z FROM pts)
SELECT a.frame_idx, a.pid, CAST(count(*) AS BIGINT) AS neighbours FROM p a JOIN p b ON a.frame_idx = b.frame_idx
  AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 0.5e0 * 0.5e0 GROUP BY 1, 2""")
def dbscan_core_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbour_counts(_scaled(pts(spark, sf_dir)), 0.5, cluster.KEYS).select("frame_idx", "pid", "neighbours")


@query()
def dbscan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.dbscan(pts(spark, sf_dir), 0.5, 5).select("frame_idx", "pid", "label")


_OBB = """g AS (SELECT frame_idx, sensor, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, avg(intensity) AS mi,
  coalesce(var_samp(x), 0) AS cxx, coalesce(covar_samp(x, y), 0) AS cxy, coalesce(var_samp(y), 0) AS cyy FROM pts GROUP BY 1, 2),
h AS (SELECT *, atan2(2 * cxy, cxx - cyy) / 2 AS half FROM g),
a AS (SELECT *, CASE WHEN cxy = 0 THEN CASE WHEN cxx > cyy THEN 0 ELSE pi() / 2 END WHEN cxy < 0 THEN half + pi() WHEN cxx < cyy THEN half ELSE half - pi() END AS yaw FROM h),
t AS (SELECT a.*, cos(yaw) * (x - mx) + sin(yaw) * (y - my) AS u, cos(yaw) * (y - my) - sin(yaw) * (x - mx) AS w, z - mz AS h FROM pts JOIN a USING (frame_idx, sensor)),
b AS (SELECT frame_idx, sensor, any_value(n) AS n, any_value(yaw) AS yaw, any_value(mi) AS mi, any_value(mx) AS mx, any_value(my) AS my,
  min(u) AS lu, max(u) AS hu, min(w) AS lw, max(w) AS hw, min(h) AS lh, max(h) AS hh FROM t GROUP BY 1, 2)"""


@query(f"""WITH {PTS_SQL}, {_OBB}
SELECT frame_idx, sensor, CAST(n AS BIGINT) AS n_points, round(yaw, 6) AS yaw, round(greatest(hu - lu, 1e-6), 6) AS sx, round(greatest(hw - lw, 1e-6), 6) AS sy, round(greatest(hh - lh, 1e-6), 6) AS sz,
  round(mx + cos(yaw) * (lu + hu) / 2 - sin(yaw) * (lw + hw) / 2, 6) AS cx, round(my + sin(yaw) * (lu + hu) / 2 + cos(yaw) * (lw + hw) / 2, 6) AS cy FROM b""")
def cluster_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = cluster.cluster_geometry(pts(spark, sf_dir), ["frame_idx", "sensor"])
    return boxes.select("frame_idx", "sensor", "n_points", *[F.round(c, 6).alias(c) for c in ("yaw", "sx", "sy", "sz", "cx", "cy")])


@query("""WITH s AS (SELECT event_type, round(value * 100) AS v, count(*) AS k FROM events GROUP BY 1, 2),
r AS (SELECT *, sum(k) OVER w AS n, sum(k * v) OVER w AS s, sum(k) OVER p AS nn, sum(k * v) OVER p AS ss FROM s
  WINDOW w AS (PARTITION BY event_type ORDER BY v), p AS (PARTITION BY event_type)),
b AS (SELECT event_type FROM s GROUP BY 1 HAVING NOT (max(v) < 0.3 OR min(v) > 1.5)),
c AS (SELECT event_type, arg_max(v, s * s / n + (ss - s) * (ss - s) / (nn - n)) AS cut FROM r JOIN b USING (event_type) WHERE n < nn GROUP BY 1)
SELECT event_type, CAST(count(*) FILTER (cut IS NULL OR round(value * 100) <= cut) AS BIGINT) AS slow, CAST(count(*) FILTER (round(value * 100) > cut) AS BIGINT) AS fast
FROM events LEFT JOIN c USING (event_type) GROUP BY 1""")
def split_by_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("v", F.round(F.col("value") * 100))
    parts = cluster.split_by_speed(events, "v", ["event_type"])
    return parts.groupBy("event_type").agg(F.count(F.when(F.col("part") == 0, 1)).alias("slow"), F.count(F.when(F.col("part") == 1, 1)).alias("fast"))


@query("""WITH RECURSIVE n AS (SELECT c_nationkey AS frame_idx, c_custkey AS pid, c_acctbal / 100e0 AS x, (c_custkey % 50) / 10e0 AS y, (c_custkey % 7) / 10e0 AS speed FROM customer),
e AS (SELECT a.frame_idx, a.pid, b.pid AS other FROM n a JOIN n b ON a.frame_idx = b.frame_idx AND a.pid <> b.pid
  AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) <= 1 AND abs(a.speed - b.speed) <= 0.5),
r AS (SELECT frame_idx, pid, pid AS root FROM n UNION SELECT r.frame_idx, e.pid, r.root FROM r JOIN e ON r.frame_idx = e.frame_idx AND r.pid = e.other)
SELECT frame_idx, pid, min(root) AS root FROM r GROUP BY 1, 2""")
def merge_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    rows = c.select(F.lit("s").alias("sequence_id"), F.col("c_nationkey").alias("frame_idx"), F.col("c_custkey").alias("pid"), (F.col("c_acctbal") / 100.0).alias("x"), (F.col("c_custkey") % 50 / 10.0).alias("y"), (F.col("c_custkey") % 7 / 10.0).alias("speed"))
    return cluster.merged_index(rows).select("frame_idx", "pid", "root")


@query(f"""WITH {SNAPS_SQL}, e AS (SELECT *, yaw + omega * 0.1e0 AS stop, abs(omega) < 1e-5 AS line FROM snaps)
SELECT event_id, round(CASE WHEN line THEN px + v * cos(yaw) * 0.1e0 ELSE px + v / omega * (sin(stop) - sin(yaw)) END, 6) AS px,
  round(CASE WHEN line THEN py + v * sin(yaw) * 0.1e0 ELSE py + v / omega * (cos(yaw) - cos(stop)) END, 6) AS py,
  round(((CASE WHEN line THEN yaw ELSE stop END + pi()) % (2 * pi()) + 2 * pi()) % (2 * pi()) - pi(), 6) AS yaw FROM e""")
def ctrv_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = snaps(spark, sf_dir)
    x = motion.ctrv(F.col("px"), F.col("py"), F.col("yaw"), F.col("v"), F.col("omega"), F.lit(0.1))
    return s.select("event_id", x.alias("n")).select("event_id", *[F.round(f"n.{c}", 6).alias(c) for c in ("px", "py", "yaw")])


@query(f"""WITH {SNAPS_SQL}, e AS (SELECT event_id, yaw, v, omega, abs(omega) < 1e-5 AS line, yaw + omega * 0.1e0 AS stop FROM snaps)
SELECT event_id, round(CASE WHEN line THEN -v * sin(yaw) * 0.1e0 ELSE -v / omega * (cos(yaw) - cos(stop)) END, 6) AS f02,
  round(CASE WHEN line THEN cos(yaw) * 0.1e0 ELSE (sin(stop) - sin(yaw)) / omega END, 6) AS f03,
  round(CASE WHEN line THEN 0 ELSE v * 0.1e0 * cos(stop) / omega - v * (sin(stop) - sin(yaw)) / (omega * omega) END, 6) AS f04,
  round(CASE WHEN line THEN v * cos(yaw) * 0.1e0 ELSE v / omega * (sin(stop) - sin(yaw)) END, 6) AS f12,
  round(CASE WHEN line THEN sin(yaw) * 0.1e0 ELSE (cos(yaw) - cos(stop)) / omega END, 6) AS f13,
  round(CASE WHEN line THEN 0 ELSE v * 0.1e0 * sin(stop) / omega - v * (cos(yaw) - cos(stop)) / (omega * omega) END, 6) AS f14, 0.1e0 AS f24 FROM e""")
def ctrv_jacobian(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = motion.ctrv_jacobian(F.col("yaw"), F.col("v"), F.col("omega"), F.lit(0.1))
    s = snaps(spark, sf_dir).select("event_id", j.alias("f"))
    picked = {f"f{a}{b}": F.round(motion.at(F.col("f"), a, b), 6) + 0.0 for a, b in ((0, 2), (0, 3), (0, 4), (1, 2), (1, 3), (1, 4))}
    return s.withColumns(picked).withColumn("f24", motion.at(F.col("f"), 2, 4)).drop("f")


@query(f"""WITH {SNAPS_SQL} SELECT event_id, round(v * cos(yaw), 6) AS vx, round(v * sin(yaw), 6) AS vy, round(cos(yaw), 6) AS t00, round(sin(yaw), 6) AS t10,
  round(px, 6) AS t03, round(py, 6) AS t13, round(((yaw + pi()) % (2 * pi()) + 2 * pi()) % (2 * pi()) - pi(), 6) AS yaw FROM snaps""")
def pose_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = snaps(spark, sf_dir).withColumn("t", motion.pose(F.col("px"), F.col("py"), F.col("pz"), F.col("yaw")))
    s = s.withColumn("s", motion.state_of(F.col("t"))).withColumn("w", motion.velocity_xy(F.col("yaw"), F.col("v")))
    return s.select("event_id", F.round("w.vx", 6).alias("vx"), F.round("w.vy", 6).alias("vy"), *[F.round(motion.at(F.col("t"), a, b), 6).alias(f"t{a}{b}") for a, b in ((0, 0), (1, 0))], F.round("s.px", 6).alias("t03"), F.round("s.py", 6).alias("t13"), F.round(motion.wrap_angle(F.col("s.yaw")), 6).alias("yaw"))


@query("""SELECT p_partkey, round(greatest(sqrt(30e0 / least(greatest(p_size, 1), 30)), greatest(1, least(3, 1 / greatest(greatest(p_retailprice / 3000, p_size / 40e0), 0.2)))), 6) AS scale,
  round((abs(p_retailprice / 1000 - 1) / greatest(1e-6, (abs(p_retailprice / 1000) + 1) / 2) + abs(p_size / 10e0 - 2) / greatest(1e-6, (p_size / 10e0 + 2) / 2) + 0) / 3, 6) AS deviation FROM part""")
def noise_and_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    scale = motion.noise_scale(F.col("p_size"), F.col("p_retailprice") / 3000, F.col("p_size") / 40.0)
    shape = motion.shape_deviation([F.col("p_retailprice") / 1000, F.col("p_size") / 10.0, F.lit(1.0)], [F.lit(1.0), F.lit(2.0), F.lit(1.0)])
    return p.select("p_partkey", F.round(scale, 6).alias("scale"), F.round(shape, 6).alias("deviation"))


@query(f"""WITH {SNAPS_SQL}, t AS (SELECT day, event_id AS tid, value * 10 AS px, py * 50 AS py, yaw, 4 + event_id % 3 AS sx FROM snaps),
d AS (SELECT day - 1 AS day, event_id AS did, value * 10 AS cx, py * 50 AS cy, yaw, 4 + event_id % 2 AS sx, event_id % 40 AS n FROM snaps),
m AS (SELECT t.day, tid, did, cx - px AS dx, cy - py AS dy, ((d.yaw - t.yaw + pi()) % (2 * pi()) + 2 * pi()) % (2 * pi()) - pi() AS da,
  greatest(sqrt(30e0 / least(greatest(n, 1), 30)), 1) AS s, abs(t.sx - d.sx) / ((t.sx + d.sx) / 2e0) / 3 AS shape FROM t JOIN d ON t.day = d.day AND abs(cx - px) <= 5 AND abs(cy - py) <= 5),
c AS (SELECT *, dx * dx / (1 + pow(0.3e0 * s, 2)) + dy * dy / (1 + pow(0.3e0 * s, 2)) + da * da / (0.5e0 + pow(radians(8e0) * s, 2)) AS d2 FROM m WHERE dx * dx + dy * dy <= 25)
SELECT day, tid, did, round(sqrt(d2) + 0.05e0 * shape, 6) AS cost FROM c WHERE d2 <= 16 AND shape <= 2""")
def gated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = snaps(spark, sf_dir)
    one = F.lit(1.0)
    t = s.select("day", F.col("event_id").alias("tid"), (F.col("value") * 10).alias("px"), (F.col("py") * 50).alias("py"), "yaw", (4 + F.col("event_id") % 3).alias("sx"), "sy", "sz", one.alias("pxx"), one.alias("pyy"), F.lit(0.5).alias("paa"))
    d = s.select((F.col("day") - 1).alias("day"), F.col("event_id").alias("did"), (F.col("value") * 10).alias("cx"), (F.col("py") * 50).alias("cy"), "yaw", (4 + F.col("event_id") % 2).alias("sx"), "sy", "sz", (F.col("event_id") % 40).alias("n_points"))
    return tracking.gated_pairs(t, d, ["day"]).select("day", "tid", "did", F.round("cost", 6).alias("cost"))


@query(f"""WITH {PTS_SQL}, m AS (SELECT frame_idx, pid, pid % 11 AS det FROM pts WHERE pid % 3 <> 0 UNION ALL SELECT frame_idx, pid, pid % 17 FROM pts WHERE pid % 4 = 1),
l AS (SELECT frame_idx, pid, max(det) AS det FROM m WHERE det % 5 <> 2 GROUP BY 1, 2)
SELECT pts.frame_idx, pts.pid, CAST(coalesce(l.frame_idx * 100 + l.det, -1) AS BIGINT) AS entity_id FROM pts LEFT JOIN l USING (frame_idx, pid)""")
def point_to_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pts(spark, sf_dir).select("sequence_id", "frame_idx", "pid")
    m = p.where("pid % 3 <> 0").withColumn("det_index", F.col("pid") % 11).unionByName(p.where("pid % 4 = 1").withColumn("det_index", F.col("pid") % 17))
    entities = m.where("det_index % 5 <> 2").select("sequence_id", "frame_idx", "det_index", (F.col("frame_idx") * 100 + F.col("det_index")).cast("long").alias("entity_id")).distinct()
    return tracking.point_entities(p, m, entities).select("frame_idx", "pid", "entity_id")


@query(f"""WITH {PTS_SQL}, m AS (SELECT frame_idx, pid, max(pid % 13) AS det FROM pts WHERE pid % 3 <> 0 GROUP BY 1, 2)
SELECT pts.frame_idx, pts.pid, CAST(coalesce(det, -1) AS BIGINT) AS det_index FROM pts LEFT JOIN m USING (frame_idx, pid)""")
def cluster_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pts(spark, sf_dir).select("sequence_id", "frame_idx", "pid")
    return cluster.point_labels(p, p.where("pid % 3 <> 0").withColumn("det_index", F.col("pid") % 13)).select("frame_idx", "pid", "det_index")


@query(f"""WITH {SNAPS_SQL}, p AS (SELECT day, event_id AS tid, CASE WHEN event_id % 4 < 2 THEN event_id + 1 - 2 * (event_id % 2) ELSE event_id END AS did, event_id AS last_did, value / 20 AS cost FROM snaps)
SELECT day, tid, did, last_did FROM p WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.day = p.day AND p.did = b.last_did AND p.last_did = b.did AND p.tid <> b.tid AND p.cost > 2.5 AND b.cost > 2.5)""")
def swap_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    p = snaps(spark, sf_dir).select("day", e.alias("tid"), F.when(e % 4 < 2, e + 1 - 2 * (e % 2)).otherwise(e).alias("did"), e.alias("last_did"), (F.col("value") / 20).alias("cost"))
    return tracking.suppressed_swaps(p, ["day"], 2.5).select("day", "tid", "did", "last_did")


_CLASSIFY = """seed AS (SELECT entity_id, avg(v) < 0.3 AS was, count(*) AS n FROM snaps GROUP BY 1),
w AS (SELECT *, max(ts) OVER (PARTITION BY entity_id) AS tmax, row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, scene_idx DESC) AS rn FROM snaps),
c AS (SELECT *, count(*) FILTER (ts >= tmax - 2) OVER (PARTITION BY entity_id) AS n2, count(*) FILTER (ts >= tmax - 5) OVER (PARTITION BY entity_id) AS n5 FROM w),
s AS (SELECT * FROM c WHERE (n2 >= 2 AND ts >= tmax - 2) OR (n2 < 2 AND rn <= 2)),
l AS (SELECT * FROM c WHERE (n5 >= 2 AND ts >= tmax - 5) OR (n5 < 2 AND rn <= 2)),
b AS (SELECT *, lag(px) OVER o AS bx, lag(py) OVER o AS by_, lag(yaw) OVER o AS ba FROM s WINDOW o AS (PARTITION BY entity_id ORDER BY ts, scene_idx)),
ov AS (SELECT entity_id, avg(CASE WHEN abs(cos(ba) * (px - bx) + sin(ba) * (py - by_)) <= 2.001 AND abs(cos(ba) * (py - by_) - sin(ba) * (px - bx)) <= 2.001 THEN 1e0 ELSE 0 END) AS overlap FROM b WHERE bx IS NOT NULL GROUP BY 1),
near AS (SELECT entity_id, avg(abs(v)) AS vm, sqrt(pow(arg_max(px, ts) - arg_min(px, ts), 2) + pow(arg_max(py, ts) - arg_min(py, ts), 2)) AS gone, max(ts) - min(ts) AS span FROM s GROUP BY 1),
far AS (SELECT entity_id, sqrt(pow(arg_max(px, ts) - arg_min(px, ts), 2) + pow(arg_max(py, ts) - arg_min(py, ts), 2)) AS travel FROM l GROUP BY 1),
f AS (SELECT seed.*, vm, CASE WHEN span < 1e-3 THEN 0 ELSE gone / span END AS drift, travel, coalesce(overlap, 0) AS overlap FROM seed LEFT JOIN near USING (entity_id) LEFT JOIN far USING (entity_id) LEFT JOIN ov USING (entity_id)),
judged AS (SELECT entity_id, was, CASE WHEN n < 2 THEN was WHEN was THEN NOT (travel > 3.0 AND (vm > 1.6 OR drift > 2.2 OR overlap < 0.10))
  ELSE (vm < 1.4 AND drift < 1.6 AND overlap > 0.20 AND travel < 2.4) END AS is_static FROM f)"""


def _histories(s: DataFrame) -> DataFrame:
    h = s.groupBy("sequence_id", "entity_id").agg(F.avg("v").alias("mean_speed"))
    return h.withColumns({"is_confirmed": F.lit(True), "is_static": F.col("mean_speed") < 0.3})


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = snaps(spark, sf_dir)
    centres = s.select("sequence_id", "entity_id", "scene_idx", F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"))
    return s, classify.classify_tracks(_histories(s), s, centres)


@query(f"WITH {SNAPS_SQL}, {_CLASSIFY} SELECT entity_id, was, is_static FROM judged")
def static_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, judged = _judged(spark, sf_dir)
    return judged.select("entity_id", "is_static").join(_histories(s).select("entity_id", F.col("is_static").alias("was")), "entity_id")


@query(f"""WITH {SNAPS_SQL}, {_CLASSIFY}, r AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN -1 WHEN event_id % 10 = 1 THEN entity_id + 1000000 ELSE entity_id END AS entity_id FROM snaps)
SELECT event_id, CASE WHEN r.entity_id >= 0 AND coalesce(is_static, false) THEN r.entity_id ELSE -1 END AS still,
  CASE WHEN r.entity_id >= 0 AND NOT coalesce(is_static, false) THEN r.entity_id ELSE -1 END AS moving FROM r LEFT JOIN judged USING (entity_id)""")
def filter_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, judged = _judged(spark, sf_dir)
    judged = materialize(judged, "judged")
    e = F.col("event_id") % 10
    rows = s.select("sequence_id", "event_id", F.when(e == 0, F.lit(-1)).when(e == 1, F.col("entity_id") + 1000000).otherwise(F.col("entity_id")).cast("long").alias("entity_id"))
    both = [filters.filter_tracking({"histories": judged, "observations": s, "det_to_track": rows}, k)["det_to_track"].select("event_id", F.col("entity_id").alias(n)) for k, n in ((True, "still"), (False, "moving"))]
    return both[0].join(both[1], "event_id")


@query(f"""WITH {SNAPS_SQL}, {_CLASSIFY} SELECT snaps.entity_id, CAST(count(*) AS BIGINT) AS n FROM snaps JOIN judged USING (entity_id) WHERE is_static GROUP BY 1""")
def filter_static_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, judged = _judged(spark, sf_dir)
    return filters.filter_tracks(s, filters.filter_histories(judged, True)).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))


_GRID = GridConf(voxel_size=0.5)
_FIELD = """g AS (SELECT min(x) - 2 AS x0, min(y) - 2 AS y0, min(z) - 2 AS z0 FROM pts),
v AS (SELECT x, y, z, x0, y0, z0, CAST(floor((x - x0) / 0.5e0) AS BIGINT) AS ix, CAST(floor((y - y0) / 0.5e0) AS BIGINT) AS iy, CAST(floor((z - z0) / 0.5e0) AS BIGINT) AS iz FROM pts, g),
d AS (SELECT ix, iy, iz, x - ((ix + 0.5e0) * 0.5e0 + x0) AS dx, y - ((iy + 0.5e0) * 0.5e0 + y0) AS dy, z - ((iz + 0.5e0) * 0.5e0 + z0) AS dz FROM v),
field AS (SELECT ix, iy, iz, avg(1 - least(greatest(sqrt(dx*dx + dy*dy + dz*dz) / 1e0, 0), 1)) AS tsdf, CAST(count(*) AS BIGINT) AS weight FROM d GROUP BY 1, 2, 3)"""


@query(f"WITH {PTS_SQL}, {_FIELD} SELECT ix, iy, iz, round(tsdf, 6) AS tsdf, weight FROM field")
def tsdf_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, field = distance_field.reconstruct(pts(spark, sf_dir), _GRID)
    return field.select("ix", "iy", "iz", F.round("tsdf", 6).alias("tsdf"), "weight")


@query(f"""WITH {PTS_SQL}, {_FIELD}, o AS (SELECT * FROM field WHERE tsdf > 0.5), w AS (SELECT * FROM (VALUES (0, -1), (0, 1), (1, -1), (1, 1), (2, -1), (2, 1)) AS t(axis, way)),
j AS (SELECT o.ix, o.iy, o.iz, axis, way, ix + CASE axis WHEN 0 THEN way ELSE 0 END AS jx, iy + CASE axis WHEN 1 THEN way ELSE 0 END AS jy, iz + CASE axis WHEN 2 THEN way ELSE 0 END AS jz FROM o, w)
SELECT ix, iy, iz, axis, way FROM j WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.ix = jx AND o.iy = jy AND o.iz = jz)""")
def iso_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, field = distance_field.reconstruct(pts(spark, sf_dir), _GRID)
    return distance_field.iso_vertices(materialize(field, "field"), _GRID).select("ix", "iy", "iz", "axis", "way")


@query()
def iso_mesh_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid, field = distance_field.reconstruct(pts(spark, sf_dir), _GRID)
    return distance_field.iso_mesh(materialize(field, "field"), materialize(grid, "grid"), _GRID)[1]


@query(f"""WITH {SNAPS_SQL}, l AS (SELECT entity_id, scene_idx, px, py, lead(px) OVER w AS next_px, lead(py) OVER w AS next_py FROM snaps WINDOW w AS (PARTITION BY entity_id ORDER BY scene_idx, ts))
SELECT entity_id, scene_idx, px, py, next_px, next_py FROM l WHERE next_px IS NOT NULL""")
def overlay_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.overlay_tracks(snaps(spark, sf_dir)).select("entity_id", "scene_idx", "px", "py", "next_px", "next_py")


@query(f"""WITH {SNAPS_SQL}, c AS (SELECT event_id, px, py, 1 + event_id % 5 AS a, (event_id % 3 - 1) / 2e0 AS b, 1 + event_id % 4 AS d FROM snaps),
e AS (SELECT *, (a + d) / 2e0 AS m, sqrt((a - d) * (a - d) / 4e0 + b * b) AS g, atan2(2 * b, a - d) / 2 AS t FROM c),
k AS (SELECT e.*, CAST(range AS INT) AS k FROM e, range(64))
SELECT event_id, k, round(px + cos(t) * 2 * sqrt(greatest(m + g, 1e-9)) * cos(k * (2 * pi() / 64)) - sin(t) * 2 * sqrt(greatest(m - g, 1e-9)) * sin(k * (2 * pi() / 64)), 6) + 0e0 AS x,
  round(py + sin(t) * 2 * sqrt(greatest(m + g, 1e-9)) * cos(k * (2 * pi() / 64)) + cos(t) * 2 * sqrt(greatest(m - g, 1e-9)) * sin(k * (2 * pi() / 64)), 6) + 0e0 AS y FROM k""")
def overlay_ellipses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    shape = overlay.ellipse(F.col("px"), F.col("py"), 1 + e % 5, (e % 3 - 1) / 2.0, 1 + e % 4)
    return snaps(spark, sf_dir).select("event_id", F.posexplode(shape).alias("k", "at")).select("event_id", "k", (F.round("at.x", 6) + 0.0).alias("x"), (F.round("at.y", 6) + 0.0).alias("y"))


@query(f"""WITH {PTS_SQL}, {_OBB}, s AS (SELECT frame_idx, sensor, greatest(hu - lu, 1e-6) AS sx, greatest(hw - lw, 1e-6) AS sy, greatest(hh - lh, 1e-6) AS sz, abs(cos(yaw)) AS c, abs(sin(yaw)) AS n FROM b),
span AS (SELECT *, sqrt(pow(c * sx + n * sy, 2) + pow(n * sx + c * sy, 2) + sz * sz) AS diag FROM s)
SELECT frame_idx, sensor, round(diag, 6) AS diag FROM span WHERE diag BETWEEN 0.1 AND 45""")
def overlay_box_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = overlay.drawn_boxes(cluster.cluster_geometry(pts(spark, sf_dir), ["frame_idx", "sensor"]), 0.1, 45.0)
    return boxes.select("frame_idx", "sensor", F.round(overlay.diagonal(F.col("corners")), 6).alias("diag"))


@query()
def overlay_box_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.box_edges(cluster.cluster_geometry(pts(spark, sf_dir), ["frame_idx", "sensor"]), ["frame_idx", "sensor"])


_PALETTE_SQL = "CASE CAST(entity_id % 10 AS INT) " + " ".join(f"WHEN {n} THEN {c[0]}e0" for n, c in enumerate(overlay.PALETTE)) + " END"


@query(f"""WITH {PTS_SQL}, r AS (SELECT frame_idx, pid, intensity, CASE WHEN pid % 5 = 0 THEN -1 WHEN pid % 7 = 0 THEN NULL ELSE pid END AS entity_id,
  min(intensity) OVER (PARTITION BY frame_idx) AS lo, max(intensity) OVER (PARTITION BY frame_idx) AS hi FROM pts)
SELECT frame_idx, pid, CAST(CASE WHEN entity_id IS NULL THEN 0.75e0 WHEN entity_id < 0 THEN 0.6e0 ELSE {_PALETTE_SQL} END AS DOUBLE) AS red, round((intensity - lo) / (hi - lo + 1e-9), 6) AS warm FROM r""")
def overlay_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = overlay.intensity_colour(overlay.finite_points(pts(spark, sf_dir)), ["frame_idx"])
    label = F.when(F.col("pid") % 5 == 0, F.lit(-1)).when(F.col("pid") % 7 == 0, F.lit(None)).otherwise(F.col("pid"))
    return p.select("frame_idx", "pid", F.get(overlay.id_colour(label), F.lit(0)).alias("red"), F.round(F.get("colour", F.lit(0)), 6).alias("warm"))


@query()
def ransac_ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pts(spark, sf_dir)
    return ground.mark_ground(p).groupBy("frame_idx").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_ground"), 1)).alias("n_ground"))


@query()
def ekf_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of sensors per month, followed from month to month."""
    p = pts(spark, sf_dir)
    boxes = cluster.cluster_geometry(p, ["sequence_id", "frame_idx", "sensor"]).withColumnRenamed("sensor", "det_index").withColumns({"vx": F.lit(0.0), "vy": F.lit(0.0)})
    out = tracking.track(_frames(p), boxes, TrackConf())
    return out.select("entity_id", "scene_idx", "det_index", "px", "py", "yaw", "v", "is_confirmed", "survived")


@query()
def scene_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points to classified tracks: thinning, ground, flow, clusters, boxes, tracking, labels."""
    p = pts(spark, sf_dir)
    found = track_scenes(process_frames(p, _frames(p), SceneConf(velocity_max_dist=0.5)))
    return found["histories"].select("entity_id", "is_confirmed", "mean_speed", "is_static")
