"""Small clouds, boxes and sequences whose answers are known."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.config import GridConf, SceneConf, TrackConf
from gridloom.functions import motion
from gridloom.operators import classify, cluster, components, distance_field, filters, fusion, ground, neighbours, overlay, tracking, voxel
from gridloom.operators.components import connected_components
from gridloom.plans import queries, scenes

POINTS = "sequence_id string, frame_idx int, pid long, x double, y double, z double, intensity double"


def cloud(spark, rows, frame=0):
    return spark.createDataFrame([("s", frame, i, *map(float, r), 1.0) if len(r) == 3 else ("s", frame, i, *map(float, r)) for i, r in enumerate(rows)], POINTS)


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_voxels_floor_and_average(spark):
    p = cloud(spark, [(0.01, 0.01, 0.01, 2), (0.03, 0.03, 0.03, 4), (0.07, 0.01, 0.01, 9), (-0.01, 0, 0, 1), (float("nan"), 0, 0, 1)])
    got = {(r.i, r.j, r.k): (round(r.x, 6), r.intensity, r.n) for r in voxel.voxel_downsample(p).collect()}
    assert got == {(0, 0, 0): (0.02, 3.0, 2), (1, 0, 0): (0.07, 9.0, 1), (-1, 0, 0): (-0.01, 1.0, 1)}


def test_transform(spark):
    t = motion.matrix([[0, -1, 0, 10], [1, 0, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]])
    r = fusion.transform_points(cloud(spark, [(1, 0, 0, 7)]), t).first()
    assert (r.x, r.y, r.z, r.intensity) == (10.0, 1.0, 0.0, 7.0)


def test_fusion_needs_every_pose_and_sensor(spark):
    p = cloud(spark, [(1, 0, 0)]).withColumns({"sensor": F.lit("a"), "coord_frame": F.lit("sensor")})
    none = spark.createDataFrame([], "sensor string, t array<array<double>>")
    with pytest.raises(Exception, match="extrinsics"):
        fusion.to_world(p, none).collect()
    assert fusion.to_world(p.withColumn("coord_frame", F.lit("world")), none).count() == 1
    with pytest.raises(Exception, match="lacks a sensor"):
        fusion.select_sensors(p, ["a", "b"]).collect()


def test_flow_gate_is_strict_and_small_steps_count(spark):
    frames = spark.createDataFrame([("s", 0, 0.0), ("s", 1, 0.1)], "sequence_id string, frame_idx int, ts double")
    p = cloud(spark, [(0, 0, 0), (5, 0, 0)]).union(cloud(spark, [(0.5, 0, 0), (7, 0, 0)], 1))
    got = {r.pid: (round(r.vx, 6), r.flow_valid) for r in neighbours.nn_flow(p, voxel.with_next(frames)).collect()}
    assert got == {0: (5.0, True), 1: (0.0, False)}
    still = spark.createDataFrame([("s", 0, 0.0), ("s", 1, 0.0)], "sequence_id string, frame_idx int, ts double")
    q = cloud(spark, [(0, 0, 0)]).union(cloud(spark, [(1e-3, 0, 0)], 1))
    assert round(neighbours.nn_flow(q, voxel.with_next(still)).first().vx, 6) == 1000.0


def copies_and_rows(rng, n):
    """Points on lines, many of them more than once, over several blocks of a radius of 0.5."""
    p = np.stack([rng.integers(-15, 15, n) * 0.4, rng.integers(-400, 400, n) * 0.02, rng.integers(0, 6, n) * 0.1], axis=1)
    return np.concatenate([p, p[: n // 3], np.repeat(p[:1], 50, axis=0)])


def no_pairs(*args, **kwargs):
    raise AssertionError("a row per pair")


def test_neighbours_are_counted_without_a_row_per_pair(spark, monkeypatch):
    for module in (neighbours, cluster):
        monkeypatch.setattr(module, "near_pairs", no_pairs)
    p = copies_and_rows(np.random.default_rng(5), 400) * 2.5
    rows = [("s", i, *map(float, r), 1.0) for i, r in enumerate([*p.tolist(), [float("nan"), 0, 0], [0, float("inf"), 0]])]
    monkeypatch.setattr(queries, "pts", lambda *_: spark.createDataFrame([(r[0], 0, *r[1:]) for r in rows], POINTS))
    d = p[:, None] * [1, 1, 0.5] - p[None] * [1, 1, 0.5]
    want = ((d**2).cumsum(axis=2)[:, :, 2] <= 0.25).sum(axis=1)
    got = {r.pid: r.neighbours for r in queries.dbscan_core_points(spark, "").collect()}
    assert got == dict(enumerate(want.tolist()))


def test_flow_without_a_row_per_pair(spark, monkeypatch):
    """Of equally near points the smallest pid, copies too; points without distance stay and have none."""
    monkeypatch.setattr(neighbours, "near_pairs", no_pairs)
    rng = np.random.default_rng(6)
    p, q = copies_and_rows(rng, 300) * 2.5, copies_and_rows(rng, 300) * 2.5
    points = cloud(spark, [*p.tolist(), [float("nan"), 0, 0]]).union(cloud(spark, [*q.tolist(), [float("nan"), 0, 0]], 1))
    frames = spark.createDataFrame([("s", 0, 0.0), ("s", 1, 0.5)], "sequence_id string, frame_idx int, ts double")
    out = {r.pid: r for r in neighbours.nn_flow(points, voxel.with_next(frames), 0.5).collect()}
    d2 = ((p[:, None] - q[None]) ** 2).cumsum(axis=2)[:, :, 2]
    for i, d in enumerate(d2):
        best = int(d.argmin())
        met = d[best] < 0.25
        assert (out[i].next_pid, out[i].flow_valid) == ((best, True) if met else (None, False))
        assert [out[i].vx, out[i].vz] == (((q[best] - p[i]) / 0.5)[[0, 2]].tolist() if met else [0.0, 0.0])
    assert len(out) == len(p) + 1 and not out[len(p)].flow_valid


def brute_dbscan(p, eps, least):
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1)) <= eps
    core, label, n = d.sum(1) >= least, np.full(len(p), -1), 0
    for i in range(len(p)):
        if core[i] and label[i] < 0:
            todo = [i]
            label[i] = n
            while todo:
                k = todo.pop()
                for j in np.flatnonzero(d[k] & core & (label < 0)):
                    label[j] = n
                    todo.append(j)
            n += 1
    for i in np.flatnonzero(~core):
        near = label[d[i] & core]
        label[i] = near.min() if len(near) else -1
    return label


def test_dbscan_against_brute_force(spark):
    rng = np.random.default_rng(3)
    p = np.concatenate([rng.normal(c, 0.5, (25, 3)) for c in ((0, 0, 0), (3, 0, 0), (0, 6, 2))] + [rng.uniform(-4, 9, (25, 3))])
    want = brute_dbscan(p * [1, 1, 0.5], 0.72, 5)
    got = {r.pid: r.label for r in cluster.dbscan(cloud(spark, p.tolist()), 0.72, 5).collect()}
    assert [got[i] for i in range(len(p))] == want.tolist()


def test_dbscan_over_blocks_without_a_row_per_pair(spark, monkeypatch):
    """Clusters that reach over several blocks, border points between clusters, copies and points without distance."""
    monkeypatch.setattr(cluster, "near_pairs", no_pairs)
    rng = np.random.default_rng(7)
    p = np.concatenate([copies_and_rows(rng, 500) * [2, 2, 4], np.stack([np.linspace(-20, 20, 200), np.full(200, 3.0), np.zeros(200)], axis=1), rng.uniform(-12, 12, (400, 3)) * [1, 1, 0.1]])
    p = p[rng.permutation(len(p))]
    for least in (3, 6):
        want = brute_dbscan(p * [1, 1, 0.5], 0.5, least)
        got = {r.pid: r.label for r in cluster.dbscan(cloud(spark, [*p.tolist(), [float("nan"), 0, 0]]).withColumn("x", F.when(F.col("pid") < len(p), F.col("x"))), 0.5, least).collect()}
        assert [got[i] for i in range(len(p))] == want.tolist() and got[len(p)] == -1
        assert len(set(want.tolist())) > 5


@pytest.mark.parametrize("held", [500_000, 12])
def test_components_of_chains_and_stars(spark, monkeypatch, held):
    monkeypatch.setattr(components, "FOREST_EDGES", held)
    rng = np.random.default_rng(0)
    order = rng.permutation(60).tolist()
    edges = list(zip(order, order[1:])) + [(100, 100 + i) for i in range(1, 20)] + [(7, 7), (None, 3)]
    want = {**{i: 0 for i in range(60)}, **{100 + i: 100 for i in range(20)}}
    for kind in ("long", "int", "string"):
        df = spark.createDataFrame(edges, "a long, b long").select(*[(F.lpad(c, 3, "0") if kind == "string" else F.col(c).cast(kind)).alias(c) for c in "ab"])
        assert {int(r.node): int(r.component) for r in connected_components(df.repartition(7)).collect()} == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("turn", [0.0, 30.0, 75.0, 120.0])
def test_box_of_a_turned_rectangle(spark, turn):
    a = math.radians(turn)
    pts = [(x * math.cos(a) - y * math.sin(a), x * math.sin(a) + y * math.cos(a), z) for x in (-2, 2) for y in (-0.5, 0.5) for z in (0, 1)]
    r = cluster.cluster_geometry(cloud(spark, pts).withColumn("det_index", F.lit(0))).first()
    assert np.allclose([r.cx, r.cy, r.cz, r.sx, r.sy, r.sz], [0, 0, 0.5, 4, 1, 1], atol=1e-6)
    assert abs((r.yaw - a + math.pi / 2) % math.pi - math.pi / 2) < 1e-6
    p = np.array(pts) - [0, 0, 0.5]
    assert np.allclose(np.array(r.cov), p.T @ p / 7, atol=1e-9)
    assert np.allclose(np.array(r.corners).mean(0), [0, 0, 0.5], atol=1e-9)


def test_single_point_cluster(spark):
    r = cluster.cluster_geometry(cloud(spark, [(1, 2, 3)]).withColumn("det_index", F.lit(0))).first()
    assert (r.cx, r.cy, r.cz, r.sx, r.sy, r.sz) == (1.0, 2.0, 3.0, 1e-6, 1e-6, 1e-6)


def test_split_by_speed(spark):
    def parts(speeds):
        df = spark.createDataFrame([("s", i, v) for i, v in enumerate(speeds)], "c string, i int, v double")
        return [r.part for r in cluster.split_by_speed(df, "v", ["c"]).orderBy("i").collect()]

    assert parts([0.0, 0.1, 5.0, 5.1]) == [0, 0, 1, 1]
    assert parts([1.0, 1.0, 1.0]) == [0, 0, 0]
    assert parts([0.0, 0.1, 0.2]) == [0, 0, 0] and parts([2.0, 9.0]) == [0, 0]
    rng = np.random.default_rng(1)
    v = sorted(rng.gamma(2, 1, 12).tolist())
    sse = lambda c: sum(np.var(g) * len(g) for g in (v[:c], v[c:]))
    assert parts(v).index(1) == min(range(1, 12), key=sse)


def test_merge_is_a_chain(spark):
    rows = [("s", 0, i, 0.9 * i, 0.0, 0.4 * i) for i in range(3)] + [("s", 0, 3, 50.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "sequence_id string, frame_idx int, pid long, x double, y double, speed double")
    assert {r.pid: r.merged for r in cluster.merged_index(df).collect()} == {0: 0, 1: 0, 2: 0, 3: 1}


def test_low_clusters_go(spark):
    rows = [("s", 0, i, h, n) for i, (h, n) in enumerate([(0.39, 9), (0.41, 9), (2.0, 4), (1.0, 5)])]
    boxes = spark.createDataFrame(rows, "sequence_id string, frame_idx int, det_index int, sz double, n_points long")
    members = boxes.select("sequence_id", "frame_idx", "det_index", F.col("det_index").alias("pid"))
    m, c = cluster.filter_clusters(members, boxes)
    assert [(r.det_index, r.sz) for r in c.orderBy("det_index").collect()] == [(0, 0.41), (1, 1.0)]
    assert {(r.pid, r.det_index) for r in m.collect()} == {(1, 0), (3, 1)}


def test_motion(spark):
    f = lambda *a: one(spark, motion.ctrv(*[F.lit(float(x)) for x in a]).alias("s")).s
    assert np.allclose(list(f(0, 0, 0, 10, 0, 0.1)), [1, 0, 0, 10, 0])
    assert np.allclose(list(f(0, 0, 0, 1, math.pi / 2, 1)), [2 / math.pi, 2 / math.pi, math.pi / 2, 1, math.pi / 2])
    for a in (math.pi, 3 * math.pi, -math.pi):
        assert abs(abs(one(spark, motion.wrap_angle(F.lit(a)).alias("a")).a) - math.pi) < 1e-9
    j = np.array(one(spark, motion.ctrv_jacobian(*[F.lit(x) for x in (0.3, 2.0, 0.4, 0.5)]).alias("j")).j)
    x = np.array([1.0, 2.0, 0.3, 2.0, 0.4])
    for k in range(5):
        h = np.eye(5)[k] * 1e-5
        assert np.allclose((np.array(list(f(*(x + h), 0.5))) - np.array(list(f(*(x - h), 0.5)))) / 2e-5, j[:, k], atol=1e-5)
    assert one(spark, motion.noise_scale(F.lit(30), F.lit(1.0), F.lit(1.0)).alias("s")).s == 1.0
    assert one(spark, motion.noise_scale(F.lit(5), F.lit(0.1), F.lit(0.1)).alias("s")).s == 3.0
    assert one(spark, motion.shape_deviation([F.lit(1.0)] * 3, [F.lit(3.0)] * 3).alias("s")).s == 1.0


def test_nearest_rotation(spark):
    m = np.array([[0.9, -0.2, 0], [0.1, 1.1, 0.05], [0, 0, 1.3]])
    r = np.array(one(spark, motion.nearest_rotation(motion.matrix(m.tolist())).alias("r")).r)
    assert np.allclose(r @ r.T, np.eye(3)) and np.linalg.det(r) > 0
    t = one(spark, motion.pose_like(F.lit(1.0), F.lit(2.0), F.lit(0.5), motion.pose(F.lit(0.0), F.lit(0.0), F.lit(7.0), F.lit(0.0))).alias("t")).t
    assert np.allclose(np.array(t)[:3, 3], [1, 2, 7]) and abs(math.atan2(t[1][0], t[0][0]) - 0.5) < 1e-9


@pytest.mark.parametrize("n,m", [(1, 1), (3, 5), (5, 3), (6, 6), (4, 4)])
def test_assignment_is_optimal(n, m):
    rng = np.random.default_rng(n * 10 + m)
    for _ in range(20):
        c = rng.integers(0, 9, (n, m)).astype(float)
        r, k = tracking.assign(c)
        assert len(set(r.tolist())) == len(set(k.tolist())) == min(n, m)
        small, big = (c, m) if n <= m else (c.T, n)
        assert c[r, k].sum() == min(sum(small[i, p[i]] for i in range(len(small))) for p in itertools.permutations(range(big), len(small)))


def box(x, y, yaw=0.2, n=20, sx=4.0, sy=2.0):
    return [n, x, y, 0.5, yaw, sx, sy, 1.5, 0.0, 0.0]


def runs(frames):
    return tracking.fold([(k, 0.1 * k, None if f is None else np.array(f, float).reshape(-1, 10)) for k, f in enumerate(frames)])


def test_one_id_for_a_moving_box():
    rows = runs([[box(k, 0)] for k in range(10)])
    assert {r["entity_id"] for r in rows} == {0} and all(r["survived"] and r["is_confirmed"] for r in rows)
    assert rows[-1]["v"] > 5
    p = np.array(rows[-1]["p"]).reshape(5, 5)
    assert np.allclose(p, p.T, atol=1e-9) and np.linalg.eigvalsh((p + p.T) / 2).min() > 0


def test_lifecycle():
    rows = runs([[box(0, 0)], [box(0, 0)], [box(0, 0)], [], [], [box(0, 0)]])
    assert [r["entity_id"] for r in rows] == [0, 0, 0, 1] and [r["survived"] for r in rows] == [False] * 3 + [True]
    # a tentative track outlives two misses, not three
    born = [[box(0, 0)], [box(0, 0), box(40, 0)]]
    assert runs([*born, [box(0, 0)], [box(0, 0)], [box(0, 0), box(40, 0)]])[-1]["entity_id"] == 1
    assert runs([*born, *[[box(0, 0)]] * 3, [box(0, 0), box(40, 0)]])[-1]["entity_id"] == 2
    # too few points start no track; a frame that was not looked at changes nothing
    assert len(runs([[], [box(0, 0, n=2)]])) == 0
    assert [r["entity_id"] for r in runs([[box(0, 0)], None, None, None, [box(0, 0)]])] == [0, 0]


def test_swaps():
    pairs, last = [(0, 1), (1, 0)], np.array([0, 1])
    assert tracking.suppress_swaps(pairs, np.array([[0, 3.5], [3.5, 0]]), last, 3.0) == []
    assert tracking.suppress_swaps(pairs, np.array([[0, 3.5], [2.0, 0]]), last, 3.0) == pairs


def test_track_in_spark_and_in_a_stream(spark, tmp_path):
    from gridloom.streaming.live import LIVE, track_stream

    rows = [("s", k, 0.1 * k, d, *map(float, box(x, y))) for k in range(6) for d, (x, y) in enumerate([(k, 0), (30 - k, 20)])]
    schema = "sequence_id string, frame_idx int, ts double, det_index int, n_points double, cx double, cy double, cz double, yaw double, sx double, sy double, sz double, vx double, vy double"
    det = spark.createDataFrame(rows, schema)
    frames = det.select("sequence_id", "frame_idx", "ts").distinct()
    batch = {(r.scene_idx, r.det_index): (r.entity_id, round(r.px, 9)) for r in tracking.track(frames, det).collect()}
    assert {v[0] for v in batch.values()} == {0, 1}
    for part in (0, 1):
        det.where(F.col("frame_idx").between(3 * part, 3 * part + 2)).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = track_stream(stream).writeStream.format("memory").queryName("live").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    live = {(r.frame_idx, r.det_index): (r.entity_id, round(r.px, 9)) for r in spark.sql("select * from live").collect()}
    assert live == batch and len(LIVE) > 0


def test_voxel_stream_equals_batch(spark, tmp_path):
    from gridloom.streaming.live import voxel_stream

    rows = [("s", k, i, 0.03 * i, 0.0, 0.0, float(i), f"2024-01-01 00:00:{10 * k:02d}") for k in range(4) for i in range(9)]
    p = spark.createDataFrame(rows, POINTS + ", t string").withColumn("event_time", F.to_timestamp("t")).drop("t")
    p.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(p.schema).parquet(f"{tmp_path}/in")
    q = voxel_stream(stream).writeStream.outputMode("complete").format("memory").queryName("vox").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((r.frame_idx, r.i, round(r.x, 9), r.n) for r in df.collect())
    assert key(spark.sql("select * from vox")) == key(voxel.voxel_downsample(p))


def histories_of(spark, static):
    return spark.createDataFrame([("s", 0, True, 0.0, static)], "sequence_id string, entity_id long, is_confirmed boolean, mean_speed double, is_static boolean")


SNAP = "sequence_id string, entity_id long, scene_idx int, ts double, px double, py double, pz double, yaw double, v double, sx double, sy double, sz double"


@pytest.mark.parametrize(
    "was,path,v,now",
    [(True, [0.0, 1.0, 3.5], 2.0, False), (True, [0.0, 1.0, 2.0], 9.0, True), (False, [0.0, 0.5, 1.0], 1.0, True), (False, [0.0, 0.5, 3.0], 1.0, False), (False, [0.0], 1.0, False)],
)
def test_static_or_not(spark, was, path, v, now):
    s = spark.createDataFrame([("s", 0, k, float(k), x, 0.0, 0.0, 0.0, v, 4.0, 4.0, 2.0) for k, x in enumerate(path)], SNAP)
    own = s.select("sequence_id", "entity_id", "scene_idx", F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"))
    assert classify.classify_tracks(histories_of(spark, was), s, own).first().is_static is now


def test_masks(spark):
    h = spark.createDataFrame([("s", 0, True), ("s", 1, False)], "sequence_id string, entity_id long, is_static boolean")
    rows = spark.createDataFrame([("s", i, e) for i, e in enumerate([0, 1, 7, -1])], "sequence_id string, pid int, entity_id long")
    got = lambda keep: [r.entity_id for r in filters.mask_entities(rows, h, keep).orderBy("pid").collect()]
    assert got(True) == [0, -1, -1, -1] and got(False) == [-1, 1, 7, -1]


def test_field_and_mesh_of_a_voxel(spark):
    p = spark.createDataFrame([(1.05, 2.05, 3.05)] * 2, "x double, y double, z double")
    grid, field = distance_field.reconstruct(p)
    assert [r.weight for r in field.collect()] == [2]
    vertices, faces = distance_field.iso_mesh(field, grid)
    assert (vertices.count(), faces.count()) == (6, 8)
    with pytest.raises(Exception, match="no static points"):
        distance_field.grid_of(p.limit(0)).collect()


def test_mesh_is_closed(spark):
    rng = np.random.default_rng(2)
    field = spark.createDataFrame([(int(a), int(b), int(c), 0.9) for a, b, c in {tuple(r) for r in rng.integers(0, 4, (30, 3)).tolist()}], "ix long, iy long, iz long, tsdf double")
    grid = spark.createDataFrame([(0.0, 0.0, 0.0, 9, 9, 9)], "x0 double, y0 double, z0 double, nx int, ny int, nz int")
    vertices, faces = distance_field.iso_mesh(field, grid, GridConf())
    f = [(r.v0, r.v1, r.v2) for r in faces.collect()]
    assert None not in {v for t in f for v in t} and sorted(r.vid for r in vertices.collect()) == list(range(vertices.count()))
    edges = [(t[i], t[(i + 1) % 3]) for t in f for i in range(3)]
    # every directed edge is met by its reverse
    assert sorted(edges) == sorted((b, a) for a, b in edges)
    at = {r.vid: np.array([r.x, r.y, r.z]) for r in vertices.collect()}
    volume = sum(np.dot(at[a], np.cross(at[b], at[c])) for a, b, c in f) / 6
    assert abs(volume) > 0


def test_ellipse_and_edges(spark):
    e = one(spark, overlay.ellipse(*[F.lit(float(x)) for x in (0, 0, 4, 0, 1)]).alias("e")).e
    assert len(e) == 64 and abs(max(p.x for p in e) - 4) < 1e-9 and abs(max(p.y for p in e) - 2) < 1e-9
    b = cluster.cluster_geometry(cloud(spark, list(itertools.product((0, 4), (0, 2), (0, 1)))).withColumn("det_index", F.lit(0)))
    rows = overlay.box_edges(b, ["det_index"]).collect()
    assert sorted(round(float(np.linalg.norm(np.array(r.a) - np.array(r.b))), 6) for r in rows) == [1.0] * 4 + [2.0] * 4 + [4.0] * 4


def test_ground_plane(spark):
    rng = np.random.default_rng(5)
    floor = np.c_[rng.uniform(0, 20, (200, 2)), rng.normal(0, 0.05, 200)]
    tall = np.c_[rng.uniform(8, 9, (40, 2)), rng.uniform(1.5, 4, 40)]
    p = cloud(spark, np.concatenate([floor, tall]).tolist())
    rest = ground.remove_ground(p, SceneConf())
    assert rest.count() == 40 and [r.pid for r in rest.orderBy("pid").collect()] == list(range(40))


def test_sequence_from_files(spark, tmp_path):
    from gridloom.plans.scenes import run_sequence
    from gridloom.sources.sequence import read_sync_table, write_ply

    (tmp_path / "timesync_info.csv").write_text("sensor,f0,f1,f2\ntimestamp,1000,1100,1200\ncrossing1_11_lidar,a0.npz,a1.npz,a2.npz\ncrossing1_12_lidar,b0.npz,,b2.npz\ncamera_1,c0.png,c1.png,c2.png\n")
    eye = np.eye(4).tolist()
    (tmp_path / "calibration.json").write_text(json.dumps({s: {"extrinsics": {"parent": "world", "T": eye}} for s in ("crossing1_11_lidar", "crossing1_12_lidar")}))
    rng = np.random.default_rng(8)
    for sensor, files in (("crossing1_11_lidar", ["a0", "a1", "a2"]), ("crossing1_12_lidar", ["b0", "b2"])):
        (tmp_path / sensor).mkdir()
        for f in files:
            floor = np.c_[rng.uniform(0, 20, (300, 2)), np.zeros(300)]
            solid = np.c_[rng.uniform(8, 10, (300, 2)), rng.uniform(0.6, 2.5, 300)]
            x, y, z = np.concatenate([floor, solid]).T
            np.savez(tmp_path / sensor / f"{f}.npz", x=x, y=y, z=z, intensity=np.ones(len(x)))
    path = f"{tmp_path}/timesync_info.csv"
    frames, sweeps = read_sync_table(spark, path)
    assert [r.ts_ms for r in frames.orderBy("frame_idx").collect()] == [1000, 1100, 1200]
    assert sorted((r.frame_idx, r.sensor[-8:-6]) for r in sweeps.collect()) == [(0, "11"), (0, "12"), (1, "11"), (2, "11"), (2, "12")]
    assert read_sync_table(spark, path, max_frames=2)[0].count() == 2
    with pytest.raises(Exception, match="lacks a sensor"):
        run_sequence(spark, str(tmp_path), "s", ["crossing1_11_lidar", "crossing1_12_lidar"])
    out = run_sequence(spark, str(tmp_path), "s", ["crossing1_11_lidar"])
    assert out["frames"].count() == 2 and out["histories"].where("is_static").count() >= 1
    assert out["vertices"].count() > 0
    write_ply(out["vertices"], out["faces"], f"{tmp_path}/m.ply")
    head = (tmp_path / "m.ply").read_text().split("end_header")[0]
    assert f"element face {out['faces'].count()}" in head


def test_scenes_look_frames_up_without_the_points(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [("s", f, i, *(rng.random(3) * (2.0, 2.0, 1.0) + (0.0, 0.0, 2.0 * (i % 2))).tolist(), 1.0) for f in range(4) for i in range(80)]
    spark.createDataFrame(rows, POINTS).write.parquet(f"{tmp_path}/points")
    points = spark.read.parquet(f"{tmp_path}/points")
    made = scenes.process_frames(points, points.select("sequence_id", "frame_idx").distinct().withColumn("ts", F.col("frame_idx").cast("double")))
    assert sorted(tuple(r) for r in made["frames"].collect()) == [("s", f, float(f), True) for f in range(3)]
    found = scenes.track_scenes(made)
    assert found["histories"].count() == found["observations"].where("survived").select("entity_id").distinct().count() > 0
    # else all points are read again for each table that looks a frame up
    assert not [f for t in (*made.values(), *found.values()) for f in t.inputFiles() if str(tmp_path) in f]


def test_one_frame_makes_no_scene(spark):
    frames = spark.createDataFrame([("s", 0, 0.0)], "sequence_id string, frame_idx int, ts double")
    assert voxel.with_next(frames).count() == 0
    assert TrackConf().dt_default == voxel.tracking_dt(frames).first().dt
