"""A sparse distance field over voxels and the surface where it crosses a level.

Only voxels that hold a point have a value above zero, so the field is an aggregate over occupied voxels
and the surface lies between an occupied voxel and an empty neighbour.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.config import GridConf


def static_points(snapshots: DataFrame, histories: DataFrame, members: DataFrame, points: DataFrame) -> DataFrame:
    """Points (sequence_id, frame_idx, pid, x, y, z) of standing tracks in the scenes where they were seen, as often as seen.

    ``snapshots`` has frame_idx and det_index.
    """
    still = histories.where("is_static").select("sequence_id", "entity_id")
    seen = snapshots.join(still, ["sequence_id", "entity_id"], "left_semi").select("sequence_id", "frame_idx", "det_index")
    held = seen.join(members.select("sequence_id", "frame_idx", "det_index", "pid"), ["sequence_id", "frame_idx", "det_index"])
    return held.join(points.select("sequence_id", "frame_idx", "pid", "x", "y", "z"), ["sequence_id", "frame_idx", "pid"])


def grid_of(points: DataFrame, conf: GridConf = GridConf()) -> DataFrame:
    """One row: least corner x0, y0, z0 and dims nx, ny, nz of the grid around ``points``. No points: an error."""
    low, high = (F.struct(*[f(a).alias(a) for a in "xyz"]) for f in (F.min, F.max))
    g = points.agg(low.alias("lo"), high.alias("hi"))
    base = [F.when(F.col(f"lo.{a}").isNull(), F.raise_error(F.lit("no static points"))).otherwise(F.col(f"lo.{a}") - conf.margin).alias(f"{a}0") for a in "xyz"]
    dims = [F.ceil((F.col(f"hi.{a}") - F.col(f"lo.{a}") + 2 * conf.margin) / F.lit(conf.voxel_size)).cast("int").alias(f"n{a}") for a in "xyz"]
    return g.select(*base, *dims)


def integrate(points: DataFrame, grid: DataFrame, conf: GridConf = GridConf()) -> DataFrame:
    """(ix, iy, iz, tsdf, weight) of the voxels ``points`` fall in: the mean closeness to the voxel's centre, 1 there and
    0 at the truncation distance. Points outside the grid are left out. ``grid`` is one row."""
    at = points.crossJoin(F.broadcast(grid))  # one row on the right
    at = at.withColumns({f"i{a}": F.floor((F.col(a) - F.col(f"{a}0")) / F.lit(conf.voxel_size)) for a in "xyz"})
    at = at.where(" and ".join(f"i{a} >= 0 and i{a} < n{a}" for a in "xyz"))
    off = {a: F.col(a) - ((F.col(f"i{a}") + 0.5) * conf.voxel_size + F.col(f"{a}0")) for a in "xyz"}
    far = F.sqrt(off["x"] * off["x"] + off["y"] * off["y"] + off["z"] * off["z"])
    near = 1.0 - F.least(F.greatest(far / conf.trunc, F.lit(0.0)), F.lit(1.0))
    return at.groupBy("ix", "iy", "iz").agg(F.avg(near).alias("tsdf"), F.count(F.lit(1)).alias("weight"))


def reconstruct(points: DataFrame, conf: GridConf = GridConf()) -> tuple[DataFrame, DataFrame]:
    """(grid, field) of ``points``."""
    grid = grid_of(points, conf)
    return grid, integrate(points, grid, conf)


_SIDES = [(axis, way) for axis in range(3) for way in (-1, 1)]


def iso_vertices(field: DataFrame, conf: GridConf = GridConf()) -> DataFrame:
    """(ix, iy, iz, axis, way, gx, gy, gz): crossings of the level between a voxel above it and the neighbour ``way`` along
    ``axis`` that is not, in grid units. Neighbours without a value are zero."""
    above = field.where(F.col("tsdf") > conf.level).select("ix", "iy", "iz", "tsdf")
    sides = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(w).alias("way")) for a, w in _SIDES]))
    out = above.withColumn("s", sides).select("ix", "iy", "iz", "tsdf", "s.axis", "s.way")
    step = lambda i: F.when(F.col("axis") == i, F.col("way")).otherwise(0)
    out = out.withColumns({f"j{a}": F.col(f"i{a}") + step(i) for i, a in enumerate("xyz")})
    below = field.select(*[F.col(f"i{a}").alias(f"j{a}") for a in "xyz"], F.col("tsdf").alias("other"))
    met = out.join(below, ["jx", "jy", "jz"], "left").withColumn("other", F.coalesce("other", F.lit(0.0))).where(F.col("other") <= conf.level)
    along = (F.col("tsdf") - conf.level) / (F.col("tsdf") - F.col("other"))
    place = {f"g{a}": F.col(f"i{a}") + F.when(F.col("axis") == i, F.col("way") * along).otherwise(0.0) for i, a in enumerate("xyz")}
    return met.withColumns(place).select("ix", "iy", "iz", "axis", "way", "gx", "gy", "gz")


# corners of a cell by bits x, y, z; edges join corners that differ in one bit
_CORNERS = list(product((0, 1), repeat=3))


def _cell_triangles(mask: int) -> list[tuple]:
    """Triangles of a cell whose corners in ``mask`` lie above the level, as triples of (inner corner, outer corner).

    On each face the surface runs between crossed edges, around the corners above the level, so two such corners
    that face each other diagonally stay apart. The runs close to loops, which fan out into triangles.
    """
    inside = [bool(mask >> n & 1) for n in range(8)]
    number = {c: n for n, c in enumerate(_CORNERS)}
    follow: dict[tuple, tuple] = {}
    for axis in range(3):
        for side in (0, 1):
            u, v = [a for a in range(3) if a != axis]
            ring = []
            for p, q in ((0, 0), (1, 0), (1, 1), (0, 1)):
                c = [0, 0, 0]
                c[axis], c[u], c[v] = side, p, q
                ring.append(number[tuple(c)])
            # seen from outside the ring runs counter-clockwise
            if (side == 0) != (axis == 1):
                ring.reverse()
            for k in range(4):
                # entering a stretch of corners above the level at k, leaving it at the next crossing
                if not inside[ring[k - 1]] and inside[ring[k]]:
                    e = k
                    while inside[ring[(e + 1) % 4]]:
                        e += 1
                    follow[ring[e % 4], ring[(e + 1) % 4]] = (ring[k], ring[k - 1])
    out, left = [], dict(follow)
    while left:
        first, nxt = next(iter(left.items()))
        loop = [first]
        del left[first]
        while nxt != first:
            loop.append(nxt)
            nxt = left.pop(nxt)
        out += [(loop[0], loop[i], loop[i + 1]) for i in range(1, len(loop) - 1)]
    return out


def _offset(edge: tuple[int, int]) -> tuple[int, int, int, int, int]:
    """(dx, dy, dz, axis, way) of a cell edge's crossing: the inner corner and the direction to the outer."""
    a, b = (_CORNERS[n] for n in edge)
    axis = next(i for i in range(3) if a[i] != b[i])
    return (*a, axis, b[axis] - a[axis])


def iso_mesh(field: DataFrame, grid: DataFrame, conf: GridConf = GridConf(), center: bool = False) -> tuple[DataFrame, DataFrame]:
    """(vertices vid, x, y, z, nx, ny, nz; faces fid, v0, v1, v2) of the level's surface in world coordinates.

    Indices times the voxel size plus the grid's corner give the place; ``center`` adds the half voxel to the centres.
    Normals point to the empty side. Ids are dense: ranks within slabs of one index, plus the counts of those before.
    """
    corner = iso_vertices(field, conf)
    slabs = corner.groupBy("ix").agg(F.count(F.lit(1)).alias("_n"))
    slabs = slabs.withColumn("_base", F.sum("_n").over(Window.orderBy("ix")) - F.col("_n")).drop("_n")  # one row per index of one axis
    ranked = corner.join(slabs, "ix").withColumn("vid", F.col("_base") + F.row_number().over(Window.partitionBy("ix").orderBy("iy", "iz", "axis", "way")) - 1)
    shift = conf.voxel_size / 2 if center else 0.0
    placed = ranked.crossJoin(F.broadcast(grid))
    vertices = placed.select("vid", *[(F.col(f"g{a}") * conf.voxel_size + F.col(f"{a}0") + shift).alias(a) for a in "xyz"], *[F.when(F.col("axis") == i, F.col("way")).otherwise(0).cast("double").alias(f"n{a}") for i, a in enumerate("xyz")])

    above = field.where(F.col("tsdf") > conf.level).select("ix", "iy", "iz")
    touch = F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"d{a}") for a, v in zip("xyz", c, strict=True)], F.lit(1 << n).alias("bit")) for n, c in enumerate(_CORNERS)]))
    cells = above.withColumn("c", touch).groupBy(*[(F.col(f"i{a}") - F.col(f"c.d{a}")).alias(f"c{a}") for a in "xyz"]).agg(F.sum("c.bit").alias("mask"))
    table = [(mask, t, k, *_offset(e)) for mask in range(1, 255) for t, tri in enumerate(_cell_triangles(mask)) for k, e in enumerate(tri)]
    spark = field.sparkSession
    cases = spark.createDataFrame(table, "mask long, t int, k int, dx int, dy int, dz int, axis int, way int")
    ends = cells.join(F.broadcast(cases), "mask").withColumns({f"i{a}": F.col(f"c{a}") + F.col(f"d{a}") for a in "xyz"})
    met = ends.join(ranked.select("ix", "iy", "iz", "axis", "way", "vid"), ["ix", "iy", "iz", "axis", "way"])
    faces = met.groupBy("cx", "cy", "cz", "t").agg(*[F.max(F.when(F.col("k") == k, F.col("vid"))).alias(f"v{k}") for k in range(3)])
    counts = faces.groupBy("cx").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_base", F.sum("_n").over(Window.orderBy("cx")) - F.col("_n")).drop("_n")
    faces = faces.join(counts, "cx").withColumn("fid", F.col("_base") + F.row_number().over(Window.partitionBy("cx").orderBy("cy", "cz", "t")) - 1)
    return vertices, faces.select("fid", "v0", "v1", "v2")
