"""Connected components of an edge table, by alternating large and small stars.

Every round re-hangs neighbours on the least vertex seen from a vertex, which halves path lengths
without ever gathering a vertex's neighbours in one place: minima are partial aggregates, and
the join that follows may be split where a vertex has very many edges. Rounds are tables in the
shared folder, so a lost executor costs one round at most.

Where vertices are whole numbers, each task first reduces its edges to a forest: every vertex with
the least one its own edges reach. That bounds a round by the vertices of its tasks, and a graph that
fits one task is done without any exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from gridloom.storage import discard, materialize, ship

#: Edges per partition of a round, about; small graphs go through few partitions.
PART_EDGES, LEAST_PARTS = 50_000, 8
#: The same where tasks reduce their edges to forests, which they hold at most so many edges for at a time.
FOREST_EDGES = 500_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _star_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) as (vertex, least vertex of its component)."""
    now = materialize(edges, "edges")
    parts, before = max(LEAST_PARTS, now.count() // PART_EDGES), None
    while True:
        old, now = now, materialize(_small_star(_large_star(now.coalesce(parts)).coalesce(parts)).coalesce(parts), "edges")
        discard(old)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            return now
        before = state


def _hung(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vertex of the edges that is not the least one they connect it to, and that least one."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    parent = np.arange(len(ids))
    while len(u):
        u, v = parent[u], parent[v]
        apart = u != v
        u, v = u[apart], v[apart]
        np.minimum.at(parent, np.maximum(u, v), np.minimum(u, v))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    below = np.flatnonzero(parent != np.arange(len(ids)))
    return ids[below], ids[parent[below]]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (a, b) of a task as (vertex, least vertex), by blocks of FOREST_EDGES that carry over what they found."""
    held, rows, schema = [], 0, None

    def reduced() -> pa.RecordBatch:
        ends = _hung(*(np.concatenate([x[i] for x in held]) for i in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(ends, schema, strict=True)], schema=schema)

    for batch in batches:
        schema = batch.schema
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        rows += batch.num_rows
        if rows >= FOREST_EDGES:
            yield reduced()
            held, rows = [], 0
    if rows:
        yield reduced()


def _forest_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) as (vertex, least vertex of its component); rounds end as soon as one task holds what is left."""
    ship(edges.sparkSession)
    reduce = lambda df, parts: df.coalesce(parts).mapInArrow(_forest, edges.schema)
    now, before = materialize(edges, "edges"), None
    while True:
        count, total = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        # a block is full once it reaches FOREST_EDGES, so a task below that has one forest
        parts = count // FOREST_EDGES + 1
        if (count, total) == before or not count:
            return now
        before, old = (count, total), now
        if parts == 1:
            now = materialize(reduce(old, 1), "edges")
            discard(old)
            return now
        hung = materialize(reduce(old, parts), "forest")
        now = materialize(_small_star(_large_star(hung)), "edges")
        discard(old, hung)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every vertex of ``edges`` (two columns of one orderable type); component is the least vertex.

    Loops and rows with a null end are ignored; repeated edges count once. No edges: no rows. Each round replaces
    the table of the one before.
    """
    a, b = edges.columns
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    now = _forest_components(edges) if isinstance(edges.schema["a"].dataType, IntegralType) else _star_components(edges.distinct())
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
    found._scratch_path = now.__dict__.pop("_scratch_path", None)  # discard(found) deletes the last round
    return found


def extended_components(known: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) of the graph of ``known`` (node, component, of :func:`connected_components`) with further ``edges`` (a, b).

    Only the graph of components is solved; its vertices are those that ``edges`` touch. Vertices that ``known`` lacks are
    components of their own.
    """
    named = lambda c: F.coalesce(F.col("component"), F.col(c))
    at = edges.join(known, edges["a"] == known["node"], "left").select(named("a").alias("a"), "b")
    at = at.join(known, at["b"] == known["node"], "left").select("a", named("b").alias("b"))
    met = connected_components(at).select(F.col("node").alias("_old"), F.col("component").alias("_new"))
    old = known.join(met, known["component"] == met["_old"], "left").select("node", F.coalesce("_new", "component").alias("component"))
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(known, "node", "left_anti")
    return old.unionByName(ends.join(met, ends["node"] == met["_old"]).select("node", F.col("_new").alias("component")))
