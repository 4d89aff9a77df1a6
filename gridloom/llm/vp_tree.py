"""Nearest neighbours by vantage-point trees, one per shard.

Vectors are scaled to unit length, where the Euclidean distance orders like the cosine and obeys the
triangle inequality. A node holds a vantage point and the range of distances from it to the vectors of
either half; a half is skipped if the inequality's bound on the distance to it, times ``factor``, is more than a query's
k-th best so far. At factor one that restores the exact search; above, more is skipped and some neighbours may be missed;
below, less is.

Shards are dealt by the nearest of a bounded number of pivots, those of many rows again by hash, so none has many
rows; trees are built once and kept as a table in the shared folder. A query first searches the shards of its own
pivot; its k-th best there tells by the same inequality which other pivots' shards it must see. All queries go through these two
jobs at once, dealt to shards in blocks of bounded size. Equal vectors of a shard share a place in its tree.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.storage import discard, materialize, ship

#: Rows of a shard, about; queries of a block; vectors of a leaf.
SHARD_ROWS = 8192
BLOCK_QUERIES = 4096
LEAF = 128
#: Pivots at most; they are sent to every task.
MAX_PIVOTS = 4096
#: Slack for rounding when distances are compared.
EPS = 1e-7


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of ``query`` with each row, in double precision, the same bits wherever a row stands."""
    rows = np.ascontiguousarray(rows, np.float64)
    dot = (rows * query).sum(axis=1)
    return dot / (np.sqrt((query * query).sum()) * np.sqrt((rows * rows).sum(axis=1)))


class Tree:
    """Arrays of one shard: distinct vectors in leaf order and the ids of each, ascending."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 5) -> None:
        plain = np.ascontiguousarray(vectors + 0.0)  # no negative zeros
        _, first, own = np.unique(plain.view(np.dtype((np.void, plain.dtype.itemsize * plain.shape[1]))).ravel(), return_index=True, return_inverse=True)
        order = np.lexsort((ids, own))
        self.ids, self.bounds = ids[order], np.concatenate([[0], np.cumsum(np.bincount(own))])
        self.vectors = plain[first]
        u = unit(self.vectors)
        rng = np.random.default_rng(seed)
        self.nodes: list[tuple] = []  # leaf: (start, end); inner: (vantage, (low, high, child), (low, high, child))
        self.order = np.arange(len(u))
        self.root = self._build(u, 0, len(u), rng)
        self.units = u[self.order]
        self.vectors = self.vectors[self.order]
        self.places = self.order

    def _build(self, u: np.ndarray, start: int, end: int, rng) -> int:
        me = len(self.nodes)
        self.nodes.append((start, end))
        if end - start <= LEAF:
            return me
        some = self.order[start:end]
        vantage = u[some[rng.integers(len(some))]]
        d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (u[some] @ vantage)))
        by = np.argsort(d, kind="stable")
        self.order[start:end], d = some[by], d[by]
        half = len(by) // 2
        inner, outer = self._build(u, start, start + half, rng), self._build(u, start + half, end, rng)
        # the halves are sorted by distance now, so their ranges are tight
        self.nodes[me] = (vantage, (d[0], d[half - 1], inner), (d[half], d[-1], outer))
        return me

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float, limit: np.ndarray | None = None) -> list[list[tuple[float, int]]]:
        """Up to k (cosine, id), nearest first, of each query but the rows of its own id ``own``; those beyond the distance ``limit`` may lack."""
        if not len(self.vectors) or queries.shape[1] != self.vectors.shape[1]:
            return [[] for _ in range(len(queries))]
        q = unit(queries)
        limit = np.full(len(q), np.inf) if limit is None else limit
        best = np.repeat(limit[:, None], k, axis=1)  # distances of the nearest ids so far, the limit where there are fewer
        found: list[list[np.ndarray]] = [[] for _ in range(len(q))]
        stack = [(self.root, np.arange(len(q)), np.zeros(len(q)))]
        copies = np.minimum(np.diff(self.bounds)[self.places], k + 1)
        while stack:
            node, active, floor = stack.pop()
            active = active[floor * factor <= best[active, -1] + EPS]
            if not len(active):
                continue
            at = self.nodes[node]
            if len(at) == 2:
                start, end = at
                d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (q[active] @ self.units[start:end].T)))
                # a place counts as often as it has ids, but for the query's own
                times = copies[start:end]
                for row, i in enumerate(active.tolist()):
                    near = np.flatnonzero(d[row] <= best[i, -1] + EPS)
                    if not len(near):
                        continue
                    found[i].append(near + start)
                    rep = np.repeat(d[row, near], self._others(near + start, times[near], own[i]))
                    best[i] = np.sort(np.concatenate([best[i], rep]))[:k]
                continue
            vantage, *halves = at
            d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (q[active] @ vantage)))
            gaps = [np.maximum(0.0, np.maximum(low - d, d - high)) for low, high, _ in halves]
            # the half that is nearer to most goes on top of the stack
            first = int(gaps[1].sum() < gaps[0].sum())
            for side in (1 - first, first):
                stack.append((halves[side][2], active, gaps[side]))
        return [self._exact(queries[i], own[i], np.concatenate(found[i]) if found[i] else np.empty(0, int), best[i, -1], k) for i in range(len(q))]

    def _ids(self, place: int) -> np.ndarray:
        v = self.places[place]
        return self.ids[self.bounds[v] : self.bounds[v + 1]]

    def _others(self, places: np.ndarray, times: np.ndarray, own: int) -> np.ndarray:
        return np.array([min(t, int((self._ids(p)[: t + 1] != own).sum())) for p, t in zip(places.tolist(), times.tolist(), strict=True)], int)

    def _exact(self, query: np.ndarray, own: int, places: np.ndarray, last: float, k: int) -> list[tuple[float, int]]:
        if not len(places):
            return []
        d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (self.units[places] @ unit(query[None])[0])))
        places = places[d <= last + EPS]
        pairs = []
        for score, p in zip(cosines(query, self.vectors[places]).tolist(), places.tolist(), strict=True):
            ids = self._ids(p)[: k + 1]
            pairs += [(-score, i) for i in ids[ids != own][:k].tolist()]
        return [(-s, i) for s, i in sorted(pairs)[:k]]


def _rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.Array) else column.combine_chunks().flatten()
    n = len(column)
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.empty((0, 0))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (unit(a) @ unit(b).T)))


def _near_pivot(pivots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = _distances(_rows(b.column(1)), pivots.value).argmin(axis=1) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32))], [*b.schema.names, "pivot"])

    return run


def _build(pivots):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows, pivot = _rows(table["embedding"]), key[0].as_py()
        radius = float(_distances(rows, pivots.value[pivot : pivot + 1]).max())
        tree = pickle.dumps(Tree(table["vec_id"].to_numpy(), rows))
        return pa.table({"pivot": pa.array([pivot], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "radius": [radius], "vector": pa.array([pivots.value[pivot].tolist()], pa.list_(pa.float64())), "tree": pa.array([tree], pa.binary())})

    return run


def usable(embedding: Column) -> Column:
    """Neither null nor zero, and without null or non-finite components."""
    good = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return embedding.isNotNull() & good & F.exists(embedding, lambda x: x != 0)


_INDEX = "pivot int, part int, radius double, vector array<double>, tree binary"
_FOUND = "query_id long, vec_id long, score double"


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(pivot, part, radius, vector, tree) of ``vectors`` (vec_id, embedding), every usable row in one tree; written to the shared folder.

    Vectors of another length than most take no part. Of rows that share an id, the one with the least
    vector stands for all. Null ids take no part. Pivots are the first rows by a hash, one for ``shard_rows`` rows.
    """
    spark = ship(vectors.sparkSession)
    rows = vectors.select("vec_id", "embedding").where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    lengths = rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "d").first()
    if lengths is None:
        return spark.createDataFrame([], _INDEX)
    d, n = lengths
    rows = rows.where(F.size("embedding") == d).groupBy("vec_id").agg(F.min("embedding").cast("array<double>").alias("embedding"))
    rows = materialize(rows, "vp-rows")
    some = rows.orderBy(F.xxhash64(F.lit(9), "vec_id"), "vec_id").limit(min(MAX_PIVOTS, -(-n // shard_rows))).toArrow()
    pivots = spark.sparkContext.broadcast(_rows(some["embedding"]))
    dealt = materialize(rows.mapInArrow(_near_pivot(pivots), "vec_id long, embedding array<double>, pivot int"), "vp-dealt")
    parts = dealt.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("parts"))  # MAX_PIVOTS rows at most
    dealt_ = dealt.join(F.broadcast(parts), "pivot").withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts").cast("int"))
    index = materialize(dealt_.groupBy("pivot", "part").applyInArrow(_build(pivots), _INDEX), "vp-index")
    discard(rows, dealt)
    return index


def _others(meta, factor: float):
    """Adds the pivots beyond a query's own whose shards may hold one nearer than its ``limit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, radius = meta.value
        for b in batches:
            d = _distances(_rows(b.column(1)), vectors) if b.num_rows else np.empty((0, len(ids)))
            gap = np.maximum(0.0, d - radius) * factor
            may = (gap <= b.column(3).to_numpy(zero_copy_only=False)[:, None] + EPS) & (ids != b.column(2).to_numpy(zero_copy_only=False)[:, None])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([ids[m].tolist() for m in may], pa.list_(pa.int32()))], [*b.schema.names, "pivots"])

    return run


def _search(k: int, factor: float):
    def run(key: tuple[pa.Scalar, ...], queries: pa.Table, trees: pa.Table) -> pa.Table:
        rows = []
        if queries.num_rows:
            ids = queries["vec_id"].to_numpy()
            for raw in trees["tree"]:
                found = pickle.loads(raw.as_py()).search(_rows(queries["embedding"]), ids, k, factor, queries["limit"].to_numpy().astype(np.float64))
                rows += [(int(q), i, s) for q, f in zip(ids.tolist(), found, strict=True) for s, i in f]
        cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    return run


def search(index: DataFrame, queries: DataFrame, k: int = 5, factor: float = 1.0, block: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found of each of ``queries`` (vec_id, embedding).

    Rows with the query's own id are left out; equal scores go to the smaller id. Queries with an unusable
    vector, one of another length than most or a null id have no rows. Of queries that share an id the least vector counts.
    """
    spark = ship(index.sparkSession)
    meta = index.groupBy("pivot").agg(F.max("radius").alias("radius"), F.first("vector").alias("vector"), F.count(F.lit(1)).cast("int").alias("parts")).orderBy("pivot").toArrow()  # MAX_PIVOTS rows at most
    if not meta.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    ids, vectors, radius = meta["pivot"].to_numpy(), _rows(meta["vector"]), meta["radius"].to_numpy()
    sent, known = spark.sparkContext.broadcast(vectors), spark.sparkContext.broadcast((ids, vectors, radius))
    parts = F.broadcast(spark.createDataFrame(list(enumerate(ids.tolist())), "pivot int, id int").join(index.groupBy(F.col("pivot").alias("id")).agg(F.collect_list("part").alias("parts")), "id"))

    rows = queries.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(usable(F.col("embedding")) & F.col("vec_id").isNotNull() & (F.size("embedding") == vectors.shape[1]))
    rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    rows = rows.mapInArrow(_near_pivot(sent), "vec_id long, embedding array<double>, pivot int").join(parts.select("pivot", "id"), "pivot")
    rows = materialize(rows.select("vec_id", "embedding", F.col("id").alias("pivot")), "vp-queries")
    blocks = max(1, -(-rows.count() // block))

    def searched(some: DataFrame) -> DataFrame:
        """What ``some`` (vec_id, embedding, limit, pivot) find in all shards of their pivots."""
        listed = parts.select(F.col("id").alias("pivot"), "parts")
        to = some.join(listed, "pivot").withColumn("part", F.explode("parts")).drop("parts").withColumn("block", F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(blocks)).cast("int"))
        trees = index.select("pivot", "part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "tree")
        keys = ["pivot", "part", "block"]
        return to.groupBy(*keys).cogroup(trees.groupBy(*keys)).applyInArrow(_search(k, factor), _FOUND)

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    first = materialize(searched(rows.withColumn("limit", F.lit(float("inf")))), "vp-found")
    kth = first.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select(F.col("query_id").alias("vec_id"), F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * F.col("score"))).alias("limit"))
    bounded = rows.join(kth, "vec_id", "left").select("vec_id", "embedding", "pivot", F.coalesce("limit", F.lit(float("inf"))).alias("limit"))
    wider = bounded.mapInArrow(_others(known, factor), "vec_id long, embedding array<double>, pivot int, limit double, pivots array<int>")
    more = materialize(searched(wider.select("vec_id", "embedding", "limit", F.explode("pivots").alias("pivot"))), "vp-found")
    discard(rows)
    return first.unionByName(more).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_vp_tree(spark, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of every fiftieth, exactly (factor one)."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(build_index(vectors), vectors.where("vec_id % 50 = 0"), 5, 1.0)
