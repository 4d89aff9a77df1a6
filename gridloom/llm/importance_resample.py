"""Importance resampling of documents towards a target.

Two generative models over hashed unigrams and bigrams, each a distribution over ``BUCKETS`` buckets:
one of all the texts (raw), one of labelled good documents (target). Tokens are words and runs of signs. A document's
log-weight is the sum over its n-grams of the log-ratio of target to raw. Adding standard Gumbel noise and
taking the k greatest draws k documents without replacement in proportion to their weights.

Both models leave the weighed document out, so that its own n-grams speak neither for nor against it, and the ratio of a
bucket is drawn to 1 by ``PRIOR`` counts, so that rare n-grams say little.

The raw model counts every n-gram of every document. Only the labelled rows are bounded: at most
``LABELS``, taken by a hash order. Unless k is given, it is the number of documents that weigh no less than all but a share
``MISS`` of held-out target documents do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.hashed import blocks, trimmed, window_hashes, word_hashes
from gridloom.llm.words import hash_key
from gridloom.storage import materialize, ship

BUCKETS = 1 << 18
#: Labelled rows that a model is fitted on, at most (half of them set the cut).
LABELS = 20_000
#: Expected counts by which a bucket's ratio is drawn to 1.
PRIOR = 10.0
#: Share of held-out target documents that may weigh less than what k is counted from.
MISS = 0.01
#: Values that one selection step may bring to the driver.
FEW = 10_000
SEED = 11
#: Bytes of text that a worker takes apart at once, about.
BLOCK_BYTES = 512 << 10
_CHUNKS = 16


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every unigram and bigram."""
    apart = pc.replace_substring_regex(pc.fill_null(texts, ""), r"([^\p{L}\p{M}\p{N}\x09-\x0D\x20]+)", r" \1 ")
    h, bounds = word_hashes(apart)
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    inside = text[1:] == text[:-1]
    pairs = window_hashes(h, 2)[inside]
    return (np.concatenate([h, pairs]) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([text, text[:-1][inside]])


def _are(ids: pa.Array, among: np.ndarray) -> np.ndarray:
    return np.isin(ids.fill_null(-(1 << 63)).to_numpy(), among)


def _count(target):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in (b.slice(i, n) for b in batches for i, n in blocks(b.column(1), BLOCK_BYTES)):
            bucket, text = _grams(b.column(1))
            raw += np.bincount(bucket, minlength=BUCKETS)
            good += np.bincount(bucket[_are(b.column(0), target.value)[text]], minlength=BUCKETS)
        parts = np.split(np.stack([raw, good]), _CHUNKS, axis=1)
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(_CHUNKS), pa.int32()), "counts": [zlib.compress(x.tobytes(), 1) for x in parts]})

    return run


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(x.as_py()), np.int64) for x in table["counts"])
    return pa.table({"chunk": table["chunk"].slice(0, 1), "counts": [zlib.compress(total.tobytes(), 1)]}, table.schema)


def labelled(labels: DataFrame, most: int = LABELS) -> tuple[np.ndarray, np.ndarray]:
    """Ids of good documents to fit on, and of others to set the cut by; from at most ``most`` labelled rows.

    A document is good if every label of it says quality 1 and none says toxic. Null ids are left out.
    """
    per = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    good = per.where("q = 1 and coalesce(t, 0) = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    ids = np.array([r[0] for r in good.select("doc_id").collect()], np.int64)
    return np.sort(ids[::2]), np.sort(ids[1::2])


def fit(docs: DataFrame, target: np.ndarray) -> np.ndarray:
    """Counts of raw and target n-grams (2, BUCKETS); ``target`` are ids of ``docs``."""
    spark = ship(docs.sparkSession)
    sent = spark.sparkContext.broadcast(target)
    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(_count(sent)), "chunk int, counts binary")
    rows = parts.groupBy("chunk").applyInArrow(_add, "chunk int, counts binary").collect()
    return np.concatenate([np.frombuffer(zlib.decompress(r["counts"]), np.int64).reshape(2, -1) for r in sorted(rows, key=lambda r: r["chunk"])], axis=1) if rows else np.zeros((2, BUCKETS), np.int64)


def log_weights(bucket: np.ndarray, text: np.ndarray, mine: np.ndarray, raw: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, log-weight) of texts 0 .. len(mine) - 1, each left out of the counts; ``mine``: whether it counts for the target."""
    n = np.bincount(text, minlength=len(mine))
    key, c = np.unique(text * np.int64(BUCKETS) + bucket, return_counts=True)
    t, b = key // BUCKETS, key % BUCKETS
    # target n-grams expected in a bucket of so many raw ones
    scale = np.maximum(0, good.sum() - n * mine) / np.maximum(1, raw.sum() - n)
    ratio = np.log((good[b] - c * mine[t] + PRIOR) / (scale[t] * (raw[b] - c) + PRIOR))
    return n, np.bincount(t, c * ratio, len(mine))


def _weigh(model, where: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (raw, good), target = model.value
        for b in (b.slice(i, n) for b in batches for i, n in blocks(b.column(where), BLOCK_BYTES)):
            bucket, text = _grams(b.column(where))
            grams, weight = log_weights(bucket, text, _are(b.column(where + 1), target), raw, good)
            keep = range(where)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(grams.astype(np.int64)), pa.array(weight.astype(np.float64))], [*(b.schema.names[i] for i in keep), "n_grams", "log_weight"])

    return run


def gumbel(seed: int, *cols: Column) -> Column:
    """Standard Gumbel noise, a function of the columns."""
    u = (F.shiftright(hash_key(F.lit(seed), *cols), 10) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def weigh(docs: DataFrame, counts: np.ndarray, target: np.ndarray, carry: list[str]) -> DataFrame:
    """Columns ``carry`` of ``docs`` with n_grams, log_weight and score (log-weight plus noise)."""
    spark = ship(docs.sparkSession)
    sent = spark.sparkContext.broadcast((counts, target))
    rows = docs.select(*carry, gumbel(SEED, F.col("doc_id"), F.col("text")).alias("_noise"), F.col("text").cast("string").alias("_text"), F.col("doc_id").cast("long").alias("_id"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2]) + ", n_grams long, log_weight double"
    # log-weights are sums of doubles in a fixed order, so they agree between runs
    return rows.mapInArrow(trimmed(_weigh(sent, len(rows.columns) - 2)), schema).withColumn("score", F.col("log_weight") + F.col("_noise")).drop("_noise")


def kth_greatest(values: DataFrame, k: int) -> float:
    """The k-th greatest (the least, if there are fewer) of the one double column ``v``: exact counts per step, the step of rank k cut again."""
    low, high, above = *values.agg(F.min("v"), F.max("v")).first(), 0
    while low < high:
        inside = values.where(F.col("v").between(low, high))
        steps = inside.groupBy(F.floor((F.col("v") - low) / ((high - low) / 4096)).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        for _, n, lo, hi in sorted(steps.collect(), reverse=True):
            if above + n >= k:
                break
            above += n
        if above + n < k:
            return values.agg(F.min("v")).first()[0]
        if n <= FEW:
            return sorted((r[0] for r in values.where(F.col("v").between(lo, hi)).collect()), reverse=True)[k - above - 1]
        low, high = lo, hi
    return low


def default_k(weighed: DataFrame, held_out: np.ndarray) -> int | None:
    """Documents of ``weighed`` (doc_id, log_weight) that weigh as ``held_out`` ones do; None if there are none of these."""
    if not len(held_out):
        return None
    ids = weighed.sparkSession.createDataFrame([(int(i),) for i in held_out], "doc_id long")  # LABELS rows at most
    sure = weighed.join(F.broadcast(ids), "doc_id", "left_semi").agg(F.percentile("log_weight", F.lit(MISS))).first()[0]
    return None if sure is None else weighed.where(F.col("log_weight") >= sure).count()


def resample(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None, k: int | None = None) -> DataFrame:
    """The ``k`` drawn documents: columns ``carry`` of ``docs`` (all, if none are named), n_grams, log_weight, score.

    ``docs`` has doc_id and text, ``labels`` doc_id, quality and toxic. Null and empty texts weigh nothing (log-weight 0).
    Without ``k`` it is estimated, so that hardly a document like the target goes. Documents with the score of the k-th are
    drawn too, so equal rows stay or go together. Without labelled good documents among ``docs`` and without ``k`` all are
    drawn. Columns named like an added one are replaced.
    """
    taken = ("n_grams", "log_weight", "score", "_noise", "_text", "_id")
    carry = [c for c in (carry or docs.columns) if c not in taken]
    target, held_out = labelled(labels)
    counts = fit(docs, target)
    weighed = materialize(weigh(docs, counts, target, ["doc_id"]), "weights")
    if k is None and counts[1].any():
        k = default_k(weighed, held_out)
    out = weighed if carry == ["doc_id"] else weigh(docs, counts, target, carry)
    if k is None or weighed.isEmpty():
        return out
    return out.where(F.col("score") >= kth_greatest(weighed.select(F.col("score").alias("v")), k)) if k > 0 else out.limit(0)


def op5_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents drawn towards the labelled good ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    drawn = resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ["doc_id"])
    return drawn.select("doc_id", "n_grams", "log_weight", "score", F.lit(True).alias("kept"))
