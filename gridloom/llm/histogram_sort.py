"""Histogram sort: exact counts below candidate keys find the splitters, then one exchange.

The rows are ordered by a pair of long keys. A narrow table (keys, size) is scanned a
few times. Each scan cuts every interval that still hides a splitter into equal steps and
counts, exactly, bytes and rows per step over all partitions; the step in which a target
falls becomes the next interval. A splitter is settled as soon as a step's edge lies
within the tolerance, or its step holds a single key. An interval that has shrunk to one
first key (a large group of copies) goes on over the second key, and where a splitter falls among rows equal
in both, these are written with a number each and the search goes on over the numbers, so no group is too large
to be cut. Only step counts reach the driver: at most 16 per open
splitter, or ``PROBES``.

With the splitters known, full rows are exchanged once, to the ranges in which they stay.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.words import hash_key
from gridloom.storage import discard, materialize

#: Probes of one scan, shared by its open splitters (16 each at least).
PROBES = 4096
#: Ranges within shards: of about so many bytes, and no more than so many in all (they are sent to every task).
RANGE_BYTES = 128 << 20
MAX_RANGES = 1 << 16
#: Keys have 62 bits; lookups of a key's interval go by its upper 12.
COARSE = 50


@dataclass
class _Search:
    """One open splitter: the keys between which it lies, and the exact bytes before them."""

    target: float
    first: int | None  # fixed first key once the search is over the second
    low: int
    high: int
    below: int


def _counts(narrow: DataFrame, spans: list[tuple]) -> dict[tuple, list]:
    """(least key, greatest key, bytes) of each non-empty step of each span (first, low, high).

    Spans do not overlap. They are looked up by the coarse step of the first key. Steps are told
    apart by a division in doubles, which is monotone; the exact keys in each are returned.
    """
    probes = max(16, PROBES // len(spans))
    listed: dict[int, list] = {}
    for n, (first, low, high) in enumerate(spans):
        width = float(max(1, -(-(high - low + 1) // probes)))
        for b in range((low if first is None else first) >> COARSE, ((high if first is None else first) >> COARSE) + 1):
            listed.setdefault(b, []).append((n, first, low, high, width))
    table = narrow.sparkSession.createDataFrame(list(listed.items()), "_step long, _spans array<struct<n:int,first:long,low:long,high:long,width:double>>")

    def holds(s: Column) -> Column:
        return F.when(s["first"].isNull(), F.col("k1").between(s["low"], s["high"])).otherwise((F.col("k1") == s["first"]) & F.col("k2").between(s["low"], s["high"]))

    met = narrow.join(F.broadcast(table), F.shiftright("k1", COARSE) == F.col("_step"))
    met = met.select("k1", "k2", "size", F.get(F.filter("_spans", holds), F.lit(0)).alias("s")).where("s is not null")
    met = met.withColumn("key", F.when(F.col("s.first").isNull(), F.col("k1")).otherwise(F.col("k2")))
    met = met.withColumn("at", F.floor((F.col("key") - F.col("s.low")) / F.col("s.width")))
    rows = met.groupBy(F.col("s.n").alias("n"), "at").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.sum("size").alias("bytes"))
    found: dict[tuple, list] = {s: [] for s in spans}
    for r in rows.collect():
        found[spans[r["n"]]].append((r["lo"], r["hi"], r["bytes"]))
    return {s: sorted(x) for s, x in found.items()}


def _settle(narrow: DataFrame, open_: dict[int, _Search], tolerance: float) -> tuple[dict[int, tuple[int, int]], dict[int, tuple[int, int, int]]]:
    """Splitters by number, and those that fall among rows of one (k1, k2) by more than ``tolerance``: (k1, k2, bytes below them).

    ``narrow`` has long columns k1, k2 (0 <= key < 2**62) and size. Steps are compared by the keys they really hold, so every
    count used is exact.
    """
    done: dict[int, tuple[int, int]] = {}
    tied: dict[int, tuple[int, int, int]] = {}
    while open_:
        spans = {}
        for i, s in open_.items():
            spans.setdefault((s.first, s.low, s.high), []).append(i)
        counts = _counts(narrow, list(spans))
        for span, members in spans.items():
            steps = counts[span]
            upto = list(accumulate(size for _, _, size in steps))
            for i in members:
                s = open_[i]
                at = min(bisect_left(upto, s.target - s.below), len(steps) - 1)
                lo, hi, size = steps[at]
                below = s.below + upto[at] - size
                near, far = s.target - below, below + size - s.target
                edge = (lo, 0) if s.first is None else (s.first, lo)
                over = (hi + 1, 0) if s.first is None else (s.first, hi + 1)
                if min(near, far) <= tolerance:
                    done[i] = edge if near <= far else over
                elif lo == hi and s.first is not None:
                    tied[i] = (s.first, lo, below)
                elif lo == hi:
                    open_[i] = _Search(s.target, lo, 0, (1 << 62) - 1, below)
                else:
                    open_[i] = _Search(s.target, s.first, lo, hi, below)
        open_ = {i: s for i, s in open_.items() if i not in done and i not in tied}
    return done, tied


def find_splitters(narrow: DataFrame, targets: list[float], tolerance: float) -> tuple[dict[int, tuple[int, int]], dict[int, tuple[int, int, int]]]:
    """Least (k1, k2) at or above which rows go to the next range, by the number of its ascending byte target; and what ``_settle`` calls tied."""
    lows = narrow.agg(F.min("k1"), F.max("k1")).first()
    if lows[0] is None:
        return {i: (0, 0) for i in range(len(targets))}, {}
    return _settle(narrow, {i: _Search(t, None, lows[0], lows[1], 0) for i, t in enumerate(targets)}, tolerance)


def _split_ties(keyed: DataFrame, tied: dict[int, tuple[int, int, int]], targets: list[float], tolerance: float) -> tuple[DataFrame, dict[int, tuple[int, int, int]]]:
    """``keyed`` with a number ``_t`` (0 but for rows of the tied keys, which are written with one each), and the splitters (k1, k2, t)."""
    keys = sorted({t[:2] for t in tied.values()})
    listed = F.broadcast(keyed.sparkSession.createDataFrame([(*k, n) for n, k in enumerate(keys)], "_k1 long, _k2 long, _key long"))  # one per splitter at most
    hot = materialize(keyed.join(listed, ["_k1", "_k2"]).withColumn("_t", F.monotonically_increasing_id()), "tied")
    narrow = hot.select(F.col("_key").alias("k1"), F.col("_t").alias("k2"), F.col("_size").alias("size"))
    most = narrow.agg(F.max("k2")).first()[0]
    open_ = {i: _Search(targets[i], keys.index((k1, k2)), 0, most, below) for i, (k1, k2, below) in tied.items()}
    done, single = _settle(narrow, open_, tolerance)
    # a row is the least that can be cut: it goes where it lies by its first byte
    found = {i: (*keys[done[i][0]], done[i][1]) if i in done else (*keys[single[i][0]], single[i][1] + 1) for i in tied}
    plain = keyed.join(listed.drop("_key"), ["_k1", "_k2"], "left_anti").withColumn("_t", F.lit(0).cast("long"))
    return plain.unionByName(hot.drop("_key")), found


def histogram_sort(df: DataFrame, first: Column, second: Column, size: Column, shards: int, tolerance: float = 0.002) -> DataFrame:
    """``df`` with ``shard`` (0..shards-1) and ``slot`` (gapless from 0 in each shard), bytes near equal.

    ``first`` and ``second`` are non-negative long keys below 2**62; rows are ordered by them, and rows equal in both
    by a number, where a shard's end falls among them. ``tolerance`` is the
    allowed error of a splitter as a share of a shard's bytes; it is met wherever single rows
    are no larger. Columns of ``df`` named like the added ones are replaced. Empty input gives
    an empty result. Fewer rows than shards leave shards empty.
    """
    keyed = df.drop("shard", "slot", "_k1", "_k2", "_t", "_key", "_size").withColumns({"_k1": first, "_k2": second, "_size": size.cast("long")})
    narrow = materialize(keyed.select(F.col("_k1").alias("k1"), F.col("_k2").alias("k2"), F.col("_size").alias("size")), "histogram")
    total = narrow.agg(F.sum("size")).first()[0] or 0
    finer = max(1, min(-(-total // (shards * RANGE_BYTES)), MAX_RANGES // shards))
    ranges = shards * finer
    targets = [total * i / ranges for i in range(1, ranges)]
    done, tied = find_splitters(narrow, targets, tolerance * total / shards)
    bare = narrow.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.lit(0).cast("long").alias("_t"))
    keyed, tied = _split_ties(keyed, tied, targets, tolerance * total / shards) if tied else (keyed.withColumn("_t", F.lit(0).cast("long")), {})
    bare = keyed.select("_k1", "_k2", "_t") if tied else bare
    cuts = sorted([(*k, 0) for k in done.values()] + list(tied.values()))

    # the splitters, by the coarse step of the first key in which they lie: 4096 + MAX_RANGES entries at most
    step = 1 << COARSE
    ends = [bisect_left(cuts, (b * step, -1, -1)) for b in range((1 << 12) + 1)]
    steps = [(b, ends[b], cuts[ends[b] : ends[b + 1]]) for b in range(1 << 12)]
    spark = df.sparkSession
    coarse = F.broadcast(spark.createDataFrame(steps, "_step long, _before int, _cuts array<struct<k1:long,k2:long,t:long>>"))

    def placed(x: DataFrame) -> DataFrame:
        key = F.struct(F.col("_k1").alias("k1"), F.col("_k2").alias("k2"), F.col("_t").alias("t"))
        at = x.join(coarse, F.shiftright(F.col("_k1"), COARSE) == F.col("_step"), "left")
        return at.withColumn("_range", F.col("_before") + F.size(F.filter("_cuts", lambda c: c <= key))).drop("_step", "_before", "_cuts")

    rows = {r["_range"]: r["n"] for r in placed(bare).groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}
    discard(narrow)
    starts = []
    for s in range(shards):
        at = 0
        for f in range(finer):
            starts.append((s * finer + f, s, at))
            at += rows.get(s * finer + f, 0)
    start = F.broadcast(spark.createDataFrame(starts, "_range int, shard int, _start long"))
    ordered = Window.partitionBy("_range").orderBy("_k1", "_k2", "_t")
    out = placed(keyed).withColumn("_at", F.row_number().over(ordered)).join(start, "_range")
    return out.withColumn("slot", F.col("_start") + F.col("_at") - 1).drop("_range", "_start", "_at", "_k1", "_k2", "_t", "_size")


def shard_documents(docs: DataFrame, shards: int = 16, tolerance: float = 0.002) -> DataFrame:
    """Documents sorted by the hash of their text, so that equal texts lie side by side, then by that of the id.

    Size is the text's UTF-8 bytes plus 1 (null: 1). Shards hold near-equal bytes; a group of equal
    texts is cut only where the tolerance calls for it. Null ids sort by the hash of null.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    return histogram_sort(docs, hash_key(F.col("text")), hash_key(F.col("doc_id")), size, shards, tolerance)


def op4_histogram_sort(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near-equal bytes (law ``bytes``); null text counts as empty."""
    out = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return out.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
