"""Weighted fair queueing of sources to target weights.

Every source is shuffled by hash and served in that order for up to ``max_epochs`` passes. A
document's virtual finish time is the words its source has served, itself included, divided
by the source's weight. All services, sorted by virtual finish time, are taken while the
words they hold stay within the total budget. A source that has served all its passes leaves
its share to the others, which is what sharing the excess by weight comes to.

No source and no time range is handled by one task: both running sums are taken over
ranges of the shuffle hash or of virtual time, joined with the sums of the ranges before. Equal rows are counted first
and served in pieces of bounded size; only where a service ends among them are they written with a number each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.words import hash_key, n_words, null_safe
from gridloom.storage import discard, materialize

#: Rows of a range of the shuffle hash, about; equal rows served as one piece, at most.
RANGE_ROWS = 4096
PIECE_ROWS = 64
#: Tables of one row per source are sent to every task up to so many sources; beyond, they are joined by a shuffle.
BROADCAST_SOURCES = 10_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_SOURCES else df


def source_targets(sizes: DataFrame, weights: list[float], share: float, max_epochs: int) -> DataFrame:
    """source, _s, source_size, weight, target, level for ``sizes`` (source, _s, source_size).

    Sources in code-point order, null last, get ``weights`` in turn. Of ``share`` times all words each
    gets in proportion to its weight; none above ``max_epochs`` times its size, the excess going to the others
    by weight. Solved in one pass over the sources sorted by size / weight: the level at which
    the budget is met is the first, and greatest, that lies below the own limit of the source it was found at.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("weight", F.get(turn, ((F.row_number().over(order) - 1) % len(weights)).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("limit", F.col("cap") / F.col("weight"))
    before = Window.orderBy("limit", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    full = Window.partitionBy()
    s = s.withColumns({
        "filled": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "left": F.sum("weight").over(full) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        "budget": F.sum("source_size").over(full) * F.lit(float(share)),
    })
    own = (F.col("budget") - F.col("filled")) / F.col("left")
    s = s.withColumn("level", F.max(F.when(own <= F.col("limit"), own)).over(full))
    s = s.withColumn("target", F.when(F.col("level").isNull() | (F.col("limit") <= F.col("level")), F.col("cap")).otherwise(F.col("weight") * F.col("level")))
    return s.select("source", "_s", "source_size", "weight", "target", "level", "budget")


def shuffle_key(seed: int, id_col: Column, text: Column, source: Column) -> Column:
    return hash_key(F.lit(seed), id_col, text, source)


def fair_mix(docs: DataFrame, weights: list[float] = (3.0, 1.0, 2.0), share: float = 1.5, max_epochs: int = 2, seed: int = 17) -> DataFrame:
    """``docs`` with size, source_size, target, copies (services taken, 0..max_epochs) and taken (words: copies * size).

    ``docs`` has doc_id, text and source; further columns pass through, those named like an
    added one are replaced. Null text has no words; null source is a source of its own, last
    in order. Documents without words are served free: as often as the words around them.
    Rows equal in id, text and source follow each other and are taken one by one, so that
    whole documents only are taken and each source ends within one document of its target. The shuffle is a
    hash, so reruns agree whatever the partitions (among equal rows, in how many are taken).
    """
    added = {"size": n_words(F.col("text")), "_h": shuffle_key(seed, F.col("doc_id"), F.col("text"), F.col("source")), "_s": null_safe(F.col("source"))}
    docs = docs.drop("source_size", "target", "taken", "copies", "_t", "_n", "_ends").withColumns(added)
    ledger = materialize(docs.groupBy("source", "_s", "_h", "size").agg(F.count(F.lit(1)).alias("_n")), "mix")
    sizes = ledger.groupBy("source", "_s").agg(F.sum(F.col("size") * F.col("_n")).alias("source_size"))
    targets = materialize(source_targets(sizes, list(weights), share, max_epochs), "targets")
    stats = ledger.agg(F.count(F.lit(1)).alias("rows")).first()
    sources = targets.count()

    bits = max(0, min(16, (stats["rows"] // RANGE_ROWS).bit_length()))
    ranged = ledger.withColumn("_r", F.shiftright("_h", 62 - bits).cast("int")).withColumn("_words", F.col("size") * F.col("_n"))
    base = ranged.groupBy("_s", "_r").agg(F.sum("_words").alias("_sum"))
    base = base.withColumn("_base", F.sum("_sum").over(Window.partitionBy("_s").orderBy("_r")) - F.col("_sum")).drop("_sum")
    served = ranged.withColumn("_in", F.sum("_words").over(Window.partitionBy("_s", "_r").orderBy("_h", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_words"))
    served = served.join(base, ["_s", "_r"]).join(_small(targets.select("_s", "source_size", "weight", "level", "budget"), sources), "_s")
    # pieces of equal rows: the first is number _lo of them, the last before _hi
    served = served.withColumn("_lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(PIECE_ROWS).cast("long"))))
    served = served.withColumn("_hi", F.least(F.col("_lo") + PIECE_ROWS, F.col("_n")))
    epoch = F.explode(F.array(*[F.lit(e) for e in range(max_epochs)]))
    served = served.select("_s", "_h", "size", "_lo", "_hi", "level", "budget", (F.col("_base") + F.col("_in") + F.col("_hi") * F.col("size")).alias("_at"), "source_size", "weight", epoch.alias("_e"))
    served = served.withColumn("_f", (F.col("_at") + F.col("_e") * F.col("source_size")) / F.col("weight"))

    # virtual time in ranges of equal length hold near-equal numbers of words, as each source is served at its rate
    steps = 1 << bits
    level = F.greatest(F.coalesce("level", F.lit(1.0)), F.lit(1e-9))
    served = served.withColumn("_v", F.floor(F.least(F.col("_f") / level * steps, F.lit(4.0 * steps))).cast("int"))
    words = (F.col("_hi") - F.col("_lo")) * F.col("size")
    served = materialize(served.select("_s", "_h", "size", "_lo", "_hi", "_e", "_f", "_v", words.alias("_words"), "budget"), "served")
    times = served.groupBy("_v").agg(F.sum("_words").alias("_sum"))
    times = times.withColumn("_to", F.sum("_sum").over(Window.orderBy("_v")))
    times = F.broadcast(times.select("_v", "_to", (F.col("_to") - F.col("_sum")).alias("_from")))  # 4 * 2**16 + 1 rows at most
    dated = served.join(times, "_v")
    place = ["_s", "_e", "_h", "size"]
    whole = dated.where("_to <= budget").select(*place, F.col("_hi").alias("_upto"))
    # the one range in which the budget runs out, and in it the one piece
    part = dated.where("_from <= budget and _to > budget")
    run = Window.partitionBy("_v").orderBy("_f", "_s", "_h", "size", "_lo", "_e").rowsBetween(Window.unboundedPreceding, 0)
    room = F.col("budget") - F.col("_from") - F.sum("_words").over(run) + F.col("_words")
    fits = F.when(F.col("size") == 0, F.col("_hi") - F.col("_lo")).otherwise(F.least(F.col("_hi") - F.col("_lo"), F.floor(F.col("_room") / F.col("size"))))
    part = part.withColumn("_room", room).where("_room >= 0").withColumn("_upto", F.col("_lo") + fits).where("_upto > _lo").select(*place, "_upto")
    last = whole.unionByName(part).groupBy("_s", "_e").agg(F.max(F.struct("_h", "size", "_upto")).alias("_last"))
    last = materialize(last, "last")
    ends = F.map_from_entries(F.collect_list(F.struct("_e", "_last")))  # max_epochs entries
    cuts = targets.select("_s", "source_size", "target").join(last.groupBy("_s").agg(ends.alias("_ends")), "_s", "left")
    cuts = materialize(cuts, "cuts")
    split = last.select("_s", "_last.*").join(ledger, ["_s", "_h", "size"]).where("_n > 1 and _upto < _n").select("_s", "_h", "size").distinct()
    split = materialize(split, "split")  # one row per source and epoch at most
    discard(ledger, targets, served, last)

    docs = docs.withColumn("_t", F.lit(0).cast("long")) if split.isEmpty() else _numbered(docs, _small(split, sources * max_epochs))
    here = F.struct("_h", "size", (F.col("_t") + 1).alias("_upto"))
    copies = sum((F.coalesce((here <= F.try_element_at("_ends", F.lit(e))).cast("int"), F.lit(0)) for e in range(max_epochs)), F.lit(0))
    out = docs.join(_small(cuts, sources), "_s").withColumn("copies", copies)
    return out.withColumn("taken", F.col("copies") * F.col("size")).drop("_s", "_h", "_t", "_ends")


def _numbered(docs: DataFrame, split: DataFrame) -> DataFrame:
    """``docs`` with ``_t``: a number from 0 among the equal rows of the keys ``split`` (_s, _h, size), 0 for all other rows.

    The rows of those keys are written first, so that numbers stay; they are counted by the partition they were written from.
    """
    key = ["_s", "_h", "size"]
    hot = materialize(docs.join(split, key).withColumn("_row", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_row", 33)), "equal")
    before = hot.groupBy(*key, "_p").agg(F.count(F.lit(1)).alias("_c"))
    before = before.withColumn("_before", F.sum("_c").over(Window.partitionBy(*key).orderBy("_p")) - F.col("_c")).drop("_c")
    inside = F.row_number().over(Window.partitionBy(*key, "_p").orderBy("_row"))
    hot = hot.withColumn("_i", inside).join(before, [*key, "_p"]).withColumn("_t", F.col("_before") + F.col("_i") - 1)
    return docs.join(split, key, "left_anti").withColumn("_t", F.lit(0).cast("long")).select(*docs.columns, "_t").unionByName(hot.select(*docs.columns, "_t"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each taken document once per copy, with the columns of ``docs``."""
    kept = fair_mix(docs, **how)
    return kept.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select(*docs.columns)


def op6_fair_mix(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, with weights 3, 1, 2 in turn and 150 % of all words."""
    out = fair_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.col("size").cast("long").alias("size"), F.col("source_size").cast("long").alias("source_size"), "target", F.col("taken").cast("long").alias("taken"))
