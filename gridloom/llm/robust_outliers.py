"""Quality rules: counts of whole texts, then robust multivariate outliers.

Each language and source has a minimum-covariance-determinant estimate of where its documents'
statistics lie. It is found by concentration steps from two starts (coordinate-wise medians
with quartile spreads, and the classical estimate): the fraction of documents nearest by
Mahalanobis distance gives the next mean and covariance, and of both ends that of the smaller
determinant counts, times the factor that makes it consistent for normal data. Documents whose distance
is beyond a quantile of the chi-square distribution are rejected.

Estimates of few documents are drawn to wider ones, at every size by one formula: that of a source of n documents and
that of its language weigh n and ``DRAW``, so do that of the language and that of all documents, and that of all and a
wide diagonal weigh n and ``DRAW_ALL``.

A concentration step is one aggregation: moments per group and distance class, the
classes in fine equal ratios, summed from the nearest class up. Statistics are whole
numbers, so every sum is exact and reruns agree. No group meets in one task. Built-in
functions only.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.words import null_safe, words
from gridloom.storage import discard, materialize

#: Statistics are kept in thousandths and cut at this, so sums of products of 2e9 documents fit a long.
TOP = 60_000
#: Documents that an estimate's wider one counts for, and the same for the wide diagonal (thousandths) behind that of all.
DRAW, DRAW_ALL, WIDE = 50.0, 5.0, 500.0
#: Share of the documents an estimate rests on.
CORE = 0.75
STEPS = 4
#: Step of the percentiles that the search starts from (thousandths).
START_STEP = 20.0
#: Variance of rounding to whole numbers, and a share of the trace; they keep covariances regular.
ROUNDING, RIDGE = 1.0 / 12.0, 1e-6
#: Share of normal documents that the cutoff rejects.
LEVEL = 1e-6
#: Models are sent to every task up to so many groups; beyond, they are joined by a shuffle.
BROADCAST_GROUPS = 10_000
STATS = ("x0", "x1", "x2", "x3", "x4")


def _let(value: Column, body) -> Column:
    """body(value) with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(w: Column) -> Column:
    """Words of ``w`` that lie in a 5-word window found twice or more, each word once."""

    def grams(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2), F.get(h, i + 3), F.get(h, i + 4)))

    def covered(g: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            key = lambda j: F.get(s, j)["h"]
            twin = F.filter(s, lambda x, j: F.coalesce(key(j - 1) == x["h"], F.lit(False)) | F.coalesce(key(j + 1) == x["h"], F.lit(False)))
            starts = F.sort_array(F.transform(twin, lambda x: x["i"]))
            return _let(starts, lambda r: F.aggregate(F.transform(r, lambda i, j: F.least(F.lit(5), F.coalesce(F.get(r, j + 1) - i, F.lit(5)))), F.lit(0).cast("long"), lambda a, b: a + b))

        placed = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(_let(placed, of_sorted))

    return F.when(F.size(w) < 6, F.lit(0).cast("long")).otherwise(_let(grams(w), covered))


def base_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_distinct, n_capitals, n_signs, n_lines, base_failed.

    Null text counts as empty: all zero, base_failed. Windows are compared by 64-bit hashes within a text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"[\x20\x09-\x0D]", "") != "")
    # all that is made of the words stands in one expression, as pushing a filter down would copy theirs into each use
    of_words = _let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("c"), _repeated(w).alias("r"), F.size(F.array_distinct(w)).cast("long").alias("d")))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("d")))
    out = docs.withColumns({"_w": of_words, "_x": of_lines}).withColumns({
        "n_words": F.col("_w.n"),
        "word_chars": F.col("_w.c"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long"),
        "n_dup_lines": F.col("_x.n") - F.col("_x.d"),
        "n_repeat_words": F.col("_w.r"),
        "n_distinct": F.col("_w.d"),
        "n_capitals": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"),
        "n_signs": F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\x20\x09-\x0D]")).cast("long"),
        "n_lines": F.col("_x.n"),
    }).drop("_w", "_x")
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def statistics() -> dict[str, Column]:
    """The transformed statistics, in thousandths: word length, signs, capitals, words a line, distinct words.

    All vary among ordinary documents. Shares are taken over the words plus a constant, so that those of short texts,
    which swing widely, are drawn in; logarithms even out long tails.
    """
    n = F.col("n_words") + 50.0
    raw = (
        F.log((F.col("word_chars") + 275.0) / n),
        F.log((F.col("n_signs") + 8.0) / n),
        F.log((F.col("n_capitals") + 5.0) / n),
        F.log(n / (F.col("n_lines") + 3.0)),
        F.log(F.col("n_distinct") + 50.0) / F.log(n),
    )
    return {name: F.greatest(F.lit(-TOP), F.least(F.lit(TOP), F.round(1000.0 * x).cast("long"))).cast("long") for name, x in zip(STATS, raw, strict=True)}


def _chi2_share(x: float, p: int) -> float:
    """Share of a chi-square distribution of ``p`` degrees of freedom that lies below x, by the series of the incomplete gamma function."""
    a, y = p / 2.0, x / 2.0
    if y <= 0.0:
        return 0.0
    term = total = 1.0 / a
    k = a
    while term > total * 1e-17:
        k += 1.0
        term *= y / k
        total += term
    return min(1.0, total * math.exp(a * math.log(y) - y - math.lgamma(a)))


def chi2_quantile(share: float, p: int) -> float:
    low, high = 0.0, 1e3
    for _ in range(200):
        mid = (low + high) / 2.0
        low, high = (mid, high) if _chi2_share(mid, p) < share else (low, mid)
    return high


def consistency(core: float, p: int) -> float:
    """What the covariance of the nearest share ``core`` of normal documents is multiplied by to estimate that of all."""
    return core / _chi2_share(chi2_quantile(core, p), p + 2)


_PAIRS = [(i, j) for i in range(len(STATS)) for j in range(i + 1)]


def _moments() -> list[Column]:
    x = [F.col(c) for c in STATS]
    return [F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(x)], *[F.sum(x[i] * x[j]).alias(f"p{i}{j}") for i, j in _PAIRS]]


_SUMS = ["n", *[f"s{i}" for i in range(len(STATS))], *[f"p{i}{j}" for i, j in _PAIRS]]


def _model(m: DataFrame, keys: list[str], passed: list[str]) -> DataFrame:
    """Mean m*, covariance c**, its Cholesky factor l** and log-determinant, from sums."""
    n, dims = F.col("n").cast("double"), range(len(STATS))
    m = m.select(*keys, *passed, "n", *[(F.col(f"s{i}") / n).alias(f"m{i}") for i in dims], *[F.col(f"p{i}{j}").cast("double").alias(f"p{i}{j}") for i, j in _PAIRS])
    m = m.select(*keys, *passed, *[f"m{i}" for i in dims], *[(F.col(f"p{i}{j}") / n - F.col(f"m{i}") * F.col(f"m{j}")).alias(f"c{i}{j}") for i, j in _PAIRS])
    return _factor(_regular(m))


def _regular(m: DataFrame) -> DataFrame:
    """Adds rounding and ridge to the variances."""
    more = F.lit(ROUNDING) + F.lit(RIDGE) * reduce(lambda a, b: a + b, [F.greatest(F.col(f"c{i}{i}"), F.lit(0.0)) for i in range(len(STATS))])
    return m.withColumns({f"c{i}{i}": F.greatest(F.col(f"c{i}{i}"), F.lit(0.0)) + more for i in range(len(STATS))})


def _factor(m: DataFrame) -> DataFrame:
    for j in range(len(STATS)):
        below = reduce(lambda a, k: a - F.col(f"l{j}{k}") ** 2, range(j), F.col(f"c{j}{j}"))
        # only rounding errors of doubles reach below what _regular added
        m = m.withColumn(f"l{j}{j}", F.sqrt(F.greatest(below, F.lit(ROUNDING / 2))))
        rest = {}
        for i in range(j + 1, len(STATS)):
            rest[f"l{i}{j}"] = reduce(lambda a, k, i=i: a - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), F.col(f"c{i}{j}")) / F.col(f"l{j}{j}")
        m = m.withColumns(rest) if rest else m
    logdet = reduce(lambda a, b: a + b, [F.log(f"l{j}{j}") for j in range(len(STATS))])
    return m.withColumn("logdet", logdet)


def _distance(df: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution."""
    for i in range(len(STATS)):
        df = df.withColumn(f"z{i}", reduce(lambda a, k, i=i: a - F.col(f"l{i}{k}") * F.col(f"z{k}"), range(i), F.col(STATS[i]) - F.col(f"m{i}")) / F.col(f"l{i}{i}"))
    return df.withColumn("d2", reduce(lambda a, b: a + b, [F.col(f"z{i}") ** 2 for i in range(len(STATS))])).drop(*[f"z{i}" for i in range(len(STATS))])


def fit_mcd(points: DataFrame, broadcast: bool, groups: int | None = None) -> DataFrame:
    """(g, n, m*, c**) per ``g``, of ``groups``, of ``points`` (g, x0..x4): documents, mean and consistent covariance of the core."""
    rows = groups and 2 * groups
    small = F.broadcast if broadcast else (lambda x: x)
    # a start may be coarse; few distinct values keep the exact percentiles small
    coarse = lambda c: F.round(F.col(c) / START_STEP).cast("long")
    quarts = points.groupBy("g").agg(*[F.percentile(coarse(c), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{i}") for i, c in enumerate(STATS)])
    quarts = quarts.select("g", *[F.transform(f"q{i}", lambda x: x * START_STEP).alias(f"q{i}") for i in range(len(STATS))])
    robust = quarts.select("g", F.lit(0).alias("start"), *[F.get(f"q{i}", F.lit(1)).alias(f"m{i}") for i in range(len(STATS))], *[
        ((F.get(f"q{i}", F.lit(2)) - F.get(f"q{i}", F.lit(0))) ** 2 / 1.82 if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in _PAIRS
    ])
    classic = _model(points.groupBy("g").agg(*_moments()).withColumn("start", F.lit(1)), ["g", "start"], [])
    model = materialize(_factor(_regular(robust)).unionByName(classic).withColumn("n", F.lit(0).cast("long")), "mcd", rows)
    upto = Window.partitionBy("g", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    for _ in range(STEPS):
        near = _distance(points.join(small(model.drop("n")), "g"))
        near = near.withColumn("bin", F.floor(64.0 * F.log1p(F.col("d2"))).cast("int"))
        bins = near.groupBy("g", "start", "bin").agg(*_moments())
        bins = bins.withColumn("_before", F.coalesce(F.sum("n").over(upto), F.lit(0))).withColumn("_all", F.sum("n").over(Window.partitionBy("g", "start")))
        core = bins.where(F.col("_before") < CORE * F.col("_all")).groupBy("g", "start").agg(F.max("_all").alias("_all"), *[F.sum(c).alias(c) for c in _SUMS])
        old, model = model, materialize(_model(core, ["g", "start"], ["_all"]).withColumnRenamed("_all", "n"), "mcd", rows)
        discard(old)
    dims = range(len(STATS))
    best = model.groupBy("g").agg(F.min(F.struct("logdet", "start", "n", *[f"m{i}" for i in dims], *[f"c{i}{j}" for i, j in _PAIRS])).alias("b"))
    factor = consistency(CORE, len(STATS))
    best = best.select("g", "b.n", *[f"b.m{i}" for i in dims], *[(F.col(f"b.c{i}{j}") * factor).alias(f"c{i}{j}") for i, j in _PAIRS])
    best = materialize(best, "mcd", rows)
    discard(model)
    return best


def _drawn(own: DataFrame, wider: DataFrame, key: str) -> DataFrame:
    """``own`` (key, n, m*, c** and others) drawn to the row of ``wider`` (key, m*, c**)."""
    names = [f"m{i}" for i in range(len(STATS))] + [f"c{i}{j}" for i, j in _PAIRS]
    both = own.join(wider.select(key, *[F.col(c).alias(f"w_{c}") for c in names]), key)
    return both.withColumns({c: (F.col("n") * F.col(c) + DRAW * F.col(f"w_{c}")) / (F.col("n") + DRAW) for c in names}).drop(*[f"w_{c}" for c in names])


def quality_rules(docs: DataFrame, level: float = LEVEL, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all, if none are named) with the base counts, ``base_failed``, ``distance2`` and ``kept``.

    ``docs`` has text, lang and source; null languages and sources form groups of their own. The
    estimates rest on documents that passed the base rules; others have distance2 null. ``level`` is the share of
    normal documents that the distance rejects. Repeated rows count as often as they stand. Columns named like an added one
    are replaced. The texts are read once. Empty input gives an empty result.
    """
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_capitals", "n_signs", "n_lines", "base_failed"]
    added = [*counts, "distance2", "kept"]
    carried = [c for c in (carry or docs.columns) if c not in added]
    lang = F.concat(F.col("lang").isNull().cast("string"), null_safe(F.col("lang")))
    group = F.concat(lang, F.lit("\u0000"), null_safe(F.col("source")))
    bare = docs.drop(*[c for c in docs.columns if c in [*added, "_l", "_g", "_w", "_x"]])
    counted = materialize(base_counts(bare.withColumns({"_l": lang, "_g": group})).select(*[c for c in carried if c in bare.columns], *counts, "_l", "_g"), "counted")
    return _judge(counted, chi2_quantile(1.0 - level, len(STATS))).select(*[c for c in carried if c in bare.columns], *counts, "distance2", "kept")


def _judge(counted: DataFrame, cutoff: float) -> DataFrame:
    points = materialize(counted.where(~F.col("base_failed")).select("_l", "_g", *[c.alias(n) for n, c in statistics().items()]), "points")
    groups = materialize(points.select("_l", "_g").distinct(), "groups")
    count = groups.count()
    small = F.broadcast if count <= BROADCAST_GROUPS else (lambda x: x)
    # each document counts for all, its language and its source there
    levels = F.explode(F.array(F.lit("0"), F.concat(F.lit("1"), F.col("_l")), F.concat(F.lit("2"), F.col("_g"))))
    fitted = fit_mcd(points.select(levels.alias("g"), *STATS), count <= BROADCAST_GROUPS // 3, 2 * count + 1)
    everything = fitted.where("g = '0'").withColumn("_k", F.lit(0))
    weigh = lambda c, wide: (F.col("n") * F.col(c) + DRAW_ALL * F.lit(wide)) / (F.col("n") + DRAW_ALL)
    everything = everything.withColumns({f"c{i}{j}": weigh(f"c{i}{j}", WIDE**2 if i == j else 0.0) for i, j in _PAIRS})
    langs = _drawn(fitted.where("g like '1%'").withColumns({"_l": F.substring("g", 2, 1 << 30), "_k": F.lit(0)}).drop("g"), everything.drop("g", "n"), "_k")
    own = fitted.where("g like '2%'").withColumn("_g", F.substring("g", 2, 1 << 30)).drop("g").join(groups, "_g")
    model = materialize(_factor(_drawn(own, langs.select("_l", *[c for c in langs.columns if c[0] in "mc"]), "_l")).drop("_l", "n", "logdet", *[f"c{i}{j}" for i, j in _PAIRS]), "mcd", count)
    discard(points, groups, fitted)
    judged = _distance(counted.withColumns(statistics()).join(small(model), "_g", "left"))
    judged = judged.withColumn("distance2", F.when(~F.col("base_failed"), F.col("d2")))
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance2") <= cutoff, F.lit(False)))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The counts and verdicts of all documents, by doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return quality_rules(docs, carry=["doc_id"])
